"""Embedding near-duplicates by NN-descent (operator 3).

A neighbour graph holds, for each vector, a list of its best neighbours so far. It starts from
random-projection buckets: vectors of one bucket meet in one task. Each round joins
every vector's neighbours, and those that have it as a neighbour, and compares them with each other:
neighbours of neighbours become neighbours. Lists whose every entry reaches the threshold are
saturated and are doubled. The rounds end when few lists change.

The lists steer the search only. Ties stand apart from them and are never dropped: wherever vectors
meet, a spanning forest of all their pairs at the threshold is kept. Ties connect components; components that
came near each other are compared whole, in blocks. Within a component, links are then counted exactly,
in blocks of vectors, so a vector's number of links is not bounded by its list.
Equal vectors are one node, whatever their number.

Recall is audited against brute force: the links of queries, picked by a hash, are sought among all
vectors, in passes, until enough of the queries outside the largest components have links or ``ASKED`` vectors, in a
smaller table all, were asked: the audit's work grows with the table, whatever its links. While recall is too low, more buckets and
rounds follow; each start has buckets enough for 1 - ``RECALL`` of the pairs at the threshold to be missed by it alone. A table of any size whose
recall is still too low after ``STARTS`` starts is at last compared whole, in passes of ``MOST_QUERIES`` queries: the work is quadratic, memory is bounded.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, dropped, ids, written

#: Neighbours of a list at first, and at most: links beyond are counted in blocks.
FIRST_K, MOST_K = 8, 64
#: Nodes that have a node in their lists and are joined at it.
REVERSE = 8
#: Vectors of a bucket that meet in one task; fuller buckets are split.
BUCKET = 256
#: Random-projection tables that start the graph, at least, and tables dealt at once.
TABLES = 12
#: Starts of the graph at most.
STARTS = 8
#: Rounds of neighbour joins at most, after each start.
ROUNDS = 3
#: Growth of the lists' mean cosine that calls for another round, where no new link does.
GROWTH = 0.01
#: Queries of the audit's first pass and of a later one, and the recall it asks for.
QUERIES, MOST_QUERIES, RECALL = 256, 4096, 0.995
#: Queries with links that an average needs, and queries asked at most. If none of so many has a link, fewer than 1 in 5000 vectors have one, with a confidence of 0.96.
ENOUGH, ASKED = 256, 1 << 14
#: Share of all vectors over which a component is one of the largest.
LARGEST = 0.01
#: Values of the hash that picks queries.
SLOTS = 1 << 40
#: Vectors of a component that a task compares: two blocks of half as many.
GROUP = 4096


def unit(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 in double precision, and which rows have one: null, zero, or rows with
    null or non-finite components, or whose length has no double, have none."""
    dim = max((len(v) for v in vectors if v is not None), default=0)
    out = np.zeros((len(vectors), dim))
    ok = np.zeros(len(vectors), bool)
    for k, v in enumerate(vectors):
        if v is None or not len(v):
            continue
        x = np.array([np.nan if c is None else c for c in v], np.float64)
        top = np.abs(x).max()
        if np.isfinite(x).all() and top > 0:
            x = x / top  # so that squares neither vanish nor overflow
            out[k, : len(x)] = x / np.sqrt((x * x).sum())
            ok[k] = True
    return out, ok


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length as rows."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _normalised(table: DataFrame) -> DataFrame:
    """``vec_id, node, dim, v``: rows with a direction; equal vectors have equal nodes."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).to_pylist()
            x, ok = unit(vectors)
            at = np.flatnonzero(ok)
            rows = [x[k, : len(vectors[k])] for k in at]
            # rounding apart: multiples of a vector may differ in last bits and are then near vectors
            node = [xxhash.xxh3_64_intdigest((r + 0.0).tobytes()) - (1 << 63) for r in rows]
            yield pa.RecordBatch.from_arrays([ids(batch, "vec_id").take(pa.array(at)), pa.array(node, pa.int64()), pa.array([len(r) for r in rows], pa.int32()), pa.array(rows, pa.list_(pa.float64()))], ["vec_id", "node", "dim", "v"])

    return table.select("vec_id", "embedding").mapInArrow(run, "vec_id long, node long, dim int, v array<double>")


def _best(node: np.ndarray, x: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """The best ``k`` partners of each vector among the others, as (a, b, cosine)."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    k = min(k, len(node) - 1)
    if k < 1:
        return []
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    a = np.repeat(node, k)
    return list(zip(a.tolist(), node[top].ravel().tolist(), np.take_along_axis(s, top, axis=1).ravel().tolist(), strict=True))


def _forest(hit: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the pairs in ``hit``, and each row's tree."""
    tree, pairs = np.arange(len(hit)), []
    left = hit.any(axis=1)
    for root in np.flatnonzero(left).tolist():
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front:
            a = front.pop()
            new = np.flatnonzero(hit[a] & left).tolist()
            left[new] = False
            tree[new] = root
            pairs += [(a, b) for b in new]
            front += new
    return pairs, tree


def near(threshold: float) -> float:
    """The cosine at twice the threshold's angle: vectors that link to one vector are no farther apart."""
    return math.cos(min(math.pi, 2 * math.acos(max(-1.0, min(1.0, threshold)))))


def _ties(node: np.ndarray, x: np.ndarray, threshold: float) -> list[tuple[int, int, float]]:
    """Pairs to keep whatever the lists hold: a forest of all pairs at the threshold, and the closest
    pair of each two near trees of which one is large enough to fill its lists."""
    s = x @ x.T
    np.fill_diagonal(s, -2)
    pairs, tree = _forest(s >= threshold)
    size = np.bincount(tree, minlength=len(node))
    close = (s >= near(threshold)) & (s < threshold) & (tree[:, None] < tree) & ((size[tree] >= FIRST_K)[:, None] | (size[tree] >= FIRST_K))
    a, b = np.nonzero(close)
    by = np.lexsort((-s[a, b], tree[b], tree[a]))
    a, b = a[by], b[by]
    first = np.ones(len(a), bool)
    first[1:] = (tree[a][1:] != tree[a][:-1]) | (tree[b][1:] != tree[b][:-1])
    pairs += zip(a[first].tolist(), b[first].tolist(), strict=True)
    return [(int(node[i]), int(node[j]), float(s[i, j])) for i, j in pairs]


_EDGE = "a long, b long, s double, tie boolean"


def _edges(found: list[tuple[int, int, float]], tie: bool) -> pa.RecordBatch:
    a, b, s = zip(*found, strict=True) if found else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64()), pa.array([tie] * len(a), pa.bool_())], ["a", "b", "s", "tie"])


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list]]:
    """Runs of rows with equal first ``keys`` columns, of batches sorted by them."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row)
    if rows:
        yield key, rows


def _bits(n: int) -> int:
    """Bits of a bucket's code."""
    return max(1, min(30, int(np.ceil(np.log2(max(2, n) / (BUCKET / 8))))))


def tables_for(n: int, threshold: float) -> int:
    """Tables that put a pair at the threshold into one bucket at least once, but for 1 - ``RECALL`` of such pairs."""
    side = 1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi
    together = min(0.999, max(0.001, side ** _bits(n)))
    return max(TABLES, math.ceil(math.log(1 - RECALL) / math.log1p(-together)))


def _buckets(nodes: DataFrame, n: int, tables: range, k: int, threshold: float) -> DataFrame:
    """First neighbours, the best of each vector in its bucket of each table, and ties."""
    bits = _bits(n)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = _matrix(batch.column(2).take(pa.array(at)))
                node = np.asarray(batch.column(0))[at]
                for t in tables:
                    plane = np.random.default_rng([31, t, dim]).standard_normal((dim, bits))
                    code = ((x @ plane > 0) @ (1 << np.arange(bits))).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t, np.int32)), pa.array(np.full(len(at), dim, np.int32)), pa.array(code), pa.array(node), batch.column(2).take(pa.array(at))], ["t", "dim", "code", "node", "v"])

    dealt = nodes.select("node", "dim", "v").mapInArrow(deal, "t int, dim int, code long, node long, v array<double>")
    # full buckets are split at random, otherwise in each table
    sizes = dealt.groupBy("t", "dim", "code").agg(F.ceil(F.count("*") / BUCKET).alias("parts"))
    split = dealt.join(sizes, ["t", "dim", "code"]).withColumn("part", F.pmod(F.xxhash64("node", "t"), F.col("parts")))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = []
        ties: list = []
        for _, rows in _grouped(batches, 4):
            node, x = np.array([r[4] for r in rows]), np.array([r[5] for r in rows])
            found += _best(node, x, k)
            ties += _ties(node, x, threshold)
            if len(found) + len(ties) > 50_000:
                yield _edges(found, False)
                yield _edges(ties, True)
                found, ties = [], []
        yield _edges(found, False)
        yield _edges(ties, True)

    keys = ["t", "dim", "code", "part"]
    return split.select(*keys, "node", "v").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(meet, _EDGE)


def _lists(edges: DataFrame, threshold: float) -> DataFrame:
    """``a, b, s, tie, listed``: the neighbour lists, each node's best partners, and all ties.

    A list holds ``FIRST_K`` partners, doubled while all of them are links, up to ``MOST_K``. Ties
    beyond it are kept, but not ``listed``.
    """
    best = Window.partitionBy("a").orderBy(F.desc("s"), "b")
    one = edges.groupBy("a", "b").agg(F.max("s").alias("s"), F.max("tie").alias("tie"))
    kept = one.withColumn("rank", F.row_number().over(best)).where((F.col("rank") <= MOST_K) | F.col("tie"))
    links = F.sum(((F.col("s") >= threshold) & (F.col("rank") <= MOST_K)).cast("int")).over(Window.partitionBy("a"))
    room, k = F.lit(MOST_K), MOST_K // 2
    while k >= FIRST_K:
        room = F.when(links < k, k).otherwise(room)
        k //= 2
    return kept.withColumn("listed", F.col("rank") <= room).where("listed or tie").select("a", "b", "s", "tie", "listed")


def _round(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Joins each node's neighbours and reverse neighbours and compares them with each other: edges found."""
    lists = lists.where("listed")
    back = lists.select(F.col("b").alias("hub"), F.col("a").alias("node"), "s")
    back = back.withColumn("rank", F.row_number().over(Window.partitionBy("hub").orderBy(F.desc("s"), "node"))).where(F.col("rank") <= REVERSE)
    at = lists.select(F.col("a").alias("hub"), F.col("b").alias("node")).union(back.select("hub", "node")).union(nodes.select(F.col("node").alias("hub"), "node")).distinct()
    at = at.join(nodes.select("node", "v"), "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], float] = {}
        ties: dict[tuple[int, int], float] = {}
        for _, rows in _grouped(batches, 1):
            node, x = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            for a, b, s in _best(node, x, FIRST_K * 2):
                found[a, b] = s
            for a, b, s in _ties(node, x, threshold):
                ties[a, b] = s
            if len(found) + len(ties) > 100_000:
                yield _edges([(a, b, s) for (a, b), s in found.items()], False)
                yield _edges([(a, b, s) for (a, b), s in ties.items()], True)
                found, ties = {}, {}
        yield _edges([(a, b, s) for (a, b), s in found.items()], False)
        yield _edges([(a, b, s) for (a, b), s in ties.items()], True)

    return at.select("hub", "node", "v").repartition("hub").sortWithinPartitions("hub").mapInArrow(meet, _EDGE)


def descend(nodes: DataFrame, n: int, threshold: float, tables: range, before: DataFrame | None = None) -> DataFrame:
    """The neighbour graph's lists after buckets of ``tables`` and rounds of neighbour joins."""
    lists = before
    for t in range(tables.start, tables.stop, TABLES):
        found = _buckets(nodes, n, range(t, min(t + TABLES, tables.stop)), FIRST_K, threshold)
        after = written(_lists(found if lists is None else found.unionByName(lists.drop("listed")), threshold), "lists")
        if lists is not None:
            dropped(lists)
        lists = after
    state = lists.where("listed").agg(F.sum((F.col("s") >= threshold).cast("long")), F.avg("s")).first()
    for _ in range(ROUNDS):
        after = written(_lists(_round(lists, nodes, threshold).unionByName(lists.drop("listed")), threshold), "lists")
        dropped(lists)
        lists = after
        now = lists.where("listed").agg(F.sum((F.col("s") >= threshold).cast("long")), F.avg("s")).first()
        settled = now[0] == state[0] and (now[1] or 0) <= (state[1] or 0) * (1 + GROWTH)
        state = now
        if settled:
            break
    return lists


def _blocks(size: str):
    """In how many blocks a component of so many nodes is compared: of half ``GROUP`` each."""
    return F.when(F.col(size) <= GROUP // 2, 1).otherwise(F.ceil(F.col(size) / (GROUP // 2))).cast("int")


def connected(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """``node, comp``: components of all links kept, after components near each other were compared.

    Of two near components the larger one is the centre; its members are compared with those of all its
    smaller neighbours, in blocks, each pair of blocks in a task of its own.
    """
    edges = lists.where(F.col("s") >= threshold).select("a", "b")
    groups = written(components(edges, "near"), "groups")
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size"))
    of = nodes.select("node").join(groups, "node", "left").join(sizes, "comp", "left")
    of = of.select("node", F.coalesce("comp", "node").alias("comp"), F.coalesce("size", F.lit(1)).alias("size"))
    close = lists.where((F.col("s") < threshold) & (F.col("s") >= near(threshold))).select("a", "b")
    close = close.join(of.select(F.col("node").alias("a"), F.struct("size", "comp").alias("x")), "a").join(of.select(F.col("node").alias("b"), F.struct("size", "comp").alias("y")), "b")
    # two vectors alone have met already
    close = close.where("x.comp <> y.comp and (x.size > 1 or y.size > 1)").select(F.greatest("x", "y").alias("big"), F.least("x", "y").alias("small")).distinct()
    pairs = written(close.select(F.col("big.comp").alias("centre"), F.col("big.size").alias("size"), F.col("small.comp").alias("comp"), F.col("small.size").alias("other")), "near-pairs")
    centres = pairs.groupBy("centre").agg(F.max("size").alias("size"), F.sum("other").alias("around"))
    centres = centres.select("centre", _blocks("size").alias("bx"), _blocks("around").alias("by"))
    inner = centres.join(of.select(F.col("comp").alias("centre"), "node"), "centre").withColumn("i", F.pmod(F.xxhash64("node"), F.col("bx")).cast("int"))
    outer = pairs.select("centre", "comp").join(of.select("comp", "node"), "comp").join(centres, "centre").withColumn("j", F.pmod(F.xxhash64("node"), F.col("by")).cast("int"))
    inner = inner.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("by") - 1))).select("centre", "i", "j", F.lit(0).alias("side"), "node")
    outer = outer.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("bx") - 1))).select("centre", "i", "j", F.lit(1).alias("side"), "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 3):
            side, node = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
            width = np.array([len(r[5]) for r in rows])
            found: list[tuple[int, int]] = []
            for dim in np.unique(width).tolist():
                one, two = (np.flatnonzero((side == k) & (width == dim)) for k in (0, 1))
                if not len(one) or not len(two):
                    continue
                x = np.array([rows[k][5] for k in one])
                # the centre is connected: one link of a neighbour's vector ties it
                for k in range(0, len(two), 512):
                    s = np.array([rows[m][5] for m in two[k : k + 512]]) @ x.T
                    at = s.argmax(axis=1)
                    hit = s[np.arange(len(s)), at] >= threshold
                    found += zip(node[two[k : k + 512][hit]].tolist(), node[one[at[hit]]].tolist(), strict=True)
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    keys = ["centre", "i", "j"]
    sent = inner.union(outer).join(nodes.select("node", "v"), "node").select(*keys, "side", "node", "v")
    more = written(sent.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(meet, "a long, b long"), "near-ties")
    if more.isEmpty():
        return groups
    stars = groups.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return written(components(stars.union(more), "near"), "groups")


def _counted(nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """``node, links``: rows that each node of a component links to, its own other rows left out.

    Components are compared in blocks of half ``GROUP`` nodes, each pair of blocks in a task of its own.
    """
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size"))
    blocks = F.when(F.col("size") <= GROUP, 1).otherwise(F.ceil(F.col("size") / (GROUP // 2)))
    placed = groups.join(sizes, "comp").withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    sent = placed.join(nodes, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("comp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "copies", "v")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, links = [], []
        for (_, i, j), rows in _grouped(batches, 3):
            side, own, copies = (np.array([r[k] for r in rows]) for k in (3, 4, 5))
            x = np.array([r[6] for r in rows])
            total = np.zeros(len(rows), np.int64)
            for a in range(0, len(rows), 512):
                hit = x[a : a + 512] @ x.T >= threshold
                if i != j:
                    hit &= side[a : a + 512, None] != side
                else:
                    hit[np.arange(len(hit)), np.arange(a, a + len(hit))] = False
                total[a : a + 512] = hit @ copies
            node += own.tolist()
            links += total.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(links, pa.int64())], ["node", "links"])

    dealt = sent.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return dealt.mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _asked(nodes: DataFrame, lo: float, hi: float):
    """The queries of a pass, nodes whose hash lies in a range of its values, shared by number of dimensions."""
    at = F.pmod(F.xxhash64("node", F.lit(3)), F.lit(SLOTS))
    picked = nodes.where((at >= int(lo * SLOTS)) & (at < int(hi * SLOTS))).select("node", "v").collect()
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {len(r["v"]) for r in picked}:
        own = [r for r in picked if len(r["v"]) == dim]
        by_dim[dim] = np.array([r["node"] for r in own]), np.array([r["v"] for r in own])
    return nodes.sparkSession.sparkContext.broadcast(by_dim)


def _met(batches: Iterator[pa.RecordBatch], by_dim: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ``node, dim, copies, v`` in blocks: dimensions, queries, nodes, copies, and which are links."""
    for batch in batches:
        dims = np.asarray(batch.column(1))
        for dim, (own, q) in by_dim.items():
            every = np.flatnonzero(dims == dim)
            for k in range(0, len(every), 1024):
                at = every[k : k + 1024]
                x = _matrix(batch.column(3).take(pa.array(at)))
                node, copies = (np.asarray(batch.column(c))[at] for c in (0, 2))
                yield dim, own, node, copies, (q @ x.T, own[:, None] != node)


def audit(nodes: DataFrame, groups: DataFrame, result: DataFrame, n: int, threshold: float) -> tuple[float, int]:
    """The least recall of ``result(node, links)`` on linked queries, and their number, by brute force.

    A query's recall is the share of its links that were found. It is averaged over all linked queries, over those outside
    the largest components, and over those with about as many links where there are ``ENOUGH``. Passes
    of queries follow each other until ``ENOUGH`` outside the largest components have links or ``ASKED`` nodes were asked.
    """
    sizes = groups.groupBy("comp").agg(F.count("*").alias("size"))
    of_node = written(result.join(groups, "node").join(sizes, "comp").select("node", "links", (F.col("size") > LARGEST * n).alias("large")), "audited")
    sums: dict[tuple[bool, int], np.ndarray] = {}
    lo, step, end = 0.0, QUERIES / max(1, n), min(1.0, ASKED / max(1, n))
    while lo < end:
        hi = min(end, lo + step)
        shared = _asked(nodes, lo, hi)

        def count(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total: dict[int, int] = {}
            for _, own, _, copies, (s, other) in _met(batches, shared.value):
                for k, c in zip(own.tolist(), (((s >= threshold) & other) @ copies).tolist(), strict=True):
                    total[k] = total.get(k, 0) + c
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["node", "links"])

        true = nodes.select("node", "dim", "copies", "v").mapInArrow(count, "node long, links long").groupBy("node").agg(F.sum("links").alias("true")).where(F.col("true") > 0)
        found = of_node.join(F.broadcast(true), "node", "right").select(F.coalesce("large", F.lit(False)).alias("large"), F.floor(F.log2("true")).alias("about"), (F.least("true", F.coalesce("links", F.lit(0))) / F.col("true")).alias("recall"))
        for r in found.groupBy("large", "about").agg(F.count("*").alias("n"), F.sum("recall").alias("recall")).collect():
            key = r["large"], r["about"]
            sums[key] = sums.get(key, np.zeros(2)) + np.array([r["n"], r["recall"]])
        shared.unpersist()
        lo, step = hi, min(MOST_QUERIES / max(1, n), 4 * step)
        if sum(v[0] for (large, _), v in sums.items() if not large) >= ENOUGH:
            break
    if not sums:
        return 1.0, 0
    every = sum(sums.values())
    outside = sum((v for (large, _), v in sums.items() if not large), np.zeros(2))
    about = [sum(v for (_, a), v in sums.items() if a == k) for k in {a for _, a in sums}]
    judged = [every] + [v for v in [outside] if v[0]] + [v for v in about if v[0] >= ENOUGH]
    return float(min(v[1] / v[0] for v in judged)), int(every[0])


def compared(nodes: DataFrame, n: int, threshold: float) -> DataFrame:
    """``a, b``: links that connect what is connected, by comparing all vectors with each other, in passes.

    A task sends a link for each vector that has one, and what else connects the pass's queries.
    """
    out, lo, step = None, 0.0, MOST_QUERIES / max(1, n)
    while lo < 1:
        hi = min(1.0, lo + step)
        shared = _asked(nodes, lo, hi)

        def tie(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tree: dict[int, np.ndarray] = {}
            for dim, own, node, _, (s, other) in _met(batches, shared.value):
                of = tree.setdefault(dim, np.arange(len(own)))
                hit = (s >= threshold) & other
                found: list[tuple[int, int]] = []
                for k in np.flatnonzero(hit.any(axis=0)).tolist():
                    at = np.flatnonzero(hit[:, k])
                    trees, first = np.unique(of[at], return_index=True)
                    found += [(int(node[k]), int(own[q])) for q in at[first]]
                    if len(trees) > 1:
                        of[np.isin(of, trees)] = trees[0]
                a, b = zip(*found, strict=True) if found else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        more = written(nodes.select("node", "dim", "copies", "v").mapInArrow(tie, "a long, b long"), "near-ties")
        out = more if out is None else out.union(more)
        shared.unpersist()
        lo = hi
    return out


def near_vectors(table: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for ``table(vec_id, embedding)``.

    Rows link when their vectors' cosine in double precision is at least ``threshold``. Null or
    zero vectors, and vectors with null or non-finite components, link with nothing, as do vectors of different lengths.
    Repeated rows are rows of their own that link with each other. Null ids are kept: they name
    no component that has another id, and ``kept`` is false. An empty table gives no rows.
    Further columns are not read.
    """
    table = table.select("vec_id", "embedding")
    rows = written(_normalised(table), "vectors")
    nodes = written(rows.groupBy("node", "dim").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("v").alias("v")), "nodes")
    n = nodes.count()
    lists, tables = None, tables_for(n, threshold)
    for start in range(STARTS):
        lists = descend(nodes, n, threshold, range(start * tables, (start + 1) * tables), lists)
        groups = connected(lists, nodes, threshold)
        counted = written(_counted(nodes, groups, threshold), "counted")
        recall, queries = audit(nodes, groups, counted, n, threshold)
        logging.getLogger(__name__).info("recall %.4f over %d linked queries after %d tables", recall, queries, (start + 1) * tables)
        if recall >= RECALL:
            break
    else:
        logging.getLogger(__name__).warning("recall is %.4f after %d starts; all vectors are compared", recall, STARTS)
        groups = written(components(compared(nodes, n, threshold), "near"), "groups")
        counted = written(_counted(nodes, groups, threshold), "counted")
    least = nodes.select("node", "least").join(groups, "node").groupBy("comp").agg(F.min("least").alias("component_id"))
    of_node = nodes.join(groups, "node", "left").join(least, "comp", "left").join(counted, "node", "left")
    of_node = of_node.select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = rows.select("vec_id", "node").join(of_node, "node").select("vec_id", "n_links", "component_id")
    alone = _without_direction(table).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _without_direction(table: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, ok = unit(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([ids(batch, "vec_id").take(pa.array(np.flatnonzero(~ok)))], ["vec_id"])

    return table.mapInArrow(run, "vec_id long")
