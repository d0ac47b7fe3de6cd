"""Exact n-gram Jaccard join with set-relation skipping (operator 10).

A document's set is its distinct word n-grams, as 64-bit hashes. Sets are joined as follows.

1. A bounded counting sketch over all sets puts n-grams in one global order, rare ones first.
   The order only steers the work: any fixed order gives whole results.
2. Equal sets become one class. A class's prefix, its first n-grams in the order, must share an
   n-gram with the prefix of each class it links to. So the prefixes form an inverted index.
   Its lists are in order of size, and what no other set of the list can reach by size is dropped.
3. Within a list, blocks are skipped by size and by the n-gram's position: what stands before and behind it in
   two sets bounds their overlap. Pairs left are held against bitmaps of the sets: the bits in
   which two bitmaps differ are at most the n-grams in which the sets differ. What passes is a tie.
4. Ties form groups, and only grouped sets are fetched, each once (in large groups, once for
   each pair of blocks). Within a group the overlaps of one set with all others come from
   index lists. A set derives its overlaps from those of the closest set already answered, by
   the lists of the few n-grams in which the two differ, where that is less work; a set whose possible partners are all
   connected to it is skipped.
5. Links form components. Only as many links as connect them leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, dropped, ids, slices, strings, written

#: Text bytes hashed at once: each takes about eighty bytes of memory.
SLICE = 1 << 19
#: Cells of the counting sketch; it is 4 MB at any size of the corpus.
CELLS = 1 << 20
#: The sketch travels in so many parts.
PARTS = 64
#: Bits of a set's bitmap, and of the second bitmap of sets over ``LARGE`` n-grams.
BITS, MORE_BITS, LARGE = 1024, 8192, 1000
#: Rows of a list that one task compares: two blocks of half as many.
LIST = 2048
#: Rows of a list up to which its pairs are compared with those of other lists.
SHORT = 24
#: Sets that a task compares with each other: two blocks of half as many.
GROUP = 1600
_odd = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(_odd), -1, 1 << 64))
        for name, b in (("up", _odd), ("down", inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str], width: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; those of a long one are found part by part."""
    if all(len(t) <= 2 * SLICE for t in texts):
        return _shingle_sets([t.encode() for t in texts], width)
    out = []
    for t in texts:
        raw, at, found = t.encode(), 0, []
        while len(raw) - at > 2 * SLICE:
            cut = max(raw.rfind(b" ", at + SLICE, at + 2 * SLICE), raw.rfind(b"\n", at + SLICE, at + 2 * SLICE))
            if cut < 0:
                break  # one word
            part = raw[at:cut]
            if len(part.split(None, width)) >= width:
                found.append(_shingle_sets([part], width)[0])
            # the next part begins with the words that its first n-grams share with this one
            keep = part.rsplit(None, width - 1)
            at = at + len(keep[0]) if len(keep) == width else at
            if len(keep) < width:
                break  # a few words fill the part
        found.append(_shingle_sets([raw[at:]], width)[0])
        out.append(np.unique(np.concatenate(found)))
    return out


def _shingle_sets(raw: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text.

    A-Z are lower-cased; words are what ASCII white space parts. A text of fewer words than
    ``width`` has its whole sequence as one n-gram; a text without words has none.
    """
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[data]
    inside = np.concatenate([[False], ~space])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _power(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((_LOWER[data] + np.uint64(1)) * up[: len(data)])])
    word = _mix((sums[end] - sums[begin]) * down[begin])
    ends = np.cumsum([len(r) + 1 for r in raw])
    bound = np.searchsorted(begin, np.concatenate([[0], ends]))
    gram = np.full(max(0, len(word) - width + 1), width, np.uint64)
    for k in range(width):
        gram = _mix(gram * _odd + word[k : k + len(gram)])
    out = []
    for a, b in zip(bound.tolist(), bound[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(gram[a : b - width + 1]))
        elif b > a:
            h = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                h = _mix(h * _odd + word[k])
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(grams: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _sketch(docs: DataFrame, width: int) -> np.ndarray:
    """How common an n-gram's cell is: 0 for what is not above the background, else its magnitude."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        held: list[np.ndarray] = []
        size = 0
        for batch in slices(batches, "text", SLICE):
            for s in shingle_sets(strings(batch), width):
                held.append(s)
                size += len(s)
            if size > CELLS:
                total += np.bincount((np.concatenate(held) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
                held, size = [], 0
        if held:
            total += np.bincount((np.concatenate(held) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if total.any():
            yield _parts(total)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = _unpacked(raw)
                total[part] = total[part] + x if part in total else x
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([_packed(x) for x in total.values()], pa.binary())], ["part", "counts"])

    got = docs.select("text").mapInArrow(count, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary").collect()
    cells = np.zeros((PARTS, CELLS // PARTS), np.int64)
    for r in got:
        cells[r["part"]] = _unpacked(r["counts"])
    cells = cells.ravel()
    mean = cells.mean()
    above = cells - mean
    common = above > max(64.0, 6 * np.sqrt(mean))
    return np.where(common, 1 + np.log2(np.maximum(above, 1)), 0).astype(np.uint8)


def _packed(x: np.ndarray) -> bytes:
    import zlib

    return zlib.compress(x.astype("<u8").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    import zlib

    return np.frombuffer(zlib.decompress(raw), "<u8").astype(np.int64)


def _parts(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([_packed(x) for x in total.reshape(PARTS, -1)], pa.binary())], ["part", "counts"])


def bitmap(grams: np.ndarray, bits: int) -> bytes:
    """The parity of the n-grams that fall on each bit."""
    n = np.bincount(((grams >> np.uint64(20)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((n & 1).astype(np.uint8)).tobytes()


def _prefixes(docs: DataFrame, width: int, percent: int, common: np.ndarray) -> DataFrame:
    """``doc_id, text_hash, n, node, prefix, bits, more``: set size, class, the n-grams that a linked set's prefix must meet, and bitmaps."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in slices(batches, limit=SLICE):
            sets = shingle_sets(strings(batch), width)
            prefix = []
            for s in sets:
                x = level[(s & np.uint64(CELLS - 1)).astype(np.int64)]
                by = s[np.argsort(x, kind="stable")] if x.any() else s
                prefix.append(by[: len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0].view(np.int64))
            more = [bitmap(s, MORE_BITS) if len(s) > LARGE else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [ids(batch), ids(batch, "text_hash"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_node(s) for s in sets], pa.int64()), pa.array(prefix, pa.list_(pa.int64())), pa.array([bitmap(s, BITS) for s in sets], pa.binary()), pa.array(more, pa.binary())],
                ["doc_id", "text_hash", "n", "node", "prefix", "bits", "more"],
            )

    return docs.select("doc_id", "text_hash", "text").mapInArrow(run, "doc_id long, text_hash long, n long, node long, prefix array<long>, bits binary, more binary")


def _lists(classes: DataFrame, percent: int) -> DataFrame:
    """``token, n, pos, node``: index rows that have a neighbour in their list within reach of size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the row before, and whether it is out already
        out = False
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            token, n = (np.asarray(rows.column(k), dtype=np.int64) for k in (0, 1))
            near = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:])
            keep = np.concatenate([near, [False]]) | np.concatenate([[False], near])
            end = bool(keep[-1])
            if last is not None and out:
                keep[0] = False
            last, out = rows.take(pa.array([rows.num_rows - 1])), end
            if keep.any():
                yield rows.filter(pa.array(keep))

    rows = classes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).select("token", "n", "pos", "node")
    return rows.repartition("token").sortWithinPartitions("token", "n").mapInArrow(run, "token long, n long, pos int, node long")


def may_link(n: np.ndarray, pos: np.ndarray, bits: np.ndarray, more: np.ndarray | None, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of rows (a, b) of a list may link, by size, position and bitmaps."""
    na, nb = n[a], n[b]
    need = -(-percent * (na + nb) // (100 + percent))
    keep = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    keep &= np.minimum(pos[a], pos[b]) + 1 + np.minimum(na - pos[a], nb - pos[b]) - 1 >= need
    at = np.flatnonzero(keep)
    differ = np.bitwise_count(bits[a[at]] ^ bits[b[at]]).sum(axis=1, dtype=np.int64)
    at = at[differ <= (na + nb - 2 * need)[at]]
    if more is not None:
        both = at[(na[at] > LARGE) & (nb[at] > LARGE)]
        differ = np.bitwise_count(more[a[both]] ^ more[b[both]]).sum(axis=1, dtype=np.int64)
        bad = both[differ > (na + nb - 2 * need)[both]]
        at = np.setdiff1d(at, bad, True)
    out = np.zeros(len(a), bool)
    out[at] = True
    return out


def _stars(pairs: np.ndarray) -> np.ndarray:
    """Pairs that connect the same: each class with the least class it is connected to."""
    if not len(pairs):
        return pairs
    nodes, index = np.unique(pairs, return_inverse=True)
    x, y = index.reshape(-1, 2).T
    label = np.arange(len(nodes))
    while True:
        before = label.copy()
        np.minimum.at(label, x, label[y])
        np.minimum.at(label, y, label[x])
        label = label[label]
        if (label == before).all():
            break
    tied = label != np.arange(len(nodes))
    return np.stack([nodes[label[tied]], nodes[tied]], axis=1)


def _candidate_ties(lists: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``a, b``: ties that connect all classes that may link."""
    sizes = lists.groupBy("token").agg(F.count("*").alias("size")).where(F.col("size") > LIST)
    placed = lists.join(sizes, "token", "left").withColumn("blocks", F.coalesce(F.ceil(F.col("size") / (LIST // 2)), F.lit(1)).cast("int"))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(classes.select("node", "bits", "more"), "node")
    sent = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = sent.select("token", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "n", "pos", "node", "bits", "more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task sends a star for each group of its ties: a row for each class, not for each tie."""
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]
                x = y
            return x

        for pairs in found(batches):
            for a, b in pairs.tolist():
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        tied = [(root(x), x) for x in list(up)]
        tied = [t for t in tied if t[0] != t[1]]
        yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in tied], pa.int64()) for k in (0, 1)], ["a", "b"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            # whole lists are compared; the last one may go on in the next batch
            key = np.stack([np.asarray(batch.column(k), dtype=np.int64) for k in range(3)])
            other = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0))
            first = held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in range(3))
            cut = int(other[-1]) + 1 if len(other) else 0
            if (first or cut) and rows:
                yield ties([*held, batch.slice(0, cut)] if cut else held)
                held, rows = [], 0
            elif cut:
                yield ties([batch.slice(0, cut)])
            held.append(batch.slice(cut))
            rows += batch.num_rows - cut
        if rows:
            yield ties(held)

    def ties(batches: list[pa.RecordBatch]) -> np.ndarray:
        t = pa.Table.from_batches([b for b in batches if b.num_rows])
        token, i, j, block, n, pos, node = (np.asarray(t.column(k), dtype=np.int64) for k in range(7))
        bits = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint64).reshape(len(n), -1)
        more = None
        if t.column(8).null_count < len(n):
            more = np.frombuffer(b"".join(x or bytes(MORE_BITS // 8) for x in t.column(8).to_pylist()), np.uint64).reshape(len(n), -1)
        new = np.ones(len(n), bool)
        new[1:] = (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(n)))
        passed: list[np.ndarray] = []

        def hold(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            ok = (i[a] == j[a]) | (block[a] != block[b])
            ok[ok] = may_link(n, pos, bits, more, a[ok], b[ok], percent)
            passed.append(np.stack([node[a[ok]], node[b[ok]]], axis=1))
            return ok

        for m in np.unique(size[size <= SHORT]).tolist():
            x, y = np.triu_indices(m, 1)
            at = start[size == m]
            for k in range(0, len(at), max(1, 50_000 // max(1, len(x)))):
                part = at[k : k + max(1, 50_000 // max(1, len(x)))]
                hold((part[:, None] + x).ravel(), (part[:, None] + y).ravel())
        for a, m in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist(), strict=True):
            label = np.arange(m)
            for x in range(1, m):
                # rows are in order of size: those before are no larger; what is connected already is skipped
                low = np.searchsorted(100 * n[a : a + x], percent * n[a + x], "left")
                y = low + np.flatnonzero(label[low:x] != label[x])
                if len(y):
                    ok = hold(np.full(len(y), a + x), a + y)
                    roots = np.unique(label[y[ok]])
                    if len(roots):
                        label[np.isin(label, roots)] = label[x]
        pairs = np.concatenate(passed) if passed else np.zeros((0, 2), np.int64)
        return _stars(pairs[pairs[:, 0] != pairs[:, 1]])

    keys = ["token", "i", "j"]
    return sent.repartition(*keys).sortWithinPartitions(*keys, "n").mapInArrow(run, "a long, b long").distinct()


def connect(sets: list[np.ndarray], nodes: np.ndarray, side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that connect what is connected among ``sets``: pairs of indices.

    ``side``: block of each set; where there are two, only links between them are looked for,
    as each block is compared with itself elsewhere.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets])
    by = np.argsort(size, kind="stable")
    sets, size, side, nodes = [sets[k] for k in by], size[by], side[by], nodes[by]
    # index lists of n-grams, in blocks by position of size: a set's partners are one range of positions
    every = np.concatenate(sets) if m else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(m), size)
    grams, code = np.unique(every, return_inverse=True)
    order = np.argsort(code, kind="stable")
    lists, bound = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(grams)))])
    starts = np.concatenate([[0], np.cumsum(size)])
    codes = [code[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    low = np.searchsorted(100 * size, percent * size, "left")
    high = np.searchsorted(percent * size, 100 * size, "right")
    two = len(np.unique(side)) > 1
    label = np.arange(m)
    out: list[tuple[int, int]] = []

    def counts(tokens: np.ndarray) -> np.ndarray:
        """How many of the tokens each set holds."""
        n = bound[tokens + 1] - bound[tokens]
        total = int(n.sum())
        if not total:
            return np.zeros(m, np.int64)
        at = np.repeat(bound[tokens] - (np.cumsum(n) - n), n) + np.arange(total)
        return np.bincount(lists[at], minlength=m)

    held = np.zeros((m, m), np.int32)  # overlaps with all sets, of each set answered so far
    answered: list[int] = []
    for x in range(m):
        near = slice(low[x], high[x])
        open_ = label[near] != label[x]
        if two:
            open_ &= side[near] != side[x]
        if not open_.any():
            continue  # its partners are all connected to it
        # in how many n-grams each answered set differs: the closest one's overlaps need the fewest lists
        differ = size[answered] + size[x] - 2 * held[answered, x] if answered else np.zeros(0, np.int64)
        if len(differ) and differ.min() <= size[x] // 2:
            y = answered[int(differ.argmin())]
            overlap = held[y] + counts(np.setdiff1d(codes[x], codes[y], True)) - counts(np.setdiff1d(codes[y], codes[x], True))
        else:
            overlap = counts(codes[x])
        held[x] = overlap
        answered.append(x)
        o = overlap[near]
        linked = open_ & (100 * o >= percent * (size[near] + size[x] - o))
        for root in np.unique(label[near][linked]).tolist():
            y = low[x] + int(np.flatnonzero(linked & (label[near] == root))[0])
            out.append((int(by[x]), int(by[y])))
            label[label == root] = label[x]
    return out


def _links(docs: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: links that connect the classes of each group."""
    sizes = members.groupBy("comp").agg(F.count("*").alias("size"))
    blocks = F.ceil(F.col("size") / (GROUP // 2)).cast("int")
    placed = members.join(sizes, "comp").withColumn("blocks", F.when(F.col("size") <= GROUP, 1).otherwise(blocks))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), "node", "comp", "blocks", "block")
    # a text stands for a class; the hash keeps null ids and repeated ids apart
    # merged at every size: texts move once, and neither side is held in memory
    joined = docs.join(placed.hint("merge"), docs["doc_id"].eqNullSafe(F.col("of_doc")) & (docs["text_hash"] == F.col("of_text"))).select("text", "node", "comp", "blocks", "block")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            rows = []
            for s, node, comp, blocks, block in zip(shingle_sets(strings(batch), width), *(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                if _node(s) != node:
                    continue  # another text of the same hash
                raw = s.tobytes()
                for other in range(blocks):
                    if blocks == 1 or other != block:
                        rows.append((comp, min(block, other), max(block, other), block, node, raw))
                if blocks > 1:
                    rows.append((comp, block, block, block, node, raw))
            if rows:
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["comp", "i", "j", "block", "node", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            for comp, i, j, block, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (comp, i, j) != key and group:
                    yield answer(group)
                    group = []
                key = (comp, i, j)
                group.append((block, node, np.frombuffer(raw, np.uint64)))
        if group:
            yield answer(group)

    def answer(group: list[tuple]) -> pa.RecordBatch:
        side, nodes = np.array([g[0] for g in group]), np.array([g[1] for g in group], np.int64)
        nodes, one = np.unique(nodes, return_index=True)  # repeated rows
        pairs = connect([group[k][2] for k in one], nodes, side[one], percent)
        return pa.RecordBatch.from_arrays([pa.array(nodes[[p[0] for p in pairs]], pa.int64()), pa.array(nodes[[p[1] for p in pairs]], pa.int64())], ["a", "b"])

    dealt = joined.mapInArrow(fetch, "comp long, i int, j int, block int, node long, grams binary").repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long")


def _joined(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``doc_id, text_hash, n, node, comp``: each row's set size and class, and the class that names its component."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = written(_prefixes(docs, width, percent, _sketch(docs, width)), "prefixes")
    classes = written(found.where("n > 0").select("node", "n", "prefix", "bits", "more").dropDuplicates(["node"]), "classes")
    lists = written(_lists(classes, percent), "lists")
    groups = components(_candidate_ties(lists, classes, percent), "ties")
    dropped(lists, classes)
    # of each class, one row stands for all: its text is fetched
    one = found.where("n > 0").select("doc_id", "text_hash", "node").join(groups, "node").groupBy("node", "comp").agg(F.min(F.struct("doc_id", "text_hash")).alias("one"))
    members = written(one.select("node", "comp", "one.*"), "members")
    links = components(_links(docs, members, width, percent), "links")
    dropped(groups, members)
    rows = found.select("doc_id", "text_hash", "n", F.when(F.col("n") > 0, F.col("node")).alias("node"))
    out = written(rows.join(links, "node", "left").select("doc_id", "text_hash", "n", "node", F.coalesce("comp", "node").alias("comp")), "joined")
    dropped(found, links)
    return out


def ngram_join(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for ``docs(doc_id, text)``.

    Documents link when 100 * |intersection| >= ``percent`` * |union| of their n-gram sets;
    a component is what links connect, named by its smallest id. Null texts and texts without
    words have no n-grams and link with nothing. Repeated rows each have a row; rows of one id
    with different texts are joined apart; null ids are kept and name no component if another
    id is there. An empty table gives no rows. Further columns are not read. Every n-gram of a
    text counts; those of a long text are found part by part.
    """
    rows = _joined(docs, width, percent)
    # the least id of each class, then of each component: a common class is a partial aggregate
    least = rows.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    with_words = rows.where("n > 0").join(least, "comp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    without = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return with_words.unionByName(without)


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all columns as they are: that of the smallest id, a null id only where there is no other.

    Of different texts of that id, and of null ids, the one of the least hash stays; of rows equal in id and text, any one.
    Rows without words, null texts too, link with nothing and stay, but for repeated ones. An empty table gives no rows.
    """
    rows = _joined(docs, width, percent)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    best = rows.where("n > 0").groupBy("comp").agg(F.min(order).alias("x")).select(F.col("x.doc_id").alias("of_doc"), F.col("x.text_hash").alias("of_text"))
    best = best.unionByName(rows.where("n = 0").select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")).distinct())
    whole = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_doc"), F.xxhash64("text").alias("own_text"))
    out = whole.join(best.hint("merge"), F.col("own_doc").eqNullSafe(F.col("of_doc")) & (F.col("own_text") == F.col("of_text")), "left_semi")
    if rows.groupBy("doc_id", "text_hash").agg(F.count("*").alias("c")).where("c > 1").limit(1).count():
        out = out.groupBy("own_doc", "own_text").agg(F.first("row").alias("row"))
    return out.select("row.*")
