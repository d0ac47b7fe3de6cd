"""Removal of repeated byte strings with suffix arrays (operator 5).

A string of ``length`` bytes that starts at two places is found in these steps.

1. Every window of ``length`` bytes is named by the least hash of its ``anchor``-byte grams. The name
   depends on the window's bytes alone, so equal windows have equal names wherever they are.
   Neighbouring windows mostly share their name: a span is a run of windows of one name.
2. Spans of equal name and bytes are counted. Where a span occurs twice, all its windows are
   repeats. This takes hashes only, combined before they are shuffled, so large groups of
   copies meet as counts.
3. Names with two or more different spans, and spans that hold their name's gram twice, need comparing. One span of each content has its
   bytes fetched and is sent to its name's task. There, suffix arrays of the spans are
   built by two-stage sorting: only suffixes smaller than their successors are sorted directly, the
   others are induced from these by scanning the buckets of first bytes; adjacent suffixes that share
   ``length`` bytes are repeats. The windows of names of more than ``GROUP`` spans are renamed by the bytes that
   neighbouring windows share, ``FINER`` by ``FINER``, which leaves apart what only has the name's gram in common. Names that stay
   large are dealt to several tasks; windows that are single in their task are then counted over all
   tasks of the name.
4. A document's repeats become byte ranges, and the ranges are cut from its text.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dropped, ids, slices, strings, written

LENGTH = 400
ANCHOR = 160
#: Windows of a span at most.
RUN = 2048
#: Spans of one name that one suffix array takes.
GROUP = 256
#: Windows that are renamed together in large names, in turn.
FINER = (80, 8)
#: Bytes of spans that go into one suffix array, unless one name has more.
SORTED_BYTES = 1 << 18
#: Text bytes hashed at once: each takes about eighty bytes of memory.
SLICE = 1 << 19
#: Bytes of one text that are hashed at once.
PIECE = 1 << 20
#: Low bits of a hash that give way to a place while the least is sought: places among so many bytes as are hashed at once.
PLACE_BITS = np.uint64(22)
_base = np.uint64(0x9E3779B97F4A7C15)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        inverse = np.uint64(pow(int(_base), -1, 1 << 64))
        for name, b in (("up", _base), ("down", inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _powers[name] = np.multiply.accumulate(p)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` bytes that start at each place that has so many."""
    up, down = _power(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    h = (sums[width:] - sums[:-width]) * down[: len(data) - width + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours: prefix and suffix minima of blocks, combined."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def spans(data: np.ndarray, ends: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """Spans of texts that lie one after another: text, first window, number of windows, name, whether it may repeat itself.

    ``ends``: where each text ends. Only windows within a text count. A span may hold a window twice
    only if the gram that names it is there twice: some window holds it twice, or there are more
    windows than can hold one place.
    """
    none = np.zeros(0, np.int64)
    nothing = none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    if len(data) < length:
        return nothing
    grams = gram_hashes(data, anchor)
    width = length - anchor + 1
    bits = PLACE_BITS
    high = (grams >> bits) << bits
    place = np.arange(len(grams), dtype=np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    left = sliding_min(high | place, width) & low
    right = low - (sliding_min(high | (low - place), width) & low)
    names = grams[left.astype(np.int64)]
    of = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    at = np.flatnonzero(np.arange(len(names)) <= ends[of[: len(names)]] - length)
    if not len(at):
        return nothing
    new = np.ones(len(at), bool)
    new[1:] = (names[at[1:]] != names[at[:-1]]) | (of[at[1:]] != of[at[:-1]])
    first = np.flatnonzero(new)
    # a long run, of a text that goes on repeating, is cut by its length from its beginning
    age = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(age % RUN == 0)
    count = np.diff(np.append(first, len(at)))
    twice = np.add.reduceat(left[at] != right[at], first) > 0
    return of[at[first]], at[first], count, names[at[first]], twice | (count > width)


#: Values of a suffix's first sorting key: nine bits each.
KEY = 7


def _first_keys(data: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The first ``KEY`` values of each suffix as one number; what lies behind its end counts as 0."""
    n = len(data)
    left = stop - np.arange(n)
    out = np.zeros(n, np.int64)
    for k in range(KEY):
        value = np.zeros(n, np.int64)
        value[: n - k] = data[k:]
        value[left < k] = 0
        out = (out << 9) | value
    return out


def _sorted_directly(at: np.ndarray, keys: np.ndarray, raw: bytes, stop: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` values: by their keys, and those of one key by their bytes."""
    at = at[np.argsort(keys[at], kind="stable")]
    own = keys[at]
    begin = np.flatnonzero(np.diff(own, prepend=-1))
    size = np.diff(np.append(begin, len(at)))
    # a key that ends in 0 holds its whole suffix, so those of one key are equal
    open_ = (size > 1) & (own[begin] & 511 > 0)
    ends, out = np.minimum(stop[at], at + depth).tolist(), at.tolist()
    for a, m in zip(begin[open_].tolist(), size[open_].tolist(), strict=True):
        if m == 2:
            i, j = out[a], out[a + 1]
            if raw[i + KEY : ends[a]] > raw[j + KEY : ends[a + 1]]:
                out[a], out[a + 1] = j, i
        else:
            part = out[a : a + m]
            cut = [raw[i + KEY : j] for i, j in zip(part, ends[a : a + m], strict=True)]
            out[a : a + m] = [part[k] for k in sorted(range(m), key=cut.__getitem__)]
    return np.array(out, np.int64)


def suffix_array(data: np.ndarray, stop: np.ndarray, depth: int) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` values, by two-stage sorting.

    ``data``: values over 0, with a 0 after each string; ``stop``: where each place's string
    has its 0. A suffix ends with its string; those equal so far are in any order.
    """
    n = len(data)
    raw = (data - 1).astype(np.uint8).tobytes()
    following = np.append(data[1:], 0)
    # a suffix is smaller than its successor if the next different value is greater
    change = np.flatnonzero(data != following)
    upcoming = change[np.minimum(np.searchsorted(change, np.arange(n)), len(change) - 1)]
    smaller = following[upcoming] > data[upcoming]
    smaller[data == 0] = True
    direct = np.flatnonzero(smaller & (data > 0))
    ordered = _sorted_directly(direct, _first_keys(data, stop), raw, stop, depth)
    rank = np.full(n, -1, np.int64)
    zeros = np.flatnonzero(data == 0)
    sizes = np.bincount(data, minlength=257)
    begin = np.cumsum(sizes) - sizes
    out = np.empty(n, np.int64)
    out[: len(zeros)] = zeros
    rank[zeros] = 0  # ends are equal
    # directly sorted suffixes stand last in their buckets
    held = np.bincount(data[ordered], minlength=257) if len(ordered) else np.zeros(257, np.int64)
    where = np.repeat(begin + sizes - held, held) + (np.arange(len(ordered)) - np.repeat(np.cumsum(held) - held, held))
    out[where] = ordered
    rank[ordered] = where
    induced = np.flatnonzero(~smaller)
    by_value = induced[np.argsort(data[induced], kind="stable")]
    bounds = np.searchsorted(data[by_value], np.arange(258))
    for value in np.unique(data[induced]).tolist():
        todo, at = by_value[bounds[value] : bounds[value + 1]], begin[value]
        # successors in lower buckets are placed already; a run of one value is induced from its end
        while len(todo):
            ready = rank[todo + 1] >= 0
            now = todo[ready]
            now = now[np.argsort(rank[now + 1], kind="stable")]
            out[at : at + len(now)] = now
            rank[now] = np.arange(at, at + len(now))
            at, todo = at + len(now), todo[~ready]
    return out


def repeated(strings_: list[bytes], length: int) -> list[np.ndarray]:
    """Per string, its places where ``length`` bytes start that also start elsewhere in the strings; and class numbers of all windows."""
    sizes = np.array([len(s) for s in strings_])
    ends = np.cumsum(sizes + 1) - 1
    data = np.zeros(int(ends[-1]) + 1, np.int64)
    keep = np.ones(len(data), bool)
    keep[ends] = False
    data[keep] = np.frombuffer(b"".join(strings_), np.uint8).astype(np.int64) + 1
    stop = np.repeat(ends, sizes + 1)
    order = suffix_array(data, stop, length)
    order = order[stop[order] - order >= length]
    equal = shared_prefix(data, order, length)
    group = np.concatenate([[0], np.cumsum(~equal)]) if len(order) else np.zeros(0, np.int64)
    label = np.full(len(data), -1, np.int64)
    label[order] = group
    begins = ends - sizes
    return [label[b : b + max(0, s - length + 1)] for b, s in zip(begins.tolist(), sizes.tolist(), strict=True)]


def shared_prefix(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Whether adjacent suffixes, all of ``length`` values at least, share so many."""
    raw = (data - 1).astype(np.uint8).tobytes()
    at = order.tolist()
    return np.fromiter((raw[a : a + length] == raw[b : b + length] for a, b in zip(at, at[1:], strict=False)), bool, max(0, len(at) - 1))


def _named_spans(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``name, content, doc_id, text_hash, start, n, twice``: the spans of every text."""
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            raw = [t.encode() for t in strings(batch)]
            # a long text is read part by part; parts share all but one byte of a window, so each window is in one part
            parts = [(k, a, r[a : a + PIECE + length - 1]) for k, r in enumerate(raw) for a in range(0, max(1, len(r) - length + 1), PIECE)]
            for group in [parts] if len(parts) == len(raw) else [[p] for p in parts]:
                joined = b"".join(p[2] for p in group)
                size = np.array([len(p[2]) for p in group], np.int64)
                ends = np.cumsum(size)
                of, at, n, name, twice = spans(np.frombuffer(joined, np.uint8), ends, length, anchor)
                content = np.fromiter((xxhash.xxh3_64_intdigest(joined[a : a + k]) for a, k in zip(at.tolist(), (n + length - 1).tolist(), strict=True)), np.uint64, len(at))
                start = at - (ends - size)[of] + np.array([p[1] for p in group], np.int64)[of]
                take = pa.array(np.array([p[0] for p in group], np.int64)[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), pa.array(content.view(np.int64)), ids(batch).take(take), ids(batch, "text_hash").take(take), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)],
                    ["name", "content", "doc_id", "text_hash", "start", "n", "twice"],
                )

    return docs.mapInArrow(run, "name long, content long, doc_id long, text_hash long, start int, n int, twice boolean")


_SPAN = "name long, gram long, doc_id long, text_hash long, start int, bytes binary"


def _fetched(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of ``wanted`` spans, cut from their documents."""
    lists = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("name", "start", "n")).alias("spans"))
    # repeated rows: one of them gives the bytes
    joined = docs.join(lists, (docs["doc_id"].eqNullSafe(lists["doc_id"])) & (docs["text_hash"] == lists["text_hash"])).select(docs["doc_id"], docs["text_hash"], "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            rows: list[tuple] = []
            for k, (text, found) in enumerate(zip(strings(batch), ids(batch, "spans").to_pylist(), strict=True)):
                raw = text.encode()
                rows += [(k, s["name"], s["start"], raw[s["start"] : s["start"] + s["n"] + length - 1]) for s in found]
            of, name, start, cut = zip(*rows, strict=True)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(name, pa.int64()), ids(batch).take(take), ids(batch, "text_hash").take(take), pa.array(start, pa.int32()), pa.array(cut, pa.binary())], ["name", "gram", "doc_id", "text_hash", "start", "bytes"])

    return joined.mapInArrow(run, _SPAN)


def _refined(large: DataFrame, width: int, length: int, anchor: int) -> DataFrame:
    """Spans of large names, cut and renamed by the bytes that ``width`` neighbouring windows share.

    Equal windows hold their name's gram first at the same place, so they fall into the same
    range of ``width`` places, and all windows of a range hold the bytes in its middle.
    """
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "bytes", SLICE):
            rows: list[tuple] = []
            for k, (gram, start, raw) in enumerate(zip(*(ids(batch, c).to_pylist() for c in ("gram", "start", "bytes")), strict=True)):
                n = len(raw) - length + 1
                at = np.flatnonzero(gram_hashes(np.frombuffer(raw, np.uint8), anchor).view(np.int64) == gram)
                first = at[np.searchsorted(at, np.arange(n))]
                block = (first - np.arange(n)) // width
                edge = np.flatnonzero(np.diff(first, prepend=-1) | np.diff(block, prepend=-1)).tolist()
                for a, b in zip(edge, [*edge[1:], n], strict=True):
                    core = int(first[a]) - int(block[a]) * width
                    h = xxhash.xxh3_64_intdigest(raw[core : core + length - width + 1], seed=int(block[a])) ^ (gram & (1 << 64) - 1)
                    rows.append((k, h - (1 << 64) if h >> 63 else h, start + a, raw[a : b + length - 1]))
            of, name, start, cut = zip(*rows, strict=True)
            take = pa.array(of)
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), *(ids(batch, c).take(take) for c in ("gram", "doc_id", "text_hash")), pa.array(start, pa.int32()), pa.array(cut, pa.binary())], ["name", "gram", "doc_id", "text_hash", "start", "bytes"])

    return large.mapInArrow(run, _SPAN)




def _compared(fetched: DataFrame, length: int) -> DataFrame:
    """Repeats among the spans of a name and task.

    Rows ``doc_id, text_hash, start, stop``: windows from start up to stop begin repeats. With a
    ``window``, the row is one kind of window of a name that several tasks share, to be counted over them;
    it is a repeat within its task if ``repeat`` is set.
    """
    import xxhash

    def emit(group: list[tuple]) -> pa.RecordBatch:
        rows, seen = [], set()
        for (_, salt, doc, text_hash, start, raw), label, count in zip(group, *_labels([g[5] for g in group], length), strict=True):
            held = count > 1
            if salt < 0:
                edge = np.flatnonzero(np.diff(held.astype(np.int8), prepend=0, append=0))
                rows += [(doc, text_hash, start + a, start + b, None, True) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
            else:
                edge = np.flatnonzero(np.diff(held.astype(np.int8), prepend=0, append=0))
                rows += [(doc, text_hash, start + a, start + b, None, True) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
                for k, (own, again) in enumerate(zip(label.tolist(), held.tolist(), strict=True)):
                    if own not in seen:
                        # one row for each kind of window of the task
                        seen.add(own)
                        rows.append((doc, text_hash, start + k, start + k + 1, xxhash.xxh3_128_digest(raw[k : k + length]), again))
        doc, text_hash, start, stop, window, repeat = zip(*rows, strict=True) if rows else ((),) * 6
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(text_hash, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32()), pa.array(window, pa.binary()), pa.array(repeat, pa.bool_())], ["doc_id", "text_hash", "start", "stop", "window", "repeat"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []  # spans of whole names
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # tasks' shares of a name have a suffix array each, so that counts over them are right
                if group and row[:2] != group[-1][:2] and (size >= SORTED_BYTES or row[1] >= 0 or group[-1][1] >= 0):
                    yield emit(group)
                    group, size = [], 0
                group.append(row)
                size += len(row[5])
        if group:
            yield emit(group)

    dealt = fetched.select("name", "salt", "doc_id", "text_hash", "start", "bytes").repartition("name", "salt").sortWithinPartitions("name", "salt")
    return dealt.mapInArrow(run, "doc_id long, text_hash long, start int, stop int, window binary, repeat boolean")


def _labels(strings_: list[bytes], length: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per string, the class of the window at each place, and how many windows that class has."""
    labels = repeated(strings_, length)
    count = np.bincount(np.concatenate(labels))
    return labels, [count[x] for x in labels]


def repeat_ranges(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """``doc_id, text_hash, ranges``: where windows that are repeats start, for texts that have any.

    ``docs(doc_id, text, text_hash)``. Ranges are structs (start, stop), in no order.
    """
    found = written(_named_spans(docs, length, anchor), "spans")
    same = found.groupBy("name", "content").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "text_hash", "start", "n", "twice")).alias("one"))
    kinds = same.groupBy("name").agg(F.count("*").alias("different"))
    same = written(same.join(kinds, "name").where("copies > 1 or different > 1 or one.twice"), "contents")
    whole = found.join(same.where("copies > 1").select("name", "content"), ["name", "content"]).select("doc_id", "text_hash", "start", (F.col("start") + F.col("n")).alias("stop"))
    wanted = same.where("different > 1 or (one.twice and copies = 1)").select("name", "one.*")
    sent = written(_fetched(docs, wanted, length), "fetched")
    made = [found, same, sent]
    # a name of few spans has one task (salt -1); larger ones are renamed, then dealt
    sizes = same.where(F.col("different") > GROUP).select("name", "different").distinct()
    ready = []
    for width in FINER:
        if not sizes.limit(1).count():
            break
        ready.append(sent.join(sizes, "name", "left_anti").withColumn("salt", F.lit(-1)))
        pieces = written(_refined(sent.join(sizes, "name", "left_semi"), width, length, anchor).withColumn("content", F.xxhash64("bytes")), "refined")
        # equal pieces are repeats, one of them goes on; equal windows of one span hold the gram at different
        # places, so they are in different pieces of one name
        kinds = written(pieces.groupBy("name", "content").agg(F.count("*").alias("copies"), F.first(F.struct("gram", "doc_id", "text_hash", "start", "bytes")).alias("one")), "kinds")
        whole = whole.union(pieces.join(kinds.where("copies > 1").select("name", "content"), ["name", "content"]).select("doc_id", "text_hash", "start", (F.col("start") + F.length("bytes") - (length - 1)).alias("stop")))
        made += [pieces, kinds]
        counts = kinds.groupBy("name").agg(F.count("*").alias("different")).where("different > 1")
        sent = kinds.join(counts.select("name"), "name").select("name", "one.*")
        sizes = counts.where(F.col("different") > GROUP)
    salted = F.when(F.col("different").isNull(), -1).otherwise(F.pmod(F.xxhash64("bytes"), F.ceil(F.col("different") / GROUP))).cast("int")
    ready.append(sent.join(sizes, "name", "left").withColumn("salt", salted).drop("different"))
    every = functools.reduce(DataFrame.unionByName, ready)
    compared = written(_compared(every, length), "compared")
    near = compared.where("repeat").select("doc_id", "text_hash", "start", "stop")
    windows = compared.where("window is not null")
    across = windows.groupBy("window").agg(F.count("*").alias("c")).where("c > 1").join(windows.where("not repeat"), "window").select("doc_id", "text_hash", "start", "stop")
    every = whole.unionByName(near).unionByName(across)
    # a set: repeated rows have the same ranges
    out = written(every.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("ranges")), "ranges")
    dropped(*made, compared)
    return out


def removed_ranges(ranges: list[dict], length: int) -> list[tuple[int, int]]:
    """Byte ranges that the windows starting in ``ranges`` cover, merged where they touch."""
    out: list[list[int]] = []
    for start, stop in sorted((r["start"], r["stop"] + length - 1) for r in ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def suffix_dedup(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, keep: bool = False) -> DataFrame:
    """Cuts every string of ``length`` bytes that starts at two places, from both.

    Returns ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for ``docs(doc_id, text)``; with
    ``keep``, all of ``docs``'s columns, the text being the bytes left, where a
    character that was cut in two is dropped. Null texts count as empty and stay null with
    ``keep``; texts shorter than ``length`` are never cut; repeated rows are copies of each
    other; null ids are kept. Strings are judged on the input. Every byte is read; a long text is
    hashed in parts that overlap, so that no string is lost between them.
    """
    others = [f for f in docs.schema.fields if f.name != "text"]
    hashed = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in others]).alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    parts = repeat_ranges(hashed.select("doc_id", "text", "text_hash"), length, anchor)
    parts = parts.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text"), "ranges")
    joined = hashed.join(parts, hashed["doc_id"].eqNullSafe(parts["of_doc"]) & (hashed["text_hash"] == parts["of_text"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            n_bytes, removed, n_spans, digest, texts = [], [], [], [], []
            for text, found in zip(ids(batch, "text").to_pylist(), ids(batch, "ranges").to_pylist(), strict=True):
                raw = (text or "").encode()
                cuts = removed_ranges(found or [], length)
                left = b"".join(raw[a:b] for a, b in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(raw)], strict=True))
                n_bytes.append(len(raw))
                removed.append(len(raw) - len(left))
                n_spans.append(len(cuts))
                if keep:
                    texts.append(None if text is None else left.decode("utf-8", "ignore"))
                else:
                    digest.append(hashlib.sha256(left).hexdigest())
            if keep:
                yield pa.RecordBatch.from_arrays([ids(batch, "row"), pa.array(texts, pa.string())], ["row", "text"])
            else:
                yield pa.RecordBatch.from_arrays([ids(batch), pa.array(n_bytes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    if keep:
        cut = joined.select("row", "text", "ranges").mapInArrow(run, T.StructType([T.StructField("row", T.StructType(others)), T.StructField("text", T.StringType())]))
        return cut.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
    return joined.select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
