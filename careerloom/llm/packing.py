"""Best-fit packing planned on the length histogram (operator 9).

Documents become token ids and pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths, at most ``capacity`` rows, reaches the driver. There best-fit decreasing runs
over counts: sequences with the same free space are an interval of sequence numbers, and one
step places a whole interval. The plan's rows map ranks within a length to sequence and
offset; their number depends on ``capacity`` alone, not on the documents. Each piece then takes
the slot of its rank within its length. Ranks are counted within buckets of a length, with
the buckets before added on, so a length that many pieces share is not gathered in one task.
"""

from __future__ import annotations

import bisect
import json
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids, slices, written

#: Chunks whose ids a worker keeps.
CACHE = 300_000
#: Pieces of one length that are ranked together.
BUCKET = 10_000
#: Text bytes that a task encodes at once.
SLICE = 8 << 20
_models: dict[str, _Words] = {}


class _Words:
    """Ids of single words of a word-end BPE model, and the distinct chunks a worker has met.

    The model's merges stand in the order of their ids, so a word's ids are those of a rank table whose
    byte strings end in an extra byte for the word's end; that byte never occurs in UTF-8.
    """

    END = b"\xff"

    def __init__(self, path: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = {c: bytes([b]) for b, c in _byte_names().items()}
        ranks = {}
        for token, i in spec["model"]["vocab"].items():
            ends = token.endswith("</w>") and len(token) > 4
            if token not in self.special:
                ranks[b"".join(names[c] for c in (token[:-4] if ends else token)) + self.END * ends] = i
        self.word = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.normal = self.tokenizer.normalizer.normalize_str
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.kept: dict[str, bytes] = {}

    def encode(self, chunk: str) -> list[int]:
        if chunk.isascii() and chunk.isalpha():
            return self.word(chunk.lower().encode() + self.END)
        out: list[int] = []
        for w in self.split(self.normal(chunk)):
            out += self.word(w.encode() + self.END)
        return out

    def lookup(self, chunks: list[str]) -> list[bytes]:
        """Native unsigned 32-bit ids of each chunk."""
        kept, encode = self.kept, self.encode
        out = []
        for c in chunks:
            got = kept.get(c)
            if got is None:
                got = array("I", encode(c)).tobytes()
                if len(kept) >= CACHE:
                    kept.clear()
                kept[c] = got
            out.append(got)
        return out


def _byte_names() -> dict[int, str]:
    """The characters that byte-level vocabularies write for bytes: printable ones stand for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _words(path: str) -> _Words:
    if path not in _models:
        _models[path] = _Words(path)
    return _models[path]


def token_bytes(text: pa.Array, path: str) -> Iterator[bytes]:
    """Little-endian unsigned 32-bit ids of each text, without special tokens added.

    The tokenizer drops white space and never joins across it, so each distinct chunk between
    spaces is encoded once. A text that holds a special token's string is encoded whole.
    """
    model = _words(path)
    whole = np.zeros(len(text), bool)
    for s in model.special:
        whole |= np.asarray(pc.match_substring(text, s))
    if whole.any():
        shown = pa.array(["" if w else t for w, t in zip(whole, text.to_pylist(), strict=True)], pa.string())
    else:
        shown = text
    plain = pc.replace_substring(shown, "\n", " ")
    parts = pc.split_pattern(plain, " ")
    coded = parts.flatten().dictionary_encode()
    got = model.lookup(coded.dictionary.to_pylist())
    size = np.fromiter(map(len, got), np.int64, len(got)) // 4
    flat = np.frombuffer(b"".join(got), np.uint32).astype("<u4")
    first = np.cumsum(size) - size
    index = np.asarray(coded.indices, dtype=np.int64)
    n = size[index]
    ends = np.cumsum(n)
    stream = flat[np.repeat(first[index] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
    bound = np.asarray(parts.offsets, dtype=np.int64)
    bound -= bound[0]
    at = np.concatenate([[0], ends])[bound] * 4
    for k in range(len(text)):
        if whole[k]:
            yield np.array(model.tokenizer.encode(text[k].as_py(), add_special_tokens=False).ids, dtype="<u4").tobytes()
        else:
            yield stream[at[k] : at[k + 1]]


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document: ``doc_id, piece, start, length, ids_crc32`` (and ``ids``)."""
    fields = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            rows = []
            for k, raw in enumerate(token_bytes(pc.fill_null(ids(batch, "text"), ""), tokenizer_path)):
                raw += end
                rows += [(k, i, i * capacity, len(cut) // 4, zlib.crc32(cut), cut) for i, cut in enumerate(raw[a : a + 4 * capacity] for a in range(0, len(raw), 4 * capacity))]
            of, piece, start, length, crc, cut = zip(*rows, strict=True)
            cols = [ids(batch).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(cut, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    return docs.select("doc_id", "text").mapInArrow(run, fields)


def plan_slots(histogram: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Best-fit decreasing over counts.

    Per length, rows ``(first rank, first sequence, pieces a sequence, first offset)`` in order
    of rank. Rank r of a row takes sequence ``first + (r - first rank) // pieces``, at offset
    ``first offset + ((r - first rank) % pieces) * length``.
    """
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free space -> intervals (first sequence, how many)
    spaces: list[int] = []  # the free spaces that have intervals, ascending
    plan: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used = 0

    def put(space: int, first: int, n: int) -> None:
        if space:
            if not free[space]:
                bisect.insort(spaces, space)
            free[space].append((first, n))

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                # the tightest sequences take as many as fit, each filled before the next
                space = spaces[at]
                first, n = free[space].pop()
                if not free[space]:
                    spaces.pop(at)
            else:
                space, n = capacity, -(-left // (capacity // length))
                first, used = used, used + n
            each = space // length
            if (full := min(n, left // each)) > 0:
                plan[length].append((rank, first, each, capacity - space))
                put(space - each * length, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if left and n:
                plan[length].append((rank, first, left, capacity - space))
                put(space - left * length, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            if n:
                put(space, first, n)
    return {k: np.array(v, dtype=np.int64) for k, v in plan.items()}


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Adds ``sequence_id, offset`` to pieces with a ``length``; ``pieces`` is read twice."""
    histogram = {int(r["length"]): r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_slots(histogram, capacity)
    parts = {k: -(-n // BUCKET) for k, n in histogram.items() if n > BUCKET}
    split = F.lit(1)
    if parts:
        split = F.coalesce(F.try_element_at(F.create_map(*[F.lit(int(x)).cast("long") for kv in parts.items() for x in kv]), F.col("length")), F.lit(1).cast("long"))
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), split))
    before = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = before.select("length", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    ranked = dealt.withColumn("place", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("ahead") + F.col("place") - 1).drop("bucket", "ahead", "place")
    names = pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), dtype=np.int64) for c in ("length", "rank"))
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                rows = plan[n]
                row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                step = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + step // row[:, 2], row[:, 3] + step % row[:, 2] * n
            cols = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Packs ``docs(doc_id, text)`` into sequences of at most ``capacity`` tokens.

    Returns ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row per piece.
    A null or empty text is the one token ``end_id``. Repeated rows and null ids are packed
    like any other row; ties in a length are ranked by id. An empty table gives no rows.
    Further columns are not read. Texts are encoded whole.
    """
    return pack_pieces(written(cut_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
