"""Byte-level BPE encoding and decoding with DuckDB recursive queries (operator 2).

Each task holds an in-memory DuckDB with the merge table. The distinct words of a slice of
rows become token-position rows; a recursive query joins neighbouring tokens with the merges
and contracts the leftmost pair of least rank of each word, until no word has a pair left.
Ordered aggregation turns the rows into ids, and the ids' bytes back into text.
Each word is one match of the split pattern, so words are encoded apart from each other; a
document's ids are its words' ids in order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import ids, slices

#: Encoded chunks from which a worker starts a new generation; it keeps the one before.
CACHE = 150_000
#: Words put through one recursive query.
WORDS = 60_000
#: Text bytes that a task encodes at once.
SLICE = 8 << 20
#: Bytes from which a word is merged with a heap: each round of the query contracts one pair
#: of a word, so its work grows with the square of a word's length, and its packed places have ten bits.
LONG = 1000

_ENCODE = """
create or replace temp table encoded as
with recursive state(w, p, t, done) as (
  select w, p, t, false from seed
  union all (
    with side as materialized (select w, p, t, lead(t) over v as nt, lead(p) over v as np from state where not done window v as (partition by w order by p)),
    best as (select w, min((m::bigint << 20) | (p << 10) | np) as k from side join merges on merges.l = side.t and merges.r = side.nt group by w)
    select side.w, side.p, case when ((k >> 10) & 1023) = side.p then (k >> 20)::int else side.t end, k is null
    from side left join best using (w)
    where k is null or side.p <> (k & 1023)))
select w, p, t from state where done
"""
_DECODE = "select string_agg(hex, '' order by w, p) as hex from encoded join vocabulary on vocabulary.id = encoded.t"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _merge_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one long word: the same leftmost least-rank merges, from a heap."""
    n = len(word)
    end = list(range(1, n + 1))  # end[i]: where the part that starts at i ends; 0 once merged away
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != stop:
            continue
        end[i], end[mid] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (b := before[i]) >= 0 and (r := ranks.get(word[b:stop])) is not None:
            heapq.heappush(heap, (r, b, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class Codec:
    """Encoder and decoder of one rank file; holds its DuckDB and the words it has met."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        if any(re.search(rb"\s ", token.strip(b" ")) for token in self.ranks):
            raise ValueError("a token of these ranks goes on over a blank behind white space, where texts are cut into chunks")
        if any(len(m) > 1 and re.search(r"\S ", m) for m in regex.findall(pattern, "a b, c. d\n e 1 2 \"f\" g")):
            raise ValueError("a match of this pattern goes on over a blank, where texts are cut into chunks")
        self.bytes = {i: b for b, i in self.ranks.items()}
        self.split = regex.compile(pattern).findall
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        rows = []
        for token, rank in self.ranks.items():
            if len(token) > 1:
                # the merge that makes a token: its bytes merged by the lower ranks
                left, right = self._parts(token, rank)
                rows.append((left, right, rank))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "200MB"})
        l, r, m = (pa.array(x, pa.int32()) for x in zip(*rows, strict=True))
        self._load("merges", pa.table({"l": l, "r": r, "m": m}))
        self._load("vocabulary", pa.table({"id": pa.array(list(self.bytes), pa.int32()), "hex": [b.hex() for b in self.bytes.values()]}))
        self.text = np.array([str(i) for i in range(max(self.bytes) + 1)], dtype=object)
        self.length = np.zeros(max(self.bytes) + 1, np.int64)
        self.length[list(self.bytes)] = [len(b) for b in self.bytes.values()]
        self.recent: dict[str, tuple[int, str, bytes]] = {}
        self.older: dict[str, tuple[int, str, bytes]] = {}

    def _load(self, name: str, rows: pa.Table) -> None:
        self.db.register("incoming", rows)
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def _parts(self, token: bytes, rank: int) -> tuple[int, int]:
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            r, i = min((r, i) for i in range(len(parts) - 1) if (r := self.ranks.get(parts[i] + parts[i + 1], rank)) < rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, bytes]:
        """Tokens of each word, all tokens in order, and all decoded bytes."""
        raw = [w.encode() for w in words]
        length = np.array([len(b) for b in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        first = np.repeat(np.cumsum(length) - length, length)
        seed = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), length), "p": (np.arange(len(flat)) - first).astype(np.int32), "t": self.byte_id[flat]})
        self.db.register("seed", seed)
        self.db.execute(_ENCODE)
        self.db.unregister("seed")
        got = self.db.sql("select w, t from encoded order by w, p").to_arrow_table()
        decoded = bytes.fromhex(self.db.sql(_DECODE).to_arrow_table().column("hex")[0].as_py())
        return np.bincount(np.asarray(got.column("w")), minlength=len(words)), np.asarray(got.column("t")), decoded

    def _words(self, chunk: str) -> list[str]:
        """The pattern's matches; what is a space and ASCII letters, and perhaps a stop, needs no search."""
        if chunk.isascii():
            bare = chunk[1:] if chunk[0] == " " else chunk
            if bare.isalpha():
                return [chunk]
            if bare[-1:] in (",", ".") and bare[:-1].isalpha():
                return [chunk[:-1], bare[-1]]
        return self.split(chunk)

    def _encode_new(self, chunks: list[str]) -> Iterator[tuple[int, str, bytes]]:
        split = [self._words(c) for c in chunks]
        flat = pa.array([w for s in split for w in s], pa.string()).dictionary_encode()
        words, index = flat.dictionary.to_pylist(), np.asarray(flat.indices, dtype=np.int64)
        count = np.zeros(len(words), np.int64)
        parts_t, parts_b = [np.zeros(0, np.int64)] * len(words), [b""] * len(words)
        size = np.array([len(w.encode()) for w in words])
        for k in np.flatnonzero(size >= LONG).tolist():
            got = _merge_heap(words[k].encode(), self.ranks)
            count[k], parts_t[k], parts_b[k] = len(got), np.array(got), b"".join(map(self.bytes.__getitem__, got))
        short = np.flatnonzero(size < LONG)
        for a in range(0, len(short), WORDS):
            at = short[a : a + WORDS]
            n, tokens, decoded = self._encode_words([words[k] for k in at.tolist()])
            count[at] = n
            ends = np.cumsum(n)
            shift = np.concatenate([[0], np.cumsum(self.length[tokens])])
            texts = self.text[tokens].tolist()
            for k, i, j in zip(at.tolist(), (ends - n).tolist(), ends.tolist(), strict=True):
                parts_t[k], parts_b[k] = " ".join(texts[i:j]), decoded[shift[i] : shift[j]]
        for k in np.flatnonzero(size >= LONG).tolist():
            parts_t[k] = " ".join(self.text[parts_t[k]].tolist())
        at, index = 0, index.tolist()
        count = count.tolist()
        for s in split:
            if len(s) == 1:
                k = index[at]
                yield count[k], parts_t[k], parts_b[k]
            else:
                own = index[at : at + len(s)]
                yield sum([count[k] for k in own]), " ".join([parts_t[k] for k in own]), b"".join([parts_b[k] for k in own])
            at += len(s)

    def encode_chunks(self, chunks: list[str]) -> list[tuple[int, str, bytes]]:
        """Of each chunk: token count, ids as text, decoded bytes."""
        recent, older = self.recent, self.older
        out = [recent.get(c) or older.get(c) for c in chunks]
        new = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(new, self._encode_new([chunks[k] for k in new]), strict=True):
            out[k] = x
        recent.update(zip(chunks, out, strict=True))
        if len(recent) > CACHE:
            self.recent, self.older = {}, recent
        return out


def chunked(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' chunks in order, and where each text's begin (and the last end).

    The split pattern always has a border before a single space, so a text without doubled
    spaces falls apart before each space. Other texts stay whole.
    """
    odd = np.asarray(pc.match_substring(text, "  "))
    at_plain = np.flatnonzero(~odd)
    parts = pc.split_pattern(text.take(pa.array(at_plain)), " ")
    flat = parts.flatten()
    bound = np.asarray(parts.offsets, dtype=np.int64)
    bound = bound - bound[0]
    opens = np.zeros(len(flat), bool)
    opens[bound[:-1]] = True
    space = pa.array(["", " "], pa.string()).take(pa.array((~opens).astype(np.int8)))
    chunks = pc.binary_join_element_wise(space, flat, "")
    count = np.zeros(len(text), np.int64)
    count[at_plain] = np.diff(bound)
    empty = np.asarray(pc.equal(chunks, ""))
    if empty.any():
        # a text that begins with a space, or is empty, has no first chunk
        np.subtract.at(count, at_plain[np.searchsorted(bound, np.flatnonzero(empty), "right") - 1], 1)
        chunks = chunks.filter(pa.array(~empty))
    if odd.any():
        count[odd] = 1
        starts = np.cumsum(count) - count
        merged = np.empty(int(count.sum()), object)
        held = np.ones(len(merged), bool)
        held[starts[odd]] = False
        merged[held] = chunks.to_pylist()
        merged[~held] = text.filter(pa.array(odd)).to_pylist()
        chunks = pa.array(merged, pa.string())
    return chunks, np.concatenate([[0], np.cumsum(count)])


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def byte_bpe(docs: DataFrame, ranks_path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """Encodes and decodes ``docs(doc_id, text)``: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    With ``keep_ids``, also ``ids array<int>`` and ``decoded binary``. Null and empty texts
    have no tokens and the digests of nothing. Repeated rows and null ids stay as they come;
    further columns are not read. Texts are read whole.
    """
    fields = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks_path, pattern)
        for batch in slices(batches, limit=SLICE):
            chunks, bound = chunked(pc.fill_null(ids(batch, "text"), ""))
            coded = chunks.dictionary_encode()
            got = codec.encode_chunks(coded.dictionary.to_pylist())
            index = np.asarray(coded.indices, dtype=np.int64)
            count = np.array([g[0] for g in got], np.int64)[index] if got else index
            id_text, raw = np.empty(len(got), object), np.empty(len(got), object)
            id_text[:], raw[:] = [g[1] for g in got], [g[2] for g in got]
            total = np.concatenate([[0], np.cumsum(count)])[bound]
            bound = bound.tolist()
            n, texts, raws = np.diff(total), [], []
            for a, b in zip(bound, bound[1:], strict=False):
                texts.append(" ".join(id_text[index[a:b]].tolist()))
                raws.append(b"".join(raw[index[a:b]].tolist()))
            cols = [ids(batch), pa.array(n, pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array([hashlib.sha256(r).hexdigest() for r in raws], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols += [pa.array([[int(x) for x in t.split()] for t in texts], pa.list_(pa.int32())), pa.array(raws, pa.binary())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select("doc_id", "text").mapInArrow(run, fields)
