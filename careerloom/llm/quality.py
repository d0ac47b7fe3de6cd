"""Quality classifier: hashed word n-grams, logistic regression, FTRL-proximal (operator 8).

Tokens are runs of letters and digits, lower-cased, or runs of other signs. Features are the
tokens and pairs of neighbouring tokens, hashed into ``2 ** BITS`` slots; a document's vector
holds each feature's share of the document's features, times ``SCALE``. The model learns from
a bounded sample of labelled documents, on the driver, one document at a time by
follow-the-regularised-leader updates with a rate per coordinate. A score is a sparse dot
product, taken for a slice of documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, ids, slices, strings

BITS = 18
SCALE = 12.0
#: Text bytes hashed at once: each takes about a hundred bytes of memory.
SLICE = 1 << 19
REPEAT = np.uint64(0x5EED)
#: Characters of one text that are read at once.
PIECE = 1 << 20
_base = np.uint64(0x9E3779B97F4A7C15)
_tables: dict[str, np.ndarray] = {}


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: 0 white space, 1 letter or digit, 2 other; and its lower case."""
    if not _tables:
        kind, low = np.full(0x110000, 2, np.uint8), np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isspace():
                kind[c] = 0
            elif x.isalnum():
                kind[c] = 1
                y = x.lower()
                low[c] = ord(y) if len(y) == 1 else c
        _tables.update(kind=kind, low=low)
    return _tables["kind"], _tables["low"]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    if len(_tables.get("up", ())) < n:
        inverse = np.uint64(pow(int(_base), -1, 1 << 64))
        for name, b in (("up", _base), ("down", inverse)):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _tables[name] = np.multiply.accumulate(p)
    return _tables["up"][:n], _tables["down"][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _tokens(raw: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first and last place of each token."""
    kind, low = _classes()
    points = np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kind[points]
    up, down = _powers(len(points) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((low[points].astype(np.uint64) + np.uint64(1)) * up[: len(points)])])
    edge = np.flatnonzero(np.diff(k, prepend=np.uint8(9), append=np.uint8(9)))
    begin, end = edge[:-1], edge[1:]
    held = k[begin] > 0
    begin, end = begin[held], end[held]
    return _mix((sums[end] - sums[begin]) * down[begin]), begin, end


def _slots(token: np.ndarray, of: np.ndarray, known: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features that end behind the ``known`` first tokens, and the text of each."""
    # a token that follows itself is one feature whatever the token: no sample holds all of them
    pair = np.where(token[:-1] == token[1:], REPEAT, _mix(token[:-1] * np.uint64(3) + token[1:]))
    place = np.arange(len(token))
    together = (of[:-1] == of[1:]) & (place[1:] >= known)
    # the same with one sign between, as in "word. word."
    over = np.flatnonzero((token[:-2] == token[2:]) & (token[:-2] != token[1:-1]) & (of[:-2] == of[2:]) & (place[2:] >= known))
    slot = np.concatenate([token[known:], pair[together], np.full(len(over), REPEAT + np.uint64(1))]) & np.uint64((1 << BITS) - 1)
    return slot.astype(np.int64), np.concatenate([of[known:], of[:-1][together], of[over]])


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all features of the texts, and the text of each."""
    token, begin, _ = _tokens("".join(f"{t}\n" for t in texts))
    return _slots(token, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right"))


def part_slots(text: str) -> Iterator[np.ndarray]:
    """The slots of a long text's features, part by part: together those of the whole text.

    A part ends with a token, and the next one knows its last two.
    """
    at, size, before = 0, PIECE, np.zeros(0, np.uint64)
    while at < len(text):
        token, begin, end = _tokens(text[at : at + size])
        last = at + size >= len(text)
        if not last and len(end) and end[-1] == size:
            token, begin = token[:-1], begin  # this one may go on
            if not len(token):
                size *= 2
                continue
            step = int(begin[-1])
        else:
            step = size
        every = np.concatenate([before, token])
        yield _slots(every, np.zeros(len(every), np.int64), len(before))[0]
        at, size, before = at + step, PIECE, every[-2:]


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01, epochs: int = 4) -> np.ndarray:
    """Weights (the last is the bias) from rows of (slots, values, label), taken in turn."""
    size = (1 << BITS) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weight(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, size - 1), np.append(x, 1.0)
            w = weight(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    return weight(np.arange(size))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_chars: int = 64_000_000) -> np.ndarray | None:
    """Weights from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``; None without labels.

    About ``max_docs`` labelled documents, picked by a hash of the id, of those of up to an eighth of ``max_chars``, are the sample: the
    documented bound of what reaches the driver. Labels other than 0 and 1 teach nothing.
    """
    labels = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", F.col("quality").cast("int").alias("quality"))
    total = labels.count()
    if not total:
        return None
    # of conflicting labels of one document the lower counts; of repeated documents one text, the least by hash
    part = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < F.lit(min(1.0, max_docs / total) * (1 << 20))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = docs.select("doc_id", "text").where(F.coalesce(F.char_length("text"), F.lit(0)) <= max_chars // 8).join(F.broadcast(part), "doc_id")
    picked = found.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min_by("text", F.xxhash64("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            texts = strings(batch)
            slot, of = features(texts)
            at, share = [], []
            for i in range(len(texts)):
                s, c = np.unique(slot[of == i], return_counts=True) if len(texts) < 64 else np.unique(slot[np.flatnonzero(of == i)], return_counts=True)
                at.append(s.astype(np.int32))
                share.append(SCALE * c / max(1, c.sum()))
            yield pa.RecordBatch.from_arrays([ids(batch), ids(batch, "quality"), pa.array(at, pa.list_(pa.int32())), pa.array(share, pa.list_(pa.float64()))], ["doc_id", "quality", "at", "share"])

    got = picked.mapInArrow(run, "doc_id long, quality int, at array<int>, share array<double>").toArrow().combine_chunks()
    at, share = (got.column(c).combine_chunks() if isinstance(got.column(c), pa.ChunkedArray) else got.column(c) for c in ("at", "share"))
    bound = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(at)))]).astype(np.int64)
    slots, shares = np.asarray(at.flatten(), dtype=np.int64), np.asarray(share.flatten())
    ids_, labels_ = got.column("doc_id").to_pylist(), got.column("quality").to_pylist()
    order = sorted(range(len(ids_)), key=lambda k: (hash((ids_[k], 8)), ids_[k]))
    rows = [(slots[bound[k] : bound[k + 1]], shares[bound[k] : bound[k + 1]], labels_[k]) for k in order]
    return ftrl(rows)


#: Weights are summed in whole numbers of this size, so parts and slices change no bit of a score.
UNIT = float(1 << 24)


def scores(texts: list[str], weights: np.ndarray | None) -> np.ndarray:
    """The chance of label 1 of each text; 0.5 without a model."""
    if weights is None:
        return np.full(len(texts), 0.5)
    whole = np.rint(weights * UNIT)
    total, n = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    short = [k for k, t in enumerate(texts) if len(t) <= PIECE]
    if short:
        slot, of = features([texts[k] for k in short])
        total[short], n[short] = np.bincount(of, whole[slot], len(short)), np.bincount(of, minlength=len(short))
    for k, t in enumerate(texts):
        if len(t) > PIECE:
            for slot in part_slots(t):
                total[k] += whole[slot].sum()
                n[k] += len(slot)
    return 1 / (1 + np.exp(-np.clip(weights[-1] + SCALE * (total / UNIT) / np.maximum(n, 1), -35, 35)))


def quality(docs: DataFrame, weights: np.ndarray | None, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` for ``docs(doc_id, text)``: the chance of label 1.

    Null and empty texts get the model's bias. Without a trained model every score is 0.5.
    Repeated rows and null ids stay; further columns are not read. Every token of a text counts; long texts are read part by part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            score = scores(strings(batch), shared.value)
            yield pa.RecordBatch.from_arrays([ids(batch), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def keep_quality(docs: DataFrame, weights: np.ndarray | None, threshold: float = 0.7) -> DataFrame:
    """The documents that the classifier does not reject, with all columns as they are; all without a model.

    Null and empty texts are judged by the model's bias, null ids and repeated rows like others; an empty table stays empty.
    """
    if weights is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return filtered(docs, lambda texts: scores(texts, shared.value) >= threshold, limit=SLICE)
