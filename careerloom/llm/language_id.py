"""Language identification with interpolated Kneser-Ney character models (operator 7).

One model per language, trained on the executors from a bounded sample of labelled rows:
about ``max_docs`` whole documents of each language, chosen by a hash of the id. The models
are merged into one sorted hash array per order that holds, for every n-gram seen in any
language, its interpolated log probability in each language. So scoring a position is one
binary search; only n-grams that no language has seen go down to shorter ones, by way of
each language's weight of their context. A document gets the language of the lowest cross-entropy per character.
A part of each language's sample is held back from training. The cross-entropies of its texts and of windows of
them, by length, calibrate the rejection: a text that lies ``SPREADS`` spreads above the mean of its language and length is rejected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, ids, slices, strings

ORDER = 4
DISCOUNT = 0.75
#: Characters taken as equally likely where nothing is known of a character.
ALPHABET = 500
#: Text bytes scored at once: each takes about two hundred bytes of memory.
SLICE = 1 << 18
#: Characters of one text that are scored at once.
PIECE = 1 << 19
#: Log probabilities are summed in whole numbers of so many parts of a nat.
UNIT = float(1 << 20)
UNKNOWN = "und"
_lut: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Code point to its lower-case letter, or to a space for what is no letter."""
    if not _lut:
        lut = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                lut[c] = ord(low) if len(low) == 1 else c
        _lut.append(lut)
    return _lut[0]


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' letters with single spaces around words, one after another, and the start of each."""
    raw = "".join(f" {t} " for t in texts)
    points = letters()[np.frombuffer(raw.encode("utf-32-le", "surrogatepass"), np.uint32)]
    length = np.array([len(t) + 2 for t in texts], np.int64)
    start = np.cumsum(length) - length
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    keep[start] = True
    return points[keep], np.concatenate([[0], np.cumsum(keep)])[start]


def gram_keys(points: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram that ends at each position; positions before a full n-gram wrap nothing."""
    out = np.zeros(len(points), np.uint64)
    for k in range(order - 1, -1, -1):
        shifted = np.full(len(points), 32, np.uint64)
        shifted[k:] = points[: len(points) - k]
        out = mixed(out, shifted)
    return out


def mixed(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The hash of an n-gram from that of its beginning and its last character."""
    h = (h ^ (c.astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


#: Characters of the sample that are counted at once.
COUNTED = 200_000


def train(texts: list[str]) -> dict:
    """Counts of one language: per order the distinct n-grams (rows of code points) and their counts."""
    rows, counts, part, size = np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64), [], 0
    for k, t in enumerate(texts):
        part.append(t)
        size += len(t)
        if size >= COUNTED or k == len(texts) - 1:
            more = _counted(part)
            rows, counts = _summed(np.concatenate([rows, more[0]]), np.concatenate([counts, more[1]]))
            part, size = [], 0
    grams = {}
    for order in range(ORDER, 0, -1):
        grams[order] = (rows, counts.astype(np.float64))
        # lower orders count the distinct characters that stand before, as Kneser and Ney do
        rows, counts = np.unique(rows[:, 1:], axis=0, return_counts=True)
    return grams


def _summed(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, at = np.unique(rows, axis=0, return_inverse=True)
    return distinct, np.bincount(at.ravel(), counts, len(distinct)).astype(np.int64)


def _counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the highest order and their counts."""
    points, start = characters(texts)
    inside = np.ones(len(points), bool)
    inside[start] = False  # a document's first space predicts nothing of the document before
    padded = np.concatenate([np.full(ORDER - 1, 32, np.uint32), points])
    windows = np.lib.stride_tricks.sliding_window_view(padded, ORDER)[inside].copy()
    # positions near a document's start would look into the document before: their context is spaces
    age = (np.arange(len(points)) - np.repeat(start, np.diff(np.append(start, len(points)))))[inside]
    for k in range(ORDER - 1):
        windows[age < ORDER - 1 - k, k] = 32
    return np.unique(windows, axis=0, return_counts=True)


def _hash_rows(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(rows.shape[1]):
        h = mixed(h, rows[:, k])
    return h


class Models:
    """All languages' models merged: per order, sorted hashes and log probabilities by language.

    ``usual``: what cross-entropies text of each language has, by length.
    """

    def __init__(self, langs: list[str], grams: list[dict]):
        self.langs = langs
        self.usual: dict[str, list[tuple[float, float, float]]] = {}
        n = len(langs)
        self.keys, self.logp, self.context, self.weight = {}, {}, {}, {}
        self.base = np.full(n, -math.log(ALPHABET))
        for order in range(1, ORDER + 1):
            every = np.unique(np.concatenate([g[order][0] for g in grams]), axis=0) if n else np.zeros((0, order), np.uint32)
            keys = _hash_rows(every)
            by = np.argsort(keys)
            keys, every = keys[by], every[by]
            shorter = np.exp(self._lower(every[:, 1:], order - 1))
            contexts = _hash_rows(every[:, :-1])
            ckeys, of = np.unique(contexts, return_inverse=True)
            logp, weight = np.zeros((len(keys), n)), np.zeros((len(ckeys), n))
            for i, g in enumerate(grams):
                count = np.zeros(len(keys))
                count[np.searchsorted(keys, _hash_rows(g[order][0]))] = g[order][1]
                total = np.bincount(of, count, len(ckeys))
                kinds = np.bincount(of, count > 0, len(ckeys))
                lam = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
                weight[:, i] = np.log(lam)
                logp[:, i] = np.log(np.maximum(count - DISCOUNT, 0) / np.maximum(total, 1)[of] + lam[of] * shorter[:, i])
            self.keys[order], self.logp[order] = keys, logp.astype(np.float32)
            self.context[order], self.weight[order] = ckeys, weight.astype(np.float32)

    def _lower(self, rows: np.ndarray, order: int) -> np.ndarray:
        """Log probabilities of rows of an order that is built."""
        if not order:
            return np.broadcast_to(self.base, (len(rows), len(self.langs)))
        prefix = [_hash_rows(rows[:, order - k : order]) for k in range(1, order + 1)]
        contexts = [_hash_rows(rows[:, order - k : order - 1]) for k in range(1, order + 1)]
        return self._score(prefix, contexts, order)

    def _score(self, keys: list[np.ndarray], contexts: list[np.ndarray], order: int) -> np.ndarray:
        """keys[k - 1], contexts[k - 1]: the hashes at order k of each position."""
        out = np.zeros((len(keys[0]), len(self.langs)), np.float32)
        todo = np.arange(len(keys[0]))
        for k in range(order, 0, -1):
            at, hit = _find(self.keys[k], keys[k - 1][todo])
            out[todo[hit]] += self.logp[k][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                return out
            at, hit = _find(self.context[k], contexts[k - 1][todo])
            out[todo[hit]] += self.weight[k][at[hit]]
        out[todo] += self.base.astype(np.float32)
        return out

    def entropy(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a character by language, and the characters scored, of each text.

        Texts of over ``PIECE`` characters are scored part by part, each part in the context of the one before. Log
        probabilities are summed as whole numbers of ``1 / UNIT``, so parts and slices change no bit.
        """
        total, n = np.zeros((len(texts), len(self.langs)), np.int64), np.zeros(len(texts), np.int64)
        short = [k for k, t in enumerate(texts) if len(t) <= PIECE]
        if short:
            total[short], n[short] = self._sums([texts[k] for k in short])
        for k, t in enumerate(texts):
            if len(t) > PIECE:
                before = np.full(ORDER - 1, 32, np.uint32)
                for a in range(0, len(t), PIECE):
                    points = _collapsed(letters()[_code_points((" " if not a else "") + t[a : a + PIECE] + (" " if a + PIECE >= len(t) else ""))], a > 0 and before[-1] == 32)
                    every = np.concatenate([before, points])
                    keys = [gram_keys(every, o) for o in range(1, ORDER + 1)]
                    contexts = [np.zeros(len(every), np.uint64), *(np.concatenate([[np.uint64(0)], x[:-1]]) for x in keys[:-1])]
                    first = ORDER - 1 + (a == 0)  # the space that begins a text is not scored
                    score = self._score([x[first:] for x in keys], [x[first:] for x in contexts], ORDER)
                    total[k] += _whole(score).sum(axis=0)
                    n[k] += len(score)
                    before = every[-(ORDER - 1) :]
        return -(total / UNIT) / np.maximum(n, 1)[:, None], n

    def _sums(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points, start = characters(texts)
        stop = np.append(start[1:], len(points))
        keys = [gram_keys(points, k) for k in range(1, ORDER + 1)] if len(texts) else []
        contexts = [np.zeros(len(points), np.uint64), *(np.concatenate([[np.uint64(0)], x[:-1]]) for x in keys[:-1])]
        # the first characters of a text have nothing but spaces before them
        for age in range(1, ORDER - 1):
            at = start + age
            at = at[at < stop]
            for k in range(age + 2, ORDER + 1):
                rows = np.full((len(at), k), 32, np.uint32)
                for j in range(age + 1):
                    rows[:, k - 1 - j] = points[at - j]
                keys[k - 1][at], contexts[k - 1][at] = _hash_rows(rows), _hash_rows(rows[:, :-1])
        score = _whole(self._score(keys, contexts, ORDER))
        score[start] = 0
        return np.add.reduceat(score, start, axis=0), stop - start - 1


def _whole(score: np.ndarray) -> np.ndarray:
    return np.rint(score.astype(np.float64) * UNIT).astype(np.int64)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _collapsed(points: np.ndarray, after_space: bool) -> np.ndarray:
    """Points with single spaces; a space at the beginning goes if there is one before."""
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    if after_space and len(points):
        keep[0] = points[0] != 32
    return points[keep]


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


#: One of so many documents of a sample calibrates the rejection; the others train.
HELD_BACK = 5
#: Lengths of the windows whose cross-entropies are measured, and windows of a document and length at most.
LENGTHS, WINDOWS = (8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384), 4


def fit(labelled: DataFrame, max_docs: int = 1000, max_chars: int = 8_000_000, max_langs: int = 200) -> Models:
    """Models from ``labelled(doc_id, text, lang)``; rows without text or language teach nothing.

    The sample of a language has about ``max_docs`` documents and ``max_chars`` characters, picked by a hash of the id, of those
    of up to an eighth of ``max_chars``; the ``max_langs`` most frequent values of ``lang`` are learned, ties by name. These
    parameters are the documented bounds of what one executor and the driver hold. A fifth of a sample is
    held back from training and calibrates the rejection.
    """
    n = F.char_length("text")
    rows = labelled.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (n <= max_chars // 8))
    counted = rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(n).alias("chars")).orderBy(F.desc("docs"), "lang").limit(max_langs).collect()
    if not counted:
        return Models([], [])
    share = F.create_map(*[F.lit(x) for r in sorted(counted) for x in (r["lang"], min(1.0, max_docs / r["docs"], max_chars / max(1, r["chars"])))])
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 20))
    picked = rows.where(place / F.lit(float(1 << 20)) < F.try_element_at(share, F.col("lang"))).withColumn("held", F.pmod(place, F.lit(HELD_BACK)) == 0)

    def one(lang: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grams = train(pdf["text"].tolist())
        return pd.DataFrame([{"lang": lang[0], "n": o, "grams": rows.astype("<u4").tobytes(), "counts": counts.astype("<f8").tobytes()} for o, (rows, counts) in grams.items()])

    got: dict[str, dict] = {}
    for r in picked.where("not held").groupBy("lang").applyInPandas(one, "lang string, n int, grams binary, counts binary").collect():
        got.setdefault(r["lang"], {})[r["n"]] = (np.frombuffer(r["grams"], "<u4").reshape(-1, r["n"]), np.frombuffer(r["counts"], "<f8"))
    langs = sorted(got)
    models = Models(langs, [got[x] for x in langs])
    models.usual = _calibrated(picked.where("held"), models)
    return models


def windows(text: str) -> list[str]:
    """Pieces of a text, of each of ``LENGTHS`` some, evenly spread, and the text itself."""
    out = [text]
    for n in LENGTHS:
        if n < len(text):
            step = max(n, (len(text) - n) // WINDOWS + 1)
            out += [text[a : a + n] for a in range(0, len(text) - n + 1, step)][:WINDOWS]
    return out


def _calibrated(held: DataFrame, models: Models) -> dict[str, list[tuple[float, float, float]]]:
    """Per language, by length: log2 of the characters, and mean and spread of the cross-entropy of text held back from training."""
    shared = held.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: k for k, x in enumerate(shared.value.langs)}
        for batch in slices(batches, limit=SLICE // 8):
            own, texts = [], []
            for lang, text in zip(ids(batch, "lang").to_pylist(), strings(batch), strict=True):
                if lang in at:
                    parts = windows(text)
                    own += [at[lang]] * len(parts)
                    texts += parts
            if texts:
                ce, n = shared.value.entropy(texts)
                keep = n > 1
                lang = np.array(shared.value.langs, object)[np.array(own)[keep]].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(n[keep]), pa.array(ce[np.arange(len(own)), own][keep])], ["lang", "n", "ce"])

    bucket = F.round(F.log2("n")).cast("int").alias("size")
    got = held.select("lang", "text").mapInArrow(run, "lang string, n long, ce double").groupBy("lang", bucket).agg(F.avg(F.log2("n")).alias("at"), F.avg("ce").alias("mean"), F.coalesce(F.stddev_pop("ce"), F.lit(0.0)).alias("spread"), F.count("*").alias("c")).where("c >= 4").collect()
    usual: dict[str, list] = {}
    for r in sorted(got, key=lambda r: (r["lang"], r["at"])):
        usual.setdefault(r["lang"], []).append((r["at"], r["mean"], max(r["spread"], LEAST_SPREAD * r["mean"])))
    return usual


#: Rejection: so many spreads above the mean of its language's own text of that length. Were these normal, one clean text in 10**9 would be.
SPREADS = 6.0
#: What counts as spread at least, as a share of the mean: a sample shows few of the documents that hold keys, names or passages in
#: another language, and these are not foreign as a whole.
LEAST_SPREAD = 0.125
#: Characters that count for the confidence; further ones would only push it to 0 or 1.
WEIGHT = 64.0


def limits(models: Models, lang: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The highest cross-entropy that a text of each language (by number) and length may have; none where a language has no calibration."""
    out = np.full(len(lang), np.inf)
    for k in np.unique(lang).tolist():
        rows = models.usual.get(models.langs[k]) if k < len(models.langs) else None
        if rows:
            at, mean, spread = (np.array(x) for x in zip(*rows, strict=True))
            own = lang == k
            size = np.log2(np.maximum(n[own], 1))
            # texts shorter than any window spread wider, as a mean of fewer characters does
            short = np.sqrt(np.maximum(1.0, 2.0 ** (at[0] - size)))
            out[own] = np.interp(size, at, mean) + SPREADS * np.interp(size, at, spread) * short
    return out


def judged(texts: list[str], models: Models) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language, confidence, cross-entropy and rejection of each text."""
    ce, n = models.entropy(texts) if models.langs and texts else (np.full((len(texts), 1), 99.0), np.zeros(len(texts)))
    none = n < 2 if models.langs else np.ones(len(texts), bool)
    best = ce.argmin(axis=1)
    least = ce[np.arange(len(texts)), best]
    score = 1 / np.exp(-(ce - least[:, None]) * np.minimum(n, WEIGHT)[:, None]).sum(axis=1)
    over = least > limits(models, best, n)
    pred = [UNKNOWN if u else models.langs[b] for u, b in zip(none, best, strict=True)]
    return pred, np.where(none, 0.0, score), np.where(none, np.nan, least), none | over


def language_id(docs: DataFrame, models: Models) -> DataFrame:
    """``doc_id, lang_pred, score, entropy, rejected`` for ``docs(doc_id, text)``.

    A null text and a text without letters are ``und`` with score 0, and rejected; without any
    trained language every text is. ``score`` is the softmax over languages of the evidence of at
    most ``WEIGHT`` characters. Ties go to the first language by name. Repeated rows and null ids
    stay; further columns are not read. Every character of a text is scored in its context, long texts part by part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            pred, score, entropy, rejected = judged(strings(batch), shared.value)
            yield pa.RecordBatch.from_arrays([ids(batch), pa.array(pred, pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)], ["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def keep_known(docs: DataFrame, models: Models) -> DataFrame:
    """The documents that are not rejected, with all columns as they are; all where no language was learned.

    Null texts and texts without letters are rejected. Null ids and repeated rows are judged like others; an empty table stays empty.
    """
    if not models.langs:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(models)
    return filtered(docs, lambda texts: ~judged(texts, shared.value)[3], limit=SLICE)
