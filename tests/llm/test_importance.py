"""Importance resampling against plain counts, on odd rows and with longer runs of words."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

from conftest import SMALL, rows_equal

from careerloom.llm import importance as I
from careerloom.llm import queries


def features(text, least, most, buckets):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(least, most + 1) for i in range(len(w) - n + 1)]


def plain(rows, target, percent, least_words, least, most, buckets):
    of, wanted = [features(t, least, most, buckets) for _, t in rows], [features(t, least, most, buckets)[1] for t in target]
    s, t = [0] * buckets, [0] * buckets
    for _, f in of:
        for b in f:
            s[b] += 1
    for f in wanted:
        for b in f:
            t[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, f) in zip(rows, of, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least_words])
    can = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    rank = {id(r): k + 1 for k, r in enumerate(can[: percent * len(can) // 100])}
    return sorted([(*r[:4], rank.get(id(r))) for r in out], key=str)


def test_scores_equal_plain_counts(spark):
    rng = random.Random(12)
    word = lambda: rng.choice(["The", "the", "été", "ÉTÉ", "x1", "don't", "a-b", "naïve", "日本", "🙂"])
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(k, text(rng.randrange(40))) for k in range(80)] + [(None, text(30)), (None, None), (3, ""), (5, text(30))] + [(7, "the x1 " * 15)] * 40 + [(9, "long " * 50_000)]
    target = [text(9), None, "the the x1", ""]
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], "doc_id long, text string, rank string, weight int").repartition(4)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for least, most, buckets in ((1, 1, 10_000), (1, 3, 50), (2, 2, 7)):
        got = I.importance(df, aim, 25, 10, least, most, buckets).collect()
        assert sorted(map(tuple, got), key=str) == plain(rows, target, 25, 10, least, most, buckets)
    assert I.importance(df.limit(0), aim).count() == 0
    assert {r.rank for r in I.importance(df.limit(8), aim.limit(0), least_words=99).collect()} == {None}


def test_query_equals_sql(spark, duck):
    df = queries.queries()["op12_importance"](spark, SMALL)
    rows_equal([tuple(r) for r in df.collect()], df.columns, duck.execute(queries.oracle_sql()["op12_importance"]))
