"""Resampling towards a target: documents are drawn by how much likelier their words are in the target than in the corpus."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What a word is made of, after A-Z are lower-cased: ASCII digits and letters, and all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_buckets(df: DataFrame, text: str = "text", least: int = 1, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """Adds ``_words``, a text's words, and ``_buckets``: for each run of ``least`` to ``most`` words, repeats too, crc32 modulo ``buckets``, plus 1."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _UPPER.lower())
    worded = df.withColumn("_words", F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)))
    bucket = lambda w: (F.crc32(w.cast("binary")) % buckets + 1).cast("int")
    if most == 1:
        return worded.withColumn("_buckets", F.transform("_words", bucket))

    def runs(n: int) -> Column:
        starts = F.when(F.size("_words") >= n, F.sequence(F.lit(0), F.size("_words") - n)).otherwise(F.array().cast("array<int>"))
        # word by word: a slice would copy the array for each position
        return F.transform(starts, lambda i: bucket(F.concat_ws(" ", *[F.get("_words", i + j) for j in range(n)])))

    return worded.withColumn("_buckets", F.concat(*[runs(n) for n in range(least, most + 1)]))


def totals(df: DataFrame, text: str = "text", least: int = 1, most: int = 1, buckets: int = 10_000) -> list[int]:
    """How many features of all texts lie in each bucket. A task sends at most a row for each bucket."""
    # explode would have the planner filter by the arrays' sizes first, and so make all arrays twice
    every = with_buckets(df.select(text), text, least, most, buckets).select(F.explode_outer("_buckets").alias("b"))
    got = every.groupBy("b").agg(F.count("*").alias("n")).where("b is not null")
    out = [0] * buckets
    for r in got.collect():
        out[r["b"] - 1] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln of (t + 1) / (T + buckets) over (s + 1) / (S + buckets)) for each bucket."""
    n, every, wanted = float(len(corpus)), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (every + n) / ((s + 1.0) * (wanted + n)))) for s, t in zip(corpus, target, strict=True)]


def noise(doc_id: Column, seed: int = 2024) -> Column:
    """floor(1000 times a Gumbel variate) from the seed and the id; a null id counts as no characters."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def importance(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, least: int = 1, most: int = 1, buckets: int = 10_000, seed: int = 2024) -> DataFrame:
    """``doc_id, n_features, weight, score, rank``, a row for each of ``docs``, whatever its other columns.

    ``target`` has ``text``. Weights are sums of the buckets' gains over a text's features. Of the N documents of at least
    ``least_words`` words, the floor(percent * N / 100) of the highest scores are drawn; ``rank`` is their place, null for all others.

    Scoring explodes nothing: a text's buckets are an array, folded over the literal array of the gains. Only
    the counts of buckets are shuffled before, and ids with their numbers after.
    Null and empty texts have no features and weight 0. Ties go to the smaller doc_id, nulls last, then to fewer features;
    repeated rows are each drawn for themselves. An empty target or corpus counts nothing; empty ``docs`` give no rows.
    """
    table = gains(totals(docs, "text", least, most, buckets), totals(target, "text", least, most, buckets))
    # folded to one literal when the plan is optimised
    gain = F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")
    weight = F.aggregate("_buckets", F.lit(0).cast("bigint"), lambda s, b: s + F.element_at(gain, b))
    scored = with_buckets(docs.select("doc_id", "text"), "text", least, most, buckets).select("doc_id", F.size("_buckets").cast("bigint").alias("n_features"), (F.size("_words") >= least_words).alias("_in"), weight.alias("weight"))
    scored = written(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "importance-scores")
    # the row's number parts rows that are equal in all else, so that no run of copies stays in one range
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("_row")]
    ranged = scored.where("_in").withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "importance-ranges")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_range")  # a row for each range
    sizes = sizes.select("_range", (F.sum("_n").over(ahead) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(F.lit(0))).alias("_all"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    drawn = ranged.join(sizes, "_range").withColumn("rank", place)
    rank = F.when(F.col("rank") <= F.floor(F.col("_all") * percent / 100), F.col("rank")).cast("bigint").alias("rank")
    shown = ["doc_id", "n_features", "weight", "score"]
    return drawn.select(*shown, rank).union(scored.where("not _in").select(*shown, F.lit(None).cast("bigint").alias("rank")))
