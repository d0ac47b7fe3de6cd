"""Ranks, percentiles, top-k, histograms and samples with defined ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Ranges of values that are ranked apart.
RANGES = 256


def percentile_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Average rank over the number of values, in (0, 1]; null where the value is null.

    Equal values share the mean of their ranks. Counts per value are made first. Values are cut into ranges at
    approximate quantiles; a window ranks within a range, and the ranges before it are added on,
    so no task gets the whole column. The cuts only steer the work.
    """
    by = by or []
    cuts = df.select(F.percentile_approx(F.col(value).cast("double"), [k / RANGES for k in range(1, RANGES)], 10_000).alias("c")).first()["c"] or []
    span = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]).cast("array<double>"), lambda c: c < F.col("_value").cast("double")))
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_value")).agg(F.count("*").alias("_same")).withColumn("_span", span)
    sums = counts.groupBy(*by, "_span").agg(F.sum("_same").alias("_in"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # a row for each range
    before = F.coalesce(F.sum("_in").over(w.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_span").alias("_of"), before.alias("_before"), F.sum("_in").over(w).alias("_all"))
    on = counts["_span"] == sums["_of"]
    for c in by:
        on = on & counts[c].eqNullSafe(sums[f"_by_{c}"])
    upto = F.sum("_same").over(Window.partitionBy(*by, "_span").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    ranks = counts.join(sums, on).select(*[F.col(c).alias(f"_by_{c}") for c in by], "_value", ((F.col("_before") + upto - (F.col("_same") - 1) / 2) / F.col("_all")).alias(out))
    on = df[value].eqNullSafe(ranks["_value"])
    for c in by:
        on = on & df[c].eqNullSafe(ranks[f"_by_{c}"])
    return df.join(ranks, on, "left").select(*[df[c] for c in df.columns], ranks[out])


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must leave no ties."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= k)


def first_rows(df: DataFrame, order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of the table, numbered. The limit comes before the window, so only ``k`` rows meet."""
    return df.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))


def right_closed_bins(c: Column, edges: list[float]) -> Column:
    """Number of the bin (a, b] that holds a value; null outside, the lowest edge too."""
    out = None
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        hit = (c > a) & (c <= b)
        out = F.when(hit, k) if out is None else out.when(hit, k)
    return out


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash: the same rows whatever the partitioning."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def upper_median(values: Column) -> Column:
    """Element n // 2 of the sorted array, from 0."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def numbered(df: DataFrame, key: str, out: str = "row", tie: str | None = None, parts: int = 64) -> DataFrame:
    """Adds the row's number from 1 in the order of a numeric column, then of ``tie``; together they must be unique.

    Rows are numbered within ranges of the key, cut at approximate quantiles, and the sizes of the ranges before are added on,
    so no task gets the whole table. The cuts only steer the work.
    """
    cuts = df.select(F.percentile_approx(F.col(key), [k / parts for k in range(1, parts)], 10_000).alias("c")).first()["c"] or []
    part = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(key))) if cuts else F.lit(0)
    dealt = df.withColumn("_part", part)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_part").orderBy(key, *([tie] if tie else [])))
    return dealt.withColumn("_at", at).join(before, "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def with_tail(top: DataFrame, rest: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The top rows, and ``n`` of the other rows in the order of a seeded hash: ``top``'s columns and ``picked``."""
    other = rest.join(top.select(key), key, "left_anti")
    return top.withColumn("picked", F.lit("top")).unionByName(hash_sample(other, key, n, seed).withColumn("picked", F.lit("tail")), allowMissingColumns=True)
