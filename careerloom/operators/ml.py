"""Text classification with Spark ML: tf-idf of word n-grams, weighted logistic regression, stratified folds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship
from ..sources import tables as S


def grams(df: DataFrame, text: str, longest: int = 2) -> DataFrame:
    """Adds ``grams``: words and word pairs, stop words left out. ``text``: texts, or arrays of their words."""
    ship(df.sparkSession)

    @F.arrow_udf("array<string>")
    def made(words: pa.Array) -> pa.Array:
        flat, size = words.flatten(), np.asarray(pc.fill_null(pc.list_value_length(words), 0), dtype=np.int64)
        row, n = np.repeat(np.arange(len(size)), size), len(flat)
        at = np.arange(n)
        # the word some places on, null where the text has ended: a join leaves nulls out
        ahead = [flat]
        for k in range(1, longest):
            on = np.minimum(at + k, max(n - 1, 0))
            ahead.append(flat.take(pa.array(on, mask=(at + k >= n) | (row[on] != row))))
        every = [pc.binary_join_element_wise(*ahead[:k], " ", null_handling="skip") for k in range(1, longest + 1)]
        grams_ = pa.chunked_array(every).combine_chunks().take(pa.array(np.arange(n * longest).reshape(longest, n).T.ravel()))
        offsets = np.concatenate([[0], np.cumsum(size * longest)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), grams_, mask=words.is_null())

    words = df.withColumn("_words", F.col(text) if df.schema[text].dataType.typeName() == "array" else T.words(F.col(text)))
    return words.select(*df.columns, made("_words").alias("grams"))


def stratified(df: DataFrame, label: str, key: str, folds: int = 5) -> DataFrame:
    """Adds ``fold``: rows of a label are dealt in the order of a hash, so each fold has its share of each label.

    A label's rows are ranked within 64 parts of the hash, and the parts before are added on, so no task gets a whole label.
    """
    h = F.xxhash64(key, F.lit(42))
    dealt = df.withColumn("_h", h).withColumn("_part", F.shiftright("_h", 58))
    sizes = dealt.groupBy(label, "_part").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy(label).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(F.col(label).alias("_label"), F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy(label, "_part").orderBy("_h", key))
    rows = dealt.withColumn("_place", place).join(F.broadcast(before), F.col(label).eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_of")))
    return rows.withColumn("fold", F.pmod(F.col("_before") + F.col("_place"), F.lit(folds)).cast("int")).drop("_h", "_part", "_label", "_of", "_before", "_place")


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight``: n / (labels * rows of the label)."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    total = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_labels"))
    # a row for each label, as many as a model has classes: broadcast, as a join by label would deal all rows of a label to one task
    return df.join(F.broadcast(sizes), label).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_all") / (F.col("_labels") * F.col("_n"))).drop("_n", "_all", "_labels")


#: Configurations to choose from: n-grams up to, terms, largest share of documents that a term may be in, strength of the penalty.
CONFIGS = {"1-grams": (1, 5_000, 1.0, 0.01), "2-grams": (2, 10_000, 1.0, 0.01), "3-grams": (3, 15_000, 0.8, 0.02)}


def pipeline(label: str, terms: int = 10_000, least_df: int = 2, most_df: float = 1.0, penalty: float = 0.01) -> Pipeline:
    return Pipeline(
        stages=[
            StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc", handleInvalid="skip"),
            CountVectorizer(inputCol="grams", outputCol="counts", vocabSize=terms, minDF=least_df, maxDF=most_df if most_df < 1 else float(1 << 62)),
            IDF(inputCol="counts", outputCol="tfidf"),
            Normalizer(inputCol="tfidf", outputCol="features"),
            LogisticRegression(featuresCol="features", labelCol="target", weightCol="weight", maxIter=20, regParam=penalty),
        ]
    )


def cross_validate(df: DataFrame, text: str, label: str, key: str, folds: int = 5, config: str = "2-grams") -> DataFrame:
    """``fold, n, top1, top3``: accuracy on each fold of a model of the others. Folds are fitted at the same time."""
    longest, terms, most_df, penalty = CONFIGS[config]
    # every fold reads the rows again, at the same time: a table, as threads that plan over one cache that is being filled can break each other's closures
    # n-grams come last, so that only the rows themselves are dealt out
    known = df.select(label, key, text).where(F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = S.stored(grams(balanced(stratified(known, label, key, folds), label), text, longest).drop(text), "classifier-rows")

    def one(k: int) -> tuple:
        model = pipeline(label, terms, most_df=most_df, penalty=penalty).fit(rows.where(F.col("fold") != k))
        p = vector_to_array("probability")
        better = F.size(F.filter(p, lambda x: x > F.element_at(p, (F.col("target") + 1).cast("int"))))
        got = model.transform(rows.where(F.col("fold") == k)).agg(F.count("*").alias("n"), F.avg((better == 0).cast("double")).alias("top1"), F.avg((better < 3).cast("double")).alias("top3")).first()
        return k, got["n"], got["top1"], got["top3"]

    with ThreadPoolExecutor(folds) as pool:
        found = list(pool.map(one, range(folds)))
    return df.sparkSession.createDataFrame(found, "fold int, n long, top1 double, top3 double")


def best_config(df: DataFrame, text: str, label: str, key: str, folds: int = 5, configs=tuple(CONFIGS)) -> tuple[str, PipelineModel, dict[str, float]]:
    """The configuration of the best mean accuracy, the first on a tie; its model of all rows; and all means."""
    means = {c: cross_validate(df, text, label, key, folds, c).agg(F.avg("top1")).first()[0] for c in configs}
    best = max(configs, key=lambda c: means[c])
    longest, terms, most_df, penalty = CONFIGS[best]
    rows = balanced(grams(df.where(F.col(label).isNotNull() & F.col(text).isNotNull()), text, longest), label)
    return best, pipeline(label, terms, most_df=most_df, penalty=penalty).fit(rows), means


def ranked_labels(scored: DataFrame, model: PipelineModel, key: str, k: int = 10) -> DataFrame:
    """``key, rank, label, p``: the ``k`` likeliest labels of each scored row, ties by label."""
    labels = F.array(*[F.lit(x) for x in model.stages[0].labels])
    pairs = F.zip_with(vector_to_array("probability"), labels, lambda p, x: F.struct((-p).alias("q"), x.alias("label")))
    return scored.select(key, F.posexplode(F.slice(F.array_sort(pairs), 1, k)).alias("at", "x")).select(key, (F.col("at") + 1).alias("rank"), "x.label", (-F.col("x.q")).alias("p"))


def accuracy(df: DataFrame, truth: str, ranked: str) -> DataFrame:
    """Top-1 and top-3 accuracy by class, from arrays of labels, best first."""
    one = (F.try_element_at(F.col(ranked), F.lit(1)) == F.col(truth)).cast("double")
    three = F.array_contains(F.slice(ranked, 1, 3), F.col(truth)).cast("double")
    return df.groupBy(truth).agg(F.count("*").alias("n"), F.avg(F.coalesce(one, F.lit(0.0))).alias("top1"), F.avg(F.coalesce(three, F.lit(0.0))).alias("top3"))
