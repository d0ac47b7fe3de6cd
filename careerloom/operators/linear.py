"""Linear text classifiers over shared features: logistic regression, a calibrated support vector machine, calibrated descent on mini-batches, and soft votes of them.

All members of all configurations that share a vectoriser are rows of one matrix of coefficients, so one pass over the features scores them all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, StringIndexer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import tables as S
from .ml import balanced, grams, stratified
from .sums import entries, summed

#: Configurations to choose from: n-grams up to, terms, largest share of documents that a term may be in, strength of fit (C), members that vote.
CONFIGS: dict[str, tuple[int, int, float, float, tuple[str, ...]]] = {
    "logistic-1": (1, 5_000, 1.0, 1.0, ("logistic",)),
    "logistic-2": (2, 10_000, 1.0, 1.0, ("logistic",)),
    "logistic-3": (3, 15_000, 0.8, 0.5, ("logistic",)),
    "svm": (2, 10_000, 1.0, 1.0, ("svm",)),
    "sgd": (2, 10_000, 1.0, 1.0, ("sgd",)),
    "vote": (2, 10_000, 1.0, 1.0, ("logistic", "svm")),
}
#: Parts of the training rows; each calibrates the margins of a model of the others.
PARTS = 3
#: Passes of the descent over all rows, and steps of a machine's or a regression's fit at most.
EPOCHS, ROUNDS = 5, 25
#: Rows of a task at least: a fit is many short jobs over the same rows.
TASK_ROWS = 5_000


def term_counts(rows: DataFrame, by: str | None = None, least_df: int = 2) -> DataFrame:
    """``gram, by, tf, df``: how often a term stands in ``rows(grams)`` and in how many of them, by a column, in one pass; terms of fewer than ``least_df`` rows in all are left out."""
    rows = rows.select((F.lit(0) if by is None else F.col(by)).cast("long").alias("by"), "grams").where("grams is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            words = lists.flatten().dictionary_encode()
            kinds, code = len(words.dictionary), np.asarray(words.indices, dtype=np.int64)
            row = np.repeat(np.arange(batch.num_rows), np.asarray(lists.value_lengths(), dtype=np.int64))
            of, which = np.unique(np.asarray(batch.column(0).fill_null(0)), return_inverse=True)
            if not kinds:
                continue
            each, tf = np.unique(row * kinds + code, return_counts=True)
            cell, at = np.unique(which[each // kinds] * kinds + each % kinds, return_inverse=True)
            tfs, dfs = np.bincount(at, tf).astype(np.int64), np.bincount(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(cell % kinds)), pa.array(of[cell // kinds], pa.int64()), pa.array(tfs), pa.array(dfs)], ["gram", "by", "tf", "df"])

    got = rows.mapInArrow(counted, "gram string, by long, tf long, df long")
    counts = got.groupBy("gram", "by").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).groupBy("gram").agg(F.collect_list(F.struct("by", "tf", "df")).alias("x"), F.sum("df").alias("_all"))
    return counts.where(F.col("_all") >= least_df).select("gram", F.inline("x"))


def chosen_terms(counts: DataFrame, n: int, terms: int, least_df: int = 2, most_df: float = 1.0) -> dict[str, float]:
    """The ``terms`` most frequent terms of ``term_counts`` of ``n`` rows, of equal ones the first, and ln((1 + n) / (1 + df)) + 1 of each."""
    most = most_df * n if most_df < 1 else float(1 << 62)
    each = counts.groupBy("gram").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df")).where((F.col("df") >= least_df) & (F.col("df") <= most))
    got = each.orderBy(F.desc("tf"), "gram").limit(terms).collect()
    if not got:
        raise ValueError("no term is in as many rows as a vocabulary asks for")
    return {r["gram"]: math.log((n + 1) / (r["df"] + 1)) + 1 for r in got}


def weighted_terms(idf: list[float]) -> list[Transformer]:
    """Adds ``features``: ``counts`` times ``idf``, of length one."""
    return [ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="counts", outputCol="tfidf"), Normalizer(inputCol="tfidf", outputCol="features")]


def known_terms(counts: DataFrame, n: int, terms: int, least_df: int = 2, most_df: float = 1.0) -> PipelineModel:
    """Adds ``features``: counts of ``chosen_terms``, weighted by their ``weighted_terms``."""
    idf = chosen_terms(counts, n, terms, least_df, most_df)
    return PipelineModel([CountVectorizerModel.from_vocabulary(list(idf), inputCol="grams", outputCol="counts"), *weighted_terms(list(idf.values()))])


def term_vectors(rows: DataFrame, terms: int, least_df: int = 2, most_df: float = 1.0) -> PipelineModel:
    """``known_terms`` of ``rows(grams)``."""
    return known_terms(term_counts(rows, None, least_df), rows.count(), terms, least_df, most_df)


def indexed(rows: DataFrame, label: str) -> Transformer:
    """Adds ``target``."""
    return StringIndexer(inputCol=label, outputCol="target", stringOrderType="alphabetAsc", handleInvalid="skip").fit(rows)


def vectoriser(rows: DataFrame, label: str, terms: int, least_df: int = 2, most_df: float = 1.0) -> PipelineModel:
    """Adds ``target``, and the ``features`` of ``term_vectors``."""
    return PipelineModel([indexed(rows, label), *term_vectors(rows, terms, least_df, most_df).stages])


def sparse(features: str = "features") -> list[Column]:
    """A vector column as ``at`` and ``x``: arrays of places and values."""
    v = F.unwrap_udt(F.col(features))
    dense = F.transform(v["values"], lambda x, i: i)
    return [F.coalesce(v["indices"], dense).alias("at"), v["values"].alias("x")]


def _margins(at: list | pa.Array, x: list | pa.Array, weights: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``[row, model]`` margins, and places, values and rows of all entries."""
    places, values, row = entries(at, x)
    out = np.tile(intercepts, (len(at), 1))
    for k, w in enumerate(weights):
        out[:, k] += np.bincount(row, values * w[places], len(at))
    return out, places, values, row


def _logistic(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -500, 500)))


def gradients(rows: DataFrame, weights: np.ndarray, intercepts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Summed gradients of the log-loss by weights and intercepts, and the summed row weights.

    ``rows(at, x, target, weight, part)``. Model ``part * classes + class`` tells its class from all others and sees no row of its own part.
    The driver gets one matrix, whatever the table's size.
    """
    models, width = weights.shape
    classes = models // PARTS

    def part(batch: pa.RecordBatch) -> np.ndarray:
        at, x, target, weight, mine = (batch.column(k) for k in range(5))
        m, places, values, row = _margins(at, x, weights, intercepts)
        target, weight, mine = (np.asarray(c, float) for c in (target, weight, mine))
        model = np.arange(models)
        pull = (_logistic(m) - (target[:, None] == model % classes)) * weight[:, None] * (mine[:, None] != model // classes)
        return np.concatenate([*(np.bincount(places, values * pull[row, k], width) for k in range(models)), pull.sum(0), [weight.sum()]])

    got = summed(rows.select("at", "x", "target", "weight", "part"), models * width + models + 1, part)
    return got[: models * width].reshape(models, width), got[models * width : -1], float(got[-1])


def descend(rows: DataFrame, classes: int, width: int, epochs: int | None = None, batches: int = 4, rate: float = 8.0, decay: float = 0.1, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of one-vs-rest log-loss models, ``PARTS`` of each class, by descent on mini-batches.

    A step's rate is ``rate / (1 + decay * step)``; the gradient is a mean over the batch's row weights, and ``penalty`` shrinks weights. ``rows`` has ``batch`` in 0 .. ``batches`` - 1 too.
    """
    weights, intercepts = np.zeros((PARTS * classes, width)), np.zeros(PARTS * classes)
    step = 0
    for _ in range(EPOCHS if epochs is None else epochs):
        for b in range(batches):
            slope, shift, n = gradients(rows.where(F.col("batch") == b), weights, intercepts)
            if n:
                pace = rate / (1 + decay * step)
                weights = weights - pace * (slope / n + penalty * weights)
                intercepts = intercepts - pace * shift / n
            step += 1
    return weights, intercepts


def support_vectors(rows: DataFrame, classes: int, width: int, fit: float) -> tuple[np.ndarray, np.ndarray]:
    """Weights and intercepts of one-vs-rest support vector machines, ``PARTS`` of each class; all are fitted at the same time."""

    def one(model: int) -> tuple[np.ndarray, float]:
        part, k = divmod(model, classes)
        mine = rows.where(F.col("part") != part).select("features", "weight", (F.col("target") == (k if classes > 1 else 1)).cast("double").alias("_is"))
        n, kinds = mine.agg(F.sum("weight"), F.countDistinct("_is")).first()
        if kinds < 2:  # all rows or none are of the class
            return np.zeros(width), 0.0
        got = LinearSVC(featuresCol="features", labelCol="_is", weightCol="weight", maxIter=ROUNDS, regParam=1 / (fit * n), standardization=False).fit(mine)
        return got.coefficients.toArray(), got.intercept

    with ThreadPoolExecutor(4) as pool:
        found = list(pool.map(one, range(PARTS * classes)))
    return np.array([w for w, _ in found]), np.array([b for _, b in found])


def sigmoids(scored: DataFrame, models: int, rounds: int = 30) -> np.ndarray:
    """``[model, 2]``: slope and shift of the logistic curve of each model's held-out margins.

    ``scored(model, margin, hit, weight)``. Targets are (hits + 1) / (hits + 2) and 1 / (others + 2), so a clean split has a finite curve. Newton's steps for all
    models at once are one aggregate each; a step that raises a model's loss is halved.
    """
    scored = scored.where(F.col("margin").isNotNull()).persist()
    try:
        sizes = {r["model"]: (r["hits"], r["others"]) for r in scored.groupBy("model").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("others")).collect()}
        hits, others = (np.array([sizes.get(m, (0, 0))[k] for m in range(models)], float) for k in (0, 1))
        now, before, best = np.stack([np.zeros(models), np.log((hits + 1) / (others + 1))], 1), None, np.full(models, np.inf)
        pick = lambda a: F.element_at(F.array(*[F.lit(float(v)) for v in a]), F.col("model") + 1)
        target = F.when(F.col("hit"), pick((hits + 1) / (hits + 2))).otherwise(pick(1 / (others + 2)))
        for _ in range(rounds):
            z = pick(now[:, 0]) * F.col("margin") + pick(now[:, 1])
            lines = scored.select("model", "margin", "weight", z.alias("z"), target.alias("t"))
            p, w, f = 1 / (1 + F.exp(-F.col("z"))), F.col("weight"), F.col("margin")
            loss = w * (F.greatest("z", F.lit(0.0)) - F.col("z") * F.col("t") + F.log1p(F.exp(-F.abs("z"))))
            pull, bend = w * (p - F.col("t")), w * p * (1 - p)
            sums = {r["model"]: r for r in lines.groupBy("model").agg(F.sum(loss).alias("loss"), F.sum(pull * f).alias("ga"), F.sum(pull).alias("gb"), F.sum(bend * f * f).alias("aa"), F.sum(bend * f).alias("ab"), F.sum(bend).alias("bb")).collect()}
            after, moved = now.copy(), 0.0
            for m, r in sums.items():
                if before is not None and r["loss"] > best[m] + 1e-12:
                    after[m] = (now[m] + before[m]) / 2
                    moved = max(moved, abs(after[m] - now[m]).max())
                    continue
                best[m] = r["loss"]
                step = np.linalg.solve(np.array([[r["aa"] + 1e-9, r["ab"]], [r["ab"], r["bb"] + 1e-9]]), np.array([r["ga"], r["gb"]]))
                if before is not None:
                    before[m] = now[m]
                after[m] = now[m] - step
                moved = max(moved, abs(step).max())
            before = now.copy() if before is None else before
            now = after
            if moved < 1e-7:
                break
        return now
    finally:
        scored.unpersist()


@dataclass
class Member:
    """Rows ``first`` to ``last`` of the matrix; ``curves`` is None for a softmax of the margins."""

    first: int
    last: int
    curves: np.ndarray | None

    def probabilities(self, margins: np.ndarray, classes: int) -> np.ndarray:
        m = margins[:, self.first : self.last]
        if self.curves is None:
            if classes == 2 and m.shape[1] == 1:
                p = _logistic(m)
                return np.concatenate([1 - p, p], 1)
            e = np.exp(m - m.max(1, keepdims=True))
            return e / e.sum(1, keepdims=True)
        p = _logistic(m * self.curves[:, 0] + self.curves[:, 1]).reshape(len(m), PARTS, -1)
        p = np.concatenate([1 - p, p], 2) if classes == 2 else p
        total = p.sum(2, keepdims=True)
        return np.where(total > 0, p / np.where(total > 0, total, 1), 1 / classes).mean(1)


@dataclass
class Fitted:
    """A vectoriser, and the configurations that share it as votes of members."""

    vector: PipelineModel
    longest: int
    weights: np.ndarray
    intercepts: np.ndarray
    votes: dict[str, list[Member]]
    #: Rows that are scored have ``counts`` already.
    counted: bool = False

    @property
    def labels(self) -> list[str]:
        return list(self.vector.stages[0].labels)

    def transform(self, df: DataFrame, text: str | None) -> DataFrame:
        """Adds ``probabilities``: a struct of an array for each configuration, in the order of ``labels``. Null texts have no words."""
        classes, weights, intercepts, votes = len(self.labels), self.weights, self.intercepts, self.votes
        whole = F.struct(*df.columns).alias("_row")
        rows = df.select(whole, "counts") if self.counted else grams(df.select(whole, F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text", self.longest).drop("_text")
        for stage in self.vector.stages[1:]:  # the labels of what is scored need not be known
            rows = stage.transform(rows)

        @F.pandas_udf(", ".join(f"`{name}` array<double>" for name in votes))
        def scored(at: pd.Series, x: pd.Series) -> pd.DataFrame:
            margins = _margins(at.tolist(), x.tolist(), weights, intercepts)[0]
            return pd.DataFrame({name: list(np.mean([m.probabilities(margins, classes) for m in members], 0)) for name, members in votes.items()})

        return rows.select("_row.*", scored(*sparse()).alias("probabilities"))


def dealt(df: DataFrame, label: str, key: str) -> DataFrame:
    """Adds ``part``: texts are dealt out here, before n-grams are made of them."""
    return stratified(df, label, key, PARTS).withColumnRenamed("fold", "part")


def fit(rows: DataFrame, text: str | None, label: str, key: str, configs: dict[str, tuple], idf: list[float] | None = None) -> Fitted:
    """Fits configurations of one vectoriser. Members that several have in common are fitted once. ``rows`` has ``weight``.

    ``idf``: the weights of the places of ``counts``, if ``rows`` has that and ``part`` in place of texts; a term that the rows do not know weighs nothing.
    """
    longest, terms, most_df = {c[:3] for c in configs.values()}.pop()
    if idf is None:
        rows = S.stored(dealt(rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()), label, key), "classifier-parts")
        held, n = grams(rows, text, longest), rows.count()
        known = known_terms(term_counts(held), n, terms, most_df=most_df).stages
        width = len(known[0].vocabulary)
    else:
        held, n, known, width = rows, rows.count(), weighted_terms(idf), len(idf)
    vector = PipelineModel([indexed(rows, label), *known])
    # n-grams are made where the texts lie; only features go to the few tasks of a fit
    made = vector.transform(held).select("features", "target", "weight", "part", *sparse(), F.pmod(F.xxhash64(key, F.lit(7)), F.lit(4)).alias("batch"))
    rows = made.repartition(max(1, -(-n // TASK_ROWS))).persist()
    try:
        n = rows.agg(F.sum("weight")).first()[0]
        labels = len(vector.stages[0].labels)
        # two classes have one margin
        classes = 1 if labels == 2 else labels
        weights, intercepts, members = [], [], {}
        for _, _, _, strength, voters in configs.values():
            for kind in voters:
                if (kind, strength) in members:
                    continue
                first, curves = sum(map(len, weights)), None
                if kind == "logistic":
                    got = LogisticRegression(featuresCol="features", labelCol="target", weightCol="weight", maxIter=ROUNDS, regParam=1 / (strength * n), standardization=False).fit(rows)
                    w, b = got.coefficientMatrix.toArray(), got.interceptVector.toArray()
                else:
                    # of two classes, the second is told from the first
                    told = rows if labels > 2 else rows.withColumn("target", 1 - F.col("target"))
                    w, b = support_vectors(rows, classes, width, strength) if kind == "svm" else descend(told, classes, width)
                    curves = sigmoids(held_out_margins(rows, w, b, classes), len(b))
                weights.append(w)
                intercepts.append(b)
                members[kind, strength] = Member(first, first + len(b), curves)
        return Fitted(vector, longest, np.concatenate(weights), np.concatenate(intercepts), {name: [members[k, c[3]] for k in c[4]] for name, c in configs.items()}, idf is not None)
    finally:
        rows.unpersist()


def held_out_margins(rows: DataFrame, weights: np.ndarray, intercepts: np.ndarray, classes: int) -> DataFrame:
    """``model, margin, hit, weight``: each row's margins by the models that did not see it."""

    @F.pandas_udf("array<double>")
    def scored(at: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(list(_margins(at.tolist(), x.tolist(), weights, intercepts)[0]))

    every = rows.select("target", "weight", "part", F.posexplode(scored("at", "x")).alias("model", "margin"))
    mine = every.where(F.floor(F.col("model") / classes) == F.col("part"))
    hit = F.col("target") == (F.lit(1) if classes == 1 else F.col("model") % classes)
    return mine.select("model", "margin", hit.alias("hit"), "weight")


def by_vectoriser(configs: dict[str, tuple]) -> list[dict[str, tuple]]:
    groups: dict[tuple, dict] = {}
    for name, c in configs.items():
        groups.setdefault(c[:3], {})[name] = c
    return list(groups.values())


def cross_validate(df: DataFrame, text: str, label: str, key: str, folds: int = 5, configs: dict[str, tuple] | None = None) -> DataFrame:
    """``config, fold, n, top1, top3, gap``: accuracy on each fold of models of the others, and how far the best probabilities are from the share of hits.

    ``gap`` is the mean over ten bins of the best probability, by their rows, of the difference between its mean and the share of hits.
    Rows without text or label are left out; ties of probabilities count for the label. Null keys are rows of their own.
    """
    configs = configs or CONFIGS
    known = df.select(*dict.fromkeys([label, text, key])).where(F.col(label).isNotNull() & F.col(text).isNotNull())
    rows = balanced(stratified(known, label, key, folds), label).withColumnRenamed("fold", "_fold")
    for k in range(folds):
        # the parts of a fold's training rows: they are told from the fold's own, so that all are dealt out at once
        rows = dealt(rows.withColumn("_strata", F.struct(F.col(label), F.col("_fold") == k)), "_strata", key).withColumnRenamed("part", f"_part{k}").drop("_strata")
    # words are found once: that takes longer than what follows from them
    rows = S.stored(rows.withColumnRenamed("_fold", "fold").withColumn(text, T.words(F.col(text))), "classifier-rows")
    groups = by_vectoriser(configs)
    sizes = {r["fold"]: r["count"] for r in rows.groupBy("fold").count().collect()}
    # n-grams are made twice, whatever the folds: to count a vocabulary, and to count what of all folds' vocabularies a row has
    counts = {n: S.stored(term_counts(grams(rows, text, n), "fold"), "classifier-terms") for n in {c[0] for g in groups for c in g.values()}}

    def vocabularies(group: dict) -> tuple[DataFrame, list[list[float]]]:
        longest, terms, most_df = next(iter(group.values()))[:3]
        chosen = [chosen_terms(counts[longest].where(F.col("by") != k), sum(sizes.values()) - sizes.get(k, 0), terms, most_df=most_df) for k in range(folds)]
        every = sorted(set().union(*chosen))
        found = CountVectorizerModel.from_vocabulary(every, inputCol="grams", outputCol="counts").transform(grams(rows, text, longest))
        return S.stored(found.drop(text, "grams"), "classifier-counts"), [[c.get(t, 0.0) for t in every] for c in chosen]

    def one(job: tuple[int, dict, DataFrame, list[float]]) -> list[tuple]:
        fold, group, counted, idf = job
        mine = counted.where(F.col("fold") != fold).withColumn("part", F.col(f"_part{fold}"))
        model = fit(mine, None, label, key, group, idf)
        known = F.array_position(F.array(*[F.lit(x) for x in model.labels]), F.col(label)).cast("int")
        scored = model.transform(counted.where(F.col("fold") == fold), None).withColumn("_at", known).select("_at", "probabilities").persist()
        out = []
        for name in group:
            p = F.col("probabilities")[name]
            truth = F.when(F.col("_at") > 0, F.element_at(p, F.when(F.col("_at") > 0, F.col("_at"))))
            # a label that training did not see is never right
            better = F.when(F.col("_at") > 0, F.size(F.filter(p, lambda x: x > F.col("_truth")))).otherwise(99)
            lines = scored.withColumn("_truth", truth).select(better.alias("better"), F.array_max(p).alias("best"))
            bins = lines.groupBy(F.least(F.floor(F.col("best") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.sum((F.col("better") == 0).cast("double")).alias("one"), F.sum((F.col("better") < 3).cast("double")).alias("three"), F.sum("best").alias("told"))
            got = bins.agg(F.sum("n"), F.sum("one") / F.sum("n"), F.sum("three") / F.sum("n"), F.sum(F.abs(F.col("one") - F.col("told"))) / F.sum("n")).first()
            out.append((name, fold, *got))
        scored.unpersist()
        return out

    with ThreadPoolExecutor(3) as pool:
        made = list(pool.map(vocabularies, groups))
        found = [r for rs in pool.map(one, [(k, g, table, idf[k]) for k in range(folds) for g, (table, idf) in zip(groups, made, strict=True)]) for r in rs]
    return df.sparkSession.createDataFrame(found, "config string, fold int, n long, top1 double, top3 double, gap double")


def choose(df: DataFrame, text: str, label: str, key: str, folds: int = 5, configs: dict[str, tuple] | None = None) -> tuple[str, Fitted, dict[str, float]]:
    """The configuration of the best mean accuracy, the first on a tie; its model of all rows; and all means."""
    configs = configs or CONFIGS
    means = {r["config"]: r["m"] for r in cross_validate(df, text, label, key, folds, configs).groupBy("config").agg(F.avg("top1").alias("m")).collect()}
    best = max(configs, key=lambda c: means[c])
    rows = balanced(df.where(F.col(label).isNotNull() & F.col(text).isNotNull()), label)
    return best, fit(rows, text, label, key, {best: configs[best]}), means
