"""The linear classifiers against plain loops, sums of probabilities, votes and choice."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from careerloom.operators import linear, ml

WORDS = {"fruit": "apple pear plum sweet ripe", "ship": "sea sail mast port deck", "tool": "saw nail drill bolt wrench"}


def texts(spark, labels, n=90, seed=1):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        label = labels[k % len(labels)]
        words = [rng.choice(WORDS[label].split()) if rng.random() < 0.6 else rng.choice(["red", "blue", "green", "sea", "apple", "nail"]) for _ in range(12)]
        rows.append((k, " ".join(words), label))
    return spark.createDataFrame(rows, "id long, text string, category string")


def test_descent_is_a_plain_loop(spark):
    rng = np.random.default_rng(5)
    n, width, classes, batches = 60, 7, 3, 2
    x = rng.normal(size=(n, width)) * (rng.random((n, width)) < 0.5)
    target, weight, part, batch = rng.integers(0, classes, n), rng.random(n) + 0.5, rng.integers(0, linear.PARTS, n), rng.integers(0, batches, n)
    rows = [([int(j) for j in np.flatnonzero(r)], [float(v) for v in r[r != 0]], float(t), float(w), int(p), int(b)) for r, t, w, p, b in zip(x, target, weight, part, batch, strict=True)]
    df = spark.createDataFrame(rows, "at array<int>, x array<double>, target double, weight double, part int, batch int").repartition(5)
    got, shifts = linear.descend(df, classes, width, epochs=2, batches=batches, rate=2.0, decay=0.5, penalty=0.01)
    for model in range(linear.PARTS * classes):
        w, b, step = np.zeros(width), 0.0, 0
        for _ in range(2):
            for k in range(batches):
                gw, gb, total = np.zeros(width), 0.0, 0.0
                for i in range(n):
                    if batch[i] != k:
                        continue
                    total += weight[i]
                    if part[i] != model // classes:
                        pull = weight[i] * (1 / (1 + math.exp(-(w @ x[i] + b))) - (target[i] == model % classes))
                        gw, gb = gw + pull * x[i], gb + pull
                pace = 2.0 / (1 + 0.5 * step)
                w, b, step = w - pace * (gw / total + 0.01 * w), b - pace * gb / total, step + 1
        assert np.allclose(got[model], w) and abs(shifts[model] - b) < 1e-9


def test_curves_are_the_best_ones(spark):
    rng = random.Random(6)
    rows = [(m, rng.gauss(0, 2) + m, 0.0, rng.choice([0.5, 1.0, 2.0])) for m in range(3) for _ in range(80)] + [(3, float(k), 0.0, 1.0) for k in range(-5, 6)]
    rows = [(m, f, (rng.random() < 1 / (1 + math.exp(-f))) if m < 3 else f > 0, w) for m, f, _, w in rows]
    got = linear.sigmoids(spark.createDataFrame(rows, "model int, margin double, hit boolean, weight double").repartition(3), 5)
    for m in range(4):
        mine = [(f, h, w) for k, f, h, w in rows if k == m]
        hits = sum(h for _, h, _ in mine)
        up, down = (hits + 1) / (hits + 2), 1 / (len(mine) - hits + 2)

        def loss(a, b, mine=mine, up=up, down=down):
            return sum(w * (math.log1p(math.exp(-abs(z := a * f + b))) + max(z, 0) - z * (up if h else down)) for f, h, w in mine)

        a, b = got[m]
        least = loss(a, b)
        assert all(loss(a + da, b + db) >= least - 1e-9 for da in (-1e-3, 0, 1e-3) for db in (-1e-3, 0, 1e-3))
    assert got[4].tolist() == [0.0, 0.0]  # a model without rows


@pytest.mark.parametrize("labels", [["fruit", "ship"], ["fruit", "ship", "tool"]])
def test_members_and_votes(spark, monkeypatch, labels):
    monkeypatch.setattr(linear, "EPOCHS", 2)
    monkeypatch.setattr(linear, "ROUNDS", 8)
    df, other = texts(spark, labels), texts(spark, labels, 60, 2)
    configs = {name: (2, 100, 1.0, 1.0, members) for name, members in {"logistic": ("logistic",), "svm": ("svm",), "sgd": ("sgd",), "vote": ("logistic", "svm")}.items()}
    model = linear.fit(ml.balanced(df, "category"), "text", "category", "id", configs)
    assert model.labels == labels
    extra = other.union(spark.createDataFrame([(99, None, None)], other.schema)).withColumn("features", F.lit("mine"))
    got = model.transform(extra, "text").collect()
    assert len(got) == 61 and got[0].features == "mine"
    for r in got:
        for name in configs:
            assert abs(sum(r.probabilities[name]) - 1) < 1e-9 and min(r.probabilities[name]) >= 0
        assert np.allclose(r.probabilities["vote"], (np.array(r.probabilities["logistic"]) + r.probabilities["svm"]) / 2)
    for name in configs:
        right = sum(labels[int(np.argmax(r.probabilities[name]))] == r.category for r in got if r.category)
        assert right >= 0.9 * 60, name


def test_margins_of_the_machine_are_the_library_s(spark):
    """One pass over the matrix gives what each fitted machine gives by itself, and the logistic member what Spark's model does."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import vector_to_array

    df = texts(spark, ["fruit", "ship", "tool"])
    rows = ml.balanced(df, "category")
    model = linear.fit(rows, "text", "category", "id", {"logistic": (1, 50, 1.0, 1.0, ("logistic",))})
    vectors = model.vector.transform(ml.grams(rows, "text", 1))
    own = LogisticRegression(featuresCol="features", labelCol="target", weightCol="weight", maxIter=linear.ROUNDS, regParam=1 / 90, standardization=False).fit(vectors)
    want = {r.id: r.p for r in own.transform(vectors).select("id", vector_to_array("probability").alias("p")).collect()}
    for r in model.transform(df, "text").collect():
        assert np.allclose(r.probabilities["logistic"], want[r.id], atol=1e-3)
    # the weights of terms: counts times the smooth idf, of length one
    (one,) = ml.grams(df.where("id = 0"), "text", 1).collect()
    vocabulary, n = model.vector.stages[1].vocabulary, 90
    held = [set(r.grams) for r in ml.grams(df, "text", 1).collect()]
    raw = {t: one.grams.count(t) * (math.log((1 + n) / (1 + sum(t in h for h in held))) + 1) for t in vocabulary if t in one.grams}
    size = math.sqrt(sum(v * v for v in raw.values()))
    vector = vectors.where("id = 0").first().features
    assert np.allclose(sorted(v / size for v in raw.values()), sorted(vector.values))


def test_choice(spark, monkeypatch):
    monkeypatch.setattr(linear, "ROUNDS", 8)
    df = texts(spark, ["fruit", "ship"], 60)
    configs = {"logistic-1": linear.CONFIGS["logistic-1"], "logistic-2": linear.CONFIGS["logistic-2"]}
    got = linear.cross_validate(df, "text", "category", "id", 2, configs).collect()
    assert {(r.config, r.fold) for r in got} == {(c, k) for c in configs for k in range(2)} and sum(r.n for r in got) == 120
    assert all(0 <= r.top1 <= r.top3 == 1 and 0 <= r.gap < 0.5 for r in got)
    best, model, means = linear.choose(df, "text", "category", "id", 2, {"logistic-1": linear.CONFIGS["logistic-1"]})
    assert best == "logistic-1" and set(means) == {"logistic-1"} and model.transform(df, "text").count() == 60
