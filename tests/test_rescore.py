"""Re-scoring by what changed against scoring everything, round after round."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from careerloom.operators import rescore as R

FIELDS = ["a", "b", "c"]


def pillars(barred=None):
    """``barred``: a column that must not reach the scorer of the first pillar where it is true."""
    number = lambda c: F.coalesce(c.try_cast("double"), F.lit(0.0))
    one = lambda c: F.when(barred, F.raise_error(F.lit("scored")).cast("double")).otherwise(number(c("a")) + number(c("b"))) if barred is not None else number(c("a")) + number(c("b"))
    return {"p": (["a", "b"], one), "q": (["b", "c"], lambda c: F.when(c("c") == "yes", 10.0).otherwise(number(c("b")) * 2))}


def rows(rng, ids):
    return [(i, *(rng.choice([None, "", "1", "3", "no", "yes", "x"]) for _ in FIELDS)) for i in ids]


def test_rounds_give_what_whole_scores_do(spark):
    rng = random.Random(9)
    schema = "id long, a string, b string, c string"
    survey = rows(rng, range(60))
    before = R.scored(spark.createDataFrame(survey, schema), "id", pillars())
    for _ in range(3):
        docs = rows(rng, rng.sample(range(70), 30))  # some of nobody that is known
        gone, new = set(rng.sample(range(60), 3)), rows(rng, range(100, 104))
        now = spark.createDataFrame([r for r in survey if r[0] not in gone] + new, schema)
        merged = R.with_documents(now, spark.createDataFrame(docs, schema).withColumn("other", F.lit(1)), "id", FIELDS)
        got = R.rescored(merged, before, "id", pillars())
        whole = {r.id: (r.p, r.q, r.digest_p, r.digest_q) for r in R.scored(merged, "id", pillars()).collect()}
        old = {r.id: (r.digest_p, r.digest_q) for r in before.collect()}
        rs = got.collect()
        assert {r.id: (r.p, r.q, r.digest_p, r.digest_q) for r in rs} == whole and len(rs) == len(whole)
        for r in rs:
            assert r.scored_anew == [p for p, k in (("p", 0), ("q", 1)) if r.id not in old or old[r.id][k] != whole[r.id][2 + k]]
        before = got


def test_what_did_not_change_reaches_no_scorer(spark):
    schema = "id long, a string, b string, c string"
    survey = spark.createDataFrame([(1, "1", "1", None), (2, None, "2", "yes"), (3, "", None, "no")], schema)
    before = R.scored(survey, "id", pillars())
    docs = spark.createDataFrame([(2, "5", None, None), (1, "0", "x", ""), (9, "1", "1", "1")], schema)
    merged = R.with_documents(survey, docs, "id", FIELDS)
    assert {r.id: r.changed_fields for r in merged.collect()} == {1: ["c"], 2: ["a"], 3: []}
    got = {r.id: r for r in R.rescored(merged, before, "id", pillars(F.col("id") != 2)).collect()}
    assert got[2].p == 7.0 and got[1].p == 2.0 and [got[k].scored_anew for k in (1, 2, 3)] == [["q"], ["p"], []]
    tagged = {r.id: (r.p_source, r.q_source) for r in R.with_sources(R.rescored(merged, before, "id", pillars()), before, "id", pillars()).collect()}
    assert tagged == {1: ("survey", "survey"), 2: ("survey+docs", "survey"), 3: ("survey", "survey")}
    assert R.rescored(merged.limit(0), before, "id", pillars()).count() == 0
    assert {tuple(r.scored_anew) for r in R.rescored(merged, before.limit(0), "id", pillars()).collect()} == {("p", "q")}
