"""Every query with SQL against DuckDB on the smallest tables."""

from __future__ import annotations

import pytest
from conftest import SMALL, rows_equal

from careerloom import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SMALL)
    rows_equal([tuple(r) for r in df.collect()], df.columns, duck.execute(catalogue.oracle_sql()[name]))


def test_queries_without_sql_are_tested_here():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"classifier_choice", "classifier_cv", "fuzzy_sequence_match", "hash_sample_tail", "text_embedding_signal", "top_with_tail"}


def test_sequence_matches_equal_all_pairs(spark):
    import difflib

    from careerloom.operators import link
    from careerloom.plans.link_queries import _names

    left, right = ([r[0] for r in df.collect()] for df in _names(spark, SMALL))
    left += ["ab", "abc", "x", "acb", "the end"]
    right += ["axb", "abd", "x", "ab", "the  end", "dne eht"]

    def best(a):
        got = []
        for b in right:
            m = difflib.SequenceMatcher()
            m.set_seq2(a)
            m.set_seq1(b)
            if m.ratio() >= 0.8:
                got.append((-m.ratio(), b))
        return min(got, default=None)

    want = {a: best(a) for a in set(left)}
    df = link.sequence_best(spark.createDataFrame([(x,) for x in [*left, None]], "l string"), spark.createDataFrame([(x,) for x in [*right, None]], "r string"))
    assert {r.l: (-r.ratio, r.r) for r in df.collect()} == {a: w for a, w in want.items() if w}


def test_edit_matches_equal_all_pairs(spark):
    import random

    from careerloom.operators import link

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
    left, right = [word() for _ in range(60)], [word() for _ in range(60)]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            before, row = row, [i + 1]
            for j, y in enumerate(b):
                row.append(min(row[j] + 1, before[j + 1] + 1, before[j] + (x != y)))
        return row[-1]

    want = {}
    for a in set(left):
        got = [(-(1 - distance(a, b) / max(len(a), len(b))), b) for b in right]
        got = [g for g in got if -g[0] >= 0.8]
        if got:
            want[a] = min(got)
    df = link.fuzzy_best(spark.createDataFrame([(x,) for x in left], "l string"), spark.createDataFrame([(x,) for x in right], "r string"))
    assert {r.l: (-r.ratio, r.r) for r in df.collect()} == want


def test_postings_are_ranked_as_by_all_pairs(spark, monkeypatch):
    import random

    from careerloom.operators import corpus

    rng = random.Random(9)
    listed = [(g, p, f"s{rng.randrange(12)}") for g in "ab" for p in range(40) for _ in range(rng.randint(0, 5))]
    held = [(c, "ab"[c % 2], f"s{k}", rng.choice([1.0, 1.5])) for c in range(30) for k in rng.sample(range(14), rng.randint(1, 6))]
    idf = {("a", f"s{k}"): float(k % 4) / 2 for k in range(10)} | {("b", f"s{k}"): 1.0 for k in range(5)}
    want = {}
    for c in {h[0] for h in held}:
        own = {s: w for d, _, s, w in held if d == c}
        g = "ab"[c % 2]
        score = {p: 0.0 for p in range(40)}
        for h, p, s in listed:
            if h == g and s in own:
                score[p] += own[s] * idf.get((g, s), 1.0)
        want[c] = [(p, round(v, 6)) for p, v in sorted(score.items(), key=lambda x: (-round(x[1], 6), x[0]))[:10]]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = frame(listed, "grp string, posting long, skill string"), frame(held, "cand long, grp string, skill string, weight double"), frame([(*k, v) for k, v in idf.items()], "grp string, skill string, idf double"), frame([(g, p) for g in "ab" for p in range(40)], "grp string, posting long")
    for cells in (1 << 21, 40):
        monkeypatch.setattr(corpus, "SCORED", cells)
        got = {}
        for r in sorted(corpus.rank_postings(*args, 10, 6).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.cand, []).append((r.posting, r.score))
        assert got == want


def test_folds_and_classifier(spark):
    from careerloom.operators import ml

    df = spark.createDataFrame([(k, ("red apple pie " if k % 3 else "blue sea ship ") + f"word{k % 7}", "fruit" if k % 3 else "ship") for k in range(90)], "id long, text string, category string")
    folds = ml.stratified(df, "category", "id", 3).groupBy("category", "fold").count().collect()
    assert {(r.category, r["count"]) for r in folds} == {("fruit", 20), ("ship", 10)} and len(folds) == 6
    got = ml.cross_validate(df, "text", "category", "id", 2).collect()
    assert sum(r.n for r in got) == 90 and all(r.top1 == 1.0 for r in got)
    name, model, means = ml.best_config(df, "text", "category", "id", 2, ("1-grams", "2-grams"))
    assert name == "1-grams" and set(means) == {"1-grams", "2-grams"}
    ranked = ml.ranked_labels(model.transform(ml.balanced(ml.grams(df, "text", 1), "category")), model, "id").where("rank = 1").collect()
    assert {(r.id % 3 > 0, r.label) for r in ranked} == {(True, "fruit"), (False, "ship")}


def test_tail_of_the_top(spark):
    got = catalogue.queries()["top_with_tail"](spark, SMALL).collect()
    top, tail = ({r.o_orderkey for r in got if r.picked == p} for p in ("top", "tail"))
    assert (len(top), len(tail)) == (20, 10) and not top & tail
    assert min(r.o_totalprice for r in got if r.picked == "top") >= max(r.o_totalprice for r in got if r.picked == "tail")


def test_sample_is_the_same_whatever_the_partitions(spark):
    from careerloom.operators.windows import hash_sample

    df = spark.range(1000)
    one = [r.id for r in hash_sample(df.repartition(7), "id", 20).collect()]
    assert one == [r.id for r in hash_sample(df.coalesce(1), "id", 20).collect()] and len(set(one)) == 20


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
