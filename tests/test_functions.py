"""Hand-checked values of normalisers, text functions, windows, links and scores."""

from __future__ import annotations

import math

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from careerloom.functions import norm as N
from careerloom.functions import text as T
from careerloom.operators import corpus as C
from careerloom.operators import link as L
from careerloom.operators import match as M
from careerloom.operators import report as R
from careerloom.operators import score as P
from careerloom.operators import windows as W


def values(spark, items, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}")
    return [r.x for r in df.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_likert_policies(spark):
    items = [None, "x", "1", "4", "7", "9"]
    assert values(spark, items, lambda c: N.scale(c, 1, 7)) == [0, 0, 0, 0.5, 1, 1]
    assert values(spark, items, lambda c: N.scale(c, 1, 7, "midpoint")) == pytest.approx([0.5, 0.5, 0, 0.5, 1, 8 / 6])
    assert values(spark, items, lambda c: N.scale(c, 1, 7, "null")) == [None, None, 0, 0.5, 1, 1]


def test_hours(spark):
    items = [None, "0", "5", "15", "20-30", "30+", "60"]
    assert values(spark, items, N.hours_bin) == [0, 0, 0.1, 0.3, 0.5, 0, 1]
    assert values(spark, items, N.hours_middle) == [0, 0, 5, 15, 25, 0, 60]
    assert values(spark, ["40", "100+", "1-10", "none"], N.hours_within) == [0, 120, 5, None]


def test_substance_and_yes(spark):
    assert values(spark, ["", "a" * 9, "a" * 10, "a" * 100, "a" * 101, None], N.substance) == [0, 0.3, 0.6, 0.6, 1, 0]
    assert [values(spark, ["True"], lambda c, v=v: N.yes_no(c, v))[0] for v in ("global", "communicator", "reflective")] == [1, 1, 0]


def test_text(spark):
    assert values(spark, ["façade über sql niño x git-hub"], T.words) == [["sql", "git", "hub"]]
    assert values(spark, ["Anna-Lee  of THE\tNorth"], T.slug) == ["anna_lee_of_the_north"]
    assert values(spark, ["Ann; Bo & Cy and Di,, "], T.split_list) == [["Ann", "Bo", "Cy", "Di"]]
    grams = values(spark, ["sql git hub"], lambda c: F.transform(T.ngrams(T.words(c)), lambda g: g["gram"]))
    assert grams == [["sql", "sql git", "sql git hub", "git", "git hub", "hub"]]
    assert values(spark, ["", "a" * 1001], lambda c: F.size(T.chunks(c))) == [1, 3]


def test_title_rules_take_the_first_match(spark):
    rules = [(r"\bSoftware\b", "technology"), (r"Engineer(?!$)", "technology"), ("Nurse", "healthcare")]
    assert values(spark, ["Nurse of Software", "Civil Engineer", "Engineering", "Nurse", "Cook"], lambda c: M.first_rule(c, rules)) == ["technology", None, "technology", "healthcare", None]


def test_percentile_is_the_average_rank(spark):
    items = [10.0, 20.0, 20.0, 30.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, v double")
    assert [r.p for r in W.percentile_rank(df, "v", "p").orderBy("i").collect()] == [0.25, 0.625, 0.625, 1.0, None]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.integers(-5, 5)), min_size=1, max_size=30))
def test_percentile_equals_pandas(spark, items):
    df = spark.createDataFrame([(i, None if v is None else float(v)) for i, v in enumerate(items)], "i int, v double")
    got = [r.p for r in W.percentile_rank(df, "v", "p").orderBy("i").collect()]
    want = pd.Series(items, dtype=float).rank(pct=True)
    assert [None if math.isnan(x) else pytest.approx(x) for x in want] == got


def test_percentile_within_groups(spark):
    df = spark.createDataFrame([(i, None if i % 5 == 0 else "ab"[i % 2], float(i % 37)) for i in range(700)], "i int, g string, v double")
    got = [r.p for r in W.percentile_rank(df, "v", "p", ["g"]).orderBy("i").collect()]
    pdf = df.orderBy("i").toPandas()
    assert got == pytest.approx(pdf.groupby(pdf.g.fillna("-"))["v"].rank(pct=True).tolist())


def test_similar_in_blocks(spark, monkeypatch):
    queries = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(9)], "doc long, q array<double>")
    items = spark.createDataFrame([(k, [1.0, float(k)]) for k in range(5)], "occ long, v array<double>")
    want = {(d, o): float(d + o) for d in range(9) for o in range(5)}
    for bound in (2000, 2):
        monkeypatch.setattr(M, "QUERIES", bound)
        assert {(r.doc, r.occ): r.score for r in M.similar(queries, items).collect()} == want


def test_frequency_and_information(spark):
    rows = [("A", ["sql", "git"]), ("B", ["sql"]), ("C", ["sql", "git", "go"]), ("D", None)]
    listed = spark.createDataFrame([("f", p, s) for p, ss in rows for s in ss or []], "grp string, posting string, skill string")
    n = spark.createDataFrame([("f", 4)], "grp string, n long")
    freq = {r.skill: (r.df, r.idf) for r in C.document_frequency(C.skill_sets(listed, "posting", "grp", F.col("skill")), n).collect()}
    assert freq == {"sql": (3, pytest.approx(math.log(4 / 3))), "git": (2, pytest.approx(math.log(2))), "go": (1, pytest.approx(math.log(4)))}
    sets = spark.createDataFrame([("f", p, s) for p in "ABC" for s in "ab"] + [("f", "D", "c")], "grp string, posting string, skill string")
    pairs = C.pair_information(sets, C.document_frequency(sets, n)).collect()
    assert [(r.a, r.b, r.together) for r in pairs] == [("a", "b", 3)] and pairs[0].pmi == pytest.approx(math.log(4 / 3))


def test_upper_median(spark):
    assert values(spark, [[1.0, 2.0, 3.0, 4.0]], W.upper_median, "array<double>") == [3.0]


def test_links_and_merge(spark):
    a = spark.createDataFrame([("i", "c", "S1", 1.0), ("i", "d", "S1", 0.5)], "intern string, champion string, source string, confidence double")
    b = spark.createDataFrame([("i", "c", "S3", 1.0), ("i", "d", "S3", 0.9)], "intern string, champion string, source string, confidence double")
    assert {tuple(r) for r in L.union_links(a, b).collect()} == {("i", "c", "S1", 1.0), ("i", "d", "S3", 0.9)}
    survey = spark.createDataFrame([("e", "a", None), ("e", "b", "3"), ("e", "c", "5"), ("e", "d", "False")], "entity string, field string, value string")
    docs = spark.createDataFrame([("e", "a", "4"), ("e", "b", "5"), ("e", "c", "3"), ("e", "d", "True")], "entity string, field string, value string")
    assert {r.field: r.value for r in L.merge_fields(survey, docs).collect()} == {"a": "4", "b": "5", "c": "5", "d": "True"}


def test_scores(spark):
    assert values(spark, [None], lambda c: F.bround(P.mean_of([F.lit(40.0), F.lit(60.0), c.cast("double"), F.lit(100.0)]), 1)) == [66.7]
    assert values(spark, [None], lambda c: N.ladder(c.cast("double"), F.lit(1), F.lit(1), F.lit(0))) == [40]
    out = values(spark, ["x"], lambda c: F.struct(*[v.alias(k) for k, v in P.global_citizen(lambda name: F.lit("7") if name.startswith("p") else F.lit(None).cast("string")).items()]))[0]
    assert out.d1 == pytest.approx(0.95)


def test_fusion_without_signals(spark):
    empty = spark.createDataFrame([], "doc long, signal int, func string, p double")
    assert M.fuse(empty).count() == 0


def test_chips(spark):
    assert values(spark, ["one two, three, x", "He built 'a robot' well", "First thing was done here today. Second thing."], R.chips) == [["one two", "three"], ["a robot"], ["First thing was done here", "Second thing"]]


def test_streams_give_what_tables_give(spark, tmp_path):
    from careerloom.streaming.windows import sessions, windowed_activity

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "value")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    for name, make in (("windows", lambda d: windowed_activity(d, "1 hour")), ("sessions", lambda d: sessions(d, "30 minutes"))):
        stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        q = make(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode("complete").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        assert spark.table(f"out_{name}").agg(F.count("*"), F.sum("n")).first() == make(events).agg(F.count("*"), F.sum("n")).first()


def test_sources(spark, tmp_path):
    from careerloom.sources import tables as S

    rows = spark.createDataFrame([("1", "Sales", "ENTRY", "us"), ("2", "sales", None, None), ("3", "ops", "intern", "US"), ("4", "sales", "senior", "US"), ("5", "sales", "intern", "DE")], "id string, function string, level string, country_code string")
    assert {r.id for r in S.entry_postings(rows, ["sales"]).collect()} == {"1", "2"}
    S.write_by_function(rows, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("function = 'ops'").count() == 1
    (tmp_path / "ann_lee_raw_data.json").write_text('{"a": 1,\n "b": "x"}')
    assert [(r.entity, r.a) for r in S.read_entities(spark, str(tmp_path / "*.json")).collect()] == [("ann_lee", 1)]
    (tmp_path / "t.csv").write_bytes("Name,Hours\nJosé,10-20\nBo,n/a\n".encode("latin1"))
    assert [tuple(r) for r in S.read_csv(spark, str(tmp_path / "t.csv"), "ISO-8859-1").collect()] == [("José", "10-20"), ("Bo", None)]
    assert S.resolve_column(rows, ["x", "level"]) == "level" and S.resolve_column(rows, [], ["country", "CODE"]) == "country_code"


def test_documents(spark):
    from careerloom.operators import docparse as D

    df = spark.createDataFrame([(1, "Ann\nx\n## Skills\nsql\ngit\n##  Work"), (2, ""), (3, None)], "id int, text string")
    got = {(r.id, r.pos): (r.title, r.body) for r in D.sections(df, "id", "text").collect()}
    assert got[1, 1] == ("Skills", "sql\ngit") and got[1, 2] == ("Work", "") and got[1, 0][0] is None
    assert values(spark, ["a github.com/login b github.com/ann-x", None], lambda c: D.code_user(c)) == ["ann-x", None]
    assert values(spark, ["Data Analyst at Acme", "\nSenior Data Engineer | Acme", "none"], D.job_title) == ["Data Analyst", "Senior Data Engineer", None]
    assert values(spark, ["0f8fad5b-d9cb-469f-a165-70867728950e", "Acme"], D.company) == ["", "Acme"]
    text = 'x {"a": {"score": 1}} {"score": 2, "b": {}}'
    assert D.keyed_json(spark.createDataFrame([(text,), (None,)], "t string"), "t", "score").collect()[0].json == '{"score": 1}'


def test_scorer_retries_and_falls_back(spark):
    from careerloom.operators import scorer

    df = spark.createDataFrame([("a long enough text",), ("",), (None,), ("a long enough text",)], "t string")

    def broken(texts):
        raise RuntimeError("no network")

    assert sorted(r.score for r in scorer.score_texts(df, "t").collect()) == [0.0, 0.0, 0.6, 0.6]
    assert {r.score for r in scorer.score_texts(df, "t", broken, default=0.5, wait=0.0).where("t <> ''").collect()} == {0.5}
    assert {r.score for r in scorer.score_texts(df, "t", lambda texts: [7.0] * len(texts)).where("t <> ''").collect()} == {1.0}


def test_enrichment(spark):
    from careerloom.operators import enrich as E

    got = values(spark, [None], lambda c: F.struct(*[v.alias(k) for k, v in E.from_profile(F.lit(16), F.lit(4), F.lit(4), F.lit(9), F.lit(True)).items()]))[0]
    assert (got.pursue, got.stronger, got.prepared, got.ready, got.more_prepared, got.community, got.diverse) == (7, 9, 8, 4, "True", 7, "True")
    assert values(spark, ["Chef", None], lambda c: E.goal_sentence(c, F.lit(None).cast("string"))) == ["Career goal: Chef.", None]
    assert values(spark, [["a", "b", "c", "d", "e"]], lambda c: F.size(E.kept_inferences(c, F.array(*[F.lit(k) for k in range(4)]))), "array<string>") == [3]
