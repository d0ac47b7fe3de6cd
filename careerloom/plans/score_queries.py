"""Survey normalisers, pillar scores, cohorts, percentiles, report rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import norm as N
from ..functions import text as T
from ..operators import report as R
from ..operators import rescore as E
from ..operators import score as P
from ..operators import windows as W
from ..sources import tables as S
from . import norm_sql as Q
from .registry import query
from .survey import looked_up, survey_sql


def _survey(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    return S.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("student"), *[F.expr(looked_up(n)).alias(f"f_{n}") for n in names])


def _c(name: str):
    return F.col(f"f_{name}")


def _with(names: list[str]) -> str:
    return f"with s as ({survey_sql(names)})"


def _likert_query(name: str, missing: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _survey(spark, sf_dir, ["pre1", "stronger", "rating"]).select("student", N.scale(_c("pre1"), 1, 7, missing).alias("seven"), N.scale(_c("stronger"), 0, 10, missing).alias("ten"), N.scale(_c("rating"), 1, 10, missing).alias("rating"))

    run.__name__ = name
    sql = f"{_with(['pre1', 'stronger', 'rating'])} select student, {Q.scale('f_pre1', 1, 7, missing)} as seven, {Q.scale('f_stronger', 0, 10, missing)} as ten, {Q.scale('f_rating', 1, 10, missing)} as rating from s"
    return query(sql)(run)


likert_norm_agent = _likert_query("likert_norm_agent", "zero")
likert_norm_midpoint = _likert_query("likert_norm_midpoint", "midpoint")
likert_norm_nullable = _likert_query("likert_norm_nullable", "null")


@query("select c_custkey, case when hi > lo then (c_acctbal - lo) / (hi - lo) when c_acctbal is not null then 0.5 end as x from customer, (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)")
def minmax_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = S.read(spark, sf_dir, "customer")
    ends = people.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi"))
    return people.crossJoin(F.broadcast(ends)).select("c_custkey", N.min_max(F.col("c_acctbal"), F.col("lo"), F.col("hi")).alias("x"))


@query(f"{_with(['diverse'])} select student, {Q.yes_no('f_diverse')} as global_, {Q.yes_no('f_diverse', 'communicator')} as communicator, {Q.yes_no('f_diverse', 'reflective')} as reflective from s")
def binary_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survey(spark, sf_dir, ["diverse"]).select("student", N.yes_no(_c("diverse")).alias("global_"), N.yes_no(_c("diverse"), "communicator").alias("communicator"), N.yes_no(_c("diverse"), "reflective").alias("reflective"))


@query(f"{_with(['hours'])} select student, {Q.hours_bin('f_hours')} as bin, {Q.hours_bin('f_hours', 'null')} as bin_null, {Q.hours_low('f_hours')} as low, {Q.hours_middle('f_hours')} as middle, {Q.hours_within('f_hours')} as within from s")
def hours_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _c("hours")
    return _survey(spark, sf_dir, ["hours"]).select("student", N.hours_bin(h).alias("bin"), N.hours_bin(h, "null").alias("bin_null"), N.hours_low(h).alias("low"), N.hours_middle(h).alias("middle"), N.hours_within(h).alias("within"))


@query(
    f"{_with(['culture', 'english', 'languages', 'hope1', 'notes'])} select student, {Q.culture_feel('f_culture')} as culture, {Q.english('f_english')} as english, {Q.english('f_english', True)} as english_within, "
    f"cast({Q.list_size('f_languages')} >= 2 as double) as multilingual, {Q.hopes('f_hope1')} as hopes, {Q.tags('f_hope1')} as tags, {Q.coverage('f_notes')} as coverage, {Q.resume_steps('f_notes')} as steps from s"
)
def answer_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _survey(spark, sf_dir, ["culture", "english", "languages", "hope1", "notes"])
    return s.select(
        "student", N.culture_feel(_c("culture")).alias("culture"), N.english(_c("english")).alias("english"), N.english(_c("english"), True).alias("english_within"), N.multilingual(_c("languages")).alias("multilingual"),
        N.hopes(_c("hope1")).alias("hopes"), N.tags(_c("hope1")).alias("tags"), N.competence_coverage(_c("notes")).alias("coverage"), N.resume_steps(_c("notes")).alias("steps"),
    )


def _q(n):
    return f"f_{n}"


def _gc_sql(variant: str) -> dict[str, str]:
    if variant == "agent":
        n, b = (lambda x: Q.scale(_q(x), 1, 7)), (lambda x: Q.yes_no(_q(x)))
        post = [(0.15, "post1"), (0.15, "post2"), (0.15, "post3"), (0.20, "post4")]
        culture, last = Q.culture_feel("f_culture"), f"least(coalesce({Q.number('f_network')}, 0.0) / 10, 1.0::double)"
        hours = Q.hours_bin("f_hours")
    else:
        n, b = (lambda x: Q.scale(_q(x), 1, 7, "midpoint")), (lambda x: Q.yes_no(_q(x), "communicator"))
        post = [(0.175, f"post{k}") for k in (1, 2, 3, 4)]
        culture, last = Q.substance("f_culture"), f"(least(greatest(coalesce({Q.number('f_network')}, 0.0), 0.0), 5.0)::double / 5)"
        hours = f"(least({Q.hours_middle('f_hours')}, 60.0)::double / 60)"
    return {
        "d1": Q.total([(0.05, n(f"pre{k}")) for k in range(1, 7)] + [(w, n(x)) for w, x in post]),
        "d2": Q.total([(0.15, n("community_pre")), (0.40, n("community")), (0.45, culture)]),
        "d3": Q.total([(0.30, n("values")), (0.30, b("diverse")), (0.40, b("introduced"))]),
        "d4": Q.total([(0.15, b(x)) for x in ("belong", "network_value", "engaged", "friends")] + [(0.40, last)]),
        "d5": Q.total([(0.35, b("volunteered")), (0.65, hours)]),
    }


_GC = [*(f"pre{k}" for k in range(1, 7)), *(f"post{k}" for k in range(1, 5)), "community_pre", "community", "culture", "values", "diverse", "introduced", "belong", "network_value", "engaged", "friends", "network", "volunteered", "hours"]
_RFF = ["adjectives", "skills", "hope1", "hope2", "goal", "goal_set", "goal_next", "pursue", "more_prepared", "ideal", "ready", "ready_fy", "stronger", "prepared", "connects", "speaker1", "speaker2", "speaker3", "topic1", "topic2"]
_CR = ["volunteered", "internship", "job", "hours", "attended", "scheduled", "champions", "notes"]
_EC = ["english", "rating", "community", "suggestion", "touch", "careers", "skills", "conflict", "listen", "include", "diverse", "languages"]


def _rff_sql(variant: str) -> dict[str, str]:
    t = lambda x: Q.substance(_q(x))
    speak = ("speaker1", "speaker2", "speaker3", "topic1", "topic2")
    if variant == "agent":
        n, z, b = (lambda x: Q.scale(_q(x), 1, 7)), (lambda x: Q.scale(_q(x), 0, 10)), (lambda x: Q.yes_no(_q(x), "reflective"))
        d1 = [(0.30, t("adjectives")), (0.30, t("skills")), (0.20, Q.hopes("f_hope1")), (0.20, Q.hopes("f_hope2"))]
        d2 = [(0.70, t("goal")), (0.30, t("goal_next"))]
        d4 = [(0.25, n("ready")), (0.20, n("ready_fy")), (0.20, z("stronger")), (0.15, z("prepared")), (0.20, b("connects"))]
        d5 = Q.total(list(zip((0.25, 0.20, 0.20, 0.20, 0.15), map(z, speak), strict=True)))
    else:
        n, z, b = (lambda x: Q.scale(_q(x), 1, 7, "midpoint")), (lambda x: Q.scale(_q(x), 0, 10, "midpoint")), (lambda x: Q.yes_no(_q(x), "communicator"))
        d1 = [(0.30, t("adjectives")), (0.30, t("skills")), (0.20, Q.tags("f_hope2")), (0.20, Q.tags("f_hope1"))]
        d2 = [(0.40, t("goal")), (0.35, t("goal_set")), (0.25, t("goal_next"))]
        d4 = [(0.20, n("ready")), (0.20, n("ready_fy")), (0.20, z("stronger")), (0.20, z("prepared")), (0.20, b("connects"))]
        d5 = f"({Q.total([(1.0, z(x)) for x in speak])} / 5)"
    return {"d1": Q.total(d1), "d2": Q.total(d2), "d3": Q.total([(0.40, n("pursue")), (0.30, b("more_prepared")), (0.30, t("ideal"))]), "d4": Q.total(d4), "d5": d5}


def _pillar(name: str, fields: list[str], parts: dict[str, str], weights: tuple, variant: str, make):
    total = Q.total(list(zip(weights, ("d1", "d2", "d3", "d4", "d5"), strict=True))) + " * 100"
    score = Q.half_even(total, 1) if variant == "agent" else Q.half_even(f"least(greatest({total}, 0.0::double), 100.0::double)", 2)
    inner = ", ".join(f"{x} as {k}" for k, x in parts.items())
    sql = f"{_with(fields)}, d as (select student, {inner} from s) select student, {', '.join(f'round({k}, 6) as {k}' for k in parts)}, {score} as score from d"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = make(_c, variant)
        return _survey(spark, sf_dir, fields).select("student", *[F.round(got[k], 6).alias(k) for k in parts], got["score"].alias("score"))

    run.__name__ = name
    return query(sql)(run)


gc_score = _pillar("gc_score", _GC, _gc_sql("agent"), (0.30, 0.20, 0.20, 0.20, 0.10), "agent", P.global_citizen)
gc_score_batch = _pillar("gc_score_batch", _GC, _gc_sql("batch"), (0.30, 0.20, 0.20, 0.20, 0.10), "batch", P.global_citizen)
rff_score = _pillar("rff_score", _RFF, _rff_sql("agent"), (0.25, 0.25, 0.25, 0.25, 0.0), "agent", P.future_focused)
rff_score_batch = _pillar("rff_score_batch", _RFF, _rff_sql("batch"), (0.25, 0.20, 0.25, 0.15, 0.15), "batch", P.future_focused)

_YES = {x: Q.yes_no(f"f_{x}", "communicator") for x in ("volunteered", "internship", "job")}


@query(
    f"""{_with(_CR)}, p as (select student,
      ((case when {Q.hours_low('f_hours')} is null and {_YES['volunteered']} = 0 then 0 when {Q.hours_low('f_hours')} is null or {Q.hours_low('f_hours')} < 10 then 10 when {Q.hours_low('f_hours')} < 30 then 20 when {Q.hours_low('f_hours')} < 60 then 30 else 40 end)
        + case when {_YES['internship']} = 1 then 30 else 0 end + case when {_YES['job']} = 1 then 30 else 0 end)::double as c1,
      round_even((case when coalesce({Q.number('f_scheduled')}, 0) > 0 then least(coalesce({Q.number('f_attended')}, 0) / {Q.number('f_scheduled')}, 1.0::double) * 60 else 0.0 end)::double + least({Q.list_size('f_champions')} / 5.0::double, 1.0::double) * 40, 1) as c2,
      case when trim(coalesce(f_notes, '')) <> '' then {Q.coverage('f_notes')} end as c3, case when trim(coalesce(f_notes, '')) <> '' then {Q.resume_steps('f_notes')}::double end as c4 from s)
    select *, {Q.half_even('(c1 + c2 + coalesce(c3, 0) + coalesce(c4, 0)) / (2 + cast(c3 is not null as int) + cast(c4 is not null as int))', 1)} as score from p"""
)
def cr_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.career_ready(_c)
    return _survey(spark, sf_dir, _CR).select("student", *[v.alias(k) for k, v in got.items()])


@query(
    f"""{_with(_CR)}, m as (select max(coalesce({Q.number('f_attended')}, 0)) as most from s), p as (select student,
      {Q.total([(0.25, _YES['volunteered']), (0.25, f"(least({Q.hours_middle('f_hours')}, 60.0)::double / 60)"), (0.25, _YES['internship']), (0.25, _YES['job'])])} * 100 as c1,
      {Q.total([(0.65, f"least(greatest(coalesce({Q.number('f_attended')}, 0) / greatest(most, 1.0), 0.0), 1.0)::double"), (0.35, f"(least({Q.list_size('f_champions')}, 6) / 6.0::double)")])} * 100 as c2,
      {Q.coverage('f_notes')} as c3, {Q.resume_steps('f_notes')}::double as c4 from s, m)
    select student, round(c1, 6) as c1, round(c2, 6) as c2, c3, c4, {Q.half_even('(c1 + c2 + c3 + c4) / 4', 2)} as score from p"""
)
def cr_score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _survey(spark, sf_dir, _CR).withColumn("sessions", F.coalesce(N.number(_c("attended")), F.lit(0.0)))
    got = P.career_ready(_c, "batch", F.col("most"))
    return P.cohort_maximum(s, "sessions", "most").select("student", F.round(got["c1"], 6).alias("c1"), F.round(got["c2"], 6).alias("c2"), got["c3"].alias("c3"), got["c4"].alias("c4"), got["score"].alias("score"))


def _ec_batch_sql() -> dict[str, str]:
    sub = lambda x: Q.substance(_q(x))
    n17 = lambda x: Q.scale(_q(x), 1, 7, "midpoint")
    eng, written = f"({Q.english('f_english', True)}::double - 1) / 4", f"(({sub('suggestion')} + {sub('touch')} + {sub('careers')}) / 3)"
    marks = " or ".join(f"contains(lower(f_languages), '{m}')" for m in N.LANGUAGE_MARKS)
    return {
        "verbal": Q.total([(10, eng), (10, Q.scale("f_rating", 1, 10, "midpoint")), (5, n17("community")), (5, written)]),
        "written": Q.total([(15, written), (5, sub("skills"))]),
        "interpersonal": Q.total([(10, n17("listen")), (10, n17("conflict")), (5, f"cast(coalesce({Q.number('f_conflict')}, 4.0) > 3 as double)")]),
        "cultural": Q.total([(10, n17("include")), (5, Q.yes_no("f_diverse", "communicator")), (3, f"coalesce(cast(({marks}) as double), 0.0)"), (2, eng)]),
    }


@query(
    f"{_with(_EC)}, p as (select student, {', '.join(f'{x} as {k}' for k, x in _ec_batch_sql().items())} from s) select student, {', '.join(f'round({k}, 6) as {k}' for k in _ec_batch_sql())}, "
    f"{Q.half_even('least(100.0::double, greatest(0.0::double, verbal + written + interpersonal + cultural))', 2)} as score from p"
)
def ec_score_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.communicator(_c, "batch")
    return _survey(spark, sf_dir, _EC).select("student", *[F.round(got[k], 6).alias(k) for k in ("verbal", "written", "interpersonal", "cultural")], got["score"].alias("score"))


@query(
    f"""{_with(['languages', 'english'])} select student, coalesce(cast(({" or ".join(f"contains(lower(f_languages), '{m}')" for m in N.LANGUAGE_MARKS)}) as double), 0.0) as marks, {Q.english('f_english', True)} as english from s"""
)
def language_answers_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _survey(spark, sf_dir, ["languages", "english"]).select("student", N.language_marks(_c("languages")).alias("marks"), N.english(_c("english"), within=True).alias("english"))


_SIX = "select o_orderkey as student, o_custkey % 101 * 1.0::double as ec, (o_orderkey % 97) * 1.0::double as gc, case when o_orderstatus <> 'P' then o_totalprice / 10000 end as ci, o_orderkey % 89 / 2.0::double as ct, o_custkey % 83 / 3.0::double as rff, 50.0::double as cr from orders"


@query(f"with t as ({_SIX}), u as (select student, {Q.half_even('(ec + gc + ci + ct + rff + cr) / 6', 2)} as total from t) select student, total, row_number() over (order by total desc nulls last, student) as rank from u")
def pillar_total_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    six = S.read(spark, sf_dir, "orders").select(
        k.alias("student"), (c % 101).cast("double").alias("ec"), (k % 97).cast("double").alias("gc"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 10000).alias("ci"),
        (k % 89 / 2.0).alias("ct"), (c % 83 / 3.0).alias("rff"), F.lit(50.0).alias("cr"),
    )
    return P.pillar_total(six, "student", ["ec", "gc", "ci", "ct", "rff", "cr"])


def _ec_sql() -> dict[str, str]:
    text = lambda x: f"greatest(1.0::double, {Q.substance(_q(x))} * 5)"
    n15, n17 = (lambda x: f"(({x}) - 1) / 4"), (lambda x: Q.scale(_q(x), 1, 7))
    eng = f"{Q.english('f_english')}::double"
    return {
        "verbal": Q.total([(10, n15(eng)), (10, Q.scale("f_rating", 1, 10)), (5, n17("community")), (5, n15(text("suggestion")))]),
        "written": Q.total([(15, n15(f"({text('suggestion')} + {text('touch')} + {text('careers')}) / 3")), (5, n15(text("skills")))]),
        "interpersonal": Q.total([(10, n17("listen")), (10, n17("conflict")), (5, f"coalesce(cast({Q.number('f_conflict')} > 3 as double), 0.0)")]),
        "cultural": Q.total([(10, n17("include")), (5, Q.yes_no("f_diverse", "communicator")), (3, f"cast({Q.list_size('f_languages')} >= 2 as double)"), (2, n15(eng))]),
    }


@query(
    f"{_with(_EC)}, p as (select student, {', '.join(f'{x} as {k}' for k, x in _ec_sql().items())} from s) select student, {', '.join(f'round({k}, 6) as {k}' for k in _ec_sql())}, "
    f"{Q.half_even('least(100.0::double, greatest(0.0::double, verbal + written + interpersonal + cultural))', 2)} as score from p"
)
def ec_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = P.communicator(_c)
    return _survey(spark, sf_dir, _EC).select("student", *[F.round(got[k], 6).alias(k) for k in ("verbal", "written", "interpersonal", "cultural")], got["score"].alias("score"))


@query("select o_orderkey, case when n > 0 then (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / n end as mean from (select o_orderkey, case when o_orderkey % 3 > 0 then o_totalprice end as a, case when o_orderkey % 2 = 1 then 1.5::double end as b, case when o_orderkey % 5 = 0 then 10.0::double end as c, cast(o_orderkey % 3 > 0 as int) + cast(o_orderkey % 2 = 1 as int) + cast(o_orderkey % 5 = 0 as int) as n from orders)")
def component_mean_skip_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    parts = [F.when(k % 3 > 0, F.col("o_totalprice")), F.when(k % 2 == 1, 1.5), F.when(k % 5 == 0, 10.0)]
    return S.read(spark, sf_dir, "orders").select("o_orderkey", P.mean_of(parts).alias("mean"))


@query("with t as (select o_custkey, count(*) as n from orders group by 1) select o_custkey, n, round_even(n / (select max(n) from t)::double * 60, 1) as scaled from t")
def cohort_max_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = S.read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return P.cohort_maximum(t, "n", "most").select("o_custkey", "n", F.bround(F.col("n") / F.col("most") * 60, 1).alias("scaled"))


_PCT = """with v as (select o_orderkey, o_orderpriority, case when o_orderkey % 11 > 0 then floor(o_totalprice / 1000) end as x from orders),
r as (select *, (rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0::double) / (select count(x) from v) as p from v where x is not null)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", F.when(F.col("o_orderkey") % 11 > 0, F.floor(F.col("o_totalprice") / 1000).cast("double")).alias("x"))


@query(f"{_PCT} select v.o_orderkey, v.x, r.p from v left join r using (o_orderkey)")
def percentile_avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.percentile_rank(_scored(spark, sf_dir), "x", "p").select("o_orderkey", "x", "p")


@query(f"{_PCT} select v.o_orderkey, cast(round_even(r.p * 100, 0) as bigint) as pct, 'Top ' || cast(100 - round_even(r.p * 100, 0) as bigint) || '%' as label from v left join r using (o_orderkey)")
def top_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = W.percentile_rank(_scored(spark, sf_dir), "x", "p").withColumn("pct", F.bround(F.col("p") * 100, 0).cast("long"))
    return p.select("o_orderkey", "pct", F.concat(F.lit("Top "), (100 - F.col("pct")).cast("string"), F.lit("%")).alias("label"))


_FACTS = """select o_custkey as student, case when o_custkey % 4 > 0 then '10' end as hours, count(*) as sessions, count(*) filter (where o_orderstatus = 'F') as cpc_sessions, count(distinct o_orderpriority) as champions,
  avg(cast(o_orderstatus <> 'P' as double)) * 100 as pct_skill, avg(cast(o_totalprice > 100000 as double)) * 100 as pct_disc, avg(cast(o_totalprice > 300000 as double)) * 100 as pct_comp,
  count(*) filter (where o_totalprice > 250000) as matched, count(*) filter (where o_orderpriority = '1-URGENT') as n_resume, coalesce(max(o_orderpriority) = '5-LOW', false) as open_resume, cast(round(sum(o_totalprice) / 10000) as bigint) as chars, o_custkey % 5 > 0 as c1_ok from orders group by o_custkey"""


@query(
    f"""with f as ({_FACTS}), g as (select *, cast(c1_ok as int) + cast(sessions >= 9 and champions > 0 as int) + cast(cpc_sessions >= 3 and pct_skill >= 60 and pct_disc >= 60 and chars >= 100 as int) + cast(n_resume > 0 as int) as n_complete from f),
    h as (select student, n_complete, n_complete * 25 + cast(hours is not null as int) * 5 + cast(not open_resume and n_resume > 0 as int) * 10 + least(cpc_sessions, 30) + least(sessions, 40) + cast(pct_skill >= 80 as int) * 5 + cast(pct_disc >= 80 as int) * 5
      + cast(matched >= 3 as int) * 5 + cast(champions >= 2 as int) * 5 + cast(pct_comp >= 50 as int) * 3 as quality from g)
    select student, n_complete, quality, cast(row_number() over (order by n_complete desc, quality desc, student) as integer) as rank from h order by rank limit 200"""
)
def cohort_top200(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, status, prio = F.col("o_totalprice"), F.col("o_orderstatus"), F.col("o_orderpriority")
    share = lambda x: F.avg(x.cast("double")) * 100
    facts = S.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("student")).agg(
        F.count("*").alias("sessions"), F.count_if(status == "F").alias("cpc_sessions"), F.countDistinct(prio).alias("champions"), share(status != "P").alias("pct_skill"), share(price > 100000).alias("pct_disc"),
        share(price > 300000).alias("pct_comp"), F.count_if(price > 250000).alias("matched"), F.count_if(prio == "1-URGENT").alias("n_resume"), F.coalesce(F.max(prio) == "5-LOW", F.lit(False)).alias("open_resume"),
        F.round(F.sum(price) / 10000).cast("long").alias("chars"),
    )
    facts = facts.withColumns({"hours": F.when(F.col("student") % 4 > 0, "10"), "c1_ok": F.col("student") % 5 > 0})
    return P.cohort(facts, 200)


@query("select bin, count(*) as n from (select case when x > 0 and x <= 20 then 0 when x > 20 and x <= 40 then 1 when x > 40 and x <= 60 then 2 when x > 60 and x <= 80 then 3 when x > 80 and x <= 100 then 4 end as bin from (select c_acctbal / 100 as x from customer)) group by 1")
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal") / 100
    return S.read(spark, sf_dir, "customer").select(W.right_closed_bins(x, [0, 20, 40, 60, 80, 100]).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


@query("select c_mktsegment, count(*) as n, count(distinct c_nationkey) as nations, round(avg(c_acctbal), 6) as mean, round(stddev_samp(c_acctbal), 6) as std, min(c_acctbal) as low, max(c_acctbal) as high, median(c_acctbal) as median, arg_min(c_custkey, c_acctbal) as lowest, arg_max(c_custkey, c_acctbal) as highest from customer group by 1")
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    return S.read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("nations"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.min(x).alias("low"), F.max(x).alias("high"),
        # of equal values the first customer, whatever the order in which rows are met; a missing value is neither lowest nor highest
        F.median(x).alias("median"), F.min_by("c_custkey", F.when(x.isNotNull(), F.struct(x, "c_custkey"))).alias("lowest"), F.max_by("c_custkey", F.when(x.isNotNull(), F.struct(x, -F.col("c_custkey")))).alias("highest"),
    )


@query("select o_custkey as entity, o_orderpriority as pillar, round_even(avg(cast(o_orderstatus <> 'P' as double)), 2) as coverage from orders group by 1, 2")
def coverage_by_pillar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("pillar"), F.when(F.col("o_orderstatus") != "P", "found").otherwise("missing").alias("status"))
    return P.coverage(rows)




@query(
    f"""{_with(['pre1', 'stronger', 'rating', 'notes'])}, p as (select student, {Q.scale('f_pre1', 1, 7)} as gc, {Q.scale('f_stronger', 0, 10)} * 30 as ec, {Q.coverage('f_notes')} as cr, coalesce(nullif(trim(f_notes), ''), 'No notes yet') as narrative from s)
    select student, round_even(least(gc * 100, 100), 1) as gc_bar, round_even(least(ec / 30 * 100, 100), 1) as ec_bar, round_even(least(cr, 100), 1) as cr_bar, round_even((gc * 100 + ec / 30 * 100 + cr) / 3, 1) as total, narrative from p"""
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _survey(spark, sf_dir, ["pre1", "stronger", "rating", "notes"])
    gc, ec, cr = N.scale(_c("pre1"), 1, 7), N.scale(_c("stronger"), 0, 10) * 30, N.competence_coverage(_c("notes"))
    return s.select(
        "student", R.bar_width("GC", "", gc).alias("gc_bar"), R.bar_width("EC", "Verbal", ec).alias("ec_bar"), R.bar_width("CR", "", cr).alias("cr_bar"), F.bround((gc * 100 + ec / 30 * 100 + cr) / 3, 1).alias("total"),
        R.first_text(_c("notes"), F.lit("No notes yet")).alias("narrative"),
    )


@query("select c_custkey, list_filter(list_transform(string_split(c_name || ', ' || c_mktsegment || ', x, ' || c_mktsegment || ' two, and three', ','), lambda x: trim(x)), lambda x: length(x) > 1 and length(x) <= 40)[1:4] as chips, substr(c_mktsegment, 1, 1) || 'C' as initials from customer")
def report_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(", x, "), "c_mktsegment", F.lit(" two, and three"))
    return S.read(spark, sf_dir, "customer").select("c_custkey", R.chips(text).alias("chips"), T.initials(F.concat_ws(" ", F.lower("c_mktsegment"), "c_name", F.lit("third"))).alias("initials"))


@query()
def hash_sample_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.hash_sample(S.read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 50)



def _gc_null_sql() -> str:
    n, b = (lambda x: Q.scale(_q(x), 1, 7, "null")), (lambda x: Q.yes_no(_q(x), "nullable"))
    network = Q.number("f_network")
    parts = {
        "d1": Q.total([(0.05, n(f"pre{k}")) for k in range(1, 7)] + [(w, n(f"post{k}")) for k, w in ((1, 0.15), (2, 0.15), (3, 0.15), (4, 0.20))]),
        "d2": Q.total([(0.15, n("community_pre")), (0.40, n("community")), (0.45, Q.culture_exact("f_culture"))]),
        "d3": Q.total([(0.30, n("values")), (0.30, b("diverse")), (0.40, b("introduced"))]),
        "d4": Q.total([(0.15, b(x)) for x in ("belong", "network_value", "engaged", "friends")] + [(0.40, f"(case when hi > lo then ({network} - lo) / (hi - lo) when {network} is not null then 0.5 end)")]),
        "d5": Q.total([(0.35, b("volunteered")), (0.65, Q.hours_bin("f_hours", "null"))]),
    }
    total = Q.total(list(zip((0.30, 0.20, 0.20, 0.20, 0.10), parts, strict=True))) + " * 100"
    return f"""{_with(_GC)}, ends as (select min({network}) as lo, max({network}) as hi from s), d as (select student, {', '.join(f'{x} as {k}' for k, x in parts.items())} from s, ends)
    select student, {', '.join(f'round({k}, 6) as {k}' for k in parts)}, {Q.half_even(total, 1)} as score from d"""


@query(_gc_null_sql())
def gc_score_nullable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cohort's form with nulls kept."""
    s = _survey(spark, sf_dir, _GC)
    ends = s.agg(F.min(N.number(_c("network"))).alias("lo"), F.max(N.number(_c("network"))).alias("hi"))
    got = P.global_citizen_nullable(_c, F.col("lo"), F.col("hi"))
    return s.crossJoin(F.broadcast(ends)).select("student", *[F.round(got[k], 6).alias(k) for k in ("d1", "d2", "d3", "d4", "d5")], got["score"].alias("score"))


#: Fields that documents speak of; the document's answer is picked by the order's key.
_TOLD = ["community", "diverse", "introduced", "pursue", "more_prepared", "ready", "stronger", "prepared"]


def _told(k: int) -> str:
    return f"case when o_orderpriority in ('1-URGENT', '2-HIGH') then case (o_orderkey + {k}) % 5 when 0 then '4' when 1 then 'True' when 2 then null when 3 then 'yes' else '12' end end"


def _rescored_sql() -> str:
    fields = sorted({*_GC, *_RFF})
    falsy = "lower(trim({s})) in ('', 'false', 'no', '0', '0.0', 'nan', 'none')"

    def merged(f: str) -> str:
        if f not in _TOLD:
            return f"f_{f}"
        s, d = f"f_{f}", f"d_{f}"
        no = falsy.format(s=s)
        larger = f"coalesce(try_cast(trim({d}) as double) > case when {s} is null or {no} then 0.0 else try_cast(trim({s}) as double) end, false)"
        return f"case when {d} is null then {s} when {s} is null then {d} when (upper(trim({d})) in ('TRUE', 'YES') and {no}) or {larger} then {d} else {s} end"

    def score(parts: dict[str, str], weights: tuple) -> str:
        return Q.half_even(Q.total([(w, f"({parts[k]})") for w, k in zip(weights, ("d1", "d2", "d3", "d4", "d5"), strict=True)]) + " * 100", 1)

    gc, rff = score(_gc_sql("agent"), (0.30, 0.20, 0.20, 0.20, 0.10)), score(_rff_sql("agent"), (0.25, 0.25, 0.25, 0.25, 0.0))
    moved = lambda names: " or ".join(f"m.f_{f} is distinct from s.f_{f}" for f in names if f in _TOLD)
    return f"""with s as ({survey_sql(fields)}), t as (select o_orderkey as student, {', '.join(f'{_told(k)} as d_{f}' for k, f in enumerate(_TOLD))} from orders),
    m as (select student, {', '.join(f'{merged(f)} as f_{f}' for f in fields)} from s join t using (student)),
    b as (select student, {gc} as gc, {rff} as rff from s), a as (select student, {gc} as gc, {rff} as rff from m)
    select student, a.gc, a.rff, case when a.gc = b.gc then 'survey' else 'survey+docs' end as gc_source, case when a.rff = b.rff then 'survey' else 'survey+docs' end as rff_source,
      list_filter([case when {moved(_GC)} then 'gc' end, case when {moved(_RFF)} then 'rff' end], lambda x: x is not null) as scored_anew
    from a join b using (student) join m using (student) join s using (student)"""


def _pillars() -> E.Pillars:
    part = lambda make: lambda c: make(c, "agent")["score"]
    return {"gc": (_GC, part(P.global_citizen)), "rff": (_RFF, part(P.future_focused))}


#: Orders whose pillars a task scores: few enough that tasks end together, whatever bytes their keys have.
SCORED = 50_000


@query(_rescored_sql())
def rescored_pillars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pillars after documents have filled and overridden fields; the scores of the survey alone are the ones from before."""
    fields = sorted({*_GC, *_RFF})
    # orders are dealt out as keys, before their answers are made of them: scoring then takes all cores however few files there are, and no answer is shuffled
    orders = S.read(spark, sf_dir, "orders")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-orders.count() // SCORED))
    dealt = lambda *more: orders.select("o_orderkey", *more).repartition(parts, "o_orderkey")
    survey = dealt("o_custkey").select(F.col("o_orderkey").alias("student"), *[F.expr(looked_up(f)).alias(f) for f in fields])
    docs = dealt("o_orderpriority").select(F.col("o_orderkey").alias("student"), *[F.expr(_told(k)).alias(f) for k, f in enumerate(_TOLD)])
    before = S.stored(E.scored(survey, "student", _pillars()), "survey-scores")
    after = E.rescored(E.with_documents(survey, docs, "student", fields), before, "student", _pillars())
    return E.with_sources(after, before, "student", _pillars()).select("student", "gc", "rff", "gc_source", "rff_source", "scored_anew")
