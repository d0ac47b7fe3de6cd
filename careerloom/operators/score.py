"""Pillar scores as named variants: each keeps its own weights, caps and policy for missing answers.

``agent`` scores one survey; ``batch`` scores a cohort table. They are not reconciled.
Text items take scores from 0 to 1 from a text scorer; the one used here is the length of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import norm as N
from .windows import numbered


def _sum(terms: list[tuple[float, Column]]) -> Column:
    out = F.lit(0.0)
    for w, c in terms:
        out = out + c * w
    return out


def global_citizen(c, variant: str = "agent") -> dict[str, Column]:
    """Dimensions and score (0-100) from answers ``c(name)``."""
    if variant == "agent":
        n = lambda x: N.scale(c(x), 1, 7)
        b = lambda x: N.yes_no(c(x))
        d1 = _sum([(0.05, n(x)) for x in ("pre1", "pre2", "pre3", "pre4", "pre5", "pre6")] + [(0.15, n("post1")), (0.15, n("post2")), (0.15, n("post3")), (0.20, n("post4"))])
        d2 = _sum([(0.15, n("community_pre")), (0.40, n("community")), (0.45, N.culture_feel(c("culture")))])
        d4_last = F.least(F.coalesce(N.number(c("network")), F.lit(0.0)) / 10, F.lit(1.0))
        d5 = _sum([(0.35, b("volunteered")), (0.65, N.hours_bin(c("hours")))])
    else:
        n = lambda x: N.scale(c(x), 1, 7, "midpoint")
        b = lambda x: N.yes_no(c(x), "communicator")
        d1 = _sum([(0.05, n(x)) for x in ("pre1", "pre2", "pre3", "pre4", "pre5", "pre6")] + [(0.175, n(f"post{k}")) for k in (1, 2, 3, 4)])
        d2 = _sum([(0.15, n("community_pre")), (0.40, n("community")), (0.45, N.substance(c("culture")))])
        d4_last = F.least(F.greatest(F.coalesce(N.number(c("network")), F.lit(0.0)), F.lit(0.0)), F.lit(5.0)) / 5
        d5 = _sum([(0.35, b("volunteered")), (0.65, F.least(N.hours_middle(c("hours")), F.lit(60.0)) / 60)])
    d3 = _sum([(0.30, n("values")), (0.30, b("diverse")), (0.40, b("introduced"))])
    d4 = _sum([(0.15, b(x)) for x in ("belong", "network_value", "engaged", "friends")] + [(0.40, d4_last)])
    total = _sum([(0.30, d1), (0.20, d2), (0.20, d3), (0.20, d4), (0.10, d5)]) * 100
    score = N.half_even(total, 1) if variant == "agent" else N.half_even(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 2)
    return {"d1": d1, "d2": d2, "d3": d3, "d4": d4, "d5": d5, "score": score}


def global_citizen_nullable(c, low: Column, high: Column) -> dict[str, Column]:
    """The cohort's form that keeps nulls: a dimension with a missing answer is null, and so is its score; the network counts by its place between the cohort's ends."""
    n = lambda x: N.scale(c(x), 1, 7, "null")
    b = lambda x: N.yes_no(c(x), "nullable")
    d1 = _sum([(0.05, n(x)) for x in ("pre1", "pre2", "pre3", "pre4", "pre5", "pre6")] + [(0.15, n("post1")), (0.15, n("post2")), (0.15, n("post3")), (0.20, n("post4"))])
    d2 = _sum([(0.15, n("community_pre")), (0.40, n("community")), (0.45, N.culture_exact(c("culture")))])
    d3 = _sum([(0.30, n("values")), (0.30, b("diverse")), (0.40, b("introduced"))])
    d4 = _sum([(0.15, b(x)) for x in ("belong", "network_value", "engaged", "friends")] + [(0.40, N.min_max(N.number(c("network")), low, high))])
    d5 = _sum([(0.35, b("volunteered")), (0.65, N.hours_bin(c("hours"), "null"))])
    return {"d1": d1, "d2": d2, "d3": d3, "d4": d4, "d5": d5, "score": N.half_even(_sum([(0.30, d1), (0.20, d2), (0.20, d3), (0.20, d4), (0.10, d5)]) * 100, 1)}


def future_focused(c, variant: str = "agent") -> dict[str, Column]:
    t = lambda x: N.substance(c(x))
    if variant == "agent":
        n = lambda x: N.scale(c(x), 1, 7)
        z = lambda x: N.scale(c(x), 0, 10)
        b = lambda x: N.yes_no(c(x), "reflective")
        d1 = _sum([(0.30, t("adjectives")), (0.30, t("skills")), (0.20, N.hopes(c("hope1"))), (0.20, N.hopes(c("hope2")))])
        d2 = _sum([(0.70, t("goal")), (0.30, t("goal_next"))])
        d4 = _sum([(0.25, n("ready")), (0.20, n("ready_fy")), (0.20, z("stronger")), (0.15, z("prepared")), (0.20, b("connects"))])
        weights = (0.25, 0.25, 0.25, 0.25, 0.0)
    else:
        n = lambda x: N.scale(c(x), 1, 7, "midpoint")
        z = lambda x: N.scale(c(x), 0, 10, "midpoint")
        b = lambda x: N.yes_no(c(x), "communicator")
        d1 = _sum([(0.30, t("adjectives")), (0.30, t("skills")), (0.20, N.tags(c("hope2"))), (0.20, N.tags(c("hope1")))])
        d2 = _sum([(0.40, t("goal")), (0.35, t("goal_set")), (0.25, t("goal_next"))])
        d4 = _sum([(0.20, n("ready")), (0.20, n("ready_fy")), (0.20, z("stronger")), (0.20, z("prepared")), (0.20, b("connects"))])
        weights = (0.25, 0.20, 0.25, 0.15, 0.15)
    d3 = _sum([(0.40, n("pursue")), (0.30, b("more_prepared")), (0.30, t("ideal"))])
    speak = ("speaker1", "speaker2", "speaker3", "topic1", "topic2")
    d5 = _sum(list(zip((0.25, 0.20, 0.20, 0.20, 0.15), map(z, speak), strict=True))) if variant == "agent" else _sum([(1.0, z(x)) for x in speak]) / 5
    total = _sum(list(zip(weights, (d1, d2, d3, d4, d5), strict=True))) * 100
    score = N.half_even(total, 1) if variant == "agent" else N.half_even(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 2)
    return {"d1": d1, "d2": d2, "d3": d3, "d4": d4, "d5": d5, "score": score}


def career_ready(c, variant: str = "agent", most_sessions: Column | None = None) -> dict[str, Column]:
    """``most_sessions``: the cohort's most sessions, for ``batch``."""
    if variant == "agent":
        vol, intern, job = (N.yes_no(c(x), "communicator") for x in ("volunteered", "internship", "job"))
        c1 = N.ladder(N.hours_low(c("hours")), vol, intern, job).cast("double")
        attended, scheduled = (F.coalesce(N.number(c(x)), F.lit(0.0)) for x in ("attended", "scheduled"))
        part = F.when(scheduled > 0, F.least(attended / scheduled, F.lit(1.0)) * 60).otherwise(0.0)
        c2 = N.half_even(part + F.least(N.list_size(c("champions")) / 5, F.lit(1.0)) * 40, 1)
        told = F.trim(F.coalesce(c("notes"), F.lit(""))) != ""
        c3, c4 = F.when(told, N.competence_coverage(c("notes"))), F.when(told, N.resume_steps(c("notes")).cast("double"))
        return {"c1": c1, "c2": c2, "c3": c3, "c4": c4, "score": N.half_even(mean_of([c1, c2, c3, c4]), 1)}
    vol, intern, job = (N.yes_no(c(x), "communicator") for x in ("volunteered", "internship", "job"))
    c1 = _sum([(0.25, vol), (0.25, F.least(N.hours_middle(c("hours")), F.lit(60.0)) / 60), (0.25, intern), (0.25, job)]) * 100
    sessions = F.coalesce(N.number(c("attended")), F.lit(0.0))
    c2 = _sum([(0.65, F.least(F.greatest(sessions / F.greatest(most_sessions, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))), (0.35, F.least(N.list_size(c("champions")), F.lit(6)) / 6)]) * 100
    c3, c4 = N.competence_coverage(c("notes")), N.resume_steps(c("notes")).cast("double")
    return {"c1": c1, "c2": c2, "c3": c3, "c4": c4, "score": N.half_even((c1 + c2 + c3 + c4) / 4, 2)}


def communicator(c, variant: str = "agent") -> dict[str, Column]:
    """Text items from 1 to 5: ``agent`` takes five times the text score, 1 at least; ``batch`` shares of the span."""
    eng = N.english(c("english"), within=variant == "batch").cast("double")
    if variant == "agent":
        text = lambda x: F.greatest(F.lit(1.0), N.substance(c(x)) * 5)
        n15 = lambda x: (x - 1) / 4
        n17 = lambda x: N.scale(c(x), 1, 7)
        rating, suggestion = N.scale(c("rating"), 1, 10), n15(text("suggestion"))
        written, skills = n15((text("suggestion") + text("touch") + text("careers")) / 3), n15(text("skills"))
        languages, calm = N.multilingual(c("languages")), F.coalesce(N.number(c("conflict")), F.lit(0.0))
    else:
        n15 = lambda x: (x - 1) / 4
        n17 = lambda x: N.scale(c(x), 1, 7, "midpoint")
        rating = N.scale(c("rating"), 1, 10, "midpoint")
        # one mean of the three texts serves as quality and as depth
        suggestion = written = (N.substance(c("suggestion")) + N.substance(c("touch")) + N.substance(c("careers"))) / 3
        skills, languages, calm = N.substance(c("skills")), N.language_marks(c("languages")), F.coalesce(N.number(c("conflict")), F.lit(4.0))
    v = _sum([(10, n15(eng)), (10, rating), (5, n17("community")), (5, suggestion)])
    w = _sum([(15, written), (5, skills)])
    i = _sum([(10, n17("listen")), (10, n17("conflict")), (5, (calm > 3).cast("double"))])
    x = _sum([(10, n17("include")), (5, N.yes_no(c("diverse"), "communicator")), (3, languages), (2, n15(eng))])
    return {"verbal": v, "written": w, "interpersonal": i, "cultural": x, "score": N.half_even(F.least(F.lit(100.0), F.greatest(F.lit(0.0), v + w + i + x)), 2)}


def pillar_total(df: DataFrame, key: str, pillars: list[str]) -> DataFrame:
    """``key, total, rank``: the mean of the pillars to two decimals, null and last where one is missing, best first."""
    total = N.half_even(sum((F.col(p) for p in pillars[1:]), F.col(pillars[0])) / len(pillars), 2)
    rows = df.select(key, total.alias("total")).withColumn("_down", F.coalesce(-F.col("total"), F.lit(1e18)))
    return numbered(rows, "_down", "rank", key).drop("_down")


def mean_of(parts: list[Column]) -> Column:
    """Mean of the parts that are there; null if none is."""
    have = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    return F.when(have > 0, sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0)) / have)


def cohort_maximum(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the table's maximum: one aggregate, joined back as a single row."""
    return df.crossJoin(F.broadcast(df.agg(F.max(value).alias(out))))


def coverage(fields: DataFrame) -> DataFrame:
    """Share of found fields by entity and pillar: ``fields(entity, pillar, status)``."""
    return fields.groupBy("entity", "pillar").agg(F.bround(F.avg((F.col("status") == "found").cast("double")), 2).alias("coverage"))


def cohort(facts: DataFrame, k: int = 200) -> DataFrame:
    """The ``k`` students of the most complete and best data.

    ``facts(student, hours, sessions, cpc_sessions, champions, pct_skill, pct_disc, pct_comp, matched, n_resume, open_resume, chars, c1_ok)``.
    """
    c = F.col
    c2 = (c("sessions") >= 9) & (c("champions") > 0)
    c3 = (c("cpc_sessions") >= 3) & (c("pct_skill") >= 60) & (c("pct_disc") >= 60) & (c("chars") >= 100)
    c4 = c("n_resume") > 0
    one = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    complete = one(c("c1_ok")) + one(c2) + one(c3) + one(c4)
    quality = (
        complete * 25 + one(c("hours").isNotNull()) * 5 + one(~c("open_resume") & c4) * 10 + F.least("cpc_sessions", F.lit(30)) + F.least("sessions", F.lit(40))
        + one(c("pct_skill") >= 80) * 5 + one(c("pct_disc") >= 80) * 5 + one(c("matched") >= 3) * 5 + one(c("champions") >= 2) * 5 + one(c("pct_comp") >= 50) * 3
    )
    scored = facts.select("student", complete.alias("n_complete"), quality.cast("long").alias("quality"))
    order = [F.desc("n_complete"), F.desc("quality"), F.col("student")]
    top = scored.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
