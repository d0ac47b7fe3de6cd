"""Re-scoring after documents have changed fields: only entities whose fields are others than before are scored anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .link import merged_from

#: Fields that a pillar reads, and its score from answers ``c(field)``.
Pillars = dict[str, tuple[list[str], Callable[[Callable[[str], Column]], Column]]]


def with_documents(survey: DataFrame, docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key``, the merged fields, and ``changed_fields``: names of those that documents filled or overrode, in order.

    ``survey`` has all ``fields``, ``docs`` any of them, one row a key; keys of ``docs`` alone are left out. Values are strings.
    """
    have = [f for f in fields if f in docs.columns]
    both = survey.select(key, *fields).join(docs.select(key, *[F.col(f).alias(f"_doc_{f}") for f in have]), key, "left")
    how = {f: merged_from(F.col(f), F.col(f"_doc_{f}")) for f in have}
    value = lambda f: F.when(how[f] == "survey", F.col(f)).otherwise(F.col(f"_doc_{f}")) if f in how else F.col(f)
    names = F.array_compact(F.array(*[F.when(how[f] != "survey", F.lit(f)) for f in have])) if have else F.array().cast("array<string>")
    return both.select(key, *[value(f).alias(f) for f in fields], names.alias("changed_fields"))


def digests(fields: DataFrame, pillars: Pillars) -> list[Column]:
    """A hash for each pillar of all fields that it reads; null and empty are told apart."""
    return [F.sha2(F.to_json(F.struct(*[F.col(f) for f in sorted(names)]), {"ignoreNullFields": "false"}), 256).alias(f"digest_{p}") for p, (names, _) in pillars.items()]


def scored(fields: DataFrame, key: str, pillars: Pillars) -> DataFrame:
    """``key``, and each pillar's score and digest: all entities are scored."""
    return fields.select(key, *[score(F.col).alias(p) for p, (_, score) in pillars.items()], *digests(fields, pillars))


def rescored(fields: DataFrame, before: DataFrame, key: str, pillars: Pillars) -> DataFrame:
    """What ``scored`` gives, and ``scored_anew``: the pillars whose score was computed.

    ``before`` is a table of ``scored`` or ``rescored``. A pillar whose digest is as before keeps its score, and its scorer is not
    evaluated for that entity. All entities are joined once and stay where they lie. Entities that are new are scored whole; those that ``fields`` lacks are left out.
    """
    old = before.select(key, *[F.col(p).alias(f"_old_{p}") for p in pillars], *[F.col(f"digest_{p}").alias(f"_old_digest_{p}") for p in pillars], F.lit(True).alias("_known"))
    now = fields.select("*", *digests(fields, pillars)).join(old, key, "left")
    now = now.withColumns({f"_other_{p}": F.col("_known").isNull() | ~F.col(f"digest_{p}").eqNullSafe(F.col(f"_old_digest_{p}")) for p in pillars})
    scores = [F.when(F.col(f"_other_{p}"), score(F.col)).otherwise(F.col(f"_old_{p}")).alias(p) for p, (_, score) in pillars.items()]
    anew = F.array_compact(F.array(*[F.when(F.col(f"_other_{p}"), F.lit(p)) for p in pillars])).alias("scored_anew")
    return now.select(key, *scores, *[F.col(f"digest_{p}") for p in pillars], anew)


def with_sources(after: DataFrame, survey: DataFrame, key: str, pillars: Pillars) -> DataFrame:
    """Adds for each pillar where its score comes from: ``survey+docs`` where it is not that of the survey alone, else ``survey``."""
    alone = survey.select(key, *[F.col(p).alias(f"_survey_{p}") for p in pillars])
    tags = [F.when(F.col(p).eqNullSafe(F.col(f"_survey_{p}")), "survey").otherwise("survey+docs").alias(f"{p}_source") for p in pillars]
    return after.join(alone, key, "left").select(*after.columns, *tags)
