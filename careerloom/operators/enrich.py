"""Deterministic enrichment of survey fields from documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_profile(certificates: Column, roles: Column, companies: Column, community: Column, education: Column) -> dict[str, Column]:
    """Field values that a profile supports, null where it says too little.

    ``certificates``, ``roles``, ``companies`` and ``community`` are counts; ``education`` says whether the section has text.
    """
    whole = lambda c, n: F.floor(c / n)
    some = (certificates > 0) | (roles >= 2)
    seen = F.when(companies >= 4, "True")
    return {
        "pursue": F.when((certificates > 0) | (roles >= 3), F.least(4 + whole(certificates, 5), F.lit(7))),
        "stronger": F.when(some, F.least(4 + whole(certificates, 3) + whole(roles, 4), F.lit(9))),
        "prepared": F.when(some, F.least(3 + whole(certificates, 3) + whole(roles, 5), F.lit(8))),
        "ready": F.when(education & ((certificates >= 3) | (roles >= 3)), 4).when(education, 3),
        "more_prepared": F.when((certificates >= 5) | (roles >= 4), "True"),
        "community": F.when(community > 0, F.least(community + 2, F.lit(7))),
        "diverse": seen,
        "introduced": seen,
    }


def goal_sentence(headline: Column, title: Column) -> Column:
    """Stand-in for a stated goal; null without headline and title."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    parts = F.concat_ws(" ", F.concat(F.lit("Career goal: "), blank(headline), F.lit(".")), F.concat(F.lit("Current role: "), blank(title), F.lit(".")))
    return F.nullif(parts, F.lit(""))


def resume_override(score: Column, resume: Column) -> Column:
    """The résumé part is complete where it scored 0 and the parsed résumé has over 300 characters."""
    return F.when((score == 0) & (F.char_length(resume) > 300), 100.0).otherwise(score)


def thin(a: Column, b: Column, least: int = 30) -> Column:
    """The section, or the other one if it has fewer characters than ``least``."""
    return F.when(F.char_length(F.coalesce(a, F.lit(""))) < least, b).otherwise(a)


def kept_inferences(inferred: Column, gaps: Column) -> Column:
    """Inferred skills that count: three tenths of the gaps, three at least."""
    return F.slice(inferred, 1, F.greatest(F.lit(3), F.floor(F.size(gaps) * 0.3).cast("int")))
