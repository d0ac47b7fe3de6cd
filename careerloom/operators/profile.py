"""Parts of a marked-up profile as expressions: header, experience, education, certificates, projects, skills.

Sections come from ``docparse.sections``. Entries of a section begin with a bold name, a dash and more; a rule ends one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTRY = r"\*\*[^\n]+?\*\*\s*[—–]\s*\S"
# Ways of working that are no places.
WORK_MODES = ("on-site", "remote", "hybrid")


def _at(items: Column, k: int) -> Column:
    return F.try_element_at(items, F.lit(k))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: (x != "") & (x != "---"))


def _filled(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def header(c: Column) -> Column:
    """``name, pronouns, headline, location`` of what stands before the first section.

    The name is the first heading, without pronouns in brackets; the headline the first bold line after it; the place the first plain line after that.
    """

    def read(lines: Column) -> Column:
        top = F.coalesce(_at(F.filter(lines, lambda x: x.rlike(r"^#\s+\S")), 1), F.lit(""))
        raw = F.trim(F.regexp_replace(top, r"^#\s+", ""))
        below = F.slice(lines, F.greatest(F.array_position(lines, top).cast("int"), F.lit(0)) + 1, F.size(lines) + 1)
        bold = _at(F.filter(below, lambda x: x.rlike(r"^\*\*.*\*\*$")), 1)
        after = F.slice(below, F.coalesce(F.array_position(below, bold).cast("int"), F.lit(0)) + 1, F.size(lines) + 1)
        plain = F.filter(F.transform(F.filter(after, lambda x: ~x.startswith("**") & ~x.rlike(r"^#\s+\S")), lambda x: F.trim(F.regexp_replace(x, r"\s*·\s*\d+(st|nd|rd|th)\s+connection.*", ""))), lambda x: x != "")
        named = top != ""
        return F.struct(
            _filled(F.regexp_replace(raw, r"\s*\([^)]+\)\s*$", "")).alias("name"), F.nullif(F.regexp_extract(raw, r"\(([^)]+)\)\s*$", 1), F.lit("")).alias("pronouns"),
            F.when(named, F.trim(F.btrim(bold, F.lit("*")))).alias("headline"), F.when(named & bold.isNotNull(), _at(plain, 1)).alias("location"),
        )

    return _at(F.transform(F.array(_lines(F.coalesce(c, F.lit("")))), read), 1)


def entries(c: Column) -> Column:
    """``left, right, lines`` of each entry of a section."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.coalesce(c, F.lit(""))), rf"\n\s*(?={_ENTRY})"), lambda x: x.rlike(rf"^{_ENTRY}"))
    field = lambda x, k: F.trim(F.regexp_extract(x, r"^\*\*([^\n]+?)\*\*\s*[—–]\s*([^\n]+)", k))
    body = lambda x: _at(F.split(F.regexp_replace(x, r"^[^\n]*", ""), r"(?m)^\s*---\s*$"), 1)
    return F.transform(parts, lambda x: F.struct(field(x, 1).alias("left"), field(x, 2).alias("right"), _lines(body(x)).alias("lines")))


def _listed(lines: Column, mark: str) -> Column:
    """Items of the last line that begins with a mark; null without one."""
    hits = F.filter(lines, lambda x: x.startswith(mark))
    line = F.when(F.size(hits) > 0, F.element_at(hits, -1))
    return F.filter(F.transform(F.split(F.substring(line, len(mark) + 1, 1 << 30), ","), lambda x: F.trim(x)), lambda x: x != "")


def _place(duration: Column) -> Column:
    """The place in a line of dates and places; a way of working counts only where no place stands before it."""
    parts = F.transform(F.split(duration, " · "), lambda x: F.trim(x))
    last, before = F.element_at(parts, -1), F.when(F.size(parts) >= 3, F.element_at(parts, -2))
    mode = F.lower(last).isin(*WORK_MODES)
    return F.when(F.size(parts) >= 2, F.when(mode, F.coalesce(F.when(~before.rlike(r"^\d"), before), last)).when(~last.rlike(r"^\d"), last))


def experience(c: Column) -> Column:
    """Roles: ``title, company, duration, location, description, skills``. The first line holds the dates."""

    def role(e: Column) -> Column:
        first = _at(e["lines"], 1)
        dates = F.when(~first.startswith("Skills:"), first)
        rest = F.filter(F.slice(e["lines"], 2, F.size(e["lines"]) + 1), lambda x: ~x.startswith("Skills:"))
        return F.struct(
            e["left"].alias("title"), F.trim(_at(F.split(e["right"], r"\s*·\s*"), 1)).alias("company"), dates.alias("duration"), _place(dates).alias("location"),
            _filled(F.array_join(rest, "\n")).alias("description"), _listed(e["lines"], "Skills:").alias("skills"),
        )

    return F.transform(entries(c), role)


def education(c: Column) -> Column:
    """Studies: ``institution, degree, years``."""

    def study(e: Column) -> Column:
        parts = F.split(e["right"], r"\s*·\s*", 2)
        two, dated = F.size(parts) == 2, e["right"].rlike(r"^\d{4}")
        return F.struct(e["left"].alias("institution"), F.when(two, F.trim(parts[0])).when(~dated, e["right"]).alias("degree"), F.when(two, F.trim(parts[1])).when(dated, e["right"]).alias("years"))

    return F.transform(entries(c), study)


def certificates(c: Column) -> Column:
    """Rows of the table below its rule: ``name, issuer, issued``; ids are cut off."""
    rows = F.filter(_lines(F.coalesce(c, F.lit(""))), lambda x: x.startswith("|") & x.endswith("|"))
    cells = F.transform(rows, lambda x: F.transform(F.split(F.substring(x, 2, F.char_length(x) - 2), r"\|"), lambda y: F.trim(y)))
    whole = F.filter(cells, lambda x: F.size(x) >= 3)
    rule = F.array_position(F.transform(whole, lambda x: x[0].rlike("^-+$")), F.lit(True)).cast("int")
    below = F.when(rule > 0, F.slice(whole, F.greatest(rule, F.lit(1)) + 1, F.size(whole) + 1)).otherwise(F.slice(whole, 1, 0))
    named = F.filter(below, lambda x: ~F.lower(x[0]).isin("certification", "name", "") & ~x[0].rlike("^-+$"))
    return F.transform(named, lambda x: F.struct(x[0].alias("name"), x[1].alias("issuer"), F.trim(F.regexp_replace(x[2], r"\s*·\s*ID:.*", "")).alias("issued")))


def projects(c: Column) -> Column:
    """Projects: ``name, date_range, description, github_url, skills``."""

    def project(e: Column) -> Column:
        link = F.filter(e["lines"], lambda x: x.startswith("GitHub:"))
        text = F.filter(e["lines"], lambda x: ~x.startswith("GitHub:") & ~x.startswith("Skills:"))
        url = F.when(F.size(link) > 0, F.trim(F.regexp_replace(F.element_at(link, -1), "^GitHub:", "")))
        return F.struct(e["left"].alias("name"), e["right"].alias("date_range"), _filled(F.array_join(text, "\n")).alias("description"), url.alias("github_url"), _listed(e["lines"], "Skills:").alias("skills"))

    return F.transform(entries(c), project)


def skills(c: Column) -> Column:
    """``technical, soft``: lists after their marks, in any case; null without one."""

    def named(pattern: str) -> Column:
        hits = F.filter(_lines(F.coalesce(c, F.lit(""))), lambda x: F.lower(x).rlike(pattern))
        line = F.when(F.size(hits) > 0, F.element_at(hits, -1))
        return F.filter(F.transform(F.split(F.regexp_replace(line, "^[^:]*:", ""), ","), lambda x: F.trim(x)), lambda x: x != "")

    return F.struct(named("^technical:").alias("technical"), named(r"^soft\s*skills?:").alias("soft"))
