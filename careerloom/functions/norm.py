"""Survey normalisers: answers as strings to scores from 0 to 1.

The policies for missing answers differ by scorer and are never merged: ``zero`` (missing is 0),
``midpoint`` (missing is the middle of the scale, values are not clamped) and ``null``
(missing stays missing).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What every text begins with that a cast to a number takes; of others the cast would throw and catch an error for each row.
_NUMERIC = r"^[\x00-\x20]*[-+]?([.0-9]|[iI][nN][fF]|[nN][aA][nN])"


def number(c: Column) -> Column:
    """The answer as a number; null where it is none. It is parsed once: ``nanvl`` reads its argument one time, a condition on it would read it again."""
    s = c.cast("string")
    return F.nanvl(F.when(s.rlike(_NUMERIC), F.trim(s).try_cast("double")), F.lit(None).cast("double"))


def half_even(x: Column, digits: int) -> Column:
    """Half-even rounding, after nine decimals: what a sum's order does to the last bits decides no tie."""
    return F.bround(F.round(x, 9), digits)


def _clamped(x: Column) -> Column:
    """From 0 to 1; null counts as 0, as ``greatest`` leaves nulls out."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def scale(c: Column, low: int, high: int, missing: str = "zero") -> Column:
    """Answers from ``low`` to ``high`` as 0 to 1."""
    x, width = number(c), float(high - low)
    if missing == "midpoint":
        middle = {(1, 7): 4.0, (1, 5): 3.0, (0, 10): 5.0, (1, 10): 5.0}[low, high]
        return (F.coalesce(x, F.lit(middle)) - low) / width
    out = _clamped((x - low) / width)
    return out if missing == "zero" else F.when(x.isNotNull(), out)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Position between a column's extremes; 0.5 where they are equal."""
    return F.when(high > low, (x - low) / (high - low)).when(x.isNotNull(), F.lit(0.5))


def yes_no(c: Column, variant: str = "global") -> Column:
    """Yes-or-no answers. ``global``: YES/TRUE/1, else a clamped number; ``communicator``: also y, and any number
    over 0 is yes; ``reflective``: clamped numbers only, so "True" is 0; ``nullable``: as ``global``, and other answers are null."""
    s, x = F.lower(F.trim(c)), number(c)
    if variant == "nullable":
        return F.when(s.isin("yes", "true"), 1.0).when(s.isin("no", "false"), 0.0).when(x.isNotNull(), _clamped(x))
    if variant == "reflective":
        return _clamped(x)
    if variant == "communicator":
        return F.when(s.isin("1", "true", "yes", "y", "1.0"), 1.0).when(s.isin("0", "false", "no", "n", "0.0"), 0.0).otherwise(F.coalesce((x > 0).cast("double"), F.lit(0.0)))
    return F.when(s.isin("yes", "true", "1"), 1.0).when(s.isin("no", "false", "0"), 0.0).otherwise(_clamped(x))


def hours_low(c: Column) -> Column:
    """Lower bound of an hours answer; null if it is no number."""
    return number(F.split_part(F.trim(c), F.lit("-"), F.lit(1)))


def hours_bin(c: Column, missing: str = "zero") -> Column:
    """Steps of volunteered hours."""
    h = hours_low(c)
    out = F.when(h <= 0, 0.0).when(h < 10, 0.1).when(h < 20, 0.3).when(h < 30, 0.5).when(h < 60, 0.7).when(h >= 60, 1.0)
    return F.coalesce(out, F.lit(0.0)) if missing == "zero" else out


def hours_middle(c: Column) -> Column:
    """Middle of a range of hours, or the number; 0 if neither."""
    a, b = (F.regexp_extract(F.trim(c), r"^(\d+)\s*[-–]\s*(\d+)", k) for k in (1, 2))
    return F.when(a != "", (a.cast("double") + b.cast("double")) / 2).otherwise(F.coalesce(number(c), F.lit(0.0)))


# Hour ranges and what they count as, in the order in which they are looked for.
HOUR_RANGES = (
    ("1-10", 5), ("10-20", 15), ("20-30", 25), ("30-40", 35), ("40-50", 45), ("50-60", 55), ("60-70", 65),
    ("70-80", 75), ("80-90", 85), ("90-100", 95), ("100+", 120), ("0", 0),
)

# Answers on one's feeling of culture.
CULTURE_FEEL = (
    ("i feel equally of both", 1.0), ("i feel more of the culture of my country of origin", 0.7),
    ("i feel more american", 0.6), ("i am confused about my culture", 0.25),
)

# Answers on spoken English, exact (agent) and contained (batch).
ENGLISH_EXACT = (("very comfortable", 5), ("comfortable", 4), ("somewhat comfortable", 3), ("not very comfortable", 2), ("not comfortable", 1))
ENGLISH_WITHIN = (("native", 5), ("very comfortable", 4), ("comfortable", 3), ("somewhat", 2), ("not", 1))


def hours_within(c: Column) -> Column:
    """The first range whose text the answer contains; "0" comes last, so "40" counts as 0."""
    out = None
    for text, value in HOUR_RANGES:
        out = F.when(c.contains(text), value) if out is None else out.when(c.contains(text), value)
    return out


def culture_feel(c: Column) -> Column:
    s, x, out = F.lower(F.trim(c)), number(c), None
    for text, value in CULTURE_FEEL:
        out = F.when(s == text, value) if out is None else out.when(s == text, value)
    return out.when(x.isNotNull(), _clamped((x - 1) / 6)).otherwise(0.5)


# Answers on culture, in their case, and what they count as.
CULTURE_EXACT = (
    ("I feel equally of both", 1.0), ("I feel more of the culture of my country of origin", 0.7), ("I feel more American", 0.6), ("I am confused about my culture", 0.25),
)


def culture_exact(c: Column) -> Column:
    """Answers on culture as they are written, whole numbers from 2 to 7, and 0.5 for all others and none."""
    s, out = F.trim(c), None
    for text, value in CULTURE_EXACT:
        out = F.when(s == text, value) if out is None else out.when(s == text, value)
    return out.when(s.rlike("^[2-7]$"), (number(c) - 1) / 6).otherwise(0.5)


def english(c: Column, within: bool = False) -> Column:
    s, out = F.lower(F.trim(c)), None
    for text, value in ENGLISH_WITHIN if within else ENGLISH_EXACT:
        hit = s.contains(text) if within else s == text
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(3)


def substance(c: Column) -> Column:
    """How much a free text says, by its length."""
    n = F.char_length(F.coalesce(F.trim(c), F.lit("")))
    return F.when(n == 0, 0.0).when(n < 10, 0.3).when(n <= 100, 0.6).otherwise(1.0)


def tags(c: Column) -> Column:
    """Distinct items of over three letters, six at most count."""
    items = F.filter(F.transform(F.split(F.lower(c), "[,\n]"), lambda x: F.trim(x)), lambda x: F.char_length(x) > 3)
    return F.coalesce(F.least(F.size(F.array_distinct(items)), F.lit(6)) / 6, F.lit(0.0))


# Phrases for hopes, with the concept of each.
HOPES = (
    ("gain skills i can use at a future job", "skills"), ("learn about careers", "careers"), ("get an internship", "internship"),
    ("learn about colleges", "colleges"), ("make new friends", "friends"), ("get coaches and mentors", "mentoring"),
    ("get mentors", "mentoring"), ("mentoring", "mentoring"), ("skills", "skills"), ("careers", "careers"),
    ("colleges", "colleges"), ("friends", "friends"), ("internship", "internship"),
)


def hopes(c: Column) -> Column:
    """Known hopes folded to concepts, with the raw items, six at most count."""
    low = F.lower(c)
    known = F.filter(F.array(*[F.when(low.contains(p), k) for p, k in HOPES]), lambda x: x.isNotNull())
    raw = F.transform(F.filter(F.transform(F.split(low, "[,\n]"), lambda x: F.trim(x)), lambda x: (F.char_length(x) > 3) & ~x.isin("nan", "y2")), lambda x: F.substring(x, 1, 30))
    return F.when(c.isNull() | F.trim(c).isin("", "nan"), 0.0).otherwise(F.least(F.lit(1.0), F.size(F.array_distinct(F.concat(known, raw))) / 6))


# Competence categories and the stems that show them.
COMPETENCES = (
    ("Communication", ("communicat", "present", "speak", "articulate", "express", "verbal", "email", "writing")),
    ("Critical Thinking", ("analyz", "research", "problem", "solution", "evaluat", "assess", "critical", "think")),
    ("Teamwork", ("team", "collaborat", "group", "together", "peer", "partner", "cooperat")),
    ("Leadership", ("lead", "initiative", "manag", "organiz", "guide", "motivat", "mentor")),
    ("Professionalism", ("professional", "punctual", "responsib", "deadline", "work ethic", "reliab", "commit")),
    ("Career Development", ("career", "goal", "pathway", "network", "interview", "job", "future", "opportunit", "skill")),
)
# Stems that show work on a résumé.
RESUME_STEMS = ("resume", "cv", "objective", "experience", "skill", "education", "award", "activit", "format", "bullet")
# Phrases that leave open whether something was done.
OPEN_PHRASES = (
    "not received", "next time", "focus more", "haven", "did not receive", "couldn", "next session", "pending", "will work", "plan to",
    "hope to", "need to", "should", "later", "future", "upcoming", "not yet", "no resume", "bring resume", "asked for", "remind",
)


def _any(s: Column, stems: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in stems:
        out = out | s.contains(x)
    return out


def _told(s: Column) -> Column:
    """Whether a text says anything: no bare number, ten letters at least."""
    return s.isNotNull() & ~s.rlike(r"^\d+(\.\d+)?$") & (F.char_length(s) >= 10)


def competence_coverage(c: Column) -> Column:
    """Percentage of competence categories that a text shows."""
    s = F.lower(F.trim(c))
    found = sum((_any(s, stems).cast("int") for _, stems in COMPETENCES), F.lit(0))
    return F.when(_told(s), F.bround(found / len(COMPETENCES) * 100, 1)).otherwise(0.0)


def resume_steps(c: Column) -> Column:
    """0, 33, 67 or 100 by how many résumé stems a text holds."""
    s = F.lower(F.trim(c))
    hits = sum((s.contains(x).cast("int") for x in RESUME_STEMS), F.lit(0))
    return F.when(~_told(s) | s.isNull() | (hits == 0), 0).when(hits <= 1, 33).when(hits <= 3, 67).otherwise(100)


def is_open(c: Column) -> Column:
    """Whether a text holds a phrase that leaves things open."""
    return F.coalesce(_any(F.lower(c), OPEN_PHRASES), F.lit(False))


def list_size(c: Column) -> Column:
    """Non-empty items of a comma-separated list; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(c, ","), lambda x: F.trim(x) != "")), F.lit(0))


def multilingual(c: Column) -> Column:
    """1 for two or more languages in a comma-separated list."""
    return (list_size(c) >= 2).cast("double")


# What shows more than one language in an answer.
LANGUAGE_MARKS = ("and", "&", "/", ",", "french", "spanish", "creole", "fulani", "yoruba", "haitian", "portuguese", "mandarin", "arabic", "hindi")


def language_marks(c: Column) -> Column:
    """1 where an answer holds a mark of a second language, within a word too."""
    return F.coalesce(_any(F.lower(c), LANGUAGE_MARKS), F.lit(False)).cast("double")


def longest_of(a: Column, b: Column) -> Column:
    """The longer text, the first on a tie; null counts as shortest."""
    n = lambda x: F.coalesce(F.char_length(x), F.lit(-1))
    return F.when(n(a) >= n(b), a).otherwise(b)


def ladder(hours: Column, volunteered: Column, internship: Column, job: Column) -> Column:
    """Points for experience before the program: hours 0 to 40, internship and job 30 each."""
    steps = F.when(hours.isNull() & (volunteered == 0), 0).when(hours.isNull() | (hours < 10), 10).when(hours < 30, 20).when(hours < 60, 30).otherwise(40)
    return steps + F.when(internship == 1, 30).otherwise(0) + F.when(job == 1, 30).otherwise(0)
