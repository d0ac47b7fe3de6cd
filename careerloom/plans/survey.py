"""The survey of the synthetic tables: one record for each order, in SQL that both engines read."""

from __future__ import annotations

_VALUES = {
    "likert": ("1", "2", "3", "4", "5", "6", "7", "9", "x", None),
    "tenth": ("0", "3", "5", "8", "10", "11", "n", None),
    "binary": ("True", "Yes", "no", "1", "0", "0.5", "y", None),
    "hours": ("0", "5", "15", "20-30", "30+", "60", "10 - 20", None),
    "count": ("0", "1", "4", "7", "12", "-", None),
    "text": (
        "", "short", "a medium answer about teamwork and goals", None, "12345678901",
        "We built the resume with objective, education and skill bullets, then wrote an email to a peer and planned the next session together",
        "Analyzed a problem, led the group and will work on it later",
    ),
    "tags": ("Make new friends, skills", "Get an internship", "a, bb, new ideas, more ideas, other ideas, learn about colleges, careers, fun things", "", None),
    "culture": ("I feel equally of both", "I feel more American", "I am confused about my culture", "5", "other", None),
    "english": ("Very comfortable", "comfortable", "Somewhat comfortable", "not comfortable", "native", None),
    "languages": ("English", "English, Spanish", "French, Creole, English", "", None),
    "champions": ("Ann", "Ann, Bo", "Ann, Bo, Cy, Di, Ed, Flo", "", None),
}

#: Field, kind of value.
FIELDS = {
    **{f"pre{k}": "likert" for k in range(1, 7)}, **{f"post{k}": "likert" for k in range(1, 5)},
    "community_pre": "likert", "community": "likert", "culture": "culture", "values": "likert", "diverse": "binary", "introduced": "binary",
    "belong": "binary", "network_value": "binary", "engaged": "binary", "friends": "binary", "network": "count", "volunteered": "binary", "hours": "hours",
    "adjectives": "text", "skills": "text", "goal": "text", "goal_set": "text", "goal_next": "text", "ideal": "text", "hope1": "tags", "hope2": "tags",
    "pursue": "likert", "more_prepared": "binary", "ready": "likert", "ready_fy": "likert", "stronger": "tenth", "prepared": "tenth", "connects": "binary",
    "speaker1": "tenth", "speaker2": "tenth", "speaker3": "tenth", "topic1": "tenth", "topic2": "tenth", "internship": "binary", "job": "binary",
    "attended": "count", "scheduled": "count", "champions": "champions", "notes": "text", "english": "english", "rating": "tenth",
    "suggestion": "text", "touch": "text", "careers": "text", "conflict": "likert", "listen": "likert", "include": "likert", "languages": "languages",
}


def field(name: str) -> str:
    """A field's value for the order: picked from its kind's values by the order's keys."""
    k, values = list(FIELDS).index(name) + 1, _VALUES[FIELDS[name]]
    cases = " ".join(f"when {i} then " + ("null" if v is None else f"'{v}'") for i, v in enumerate(values))
    return f"case cast((o_orderkey * {k + 3} + o_custkey * {2 * k + 1} + {k}) % {len(values)} as int) {cases} end"


def looked_up(name: str) -> str:
    """``field`` as Spark evaluates it faster: one remainder and a look-up in place of a comparison for each value."""
    k, values = list(FIELDS).index(name) + 1, _VALUES[FIELDS[name]]
    listed = ", ".join("null" if v is None else f"'{v}'" for v in values)
    return f"get(array({listed}), cast((o_orderkey * {k + 3} + o_custkey * {2 * k + 1} + {k}) % {len(values)} as int))"


def survey_sql(names: list[str]) -> str:
    return "select o_orderkey as student, " + ", ".join(f'{field(n)} as f_{n}' for n in names) + " from orders"
