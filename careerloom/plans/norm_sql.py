"""DuckDB text of the survey normalisers, for the queries' SQL."""

from __future__ import annotations

from ..functions import norm as N


def number(c):
    return f"try_cast(trim({c}) as double)"


def clamp(x):
    return f"least(1.0::double, greatest(0.0::double, {x}))"


def scale(c, low, high, missing="zero"):
    if missing == "midpoint":
        middle = {(1, 7): 4.0, (1, 5): 3.0, (0, 10): 5.0, (1, 10): 5.0}[low, high]
        return f"((coalesce({number(c)}, {middle}::double) - {low}) / {float(high - low)}::double)"
    x = f"case when {number(c)} is not null then {clamp(f'({number(c)} - {low}) / {float(high - low)}::double')} end"
    return f"coalesce({x}, 0.0::double)" if missing == "zero" else f"({x})"


def yes_no(c, variant="global"):
    s = f"lower(trim({c}))"
    if variant == "nullable":
        return f"(case when {s} in ('yes', 'true') then 1.0 when {s} in ('no', 'false') then 0.0 else {clamp_null(number(c))} end)::double"
    if variant == "reflective":
        return f"coalesce({clamp_null(number(c))}, 0.0::double)"
    if variant == "communicator":
        return f"(case when {s} in ('1', 'true', 'yes', 'y', '1.0') then 1.0 when {s} in ('0', 'false', 'no', 'n', '0.0') then 0.0 else coalesce(cast({number(c)} > 0 as double), 0.0) end)::double"
    return f"(case when {s} in ('yes', 'true', '1') then 1.0 when {s} in ('no', 'false', '0') then 0.0 else coalesce({clamp_null(number(c))}, 0.0) end)::double"


def clamp_null(x):
    """Unlike Spark's, least and greatest of DuckDB skip nulls."""
    return f"case when {x} is not null then {clamp(x)} end"


def hours_low(c):
    return number(f"split_part(trim({c}), '-', 1)")


def hours_bin(c, missing="zero"):
    h = hours_low(c)
    x = f"(case when {h} <= 0 then 0.0 when {h} < 10 then 0.1 when {h} < 20 then 0.3 when {h} < 30 then 0.5 when {h} < 60 then 0.7 when {h} >= 60 then 1.0 end)::double"
    return f"coalesce({x}, 0.0::double)" if missing == "zero" else x


def hours_middle(c):
    m = rf"regexp_extract(trim({c}), '^(\d+)\s*[-–]\s*(\d+)', %d)"
    return f"(case when {m % 1} <> '' then (cast({m % 1} as double) + cast({m % 2} as double)) / 2 else coalesce({number(c)}, 0.0) end)::double"


def _cases(pairs, test, default, cast):
    return "(case " + " ".join(f"when {test(t)} then {v}" for t, v in pairs) + f" {default} end)::{cast}"


def hours_within(c):
    return _cases(N.HOUR_RANGES, lambda t: f"contains({c}, '{t}')", "", "int")


def culture_feel(c):
    s = f"lower(trim({c}))"
    inner = clamp(f"({number(c)} - 1) / 6.0::double")
    return _cases(N.CULTURE_FEEL, lambda t: f"{s} = '{t}'", f"when {number(c)} is not null then {inner} else 0.5", "double")


def culture_exact(c):
    s = f"trim({c})"
    return _cases(N.CULTURE_EXACT, lambda t: f"{s} = '{t}'", f"when regexp_full_match({s}, '[2-7]') then ({number(c)} - 1) / 6.0::double else 0.5", "double")


def english(c, within=False):
    s = f"lower(trim({c}))"
    return _cases(N.ENGLISH_WITHIN if within else N.ENGLISH_EXACT, (lambda t: f"contains({s}, '{t}')") if within else (lambda t: f"{s} = '{t}'"), "else 3", "int")


def substance(c):
    n = f"length(coalesce(trim({c}), ''))"
    return f"(case when {n} = 0 then 0.0 when {n} < 10 then 0.3 when {n} <= 100 then 0.6 else 1.0 end)::double"


def tags(c):
    return rf"coalesce(least(len(list_distinct(list_filter(list_transform(regexp_split_to_array(lower({c}), '[,\n]'), lambda x: trim(x)), lambda x: length(x) > 3))), 6) / 6.0::double, 0.0::double)"


def hopes(c):
    known = ", ".join(f"case when contains(lower({c}), '{p}') then '{k}' end" for p, k in N.HOPES)
    raw = rf"list_transform(list_filter(list_transform(regexp_split_to_array(lower({c}), '[,\n]'), lambda x: trim(x)), lambda x: length(x) > 3 and x not in ('nan', 'y2')), lambda x: substr(x, 1, 30))"
    return f"(case when {c} is null or trim({c}) in ('', 'nan') then 0.0 else least(1.0::double, len(list_distinct(list_concat(list_filter([{known}], lambda x: x is not null), {raw}))) / 6.0::double) end)::double"


def told(c):
    return rf"({c} is not null and not regexp_full_match(lower(trim({c})), '\d+(\.\d+)?') and length(lower(trim({c}))) >= 10)"


def coverage(c):
    found = " + ".join("cast(" + " or ".join(f"contains(lower(trim({c})), '{s}')" for s in stems) + " as int)" for _, stems in N.COMPETENCES)
    return f"(case when {told(c)} then round_even(({found}) / 6.0::double * 100, 1) else 0.0 end)::double"


def resume_steps(c):
    h = "(" + " + ".join(f"cast(contains(lower(trim({c})), '{s}') as int)" for s in N.RESUME_STEMS) + ")"
    return f"(case when not {told(c)} or {c} is null or {h} = 0 then 0 when {h} <= 1 then 33 when {h} <= 3 then 67 else 100 end)"


def list_size(c):
    return f"coalesce(len(list_filter(string_split({c}, ','), lambda x: trim(x) <> '')), 0)"


def total(terms):
    return "(0.0::double" + "".join(f" + ({x}) * {w}::double" for w, x in terms) + ")"


def half_even(x, digits):
    """Half-even rounding of the value at nine decimals, in whole numbers."""
    r, p = f"cast(round(({x}) * 1000000000) as bigint)", 10 ** (9 - digits)
    up = f"(case when {r} % {p} * 2 > {p} or ({r} % {p} * 2 = {p} and {r} // {p} % 2 = 1) then 1 else 0 end)"
    return f"(({r} // {p} + {up}) / {10**digits}::double)"
