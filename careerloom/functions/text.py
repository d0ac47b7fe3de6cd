"""Text expressions: normalisers, tokens, n-grams, chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no occupation signal.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall "
    "to of in for on with at by from as into through during before after above below between and or not that this "
    "these those it its they them their he she his her who whom which what when where how all each every both few "
    "more most other some such no only own same so than too very just also if then else about up out over under "
    "again further once here there activities may work use using equipment information develop prepare provide "
    "materials determine ensure evaluate maintain programs procedures perform reports conduct research control plan "
    "test monitor direct review plans tools required including related knowledge principles techniques methods needs "
    "appropriate necessary standards results processes services records record supervise inspect specifications "
    "clean coordinate identify quality customer"
).split()


def skill_key(c: Column) -> Column:
    """Market form of a skill: lower case without blanks, hyphens, slashes and commas."""
    return F.regexp_replace(F.lower(c), "[- ,/]", "")


def vocabulary_key(c: Column) -> Column:
    """Vocabulary form of a skill: case kept, without blanks and hyphens."""
    return F.regexp_replace(c, "[- ]", "")


def letters_only(c: Column, keep_hyphen: bool = False) -> Column:
    """Lower case; what is no a-z (or hyphen) becomes one blank; trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z\\s-]" if keep_hyphen else "[^a-z\\s]", " "), "\\s+", " "))


def person_name(c: Column) -> Column:
    """Comparable form of a person's name: no-break blanks and broken-encoding marks gone, lower case, single blanks."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, " Â", " ")), "\\s+", " "))


def slug(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def email(c: Column) -> Column:
    return F.lower(F.trim(c))


def words(c: Column, min_stop: bool = True) -> Column:
    """Words of two or more letters a-z, in order; stop words left out on request.

    A word with other letters or digits is no word, as under Unicode word borders.
    """
    out = F.filter(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: w.rlike("^[a-z][a-z]+$"))
    return F.filter(out, lambda w: ~w.isin(STOP_WORDS)) if min_stop else out


def ngrams(tokens: Column, longest: int = 3) -> Column:
    """(position, length, text) of the 1- to ``longest``-grams of a word array, by position."""
    return F.flatten(
        F.transform(
            tokens,
            lambda _, i: F.filter(
                F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.struct(i.alias("pos"), n.alias("n"), F.array_join(F.slice(tokens, i + 1, n), " ").alias("gram"))),
                lambda g: g["pos"] + g["n"] <= F.size(tokens),
            ),
        )
    )


def split_list(c: Column) -> Column:
    """Parts of a hand-written list: semicolons, ampersands and "and" count as commas."""
    return F.filter(F.transform(F.split(F.regexp_replace(c, "(;|&| and | And )", ","), ","), lambda x: F.trim(x)), lambda x: x != "")


def chunks(c: Column, width: int = 500) -> Column:
    """(number, text) of the chunks of ``width`` characters."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.char_length(c) / width).cast("int") - 1, F.lit(0))), lambda i: F.struct(i.alias("chunk"), F.substring(c, i * width + 1, F.lit(width)).alias("part")))


def safe_filename(c: Column) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.trim(c), r"[^\w\s-]", ""), "\\s+", "_"), 1, 60)


def truncated(c: Column, n: int) -> Column:
    """The first ``n`` characters, with an ellipsis where there were more; null counts as empty."""
    s = F.coalesce(c, F.lit(""))
    return F.when(F.char_length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def initials(c: Column) -> Column:
    return F.substring(F.array_join(F.transform(F.filter(F.split(c, "\\s+"), lambda w: w != ""), lambda w: F.upper(F.substring(w, 1, 1))), ""), 1, 2)


def containment(a: Column, b: Column) -> Column:
    """Share of the distinct words of ``a`` that are in ``b``; 0 without words."""
    n = F.size(F.array_distinct(a))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


# Answers in place of a name.
NO_NAMES = ("i forgot", "forgot", "don't remember", "not sure", "n/a", "na", "none", "idk", "unknown")


def valid_name(c: Column) -> Column:
    """Whether an answer can be a name: four characters at least, and none of the stock answers."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return (F.char_length(t) >= 4) & ~F.lower(t).isin(*NO_NAMES)


def holds_word(c: Column, words: list[str], negate: bool = False) -> Column:
    """Whether a text holds one of the words in any case; null counts as a text without them."""
    hit = F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))
    return ~hit if negate else hit


# Capitalised words that are no names.
NOT_NAMES = ("The", "This", "His", "Her", "Their", "AI", "An", "In", "For", "By", "And", "Of", "To", "A", "On", "Is", "With", "From", "That", "It")


def shared_names(a: Column, b: Column) -> Column:
    """What two texts both name: capitalised words of three characters or more, and other shared words of five or more, sorted, with commas between."""
    names = lambda t: F.regexp_extract_all(t, F.lit(r"\b[A-Z][A-Za-z0-9_-]{2,}\b"), 0)
    words = lambda t: F.filter(F.split(F.lower(t), r"\s+"), lambda w: F.char_length(w) > 4)
    capital = F.array_except(F.array_intersect(names(a), names(b)), F.array(*[F.lit(w) for w in NOT_NAMES]))
    lower = F.transform(F.array_intersect(words(a), words(b)), lambda w: F.btrim(w, F.lit(".,;:\"'")))
    return F.array_join(F.array_sort(F.array_union(capital, lower)), ", ")


def flag_labels(columns: list[str], sep: str = ", ") -> Column:
    """The labels in brackets in the names of the columns that are set: ``Languages [French]`` gives ``French``."""
    label = lambda c: c[c.rindex("[") + 1 : c.rindex("]")] if "[" in c else c
    return F.array_join(F.filter(F.array(*[F.when(F.col(f"`{c}`"), F.lit(label(c))) for c in columns]), lambda x: x.isNotNull()), sep)
