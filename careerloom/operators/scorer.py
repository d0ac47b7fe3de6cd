"""Text scorers behind one interface. The default is deterministic and needs no network."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.norm import substance
from .docparse import loose_json

#: A scorer takes texts and gives scores from 0 to 1, None where it has none.
Scorer = Callable[[list[str]], list[float | None]]


def by_length(texts: list[str]) -> list[float | None]:
    """The default: how much a text says, by its length."""
    return [0.0 if not (n := len(t.strip())) else 0.3 if n < 10 else 0.6 if n <= 100 else 1.0 for t in texts]


def score_texts(df: DataFrame, text: str, scorer: Scorer | None = None, out: str = "score", default: float = 0.0, tries: int = 3, wait: float = 2.0, batch: int = 64) -> DataFrame:
    """Adds scores: without a scorer, those of the text's length, as an expression.

    For a scorer, equal texts are scored once; a batch that fails is tried again, with doubled waits, then gets the default.

    Only texts not in ``df`` twice reach the scorer, and blank ones never do.
    """
    if scorer is None:
        return df.withColumn(out, substance(F.col(text)))
    key = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    once = df.select(key.alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text")).dropDuplicates(["_key"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            scores: list[float] = []
            for k in range(0, len(frame), batch):
                part = frame["_text"].tolist()[k : k + batch]
                said = [i for i, t in enumerate(part) if t.strip()]
                got: list[float | None] = [0.0] * len(part)
                for attempt in range(tries):
                    try:
                        for i, s in zip(said, scorer([part[i] for i in said]), strict=True):
                            got[i] = s
                        break
                    except Exception:
                        if attempt == tries - 1:
                            for i in said:
                                got[i] = None
                        else:
                            time.sleep(wait * 2**attempt)
                scores += [default if s is None else min(1.0, max(0.0, float(s))) for s in got]
            yield pd.DataFrame({"_key": frame["_key"], out: scores})

    scored = once.mapInPandas(run, T.StructType([T.StructField("_key", T.StringType()), T.StructField(out, T.DoubleType())]))
    return df.withColumn("_key", key).join(scored, "_key").drop("_key")


def uncached(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Requests whose key has no cached answer."""
    return requests.join(cache.select(key).distinct(), key, "left_anti")


class Prompts:
    """Prompt templates by name, each with the fields of its JSON answer, their bounds and what stands in for missing ones."""

    def __init__(self) -> None:
        self.templates: dict[str, str] = {}
        self.fields: dict[str, dict[str, tuple[float, float, float | None]]] = {}

    def add(self, name: str, template: str, fields: dict[str, tuple[float, float, float | None]]) -> None:
        """``fields``: name to (least, most, default)."""
        if name in self.templates:
            raise ValueError(f"there is a prompt {name} already")
        self.templates[name], self.fields[name] = template, fields

    def text(self, name: str, **parts: Column) -> Column:
        """The prompt of each row: ``{part}`` gives way to a column, null to nothing."""
        out = F.lit(self.templates[name])
        for part, c in parts.items():
            out = F.replace(out, F.lit("{" + part + "}"), F.coalesce(c.cast("string"), F.lit("")))
        return out

    def answer(self, name: str, c: Column) -> Column:
        """An answer's fields, clamped; the defaults where it is no JSON or lacks a field."""
        fields = self.fields[name]
        found = loose_json(c, ", ".join(f"`{f}` double" for f in fields))
        return F.struct(*[F.when(found[f].isNotNull(), F.least(F.lit(float(most)), F.greatest(F.lit(float(least)), found[f]))).otherwise(F.lit(default).cast("double")).alias(f) for f, (least, most, default) in fields.items()])


#: A reasoner takes a pillar's row and the notes written before for the same person, and gives a note or None.
Reasoner = Callable[[dict, list[str]], str | None]


def reasoned(df: DataFrame, key: str, pillar: str, order: list[str], reasoner: Reasoner | None = None, source: str = "source") -> DataFrame:
    """Adds ``reasoning``: by default where the score comes from.

    A reasoner sees a person's pillars in order, each with the notes of those before, so that evidence is not cited
    twice. A person has a row for each pillar; pillars that ``order`` lacks come last, by name.
    """
    fallback = F.concat(F.lit("Score derived from "), F.coalesce(source, F.lit("survey+docs")), F.lit("."))
    out = df.withColumn("reasoning", fallback)
    if reasoner is None:
        return out

    def person(rows: pd.DataFrame) -> pd.DataFrame:
        place = {p: k for k, p in enumerate(order)}
        rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (place.get(rows[pillar].iloc[i], len(place)), str(rows[pillar].iloc[i])))].copy()
        notes: list[str] = []
        said = []
        for row in rows.to_dict("records"):
            note = reasoner(row, list(notes)) or row["reasoning"]
            notes.append(note)
            said.append(note)
        return rows.assign(reasoning=said)

    return out.groupBy(key).applyInPandas(person, out.schema)
