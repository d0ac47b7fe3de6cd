"""A text encoder that the engine fits itself: truncated singular value decomposition of tf-idf, and the embedding signal of functions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import docparse, match
from .linear import sparse, term_vectors
from .ml import grams
from .sums import entries, summed

#: Entries of sparse rows that are spread over all directions at once.
SPREAD = 1 << 15


def _through(at: list | pa.Array, x: list | pa.Array, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times the basis."""
    places, values, row = entries(at, x)
    sizes = np.bincount(row, minlength=len(at))
    ends = np.cumsum(sizes)
    out, k = np.zeros((len(at), basis.shape[1])), 0
    while k < len(at):
        # rows of about SPREAD entries
        first = int(ends[k] - sizes[k])
        stop = max(k + 1, int(np.searchsorted(ends, first + SPREAD, "right")))
        full = np.flatnonzero(sizes[k:stop]) + k
        if len(full):
            some = slice(first, int(ends[stop - 1]))
            out[full] = np.add.reduceat(values[some, None] * basis[places[some]], ends[full] - sizes[full] - first)
        k = stop
    return out


def decomposed(rows: DataFrame, width: int, size: int, extra: int = 8, passes: int = 12, close: float = 1e-7, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``size`` largest singular values of the matrix of ``rows(at, x)``, and their right directions as columns.

    A subspace of ``size + extra`` random directions is sent through the matrix and its transpose, one pass over the rows a time, until the values move by
    less than ``close`` of the largest, or ``passes`` are over. Values and directions past the matrix's rank are zero.
    """
    many = min(width, size + extra)
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, many)))
    before = np.zeros(many)

    def part(batch: pa.RecordBatch, basis: np.ndarray) -> np.ndarray:
        at, x = batch.column(0), batch.column(1)
        image = _through(at, x, basis)
        places, values, row = entries(at, x)
        return np.stack([np.bincount(places, values * image[row, k], width) for k in range(many)]).ravel()

    for _ in range(passes):
        image = summed(rows.select("at", "x"), many * width, lambda batch, basis=basis: part(batch, basis)).reshape(many, width).T
        squares, turn = np.linalg.eigh(basis.T @ image)
        values = np.sqrt(np.maximum(squares[::-1], 0))
        found = basis @ turn[:, ::-1]
        if abs(values - before)[:size].max(initial=0) <= close * max(values[0], 1e-300):
            break
        before = values
        basis, _ = np.linalg.qr(image)
    real = values > 1e-9 * max(values[0], 1e-300)
    return np.where(real, values, 0)[:size], np.where(real, found, 0)[:, :size]


@dataclass
class Encoder:
    """A vectoriser of words, and the directions that its vectors are turned to."""

    terms: PipelineModel
    values: np.ndarray
    basis: np.ndarray

    def encode(self, df: DataFrame, text: str, out: str = "vector") -> DataFrame:
        """Adds the text's vector of length one; zeros for null texts and those without known words."""
        basis = self.basis

        @F.pandas_udf("array<double>")
        def turned(at: pd.Series, x: pd.Series) -> pd.Series:
            v = _through(at.tolist(), x.tolist(), basis)
            size = np.linalg.norm(v, axis=1, keepdims=True)
            return pd.Series(list(v / np.where(size > 0, size, 1)))

        rows = grams(df.select(F.struct(*df.columns).alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text", 1)
        return self.terms.transform(rows).select("_row.*", turned(*sparse()).alias(out))


def fit(texts: DataFrame, text: str, terms: int = 5_000, size: int = 64, least_df: int = 2, passes: int = 12) -> Encoder:
    """An encoder of the ``terms`` most frequent words in ``size`` directions. All texts count; null ones have no words."""
    rows = grams(texts.select(F.coalesce(F.col(text), F.lit("")).alias("_text")), "_text", 1)
    model = term_vectors(rows, terms, least_df)
    vectors = model.transform(rows).select(*sparse()).persist()
    try:
        return Encoder(model, *decomposed(vectors, len(model.stages[0].vocabulary), size, passes=passes))
    finally:
        vectors.unpersist()


def document_vectors(docs: DataFrame, encoder: Encoder, width: int = 500, title_weight: float = 2.0) -> DataFrame:
    """``doc, v``: the mean of the vectors of a text's chunks, and of its job title if it names one, which counts twice. ``docs(doc, text)``."""
    parts = docs.select("doc", F.explode(T.chunks(F.col("text"), width)).alias("c")).select("doc", F.col("c.part").alias("part"), F.lit(1.0).alias("weight"))
    titles = docs.select("doc", docparse.job_title(F.col("text")).alias("part"), F.lit(title_weight).alias("weight")).where(F.char_length("part") > 5)
    encoded = encoder.encode(parts.union(titles), "part", "v")
    return encoded.groupBy("doc").agg(vector_to_array(Summarizer.mean(array_to_vector("v"), F.col("weight"))).alias("v"))


def embedding_signal(docs: DataFrame, occupations: DataFrame, functions: DataFrame, encoder: Encoder) -> DataFrame:
    """``doc, func, p``: shares of functions by the best occupation's likeness to the text. ``docs(doc, text)``, ``occupations(occ, text)``, ``functions(occ, func)``.

    Up to ``match.QUERIES`` occupations, by a count, are one matrix, and a document's scores never are rows; more are joined in blocks.
    """
    known = encoder.encode(occupations.select(F.col("occ").alias("doc"), "text"), "text", "q").select("doc", "q")
    vectors = document_vectors(docs, encoder)
    if occupations.count() > match.QUERIES:
        scores = match.similar(known, vectors.withColumnRenamed("doc", "occ"))
        return match.roll_up(scores.select(F.col("occ").alias("doc"), F.col("doc").alias("occ"), "score"), functions, "max")
    rows = known.withColumnRenamed("doc", "occ").join(functions.where("func <> 'unmapped'"), "occ").select("func", "q").collect()
    names = sorted({r["func"] for r in rows})
    of = np.array([names.index(r["func"]) for r in rows], np.int64)
    order = np.argsort(of, kind="stable")
    table, starts = np.array([r["q"] for r in rows])[order], np.flatnonzero(np.diff(of[order], prepend=-1))

    @F.pandas_udf("array<double>")
    def shares(v: pd.Series) -> pd.Series:
        best = np.maximum(np.maximum.reduceat(np.stack(v.tolist()) @ table.T, starts, axis=1), 0)
        total = best.sum(1, keepdims=True)
        return pd.Series(list(best / np.where(total > 0, total, 1)))

    if not names:
        return vectors.select("doc", F.lit(None).cast("string").alias("func"), F.lit(0.0).alias("p")).limit(0)
    told = F.posexplode(shares("v")).alias("at", "p")
    return vectors.select("doc", told).select("doc", F.element_at(F.array(*[F.lit(n) for n in names]), F.col("at") + 1).alias("func"), "p")
