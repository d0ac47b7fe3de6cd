"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import analysis_queries, corpus_queries, link_queries, score_queries, text_queries  # noqa: F401  (their queries register themselves)
from .plans.registry import QUERIES, SQL
from .session import ship


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best postings of each candidate by tf-idf."""
    return QUERIES["topk_postings_tfidf"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
