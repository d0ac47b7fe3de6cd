"""A training-data pipeline of corpus operators over the table of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careerloom.llm import language_id, quality
from careerloom.llm.common import dropped, held_out, table, written
from careerloom.llm.ngram_join import keep_one
from careerloom.llm.packing import best_fit_packing
from careerloom.llm.suffix_dedup import suffix_dedup
from careerloom.session import ship


#: Bytes of a repeated passage: fewer than fifty words have in the languages at hand, more than a line of boilerplate.
PASSAGE = 250


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labels, does not reject."""
    ship(spark)
    weights = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").where(~held_out()))
    return quality.keep_quality(docs, weights, threshold=0.7)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the models, trained on the table of documents, know."""
    ship(spark)
    models = language_id.fit(table(spark, sf_dir, "documents").where(~held_out()))
    return language_id.keep_known(docs, models)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, likeness 0.8."""
    ship(spark)
    return keep_one(docs, width=5, percent=80)


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of ``PASSAGE`` bytes that stand at two places."""
    ship(spark)
    cut = suffix_dedup(docs, length=PASSAGE, anchor=PASSAGE * 2 // 5, keep=True)
    return cut.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in cut.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 4096 tokens."""
    ship(spark)
    return best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_copies", near_copy_stage),
    ("repeats", repeat_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifiers nor the tokenizer; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's result is written and read again, and deleted once the next one is there."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(docs)
        docs = after
    packed = STAGES[-1][1](spark, docs, sf_dir)
    dropped(docs)  # the pieces are a table of their own
    return packed
