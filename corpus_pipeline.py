"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and gives a table that is written as Parquet and read again as
the next stage's ``docs``. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import jaccard, language, packing, quality
from tidegauge.llm.common import small_batches, table
from tidegauge.session import cut

#: A text is rejected as of no known language where less than this share of its n-grams is known.
LEAST_COVERAGE = 0.2
#: Documents with a smaller probability of good quality are rejected.
LEAST_QUALITY = 0.5


def _carried(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns in one, so that no name clashes, beside those the operators read."""
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__row")
    return docs.select(rest, "text", F.col("lang").alias("_lang"), F.col("source").alias("_source"))


def _restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col(f"__row.`{c}`") for c in columns])


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; repeated and mixed ones stay."""
    small_batches(spark)
    model = language.fit(docs)
    found = language.predict(_carried(docs), model, keep_text=True)
    right = (F.col("lang_pred") != language.UNDETERMINED) & (F.col("coverage") >= LEAST_COVERAGE)
    return _restored(found.where(right), docs.columns)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(_carried(docs), model, lang="_lang", source="_source", keep_text=True)
    return _restored(scored.where(F.col("score") >= LEAST_QUALITY), docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    small_batches(spark)
    return jaccard.first_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens, one row per piece of a document."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("quality", good_quality),
    ("near_copies", without_near_copies),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Classifiers and tokenizers cannot be said in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None
