"""The corpus pipeline: documents in, encoded documents out.

Stages, each over all rows its predecessor kept:

1. language: documents without a language go (`webtrail.llm.language`).
2. near_duplicates: of documents whose word 5-gram sets link at a Jaccard similarity of 0.8 or
   more, the one with the smallest id stays (`webtrail.llm.ngram_join`).
3. decontamination: documents that hold a benchmark passage go (`webtrail.llm.decontamination`).
4. personal_data: spans of personal data are replaced by their kind (`webtrail.llm.pii`).
5. pieces: texts are segmented into SentencePiece ids, reproducibly (`webtrail.llm.pieces`).

Every stage but the last returns the columns of documents; the last adds the ids. A row with a
null doc_id passes the second stage as a document of its own. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webtrail.llm import decontamination, language, ngram_join, pieces, pii
from webtrail.llm.common import stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is undetermined."""
    return language.identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in texts; n_chars follows the text."""
    done = pii.redact(docs)
    return done.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in done.columns else done


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids with the SentencePiece ids of their texts."""
    return pieces.encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("personal_data", without_personal_data),
    ("pieces", encoded),
]

#: Sampled segmentations and a fitted language model are beyond SQL; the tests compare the
#: stages with plain readings of their rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
