"""Stages of the corpus pipeline, each one operator of this subpackage.

``docs`` is a Parquet table as it was read: the pipeline writes every stage's rows and reads
them again, so their file and row index are an identity that needs no further copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import drop_copies
from .language_id import keep_identified
from .near_dedup import drop_near_duplicates
from .packing import pack_documents
from .pii import pseudonymise


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is found; a null text, one without letters and noise go."""
    return keep_identified(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, that with the smallest doc_id."""
    return drop_copies(docs, stored=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: five-word shingles, similarity 0.8."""
    return drop_near_duplicates(docs, stored=True)


def privacy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with pseudonyms in their texts; n_chars follows the text."""
    done = pseudonymise(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast("long"))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces in sequences of 2048 ids."""
    return pack_documents(docs)
