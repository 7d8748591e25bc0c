"""From documents to packed training sequences: language, copies, near copies, privacy, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plenarium.llm.common import discard, scope, stage, table
from plenarium.llm.pipeline import exact_stage, language_stage, near_stage, packing_stage, privacy_stage

STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("pii", privacy_stage),
    ("packing", packing_stage),
]

#: Trained predictions, keyed permutations and packing have no SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again for the next.

    What a stage leaves in the shared folder goes when its rows are written, and those rows
    go when the next stage's are.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES[:-1]):
        with scope():
            before, docs = docs, stage(step(spark, docs, sf_dir), f"pipeline-{name}", outer=True)
        if k:
            discard(before)
    before, docs = docs, STAGES[-1][1](spark, docs, sf_dir)
    discard(before)
    return docs
