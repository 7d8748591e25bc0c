"""Exact deduplication that no group of copies can overload.

Copies meet in three steps: inside each partition, then in salted groups of a digest,
then among the salted groups' winners.  Every step groups by digest and by the whole
text, so rows are merged only when their full content is equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import identified, stage, table
from .graph import join_groups

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _groups(rows: DataFrame, salts: int) -> DataFrame:
    """group (its number), digest, keep_id, group_size and content of each group of ``rows`` (doc_id, digest, content).

    ``content`` is null unless the digest stands for several texts.
    """
    # Spark's partial aggregate is the local step; the salt is the partition, so each adds one row to a group.
    salted = (
        rows.withColumns({"salt": F.spark_partition_id() % salts, "n": F.lit(1)})
        .groupBy("digest", "salt", "content")
        .agg(F.min("doc_id").alias("doc_id"), F.sum("n").alias("n"))
    )
    # Dealt by digest alone, so that counting a digest's texts needs no further exchange.
    texts = F.count("*").over(Window.partitionBy("digest"))
    return stage(
        salted.repartition("digest").groupBy("digest", "content")
        .agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size")).withColumn("texts", texts)
        .select(F.monotonically_increasing_id().alias("group"), "digest", "keep_id", "group_size", F.when(F.col("texts") > 1, F.col("content")).alias("content")),
        "copies",
    )


def _joined(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with their groups: by digest, which moves no text, or by text where a digest stands for several.

    Rows of digests with many copies stay where they are (see ``graph.join_groups``).
    """
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    plain = groups.where("content is null").drop("content").withColumn("n", F.col("group_size"))
    found = join_groups(rows.drop("content"), plain, "digest", total).drop("n")
    shared = groups.where("content is not null")
    if not shared.isEmpty():
        found = found.unionByName(rows.join(shared, ["digest", "content"]).drop("content"))
    return found


def copy_groups(docs: DataFrame, salts: int = 16, digest=sha256) -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept, text_digest.

    Texts are equal when ``normalised`` makes them identical; null counts as empty.  The
    smallest doc_id of a group is its keep_id and the rows that bear it are kept (so rows
    that repeat a doc_id and its text are kept together).  A null doc_id comes after all
    others: such a row is kept only if its whole group has none.  An empty table gives an
    empty result; other columns are ignored.

    ``digest`` may collide: rows of a digest that stands for several texts are matched by
    the text itself.
    """
    rows = docs.select("doc_id", normalised("text").alias("content")).withColumn("digest", digest(F.col("content")))
    found = _joined(rows, _groups(rows, salts))
    return found.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_digest"),
    )


def drop_copies(docs: DataFrame, salts: int = 16, digest=sha256, stored: bool = False) -> DataFrame:
    """One row of each group of equal texts, with all its columns: that with the smallest doc_id.

    Of rows that repeat a doc_id one stays as well, the first by file and place; a null
    doc_id comes after all others.  ``stored``: ``docs`` is a Parquet table as it was read.
    """
    rows = identified(docs, stored)
    texts = rows.select("row.doc_id", "file", "place", normalised(F.col("row.text")).alias("content")).withColumn("digest", digest(F.col("content")))
    found = _joined(texts, _groups(texts, salts)).where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    first = found.groupBy("group").agg(F.min(F.struct("file", "place")).alias("first")).select("first.*")
    return rows.join(first, ["file", "place"], "left_semi").select("row.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(table(spark, sf_dir, "documents")).withColumnRenamed("text_digest", "text_sha256")


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY text_sha256
)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, n.text_sha256
FROM n JOIN g USING (text_sha256)
"""
