"""Uniform shuffle into shards of exact size through a communication matrix.

How many rows go from each source file to each shard is drawn first, from the
multivariate hypergeometric law that a uniform shuffle of all rows follows.  Each
file then permutes its rows locally and deals them out by its row of the matrix;
after the exchange each shard permutes what it received.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage, table

#: numpy's own sampler takes populations below this.
NUMPY_LIMIT = 1_000_000_000
#: A row's random key has 62 bits; its upper 20 choose the cell of the shard.
KEY_BITS, CELL_BITS = 62, 20


def shard_sizes(rows: int, shards: int) -> list[int]:
    """Sizes that differ by one at most, the larger ones first."""
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def draw_hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows taken from ``good + bad`` are good.

    Beyond numpy's limit the law is inverted over a window of twelve standard
    deviations round its mean; what lies outside is below 1e-30.
    """
    total = good + bad
    if drawn <= 0 or good <= 0:
        return 0
    if bad <= 0:
        return min(drawn, good)
    if total < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, drawn))
    mean = drawn * (good / total)
    spread = np.sqrt(mean * (bad / total) * ((total - drawn) / max(total - 1, 1)))
    low = max(0, drawn - bad, int(mean - 12 * spread) - 12)
    high = min(good, drawn, int(mean + 12 * spread) + 12)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) / (k + 1)) + np.log((drawn - k) / (bad - drawn + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    weights = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(counts: Sequence[int], sizes: Sequence[int], seed: int) -> list[list[int]]:
    """Exact counts, a row for each source and a column for each shard.

    Rows add up to ``counts`` and columns to ``sizes``.
    """
    rng = np.random.default_rng([seed, 1])
    left = list(sizes)
    matrix = []
    for count in counts:
        row, rest, room = [], count, sum(left)
        for shard, free in enumerate(left):
            room -= free
            taken = draw_hypergeometric(rng, free, room, rest)
            row.append(taken)
            rest -= taken
            left[shard] -= taken
        matrix.append(row)
    return matrix


def _local_permutation(seed: int):
    """A file's random order and keys, from the file's number, its row count and the row's place."""

    @F.pandas_udf("rank long, key long")
    def local_permutation(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        # A file's rows follow one another, so what was drawn for one serves all its batches.
        drawn, order, keys = -1, np.empty(0, np.int64), np.empty(0, np.int64)
        for number, rows, place in batches:
            rank = np.empty(len(place), dtype=np.int64)
            key = np.empty(len(place), dtype=np.int64)
            numbers, places = number.to_numpy(), place.to_numpy()
            for file in np.unique(numbers):
                here = np.flatnonzero(numbers == file)
                if file != drawn:
                    rng = np.random.default_rng([seed, 2, int(file)])
                    size = int(rows.iloc[here[0]])
                    drawn, order, keys = file, rng.permutation(size), rng.integers(0, 1 << KEY_BITS, size)
                rank[here], key[here] = order[places[here]], keys[places[here]]
            yield pd.DataFrame({"rank": rank, "key": key})

    return local_permutation


def shuffle_shards(docs: DataFrame, shards: int = 40, seed: int = 20, rows_per_cell: int = 2_000, rows_per_file: int = 500_000) -> DataFrame:
    """All rows of ``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in its shard).

    Shard sizes differ by one row at most, and every assignment of rows to slots is as
    likely as any other.  Content plays no part: null or empty columns, equal rows and
    very long texts are dealt like any row; fewer rows than shards leave shards empty;
    an empty table gives an empty result.  Columns of the input named ``shard`` or
    ``slot`` are replaced.

    The rows are staged once, so that file and row index identify a row in every later
    pass.  The driver holds a count for each file and shard.  A shard is cut by leading
    key bits into cells of about ``rows_per_cell`` rows, so few shards don't mean few
    tasks.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    staged = stage(docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")), "shards", rows_per_file)
    source = staged.select("row", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    counts = sorted(source.groupBy("file").count().collect())
    total = sum(r["count"] for r in counts)
    matrix = communication_matrix([r["count"] for r in counts], shard_sizes(total, shards), seed)
    deals = spark.createDataFrame(
        [(r["file"], number, r["count"], np.cumsum(row).tolist()) for number, (r, row) in enumerate(zip(counts, matrix, strict=True))],
        "file string, number int, rows long, upto array<long>",
    )
    # The deals grow with the number of files; beyond 16 MB they meet the rows by a shuffle.
    if len(counts) * shards * 8 <= 16 << 20:
        deals = F.broadcast(deals)
    cells = min(1 << CELL_BITS, max(1, -(-total // (shards * rows_per_cell))))
    dealt = (
        source.join(deals, "file")
        .withColumn("dealt", _local_permutation(seed)("number", "rows", "place"))
        .select(
            "row",
            F.size(F.filter("upto", lambda upto: upto <= F.col("dealt.rank"))).alias("shard"),
            F.shiftright(F.shiftright(F.col("dealt.key"), KEY_BITS - CELL_BITS) * cells, CELL_BITS).alias("cell"),
            F.col("dealt.key").alias("key"),
            "number",
            "place",
        )
    )
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = dealt.groupBy("shard", "cell").agg(F.count("*").alias("n")).select("shard", "cell", F.coalesce(before, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "cell").orderBy("key", "number", "place"))
    return (
        dealt.withColumn("nth", within)
        .join(starts.hint("merge"), ["shard", "cell"])
        .select("row.*", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"))
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` in shards 0 to 39 under the law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    return shuffle_shards(table(spark, sf_dir, "documents")).select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
