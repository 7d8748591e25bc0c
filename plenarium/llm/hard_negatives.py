"""Hard negatives of anchors, found by integer products over bit planes.

Vectors become integers in two's complement and are kept as bit planes, the most significant
first.  A product of an anchor with the planes read so far leaves an interval for its score,
as each plane still to come adds between nothing and one weight for every component; the
interval halves with each plane.  A candidate goes as soon as its interval cannot hold a
score that is asked for, or as enough others are sure to score more; after the last plane
the scores of those left are exact.

Two searches use this: an anchor's best rows of its own label, and below each of them the
best rows of other labels within a share of its score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stage, table
from .topk import blocks_of
from .vectors import matrix, usable

#: Squared norms have to stay below this, so that a hundred scores are a long and sums of planes exact doubles.
LARGEST = 2.0**54
#: Labels meet within so many cells.
CELLS = 64
#: Anchors whose intervals are held at once in a task.
TOGETHER = 64
#: Pairs are taken one by one where no more than one in so many is left.
SPARSE = 8
LOWEST, HIGHEST = -(2**62), 2**62


def slice_bits(x: np.ndarray, bits: int) -> np.ndarray:
    """rows x bits x bytes: two's complement planes of integers, the sign's first."""
    planes = np.stack([(x >> b) & 1 for b in range(bits - 1, -1, -1)], axis=1).astype(np.uint8)
    return np.packbits(planes, axis=2)


def weights(bits: int) -> np.ndarray:
    """What a set bit of each plane is worth."""
    return np.array([-(1 << (bits - 1)), *[1 << b for b in range(bits - 2, -1, -1)]], dtype=np.int64)


def _planes(column: pa.ChunkedArray, bits: int, dims: int) -> np.ndarray:
    """rows x bits x dims of zeros and ones."""
    raw = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8)
    return np.unpackbits(raw.reshape(len(column), bits, -1), axis=2)[:, :, :dims]


def _joined(planes: np.ndarray) -> np.ndarray:
    return np.einsum("nbd,b->nd", planes.astype(np.int64), weights(planes.shape[1]))


def _floors(search: np.ndarray, low: np.ndarray, searches: int, k: int) -> np.ndarray:
    """For each search the ``k``-th largest of its sure scores' lower ends."""
    order = np.lexsort((-low, search))
    starts = np.searchsorted(search[order], np.arange(searches))
    ends = np.searchsorted(search[order], np.arange(searches), side="right")
    out = np.full(searches, LOWEST)
    full = ends - starts >= k
    out[full] = low[order][starts[full] + k - 1]
    return out


def sliced_best(anchors: np.ndarray, who: np.ndarray, least: np.ndarray, most: np.ndarray, planes: np.ndarray, ids: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """search, candidate and score of each search's ``k`` best, and how many pairs each plane was read for.

    Search ``s`` belongs to the anchor ``who[s]`` (ascending) and takes scores from
    ``least[s]`` to ``most[s]``, higher ones first, then smaller ids.  ``allowed`` (anchors x
    candidates) says which pairs take part.
    """
    bits, worth, read = planes.shape[1], weights(planes.shape[1]), []
    above, below = np.maximum(anchors, 0).sum(1), np.minimum(anchors, 0).sum(1)
    # Products with a plane stay within the sum of the components.
    kind = np.float32 if len(anchors) and (above - below).max() < 2**24 else np.float64
    left = anchors.astype(kind)
    one = np.array_equal(who, np.arange(len(anchors)))
    hull_low, hull_high = np.full(len(anchors), HIGHEST), np.full(len(anchors), LOWEST)
    np.minimum.at(hull_low, who, least)
    np.maximum.at(hull_high, who, most)
    alive, partial, b = allowed & (hull_low <= hull_high)[:, None], np.zeros(allowed.shape, np.int64), 0
    while b < bits and alive.sum() * SPARSE > alive.size:
        read.append(int(alive.sum()))
        partial += worth[b] * np.rint(left @ planes[:, b].astype(kind).T).astype(np.int64)
        rest = (1 << (bits - 1 - b)) - 1
        low, high = partial + (rest * below)[:, None], partial + (rest * above)[:, None]
        alive &= (high >= hull_low[:, None]) & (low <= hull_high[:, None])
        if one and alive.shape[1] > k:
            sure = np.where(alive & (low >= least[:, None]) & (high <= most[:, None]), low, LOWEST)
            alive &= high >= np.partition(sure, -k, axis=1)[:, -k, None]
        b += 1
    # From here on by pairs, and by the searches of each pair's anchor.
    a, c = np.nonzero(alive)
    value = partial[a, c]
    first, last = np.searchsorted(who, a), np.searchsorted(who, a, side="right")
    pair = np.repeat(np.arange(len(a)), last - first)
    search = np.arange(len(pair)) - np.repeat(np.cumsum(last - first) - (last - first), last - first) + first[pair]
    while True:
        if b:
            # The sign's plane takes away, so there is no interval before it.
            rest = (1 << (bits - b)) - 1
            low, high = value + rest * below[a], value + rest * above[a]
            keep = (high[pair] >= least[search]) & (low[pair] <= most[search])
            pair, search = pair[keep], search[keep]
        if b == bits:
            break
        if b:
            sure = (low[pair] >= least[search]) & (high[pair] <= most[search])
            keep = high[pair] >= _floors(search[sure], low[pair[sure]], len(who), k)[search]
            pair, search = pair[keep], search[keep]
        needed, pair = np.unique(pair, return_inverse=True)
        a, c, value = a[needed], c[needed], value[needed]
        read.append(len(a))
        value = value + worth[b] * np.rint(np.einsum("pd,pd->p", left[a].astype(np.float64), planes[c, b])).astype(np.int64)
        b += 1
    score, found = value[pair], ids[c[pair]]
    order = np.lexsort((found, -score, search))
    search, score, found = search[order], score[order], found[order]
    best = np.arange(len(search)) - np.searchsorted(search, search) < k
    return search[best], found[best], score[best], read


def _grid(rows: DataFrame, cell: Column, most: int) -> tuple[dict, Column]:
    """Blocks of the cells (at most CELLS of them), and a row's own block."""
    sizes = {r["cell"]: r["count"] for r in rows.groupBy(cell.alias("cell")).count().orderBy("cell").collect()}
    places = blocks_of(sizes, most) or {0: (0, 1)}
    return places, _of(places, cell, 0) + F.pmod(F.xxhash64("vec_id"), _of(places, cell, 1))


def _of(places: dict, cell: Column, i: int) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for c, place in places.items() for x in (c, place[i])]), cell).cast("long")


def _meet(anchors: DataFrame, rows: DataFrame, cell: Column, query_block: int, candidate_block: int, search, schema: str) -> DataFrame:
    """``search`` over every pair of a block of anchors and a block of rows whose cells meet, each in a task of its own."""
    _, asked = _grid(anchors, cell, query_block)
    places, held = _grid(rows, cell, candidate_block)
    start = _of(places, cell, 0)
    left = anchors.withColumn("qb", asked).withColumn("cb", F.explode(F.sequence(start, start + _of(places, cell, 1) - 1)))
    left = left.select(*[F.col(c).alias(c) for c in left.columns])
    # As many rows as there are pairs of blocks that meet.
    met = left.select(*[F.col(c).alias(c) for c in ("qb", "cb")]).distinct()
    right = rows.withColumn("cb", held).join(met, "cb")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    key = ["qb", "cb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, schema)


def hard_negatives(
    embeddings: DataFrame, is_anchor: Column, label: Column | None = None, vector: str = "embedding", positives: int = 5, negatives: int = 5,
    least: int = 80, scale: int = 256, query_block: int = 4096, candidate_block: int = 8192,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    A row's score is its integer inner product with the anchor, of floor(scale * x) of each
    component, x as double.  An anchor's positives are its ``positives`` best other rows of
    the same ``label``; for each, the ``negatives`` best rows of other labels are returned
    whose score is at most the positive's and at least ``least`` hundredths of it (below zero
    there are none).  Ties go to the smaller vec_id; where there are fewer, all are returned.

    A row takes no part, as anchor or otherwise, if its vec_id, label or vector is null, if a
    component is null or not finite, or if its integers' squared norm is LARGEST or more.  Of
    rows that repeat a vec_id the least (vector, then label) counts.  Shorter vectors count
    as padded with zeros; an empty table gives an empty result; other columns are ignored.

    Rows travel as bit planes, once for each block of ``query_block`` anchors.  Rows of one
    label meet only anchors of its cell, cut into blocks like all others, however many rows
    the label has; from each pair of blocks only each search's best leave.
    """
    spark = embeddings.sparkSession
    rows = embeddings.withColumn("_label", F.col("label") if label is None else label).where(usable(vector, scale, LARGEST))
    rows = rows.where("vec_id is not null and _label is not null").select("vec_id", F.col("_label").alias("label"), F.col(f"`{vector}`").alias("vector"))
    extent = F.greatest(F.abs(F.array_max("vector").cast("double")), F.abs(F.array_min("vector").cast("double")))
    dims, reach = rows.agg(F.max(F.size("vector")), F.max(extent)).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not dims:
        return spark.createDataFrame([], out)
    # Floors of numbers up to ``reach`` in magnitude, and a bit for the sign.
    bits = (int(np.floor(reach * scale)) + 1).bit_length() + 1

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = slice_bits(np.floor(scale * matrix(batch.column("vector"), dims)).astype(np.int64), bits)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([p.tobytes() for p in planes], pa.binary())], names=["vec_id", "label", "planes"])

    single = rows.groupBy("vec_id").agg(F.min(F.struct("vector", "label")).alias("one")).select("vec_id", "one.label", "one.vector")
    kind = rows.schema["label"].dataType.simpleString()
    held = stage(single.mapInArrow(sliced, f"vec_id long, label {kind}, planes binary").withColumn("cell", F.pmod(F.xxhash64("label"), F.lit(CELLS)).cast("int")), "sliced")
    anchors = held.where(is_anchor)

    def searched(same: bool):
        def search(q: pa.Table, c: pa.Table) -> pa.Table:
            parts = []
            if len(q) and len(c):
                planes, ids, labels = _planes(c.column("planes"), bits, dims), c.column("vec_id").to_numpy(), c.column("label").to_pandas().to_numpy()
                for at in range(0, len(q), TOGETHER):
                    some = q.slice(at, TOGETHER)
                    own, mine = some.column("vec_id").to_numpy(), some.column("label").to_pandas().to_numpy()
                    alike = mine[:, None] == labels[None, :]
                    if same:
                        who, good = np.arange(len(some)), np.zeros((2, len(some)), np.int64)
                        low, high = np.full(len(some), LOWEST), np.full(len(some), HIGHEST)
                        allowed = alike & (own[:, None] != ids[None, :])
                    else:
                        lists = some.column("positives").combine_chunks()
                        who = np.repeat(np.arange(len(some)), np.diff(lists.offsets.to_numpy()))
                        good = np.stack([lists.flatten().field(f).to_numpy() for f in ("vec_id", "score")])
                        low, high, allowed = -(-least * good[1] // 100), good[1], ~alike
                    s, found, score, _ = sliced_best(_joined(_planes(some.column("planes"), bits, dims)), who, low, high, planes, ids, allowed, positives if same else negatives)
                    parts.append(np.stack([own[who[s]], good[0][s], found, good[1][s], score]))
            all_ = np.concatenate(parts, axis=1) if parts else np.zeros((5, 0), np.int64)
            return pa.table(list(all_), names=["anchor_id", "positive_id", "vec_id", "positive_score", "score"])

        return search

    found = "anchor_id long, positive_id long, vec_id long, positive_score long, score long"
    ranked = lambda df, key, k: df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    near = ranked(_meet(anchors, held, F.col("cell"), query_block, candidate_block, searched(True), found), ["anchor_id"], positives)
    # At most ``positives`` for an anchor.
    wanted = near.where("score >= 0").groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))
    asking = stage(anchors.join(wanted, "vec_id"), "asking")
    pairs = _meet(asking, held, F.lit(0), query_block, candidate_block, searched(False), found)
    best = ranked(pairs, ["anchor_id", "positive_id"], negatives)
    answer = stage(best.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    discard(held, asking)
    return answer


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, changed)


OP12_SQL = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.vector, c.vector) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 5
"""
