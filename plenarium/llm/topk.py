"""Exact top-k by inner product, with a pivot table.

Vectors are lifted to one common norm, so that a larger inner product is a smaller
distance.  Distances of every vector to the pivots are computed once; the largest
difference between a query's and a candidate's distance to a pivot bounds the distance
between them from below.  Bounds are taken for whole cells and groups of neighbouring
candidates: cells that cannot hold a result are ruled out before anything is sent, groups
are evaluated in the order of their bounds until it rules out the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stage, table

PIVOTS = 48
#: Rows that reach the driver; pivots are chosen among them, and they give each query a first floor.
SAMPLE = 2048
#: Candidates that are bounded and evaluated together.
GROUP = 64
#: Inner products below this are exact in double precision.
EXACT = 2**52
#: Squared norms have to stay below this, so that every score is a long.
LARGEST = 2.0**62
#: Below every score; its negative is a long too.
NOTHING = -(2**63) + 1


def integer_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and floor(scale * x) of each component; see ``top_k`` for what takes part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.when(usable, F.transform(x, lambda c: F.floor(c * scale)))
    rows = embeddings.where("vec_id is not null").select("vec_id", scaled.alias("vector")).where("vector is not null")
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _padded(vectors: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for row, v in zip(out, vectors, strict=True):
        row[: len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products of all rows; ``exact``: doubles can hold them."""
    if exact:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    # Sums may wrap on the way; below LARGEST the result itself is a long.
    return a @ b.T


def _squares(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(1)


def _distances(x: np.ndarray, pivots: np.ndarray, top: float, exact: bool, lifted: bool = True) -> np.ndarray:
    """Distances to pivots, which are lifted to the squared norm ``top``; candidates are too, queries aren't."""
    square, lift_p = _squares(x), np.sqrt(np.maximum(0, top - _squares(pivots)))
    products = _products(x, pivots, exact).astype(np.float64)
    if lifted:
        products += np.sqrt(np.maximum(0, top - square))[:, None] * lift_p[None, :]
    return np.sqrt(np.maximum(0, (top if lifted else square[:, None]) + top - 2.0 * products))


def _highest(to_pivots: np.ndarray, square: np.ndarray, low: np.ndarray, high: np.ndarray, top: float) -> np.ndarray:
    """For each query and group, the highest score that the group's ranges of pivot distances allow."""
    bound = np.zeros((len(to_pivots), len(low)))
    for p in range(low.shape[1]):
        here = to_pivots[:, p, None]
        np.maximum(bound, np.maximum(low[None, :, p] - here, here - high[None, :, p]), out=bound)
    # And a margin for rounding.
    return (square[:, None] + top - bound**2) / 2 + 0.5 + 1e-9 * top


class _Best:
    """The k best (score, smaller id first) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.scores = np.full((queries, k), NOTHING)
        self.ids = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, who: np.ndarray, scores: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """Scores of candidates ``ids`` for the queries ``who``, whose own ids are no candidates."""
        # Only rows with a score that reaches the queries' k-th best can change anything.
        can = scores.max(axis=1) >= self.scores[who, -1]
        who, scores, own = who[can], scores[can], own[can]
        if not len(who):
            return
        scores = np.rint(scores).astype(np.int64) if scores.dtype == np.float64 else scores
        scores[own[:, None] == ids[None, :]] = NOTHING
        all_scores = np.concatenate([self.scores[who], scores], axis=1)
        all_ids = np.concatenate([self.ids[who], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((all_ids, -all_scores), axis=1)[:, : self.k]
        self.scores[who], self.ids[who] = np.take_along_axis(all_scores, order, 1), np.take_along_axis(all_ids, order, 1)

    def pairs(self, query_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, column = np.nonzero(self.ids != np.iinfo(np.int64).max)
        return query_ids[row], self.ids[row, column], self.scores[row, column]


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, candidates: np.ndarray, ids: np.ndarray, table_: np.ndarray, pivots: np.ndarray, top: float, k: int, group: int = GROUP) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Queries, candidates and scores of what of this block can be among the ``k`` best, and how many pairs were evaluated.

    Candidates stand in groups of neighbours.  Each query takes its groups in the order of
    their bounds, in waves that double; groups are evaluated for all queries of a wave at
    once, and a query stops when the best bound left is below its floor.
    """
    exact = top < EXACT
    # Neighbours have the same nearest pivot and like distances to it.
    near = table_.argmin(axis=1)
    order = np.lexsort((table_[np.arange(len(near)), near], near))
    candidates, ids, table_ = candidates[order], ids[order], table_[order]
    starts = np.arange(0, len(ids), group)
    low, high = np.minimum.reduceat(table_, starts), np.maximum.reduceat(table_, starts)
    allowed = _highest(_distances(queries, pivots, top, exact, False), _squares(queries), low, high, top)
    rank = np.argsort(-allowed, axis=1, kind="stable")
    best, floors, evaluated = _Best(len(queries), k), floors.astype(np.float64), 0
    # Converted once; doubles hold the products exactly.
    left, right = (queries.astype(np.float64), candidates.astype(np.float64)) if exact else (queries, candidates)
    wave, size = 0, 1
    while wave < len(starts):
        chosen = rank[:, wave : wave + size]
        wanted = np.take_along_axis(allowed, chosen, 1) >= floors[:, None]
        if not wanted[:, 0].any():
            break
        who, at = np.nonzero(wanted)
        groups = chosen[who, at]
        by_group = np.argsort(groups, kind="stable")
        who, groups = who[by_group], groups[by_group]
        for some in np.split(np.arange(len(who)), np.flatnonzero(np.diff(groups)) + 1):
            here = slice(starts[groups[some[0]]], starts[groups[some[0]]] + group)
            scores = left[who[some]] @ right[here].T
            evaluated += scores.size
            best.add(who[some], scores, ids[here], query_ids[who[some]])
        reached = best.ids[:, -1] != np.iinfo(np.int64).max
        floors[reached] = np.maximum(floors[reached], best.scores[reached, -1])
        wave, size = wave + size, 2 * size
    q, c, s = best.pairs(query_ids)
    real = s != NOTHING
    return q[real], c[real], s[real], evaluated


def spread_pivots(x: np.ndarray, n: int, top: float) -> np.ndarray:
    """Places of ``n`` rows, each the farthest from those before it, by their lifted distances."""
    exact, chosen = top < EXACT, [0]
    nearest = _distances(x, x[:1], top, exact)[:, 0]
    while len(chosen) < min(n, len(x)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(x, x[chosen[-1:]], top, exact)[:, 0])
    return np.array(chosen)


def blocks_of(sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """For each cell the number of its first block and how many it has; small cells share one, large ones are split."""
    out, number, held = {}, 0, 0
    for cell, size in sizes.items():
        parts = max(1, -(-size // most))
        if held and held + size > most:
            number, held = number + 1, 0
        out[cell] = number, parts
        number, held = (number + parts, 0) if parts > 1 else (number, held + size)
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, pivots: int = PIVOTS, query_block: int = 1024, candidate_block: int = 8192, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` best other vectors by inner product.

    ``vectors`` has vec_id and an array of longs, as ``integer_vectors`` makes it: there a
    null vec_id, a null vector and one with a null or non-finite component take no part,
    and of rows that repeat a vec_id the least vector counts.  Ties go to the smaller
    vec_id; a query with fewer candidates gets all of them; shorter vectors count as
    padded with zeros; an empty table gives an empty result.  Vectors whose squared norm is
    LARGEST or more take no part, since scores might not be longs.

    A hashed sample of ``sample`` rows is the only part that reaches the driver.  ``pivots``
    of them are chosen for their spread; each vector belongs to the cell of its nearest
    pivot.  Blocks hold whole small cells or parts of a large one.  A query goes only to
    blocks of cells whose range of pivot distances can beat the ``k``-th best of the sample;
    each pair of blocks meets in a task of its own, and only each query's best leave it.
    """
    spark = vectors.sparkSession
    square = F.aggregate("vector", F.lit(0).cast("double"), lambda s, c: s + c.cast("double") * c)
    rows = stage(vectors.select("vec_id", "vector", square.alias("square"), is_query.alias("is_query")).where(F.col("square") < LARGEST), "vectors")
    n, dims, top = rows.agg(F.count("*"), F.max(F.size("vector")), F.ceil(F.max("square")).cast("double")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    exact = top < EXACT
    chosen = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    sample_ids, sample_rows = chosen["vec_id"].to_numpy(), _padded(chosen["vector"], dims)
    pivot_rows = sample_rows[spread_pivots(sample_rows, pivots, top)]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = _distances(_padded(batch["vector"], dims), pivot_rows, top, exact)
            yield batch.assign(table=list(found), cell=found.argmin(axis=1).astype(np.int32))

    measured = stage(rows.mapInPandas(measure, "vec_id long, vector array<long>, square double, is_query boolean, table array<double>, cell int"), "measured")
    # A row for each cell: at most as many as pivots.
    ranges = measured.select("cell", F.posexplode("table").alias("pivot", "distance")).groupBy("cell", "pivot").agg(F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n"))
    cells = ranges.toPandas().sort_values(["cell", "pivot"])
    numbers, sizes = cells["cell"].unique(), cells.groupby("cell")["n"].first().to_numpy()
    low, high = (cells[c].to_numpy().reshape(len(numbers), -1) for c in ("low", "high"))
    asked = {r["cell"]: r["count"] for r in measured.where("is_query").groupBy("cell").count().orderBy("cell").collect()} or {0: 0}

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, own = _padded(batch["vector"], dims), batch["vec_id"].to_numpy()
            scores = _products(x, sample_rows, exact)
            scores[own[:, None] == sample_ids[None, :]] = NOTHING
            floors = np.sort(scores, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(x), NOTHING)
            open_cells = _highest(_distances(x, pivot_rows, top, exact, False), _squares(x), low, high, top) >= floors[:, None]
            yield batch[["vec_id", "vector", "cell"]].assign(floor=floors, cells=[numbers[o].tolist() for o in open_cells])

    own = F.xxhash64("vec_id")
    of_cell = lambda places, cell, i: F.element_at(F.create_map(*[F.lit(x) for c, place in places.items() for x in (c, place[i])]), cell)
    in_block = lambda places: (of_cell(places, F.col("cell"), 0) + F.pmod(own, of_cell(places, F.col("cell"), 1))).cast("int")
    ask_blocks, blocks = blocks_of(asked, query_block), blocks_of(dict(zip(map(int, numbers), map(int, sizes), strict=True)), candidate_block)
    queries = measured.where("is_query").mapInPandas(ask, "vec_id long, vector array<long>, cell int, floor long, cells array<int>")
    met_blocks = F.array_distinct(F.flatten(F.transform("cells", lambda c: F.sequence(of_cell(blocks, c, 0), of_cell(blocks, c, 0) + of_cell(blocks, c, 1) - 1))))
    queries = stage(queries.select("vec_id", "vector", "floor", in_block(ask_blocks).alias("qb"), met_blocks.alias("cbs")), "queries")
    left = queries.select("vec_id", "vector", "floor", "qb", F.explode("cbs").alias("cb"))
    # As many rows as there are pairs of blocks that meet.
    met = left.select(*[F.col(c).alias(c) for c in ("qb", "cb")]).distinct()
    right = measured.select("vec_id", "vector", "table", in_block(blocks).alias("cb")).join(met, "cb").select(*[F.col(c).alias(c) for c in ("vec_id", "vector", "table", "qb", "cb")])

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not (len(q) and len(c)):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        query, found, score, _ = best_of_block(
            _padded(q["vector"], dims), q["vec_id"].to_numpy(), q["floor"].to_numpy(), _padded(c["vector"], dims), c["vec_id"].to_numpy(), np.stack(c["table"].to_numpy()), pivot_rows, top, k,
        )
        return pd.DataFrame({"query_id": query, "vec_id": found, "score": score})

    key = ["qb", "cb"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    answer = stage(pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
    discard(rows, measured, queries)
    return answer


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.vector AS DOUBLE[]), CAST(c.vector AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
