"""Approximate nearest neighbours by inner product: inverted lists, scanned a few dimensions at a time.

Candidates are scaled by the largest norm and lifted to the unit sphere by one more component,
queries are scaled to length one, so that a larger inner product is a smaller distance.  A
random rotation spreads every distance evenly over the dimensions.  Rows stand in the list of
their nearest centre, their rotated vectors in blocks of columns; a query visits its nearest
lists.  After each column block the partial distance is tested against what it would be for
the distance of the query's k-th best so far, with an allowance that shrinks as dimensions
are added, and the pairs that fail are given up.  Pairs that pass them all get their exact
product on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, stage, table
from .vectors import lists, matrix, usable

#: Rows a list has in the mean, and lists at most; both set how finely a query's visits can be chosen.
LIST, LISTS = 1024, 4096
#: Rows the index is fitted on, for each list, at least and at most.
SAMPLE = (16, 8192, 65536)
#: Queries whose true neighbours are found by a full scan, and the share of these that the visited lists must hold.
TRIALS, REACH = 64, 0.97
#: Dimensions in a column block; allowance of the test (the wider, the fewer neighbours are given up).
COLUMNS, ALLOWANCE = 16, 2.1
#: Candidates after which a query's k-th best is taken anew.
GROUP = 1024
#: Pairs are taken one by one where no more than one in so many is left.
SPARSE = 8
#: Lifted distances are held in single precision.
ROUNDING = 1e-5
#: Squared norms have to stay below this, so that products are finite.
LARGEST = 1e300


def rotation(dims: int, seed: int = 0) -> np.ndarray:
    """A uniformly random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Candidates scaled by the largest norm, with a component that makes each length one."""
    x = x / top
    return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(1)))[:, None]], axis=1)


def asking(x: np.ndarray) -> np.ndarray:
    """Queries of length one; the component of the lift is zero."""
    return np.concatenate([x / np.sqrt((x**2).sum(1))[:, None], np.zeros((len(x), 1))], axis=1)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows side by side, component after component in double precision."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def centres(x: np.ndarray, n: int, rounds: int = 10) -> np.ndarray:
    """``n`` centres (as many as there are different rows, if fewer) by plain rounds of means; one without rows stays."""
    out = x[np.sort(np.unique(x, axis=0, return_index=True)[1])[:n]]
    for _ in range(rounds):
        near = nearest_centre(x, out)
        count = np.bincount(near, minlength=len(out))
        order = np.argsort(near, kind="stable")
        used = np.flatnonzero(count)
        out[used] = np.add.reduceat(x[order], (np.cumsum(count) - count)[used]) / count[used, None]
    return out


def nearest_centre(x: np.ndarray, middles: np.ndarray) -> np.ndarray:
    half = (middles**2).sum(1) / 2
    return np.concatenate([np.argmax(x[at : at + 4096] @ middles.T - half, axis=1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def column_blocks(dims: int, columns: int = COLUMNS) -> list[slice]:
    return [slice(at, min(at + columns, dims)) for at in range(0, dims, columns)]


class _Found:
    """The k best (score, then smaller id) of each query so far."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.copy()
        self.who, self.id, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        fits = score >= self.floors[who]
        who, ids, score = (np.concatenate(x) for x in ((self.who, who[fits]), (self.id, ids[fits]), (self.score, score[fits])))
        order = np.lexsort((ids, -score, who))
        place = np.arange(len(order)) - np.searchsorted(who[order], who[order])
        order, place = order[place < self.k], place[place < self.k]
        self.who, self.id, self.score = who[order], ids[order], score[order]
        last = place == self.k - 1
        self.floors[self.who[last]] = np.maximum(self.floors[self.who[last]], self.score[last])

    def score_pairs(self, who: np.ndarray, what: np.ndarray, queries: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Exact products, some pairs at a time, as equal rows may make many."""
        for at in range(0, len(who), 1 << 16):
            w, c = who[at : at + (1 << 16)], what[at : at + (1 << 16)]
            self.add(w, ids[c], products(queries[w], x[c]))


def scan(queries: np.ndarray, query_ids: np.ndarray, turned: list[np.ndarray], floors: np.ndarray, top: float, x: np.ndarray, ids: np.ndarray, blocks: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """query, candidate and score of each query's ``k`` best here, and how many pairs each column block was read for.

    ``turned`` and ``blocks`` are the rotated queries and candidates by column blocks;
    ``floors`` are scores that a candidate must reach.
    """
    dims, norms = sum(b.shape[1] for b in blocks), np.sqrt((queries**2).sum(1))
    found, read = _Found(floors, k), [0] * (len(blocks) + 1)
    end, step = 0, 64
    while end < len(ids):
        # The first groups are small, so that floors rise early.
        at, end, step = end, min(end + step, len(ids)), min(2 * step, GROUP)
        here = slice(at, end)
        # The squared lifted distance of the lowest score that still counts.
        reach = 2 - 2 * found.floors / (norms * top) + ROUNDING
        alive, total, seen, pairs = query_ids[:, None] != ids[None, here], 0, 0, None
        for b, (q, c) in enumerate(zip(turned, blocks, strict=True)):
            c, seen = c[here], seen + c.shape[1]
            allowed = reach * (seen / dims) * (1 + ALLOWANCE / np.sqrt(seen)) ** 2 if seen < dims else reach
            if pairs is None:
                read[b] += alive.sum()
                total = total + ((q**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * (q @ c.T))
                alive &= total <= allowed[:, None]
                if alive.sum() * SPARSE < alive.size:
                    pairs = np.nonzero(alive)
                    total = total[pairs]
            else:
                read[b] += len(pairs[0])
                total = total + ((q[pairs[0]] - c[pairs[1]]) ** 2).sum(1)
                kept = total <= allowed[pairs[0]]
                pairs, total = (pairs[0][kept], pairs[1][kept]), total[kept]
        who, what = np.nonzero(alive) if pairs is None else pairs
        read[-1] += len(who)
        found.score_pairs(who, what + at, queries, x, ids)
    return query_ids[found.who], found.id, found.score, read


def neighbours(
    embeddings: DataFrame, is_query: Column, k: int = 20, vector: str = "embedding", rows_per_list: int = LIST, reach: float = REACH, trials: int = TRIALS,
    sample: tuple[int, int, int] = SAMPLE, slab: int = 8192, query_block: int = 1024, seed: int = 0,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest other rows found for each query, nearest first.

    Nearness is the inner product in double precision, which is the score; ties go to the
    smaller vec_id, and a query with fewer candidates gets all of them.  A row takes no part,
    as query or candidate, if its vec_id or vector is null, if a component is null or not
    finite, if all are zero (or none is there), or if the squared norm rounds to zero or
    reaches LARGEST.  Of
    rows that repeat a vec_id the least vector counts.  Shorter vectors count as padded with
    zeros; an empty table gives an empty result; other columns are ignored.

    Every row is in the index.  Centres are fitted on a hashed sample of ``sample`` rows (for
    each list, at least, at most), which reaches the driver.  How many lists a query visits
    is measured: the lists of the true neighbours of ``trials`` hashed queries, found by a
    full scan, must be visited for a share of ``reach``.  The sample also gives every query
    its first floor, and rows of it count as found.  A list is cut into slabs of ``slab`` rows
    and its queries into blocks, each pair of which meets in a task of its own, so a list that
    holds a third of all rows is no larger a task than others.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where(usable(vector, 1.0, LARGEST)).where(F.col("vec_id").isNotNull() & F.exists(vector, lambda c: c != 0))
    rows = rows.groupBy("vec_id").agg(F.min(F.col(f"`{vector}`").cast("array<double>")).alias("vector"))
    square = F.aggregate("vector", F.lit(0.0), lambda s, c: s + c * c)
    held = stage(rows.select("vec_id", "vector", square.alias("square"), is_query.alias("is_query")), "vectors")
    n, dims, largest = held.where("square > 0").agg(F.count("*"), F.max(F.size("vector")), F.max("square")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], out)
    held, top = held.where("square > 0"), float(np.sqrt(largest))
    count = int(min(LISTS, max(1, -(-n // rows_per_list))))
    hashed = held.orderBy(F.xxhash64("vec_id"), "vec_id")
    chosen = hashed.select("vec_id", "vector").limit(min(max(sample[0] * count, sample[1]), sample[2])).toArrow()
    sample_ids, sample_rows = chosen.column("vec_id").to_numpy(), matrix(chosen.column("vector"), dims)
    middles, turn = centres(lifted(sample_rows, top), count), rotation(dims + 1, seed)
    parts = column_blocks(dims + 1)
    names = [f"b{i}" for i in range(len(parts))]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up = lifted(matrix(batch.column("vector"), dims), top)
            turned = (up @ turn).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), batch.column("is_query"), pa.array(nearest_centre(up, middles).astype(np.int32)), *[lists(turned[:, p]) for p in parts]],
                names=["vec_id", "vector", "is_query", "list", *names],
            )

    rotated = ", ".join(f"{name} array<float>" for name in names)
    indexed = stage(held.drop("square").mapInArrow(index, f"vec_id long, vector array<double>, is_query boolean, list int, {rotated}"), "index")
    # A row for each list.
    sizes = np.zeros(len(middles), np.int64)
    for r in indexed.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    tried = held.where("is_query").orderBy(F.xxhash64("vec_id"), "vec_id").select("vec_id", "vector").limit(trials).toArrow()
    visits = _visits(indexed, tried.column("vec_id").to_numpy(), matrix(tried.column("vector"), dims), middles, k, reach)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                batch = whole.slice(at, 64)
                x, own = matrix(batch.column("vector"), dims), batch.column("vec_id").to_numpy()
                up = asking(x)
                order = _order(up, middles)
                # More lists where these hold too few rows.
                enough = np.cumsum(sizes[order], axis=1) - sizes[order] < min(n, 10 * (k + 1))
                visited = [o[: max(visits, e)] for o, e in zip(order, enough.sum(1), strict=True)]
                best = _Found(np.full(len(x), -np.inf), k)
                rough = x @ sample_rows.T
                rough[own[:, None] == sample_ids[None, :]] = -np.inf
                # Sums in another order differ by less than this.
                loose = 1e-12 * np.sqrt((x**2).sum(1)) * top
                last = np.partition(rough, -min(k, rough.shape[1]), axis=1)[:, -min(k, rough.shape[1])]
                w, c = np.nonzero((rough >= (last - loose)[:, None]) & np.isfinite(rough))
                best.score_pairs(w, c, x, sample_rows, sample_ids)
                ends = np.searchsorted(best.who, np.arange(len(x) + 1)).astype(np.int32)
                seeds = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(best.id), pa.array(best.score)], names=["vec_id", "score"]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("vector"), pa.array(best.floors), pa.array([v.tolist() for v in visited], pa.list_(pa.int32())), seeds],
                    names=["vec_id", "vector", "floor", "lists", "seeds"],
                )

    queries = stage(indexed.where("is_query").select("vec_id", "vector").mapInArrow(ask, "vec_id long, vector array<double>, floor double, lists array<int>, seeds array<struct<vec_id:long,score:double>>"), "queries")
    own = F.xxhash64("vec_id")
    blocks = max(1, -(-queries.count() // query_block))
    # As many rows as lists.
    cut = F.broadcast(spark.createDataFrame([(i, int(max(1, -(-s // slab)))) for i, s in enumerate(sizes)], "list int, slabs int"))
    left = queries.select("vec_id", "vector", "floor", F.pmod(own, F.lit(blocks)).alias("qb"), F.explode("lists").alias("list")).join(cut, "list")
    left = left.select("vec_id", "vector", "floor", "qb", "list", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)).alias("slab"))
    met = left.select(*[F.col(c).alias(c) for c in ("qb", "list")]).distinct()
    right = indexed.select("vec_id", "vector", "list", *names).join(cut, "list").withColumn("slab", F.pmod(own, F.col("slabs")).cast("int")).drop("slabs")
    right = right.join(met, "list")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])

    def search(q: pa.Table, c: pa.Table) -> pa.Table:
        who, what, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if len(q) and len(c):
            x = matrix(q.column("vector"), dims)
            turned = (asking(x) @ turn).astype(np.float32)
            pieces = [matrix(c.column(name), p.stop - p.start, np.float32) for name, p in zip(names, parts, strict=True)]
            who, what, score, _ = scan(
                x, q.column("vec_id").to_numpy(), [np.ascontiguousarray(turned[:, p]) for p in parts], q.column("floor").to_numpy(), top,
                matrix(c.column("vector"), dims), c.column("vec_id").to_numpy(), pieces, k,
            )
        return pa.table([who, what, score], names=["query_id", "vec_id", "score"])

    key = ["list", "slab", "qb"]
    pairs = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(search, "query_id long, vec_id long, score double")
    seeds = queries.select(F.col("vec_id").alias("query_id"), F.explode("seeds").alias("seed")).select("query_id", "seed.*")
    # A row of the sample may be found twice, with the same score.
    every = pairs.unionByName(seeds).distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    answer = stage(every.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "neighbours")
    discard(held, indexed, queries)
    return answer


def _order(asked: np.ndarray, middles: np.ndarray) -> np.ndarray:
    """Each query's lists, nearest first."""
    return np.argsort((middles**2).sum(1) / 2 - asked @ middles.T, axis=1, kind="stable")


def _visits(indexed: DataFrame, query_ids: np.ndarray, queries: np.ndarray, middles: np.ndarray, k: int, reach: float) -> int:
    """How many lists a query has to visit so that those of its true neighbours are among them for a share of ``reach``."""
    dims = queries.shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Found(np.full(len(query_ids), -np.inf), k)
        of: dict[int, int] = {}
        for batch in batches:
            ids, x = batch.column("vec_id").to_numpy(), matrix(batch.column("vector"), dims)
            scores = queries @ x.T
            scores[query_ids[:, None] == ids[None, :]] = -np.inf
            likely = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
            w, c = np.repeat(np.arange(len(scores)), likely.shape[1]), likely.ravel()
            w, c = w[np.isfinite(scores[w, c])], c[np.isfinite(scores[w, c])]
            of.update(zip(ids[c].tolist(), batch.column("list").to_numpy()[c].tolist(), strict=True))
            found.add(w, ids[c], scores[w, c])
            held = set(found.id.tolist())
            of = {i: place for i, place in of.items() if i in held}
        yield pa.RecordBatch.from_arrays([pa.array(found.who), pa.array(found.id), pa.array(found.score), pa.array([of[i] for i in found.id.tolist()], pa.int32())], names=["query", "vec_id", "score", "list"])

    if not len(query_ids):
        return 1
    near = indexed.select("vec_id", "vector", "list").mapInArrow(best, "query long, vec_id long, score double, list int")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    # At most ``k`` rows for each trial.
    true = near.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "list").collect()
    place = np.argsort(_order(asking(queries), middles), axis=1)
    needed = np.sort([place[r["query"], r["list"]] for r in true])
    return int(needed[int(np.ceil(reach * len(needed))) - 1]) + 1 if len(needed) else len(middles)


def op13_near_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
