"""Compression of vectors to product codes, with codebooks trained by Elkan's form of Lloyd's rounds.

A vector becomes integers and is cut into equal parts; each part position has a codebook of
its own.  What a round knows of a part is written with its row: its entry, an upper bound of
the distance to it, and a lower bound of the distance to every entry.  When entries move, the
bounds shift by as much, and only where they leave open which entry is nearest are distances
taken again.  Bounds are whole numbers, rounded away from each other, and an entry is passed
over only where they are strictly apart; all else is compared by exact integer squares.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, stage, table
from .graph import join_groups
from .vectors import lists, matrix, usable

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Squared norms have to stay below this, so that squared distances and their sums over parts are longs.
LARGEST = 2.0**56


class Codes(NamedTuple):
    """``rows``: the kept columns, code (one entry for each part), error; ``books``: parts x entries x components."""

    rows: DataFrame
    books: np.ndarray


def floor_root(squares: np.ndarray) -> np.ndarray:
    """The whole part of each square root, exactly."""
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def ceil_root(squares: np.ndarray) -> np.ndarray:
    root = floor_root(squares)
    return root + (root * root < squares)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of vectors that stand side by side."""
    return ((a - b) ** 2).sum(-1)


def assign_anew(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """code, upper (rows x parts) and lower (rows x parts x entries), from all distances."""
    code, upper = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
    lower = np.empty((*x.shape[:2], books.shape[1]), np.int64)
    for p in range(x.shape[1]):
        squares = _squares(x[:, p, None, :], books[p][None, :, :])
        # The first of equal distances is the lowest index.
        code[:, p] = squares.argmin(axis=1)
        lower[:, p], upper[:, p] = floor_root(squares), ceil_root(squares.min(axis=1))
    return code, upper, lower


def assign_again(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, books: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """code, upper and lower after entries have ``moved`` (whole distances, rounded up), and how many distances were taken."""
    code, taken = code.copy(), 0
    lower = np.maximum(0, lower - moved[None, :, :])
    upper = upper + np.take_along_axis(np.broadcast_to(moved, lower.shape), code[:, :, None], 2)[:, :, 0]
    for p in range(x.shape[1]):
        book = books[p]
        between = floor_root(_squares(book[:, None, :], book[None, :, :]))
        apart = between + np.where(np.eye(len(book), dtype=bool), np.iinfo(np.int64).max // 2, 0)
        # Where the nearest other entry is over twice as far off as the own one is at most, nothing changes.
        open_ = np.flatnonzero(apart.min(axis=1)[code[:, p]] <= 2 * upper[:, p])
        a, u, low, part = code[open_, p], upper[open_, p], lower[open_, p], x[open_, p]
        # The own distance is taken when first another entry is in question.
        square, known = np.zeros(len(open_), np.int64), np.zeros(len(open_), bool)
        for j in range(len(book)):
            asked = np.flatnonzero((a != j) & (low[:, j] <= u) & (between[a, j] <= 2 * u))
            fresh = asked[~known[asked]]
            if len(fresh):
                own = a[fresh]
                square[fresh], known[fresh] = _squares(part[fresh], book[own]), True
                u[fresh], low[fresh, own] = ceil_root(square[fresh]), floor_root(square[fresh])
                asked = asked[(low[asked, j] <= u[asked]) & (between[a[asked], j] <= 2 * u[asked])]
            found = _squares(part[asked], book[j])
            taken += len(fresh) + len(asked)
            low[asked, j] = floor_root(found)
            better = (found < square[asked]) | (found == square[asked]) & (j < a[asked])
            won = asked[better]
            a[won], square[won], u[won] = j, found[better], ceil_root(found[better])
        code[open_, p], upper[open_, p], lower[open_, p] = a, u, low
    return code, upper, lower, taken


def _moved(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    return ceil_root(_squares(before, after))


def _with(batch: pa.RecordBatch, **more: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("kept"), *more.values()], names=["kept", *more])


def _kept(embeddings: DataFrame, keep: list[str], vector: str, scale: int) -> DataFrame:
    """The rows that take part: what is kept of them, and their vector."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    return embeddings.where(usable(vector, scale, LARGEST)).select(kept, F.col(f"`{vector}`").alias("vector"))


def _typed(rows: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([rows.schema["kept"], *[T.StructField(c, t) for c, t in more.items()]])


_LONGS = T.ArrayType(T.LongType())


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries replaced by the floored means of their parts; one without parts stays."""
    parts, entries, width = books.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(books.shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x, code = matrix(batch.column("vector"), parts * width, np.int64).reshape(-1, parts, width), matrix(batch.column("code"), parts, np.int64)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                count[p] += np.bincount(code[:, p], minlength=entries)
        at = np.arange(parts * entries)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count.ravel()), lists(total.reshape(parts * entries, width))], names=["entry", "n", "total"])

    # A task gives one row for each entry.
    given = state.select("vector", "code").mapInArrow(sums, "entry long, n long, total array<long>")
    counts = given.groupBy("entry").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)])
    after = books.copy().reshape(parts * entries, width)
    for row in counts.where("n > 0").collect():
        after[row["entry"]] = [int(row[f"t{i}"]) // int(row["n"]) for i in range(width)]
    return after.reshape(books.shape)


def compress(embeddings: DataFrame, keep: list[str] | None = None, vector: str = "embedding", id_: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codes:
    """Codebooks trained on all rows, and the ``keep`` columns of every row (``id_`` alone by default) with code and error.

    Each component x counts as floor(scale * x), x as double.  A row whose vector is null, or
    holds a null or a non-finite component, takes no part; nor does one whose integers have a
    squared norm of LARGEST or more, as its errors might not be longs.  A length that is no
    multiple of ``parts``, or less than the longest, counts as padded with zeros.  Each
    codebook starts as its part of the ``entries`` rows of smallest ``id_`` (all, if fewer),
    a null one last, equal ones by their vectors; rows that repeat an id are rows of their
    own.  ``rounds`` times every part goes to its nearest entry (of equally near ones the
    first) and each entry becomes the floored mean of its parts; then parts are assigned once
    more, and ``error`` is a row's squared distance to its entries.  An empty table has no
    codes and books without entries.

    What reaches the driver is the books' first rows and, each round, a sum for each entry.
    Every round's bounds are written to the shared folder, and the round's before go.
    """
    rows = _kept(embeddings, list(dict.fromkeys([*(keep or []), id_])), vector, scale)
    kept = [F.col(f"kept.`{c}`") for c in keep or [id_]]
    out = _typed(rows, code=_LONGS, error=T.LongType())
    longest = rows.agg(F.max(F.size("vector"))).first()[0]
    if longest is None:
        return Codes(embeddings.sparkSession.createDataFrame([], out).select(*kept, "code", "error"), np.zeros((parts, 0, 0), np.int64))
    width = max(1, -(-longest // parts))
    whole = lambda v: np.floor(scale * matrix(v, parts * width)).astype(np.int64)
    first = rows.orderBy(F.col(f"kept.`{id_}`").asc_nulls_last(), "vector").select("vector").limit(entries).toArrow()
    books = np.ascontiguousarray(whole(first.column("vector")).reshape(-1, parts, width).transpose(1, 0, 2))
    entries = books.shape[1]
    held = _typed(rows, vector=_LONGS, code=_LONGS, upper=_LONGS, lower=_LONGS)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(batch.column("vector")).reshape(-1, parts, width)
            code, upper, lower = assign_anew(x, books)
            yield _with(batch, vector=lists(x), code=lists(code), upper=lists(upper), lower=lists(lower))

    def again(books: np.ndarray, moved: np.ndarray, last: bool):
        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("vector"), parts * width, np.int64).reshape(-1, parts, width)
                code, upper, lower, _ = assign_again(
                    x, matrix(batch.column("code"), parts, np.int64), matrix(batch.column("upper"), parts, np.int64),
                    matrix(batch.column("lower"), parts * entries, np.int64).reshape(-1, parts, entries), books, moved,
                )
                if last:
                    error = sum(_squares(x[:, p], books[p][code[:, p]]) for p in range(parts))
                    yield _with(batch, code=lists(code), error=pa.array(error))
                else:
                    yield _with(batch, vector=batch.column("vector"), code=lists(code), upper=lists(upper), lower=lists(lower))

        return step

    state, moved = stage(rows.mapInArrow(begin, held), "codes"), np.zeros((parts, entries), np.int64)
    for k in range(rounds):
        after = _means(state, books)
        moved, books = _moved(books, after), after
        if not moved.any():
            # Every further round would find the same.
            break
        if k < rounds - 1:
            before, state = state, stage(state.mapInArrow(again(books, moved, False), held), "codes")
            discard(before)
    coded = stage(state.mapInArrow(again(books, moved, True), out), "coded")
    discard(state)
    return Codes(coded.select(*kept, "code", "error"), books)


def encode(embeddings: DataFrame, books: np.ndarray, keep: list[str], vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The ``keep`` columns, code and error of rows that needn't be those the ``books`` come from.

    The same vectors take part as in ``compress``; components beyond the books' length are an error.
    """
    parts, _, width = books.shape
    rows = _kept(embeddings, keep, vector, scale)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * matrix(batch.column("vector"), parts * width)).astype(np.int64).reshape(-1, parts, width)
            code = assign_anew(x, books)[0]
            yield _with(batch, code=lists(code), error=pa.array(sum(_squares(x[:, p], books[p][code[:, p]]) for p in range(parts))))

    return rows.mapInArrow(near, _typed(rows, code=_LONGS, error=T.LongType())).select("kept.*", "code", "error")


def decode(rows: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """``rows`` with ``vector`` in place of ``code``: what the entries of a code stand for, in the original measure."""
    columns = [c for c in rows.columns if c != "code"]
    packed = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("kept"), "code")

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = matrix(batch.column("code"), len(books), np.int64)
            x = np.stack([books[p][code[:, p]] for p in range(len(books))], axis=1) if len(code) else np.zeros((0, 1))
            # A component stands for the middle of the interval that was floored to it.
            yield _with(batch, vector=lists((x + 0.5) / scale))

    return packed.mapInArrow(back, _typed(packed, vector=T.ArrayType(T.DoubleType()))).select("kept.*", "vector")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = compress(table(spark, sf_dir, "embeddings"), ["vec_id", "label"])
    listed = F.sha2(F.lit(",".join(map(str, books.ravel().tolist()))), 256)
    # The key holds null labels together.
    rows = rows.withColumn("key", F.struct("label"))
    sums = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    hexes = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    joined = join_groups(rows, sums, "key", rows.count())
    return joined.select("vec_id", hexes.alias("code"), "error", "label_error", listed.alias("codebooks_sha256"))


def _sql() -> str:
    """Rounds are written out one after another; products of doubles are exact here."""
    distance = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, b.x) + list_inner_product(b.x, b.x)"
    steps = [
        f"""v AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT rn, part, x[part * len(x) // {PARTS} + 1 : (part + 1) * len(x) // {PARTS}] AS x FROM v, range({PARTS}) t(part)
), b0 AS MATERIALIZED (
  SELECT part, rn - 1 AS entry, x FROM p WHERE rn <= {ENTRIES}
)"""
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT rn, part, any_value(p.x) AS x, CAST(min([{distance}, entry])[1] AS BIGINT) AS error, CAST(min([{distance}, entry])[2] AS BIGINT) AS entry
  FROM p JOIN b{r} b USING (part) GROUP BY rn, part
)""")
        if r < ROUNDS:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.x, b.x) AS x
  FROM b{r} b LEFT JOIN (
    SELECT part, entry, list(c ORDER BY place) AS x FROM (
      SELECT part, entry, place, floor(sum(c) / count(*)) AS c
      FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS place FROM a{r}) GROUP BY part, entry, place
    ) GROUP BY part, entry
  ) m ON b.part = m.part AND b.entry = m.entry
)""")
    return f"""WITH {", ".join(steps)}, c AS (
  SELECT rn, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(error) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rn
), h AS (
  SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS place FROM b{ROUNDS})
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM v JOIN c USING (rn), h
"""


OP11_SQL = _sql()
