"""Listings of unknown length, and dated listings as a stream.

Pages are asked for in runs of 1, 2, 4, ... pages, each page a task; the first page with fewer
items than a page holds is the last one.  What a run gave is written before the next begins.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .files import window_walk
from .published import Table, not_empty
from .work import scope, work_folder


class NotAList(ValueError):
    """A page isn't the list that was asked for."""


def items_of(body: str, key: str | None) -> list | None:
    """The items of a page: the body itself, or, of an object, what ``key`` holds (nothing, if it isn't there); None if that is no list."""
    value = json.loads(body)
    if key is not None:
        value = value.get(key, []) if isinstance(value, dict) else None
    return value if isinstance(value, list) else None


def walked(spark: SparkSession, fetch: Callable[[int], str], size: int, most: int | None = None, key: str | None = None, widest: int = 64) -> DataFrame:
    """page (from 1), pos (from 0), item (JSON) of all pages of a listing, in the work folder of the scope around it.

    ``fetch(page)`` gives a body; it runs in tasks, and what it raises fails the walk after
    Spark's retries.  The walk ends with the first page of fewer than ``size`` items, or with
    page ``most``.  Runs grow to ``widest`` pages, so beyond the end at most as many pages are
    asked for as were needed, and no more than ``widest``.  A page that is no list is an
    error, unless it lies beyond the end.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.column("id").to_pylist():
                found = items_of(fetch(page), key)
                # A row at -1 for the page itself, with the number of its items; null if it is no list.
                rows = [(page, -1, None if found is None else str(len(found))), *[(page, i, json.dumps(x)) for i, x in enumerate(found or [])]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["page", "pos", "item"])

    schema, parts, at, width = "page long, pos long, item string", [], 1, 1
    while True:
        end = at + width if most is None else min(at + width, most + 1)
        folder = work_folder(spark, "walk")
        spark.range(at, end, numPartitions=end - at).mapInArrow(ask, schema).write.parquet(folder)
        run = spark.read.schema(schema).parquet(folder)
        # A row for each page of the run.
        pages = {r["page"]: r["item"] for r in run.where("pos = -1").collect()}
        last = next((p for p in range(at, end) if pages[p] is None or int(pages[p]) < size), None)
        if last is not None and pages[last] is None:
            raise NotAList(f"page {last} isn't a list")
        parts.append(run.where((F.col("pos") >= 0) & (F.col("page") <= (end if last is None else last))))
        if last is not None or end == (most or 0) + 1:
            out = parts[0]
            for more in parts[1:]:
                out = out.unionByName(more)
            return out
        at, width = end, min(2 * width, widest)


def publish_walk(spark: SparkSession, fetch: Callable[[int], str], size: int, table: Table, schema: str, audit: Callable[[DataFrame], None] = not_empty, **options) -> None:
    """A listing's items, as ``schema``, with page and pos, in place of a published table.

    An error midway, a page that is no list, no item at all or what else ``audit`` raises
    leaves the table as it is.
    """
    with scope():
        rows = walked(spark, fetch, size, **options)
        table.publish(rows.select("page", "pos", F.from_json("item", schema).alias("item")).select("page", "pos", "item.*"), audit)


class CursorSource(DataSource):
    """A stream of an API's dated records as (id, date, body); its offset is the date cursor.

    Options: ``start`` (the first date), ``overlap`` (days before the cursor that each batch
    asks for again, 14), ``days`` of a task's window, ``page``.  Given are ``fetch(start, end)``
    (see ``window_walk``) and ``latest()``, the date of the newest record or None.  Late
    records within the overlap are taken with the next batch; ids that come again are for the
    sink to merge.  Every trigger has a batch, even when the newest date hasn't moved, since
    what lies in the overlap may have.
    """

    fetch: Callable[[str, str], list[dict]] | None = None
    latest: Callable[[], str | None] | None = None

    @classmethod
    def name(cls) -> str:
        return "cursor"

    def schema(self) -> str:
        return "id string, date string, body string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        o = self.options
        return CursorReader(o["start"], int(o.get("overlap", "14")), int(o.get("days", "31")), int(o.get("page", "100")), type(self).fetch, type(self).latest)


class CursorReader(DataSourceStreamReader):
    def __init__(self, start: str, overlap: int, days: int, page: int, fetch, latest):
        self.start, self.overlap, self.days, self.page, self.fetch, self.latest = start, overlap, days, page, fetch, latest
        self.run = 0

    def initialOffset(self) -> dict:
        return {"cursor": None, "run": 0}

    def latestOffset(self) -> dict:
        self.run += 1
        return {"cursor": self.latest(), "run": self.run}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        """Windows from ``overlap`` days before the cursor to the newest date; none before the API has records."""
        # A restarted reader goes on from the offset that the checkpoint holds.
        self.run = max(self.run, end["run"])
        if end["cursor"] is None:
            return []
        first = date.fromisoformat(self.start)
        at = first if start["cursor"] is None else max(first, date.fromisoformat(start["cursor"]) - timedelta(self.overlap))
        out, last = [], date.fromisoformat(end["cursor"])
        while at <= last:
            to = min(last, at + timedelta(self.days - 1))
            out.append(InputPartition((at.isoformat(), to.isoformat())))
            at = to + timedelta(1)
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in window_walk(self.fetch, *partition.value, self.page):
            yield str(row["id"]), row["date"], json.dumps(row)

    def commit(self, end: dict) -> None:
        """The checkpoint holds the cursor."""
