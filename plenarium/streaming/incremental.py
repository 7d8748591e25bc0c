"""Incremental semantics: overlap windows, change detection, refresh, versions, upserts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def overlap_window(rows: DataFrame, date: str, cursor: str, days: int = 14) -> DataFrame:
    """Rows from ``days`` before the cursor on, so that late ones are seen again."""
    return rows.where(F.col(date) >= F.date_sub(F.lit(cursor).cast("date"), days))


def changed_only(incoming: DataFrame, stored: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Incoming rows that are new or differ from what is stored in one of ``values``."""
    old = stored.select(key, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("had"))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.col(f"old_{v}"))
    return incoming.join(old, key, "left").where(F.col("had").isNull() | ~same).drop("had", *[f"old_{v}" for v in values])


def stale_marker(incoming: DataFrame, stored: DataFrame, key: str, marker: str, timeline: str) -> DataFrame:
    """Rows to fetch again: another marker, or a stored timeline without steps."""
    old = stored.select(key, F.col(marker).alias("old_marker"), F.size(timeline).alias("steps"))
    fresh = F.col(marker).eqNullSafe(F.col("old_marker")) & (F.coalesce("steps", F.lit(0)) > 0)
    return incoming.join(old, key, "left").where(~fresh).drop("old_marker", "steps")


def due(rows: DataFrame, stored_at: Column, as_of: Column, days: float = 7, changed: Column | None = None) -> DataFrame:
    """Rows whose stored copy is ``days`` old or more, is missing, or whose id changed."""
    from ..functions.dates import age_days

    old = age_days(stored_at, as_of) >= days
    return rows.where(old if changed is None else old | F.coalesce(changed, F.lit(True)))


def pending(items: DataFrame, notes: DataFrame, key: str, version: Column | str, considered: str | None = None) -> DataFrame:
    """Items whose note is missing or of another version (or, if given, considered another count).

    An empty note is a decision and counts as there.
    """
    had = notes.select(key, F.col("version").alias("had_version"), *([F.col(considered).alias("had_count")] if considered else []))
    current = F.col("had_version").eqNullSafe(version if isinstance(version, Column) else F.lit(version))
    if considered:
        current = current & F.col("had_count").eqNullSafe(F.col(considered))
    return items.join(had, key, "left").where(~current).drop("had_version", "had_count")


def next_cursor(rows: DataFrame, date: str) -> DataFrame:
    """One row: the latest date of what was fetched again."""
    return rows.agg(F.max(date).alias("cursor"))


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key, incoming before stored and the latest by ``order`` first; of a tie the greatest by all its columns."""
    both = incoming.withColumn("_new", F.lit(1)).unionByName(stored.withColumn("_new", F.lit(0)))
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_new"), F.desc(order), *[F.desc(c) for c in sorted(incoming.columns)]))
    return both.withColumn("_nth", nth).where("_nth = 1").drop("_new", "_nth")


def record_sync(manifest: DataFrame, source: str, when: str, ok: bool, note: str | None = None) -> DataFrame:
    """The manifest with one source's status replaced; success clears the note."""
    row = manifest.sparkSession.createDataFrame([(source, when, ok, None if ok else note)], "source string, lastSync string, ok boolean, note string")
    return manifest.where(F.col("source") != source).unionByName(row)


def accepted_answers(answers: DataFrame, batch: DataFrame, keep_empty: bool) -> DataFrame:
    """id, text from JSON arrays of {id, summary}; ids outside the batch are ignored, texts trimmed."""
    rows = answers.select(F.explode(F.from_json("answer", "array<struct<id: string, summary: string>>")).alias("a")).select("a.id", F.trim("a.summary").alias("text"))
    rows = rows.join(batch.select("id"), "id", "left_semi")
    return rows if keep_empty else rows.where("text <> ''")


def run_sources(sources: dict[str, Callable[[], None]]) -> list[tuple[str, bool, str | None]]:
    """Run each source; one's failure is recorded and the others go on."""
    status: list[tuple[str, bool, str | None]] = []
    for name, run in sources.items():
        try:
            run()
            status.append((name, True, None))
        except Exception as error:  # noqa: BLE001 - every failure is a source's status
            status.append((name, False, str(error)))
    return status


def latest_by_key_stream(events: DataFrame, ts: str, key: str, late: str = "14 days") -> DataFrame:
    """Streaming: the latest time of each key on each day; a day's state goes once it is ``late`` old."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, "1 day"), key).agg(F.max(ts).alias("last_ts"), F.count("*").alias("n"))


def daily_counts_stream(events: DataFrame, ts: str, *keys: str, late: str = "14 days") -> DataFrame:
    """Streaming: counts by day and keys; a day is final once it is ``late`` old."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, "1 day"), *keys).agg(F.count("*").alias("n"))


def upsert_stream(events: DataFrame, table_path: str, checkpoint: str, key: list[str], order: str, buckets: int = 64):
    """Streaming sink: each micro-batch is merged into a published table (``sources.published``), in buckets by a hash of the key.

    Only buckets that the batch touches are read and written anew, into folders of their own;
    then the table's pointer moves, so a driver that is lost at any time leaves a whole table.
    A batch that runs again merges the same rows once more, which changes nothing; a table
    that is there already is merged into, whatever the checkpoint knows.
    """
    from ..sources.published import Table, bucket_of

    def merge(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("bucket", bucket_of(key, buckets)).persist()
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # as many as there are buckets at most
        if touched:
            table = Table(batch.sparkSession, table_path)
            stored = table.read(batch.schema, touched).withColumn("bucket", bucket_of(key, buckets))
            merged = upsert(stored, new, key, order).repartition("bucket")
            table.publish_buckets(merged, "bucket")
        new.unpersist()

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def capped(pending_rows: DataFrame, cap: int, *order: str) -> DataFrame:
    """The first ``cap`` pending rows of a run, in order; the rest stay pending for the next one."""
    return pending_rows.orderBy(*order).limit(cap)


class Budget:
    """Requests and failures of one run, on the driver; beyond either bound the run ends with an error."""

    def __init__(self, requests: int = 500, failures: int = 10):
        self.requests, self.failures = requests, failures
        self.used = self.failed = 0

    def spend(self) -> None:
        self.used += 1
        if self.used > self.requests:
            raise RuntimeError(f"request budget of {self.requests} is used up")

    def failure(self, error: Exception) -> None:
        self.failed += 1
        if self.failed >= self.failures:
            raise RuntimeError(f"{self.failed} failures, the last: {error}")


def run_counters(rows: DataFrame, name: str = "run") -> tuple[DataFrame, Observation]:
    """``rows`` (with status) and an observation of rows fetched, skipped, failed and unmatched.

    The counts come with the job that writes the rows, without a pass of their own.
    """
    seen = Observation(name)
    counts = [F.count_if(F.col("status") == kind).alias(kind) for kind in ("fetched", "skipped", "failed", "unmatched")]
    return rows.observe(seen, *counts), seen


def run_status(rows: DataFrame, found: DataFrame, stored: DataFrame, key: str, as_of: Column, days: float = 7) -> DataFrame:
    """``rows`` (key) with status: unmatched without an entry in ``found``, skipped if what is ``stored`` (key, stored_at) is fresh, else fetched."""
    from ..functions.dates import age_days

    joined = rows.join(found.select(key, F.lit(True).alias("matched")), key, "left").join(stored.select(key, "stored_at"), key, "left")
    fresh = F.coalesce(age_days(F.col("stored_at"), as_of) < days, F.lit(False))
    return joined.withColumn("status", F.when(F.col("matched").isNull(), "unmatched").when(fresh, "skipped").otherwise("fetched")).drop("matched", "stored_at")
