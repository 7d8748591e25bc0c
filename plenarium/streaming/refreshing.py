"""Which copies are due, kept as streaming state with timers.

The batch operators join a listing with all that is stored.  Here a key's marker, version and
age are state of its own, and a timer tells when its copy has grown old, whether or not the
key is listed again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

DAY = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DUE = "key string, at timestamp, reason string"


class Copies(StatefulProcessor):
    """A key's copy: the marker and version it was made from, and when.

    A listing row makes it due if there is none (``new``), if the marker or the version is
    another (``changed``, ``version``), or if it is as old as that (``aged``); of several
    reasons the first counts.  What is due is taken as fetched then.  A timer makes a copy due
    that no row asked for in time, at the very moment it has the age, so what is due doesn't
    depend on how rows fall into batches.
    """

    def __init__(self, days: float):
        self.age = int(days * DAY)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.copy = handle.getValueState("copy", "marker string, version string, stored long")

    def _fetched(self, marker, version, at: int) -> None:
        held = self.copy.get()
        if held is not None:
            self.handle.deleteTimer(held[2] + self.age)
        self.copy.update((marker, version, at))
        self.handle.registerTimer(at + self.age)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        listed = pd.concat(list(rows)).sort_values(["at_ms", "marker", "version"], kind="stable")
        out = []
        for marker, version, at in zip(*(listed[c] for c in ("marker", "version", "at_ms")), strict=True):
            marker, version, at, held = None if pd.isna(marker) else marker, None if pd.isna(version) else version, int(at), self.copy.get()
            # A batch's rows come before its timers: what was due before this row is told first.
            while held is not None and held[2] + self.age < at:
                out.append((key[0], pd.Timestamp(held[2] + self.age, unit="ms"), "aged"))
                self._fetched(held[0], held[1], held[2] + self.age)
                held = self.copy.get()
            if held is None:
                reason = "new"
            elif held[0] != marker:
                reason = "changed"
            elif held[1] != version:
                reason = "version"
            elif at - held[2] >= self.age:
                reason = "aged"
            else:
                continue
            self._fetched(marker, version, at)
            out.append((key[0], pd.Timestamp(at, unit="ms"), reason))
        yield pd.DataFrame(out, columns=["key", "at", "reason"]).astype({"at": "datetime64[ns]"})

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, at, out = self.copy.get(), expiredTimerInfo.getExpiryTimeInMs(), []
        if held is not None and held[2] + self.age == at:
            # A timer that is set for a time already past would wait for another batch.
            while at <= timerValues.getCurrentWatermarkInMs():
                out.append((key[0], pd.Timestamp(at, unit="ms"), "aged"))
                at += self.age
            self.copy.update((held[0], held[1], at - self.age))
            self.handle.registerTimer(at)
        yield pd.DataFrame(out, columns=["key", "at", "reason"]).astype({"at": "datetime64[ns]"})

    def close(self) -> None:
        pass


def due_stream(listings: DataFrame, key: str, marker: str, version: str, at: str, days: float = 7, late: str = "0 seconds") -> DataFrame:
    """key, at, reason: a stream of what is due, from a stream of listing rows; see ``Copies``.

    ``at`` is when a row was listed, and the clock: a timer goes off once the watermark, ``late``
    behind the newest row, has reached it.  A null marker or version is a value like any other; rows without
    a key or time are left out.  Rows of one key and batch count in the order of their times.
    State is one small row a key, spread by keys; Spark wants the RocksDB state store for it,
    which ``with_state_store`` sets.
    """
    rows = listings.select(F.col(key).cast("string").alias("key"), F.col(marker).cast("string").alias("marker"), F.col(version).cast("string").alias("version"), F.col(at).cast("timestamp").alias("listed"))
    rows = rows.where("key is not null and listed is not null").withColumn("at_ms", F.unix_millis("listed")).withWatermark("listed", late)
    return rows.groupBy("key").transformWithStateInPandas(Copies(days), outputStructType=DUE, outputMode="Append", timeMode="EventTime")


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session with the state store that timers need, unless it has another of its own already."""
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return spark
