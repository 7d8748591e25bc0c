"""Tables that are replaced whole, or in buckets, by moving one pointer.

A new version is written beside the others and audited; only then is the file that names the
version to read replaced, by one rename.  Whatever fails before that leaves what is stored as
it was, and a reader sees either the old rows or the new ones.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def not_empty(rows: DataFrame) -> None:
    """An audit: nothing is written over what is stored by an empty listing."""
    if rows.isEmpty():
        raise ValueError("there are no rows, so nothing is published")


class Table:
    """Parquet versions under ``root``; ``root/_current`` names the folders that make up the table."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        self._system = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def parts(self) -> dict[str, str]:
        """Bucket to folder of what is current; '' is a table without buckets; nothing if none was published."""
        pointer = self._path("_current")
        if not self._system.exists(pointer):
            return {}
        stream = self._system.open(pointer)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, schema: str | StructType | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The current rows, of some ``buckets`` if asked; with a ``schema`` a table that isn't there is empty."""
        folders = sorted({f for b, f in self.parts().items() if buckets is None or b in map(str, buckets)})
        if not folders:
            if schema is None:
                raise ValueError(f"nothing was published at {self.root}")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(*[f"{self.root}/{f}" for f in folders])

    def _point(self, parts: dict[str, str]) -> None:
        fs = self.spark._jvm.org.apache.hadoop.fs
        new = self._path(f"_current-{uuid.uuid4().hex}")
        out = self._system.create(new, True)
        try:
            out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        finally:
            out.close()
        overwrite = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        overwrite[0] = getattr(fs, "Options$Rename").OVERWRITE
        # The pointer's file system, since the default one may be another.
        uri = self._system.makeQualified(new).toUri()
        fs.FileContext.getFileContext(uri, self.spark._jsc.hadoopConfiguration()).rename(new, self._path("_current"), overwrite)

    def publish(self, rows: DataFrame, audit: Callable[[DataFrame], None] = not_empty, key: str | None = None) -> None:
        """``rows`` in place of the whole table, once they are written and ``audit`` of what was written raises nothing.

        ``key``: rows are sorted into files by it.  The version before stays until the next
        publication, for readers that have begun.
        """
        before = self.parts()
        folder = f"v-{uuid.uuid4().hex}"
        try:
            (rows.sortWithinPartitions(key) if key else rows).write.parquet(f"{self.root}/{folder}")
            audit(self.spark.read.schema(rows.schema).parquet(f"{self.root}/{folder}"))
        except Exception:
            self._system.delete(self._path(folder), True)
            raise
        self._point({"": folder})
        self._sweep({folder, *before.values()})

    def publish_buckets(self, rows: DataFrame, bucket: str) -> None:
        """``rows`` in place of the buckets they have; all other buckets stay where they are.

        The folders of a publication are named by it, so what was there before is whole until
        the pointer moves, and what a lost driver leaves is swept by the next publication.
        """
        before = {b: f for b, f in self.parts().items() if b}
        folder = f"v-{uuid.uuid4().hex}"
        rows.write.partitionBy(bucket).parquet(f"{self.root}/{folder}")
        status = self._system.listStatus(self._path(folder))
        now = {s.getPath().getName().partition("=")[2]: f"{folder}/{s.getPath().getName()}" for s in status if "=" in s.getPath().getName()}
        self._point({**before, **now})
        self._sweep({*before.values(), *now.values()})

    def _sweep(self, kept: set[str]) -> None:
        """Versions and buckets go that neither the current table nor the one before reads."""
        tops = {f.partition("/")[0] for f in kept}
        for s in self._system.listStatus(self._path("")):
            name = s.getPath().getName()
            if name.startswith("v-") and name not in tops or name.startswith("_current-"):
                self._system.delete(s.getPath(), True)
            elif name.startswith("v-") and name not in kept:
                for b in self._system.listStatus(s.getPath()):
                    if "=" in b.getPath().getName() and f"{name}/{b.getPath().getName()}" not in kept:
                        self._system.delete(b.getPath(), True)


def bucket_of(key: list[str], buckets: int):
    return F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
