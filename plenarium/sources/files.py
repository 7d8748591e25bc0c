"""Readers and writers: entity stores, JSON lines, ragged CSV, lookup tables, paged APIs."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .delimited import header_csv


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def entity_store(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON object a file; ``ord`` is the file's name, so order by it is key order.  A broken file fails the read."""
    if not exists(spark, folder):
        return empty(spark, f"{schema}, ord string")
    reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    return reader.json(folder).withColumn("ord", F.col("_metadata.file_path"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An entity a line; a missing file is an empty table, a bad line fails the read."""
    if not exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def titled_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """ord and ``columns`` of CSV files whose first line is a title; see ``delimited.header_csv``."""
    return header_csv(spark, path, columns, titled=True)


def plain_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """``columns`` of CSV files with a header; see ``delimited.header_csv``."""
    return header_csv(spark, path, columns).drop("ord")


def lookup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small table in one JSON document."""
    return spark.read.schema(schema).option("multiLine", True).json(path) if exists(spark, path) else empty(spark, schema)


def write_bundle(df: DataFrame, path: str, *order) -> None:
    """JSON lines in order: part files follow one another by name, each sorted; nulls are left out."""
    df.orderBy(*order).drop("ord", "rank").write.mode("overwrite").json(path)


def write_documents(df: DataFrame, folder: str, key: str) -> None:
    """One JSON document for each row, in a folder of its key; nulls are left out, field order is the schema's."""
    values = [c for c in df.columns if c not in (key, "ord")]
    df.select(F.col(key).alias("key"), F.to_json(F.struct(key, *values)).alias("value")).write.mode("overwrite").partitionBy("key").text(folder)


class Store:
    """Objects by key under a root that Hadoop's file systems reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, key: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{key}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def list(self, prefix: str = "") -> DataFrame:
        """key, size of every object whose key begins with ``prefix``, at any depth, in key order; none if nothing is there."""
        folder = f"{self.root}/{prefix.rpartition('/')[0]}".rstrip("/")
        if not exists(self.spark, folder):
            return empty(self.spark, "key string, size long")
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        at = F.instr("path", f"{self.root.removeprefix('file://')}/") + len(self.root.removeprefix("file://")) + 1
        keys = found.select(F.substr("path", at, F.length("path")).alias("key"), F.col("length").alias("size"))
        return keys.where(F.startswith("key", F.lit(prefix))).orderBy("key")

    def get(self, key: str) -> bytes | None:
        """An object's bytes; None if there is none."""
        system, path = self._path(key)
        if not system.exists(path):
            return None
        return bytes(self.spark.read.format("binaryFile").load(f"{self.root}/{key}").select("content").first()[0])

    def put(self, key: str, value: bytes) -> None:
        system, path = self._path(key)
        out = system.create(path, True)
        try:
            out.write(bytearray(value))
        finally:
            out.close()

    def delete(self, key: str) -> None:
        """What is there goes; deleting again changes nothing."""
        system, path = self._path(key)
        system.delete(path, False)


def write_entities(df: DataFrame, path: str, partition: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


class PagedSource(DataSource):
    """Rows of a paged API as (page, body); the fetcher is given, as ``fetch(url)``.

    Options: ``url`` with ``{page}``, ``pages``.  Each page is a partition; retries,
    spacing and headers belong to the fetcher.
    """

    fetch: Callable[[str], str] | None = None

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page int, body string"

    def reader(self, schema) -> DataSourceReader:
        return PagedReader(self.options["url"], int(self.options.get("pages", "1")), type(self).fetch)


class PagedReader(DataSourceReader):
    def __init__(self, url: str, pages: int, fetch: Callable[[str], str] | None):
        self.url, self.pages, self.fetch = url, pages, fetch

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(page) for page in range(1, self.pages + 1)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield partition.value, self.fetch(self.url.replace("{page}", str(partition.value)))


class WindowSource(DataSource):
    """Rows of an API of dated records as (id, date, body), split by date into windows that are walked apart.

    Options: ``start``, ``end`` (dates), ``days`` of a window, ``page``.  The fetcher is given,
    as ``fetch(start, end)``; see ``window_walk``.  Ids that two windows give are the caller's
    to drop, by ``first_of_each``.
    """

    fetch: Callable[[str, str], list[dict]] | None = None

    @classmethod
    def name(cls) -> str:
        return "dated"

    def schema(self) -> str:
        return "id string, date string, body string"

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return WindowReader(o["start"], o["end"], int(o.get("days", "31")), int(o.get("page", "100")), type(self).fetch)


class WindowReader(DataSourceReader):
    def __init__(self, start: str, end: str, days: int, page: int, fetch: Callable[[str, str], list[dict]] | None):
        self.start, self.end, self.days, self.page, self.fetch = start, end, days, page, fetch

    def partitions(self) -> list[InputPartition]:
        at, last, out = date.fromisoformat(self.start), date.fromisoformat(self.end), []
        while at <= last:
            to = min(last, at + timedelta(self.days - 1))
            out.append(InputPartition((at.isoformat(), to.isoformat())))
            at = to + timedelta(1)
        return out

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for row in window_walk(self.fetch, *partition.value, self.page):
            yield str(row["id"]), row["date"], json.dumps(row)


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the least by ``order`` and then by its other columns."""
    least = F.min(F.struct(order, *[c for c in rows.columns if c not in (key, order)]))
    return rows.groupBy(key).agg(least.alias("row")).select(key, "row.*").select(rows.columns)


def checked_list(rows: DataFrame) -> DataFrame:
    """``rows`` of a listing; one without a row is an error, so that nothing is written over what is stored."""
    if rows.isEmpty():
        raise ValueError("the listing is empty or isn't a list")
    return rows


def window_walk(fetch: Callable[[str, str], list[dict]], start: str, end: str, page: int = 100) -> list[dict]:
    """Rows of an API that gives at most ``page`` rows, newest first: the window's end moves to the
    oldest date seen until a short page or no new id; the last value of an id counts, at its first place."""
    seen: dict = {}
    while True:
        rows = fetch(start, end)
        new = [r for r in rows if r["id"] not in seen]
        seen.update((r["id"], r) for r in rows)
        if len(rows) < page or not new:
            return list(seen.values())
        end = min(r["date"] for r in rows)


def sparql_bindings(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """ord and a string column for each variable of a SPARQL answer."""
    row = ", ".join(f"{n}: struct<value: string>" for n in names)
    found = spark.read.schema(f"results struct<bindings: array<struct<{row}>>>").option("multiLine", True).json(path)
    rows = found.select(F.posexplode("results.bindings").alias("ord", "b"))
    return rows.select(F.col("ord").cast("long").alias("ord"), *[F.col(f"b.{n}.value").alias(n) for n in names])


def odata_values(spark: SparkSession, path: str, item: str) -> DataFrame:
    """The items of OData pages, ``item`` being their struct's fields."""
    return spark.read.schema(f"value array<struct<{item}>>").option("multiLine", True).json(path).select(F.explode("value").alias("v")).select("v.*")


def image_licences(spark: SparkSession, path: str) -> DataFrame:
    """commonsFile, licence, attribution from answers that map page ids to pages."""
    from ..functions.text import attribution

    meta = "struct<LicenseShortName: struct<value: string>, Artist: struct<value: string>>"
    pages = spark.read.schema(f"query struct<pages: map<string, struct<title: string, imageinfo: array<struct<extmetadata: {meta}>>>>>").option("multiLine", True).json(path)
    rows = pages.select(F.explode("query.pages").alias("id", "p")).select("p.title", F.get("p.imageinfo", F.lit(0))["extmetadata"].alias("m"))
    known = rows.where("title is not null and m is not null")
    licence = F.coalesce("m.LicenseShortName.value", F.lit("unknown"))
    return known.select(F.regexp_replace("title", "^File:", "").alias("commonsFile"), licence.alias("licence"), attribution(F.coalesce("m.Artist.value", F.lit(""))).alias("attribution"))


def image_batches(files: DataFrame, name: str = "commonsFile", size: int = 40) -> DataFrame:
    """batch, titles: distinct file names in order, so many to a request, joined by bars."""
    from ..operators.ordering import batches

    named = batches(files.where(f"{name} is not null").select(name).distinct(), size, name)
    return named.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(name)), lambda n: F.concat(F.lit("File:"), n)), "|").alias("titles"))


def bundles(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The entity tables of a bundle folder and the search index; a missing one is empty."""
    from .. import schemas

    tables = {name: json_lines(spark, f"{root}/{name}.jsonl", schema) for name, schema in schemas.ENTITIES.items()}
    return {**tables, "quick-search": json_lines(spark, f"{root}/quick-search.json", "t string, slug string, name string, sub string")}


def bundle_meta(spark: SparkSession, root: str) -> DataFrame:
    """generatedAt, sample, sources of a bundle folder: one row; without one it is a sample of unknown age."""
    schema = "generatedAt string, sample boolean, sources map<string, struct<lastSync: string, ok: boolean, note: string>>"
    found = lookup(spark, f"{root}/meta.json", schema)
    if found.isEmpty():
        return spark.range(1).select(F.lit("").alias("generatedAt"), F.lit(True).alias("sample"), F.create_map().cast("map<string, struct<lastSync: string, ok: boolean, note: string>>").alias("sources"))
    return found
