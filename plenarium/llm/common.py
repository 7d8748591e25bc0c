"""What the operators share: the shared work folder, staged tables, row identities, table reading."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_folder: list[str] = []
#: Staged tables of each open scope, outermost first; the outermost lasts as long as the driver.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]


def work_folder(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Where that is unset a temporary folder does, but on a local master only: executors on
    other machines would each write to a disk of their own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="plenarium-"))
    return _own_folder[0]


def stage(df: DataFrame, name: str, rows_per_file: int = 0, outer: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The written table cuts lineage and survives lost executors; file path and row
    index of what is read back are a stable identity of each row.  It is deleted by
    ``discard`` or at the end of the ``scope`` it was made in (``outer``: of the one around it).
    """
    spark = df.sparkSession
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _scopes[-2 if outer and len(_scopes) > 1 else -1].append((spark, path))
    writer = df.write
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        folders = {file.rsplit("/", 1)[0].rsplit("/", 1)[-1] for file in df.inputFiles()}
        for held in _scopes:
            for spark, path in [x for x in held if x[1].rsplit("/", 1)[-1] in folders]:
                _delete(spark, path)
                held.remove((spark, path))


@contextmanager
def scope() -> Iterator[None]:
    """Owns the tables that operators stage inside it and deletes them at its end.

    Results are lazy and read staged tables, so they have to be written or counted inside.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


@atexit.register
def _last() -> None:
    for spark, path in _scopes[0]:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended
            return


def identified(docs: DataFrame, stored: bool = False) -> DataFrame:
    """row (a struct of all columns), file and place: an identity that rows keep in every pass.

    ``stored``: ``docs`` is a Parquet table as it was read, whose file and row index serve.
    Anything else is staged first, since rows of a plan may be dealt anew when it runs again;
    so is a table whose rows have lost their place, say to a cache.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    if stored:
        try:
            return _placed(docs, row)
        except AnalysisException:
            pass
    return _placed(stage(docs.select(row), "rows"), F.col("row"))


def _placed(held: DataFrame, row: Column) -> DataFrame:
    own = held.metadataColumn("_metadata")
    return held.select(row, F.xxhash64(own["file_path"]).alias("file"), own["row_index"].alias("place"))


def chunks(items: Iterable, size, most: int = 1 << 20) -> Iterator[list]:
    """Items in lists of about ``most`` by ``size``, so that a batch of long texts isn't held several times."""
    some, held = [], 0
    for item in items:
        some.append(item)
        held += size(item)
        if held >= most:
            yield some
            some, held = [], 0
    if some:
        yield some


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more, on either side."""
    gc.collect()
    # The plan that ran last is referred to until another one runs.
    spark.range(1).count()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
