"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of each open scope, outermost first; the outermost lasts as long as the driver.
_scopes: list[list[tuple[SparkSession, str]]] = [[]]
_own: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def scope() -> Iterator[None]:
    """Owns the folders made inside it and deletes them at its end; lazy results that read them have to be written inside."""
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


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset a temporary one, on a local master only."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not shared and not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='plenarium-')}")
    return (shared or _own[0]).rstrip("/")


def work_folder(spark: SparkSession, kind: str) -> str:
    """A new folder there, which goes with the scope it is made in, or with the driver."""
    path = f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
    _scopes[-1].append((spark, path))
    return path


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written out by checkpoint(), so that its rows stay where they are and lost executors cost nothing before it.

    Spark deletes the files with the last reference to the result if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()
