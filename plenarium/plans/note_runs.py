"""Runs of the note layer that cap, resume and abort; the call itself is given."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import batches
from ..sources.files import empty, exists
from ..sources.work import scope, work_folder
from ..streaming.incremental import accepted_answers

# Requests of a run, items of a request, and failed requests that end it.
CAP, SIZE, FAILURES = 80, 8, 5
PROGRESS = "run string, request long, id string, text string, error string"


class TooManyFailures(RuntimeError):
    """So many requests failed that the run ended."""


class Done(NamedTuple):
    requests: int
    written: int
    failed: int
    left: int


def progress_of(spark, path: str) -> DataFrame:
    """run, request, id, text, error: a row for every item that was asked for; text is null where there is no note."""
    return spark.read.schema(PROGRESS).parquet(path) if exists(spark, path) else empty(spark, PROGRESS)


def notes_of(progress: DataFrame) -> DataFrame:
    """id, text of the notes that were made; the last by run and request of several is no different from the others."""
    return progress.where("text is not null").groupBy("id").agg(F.max("text").alias("text"))


def run_notes(pending: DataFrame, call: Callable[[list[dict]], str], path: str, order: str, cap: int = CAP, size: int = SIZE, failures: int = FAILURES, wave: int = 1, keep_empty: bool = False) -> Done:
    """Ask for the notes of ``pending`` (id, ``order``, and what the call reads), in order, ``size`` to a request.

    ``call(items)`` gives a JSON list of {id, summary} and runs in tasks; what it raises makes
    its request a failed one, whose items stay pending, and so does an answer that isn't such
    a list.  Ids that weren't asked for are ignored, ids without an answer and empty notes
    (unless ``keep_empty``: then they are a decision) stay pending.  A run makes ``cap``
    requests at most; the rest is for the next one.  ``wave`` requests are made at a time and
    their rows appended to the progress table at ``path`` before the next, so a run that is
    lost repeats one wave at most, and a restart asks for nothing that was answered.  With
    the ``failures``-th failed request the run ends with an error, after its wave.
    """
    spark, run = pending.sparkSession, uuid.uuid4().hex
    todo = pending.join(notes_of(progress_of(spark, path)).select("id"), "id", "left_anti")
    total, failed, made, written = todo.count(), 0, 0, 0
    if not total:
        return Done(0, 0, 0, 0)
    fields = [c for c in pending.columns if c != "id"]

    def ask(items: pd.DataFrame) -> pd.DataFrame:
        request = int(items["request"].iloc[0])
        rows = items.drop(columns="request").sort_values(order, kind="stable").to_dict("records")
        try:
            answer, error = call(rows), None
        except Exception as raised:  # noqa: BLE001 - every failure is the request's
            answer, error = None, f"{type(raised).__name__}: {raised}"
        return pd.DataFrame({"request": [request], "answer": [answer], "error": [error]})

    with scope():
        # A run's items: cap times size at most.
        folder = work_folder(spark, "notes")
        first = todo.orderBy(order, "id").limit(cap * size).select(F.struct("*").alias("row"), F.col(order).alias("at"), F.col("id").alias("id"))
        batches(first, size, "at", "id").select(F.col("batch").alias("request"), F.col("id").cast("string").alias("id"), *[f"row.{c}" for c in fields]).write.parquet(folder)
        items = spark.read.parquet(folder)
        last = items.agg(F.max("request")).first()[0]
        for at in range(0, last + 1, wave):
            some = items.where(F.col("request").between(at, min(at + wave - 1, last)))
            answers = work_folder(spark, "answers")
            some.groupBy("request").applyInPandas(ask, "request long, answer string, error string").write.parquet(answers)
            got = spark.read.parquet(answers)
            asked = some.select("request", "id").join(got, "request")
            listed = F.from_json("answer", "array<struct<id: string, summary: string>>")
            asked = asked.withColumn("error", F.when(F.col("error").isNull() & listed.isNull(), "the answer isn't a list").otherwise(F.col("error")))
            texts = accepted_answers(got.where("answer is not null").select("answer"), some, keep_empty).groupBy("id").agg(F.max("text").alias("text"))
            rows = asked.drop("answer").join(texts, "id", "left").select(F.lit(run).alias("run"), "request", "id", F.when(F.col("error").isNull(), F.col("text")).alias("text"), "error")
            rows.coalesce(1).write.mode("append").parquet(path)
            mine = progress_of(spark, path).where((F.col("run") == run) & (F.col("request") >= at))
            seen = mine.agg(F.count_distinct(F.when(F.col("error").isNotNull(), F.col("request"))), F.count(F.when(F.col("text") != "", 1))).first()
            failed, written, made = failed + seen[0], written + seen[1], min(at + wave, last + 1)
            if failed >= failures:
                raise TooManyFailures(f"{failed} requests failed, of {made}")
    return Done(made, written, failed, max(0, total - cap * size))
