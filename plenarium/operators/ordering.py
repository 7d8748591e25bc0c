"""Orders, tops, runs and search; every order ends with an explicit ordinal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.rules import LEADERSHIP
from ..sources.work import cut_lineage


def collated(column: str) -> Column:
    """Order by English collation."""
    return F.expr(f"{column} collate en")


def in_order(df: DataFrame, *keys: str | Column) -> DataFrame:
    """A total order; the last key has to be unique."""
    return df.orderBy(*keys)


def newest_first() -> list[Column]:
    """Divisions by date, number and house from the end; ties in reverse load order."""
    number = F.col("number").cast("string")
    return [F.concat_ws("-", "date", F.lpad(number, F.greatest(F.length(number), F.lit(4)), F.lit("0")), "house").desc(), F.desc("ord")]


def divisions_newest_first(divisions: DataFrame) -> DataFrame:
    return divisions.orderBy(*newest_first())


def first_per_key(df: DataFrame, keys: list[str], *order: str | Column) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def latest_open(seats: DataFrame, person: str, start: str, order: list[str]) -> DataFrame:
    """Each person's seat of the latest start; ties keep the first."""
    return first_per_key(seats, [person], F.col(start).desc_nulls_last(), *order)


def numbered(df: DataFrame, *order: str | Column) -> DataFrame:
    """``df`` with ``nth``, its rows' places in the order from 0; the last of ``order`` has to be unique.

    Rows go to ranges of the order, as many as the data need, and those are counted first, so
    no task orders more than its own range.  The ranges are cut from lineage: computed again
    they might hold other rows.
    """
    ranged = cut_lineage(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranged.withColumn("nth", nth).join(F.broadcast(starts), "part").withColumn("nth", F.col("start") + F.col("nth") - 1).drop("part", "start")


def batches(df: DataFrame, size: int, *order: str) -> DataFrame:
    """``df`` with ``batch``: runs of ``size`` rows in order; the last of ``order`` has to be unique."""
    return numbered(df, *order).withColumn("batch", F.floor(F.col("nth") / size)).drop("nth")


def month_runs(rows: DataFrame, date: str, text: Column | None = None, needle: str = "", **equal: str | None) -> DataFrame:
    """month, n; rows without a date under ``undated``.  What a filter leaves is counted, so months without a row go."""
    rows = rows if text is None else text_filter(rows, text, needle, **equal)
    return rows.groupBy(F.coalesce(F.substring(date, 1, 7), F.lit("undated")).alias("month")).agg(F.count("*").alias("n"))


def latest_step(steps: DataFrame, key: str, date: str, pos: str, event: str) -> DataFrame:
    """Each key's last event by date, the last one of a tie."""
    return steps.groupBy(key).agg(F.max_by(F.struct(date, event), F.struct(date, pos)).alias("step")).select(key, f"step.{date}", f"step.{event}")


def leadership(positions: DataFrame) -> DataFrame:
    """person, role, since of open leading positions, one a person and role."""
    return positions.where(F.col("to").isNull() & F.col("role").rlike(LEADERSHIP)).groupBy("person", "role").agg(F.min("from").alias("since"))


def merged_positions(person: str, ministries: DataFrame, shadows: DataFrame, parliamentary: DataFrame) -> DataFrame:
    """person, positions: three kinds in one list, latest start first, the three in that order on ties."""
    kinds = [d.withColumn("rank", F.lit(i)) for i, d in enumerate((ministries, shadows, parliamentary))]
    rows = kinds[0].unionByName(kinds[1]).unionByName(kinds[2])
    entry = F.struct(F.coalesce("from", F.lit("")).alias("start"), "rank", "pos", "role", "from", "to", "kind")
    newest = F.array_sort(
        F.collect_list(entry),
        lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).when(a["rank"] != b["rank"], a["rank"] - b["rank"]).otherwise((a["pos"] - b["pos"]).cast("int")),
    )
    return rows.groupBy(person).agg(newest.alias("positions"))


def search_index(bills: DataFrame, people: DataFrame, electorates: DataFrame) -> DataFrame:
    """t, slug, name, sub, rank: three typed projections; each input has slug, name, sub."""
    parts = [d.select(F.lit(t).alias("t"), "slug", "name", "sub", F.lit(i).alias("rank")) for i, (t, d) in enumerate((("bill", bills), ("person", people), ("electorate", electorates)))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def quick_search(index: DataFrame, needle: str, limit: int = 8) -> DataFrame:
    """The first ``limit`` entries whose name holds the needle, in the groups' order; nothing under two characters."""
    found = index.where(F.contains(F.lower("name"), F.lit(needle.strip().lower()))) if len(needle.strip()) >= 2 else index.limit(0)
    return found.orderBy("rank", "name", "slug").limit(limit)


def text_filter(rows: DataFrame, text: Column, needle: str, **equal: str | None) -> DataFrame:
    """Rows whose lower-cased text holds the needle and whose columns equal what is given."""
    out = rows.where(F.contains(F.lower(text), F.lit(needle.strip().lower())))
    for column, value in equal.items():
        out = out.where(F.col(column) == value) if value else out
    return out
