"""Substring search by an index of trigrams: a needle's rarest ones choose rows, which are then compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text_index

#: Trigrams of a needle that choose rows.
CHOSEN = 3
#: Needles under three characters that one scan takes at most.
SHORT = 10_000


def trigrams(value: Column) -> Column:
    """The different runs of three characters, in lower case; none of fewer characters."""
    low = F.lower(value)
    at = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(low, i, F.lit(3))))


def trigram_index(rows: DataFrame, key: str, value: str) -> DataFrame:
    """word (a trigram), block, keys: rows that hold it, in blocks, so that a frequent one is many rows.

    Rows without a key or value aren't in it; ``key`` has to be unique.  ``text_index.write_index`` writes it.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), trigrams(F.col(value)).alias("words"))
    return text_index.listed(own).select("word", "block", "keys")


def candidates(index: DataFrame, needles: DataFrame) -> DataFrame:
    """needle, key: the rows that hold the CHOSEN rarest trigrams of each of ``needles`` (needle, text).

    Only needles of three characters or more have any; one with a trigram that no row has has none.
    """
    asked = needles.select("needle", F.explode(trigrams(F.col("text"))).alias("word"))
    counts = index.join(text_index.sent(asked.select("word").distinct()), "word").groupBy("word").agg(F.sum(F.size("keys").cast("long")).alias("n"))
    nth = F.row_number().over(Window.partitionBy("needle").orderBy("n", "word"))
    # A trigram that isn't there sorts first, as none.
    rare = asked.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("nth", nth).where(F.col("nth") <= CHOSEN)
    sizes = rare.groupBy("needle").agg(F.count("*").alias("size"))
    rare = rare.select("needle", "word").join(sizes, "needle")
    # Block by block: blocks without one of the trigrams aren't opened.
    lists = index.join(text_index.sent(rare), "word").groupBy("needle", "block").agg(F.collect_list("keys").alias("all"), F.first("size").alias("size")).where(F.size("all") == F.col("size"))
    common = F.aggregate(F.slice("all", F.lit(2), F.size("all")), F.get("all", F.lit(0)), lambda a, b: F.array_intersect(a, b))
    return lists.select("needle", F.explode(common).alias("key"))


def found(rows: DataFrame, key: str, value: str, index: DataFrame, needles: DataFrame) -> DataFrame:
    """needle, key of every row whose ``value`` holds the needle's text, whatever the case of either.

    Needles of one or two characters have no trigram: all rows are compared with them, by
    broadcast of SHORT at most (more are an error).  An empty needle is held by every row with
    a value.  A needle is a row of ``needles`` (needle, text); a null text is held nowhere.
    """
    asked = needles.where("text is not null").select("needle", F.lower("text").alias("low"))
    plain = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("key"), F.lower(value).alias("value"))
    near = candidates(index, needles.where(F.length(F.lower("text")) >= 3))
    long = near.join(plain, "key").join(asked, "needle").where(F.contains("value", "low")).select("needle", "key")
    short = asked.where(F.length("low") < 3)
    n = short.count()
    if not n:
        return long
    if n > SHORT:
        raise ValueError(f"{n} needles have fewer than three characters")
    return long.unionByName(plain.join(F.broadcast(short), F.contains("value", "low")).select("needle", "key"))
