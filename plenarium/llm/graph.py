"""Connected components over a table of edges, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stage

#: A key with more than one in so many of all rows is hot; there are at most so many such keys.
HOT = 500


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined with ``groups``, which has one row for each ``key`` and its number of rows, n.

    Rows of hot keys stay where they are and meet their groups by broadcast: of ``total``
    rows at most HOT keys have more than one in HOT.  The others meet by a shuffle, in which
    no key is large.
    """
    hot, cold = F.broadcast(groups.where(F.col("n") * HOT > total)), groups.where(F.col("n") * HOT <= total)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def _upward(links: DataFrame, total: int) -> DataFrame:
    """``links`` (u, v; u > v) with the least that v itself is linked to, if any, for v."""
    least = links.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), "m")
    groups = links.groupBy("v").agg(F.count("*").alias("n")).join(least, "v", "left")
    return join_groups(links, groups, "v", total).select("u", F.coalesce("m", "v").alias("v"))


def _downward(links: DataFrame, total: int) -> DataFrame:
    """Each u of ``links`` (u, v; u > v) linked to its least v, and its other v to that one."""
    least = links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    others = join_groups(links, least, "u", total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).unionByName(others).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node is linked to one other at most, which itself is linked to none."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > 1").agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root: every node of ``edges`` (a, b) with the smallest node of its component.

    A node's smaller neighbours are linked to the least of them, which leaves of many links
    of a node about one.  Each round links its larger neighbours, then its smaller ones, to the
    least neighbour, until every node is linked to its root alone.  No step makes more rows
    than it has links and nodes.  Each step is written out, so lost executors never cost more
    than one step.  A node with many neighbours isn't gathered (see ``join_groups``).  Loops
    (a = b) give no node of their own.
    """
    larger = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    first = stage(larger.distinct(), name)
    now = stage(_downward(first, first.count()), name)
    discard(first)
    while not _are_stars(now):
        # Both steps are written out, so that no plan holds a step several times over.
        total = now.count()
        large = stage(_upward(now, total), name)
        before, now = now, stage(_downward(large, total), name)
        discard(large)
        discard(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
