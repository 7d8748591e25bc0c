"""Contests, candidates, parties and seats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import round2, share


def polling_place_totals(rows: DataFrame, key: str, votes: str, order: list[str], first: list[str]) -> DataFrame:
    """Votes of each candidate over polling places; other columns from the first row by ``order``, of equal ones the least.

    That row travels as one value, so its order isn't held once for each column.
    """
    least = F.min(F.struct(*order, *[c for c in first if c not in order])).alias("first_row")
    return rows.groupBy(key).agg(F.sum(votes).alias("votes"), least).select(key, "votes", *[F.col("first_row")[c].alias(c) for c in first])


def _with_totals(rows: DataFrame, electorate: str, votes: str) -> DataFrame:
    """``rows`` with total and candidates of their electorate, counted before anything moves."""
    totals = rows.groupBy(F.col(electorate).alias("of_electorate")).agg(F.sum(votes).alias("total"), F.count("*").alias("candidates"))
    return rows.join(totals, rows[electorate].eqNullSafe(totals["of_electorate"])).drop("of_electorate")


def percentage(votes: Column, total: Column) -> Column:
    """A share of the electorate's votes to two places, 0 of no votes."""
    return F.when(total > 0, round2(votes / F.when(total > 0, total) * 100)).otherwise(0.0)


def candidate_shares(rows: DataFrame, electorate: str, votes: str) -> DataFrame:
    """``rows`` with ``pct``: share of the electorate's votes to two places, 0 of no votes."""
    pct = percentage(F.col(votes), F.col("total"))
    return _with_totals(rows, electorate, votes).withColumn("pct", pct).drop("total", "candidates")


def two_candidate_shares(rows: DataFrame, electorate: str, votes: str) -> DataFrame:
    """``rows`` with ``share``, given only where an electorate has exactly two."""
    own = F.when(F.col("candidates") == 2, share(F.col(votes), F.col("total")))
    return _with_totals(rows, electorate, votes).withColumn("share", own).drop("total", "candidates")


def latest_contest(contests: DataFrame, current: DataFrame, event: str = "event_id", electorate: str = "electorate", order: str = "ord") -> DataFrame:
    """Each current electorate's contest of the highest event id, compared as text; ties keep the first."""
    nth = F.row_number().over(Window.partitionBy(electorate).orderBy(F.col(event).cast("string").desc(), order))
    return contests.join(current.select(electorate), electorate, "left_semi").withColumn("nth", nth).where("nth = 1").drop("nth")


def electorates_of(rows: DataFrame, name: str, state: str, order: list[str]) -> DataFrame:
    """Each electorate with the state of its last row."""
    return rows.groupBy(name).agg(F.max_by(state, F.struct(*order)).alias(state))


def party_seats(people: DataFrame, reference: DataFrame | None = None) -> DataFrame:
    """party, name, seats of either house; ``people``: party, group, house, ord.

    The name is the reference's (party, name), else that of the first person.
    """
    in_house = lambda h: F.count_if(F.col("house") == h).alias(h)
    seats = people.groupBy("party").agg(in_house("representatives"), in_house("senate"), F.min_by("group", "ord").alias("own_name"))
    if reference is None:
        return seats.withColumnRenamed("own_name", "name")
    return seats.join(reference.select("party", "name"), "party", "left").withColumn("name", F.coalesce("name", "own_name")).drop("own_name")


def seat_bar(seats: DataFrame) -> DataFrame:
    """house, party, seats, total, majority, tick, pct; ``seats``: house, party, seats.

    Parties without a seat have no bar.
    """
    total = F.sum("seats").over(Window.partitionBy("house"))
    rows = seats.withColumn("total", total).withColumn("majority", F.expr("total div 2 + 1"))
    tick = (F.col("majority") - 1) / F.greatest("total", F.lit(1)) * 100
    return rows.withColumn("tick", tick).withColumn("pct", share(F.col("seats"), F.col("total"))).where("seats > 0")
