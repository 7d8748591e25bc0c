"""Recorded votes: sides, crossings, participation, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sides(votes: DataFrame) -> DataFrame:
    """division, party, side: a party's strict majority in a division; a tie has no side.

    Ballots are counted where they are before anything moves, so few parties and divisions
    don't mean few tasks.
    """
    counted = votes.groupBy("division", "party").agg(F.count_if(F.col("vote") == "aye").alias("ayes"), F.count_if(F.col("vote") == "no").alias("noes"))
    return counted.select("division", "party", F.when(F.col("ayes") > F.col("noes"), "aye").when(F.col("noes") > F.col("ayes"), "no").alias("side"))


def crossed_votes(votes: DataFrame, exclude_groups: list[str] | None = None) -> DataFrame:
    """``votes`` (division, member, party, vote aye/no) with ``side`` and ``crossed``.

    ``crossed`` is true where the vote differs from the party's side and null elsewhere.
    Groups in ``exclude_groups`` never cross.
    """
    found = sides(votes).select(F.col("division").alias("of_division"), F.col("party").alias("of_party"), "side")
    rows = votes.join(found, votes["division"].eqNullSafe(found["of_division"]) & votes["party"].eqNullSafe(found["of_party"])).drop("of_division", "of_party")
    crossed = F.when(F.col("side").isNotNull() & (F.col("vote") != F.col("side")), True)
    if exclude_groups:
        crossed = F.when(~F.col("party").isin(exclude_groups), crossed)
    return rows.withColumn("crossed", crossed)


def crossed_together(votes: DataFrame) -> DataFrame:
    """``crossed_votes`` where a division's votes are to be gathered anyway: they move once, by division."""
    own = Window.partitionBy("division", "party")
    counted = votes.repartition("division").withColumns({"ayes": F.count_if(F.col("vote") == "aye").over(own), "noes": F.count_if(F.col("vote") == "no").over(own)})
    side = F.when(F.col("ayes") > F.col("noes"), "aye").when(F.col("noes") > F.col("ayes"), "no")
    rows = counted.withColumn("side", side).drop("ayes", "noes")
    return rows.withColumn("crossed", F.when(F.col("side").isNotNull() & (F.col("vote") != F.col("side")), True))


def chamber_totals(divisions: DataFrame) -> DataFrame:
    """house, total."""
    return divisions.groupBy("house").agg(F.count("*").alias("total"))


def voting_records(votes: DataFrame, least: int = 10) -> DataFrame:
    """member, voted, crossed: people with ``least`` votes or more; ``votes``: member, crossed."""
    counted = votes.groupBy("member").agg(F.count("*").alias("voted"), F.count_if(F.coalesce("crossed", F.lit(False))).alias("crossed"))
    return counted.where(F.col("voted") >= least)


def member_stats(people: DataFrame, votes: DataFrame, divisions: DataFrame) -> DataFrame:
    """slug, eligible, voted, against for people of a house that has divisions.

    ``people``: slug, house; ``votes``: member, crossed; ``divisions``: division, house.
    Eligible counts the current house's divisions, voted the votes in any.
    """
    tallies = votes.groupBy("member").agg(F.count("*").alias("voted"), F.count_if(F.coalesce("crossed", F.lit(False))).alias("against"))
    eligible = divisions.groupBy("house").agg(F.count("*").alias("eligible"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    joined = people.join(eligible, "house").join(tallies, people["slug"] == tallies["member"], "left")
    return joined.select("slug", "eligible", zero("voted"), zero("against"))


def division_results(votes: DataFrame) -> DataFrame:
    """division, ayes, noes, result; a tie is rejected."""
    counts = votes.groupBy("division").agg(F.count_if(F.col("vote") == "aye").alias("ayes"), F.count_if(F.col("vote") == "no").alias("noes"))
    return counts.withColumn("result", F.when(F.col("ayes") > F.col("noes"), "passed").otherwise("rejected"))


def group_breakdown(votes: DataFrame, members: DataFrame) -> DataFrame:
    """division, party, ayes, noes, total; votes of unknown members count as Unknown.

    ``members``: member, party.
    """
    named = votes.select("division", "member", "vote").join(members, "member", "left").withColumn("party", F.coalesce("party", F.lit("Unknown")))
    counts = named.groupBy("division", "party").agg(F.count_if(F.col("vote") == "aye").alias("ayes"), F.count_if(F.col("vote") == "no").alias("noes"))
    return counts.withColumn("total", F.col("ayes") + F.col("noes"))


def aye_width(ayes: Column, noes: Column) -> Column:
    return ayes / F.greatest(ayes + noes, F.lit(1)) * 100
