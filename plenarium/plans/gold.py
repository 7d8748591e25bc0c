"""Canonical tables to derived tables: enrichment, statistics, links and export order."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import elections, linking, matching, ordering, votes
from ..sources import files


@dataclass
class Canonical:
    """Entity tables with ``ord``, and side tables by their owner's slug or id."""

    people: DataFrame
    electorates: DataFrame
    divisions: DataFrame
    bills: DataFrame
    elections: DataFrame
    handbook: DataFrame
    person_notes: DataFrame
    division_notes: DataFrame
    profiles: DataFrame
    party_reference: DataFrame
    party_facts: DataFrame


NOTE = f"slug string, note {schemas.AI_TEXT}"
SIDE = {
    "handbook": schemas.HANDBOOK,
    "person_notes": NOTE,
    "division_notes": NOTE,
    "profiles": f"slug string, profile {schemas.PROFILE}, enrolment bigint",
    "party_reference": "slug string, name string, code string, colour string",
    "party_facts": "slug string, facts struct<founded: string, website: string, wikipedia: string>",
}


def load(spark: SparkSession, root: str) -> Canonical:
    """Entities from ``<root>/<entity>/*.json``, side tables from ``<root>/<table>.jsonl``; missing ones are empty."""
    entities = {n: files.entity_store(spark, f"{root}/{n}", schemas.ENTITIES[n]) for n in ("people", "electorates", "divisions", "bills", "elections")}
    side = {n: files.json_lines(spark, f"{root}/{n}.jsonl", schema) for n, schema in SIDE.items()}
    return Canonical(**entities, **side)


def _seated(c: Canonical) -> Canonical:
    """A member's state is that of the seat; a seat's member is the last person in key order."""
    seats = c.electorates.select(F.col("slug").alias("electorate"), F.col("state").alias("seat_state"))
    people = c.people.join(seats, "electorate", "left").withColumn("state", F.coalesce("seat_state", "state")).drop("seat_state")
    holder = people.where("electorate is not null").groupBy(F.col("electorate").alias("slug")).agg(F.max_by("slug", "ord").alias("holder"))
    seated = c.electorates.join(holder, "slug", "left").withColumn("memberSlug", F.coalesce("holder", "memberSlug")).drop("holder")
    return replace(c, people=people, electorates=seated)


def summarised(divisions: DataFrame, people: DataFrame, division_notes: DataFrame) -> DataFrame:
    """Divisions with the kind of their summary; only transcripts carry a note, and an empty one stays hidden."""
    notes = division_notes.select(F.col("slug").alias("id"), "note")
    joined = linking.transcripts(divisions, people, "id", "summary", "name").withColumnRenamed("transcript", "spoken").join(notes, "id", "left")
    kind = F.when(F.col("summary").isNotNull(), F.when(F.col("spoken"), "transcript").otherwise("summary"))
    shown = F.when(F.col("spoken") & (F.col("note.text") != ""), F.col("note"))
    return joined.withColumns({"summaryKind": kind, "aiSummary": shown}).drop("spoken", "note")


def _raisers(bills: DataFrame, people: DataFrame) -> DataFrame:
    """Slugs of sponsors and movers, by id whatever its case, else by name."""
    known = people.select(F.col("ids.aph").alias("person_id"), "slug")
    for kind in ("sponsors", "movers"):
        rows = bills.select(F.col("id").alias("bill_id"), F.posexplode(kind).alias("pos", "raiser"))
        rows = rows.select("bill_id", "pos", "raiser", F.col("raiser.phid").alias("id"), text.slugify(F.col("raiser.name")).alias("name_slug"))
        found = matching.resolve_by_id_then_slug(rows, known)
        entry = F.struct("pos", F.col("raiser.name").alias("name"), F.col("raiser.phid").alias("phid"), F.col("person").alias("slug"))
        lists = found.groupBy("bill_id").agg(F.array_sort(F.collect_list(entry)).alias("found"))
        resolved = F.transform("found", lambda r: F.struct(r["name"].alias("name"), r["phid"].alias("phid"), r["slug"].alias("slug")))
        bills = bills.join(lists, bills["id"] == lists["bill_id"], "left").withColumn(kind, F.coalesce(resolved, F.array().cast(f"array<{schemas.RAISER}>"))).drop("found", "bill_id")
    return bills


def _contests(people: DataFrame, results: DataFrame) -> DataFrame:
    rows = results.select("ord", "eventId", "eventName", "electorateSlug", "electorateName", F.posexplode("firstPrefs").alias("pos", "c"))
    candidates = rows.select(
        text.slugify(F.col("c.name")).alias("name_slug"), F.col("eventId").alias("event_id"), F.struct("ord", "pos").alias("ord"), "eventName", "electorateSlug", "electorateName",
        *[F.col(f"c.{x}").alias(x) for x in ("party", "votes", "pct", "swing", "elected")],
    )
    lists = linking.elections_of_people(candidates, people)
    entry = lambda e: F.struct(e["event_id"].alias("event"), *[e[x].alias(x) for x in ("eventName", "electorateSlug", "electorateName", "party", "votes", "pct", "swing", "elected")])
    return people.drop("elections").join(lists.select("slug", F.transform("elections", entry).alias("elections")), "slug", "left")


def derive(c: Canonical) -> dict[str, DataFrame]:
    """people, parties, electorates, divisions, bills, elections and the search index, each with ``ord``."""
    c = _seated(c)
    divisions = summarised(c.divisions, c.people, c.division_notes)
    bills = _raisers(c.bills, c.people)
    notes = c.person_notes.select("slug", F.when(F.col("note.text") != "", F.col("note")).alias("new_note"))
    book = c.handbook.select("slug", F.col("background").alias("new_background"), F.when(F.size("positions") > 0, F.col("positions")).alias("new_positions"))
    people = c.people.join(notes, "slug", "left").join(book, "slug", "left")
    people = people.withColumns({"aiNote": F.coalesce("new_note", "aiNote"), "background": F.coalesce("new_background", "background"), "positions": F.coalesce("new_positions", "positions")})
    people = _contests(people.drop("new_note", "new_background", "new_positions"), c.elections)

    cast = divisions.select(F.col("id").alias("division"), F.explode("votes").alias("v")).select("division", F.col("v.personSlug").alias("member"), F.col("v.againstGroupMajority").alias("crossed"))
    stats = votes.member_stats(people.select("slug", "house"), cast, divisions.select(F.col("id").alias("division"), "house"))
    stats = stats.select("slug", F.struct(F.col("eligible").alias("divisionsEligible"), F.col("voted").alias("divisionsVoted"), F.col("against").alias("againstGroupMajority")).alias("new_stats"))
    people = people.join(stats, "slug", "left").withColumn("stats", F.col("new_stats")).drop("new_stats")

    named = divisions.select(F.col("id").alias("division"), "ord", F.col("billIds").alias("bill_ids"))
    linked = linking.bill_divisions(bills.withColumnsRenamed({"id": "bill_id", "divisionIds": "division_ids"}), named)
    bills = linked.withColumnsRenamed({"bill_id": "id", "division_ids": "divisionIds"})

    seats = elections.party_seats(people.select(F.col("groupSlug").alias("party"), "group", "house", "ord"), c.party_reference.select(F.col("slug").alias("party"), "name"))
    parties = seats.withColumnRenamed("party", "slug").join(c.party_reference.select("slug", "code", "colour"), "slug", "left").join(c.party_facts, "slug", "left")
    parties = parties.select("slug", "name", "code", "colour", F.struct("representatives", "senate").alias("seats"), "facts", F.col("slug").alias("ord"))

    electorates = c.electorates.drop("profile", "enrolment").join(c.profiles, "slug", "left")
    latest = elections.latest_contest(c.elections, electorates.select(F.col("slug").alias("electorateSlug")), "eventId", "electorateSlug", "ord")
    index = ordering.search_index(
        bills.select(F.col("id").alias("slug"), F.col("title").alias("name"), F.col("status").alias("sub")),
        people.select("slug", "name", F.col("group").alias("sub")),
        electorates.select("slug", "name", F.col("state").alias("sub")),
    )
    return {"people": people, "parties": parties, "electorates": electorates, "divisions": divisions, "bills": bills, "elections": latest, "quick-search": index}


def write(tables: dict[str, DataFrame], root: str) -> None:
    """Bundles in export order, by English collation; divisions newest first."""
    keys = {"people": "slug", "parties": "slug", "electorates": "slug", "bills": "title", "elections": "electorateSlug"}
    for name, key in keys.items():
        files.write_bundle(tables[name], f"{root}/{name}", ordering.collated(key), "ord")
    files.write_bundle(tables["divisions"], f"{root}/divisions", *ordering.newest_first())
    files.write_bundle(tables["quick-search"], f"{root}/quick-search", "rank", ordering.collated("name"), "slug")
