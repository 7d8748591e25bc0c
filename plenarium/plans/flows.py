"""Whole jobs from raw extracts to side tables: elections, seats, biographies, profiles, notes, repairs.

Each takes and gives DataFrames.  What a job stores, keeps or asks for again is a column
(``status``) or a table, so that the caller writes it with one of the writers.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, rules, text
from ..operators import elections, linking, matching, votes
from ..streaming import incremental
from . import silver

# Facts of a seat's page by their labels there.
PROFILE_LABELS = {
    "nameDerivation": "name derivation", "location": "location description", "area": "area", "gazetted": "date this name and boundary was gazetted",
    "firstContested": "first election this name was used at", "demographic": "demographic rating",
}
#: Versions of what is asked for; another version asks again.
NOTE_VERSION, LEAST_VOTES, EXCERPT = 1, 10, 2200
_COUNT = ["StateAb", "DivisionNm", "CandidateID", "Surname", "GivenNm", "PartyNm", "PartyAb", "Swing", "Elected"]


def candidate_counts(rows: DataFrame, by_places: bool) -> DataFrame:
    """One row a candidate with TotalVotes; ``rows`` has the columns of a count's CSV, all strings, and ord.

    ``by_places``: counts of polling places (OrdinaryVotes), summed for each candidate; what
    else a candidate has is that of the first place.
    """
    has = {c: F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in _COUNT}
    if not by_places:
        return rows.select(*has.values(), "TotalVotes", "ord")
    counted = rows.select(*has.values(), numbers.count_of(F.col("OrdinaryVotes")).alias("n"), "ord")
    first = [c for c in _COUNT if c != "CandidateID"]
    totals = elections.polling_place_totals(counted, "CandidateID", "n", ["ord"], [*first, "ord"])
    return totals.withColumn("TotalVotes", F.col("votes").cast("string")).drop("votes")


def event_results(event: str, first_preferences: DataFrame, two_candidates: DataFrame) -> DataFrame:
    """eventId, eventName, electorateSlug, electorateName, state, firstPrefs, tcp: an election's seats.

    Events held in single seats publish polling places, which are summed.  Seats come from
    the first preferences; one without a two-candidate count has an empty list.  A state that
    isn't one of the codes fails the job.
    """
    by_places = event in rules.BY_ELECTIONS
    firsts = silver.seat_contests(candidate_counts(first_preferences, by_places))
    pairs = silver.seat_contests(candidate_counts(two_candidates, by_places)).select("electorateName", F.col("firstPrefs").alias("tcp"))
    # By name, of which either has one row, so that nothing counts twice and a result that isn't asked for isn't made.
    named = silver.checked_states(firsts).join(pairs, "electorateName", "left")
    none = F.array().cast(pairs.schema["tcp"].dataType)
    return named.select(F.lit(event).alias("eventId"), rules.event_name(F.lit(event)).alias("eventName"), "electorateSlug", "electorateName", "state", "firstPrefs", F.coalesce("tcp", none).alias("tcp"))


def seats_of(results: DataFrame) -> DataFrame:
    """slug, name, state of the seats that the one defining event has; other events only add results."""
    return results.where(F.col("eventId") == rules.SEAT_EVENT).select(F.col("electorateSlug").alias("slug"), F.col("electorateName").alias("name"), "state").distinct()


def profile_url(base: str, seats: DataFrame) -> DataFrame:
    """``seats`` with the address of each one's page."""
    return seats.withColumn("url", F.concat(F.lit(f"{base}/profiles/"), text.state_path(F.col("state")), F.lit("/"), "slug", F.lit(".htm")))


def seat_profiles(seats: DataFrame, pages: DataFrame, enrolment: DataFrame | None) -> DataFrame:
    """slug, profile, enrolment, status: six named facts of each seat's page, and its enrolment.

    ``seats``: slug, name, state; ``pages``: slug, html (null: not fetched, so failed);
    ``enrolment``: name in lower case, enrolment, or None where it couldn't be fetched, which
    leaves it unknown.
    """
    found = seats.join(pages.select("slug", "html"), "slug", "left").withColumn("facts", text.label_values(F.col("html")))
    facts = F.struct(*[F.try_element_at("facts", F.lit(label)).alias(name) for name, label in PROFILE_LABELS.items()])
    rows = found.withColumn("profile", F.when(F.col("html").isNotNull(), facts))
    if enrolment is None:
        rows = rows.withColumn("enrolment", F.lit(None).cast("bigint"))
    else:
        counts = enrolment.groupBy(F.col("name").alias("low_name")).agg(F.max("enrolment").alias("enrolment"))
        rows = rows.join(counts, F.lower(rows["name"]) == counts["low_name"], "left")
    return rows.select("slug", "profile", "enrolment", F.when(F.col("html").isNull(), "failed").otherwise("fetched").alias("status"))


def handbook_matches(individuals: DataFrame, people: DataFrame) -> DataFrame:
    """PHID, slug of the individuals who are known people; of several for one person the last by PHID.

    ``individuals``: PHID, GivenName, PreferredName, FamilyName, Electorate, StateAbbrev;
    ``people``: slug, name, electorate, state, ord.
    """
    slug_of = lambda given: text.non_empty(text.slugify(F.concat_ws(" ", given, F.coalesce("FamilyName", F.lit("")))))
    preferred = text.preferred_name(F.coalesce("PreferredName", F.lit("")))
    sources = individuals.where("PHID <> ''").select(
        F.col("PHID").alias("source_id"), slug_of(F.coalesce("GivenName", F.lit(""))).alias("given_slug"), F.when(preferred != "", slug_of(preferred)).alias("preferred_slug"),
        text.slugify(F.coalesce("FamilyName", F.lit(""))).alias("family_slug"), text.slugify(F.coalesce("Electorate", F.lit(""))).alias("seat"), F.upper(F.coalesce("StateAbbrev", F.lit(""))).alias("state"),
    )
    known = people.select("slug", text.slugify(F.col("name")).alias("name_slug"), F.col("electorate").alias("seat"), "state", "ord")
    found = matching.match_slug_then_family(sources, known)
    return found.groupBy("slug").agg(F.max("source_id").alias("PHID"))


def handbook_profiles(individuals: DataFrame, ministries: DataFrame, shadows: DataFrame, matches: DataFrame) -> DataFrame:
    """slug, phid, background, positions of matched individuals.

    ``ministries`` and ``shadows``: PHID, pos and a role's columns; they are listed in order.
    """
    role = ["Role", "Prep", "Entity", "Ministry", "RDateStart", "RDateEnd"]

    def lists(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("PHID").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", *role))), lambda r: F.struct(*[r[c].alias(c) for c in role])).alias(name))

    rows = individuals.join(matches, "PHID").join(lists(ministries, "m"), "PHID", "left").join(lists(shadows, "s"), "PHID", "left")
    none = lambda c: F.coalesce(c, F.array().cast(rows.schema[c].dataType))
    texts = F.array().cast("array<string>")
    background = F.struct(
        text.non_empty(F.col("DateOfBirth")).alias("born"), silver.birthplace(F.col("PlaceOfBirth"), F.col("StateOfBirth"), F.col("CountryOfBirth")).alias("birthplace"),
        F.coalesce("Occupations", texts).alias("occupations"), F.coalesce("Qualifications", texts).alias("qualifications"), F.coalesce("Honours", texts).alias("honours"),
        text.non_empty(F.col("ServiceHistory_Start")).alias("serviceStart"), F.coalesce("RepresentedParliaments", F.array().cast("array<bigint>")).alias("parliaments"),
    )
    return rows.select("slug", F.col("PHID").alias("phid"), background.alias("background"), silver.positions(none("m"), none("s"), F.coalesce("ParliamentaryPositions", texts)).alias("positions"))


def with_handbook_ids(people: DataFrame, matches: DataFrame) -> DataFrame:
    """``people`` with the matched id as their parliamentary one."""
    joined = people.join(matches.select("slug", F.col("PHID").alias("phid")), "slug", "left")
    return joined.withColumn("ids", F.col("ids").withField("aph", F.coalesce("phid", "ids.aph"))).drop("phid")


def party_groups(people: DataFrame) -> DataFrame:
    """slug, name of the groups that people belong to, without independents; the last person's name of a group counts."""
    return people.where("groupSlug <> 'independent'").groupBy(F.col("groupSlug").alias("slug")).agg(F.max_by("group", "ord").alias("name"))


def party_facts(bindings: DataFrame, groups: DataFrame) -> DataFrame:
    """slug, facts: the first answer for each known group; ``bindings``: ord, label, inception, website, article."""
    rows = bindings.where("label is not null").withColumn("slug", text.slugify(F.col("label"))).join(groups.select("slug"), "slug", "left_semi")
    facts = F.struct(F.substring("inception", 1, 10).alias("founded"), "website", F.col("article").alias("wikipedia"))
    return rows.groupBy("slug").agg(F.min_by(facts, "ord").alias("facts"))


def rebuild_divisions(raw_divisions: DataFrame, raw_people: DataFrame, people: DataFrame) -> DataFrame:
    """Canonical divisions of every stored raw one, without asking its source again.

    Without the raw people there is nobody to name the votes by: an error.
    """
    if raw_people.isEmpty():
        raise ValueError("the raw people are missing: fetch them before rebuilding")
    return silver.divisions(raw_divisions, silver.person_crosswalk(raw_people, people))


def healed_bills(stored: DataFrame, raw_list: DataFrame, raw_details: DataFrame, parliament: int) -> DataFrame:
    """Stored bills whose fields are missing or still hold entities, made again from their raw records."""
    broken = stored.where(silver.has_entity(stored) | F.col("sponsors").isNull() | F.col("movers").isNull() | F.col("listUpdated").isNull()).select("id")
    fresh = silver.with_detail(silver.bills(raw_list, parliament), raw_details)
    return fresh.join(broken, "id", "left_semi")


@dataclass
class Meta:
    """What the bundle says about its making."""

    generated_at: str
    sample: bool
    sources: DataFrame


def freshness(manifest: DataFrame, labels: DataFrame, generated_at: str) -> DataFrame:
    """line, ok, shown: the state of each source by name, then when all was built; ``labels``: source, label."""
    rows = manifest.join(labels, "source", "left").select(F.coalesce("label", "source").alias("name"), F.col("source"), "ok", dates.format_date(F.substring("lastSync", 1, 10)).alias("day"))
    own = rows.select(F.lit(0).alias("rank"), "source", "ok", F.concat_ws(" · ", "name", "day").alias("shown"))
    built = manifest.sparkSession.createDataFrame([(1, "", True, generated_at)], "rank int, source string, ok boolean, at string")
    built = built.select("rank", "source", "ok", F.concat(F.lit("built "), dates.format_date(F.substring("at", 1, 10))).alias("shown"))
    return own.unionByName(built)


def due_person_notes(people: DataFrame, ballots: DataFrame, notes: DataFrame, least: int = LEAST_VOTES) -> DataFrame:
    """slug, voted, crossed of people whose note is missing, of another version or of another number of votes.

    ``people``: slug; ``ballots``: member, crossed; ``notes``: slug, version, considered.
    People with fewer than ``least`` votes have no note.
    """
    records = votes.voting_records(ballots, least).withColumnRenamed("member", "slug")
    counted = people.select("slug").join(records, "slug").withColumn("considered", F.col("voted"))
    return incremental.pending(counted, notes, "slug", NOTE_VERSION, "considered").drop("considered")


def person_prompts(due: DataFrame, people: DataFrame, ballots: DataFrame, divisions: DataFrame) -> DataFrame:
    """slug, head, lines: the counts of each due person and every vote by division, as material for a note.

    ``ballots``: member, division, vote, crossed; ``divisions``: division, house, date, name, ord.
    """
    totals = votes.chamber_totals(divisions)
    cast = ballots.join(divisions.select("division", "date", "name", "ord"), "division")
    line = F.concat_ws(" | ", "date", "name", F.concat(F.lit("voted "), "vote"), F.when(F.coalesce("crossed", F.lit(False)), "crossed"))
    lines = cast.groupBy(F.col("member").alias("slug")).agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))["line"], "\n").alias("lines"))
    house = F.when(F.col("house") == "senate", "Senate").otherwise("House of Representatives")
    rows = due.join(people.select("slug", "name", "group", "house"), "slug").join(totals, "house").join(lines, "slug")
    counts = F.concat(F.lit("voted in "), "voted", F.lit(" of "), "total", F.lit("; crossed "), "crossed")
    return rows.select("slug", F.concat(F.col("name"), F.lit(" ("), "group", F.lit("), "), house, F.lit(": "), counts).alias("head"), "lines")


def division_prompts(divisions: DataFrame, bills: DataFrame, summary: Column | None = None) -> DataFrame:
    """division, head, bills, ledger, excerpt: what a division's note may draw on.

    ``divisions``: division, house, date, number, name, summary, bill_ids; ``bills``:
    bill_id, title, summary.  The excerpt holds so many UTF-16 units.  It travels with its
    division, cut; a ``summary`` made of the first five columns stands for the column and
    is made where its division has arrived.
    """
    excerpt = lambda said: text.utf16_slice(F.coalesce(said, F.lit("")), EXCERPT).alias("excerpt")
    cut = [excerpt(F.col("summary"))] if summary is None else []
    said = F.concat(F.lit("- "), "title", F.lit(": "), F.coalesce("summary", F.lit("no official summary")))
    related = linking.listed(divisions, "division", "bill_ids", bills.select("bill_id", said.alias("line")), "bill_id")
    related = related.groupBy("division").agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line")))["line"], "\n").alias("bills"))
    head = F.concat(F.col("name"), F.lit(" (division "), F.col("number").cast("string"), F.lit(" of "), "date", F.lit(", "), F.when(F.col("house") == "senate", "Senate").otherwise("House of Representatives"), F.lit(")"))
    rows = divisions.select("division", "house", "date", "number", "name", *cut).join(related, "division", "left")
    line = F.concat(F.lit("- (division "), F.col("number").cast("string"), F.lit(") "), F.col("name"))
    return linking.with_day_ledgers(rows, line, "\n").select("division", head.alias("head"), F.coalesce("bills", F.lit("")).alias("bills"), F.coalesce("ledger", F.lit("")).alias("ledger"), F.col("excerpt") if summary is None else excerpt(summary))


def merged_notes(stored: DataFrame, answers: DataFrame, model: str, at: Column | str, version: int = NOTE_VERSION, keep_empty: bool = False) -> DataFrame:
    """The side table of notes after a run: new answers replace what was stored, other notes stay.

    ``stored``: id, text, model, generatedAt, version; ``answers``: id, text.  An empty answer
    is a decision for bills (``keep_empty``) and none for divisions and people.
    """
    new = answers if keep_empty else answers.where("text <> ''")
    fresh = new.select("id", "text", F.lit(model).alias("model"), (F.lit(at) if isinstance(at, str) else at).alias("generatedAt"), F.lit(version).alias("version"))
    return incremental.upsert(stored.select(*fresh.columns), fresh, ["id"], "generatedAt")
