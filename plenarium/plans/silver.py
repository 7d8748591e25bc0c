"""Raw extracts to canonical tables; each function takes and gives DataFrames.

Arrays in the raw rows stay arrays where order matters, so a row is one entity throughout
and the only shuffles are those of joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers, rules, text
from ..operators import elections, matching, ordering, votes

PERSON_RAW = "id bigint, latest_member struct<name: struct<first: string, last: string>, electorate: string, house: string, party: string>"
DIVISION_RAW = (
    "id bigint, house string, date string, number bigint, name string, aye_votes bigint, no_votes bigint, summary string, "
    "votes array<struct<member: struct<person: struct<id: bigint>, first_name: string, last_name: string, party: string>, vote: string>>, "
    "bills array<struct<id: bigint, title: string, official_id: string>>"
)
BILL_RAW = "Id string, Title string, FormattedOriginatingChamber string, Status string, Summary string, LastUpdatedDateTime string"
_RAISER = "array<struct<DisplayName: string, Id: string>>"
DETAIL_RAW = (
    f"Id string, Bill struct<ParlInfoUrl: string, Sponsors: {_RAISER}, Movers: {_RAISER}, "
    "GroupedProgressStates: array<struct<FormattedChamber: string, ProgressStates: array<struct<Description: string, UpdateDate: string>>>>>"
)
# Ids of the two offices, and what they are a seat of.
HOUSES = {"Q18912794": "representatives", "Q6814428": "senate"}
INDEPENDENT = "Independent"


def divisions(raw: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Canonical divisions; ``crosswalk``: person_id, slug, ord.

    ``official_id`` is read as text, whether it was a string or a number; without one the
    internal id stands.  Sides follow the source's own party label.
    """
    key = F.concat_ws("/", "house", "date", F.col("number").cast("string"))
    rows = raw.withColumn("division", key)
    # Slugs of names are made only for votes whose id isn't known.
    cast = rows.select("division", F.posexplode("votes").alias("pos", "v")).select(
        "division", "pos", F.col("v.member.person.id").alias("person_id"), F.col("v.member.party").alias("party"), F.col("v.vote").alias("vote"),
        F.concat_ws(" ", "v.member.first_name", "v.member.last_name").alias("name"),
    )
    marked = votes.crossed_together(matching.crosswalk(cast, crosswalk, text.slugify(F.col("name"))).drop("name"))
    entry = F.struct("pos", F.col("member").alias("personSlug"), "vote", F.lit(None).cast("boolean").alias("teller"), F.col("crossed").alias("againstGroupMajority"))
    lists = marked.groupBy("division").agg(F.sort_array(F.collect_list(entry)).alias("cast"))
    ballots = F.transform(F.coalesce("cast", F.array().cast(lists.schema["cast"].dataType)), lambda v: v.dropFields("pos"))
    bills = F.transform(F.coalesce("bills", F.array().cast("array<struct<id: bigint, title: string, official_id: string>>")), lambda b: F.coalesce(b["official_id"], b["id"].cast("string")))
    return rows.drop("votes").join(lists, "division", "left").select(
        F.col("division").alias("id"), "house", "date", "number", "name", text.non_empty(F.trim("summary")).alias("summary"),
        F.when(F.col("aye_votes") > F.col("no_votes"), "passed").otherwise("rejected").alias("result"), F.col("aye_votes").alias("ayes"), F.col("no_votes").alias("noes"),
        bills.alias("billIds"), ballots.alias("votes"),
    )


def person_crosswalk(raw_people: DataFrame, people: DataFrame) -> DataFrame:
    """person_id, slug, ord of the vote source's people found among ``people``."""
    name = F.concat_ws(" ", "latest_member.name.first", "latest_member.name.last")
    seat = F.col("latest_member.electorate")
    sources = raw_people.select(F.col("id").alias("source_id"), text.slugify(name).alias("name_slug"), F.col("latest_member.house").alias("house"), text.slugify(seat).alias("seat"), text.state_code(seat).alias("state"))
    known = people.select("slug", text.slugify(F.col("name")).alias("name_slug"), "house", F.col("electorate").alias("seat"), "state", "ord")
    found = matching.match_name_then_seat(sources, known)
    return found.select(F.col("source_id").alias("person_id"), "slug", F.col("source_id").alias("ord"))


def bills(raw: DataFrame, parliament: int) -> DataFrame:
    status = F.coalesce(text.strip_html(text.non_empty(F.col("Status"))), F.lit("Before parliament"))
    return raw.select(
        F.coalesce("Id", F.lit("")).alias("id"), F.coalesce(text.strip_html(F.col("Title")), F.lit("")).alias("title"), F.lit(parliament).cast("long").alias("parliament"),
        rules.chamber_of(F.coalesce("FormattedOriginatingChamber", F.lit(""))).alias("chamber"), text.strip_html(text.non_empty(F.col("Summary"))).alias("summary"), status.alias("status"),
        F.col("LastUpdatedDateTime").alias("listUpdated"),
    )


def bill_timeline(detail: Column) -> Column:
    """Dated, described steps of all groups by date; steps of one day stay in their order."""

    def steps(group: Column) -> Column:
        chamber = text.non_empty(group["FormattedChamber"])
        return F.transform(
            F.coalesce(group["ProgressStates"], F.array().cast("array<struct<Description: string, UpdateDate: string>>")),
            lambda s: F.struct(dates.dot_net_date(s["UpdateDate"]).alias("date"), F.when(s["Description"] != "", text.strip_html(F.concat(s["Description"], F.coalesce(F.concat(F.lit(" ("), chamber, F.lit(")")), F.lit(""))))).alias("event")),
        )

    groups = F.coalesce(detail["GroupedProgressStates"], F.array().cast("array<struct<FormattedChamber: string, ProgressStates: array<struct<Description: string, UpdateDate: string>>>>"))
    dated = F.filter(F.flatten(F.transform(groups, steps)), lambda s: s["date"].isNotNull() & s["event"].isNotNull())
    placed = F.transform(dated, lambda s, i: F.struct(s["date"].alias("date"), i.alias("pos"), s["event"].alias("event")))
    return F.transform(F.array_sort(placed), lambda s: F.struct(s["date"].alias("date"), s["event"].alias("event")))


def bill_raisers(people: Column) -> Column:
    rows = F.coalesce(people, F.array().cast(_RAISER))
    named = F.transform(rows, lambda p: F.struct(text.raiser_name(text.strip_html(F.coalesce(p["DisplayName"], F.lit("")))).alias("name"), text.non_empty(p["Id"]).alias("phid"), F.lit(None).cast("string").alias("slug")))
    return F.filter(named, lambda r: r["name"] != "")


def with_detail(listed: DataFrame, details: DataFrame) -> DataFrame:
    """Bills with timeline, raisers and the detail's link; bills without a detail keep empty lists."""
    found = details.select(F.col("Id").alias("id"), bill_timeline(F.col("Bill")).alias("timeline"), bill_raisers(F.col("Bill.Sponsors")).alias("sponsors"), bill_raisers(F.col("Bill.Movers")).alias("movers"), text.non_empty(F.col("Bill.ParlInfoUrl")).alias("parlinfo"))
    joined = listed.join(found, "id", "left")
    empty = {c: F.coalesce(c, F.array().cast(found.schema[c].dataType)) for c in ("timeline", "sponsors", "movers")}
    return joined.withColumns(empty)


def has_entity(bill: DataFrame) -> Column:
    """Whether an HTML entity is left in a bill's texts."""
    entity = r"&(#\d+|#x[0-9a-fA-F]+|[A-Za-z]+);"
    lists = F.concat(F.transform("timeline", lambda s: s["event"]), F.transform("sponsors", lambda r: r["name"]), F.transform("movers", lambda r: r["name"]))
    return F.exists(F.array_compact(F.concat(F.array("title", "status", "summary"), lists)), lambda x: x.rlike(entity))


def members(bindings: DataFrame) -> DataFrame:
    """One open seat a person, the latest by start; ``bindings``: ord, person, personLabel, houseQ, partyLabel, electorateLabel, img, start, article."""
    house = None
    for q, name in HOUSES.items():
        here = text.last_segment(F.col("houseQ")) == q
        house = F.when(here, name) if house is None else house.when(here, name)
    file = text.decode_component(F.substring_index("img", "/Special:FilePath/", -1))
    rows = bindings.where("person is not null and personLabel is not null").withColumns({"house": house, "from": F.coalesce("start", F.lit(""))}).where("house is not null")
    latest = ordering.latest_open(rows, "person", "from", ["ord"])
    first = rows.groupBy("person").agg(F.min("ord").alias("first_ord"))
    return latest.join(first, "person").select(
        F.col("first_ord").alias("ord"), text.last_segment(F.col("person")).alias("wikidata"), F.col("personLabel").alias("name"), "house", F.col("partyLabel").alias("group"),
        F.col("electorateLabel").alias("district"), file.alias("commonsFile"), text.non_empty(F.col("from")).alias("since"), F.col("article").alias("wikipedia"),
    )


def people(rows: DataFrame, licences: DataFrame) -> DataFrame:
    """People from members; ``licences``: commonsFile, licence, attribution.  Photos need a free licence."""
    named = rows.withColumns({"plain": text.slugify(F.col("name")), "extra": text.slugify(F.coalesce("district", "house"))})
    keyed = matching.unique_slugs(named, "plain", "extra", ["ord"]).join(licences, "commonsFile", "left")
    free = F.col("licence").rlike(rules.FREE_LICENCE)
    group = F.coalesce("group", F.lit(INDEPENDENT))
    senator = F.col("house") == "senate"
    return keyed.select(
        F.col("unique_slug").alias("slug"), "name", "house", F.when(senator, text.as_state(F.col("district"))).alias("state"), F.when(~senator, text.slugify(F.col("district"))).alias("electorate"),
        group.alias("group"), text.slugify(group).alias("groupSlug"), F.substring("since", 1, 10).alias("since"), "wikidata",
        F.when(free, F.struct("commonsFile", "licence", "attribution")).alias("photo"), "wikipedia", "ord",
    )


def position(role: Column, kind: str) -> Column:
    """A role record as a position: its parts joined, open ends and placeholders as null."""
    words = F.concat_ws(" ", *[text.non_empty(role[c]) for c in ("Role", "Prep", "Entity")])
    return F.struct(F.trim(words).alias("role"), text.non_empty(role["Ministry"]).alias("ministry"), F.lit(kind).alias("kind"), dates.clean_date(role["RDateStart"]).alias("from"), dates.clean_date(role["RDateEnd"]).alias("to"))


def positions(ministries: Column, shadows: Column, parliamentary: Column) -> Column:
    """Three lists as one, latest start first, the three in that order on ties."""
    plain = F.transform(parliamentary, lambda r: F.struct(r.alias("role"), F.lit(None).cast("string").alias("ministry"), F.lit("position").alias("kind"), F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("to")))
    every = F.concat(F.transform(ministries, lambda r: position(r, "ministry")), F.transform(shadows, lambda r: position(r, "shadow")), plain)
    placed = F.transform(every, lambda p, i: F.struct(F.coalesce(p["from"], F.lit("")).alias("start"), i.alias("pos"), p.alias("p")))
    newest = F.array_sort(placed, lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).otherwise(a["pos"] - b["pos"]))
    return F.transform(newest, lambda x: x["p"])


def birthplace(place: Column, state: Column, country: Column) -> Column:
    return text.non_empty(F.concat_ws(", ", text.non_empty(place), F.coalesce(text.non_empty(state), text.non_empty(country))))


def _candidate() -> dict[str, Column]:
    """What a row of a count's CSV says about a candidate, but for the share of votes."""
    swing = F.when(F.coalesce("Swing", F.lit("")) != "", numbers.number_of(F.col("Swing")))
    return {
        "name": text.title_case(F.trim(F.concat_ws(" ", "GivenNm", "Surname"))), "party": F.coalesce(text.non_empty(F.col("PartyNm")), F.lit(INDEPENDENT)),
        "partyCode": text.non_empty(F.col("PartyAb")), "votes": numbers.count_of(F.col("TotalVotes")), "swing": swing, "elected": F.coalesce(F.col("Elected") == "Y", F.lit(False)),
    }


_ENTRY = ["name", "party", "partyCode", "votes", "pct", "swing", "elected"]


def candidates(rows: DataFrame) -> DataFrame:
    """Candidates of each electorate, most votes first; ``rows``: the columns of the count's CSV and ord.

    A blank count is 0; blank party, code and swing are Independent, null and null.
    """
    counted = rows.withColumn("count", numbers.number_of(F.coalesce("TotalVotes", F.lit("0"))))
    own = {**_candidate(), "pct": F.col("pct")}
    shared = elections.candidate_shares(counted, "DivisionNm", "count")
    return shared.select(F.col("DivisionNm").alias("electorateName"), text.slugify(F.col("DivisionNm")).alias("electorateSlug"), F.col("StateAb").alias("state"), *[own[c].alias(c) for c in _ENTRY], "ord")


def contests(rows: DataFrame) -> DataFrame:
    """One row an electorate with its candidates, most votes first, ties in file order; its state is the last row's."""
    entry = F.struct((-F.col("votes")).alias("down"), "ord", "name", "party", "partyCode", "votes", "pct", "swing", "elected")
    lists = rows.groupBy("electorateSlug", "electorateName").agg(F.array_sort(F.collect_list(entry)).alias("c"), F.max_by("state", "ord").alias("state"))
    return lists.select("electorateSlug", "electorateName", "state", F.transform("c", lambda x: x.dropFields("down", "ord")).alias("firstPrefs"))


def seat_contests(rows: DataFrame) -> DataFrame:
    """``contests`` of ``candidates``, whose ``rows`` are read once.

    An electorate's total is summed as its candidates are gathered, and its slug is made once.
    """
    own = {**_candidate(), "count": numbers.number_of(F.coalesce("TotalVotes", F.lit("0")))}
    entry = F.struct((-F.col("votes")).alias("down"), "ord", *own)
    plain = rows.select("DivisionNm", F.col("StateAb").alias("state"), "ord", *[c.alias(name) for name, c in own.items()])
    lists = plain.groupBy("DivisionNm").agg(F.sort_array(F.collect_list(entry)).alias("c"), F.max_by("state", "ord").alias("state"), F.sum("count").alias("total"))
    shown = lambda x: F.struct(*[(elections.percentage(x["count"], F.col("total")) if c == "pct" else x[c]).alias(c) for c in _ENTRY])
    return lists.select(text.slugify(F.col("DivisionNm")).alias("electorateSlug"), F.col("DivisionNm").alias("electorateName"), "state", F.transform("c", shown).alias("firstPrefs"))


def enrolment(rows: DataFrame) -> DataFrame:
    """name, enrolment: by lower-cased electorate, the first of two columns, above 0."""
    first = lambda c: F.col(c).try_cast("bigint") if c in rows.columns else F.lit(None).cast("bigint")
    return rows.select(F.lower("DivisionNm").alias("name"), F.coalesce(first("Enrolment"), first("CloseOfRollsEnrolment")).alias("enrolment")).where("name <> '' and enrolment > 0")


def checked_states(rows: DataFrame, column: str = "state") -> DataFrame:
    """``rows``; a state that isn't one of the eight codes fails the job."""
    known = F.col(column).isin(list(text.STATES))
    return rows.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown state "), F.coalesce(column, F.lit("null"))))))
