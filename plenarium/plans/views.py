"""Read models over the derived tables; each is one lazily planned query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import dates, rules, text
from ..operators import elections, linking, ordering, votes

Tables = dict[str, DataFrame]


def _votes(t: Tables) -> DataFrame:
    rows = t["divisions"].select(F.col("id").alias("division"), "house", "date", "number", F.col("name").alias("title"), "result", F.posexplode("votes").alias("pos", "v"))
    return rows.select("*", F.col("v.personSlug").alias("member"), F.col("v.vote").alias("vote"), F.coalesce(F.col("v.againstGroupMajority"), F.lit(False)).alias("crossed")).drop("v")


def _last_date(timeline: str) -> Column:
    return F.array_max(F.transform(timeline, lambda s: s["date"]))


def seat_bars(t: Tables) -> DataFrame:
    rows = t["parties"].select(F.col("slug").alias("party"), F.explode(F.create_map(F.lit("representatives"), F.col("seats.representatives"), F.lit("senate"), F.col("seats.senate"))).alias("house", "seats"))
    return elections.seat_bar(rows)


def home_divisions(t: Tables, n: int = 8) -> DataFrame:
    return ordering.divisions_newest_first(t["divisions"]).limit(n)


def home_bills(t: Tables, n: int = 8) -> DataFrame:
    moved = t["bills"].withColumn("moved", _last_date("timeline")).where("moved is not null")
    return moved.orderBy(F.desc("moved"), ordering.collated("title"), "id").limit(n)


def people_index(t: Tables) -> DataFrame:
    found = text.search_text(F.col("name"), F.col("electorate"), F.col("state"))
    seats = t["electorates"].select(F.col("slug").alias("electorate"), F.col("name").alias("seat_name"))
    rows = t["people"].join(seats, "electorate", "left")
    return rows.select("slug", "name", "group", found.alias("search"), rules.seat_descriptor(F.col("house"), text.state_name(F.col("state")), F.col("seat_name")).alias("seat")).orderBy(ordering.collated("name"), "slug")


def person_votes(t: Tables) -> DataFrame:
    """Each member's votes, the first of a division, newest first within a member."""
    first = ordering.first_per_key(_votes(t), ["member", "division"], "pos")
    return first.select("member", "division", "date", "number", "title", "vote", "crossed", "result")


def person_bills(t: Tables) -> DataFrame:
    raisers = None
    for kind, column in (("sponsor", "sponsors"), ("mover", "movers")):
        rows = t["bills"].select(F.col("id").alias("bill_id"), F.explode(column).alias("r")).select(F.col("r.slug").alias("person"), "bill_id", F.lit(kind).alias("kind"))
        raisers = rows if raisers is None else raisers.unionByName(rows)
    return linking.raised_bills(raisers)


def person_background(t: Tables, as_of: Column) -> DataFrame:
    people = t["people"].where("background is not null")
    work = F.transform("background.occupations", lambda o: F.coalesce(text.occupation(o, dates.dotted_date), F.struct(F.lit("").alias("role"), o.alias("org"), F.lit("").alias("period"))))
    study = F.transform("background.qualifications", text.qualification)
    return people.select("slug", work.alias("work"), study.alias("study"), dates.service_years(F.col("background.serviceStart"), as_of).alias("years"))


def divisions_by_month(t: Tables) -> DataFrame:
    return ordering.month_runs(t["divisions"], "date")


def division_page(t: Tables) -> DataFrame:
    """One row a division: label, tier, width of the ayes, page key."""
    return t["divisions"].select(
        "id", text.division_key(F.col("date"), F.col("number")).alias("key"), rules.procedure(F.col("name")).alias("procedure"), text.title_tier(F.col("name")).alias("tier"),
        votes.aye_width(F.col("ayes"), F.col("noes")).alias("width"), dates.format_date(F.col("date")).alias("day"), "result",
    )


def division_groups(t: Tables) -> DataFrame:
    members = t["people"].select(F.col("slug").alias("member"), F.col("group").alias("party"))
    return votes.group_breakdown(_votes(t).select("division", "member", "vote"), members)


def division_votes(t: Tables) -> DataFrame:
    """Votes with a name for each member, made from the slug where there is no person."""
    names = t["people"].select(F.col("slug").alias("member"), "name")
    shown = F.coalesce("name", F.replace("member", F.lit("-"), F.lit(" ")))
    return _votes(t).join(names, "member", "left").select("division", "pos", "member", shown.alias("name"), "vote", "crossed")


def same_day(t: Tables) -> DataFrame:
    return linking.same_day(t["divisions"].select("house", "date", F.col("id").alias("division"), "number"))


def division_bills(t: Tables) -> DataFrame:
    return linking.listed(t["divisions"].withColumnRenamed("id", "division"), "division", "billIds", t["bills"].select(F.col("id").alias("bill_id"), "title"), "bill_id")


def bills_index(t: Tables) -> DataFrame:
    """Latest step first, undated last, title order within."""
    events = F.transform("timeline", lambda s: s["event"])
    rows = t["bills"].withColumn("moved", _last_date("timeline"))
    chosen = rows.select("id", "title", "moved", rules.status_bucket(F.col("status")).alias("bucket"), rules.bill_stage(events, F.col("status"), F.col("chamber")).alias("stage"), text.search_text(F.col("title"), F.col("portfolio")).alias("search"))
    return chosen.orderBy(F.col("moved").desc_nulls_last(), ordering.collated("title"), "id")


def bill_page(t: Tables) -> DataFrame:
    return t["bills"].select("id", "title", text.summary_groups(F.col("summary")).alias("groups"), text.summary_list(F.col("summary")).alias("list"))


def bill_divisions(t: Tables) -> DataFrame:
    return linking.listed(t["bills"].withColumnRenamed("id", "bill_id"), "bill_id", "divisionIds", t["divisions"].select(F.col("id").alias("division"), "date", "number", "result"), "division")


def electorate_page(t: Tables) -> DataFrame:
    """Two-candidate counts of each electorate's latest contest with recomputed shares."""
    rows = t["elections"].select("electorateSlug", F.posexplode("tcp").alias("pos", "c")).select("electorateSlug", "pos", "c.*")
    return elections.two_candidate_shares(rows, "electorateSlug", "votes")


def electorates_index(t: Tables) -> DataFrame:
    members = t["people"].select(F.col("slug").alias("memberSlug"), F.col("name").alias("member"))
    rows = t["electorates"].join(members, "memberSlug", "left")
    return rows.select("slug", "name", "state", "member", text.search_text(F.col("name"), F.col("state"), text.state_name(F.col("state")), F.col("member")).alias("search")).orderBy(ordering.collated("name"), "slug")


def parties_index(t: Tables) -> DataFrame:
    total = F.coalesce("seats.representatives", F.lit(0)) + F.coalesce("seats.senate", F.lit(0))
    return t["parties"].withColumn("total", total).orderBy(F.desc("total"), ordering.collated("name"), "slug")


def party_leaders(t: Tables) -> DataFrame:
    held = t["people"].select(F.col("slug").alias("person"), "groupSlug", "name", F.explode("positions").alias("p")).select("person", "p.*")
    return ordering.leadership(held)


def data_sources(listed: DataFrame, manifest: DataFrame) -> DataFrame:
    """A fixed list of sources with their status where they have run."""
    return listed.join(manifest, "source", "left")


def feed(t: Tables, n: int = 50) -> DataFrame:
    """The ``n`` newest divisions as a feed's entries, in order."""
    rows = ordering.divisions_newest_first(t["divisions"]).limit(n)
    result = F.when(F.col("result") == "passed", "Carried").otherwise("Negatived")
    counts = F.concat(F.col("ayes").cast("string"), F.lit("–"), F.col("noes").cast("string"))
    said = F.concat(F.when(F.col("house") == "senate", "Senate").otherwise("House"), F.lit(" "), counts, F.lit(" · "), result)
    path = F.concat(F.lit("/divisions/"), "house", F.lit("/"), text.division_key(F.col("date"), F.col("number")), F.lit("/"))
    return _entries(rows, ordering.newest_first(), F.col("name"), path, F.col("date"), said)


def bills_feed(t: Tables, n: int = 50) -> DataFrame:
    """The ``n`` bills that moved last as a feed's entries; the last of a day's steps counts, bills of a day stand by title."""
    last = F.array_max(F.transform("timeline", lambda s, i: F.struct(s["date"].alias("date"), i.alias("pos"), s["event"].alias("event"))))
    order = [F.desc("last.date"), ordering.collated("title"), F.col("id")]
    rows = t["bills"].withColumn("last", last).where("last.date is not null").orderBy(*order).limit(n)
    said = F.concat("last.event", F.lit(" · "), "status")
    return _entries(rows, order, F.concat("title", F.lit(" — "), "last.event"), F.concat(F.lit("/bills/"), "id", F.lit("/")), F.col("last.date"), said)


def _entries(rows: DataFrame, order: list[Column], title: Column, path: Column, date: Column, summary: Column) -> DataFrame:
    """id, nth, title, path, updated, summary; ``rows`` are as few as a feed has entries, so one task numbers them."""
    nth = F.row_number().over(Window.orderBy(*order))
    return rows.select("id", nth.alias("nth"), title.alias("title"), path.alias("path"), dates.feed_timestamp(date).alias("updated"), summary.alias("summary")).orderBy("nth")


def feed_text(entries: DataFrame, origin: str, title: str, index_path: str, author: str) -> DataFrame:
    """One row, xml: the Atom text of ``entries``; that of none is dated to 1970."""
    origin = F.lit(origin.rstrip("/"))
    tag = lambda name, *inner: F.concat(F.lit(f"<{name}>"), *inner, F.lit(f"</{name}>"))
    link = lambda url, rel="": F.concat(F.lit(f"<link {rel}href=\""), text.escape_attribute(url), F.lit("\"/>"))
    url = F.concat(origin, "path")
    entry = tag("entry", tag("title", text.escape_html(F.col("title"))), link(url), tag("id", text.escape_html(url)), tag("updated", F.col("updated")), tag("summary", text.escape_html(F.col("summary"))))
    # No more than a feed's entries.
    all_of = entries.agg(F.array_sort(F.collect_list(F.struct("nth", entry.alias("xml")))).alias("all"), F.min_by("updated", "nth").alias("updated"))
    index, own = F.concat(origin, F.lit(index_path)), F.concat(origin, F.lit(f"{index_path}feed.xml"))
    head = [tag("title", text.escape_html(F.lit(title))), link(own, 'rel="self" '), link(index), tag("id", text.escape_html(own)), tag("updated", F.coalesce("updated", F.lit("1970-01-01T00:00:00Z"))), tag("author", tag("name", text.escape_html(F.lit(author))))]
    opening = F.lit('<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom">')
    return all_of.select(F.concat(opening, *head, F.array_join(F.transform("all", lambda e: e["xml"]), ""), F.lit("</feed>")).alias("xml"))


def sitemap(urls: DataFrame) -> DataFrame:
    """Urls in natural order; ``urls``: url, lastmod, which may be null."""
    return urls.orderBy(text.natural_key(F.col("url")), "url")


def sitemap_index(urls: DataFrame) -> DataFrame:
    """One row: the latest of all lastmods, which the index gives for the map."""
    return urls.agg(F.max("lastmod").alias("lastmod"), F.count("*").alias("urls"))


def bill_rows(t: Tables) -> DataFrame:
    """What a bill's line in a list shows: title, stage, status bucket, its last step and that step's day."""
    last = F.array_max(F.transform("timeline", lambda s, i: F.struct(s["date"].alias("date"), i.alias("pos"), s["event"].alias("event"))))
    rows = t["bills"].withColumn("last", last)
    events = F.transform("timeline", lambda s: s["event"])
    return rows.select("id", "title", rules.bill_stage(events, F.col("status"), F.col("chamber")).alias("stage"), rules.status_bucket(F.col("status")).alias("bucket"), text.event_description(F.col("last.event")).alias("step"), dates.short_date(F.col("last.date")).alias("day"))


def ledger_rows(t: Tables) -> DataFrame:
    """What a division's line in a list shows, with the month it stands under."""
    rows = t["divisions"].select("id", dates.month_label(F.coalesce(F.substring("date", 1, 7), F.lit("undated"))).alias("month"), dates.short_date(F.col("date")).alias("day"), "number", F.col("name").alias("title"), rules.procedure(F.col("name")).alias("procedure"), "house", "result", "ayes", "noes")
    return rows.withColumn("width", votes.aye_width(F.col("ayes"), F.col("noes")))


def person_cards(t: Tables) -> DataFrame:
    """What a person's card shows: initials stand for a missing photo."""
    rows = people_index(t).select("slug", "name", "group", "seat")
    photos = t["people"].select("slug", F.col("photo.thumb").alias("thumb"))
    return rows.join(photos, "slug", "left").withColumn("initials", F.when(F.col("thumb").isNull(), text.initials(F.col("name"))))


def word_index(pages: DataFrame, key: str, body: str) -> DataFrame:
    """word, and how many pages hold it."""
    words = pages.select(key, F.explode(F.split(F.lower(body), r"[^\p{L}\p{N}]+")).alias("word")).where("word <> ''").distinct()
    return words.groupBy("word").agg(F.count("*").alias("n"))
