"""Queries of the read models, the jobs and the readers over the driver's tables, with their SQL.

People are suppliers, seats nations, parties regions, divisions orders with their lines as
votes, bills parts with their lines as steps.  What a reader is to read is written first, from
the table that the SQL reads.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import dates, numbers, text
from ..operators import elections, linking, ordering, substrings, text_index, votes
from ..sources import files, requests
from ..sources.published import Table
from ..sources.work import work_folder
from ..streaming import incremental
from . import flows, gold, note_runs, silver, views
from .queries import query, t

_STATES = "(['NSW', 'VIC', 'QLD', 'WA', 'SA'])[n_regionkey + 1]"
_state = lambda: F.get(F.array(*[F.lit(x) for x in ("NSW", "VIC", "QLD", "WA", "SA")]), F.col("n_regionkey"))
_day = lambda c: F.date_format(c, "yyyy-MM-dd")
_none = lambda kind: F.lit(None).cast(kind)


def _people(spark: SparkSession, sf: str) -> DataFrame:
    rows = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    senator = F.col("s_acctbal") < 3000
    roles = F.array(F.struct(F.when(senator, "Chief Whip").otherwise("Member of a committee").alias("role"), _none("string").alias("ministry"), F.lit("position").alias("kind"), F.lit("2020-01-01").alias("from"), _none("string").alias("to")))
    return rows.select(
        F.concat(F.lit("p"), "s_suppkey").alias("slug"), F.col("s_name").alias("name"), F.when(senator, "senate").otherwise("representatives").alias("house"),
        F.when(senator, _state()).alias("state"), F.when(~senator, F.lower("n_name")).alias("electorate"), F.col("r_name").alias("group"), F.lower("r_name").alias("groupSlug"),
        roles.alias("positions"), F.struct(_none("string").alias("thumb")).alias("photo"), F.col("s_suppkey").alias("ord"),
    )


PEOPLE = f"""people AS (
  SELECT 'p' || s_suppkey AS slug, s_name AS name, CASE WHEN s_acctbal < 3000 THEN 'senate' ELSE 'representatives' END AS house,
    CASE WHEN s_acctbal < 3000 THEN {_STATES} END AS state, CASE WHEN s_acctbal >= 3000 THEN lower(n_name) END AS electorate, r_name AS grp, s_suppkey AS ord
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)"""


def _electorates(spark: SparkSession, sf: str) -> DataFrame:
    holder = _people(spark, sf).where("electorate is not null").groupBy(F.col("electorate").alias("slug")).agg(F.max_by("slug", "ord").alias("memberSlug"))
    seats = t(spark, sf, "nation").select(F.lower("n_name").alias("slug"), F.col("n_name").alias("name"), _state().alias("state"))
    return seats.join(holder, "slug", "left")


def _ballots(spark: SparkSession, sf: str) -> DataFrame:
    """division, pos, member, party, vote: a line is a vote; lines that repeat a place are told apart by all that they hold."""
    rows = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("division"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus").alias("pos"), F.concat(F.lit("p"), "l_suppkey").alias("member"), F.when(F.col("l_linestatus") == "O", "aye").otherwise("no").alias("vote"))
    return rows.join(_people(spark, sf).select(F.col("slug").alias("member"), F.col("group").alias("party")), "member")


def _divisions(spark: SparkSession, sf: str) -> DataFrame:
    lists = _ballots(spark, sf).groupBy("division").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("member").alias("personSlug"), "vote"))).alias("cast"), F.count_if(F.col("vote") == "aye").alias("ayes"), F.count_if(F.col("vote") == "no").alias("noes"))
    ballots = F.transform("cast", lambda v: F.struct(v["personSlug"].alias("personSlug"), v["vote"].alias("vote"), _none("boolean").alias("teller"), _none("boolean").alias("againstGroupMajority")))
    parts = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("division")).agg(F.array_sort(F.collect_set(F.col("l_partkey"))).alias("parts"))
    rows = t(spark, sf, "orders").join(lists, F.col("o_orderkey") == F.col("division"), "left").drop("division").join(parts, F.col("o_orderkey") == F.col("division"), "left")
    return rows.select(
        F.col("o_orderkey").cast("string").alias("id"), F.when(F.col("o_orderstatus") == "O", "senate").otherwise("representatives").alias("house"), _day("o_orderdate").alias("date"), F.col("o_orderkey").alias("number"),
        F.concat(F.lit("Second reading "), "o_orderpriority").alias("name"), F.coalesce("ayes", F.lit(0)).alias("ayes"), F.coalesce("noes", F.lit(0)).alias("noes"), F.when(F.col("ayes") > F.col("noes"), "passed").otherwise("rejected").alias("result"),
        F.transform("parts", lambda x: x.cast("string")).alias("billIds"), ballots.alias("votes"), F.col("o_orderkey").alias("ord"),
    )


DIVISIONS = """divisions AS (
  SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'senate' ELSE 'representatives' END AS house, strftime(o_orderdate, '%Y-%m-%d') AS date, 'Second reading ' || o_orderpriority AS name,
    count(l_linestatus) FILTER (l_linestatus = 'O') AS ayes, count(l_linestatus) FILTER (l_linestatus <> 'O') AS noes
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
)"""


def _bills(spark: SparkSession, sf: str) -> DataFrame:
    """Parts; each ship day of a part is a step, a return the third reading."""
    event = F.when(F.col("l_returnflag") == "R", "Third reading agreed (Senate)").otherwise("Introduced (Senate)")
    steps = t(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_list(F.struct(_day("l_shipdate").alias("date"), event.alias("event")))).alias("timeline"))
    raisers = F.array(F.struct(F.col("p_name").alias("name"), _none("string").alias("phid"), F.concat(F.lit("p"), "p_size").alias("slug")))
    rows = t(spark, sf, "part").join(steps, "p_partkey", "left")
    return rows.select(
        F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("title"), F.when(F.col("p_type") == "PROMO", "Act").when(F.col("p_type") == "SMALL", "Before Senate").otherwise("Lapsed").alias("status"), F.lit("representatives").alias("chamber"),
        F.col("p_brand").alias("portfolio"), F.coalesce("timeline", F.array().cast("array<struct<date: string, event: string>>")).alias("timeline"), F.concat("p_name", F.lit(", "), "p_brand").alias("summary"),
        raisers.alias("sponsors"), F.array().cast(f"array<{schemas.RAISER}>").alias("movers"), F.lit("u").alias("listUpdated"), F.col("p_partkey").alias("ord"),
    )


def _tables(spark: SparkSession, sf: str, *names: str) -> views.Tables:
    makers = {"people": _people, "electorates": _electorates, "divisions": _divisions, "bills": _bills}
    return {name: makers[name](spark, sf) for name in names}


@query("WITH " + PEOPLE + """, s AS (SELECT lower(grp) AS party, house, count(*) AS seats FROM people GROUP BY ALL),
w AS (SELECT *, CAST(sum(seats) OVER (PARTITION BY house) AS BIGINT) AS total FROM s)
SELECT house, party, seats, total, total // 2 + 1 AS majority, (total // 2) / greatest(total, 1) * 100 AS tick, seats / greatest(total, 1) * 100 AS pct FROM w""")
def view_seat_bars(spark, sf):
    """VW-01."""
    people = _people(spark, sf).select(F.col("groupSlug").alias("party"), "group", "house", "ord")
    seats = elections.party_seats(people).withColumnRenamed("party", "slug")
    return views.seat_bars({"parties": seats.select("slug", "name", F.struct("representatives", "senate").alias("seats"))})


@query("WITH " + PEOPLE + f"""
SELECT p.slug, p.name, p.grp AS "group", lower(p.name || ' ' || coalesce(p.electorate, '') || ' ' || coalesce(p.state, '')) AS search,
  CASE WHEN p.house = 'senate' THEN 'Senator for ' || CASE p.state WHEN 'NSW' THEN 'New South Wales' WHEN 'VIC' THEN 'Victoria' WHEN 'QLD' THEN 'Queensland' WHEN 'WA' THEN 'Western Australia' ELSE 'South Australia' END ELSE 'Member for ' || n_name END AS seat
FROM people p LEFT JOIN nation ON lower(n_name) = p.electorate""")
def view_people_index(spark, sf):
    """VW-02, SRT-07, PRJ-29."""
    return views.people_index(_tables(spark, sf, "people", "electorates"))


@query("""WITH v AS (SELECT 'p' || l_suppkey AS member, l_orderkey AS division, CASE WHEN arg_min(l_linestatus, (l_linenumber, l_partkey, l_suppkey, l_linestatus)) = 'O' THEN 'aye' ELSE 'no' END AS vote FROM lineitem GROUP BY l_suppkey, l_orderkey),
""" + DIVISIONS + """
SELECT member, CAST(division AS VARCHAR) AS division, date, division AS number, name AS title, vote, false AS crossed, CASE WHEN ayes > noes THEN 'passed' ELSE 'rejected' END AS result FROM v JOIN divisions ON id = division""")
def view_person_votes(spark, sf):
    """VW-03, JON-19: a member's first vote in a division."""
    return views.person_votes(_tables(spark, sf, "divisions"))


@query("SELECT 'p' || p_size AS person, CAST(p_partkey AS VARCHAR) AS bill_id, 'Sponsor' AS role FROM part")
def view_person_bills(spark, sf):
    """VW-03, JON-23."""
    return views.person_bills(_tables(spark, sf, "bills"))


@query("WITH " + DIVISIONS + """SELECT CAST(id AS VARCHAR) AS id, date || '-' || id AS key, 'Second reading' AS procedure, CASE WHEN length(name) <= 45 THEN 'l' ELSE 'm' END AS tier,
  ayes / greatest(ayes + noes, 1) * 100 AS width, CAST(day(CAST(date AS DATE)) AS VARCHAR) || ' ' || monthname(CAST(date AS DATE)) || ' ' || year(CAST(date AS DATE)) AS day, CASE WHEN ayes > noes THEN 'passed' ELSE 'rejected' END AS result FROM divisions""")
def view_division_page(spark, sf):
    """VW-05, NUM-06, PRJ-28."""
    return views.division_page(_tables(spark, sf, "divisions"))


@query("WITH " + PEOPLE + """SELECT CAST(l_orderkey AS VARCHAR) AS division, coalesce(grp, 'Unknown') AS party, count(*) FILTER (l_linestatus = 'O') AS ayes, count(*) FILTER (l_linestatus <> 'O') AS noes, count(*) AS total
FROM lineitem LEFT JOIN people ON slug = 'p' || l_suppkey GROUP BY ALL""")
def view_division_groups(spark, sf):
    """VW-05, AGG-05."""
    return views.division_groups(_tables(spark, sf, "people", "divisions"))


@query("""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS division, CAST(p_partkey AS VARCHAR) AS bill_id, p_name || ' (' || p_brand || ')' AS title FROM lineitem JOIN part ON l_partkey = p_partkey""")
def view_division_bills(spark, sf):
    """VW-05, JON-24: bills of a division that are known."""
    return views.division_bills(_tables(spark, sf, "divisions", "bills")).select("division", "bill_id", "title")


_STEPS = """e AS (SELECT p_partkey, p_name, p_brand, p_type, strftime(max(l_shipdate), '%Y-%m-%d') AS moved, count(l_returnflag) FILTER (l_returnflag = 'R') AS thirds, count(l_returnflag) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY ALL),
s AS (SELECT *, CASE WHEN p_type = 'PROMO' THEN 'act' WHEN p_type = 'SMALL' THEN 'open' ELSE 'other' END AS bucket, CAST(greatest(CASE WHEN n > thirds THEN 1 ELSE 0 END, CASE WHEN thirds >= 2 THEN 3 WHEN thirds = 1 THEN 2 ELSE 0 END, CASE p_type WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 2 ELSE 0 END) AS INTEGER) AS stage FROM e)"""


@query("WITH " + _STEPS + "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' (' || p_brand || ')' AS title, moved, bucket, stage, lower(p_name || ' (' || p_brand || ') ' || p_brand) AS search FROM s")
def view_bills_index(spark, sf):
    """VW-07, SRT-06, PRJ-16, PRJ-17."""
    return views.bills_index(_tables(spark, sf, "bills"))


@query("WITH " + _STEPS + """, l AS (SELECT l_partkey, max(CASE WHEN l_returnflag = 'R' THEN 'Third reading agreed' ELSE 'Introduced' END) AS step FROM lineitem JOIN s ON l_partkey = p_partkey AND strftime(l_shipdate, '%Y-%m-%d') = moved GROUP BY 1)
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' (' || p_brand || ')' AS title, stage, bucket, replace(step, ' (Senate)', '') AS step, CAST(day(CAST(moved AS DATE)) AS VARCHAR) || ' ' || left(monthname(CAST(moved AS DATE)), 3) AS day FROM s LEFT JOIN l ON l_partkey = p_partkey""")
def view_bill_rows(spark, sf):
    """VW-12, STR-10: the last step by date, then by place."""
    return views.bill_rows(_tables(spark, sf, "bills"))


@query("WITH " + DIVISIONS + """SELECT CAST(id AS VARCHAR) AS id, monthname(CAST(date AS DATE)) || ' ' || year(CAST(date AS DATE)) AS month, CAST(day(CAST(date AS DATE)) AS VARCHAR) || ' ' || left(monthname(CAST(date AS DATE)), 3) AS day, id AS number,
  name AS title, 'Second reading' AS procedure, house, CASE WHEN ayes > noes THEN 'passed' ELSE 'rejected' END AS result, ayes, noes, ayes / greatest(ayes + noes, 1) * 100 AS width FROM divisions""")
def view_ledger_rows(spark, sf):
    """VW-12."""
    return views.ledger_rows(_tables(spark, sf, "divisions"))


@query("WITH " + PEOPLE + """, h AS (SELECT electorate, max_by(slug, ord) AS slug FROM people WHERE electorate IS NOT NULL GROUP BY 1)
SELECT lower(n_name) AS slug, n_name AS name, """ + _STATES + """ AS state, p.name AS member FROM nation LEFT JOIN h ON h.electorate = lower(n_name) LEFT JOIN people p ON p.slug = h.slug""")
def view_electorates_index(spark, sf):
    """VW-08, JON-01."""
    return views.electorates_index(_tables(spark, sf, "people", "electorates")).select("slug", "name", "state", "member")


@query("WITH " + PEOPLE + "SELECT slug AS person, 'Chief Whip' AS role, '2020-01-01' AS since FROM people WHERE house = 'senate'")
def view_party_leaders(spark, sf):
    """VW-09, AGG-13."""
    return views.party_leaders(_tables(spark, sf, "people"))


_LAST_STEPS = """l AS (SELECT l_partkey, max({'date': strftime(l_shipdate, '%Y-%m-%d'), 'event': CASE WHEN l_returnflag = 'R' THEN 'Third reading agreed (Senate)' ELSE 'Introduced (Senate)' END}) AS last FROM lineitem GROUP BY l_partkey),
b AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' (' || p_brand || ')' AS title, CASE p_type WHEN 'PROMO' THEN 'Act' WHEN 'SMALL' THEN 'Before Senate' ELSE 'Lapsed' END AS status, last.date AS moved, last.event AS event FROM part JOIN l ON l_partkey = p_partkey)"""
_FEED = """SELECT '<?xml version="1.0" encoding="utf-8"?><feed xmlns="http://www.w3.org/2005/Atom"><title>%(title)s</title><link rel="self" href="https://example.org%(path)sfeed.xml"/><link href="https://example.org%(path)s"/><id>https://example.org%(path)sfeed.xml</id><updated>'
  || coalesce(arg_min(date, nth), '1970-01-01') || 'T00:00:00Z</updated><author><name>A &amp; B</name></author>' || coalesce(string_agg('<entry><title>' || title || '</title><link href="https://example.org' || path || '"/><id>https://example.org' || path
  || '</id><updated>' || date || 'T00:00:00Z</updated><summary>' || summary || '</summary></entry>', '' ORDER BY nth), '') || '</feed>' AS xml FROM e WHERE nth <= 50"""


@query("WITH " + DIVISIONS + """, e AS (SELECT name AS title, '/divisions/' || house || '/' || date || '-' || id || '/' AS path, date,
  CASE house WHEN 'senate' THEN 'Senate' ELSE 'House' END || ' ' || ayes || '–' || noes || ' · ' || CASE WHEN ayes > noes THEN 'Carried' ELSE 'Negatived' END AS summary,
  row_number() OVER (ORDER BY date || '-' || lpad(CAST(id AS VARCHAR), CAST(greatest(4, length(CAST(id AS VARCHAR))) AS INTEGER), '0') || '-' || house DESC, id DESC) AS nth FROM divisions)
""" + _FEED % {"title": "Votes &lt;all&gt;", "path": "/divisions/"})
def division_feed_text(spark, sf):
    """SNK-06, TOP-03: the feed of the fifty newest divisions."""
    return views.feed_text(views.feed(_tables(spark, sf, "divisions")), "https://example.org/", "Votes <all>", "/divisions/", "A & B")


@query("WITH " + _LAST_STEPS + """, e AS (SELECT title || ' — ' || event AS title, '/bills/' || id || '/' AS path, moved AS date, event || ' · ' || status AS summary, row_number() OVER (ORDER BY moved DESC, title, id) AS nth FROM b)
""" + _FEED % {"title": "Bills", "path": "/bills/"})
def bill_feed_text(spark, sf):
    """SNK-06, TOP-03: the feed of the fifty bills that moved last."""
    return views.feed_text(views.bills_feed(_tables(spark, sf, "bills")), "https://example.org/", "Bills", "/bills/", "A & B")


@query("WITH " + _LAST_STEPS + "SELECT id, title, moved FROM b ORDER BY moved DESC, title, id LIMIT 8")
def view_home_bills(spark, sf):
    """TOP-02, VW-01: the eight bills that moved last, by title within a day."""
    return views.home_bills(_tables(spark, sf, "bills")).select("id", "title", "moved")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' (' || p_brand || ')' AS title,
  CASE WHEN p_size % 2 = 0 THEN 'Alpha Act 1999: ' || p_name || ' / Beta Code: ' || p_brand || '; ' || p_type END AS acts,
  CASE WHEN p_size % 2 = 1 THEN 'To:' END AS lead, CASE WHEN p_size % 2 = 1 THEN p_name || '; ' || p_brand || '; ' || p_type || '; end' END AS items FROM part""")
def view_bill_page(spark, sf):
    """VW-07, STR-13, STR-14: summaries by acts and as flat lists."""
    by_acts = F.concat(F.lit("Amends the: Alpha Act 1999 to: "), "p_name", F.lit("; and Beta Code to "), "p_brand", F.lit("; "), "p_type", F.lit("."))
    listed = F.concat(F.lit("To: "), "p_name", F.lit("; "), "p_brand", F.lit(";  and "), "p_type", F.lit("; end"))
    said = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.when(F.col("p_size") % 2 == 0, by_acts).otherwise(listed).alias("said"))
    page = views.bill_page({"bills": _bills(spark, sf).drop("summary").join(said.withColumnRenamed("said", "summary"), "id")})
    acts = F.transform("groups", lambda g: F.concat(g["acts"], F.lit(": "), F.array_join(g["items"], "; ")))
    return page.select("id", "title", F.array_join(acts, " / ").alias("acts"), F.col("list.lead").alias("lead"), F.array_join("list.items", "; ").alias("items"))


@query("""SELECT 'c' || c_custkey AS slug, CASE c_custkey % 3 WHEN 0 THEN 'Adviser of ' || c_mktsegment || ' ()' WHEN 1 THEN 'Clerk of ' || c_mktsegment || ' (2003 – 2007)' ELSE ' of ' || c_mktsegment || ' ()' END || '|Adviser of ' || c_name || ' ()' AS work,
  'BA (' || c_mktsegment || ')|Dip ()' AS study, regexp_replace(CAST(floor((epoch_ms(TIMESTAMP '2025-01-01') - epoch_ms(TIMESTAMP '2001-07-01' + to_days(CAST(c_nationkey AS INTEGER)))) / 31557600000 * 10 + 0.5) / 10 AS VARCHAR), '\\.0$', '') AS years
FROM customer WHERE c_custkey % 5 <> 0""")
def view_person_background(spark, sf):
    """VW-04, STR-15, STR-17, DT-07: work, study and years of service of people who have a background."""
    rows, segment = t(spark, sf, "customer"), F.col("c_mktsegment")
    first = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("Adviser at the "), segment, F.lit("."))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Clerk of the "), segment, F.lit(", 2003-2007"))).otherwise(segment)
    background = F.struct(
        F.array(first, F.concat(F.lit("Adviser at the "), "c_name", F.lit("."))).alias("occupations"), F.array(F.concat(F.lit("BA, "), segment), F.lit("Dip")).alias("qualifications"),
        _day(F.date_add(F.lit("2001-07-01").cast("date"), F.col("c_nationkey").cast("int"))).alias("serviceStart"),
    )
    people = rows.select(F.concat(F.lit("c"), "c_custkey").alias("slug"), F.when(F.col("c_custkey") % 5 != 0, background).alias("background"))
    shown = views.person_background({"people": people}, F.lit("2025-01-01 00:00:00").cast("timestamp"))
    work = F.transform("work", lambda o: F.concat(o["role"], F.lit(" of "), o["org"], F.lit(" ("), o["period"], F.lit(")")))
    study = F.transform("study", lambda q: F.concat(q["qual"], F.lit(" ("), q["institution"], F.lit(")")))
    return shown.select("slug", F.array_join(work, "|").alias("work"), F.array_join(study, "|").alias("study"), "years")


@query("""WITH n AS (SELECT DISTINCT trim(string_split(text, chr(10))[-1], ' ') AS name FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
s AS (SELECT d.doc_id, any_value(d.whole) IS NOT NULL AS written, coalesce(bool_or(n.name IS NOT NULL), false) AS spoken
  FROM (SELECT doc_id, text AS whole, trim(unnest(CASE WHEN text IS NULL THEN [NULL] ELSE string_split(text, chr(10)) END), ' ') AS line FROM documents) d LEFT JOIN n ON d.line = n.name GROUP BY d.doc_id)
SELECT CAST(s.doc_id AS VARCHAR) AS id, CASE WHEN written THEN CASE WHEN spoken THEN 'transcript' ELSE 'summary' END END AS "summaryKind", CASE WHEN spoken AND quality = 1 THEN 'good' END AS note FROM s LEFT JOIN labels l ON l.doc_id = s.doc_id""")
def summary_kinds(spark, sf):
    """PRJ-15, JON-02: kinds of summaries; notes of transcripts alone, and no empty ones.  Last lines of toxic texts are the names."""
    documents, labels = t(spark, sf, "documents"), t(spark, sf, "labels")
    divisions = documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("summary"))
    names = documents.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_semi").select(F.trim(F.element_at(F.split("text", "\n"), -1)).alias("name"))
    notes = labels.select(F.col("doc_id").cast("string").alias("slug"), F.struct(F.when(F.col("quality") == 1, "good").otherwise("").alias("text")).alias("note"))
    told = gold.summarised(divisions, names, notes)
    return told.select("id", "summaryKind", F.col("aiSummary.text").alias("note"))


@query("WITH " + PEOPLE + "SELECT slug, name, grp AS \"group\", upper(name[1]) AS initials FROM people")
def view_person_cards(spark, sf):
    """VW-12, STR-20."""
    return views.person_cards(_tables(spark, sf, "people", "electorates")).select("slug", "name", "group", "initials")


@query("""SELECT event_type AS source, CASE event_type WHEN 'click' THEN 'Clicks' END AS label, strftime(max(ts), '%Y-%m-%d') AS "lastSync", event_type <> 'error' AS ok,
CASE event_type WHEN 'error' THEN 'it has nothing but errors' END AS note FROM events GROUP BY event_type""")
def view_data_sources(spark, sf):
    """VW-10, SNK-05, INC-08: each source is run, what fails is recorded, and the manifest holds each one's last status."""
    events = t(spark, sf, "events")
    # As many rows as there are sources.
    kinds = {r["event_type"]: r["d"] for r in events.groupBy("event_type").agg(_day(F.max("ts")).alias("d")).collect()}

    def source(kind: str):
        def run() -> None:
            if kind == "error":
                raise ValueError("it has nothing but errors")
            events.where(F.col("event_type") == kind).agg(F.count("*")).first()

        return run

    manifest = spark.createDataFrame([("click", "2000-01-01", False, "older")], "source string, lastSync string, ok boolean, note string")
    for kind, ok, note in incremental.run_sources({kind: source(kind) for kind in kinds}):
        manifest = incremental.record_sync(manifest, kind, kinds[kind], ok, note)
    listed = events.select(F.col("event_type").alias("source")).distinct().withColumn("label", F.when(F.col("source") == "click", "Clicks"))
    return views.data_sources(listed, manifest)


@query("""WITH m AS (SELECT event_type, max(ts) AS latest FROM events GROUP BY 1)
SELECT CASE event_type WHEN 'click' THEN 'Clicks' ELSE event_type END || ' · ' || day(latest) || ' ' || monthname(latest) || ' ' || year(latest) AS shown, event_type <> 'error' AS ok FROM m
UNION ALL SELECT 'built 2 January 2025', true""")
def freshness_rows(spark, sf):
    """VW-11."""
    manifest = t(spark, sf, "events").groupBy(F.col("event_type").alias("source")).agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("lastSync"), F.first(F.col("event_type") != "error").alias("ok"))
    labels = spark.createDataFrame([("click", "Clicks")], "source string, label string")
    return flows.freshness(manifest, labels, "2025-01-02T03:04:05Z").select("shown", "ok")


@query("""SELECT max(strftime(o_orderdate, '%Y-%m-%d')) AS lastmod, count(*) AS urls FROM orders""")
def sitemap_index(spark, sf):
    """SNK-07."""
    return views.sitemap_index(t(spark, sf, "orders").select(F.concat(F.lit("/divisions/"), "o_orderkey").alias("url"), _day("o_orderdate").alias("lastmod")))


@query("""SELECT n_nationkey, slug, fallback, folder FROM (SELECT n_nationkey, CASE n_nationkey WHEN 0 THEN '2025 federal election' WHEN 1 THEN '2019 federal election' ELSE 'AEC event ' || n_nationkey END AS fallback,
  lower(n_name) AS slug, CASE n_regionkey WHEN 0 THEN 'nsw' WHEN 1 THEN 'vic' ELSE '' END AS folder FROM nation)""")
def event_names(spark, sf):
    """PRJ-11, PRJ-12: known events, others by id; parts of an address."""
    from ..functions import rules

    key = F.col("n_nationkey")
    event = F.when(key == 0, "31496").when(key == 1, "24310").otherwise(key.cast("string"))
    code = F.when(F.col("n_regionkey") == 0, "NSW").when(F.col("n_regionkey") == 1, "VIC").otherwise("Elsewhere")
    return t(spark, sf, "nation").select("n_nationkey", F.lower("n_name").alias("slug"), rules.event_name(event).alias("fallback"), text.state_path(code).alias("folder"))


def _count_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as the rows of a count: a seat is a supplier, a candidate a part there."""
    rows = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    place = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return rows.select(
        _state().alias("StateAb"), F.col("s_name").alias("DivisionNm"), F.concat_ws("-", "l_suppkey", "l_partkey").alias("CandidateID"), F.lit("SMITH").alias("Surname"), F.lit("JO").alias("GivenNm"), F.concat(F.lit("Part "), "l_partkey").alias("PartyNm"),
        F.lit("").alias("PartyAb"), F.lit("").alias("Swing"), F.when(F.col("l_returnflag") == "A", "Y").otherwise("N").alias("Elected"), F.col("l_quantity").cast("long").cast("string").alias("OrdinaryVotes"), place.alias("ord"),
    )


@query(f"""WITH c AS (SELECT l_suppkey, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS votes FROM lineitem GROUP BY ALL),
w AS (SELECT *, sum(votes) OVER (PARTITION BY l_suppkey) AS total FROM c)
SELECT '28791' AS "eventId", '2023 Aston by-election' AS "eventName", lower(replace(s_name, '#', '-')) AS "electorateSlug", {_STATES} AS state, count(*) AS candidates, max(votes) AS most, arg_max('Part ' || l_partkey, (votes, -l_partkey)) IS NOT NULL AS led, max(round(votes / total * 100 * 100) / 100) AS pct
FROM w JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL""")
def by_election_results(spark, sf):
    """SRC-07, AGG-01, PRJ-07, PRJ-10: polling places summed into candidates, candidates into seats."""
    rows = _count_rows(spark, sf)
    found = flows.event_results("28791", rows, rows)
    first = F.get("firstPrefs", F.lit(0))
    return found.select("eventId", "eventName", "electorateSlug", "state", F.size("firstPrefs").cast("long").alias("candidates"), first["votes"].alias("most"), first["party"].isNotNull().alias("led"), first["pct"].alias("pct"))


@query(f"""SELECT DISTINCT lower(replace(s_name, '#', '-')) AS slug, s_name AS name, {_STATES} AS state FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""")
def seat_map(spark, sf):
    """SRC-06, PRJ-13: one general election defines the seats, a by-election adds none."""
    rows = _count_rows(spark, sf).withColumnRenamed("OrdinaryVotes", "TotalVotes")
    general = flows.event_results("31496", rows, rows.limit(0))
    other = flows.event_results("28791", _count_rows(spark, sf).withColumn("DivisionNm", F.lit("Nowhere")), _count_rows(spark, sf))
    return flows.seats_of(general.unionByName(other))


@query("""SELECT p_partkey AS slug, p_brand AS area, p_type AS demographic, p_name AS "nameDerivation", CAST(p_size AS BIGINT) AS enrolment FROM part""")
def seat_profiles(spark, sf):
    """SRC-08, SRC-19, JON-17, STR-12: named facts of a page, enrolment by lower-cased name."""
    html = F.concat(F.lit("<dl><dt>Area:</dt><dd>"), "p_brand", F.lit("</dd><dt>Demographic&nbsp;rating</dt> <dd><b>"), "p_type", F.lit("</b></dd><dt>NAME DERIVATION:</dt><dd>"), "p_name", F.lit("</dd><dt>Other</dt><dd>x</dd></dl>"))
    part = t(spark, sf, "part")
    seats = part.select(F.col("p_partkey").alias("slug"), F.concat(F.lit("Seat "), "p_partkey").alias("name"), F.lit("NSW").alias("state"))
    counts = silver.enrolment(part.select(F.concat(F.lit("SEAT "), "p_partkey").alias("DivisionNm"), F.col("p_size").cast("string").alias("Enrolment")))
    found = flows.seat_profiles(seats, part.select(F.col("p_partkey").alias("slug"), html.alias("html")), counts)
    return found.select("slug", "profile.area", "profile.demographic", "profile.nameDerivation", "enrolment")


def _individuals(spark: SparkSession, sf: str) -> DataFrame:
    words = F.split("p_name", " ")
    place = lambda c, v: v.alias(c)
    lists = F.array(F.col("p_type"))
    return t(spark, sf, "part").select(
        F.concat(F.lit("H"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("PHID"), place("GivenName", words[0]), F.concat(F.lit("("), words[0], F.lit(")")).alias("PreferredName"), place("FamilyName", F.concat(words[1], F.lit(" "), "p_partkey")), F.lit("").alias("Electorate"), F.lit("").alias("StateAbbrev"),
        F.when(F.col("p_type") == "PROMO", "").otherwise("1970-01-01").alias("DateOfBirth"), F.col("p_brand").alias("PlaceOfBirth"), F.when(F.col("p_type") == "SMALL", "VIC").otherwise("").alias("StateOfBirth"), F.lit("Norway").alias("CountryOfBirth"),
        lists.alias("Occupations"), lists.alias("Qualifications"), lists.alias("Honours"), F.lit("").alias("ServiceHistory_Start"), F.array(F.lit(48).cast("bigint")).alias("RepresentedParliaments"), F.array(F.lit("Member of a committee")).alias("ParliamentaryPositions"),
    )


@query("""SELECT replace(p_name, ' ', '-') || '-' || p_partkey AS slug, 'H' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS phid, CASE WHEN p_type <> 'PROMO' THEN '1970-01-01' END AS born,
  p_brand || ', ' || CASE WHEN p_type = 'SMALL' THEN 'VIC' ELSE 'Norway' END AS birthplace, 1 + (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS positions FROM part""")
def handbook_flow(spark, sf):
    """SRC-17, JON-12, PRJ-05, PRJ-06, STR-22: individuals to people, their roles to positions."""
    individuals = _individuals(spark, sf)
    people = t(spark, sf, "part").select(F.concat(text.slugify_ascii(F.col("p_name")), F.lit("-"), "p_partkey").alias("slug"), F.concat("p_name", F.lit(" "), "p_partkey").alias("name"), _none("string").alias("electorate"), _none("string").alias("state"), F.col("p_partkey").alias("ord"))
    roles = t(spark, sf, "lineitem").select(F.concat(F.lit("H"), F.lpad(F.col("l_partkey").cast("string"), 9, "0")).alias("PHID"), F.struct("l_orderkey", "l_linenumber", "l_suppkey").alias("pos"), F.lit("Minister").alias("Role"), F.lit("for").alias("Prep"), F.lit("Lines").alias("Entity"), F.lit("").alias("Ministry"), _day("l_shipdate").alias("RDateStart"), F.lit("").alias("RDateEnd"), "l_linestatus")
    shadows = roles.where("l_linestatus <> 'O'")
    found = flows.handbook_profiles(individuals, roles.where("l_linestatus = 'O'"), shadows, flows.handbook_matches(individuals, people))
    return found.select("slug", "phid", "background.born", "background.birthplace", F.size("positions").cast("long").alias("positions"))


@query("""SELECT p_partkey, 'Minister for Lines' AS role, strftime(max(l_shipdate), '%Y-%m-%d') AS latest FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""")
def handbook_positions(spark, sf):
    """PRJ-05, DT-03: a person's first position is that of the latest start."""
    roles = t(spark, sf, "lineitem").select("l_partkey", F.struct(F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate").alias("pos"), F.lit("Minister").alias("Role"), F.lit("for").alias("Prep"), F.lit("Lines").alias("Entity"), F.lit("").alias("Ministry"), _day("l_shipdate").alias("RDateStart"), F.lit("1900-01-01").alias("RDateEnd")).alias("r"))
    lists = roles.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.array_sort(F.collect_list("r")).alias("r"))
    found = lists.withColumn("p", silver.positions(F.col("r"), F.slice("r", 1, 0), F.array().cast("array<string>")))
    return found.select("p_partkey", F.get("p", F.lit(0))["role"].alias("role"), F.get("p", F.lit(0))["from"].alias("latest"))


@query("SELECT DISTINCT lower(r_name) AS slug, r_name AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'")
def party_groups(spark, sf):
    """AGG-18: groups without independents."""
    people = _people(spark, sf).withColumn("groupSlug", F.when(F.col("group") == "ASIA", "independent").otherwise(F.col("groupSlug")))
    return flows.party_groups(people)


@query("SELECT replace(lower(r_name), ' ', '-') AS slug, '1901-05-09' AS founded, arg_min(n_name, n_nationkey) AS website FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name")
def party_facts(spark, sf):
    """SRC-10: the first answer for each known group."""
    answers = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("ord"), F.col("r_name").alias("label"), F.lit("1901-05-09T00:00:00Z").alias("inception"), F.col("n_name").alias("website"), _none("string").alias("article"))
    groups = t(spark, sf, "region").select(text.slugify_ascii(F.col("r_name")).alias("slug"))
    return flows.party_facts(answers.unionByName(answers.withColumn("label", F.lit("Unknown"))), groups).select("slug", "facts.founded", "facts.website")


@query("""SELECT l_suppkey AS member, count(*) AS voted, count(*) FILTER (l_returnflag = 'R') AS crossed FROM lineitem GROUP BY 1 HAVING count(*) >= 10""")
def voting_records(spark, sf):
    """AGG-15: people with ten votes or more."""
    return votes.voting_records(t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("member"), (F.col("l_returnflag") == "R").alias("crossed")))


@query("""WITH v AS (SELECT 'p' || l_suppkey AS slug, count(*) AS voted, count(*) FILTER (l_returnflag = 'R') AS crossed FROM lineitem GROUP BY 1 HAVING count(*) >= 10)
SELECT slug, voted, crossed FROM v WHERE slug NOT IN (SELECT 'p' || s_suppkey FROM supplier WHERE s_acctbal < 3000)""")
def due_person_notes(spark, sf):
    """NOTE, INC-05: notes of another version or number of votes; senators' are current."""
    ballots = t(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_suppkey").alias("member"), (F.col("l_returnflag") == "R").alias("crossed"))
    counts = ballots.groupBy(F.col("member").alias("slug")).agg(F.count("*").alias("considered"))
    notes = _people(spark, sf).join(counts, "slug").select("slug", F.lit(flows.NOTE_VERSION).alias("version"), F.when(F.col("house") == "senate", F.col("considered")).otherwise(0).alias("considered"))
    return flows.due_person_notes(_people(spark, sf), ballots, notes)


@query("WITH " + DIVISIONS + ", " + PEOPLE + """, c AS (SELECT house, count(*) AS total FROM divisions GROUP BY 1), v AS (SELECT 'p' || l_suppkey AS slug, count(*) AS voted, count(*) FILTER (l_returnflag = 'R') AS crossed,
  md5(string_agg(date || ' | ' || name || ' | voted ' || CASE WHEN l_linestatus = 'O' THEN 'aye' ELSE 'no' END || CASE WHEN l_returnflag = 'R' THEN ' | crossed' ELSE '' END, chr(10) ORDER BY l_orderkey, date || ' | ' || name || ' | voted ' || CASE WHEN l_linestatus = 'O' THEN 'aye' ELSE 'no' END || CASE WHEN l_returnflag = 'R' THEN ' | crossed' ELSE '' END)) AS lines_md5 FROM lineitem JOIN divisions ON id = l_orderkey GROUP BY 1)
SELECT slug, p.name || ' (' || grp || '), ' || CASE house WHEN 'senate' THEN 'Senate' ELSE 'House of Representatives' END || ': voted in ' || voted || ' of ' || total || '; crossed ' || crossed AS head, lines_md5 FROM v JOIN people p USING (slug) JOIN c USING (house)""")
def person_prompts(spark, sf):
    """NOTE: what a person's note may draw on."""
    ballots = t(spark, sf, "lineitem").select(F.concat(F.lit("p"), "l_suppkey").alias("member"), F.col("l_orderkey").alias("division"), F.when(F.col("l_linestatus") == "O", "aye").otherwise("no").alias("vote"), (F.col("l_returnflag") == "R").alias("crossed"))
    divisions = _divisions(spark, sf).select(F.col("ord").alias("division"), "house", "date", "name", "ord")
    due = votes.voting_records(ballots, 1).withColumnRenamed("member", "slug")
    return flows.person_prompts(due, _people(spark, sf), ballots, divisions).select("slug", "head", F.md5(F.col("lines").cast("binary")).alias("lines_md5"))


@query("WITH " + DIVISIONS + """, b AS (SELECT l_orderkey AS id, string_agg('- ' || p_name || ': ' || coalesce(CASE WHEN p_type <> 'PROMO' THEN p_brand END, 'no official summary'), chr(10) ORDER BY p_partkey) AS bills
  FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey GROUP BY 1), o AS (SELECT a.id, string_agg('- (division ' || b.id || ') ' || b.name, chr(10) ORDER BY b.id) AS ledger FROM divisions a JOIN divisions b ON a.house = b.house AND a.date = b.date AND a.id <> b.id GROUP BY 1)
SELECT d.id AS division, name || ' (division ' || d.id || ' of ' || date || ', ' || CASE house WHEN 'senate' THEN 'Senate' ELSE 'House of Representatives' END || ')' AS head, coalesce(bills, '') AS bills, coalesce(ledger, '') AS ledger, left(name || ' ' || repeat('x', 2300), 2200) AS excerpt
FROM divisions d LEFT JOIN b USING (id) LEFT JOIN o USING (id)""")
def division_prompts(spark, sf):
    """NOTE, JON-25, STR-16: what a division's note may draw on."""
    divisions = _divisions(spark, sf).select(F.col("ord").alias("division"), "house", "date", "number", "name", F.col("billIds").alias("bill_ids"))
    bills = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("bill_id"), F.col("p_name").alias("title"), F.when(F.col("p_type") != "PROMO", F.col("p_brand")).alias("summary"))
    return flows.division_prompts(divisions, bills, F.concat("name", F.lit(" "), F.lit("x" * 2300)))


@query("""SELECT d.doc_id AS id, CASE WHEN l.toxic = 1 THEN 'new' ELSE 'old' END AS text FROM documents d LEFT JOIN labels l USING (doc_id)""")
def merged_notes(spark, sf):
    """NOTE, INC-10, SET-06: new answers replace stored notes, empty ones don't."""
    stored = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("old").alias("text"), F.lit("m").alias("model"), F.lit("t0").alias("generatedAt"), F.lit(0).alias("version"))
    answers = t(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("toxic") == 1, "new").otherwise("").alias("text"))
    return flows.merged_notes(stored, answers, "m2", "t1").select("id", "text")


@query("""SELECT CASE WHEN q IS NULL THEN 'unmatched' WHEN q = 1 THEN 'skipped' ELSE 'fetched' END AS status, count(*) AS n FROM (SELECT l.quality AS q FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1""")
def run_status(spark, sf):
    """AGG-19, INC-04: what a run fetches, skips and finds nobody for; the counts come with the rows."""
    labels = t(spark, sf, "labels")
    stored = labels.select("doc_id", F.when(F.col("quality") == 1, "2025-01-01T00:00:00Z").otherwise("2020-01-01T00:00:00Z").alias("stored_at"))
    rows = incremental.run_status(t(spark, sf, "documents").select("doc_id"), labels, stored, "doc_id", F.lit("2025-01-02 00:00:00").cast("timestamp"))
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS unmatched, (SELECT string_agg(p_name, ', ' ORDER BY p_partkey) FROM (SELECT * FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer) ORDER BY p_partkey LIMIT 8)) AS names
FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)""")
def unmatched_report(spark, sf):
    """TOP-05: eight names are the feature."""
    from ..operators import matching

    sources = t(spark, sf, "part").withColumnRenamed("p_partkey", "source_id")
    return matching.unmatched(sources, t(spark, sf, "customer").select(F.col("c_custkey").alias("source_id")), "p_name", "source_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 80""")
def capped_run(spark, sf):
    """INC-07: eighty pending items a run are the feature."""
    return incremental.capped(t(spark, sf, "orders").where("o_orderstatus = 'P'"), 80, "o_orderdate", "o_orderkey").select("o_orderkey")


@query("SELECT strftime(max(ts), '%Y-%m-%d') AS cursor FROM events")
def fetch_cursor(spark, sf):
    """INC-01: where the next fetch begins."""
    return incremental.next_cursor(t(spark, sf, "events").select(_day("ts").alias("d")), "d")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' ’' AS title FROM part WHERE p_type IN ('PROMO', 'LARGE')""")
def healed_bills(spark, sf):
    """INC-06, PRJ-21, PRJ-03: stored bills that still hold entities or lack fields, made again from raw ones."""
    broken = F.col("p_type") == "PROMO"
    stored = _bills(spark, sf).join(t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_type"), "id")
    stored = stored.withColumn("title", F.when(broken, F.concat("title", F.lit(" &#8217;"))).otherwise(F.col("title"))).withColumn("listUpdated", F.when(F.col("p_type") != "LARGE", F.col("listUpdated")))
    raw = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("Id"), F.concat("p_name", F.lit(" &#8217;")).alias("Title"), F.lit("Before Senate").alias("Status"), F.lit("").alias("Summary"), F.lit("House").alias("FormattedOriginatingChamber"), F.lit("u2").alias("LastUpdatedDateTime"))
    details = spark.createDataFrame([], silver.DETAIL_RAW)
    return flows.healed_bills(stored, raw, details, 48).select("id", "title")


@query("""WITH s AS (SELECT l_orderkey AS o_orderkey, count(*) AS n, strftime(min(l_shipdate), '%Y-%m-%d') AS first FROM lineitem GROUP BY 1)
SELECT o_orderkey, n, first, 'Step ’ (Senate)' AS event FROM s""")
def bill_timelines(spark, sf):
    """PRJ-03, DT-01, SRC-16, ARR-02: steps of all chambers by date; those without date or words go."""
    stamp = F.concat(F.lit("/Date("), F.unix_millis(F.col("l_shipdate").cast("timestamp")).cast("string"), F.lit(")/"))
    step = lambda said, at: F.struct(F.lit(said).alias("Description"), at.alias("UpdateDate"))
    steps = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.flatten(F.collect_list(F.array(step("Step &#8217;", stamp), step("", stamp), step("No date", _none("string"))))).alias("steps"))
    detail = F.struct(F.array(F.struct(F.lit("Senate").alias("FormattedChamber"), F.col("steps").alias("ProgressStates"))).alias("GroupedProgressStates"))
    rows = steps.select("o_orderkey", silver.bill_timeline(detail).alias("timeline"))
    return rows.select("o_orderkey", F.size("timeline").cast("long").alias("n"), F.get("timeline", F.lit(0))["date"].alias("first"), F.get("timeline", F.lit(0))["event"].alias("event"))


@query("WITH " + PEOPLE + """SELECT CAST(substr(slug, 2) AS BIGINT) AS person_id, slug FROM people""")
def person_crosswalk(spark, sf):
    """PRJ-02, SRC-14: the vote source's people among the known ones."""
    people = _people(spark, sf)
    where = F.when(F.col("house") == "senate", text.state_name(F.col("state"))).otherwise(F.col("electorate"))
    raw = people.select(F.col("ord").alias("id"), F.struct(F.struct(F.lit("Supplier").alias("first"), F.substring_index("name", "#", -1).alias("last")).alias("name"), where.alias("electorate"), "house", F.col("group").alias("party")).alias("latest_member"))
    return silver.person_crosswalk(raw, people).select("person_id", "slug")


@query("""SELECT o_orderkey, CAST(count(l_orderkey) AS BIGINT) AS votes, CASE WHEN count(l_orderkey) FILTER (l_linestatus = 'O') > count(l_orderkey) FILTER (l_linestatus = 'F') THEN 'passed' ELSE 'rejected' END AS result
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def rebuilt_divisions(spark, sf):
    """SRC-22, PRJ-01, JSN-02: every stored raw division made canonical again."""
    people = _people(spark, sf)
    member = F.struct(F.struct(F.col("l_suppkey").alias("id")).alias("person"), F.lit("Supplier").alias("first_name"), F.col("l_suppkey").cast("string").alias("last_name"), F.col("l_returnflag").alias("party"))
    cast = t(spark, sf, "lineitem").withColumn("vote", F.when(F.col("l_linestatus") == "O", "aye").otherwise("no"))
    lists = cast.groupBy("l_orderkey").agg(F.collect_list(F.struct(member.alias("member"), "vote")).alias("votes"), F.count_if(F.col("vote") == "aye").alias("aye_votes"), F.count_if(F.col("vote") == "no").alias("no_votes"))
    raw = t(spark, sf, "orders").join(lists, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_orderkey").alias("id"), F.lit("senate").alias("house"), _day("o_orderdate").alias("date"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("name"), "aye_votes", "no_votes", F.lit("").alias("summary"), "votes",
        F.array(F.struct(F.lit(1).cast("bigint").alias("id"), F.lit("t").alias("title"), _none("string").alias("official_id"))).alias("bills"),
    )
    raw_people = people.select(F.col("ord").alias("id"), F.struct(F.struct(F.lit("Supplier").alias("first"), F.substring_index("name", "#", -1).alias("last")).alias("name"), F.lit("").alias("electorate"), "house", F.col("group").alias("party")).alias("latest_member"))
    return flows.rebuild_divisions(raw, raw_people, people).select(F.col("number").alias("o_orderkey"), F.size("votes").cast("long").alias("votes"), "result")


@query("""SELECT CAST(c_custkey AS BIGINT) AS ord, 'Q' || c_custkey AS wikidata, c_name AS name, 'senate' AS house, '2020-01-02' AS since FROM customer""")
def open_members(spark, sf):
    """PRJ-04, WIN-04, SRC-09: one open seat a person, the latest."""
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("http://e/Q"), "c_custkey").alias("person"), F.col("c_name").alias("personLabel"), F.lit("http://e/Q6814428").alias("houseQ"), F.col("c_mktsegment").alias("partyLabel"), F.lit("Victoria").alias("electorateLabel"), _none("string").alias("img"), F.lit("2020-01-02").alias("start"), _none("string").alias("article"))
    older = rows.withColumns({"ord": F.col("ord") + 10_000_000, "start": F.lit("2010-01-01"), "houseQ": F.lit("http://e/Q18912794")})
    return silver.members(rows.unionByName(older)).select("ord", "wikidata", "name", "house", "since")


@query("""SELECT c_custkey, 'customer-' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS slug, 'senate' AS house, 'VIC' AS state, c_mktsegment AS "group", CASE WHEN c_mktsegment = 'BUILDING' THEN 'CC BY 4.0' END AS licence FROM customer""")
def canonical_people(spark, sf):
    """PRJ-08, STR-06: photos under a free licence only."""
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("ord"), F.concat(F.lit("Q"), "c_custkey").alias("wikidata"), F.col("c_name").alias("name"), F.lit("senate").alias("house"), F.col("c_mktsegment").alias("group"), F.lit("Victoria").alias("district"), F.col("c_mktsegment").alias("commonsFile"), F.lit("2020-01-02T00").alias("since"), _none("string").alias("wikipedia"))
    licences = spark.createDataFrame([("BUILDING", "CC BY 4.0", "Jo"), ("MACHINERY", "All rights reserved", "Al")], "commonsFile string, licence string, attribution string")
    return silver.people(rows, licences).select(F.col("ord").alias("c_custkey"), "slug", "house", "state", "group", "photo.licence")


@query("""SELECT c_custkey, 'A ' || c_mktsegment AS artist, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' Part' AS title, c_name AS event, 'example.org/' || c_custkey AS label, 'x' || c_custkey AS last, c_mktsegment AS preferred FROM customer""")
def name_rules(spark, sf):
    """STR-06, STR-09, STR-10, STR-21, STR-22."""
    segment = F.col("c_mktsegment")
    return t(spark, sf, "customer").select(
        "c_custkey", text.attribution(F.concat(F.lit("<a href='x'>A "), segment, F.lit("</a>"))).alias("artist"), text.title_from_slug(F.concat(F.lower(segment), F.lit("-part"))).alias("title"),
        text.event_description(F.concat("c_name", F.lit(" (Senate)"))).alias("event"), text.website_label(F.concat(F.lit("https://www.example.org/"), "c_custkey", F.lit("/"))).alias("label"),
        text.last_segment(F.concat(F.lit("http://e/f/x"), "c_custkey")).alias("last"), text.preferred_name(F.concat(F.lit(" ("), segment, F.lit(") "))).alias("preferred"),
    )


@query("""SELECT o_orderkey, regexp_replace(CAST(floor((epoch_ms(TIMESTAMP '2025-01-01') - epoch_ms(o_orderdate)) / 31557600000 * 10 + 0.5) / 10 AS VARCHAR), '\\.0$', '') AS years, CAST(CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_orderkey END AS BIGINT) AS n FROM orders""")
def service_years(spark, sf):
    """DT-07, NUM-03: years to a decimal place; counts as texts, unreadable ones as 0."""
    years = dates.service_years(_day("o_orderdate"), F.lit("2025-01-01 00:00:00").cast("timestamp"))
    said = F.when(F.col("o_orderstatus") == "P", "n/a").otherwise(F.concat(F.lit(" "), "o_orderkey", F.lit(" ")))
    return t(spark, sf, "orders").select("o_orderkey", years.alias("years"), numbers.count_of(said).alias("n"))


@query("""SELECT CAST(p_size AS BIGINT) AS total, lower(p_brand) AS name, p_partkey AS slug FROM part""")
def parties_order(spark, sf):
    """SRT-04, VW-09: parties by seats, then by name."""
    rows = t(spark, sf, "part").select(F.struct(F.col("p_size").cast("bigint").alias("representatives"), _none("bigint").alias("senate")).alias("seats"), F.lower("p_brand").alias("name"), F.col("p_partkey").alias("slug"))
    return views.parties_index({"parties": rows}).select("total", "name", "slug")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders WHERE contains(lower(o_orderpriority), 'urgent') AND o_orderstatus = 'O' GROUP BY 1")
def filtered_months(spark, sf):
    """PRJ-24: months of what a filter leaves."""
    return ordering.month_runs(t(spark, sf, "orders").withColumn("d", _day("o_orderdate")), "d", F.col("o_orderpriority"), "Urgent", o_orderstatus="O")


@query("""SELECT p_partkey AS id, p_name AS title, '/bills/' || p_partkey || '/' AS href FROM part""")
def bill_hrefs(spark, sf):
    """SRT-09, AGG-14: a link for each bill, beside those of families."""
    bills = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("title"))
    return linking.title_links(bills).where("rank = 0").select(F.regexp_extract("href", r"^/bills/(\d+)/$", 1).cast("long").alias("id"), "title", "href")


@query("""SELECT p_name || ' bills' AS title, '/bills/?q=' || replace(p_name, ' ', '%20') AS href FROM part GROUP BY p_name HAVING count(*) > 1""")
def family_links(spark, sf):
    """STR-18, SRT-09: families of titles link to a search."""
    bills = t(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"), F.concat("p_name", F.lit(" ("), "p_brand", F.lit(")")).alias("title"))
    return linking.title_links(bills).where("rank = 1").select("title", "href")


def _written(spark: SparkSession, df: DataFrame, kind: str) -> str:
    """A folder with one-column rows as lines of text files."""
    folder = work_folder(spark, kind)
    df.write.mode("overwrite").text(folder)
    return folder


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def json_lines_read(spark, sf):
    """SRC-02, SRC-23, SNK-03, JSN-01, JSN-03: a bundle in order, undeclared fields ignored, nulls left out."""
    folder = work_folder(spark, "bundle")
    files.write_bundle(t(spark, sf, "customer").withColumn("nothing", _none("string")), folder, "c_custkey")
    return files.json_lines(spark, folder, "c_custkey bigint, c_name string, c_mktsegment string")


@query("SELECT n_nationkey, n_name FROM nation")
def entity_documents(spark, sf):
    """SRC-01, SNK-01: one document for each entity."""
    folder = work_folder(spark, "documents")
    files.write_documents(t(spark, sf, "nation"), folder, "n_nationkey")
    return spark.read.schema("n_nationkey int, n_name string").option("recursiveFileLookup", True).json(folder)


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, c_name || chr(10) || '"x", y' AS name, CASE WHEN c_custkey // 500 % 2 = 1 THEN c_mktsegment ELSE '' END AS segment FROM customer""")
def titled_csv_read(spark, sf):
    """SRC-05: a title, headers of different orders, quotes, line feeds in values, short rows, ranges that cut records."""
    file, even = F.floor(F.col("c_custkey") / 500), F.floor(F.col("c_custkey") / 500) % 2 == 0
    name = F.concat(F.lit('"'), "c_name", F.lit('\n""x"", y"'))
    rows = t(spark, sf, "customer").select(file.alias("file"), F.lit(2).alias("at"), F.when(even, F.concat("c_custkey", F.lit(","), name)).otherwise(F.concat_ws(",", "c_mktsegment", name, F.lit("-"), "c_custkey")).alias("value"))
    heads = rows.select("file").distinct().select("file", F.posexplode(F.array(F.lit('Some "title, made today'), F.when(F.col("file") % 2 == 0, "id,name,segment").otherwise("segment,name,more,id"))).alias("at", "value"))
    folder = work_folder(spark, "titled")
    heads.unionByName(rows).repartition("file").sortWithinPartitions("file", "at").drop("at").write.mode("overwrite").partitionBy("file").text(folder)
    return files.titled_csv(spark, folder, ["id", "name", "segment"]).drop("ord")


@query("SELECT CAST(p_partkey AS VARCHAR) AS a, p_name AS b FROM part")
def plain_csv_read(spark, sf):
    """SRC-04: columns by each file's header, blank rows go."""
    folder = work_folder(spark, "csv")
    rows = t(spark, sf, "part").select(F.col("p_name").alias("b"), F.col("p_size").cast("string").alias("more"), F.col("p_partkey").cast("string").alias("a"))
    blank = rows.select(*[F.lit("").alias(c) for c in rows.columns]).distinct()
    rows.unionByName(blank).write.mode("overwrite").option("header", True).csv(folder)
    return files.plain_csv(spark, folder, ["a", "b"])


@query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, n_name AS person, CASE WHEN n_regionkey = 0 THEN 'A' END AS start FROM nation")
def sparql_read(spark, sf):
    """SRC-09: bindings in order, missing ones null."""
    item = F.struct("n_nationkey", F.struct(F.col("n_name").alias("value")).alias("person"), F.when(F.col("n_regionkey") == 0, F.struct(F.lit("A").alias("value"))).alias("start"))
    answer = t(spark, sf, "nation").agg(F.to_json(F.struct(F.struct(F.array_sort(F.collect_list(item)).alias("bindings")).alias("results"))).alias("value"))
    return files.sparql_bindings(spark, _written(spark, answer, "sparql"), ["person", "start"])


@query("SELECT 's' || s_suppkey AS \"PHID\", s_name AS \"FamilyName\" FROM supplier")
def odata_read(spark, sf):
    """SRC-17: the items of all pages."""
    item = F.struct(F.concat(F.lit("s"), "s_suppkey").alias("PHID"), F.col("s_name").alias("FamilyName"))
    pages = t(spark, sf, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(item).alias("value"))).alias("value")).select("value")
    return files.odata_values(spark, _pages(spark, pages, "odata"), "PHID: string, FamilyName: string")


def _pages(spark: SparkSession, df: DataFrame, kind: str) -> str:
    """A file for each row."""
    folder = work_folder(spark, kind)
    df.withColumn("page", F.xxhash64("value")).write.mode("overwrite").partitionBy("page").text(folder)
    return folder


@query("SELECT n_name || '.jpg' AS \"commonsFile\", CASE WHEN n_regionkey = 0 THEN 'unknown' ELSE 'CC0' END AS licence, 'Jo ' || n_nationkey AS attribution FROM nation")
def licences_read(spark, sf):
    """SRC-11, STR-06: licences of pages by id."""
    value = lambda c: F.struct(c.alias("value"))
    meta = F.struct(F.when(F.col("n_regionkey") != 0, value(F.lit("CC0"))).alias("LicenseShortName"), value(F.concat(F.lit("<a>Jo "), "n_nationkey", F.lit("</a>"))).alias("Artist"))
    page = F.struct(F.concat(F.lit("File:"), "n_name", F.lit(".jpg")).alias("title"), F.array(F.struct(meta.alias("extmetadata"))).alias("imageinfo"))
    answer = t(spark, sf, "nation").agg(F.to_json(F.struct(F.struct(F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string"), page))).alias("pages")).alias("query"))).alias("value"))
    return files.image_licences(spark, _written(spark, answer, "licences"))


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), r AS (SELECT p_name, (row_number() OVER (ORDER BY p_name) - 1) // 40 AS batch FROM n)
SELECT batch, string_agg('File:' || p_name, '|' ORDER BY p_name) AS titles FROM r GROUP BY batch""")
def image_batches(spark, sf):
    """SRC-11, WIN-07: forty titles to a request."""
    return files.image_batches(t(spark, sf, "part"), "p_name")


@query("SELECT CAST(user_id AS VARCHAR) AS id, strftime(min(ts), '%Y-%m-%d') AS date FROM events GROUP BY user_id")
def first_of_each(spark, sf):
    """SRC-13: one row an id, whatever windows gave it."""
    rows = t(spark, sf, "events").select(F.col("user_id").cast("string").alias("id"), _day("ts").alias("date"))
    return files.first_of_each(rows, "id", "date")


_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"


def _index(spark: SparkSession, sf: str) -> DataFrame:
    """The written index of all documents."""
    folder = work_folder(spark, "index")
    text_index.write_index(text_index.postings(t(spark, sf, "documents"), "doc_id", "text"), folder, ranged=False)
    return spark.read.parquet(folder)


@query(f"SELECT word, count(DISTINCT doc_id) AS pages, count(*) AS places FROM (SELECT doc_id, unnest({_WORDS}) AS word FROM documents WHERE doc_id IS NOT NULL) GROUP BY word")
def posting_counts(spark, sf):
    """SNK-09: pages and places of every word of the index."""
    return text_index.word_counts(text_index.postings(t(spark, sf, "documents"), "doc_id", "text"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS three FROM w), q AS (SELECT item_id, {_WORDS} AS ws FROM benchmark)
SELECT item_id AS phrase, doc_id AS key, count(*) AS n FROM q JOIN p ON three = ws[1] || ' ' || ws[2] || ' ' || ws[3] GROUP BY item_id, doc_id""")
def phrase_hits(spark, sf):
    """SNK-09: the first three words of every benchmark item as phrases, in all documents."""
    phrases = t(spark, sf, "benchmark").select(F.col("item_id").alias("phrase"), F.array_join(F.slice(text_index.words_of(F.col("text")), 1, 3), " ").alias("text"))
    return text_index.phrase_hits(_index(spark, sf), phrases)


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL), p AS (SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS word FROM w) GROUP BY ALL),
d AS (SELECT word, count(*) AS df FROM p GROUP BY word), q AS (SELECT item_id AS query, unnest(list_distinct(({_WORDS})[1:4])) AS word FROM benchmark),
s AS (SELECT query, doc_id AS key, list_sum(list(ln(1 + ((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2) ORDER BY word)) AS score FROM q JOIN d USING (word) JOIN p USING (word) GROUP BY query, doc_id),
r AS (SELECT query, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, key) AS INTEGER) AS rank, key, score FROM s)
SELECT query, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")
def ranked_pages(spark, sf):
    """SNK-09: the ten best documents for the first four words of every benchmark item."""
    queries = t(spark, sf, "benchmark").select(F.col("item_id").alias("query"), F.array_join(F.slice(text_index.words_of(F.col("text")), 1, 4), " ").alias("text"))
    best = text_index.ranked(_index(spark, sf), queries, t(spark, sf, "documents").count())
    return best.select("query", "rank", F.round("score", 6).alias("score"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'new' ELSE c_mktsegment END AS segment FROM customer""")
def published_customers(spark, sf):
    """SRC-15, JSN-02: a table published in buckets, some of them again; an empty publication changes nothing."""
    table = Table(spark, work_folder(spark, "published"))
    rows = t(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("segment")).withColumn("bucket", F.pmod("c_custkey", F.lit(7)))
    table.publish_buckets(rows, "bucket")
    table.publish_buckets(rows.where("bucket = 0").withColumn("segment", F.lit("new")), "bucket")
    try:
        table.publish(rows.limit(0))
    except ValueError:
        return table.read()
    raise AssertionError("an empty table was published")


@query("""WITH c AS (SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_custkey) AS nth FROM customer), d AS (SELECT c_custkey, c_name, (nth - 1) // 8 AS request FROM c WHERE nth <= 640), f AS (SELECT request FROM d GROUP BY request HAVING bool_or(c_custkey % 500 = 0))
SELECT 'c' || c_custkey AS id, d.request, CASE WHEN f.request IS NULL THEN upper(c_name) END AS text, f.request IS NOT NULL AS failed FROM d LEFT JOIN f ON d.request = f.request""")
def note_progress(spark, sf):
    """NOTE: the progress of a run with its cap, over requests of eight of which some fail."""
    pending = t(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), "c_custkey", "c_name")

    def call(items: list[dict]) -> str:
        if any(i["c_custkey"] % 500 == 0 for i in items):
            raise ValueError("refused")
        return json.dumps([{"id": i["id"], "summary": i["c_name"].upper()} for i in items])

    path = work_folder(spark, "progress")
    note_runs.run_notes(pending, call, path, "c_custkey", wave=80)
    return note_runs.progress_of(spark, path).select("id", "request", "text", F.col("error").isNotNull().alias("failed"))


@query("""WITH n AS (SELECT r_name AS host, n_name, 'http://' || r_name || '/' || n_nationkey AS url, n_nationkey % 5 AS k FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_name AS id, host, CAST(a AS INTEGER) AS attempt, CASE k WHEN 1 THEN 404 WHEN 2 THEN CASE WHEN a < 3 THEN 503 ELSE 200 END ELSE 200 END AS status, CASE WHEN k <> 1 AND (k <> 2 OR a = 3) THEN url END AS answer
FROM n, range(1, 4) t(a) WHERE a <= CASE k WHEN 2 THEN 3 ELSE 1 END""")
def request_attempts(spark, sf):
    """SRC-10, SRC-11, SRC-17, SRC-19: requests as rows, every attempt an answer's row; some are refused, some busy twice."""
    rows = t(spark, sf, "nation").join(t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    asked = rows.select(F.col("n_name").alias("id"), F.col("r_name").alias("host"), F.concat(F.lit("http://"), "r_name", F.lit("/"), "n_nationkey").alias("url"), _none("string").alias("body"))
    seen: dict[str, int] = {}

    def transport(url: str, body: str | None, timeout: float) -> tuple[int, str]:
        k, seen[url] = int(url.rsplit("/", 1)[1]) % 5, seen.get(url, 0) + 1
        return 404 if k == 1 else 503 if k == 2 and seen[url] < 3 else 200, url

    return requests.answered(asked, transport, interval=0, sleep=lambda s: None).select("id", "host", "attempt", "status", "answer")


@query("""WITH n AS (SELECT DISTINCT split_part(lower(p_name), ' ', 1) AS needle FROM part UNION SELECT DISTINCT substr(lower(p_type), 1, 2) FROM part)
SELECT needle, count(*) AS n, min(p_partkey) AS first FROM n JOIN part ON contains(lower(p_name), needle) GROUP BY needle""")
def substring_search(spark, sf):
    """TOP-04, PRJ-23: needles out of the data, those of two characters by a scan, through a written index."""
    part = t(spark, sf, "part")
    texts = part.select(F.substring_index(F.lower("p_name"), " ", 1).alias("text")).unionByName(part.select(F.substring(F.lower("p_type"), 1, 2).alias("text"))).distinct()
    folder = work_folder(spark, "trigrams")
    text_index.write_index(substrings.trigram_index(part, "p_partkey", "p_name"), folder)
    hits = substrings.found(part, "p_partkey", "p_name", spark.read.parquet(folder), texts.select(F.col("text").alias("needle"), "text"))
    return hits.groupBy("needle").agg(F.count("*").alias("n"), F.min("key").alias("first"))
