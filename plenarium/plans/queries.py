"""Queries over the driver's tables, one for each operator, with their SQL for DuckDB.

The tables stand in for the domain's: lineitem for recorded votes (division: ship month;
member: supplier; party: region; vote: line status), orders for contests, bills and
divisions, part for titles, events for feeds, pages for scraped HTML.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, numbers, rules, text
from ..operators import elections, linking, matching, ordering, votes
from ..streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def month(column: str):
    return F.date_format(column, "yyyy-MM")


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    members = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("member"), F.col("n_regionkey").alias("party"))
    cast = t(spark, sf, "lineitem").select(month("l_shipdate").alias("division"), F.col("l_suppkey").alias("member"), F.when(F.col("l_linestatus") == "O", "aye").otherwise("no").alias("vote"))
    return cast.join(members, "member")


VOTES = """
WITH v AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS division, l_suppkey AS member, n_regionkey AS party,
    CASE WHEN l_linestatus = 'O' THEN 'aye' ELSE 'no' END AS vote
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
), c AS (
  SELECT *, sum(CASE WHEN vote = 'aye' THEN 1 ELSE -1 END) OVER (PARTITION BY division, party) AS lead FROM v
), x AS (
  SELECT division, member, party, vote, CASE WHEN lead > 0 THEN 'aye' WHEN lead < 0 THEN 'no' END AS side FROM c
)
"""


@query(VOTES + """, m AS (
  SELECT member, count(*) AS voted, count(*) FILTER (vote <> side) AS against FROM x GROUP BY member
), e AS (SELECT count(DISTINCT division) AS eligible FROM x)
SELECT s_suppkey AS slug, eligible, CAST(coalesce(voted, 0) AS BIGINT) AS voted, CAST(coalesce(against, 0) AS BIGINT) AS against
FROM supplier CROSS JOIN e LEFT JOIN m ON s_suppkey = member
""")
def member_vote_stats(spark, sf):
    """AGG-02, WIN-01, JON-07."""
    crossed = votes.crossed_votes(_votes(spark, sf))
    divisions = t(spark, sf, "lineitem").select(month("l_shipdate").alias("division"), F.lit("h").alias("house")).distinct()
    people = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("slug"), F.lit("h").alias("house"))
    return votes.member_stats(people, crossed, divisions)


@query(VOTES + "SELECT division, party, side, count(*) AS n, count(*) FILTER (vote <> side) AS crossed FROM x GROUP BY division, party, side")
def crossed_votes(spark, sf):
    """WIN-01, AGG-03."""
    crossed = votes.crossed_votes(_votes(spark, sf))
    return crossed.groupBy("division", "party", "side").agg(F.count("*").alias("n"), F.count_if(F.coalesce("crossed", F.lit(False))).alias("crossed"))


@query(VOTES + """SELECT division, count(*) FILTER (vote = 'aye') AS ayes, count(*) FILTER (vote = 'no') AS noes,
  CASE WHEN count(*) FILTER (vote = 'aye') > count(*) FILTER (vote = 'no') THEN 'passed' ELSE 'rejected' END AS result,
  count(*) FILTER (vote = 'aye') / greatest(count(*), 1) * 100 AS width
FROM x GROUP BY division""")
def division_results(spark, sf):
    """PRJ-01, NUM-06, AGG-15."""
    return votes.division_results(_votes(spark, sf)).withColumn("width", votes.aye_width(F.col("ayes"), F.col("noes")))


@query("""WITH v AS (
  SELECT strftime(l_shipdate, '%Y-%m') AS division, coalesce(c_mktsegment, 'Unknown') AS party, l_linestatus
  FROM lineitem LEFT JOIN customer ON l_partkey = c_custkey
)
SELECT division, party, count(*) FILTER (l_linestatus = 'O') AS ayes, count(*) FILTER (l_linestatus <> 'O') AS noes, count(*) AS total FROM v GROUP BY ALL""")
def group_breakdown(spark, sf):
    """AGG-05, JON-21: parts vote, and those that aren't customers count as Unknown."""
    members = t(spark, sf, "customer").select(F.col("c_custkey").alias("member"), F.col("c_mktsegment").alias("party"))
    cast = t(spark, sf, "lineitem").select(month("l_shipdate").alias("division"), F.col("l_partkey").alias("member"), F.when(F.col("l_linestatus") == "O", "aye").otherwise("no").alias("vote"))
    return votes.group_breakdown(cast, members)


def _seats(spark, sf):
    house = F.when(F.col("p_type").isin("SMALL", "STANDARD"), "senate").otherwise("representatives")
    return t(spark, sf, "part").select(F.col("p_size").alias("party"), F.col("p_brand").alias("group"), house.alias("house"), F.col("p_partkey").alias("ord"))


@query("""SELECT p_size AS party, coalesce(any_value(n_name), arg_min(p_brand, p_partkey)) AS name,
  count(*) FILTER (p_type NOT IN ('SMALL', 'STANDARD')) AS representatives, count(*) FILTER (p_type IN ('SMALL', 'STANDARD')) AS senate, count(*) AS total
FROM part LEFT JOIN nation ON p_size = n_nationkey GROUP BY p_size""")
def party_seats(spark, sf):
    """AGG-04, AGG-09, JON-09: sizes beyond the nations have no reference."""
    reference = t(spark, sf, "nation").select(F.col("n_nationkey").alias("party"), F.col("n_name").alias("name"))
    return elections.party_seats(_seats(spark, sf), reference).withColumn("total", F.col("representatives") + F.col("senate"))


@query("""WITH s AS (
  SELECT CASE WHEN p_type IN ('SMALL', 'STANDARD') THEN 'senate' ELSE 'representatives' END AS house, p_size AS party, count(*) AS seats FROM part GROUP BY ALL
), w AS (SELECT *, CAST(sum(seats) OVER (PARTITION BY house) AS BIGINT) AS total FROM s)
SELECT house, party, seats, total, total // 2 + 1 AS majority, (total // 2) / greatest(total, 1) * 100 AS tick, seats / greatest(total, 1) * 100 AS pct FROM w""")
def seat_majority(spark, sf):
    """AGG-08."""
    seats = _seats(spark, sf).groupBy("house", "party").agg(F.count("*").alias("seats"))
    return elections.seat_bar(seats)


LINE_ORDER = ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"""SELECT l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS votes, arg_min(l_returnflag, r) AS l_returnflag, arg_min(l_linestatus, r) AS l_linestatus
FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY {', '.join(LINE_ORDER)}) AS r FROM lineitem) GROUP BY l_partkey""")
def polling_place_totals(spark, sf):
    """AGG-01."""
    rows = t(spark, sf, "lineitem").withColumn("n", F.col("l_quantity").cast("long"))
    return elections.polling_place_totals(rows, "l_partkey", "n", LINE_ORDER, ["l_returnflag", "l_linestatus"])


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN sum(l_quantity) OVER w > 0 THEN round(l_quantity / sum(l_quantity) OVER w * 100 * 100) / 100 ELSE 0 END AS pct
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def candidate_share(spark, sf):
    """WIN-02, PRJ-07, AGG-06, NUM-01."""
    return elections.candidate_shares(t(spark, sf, "lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "pct")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN count(*) OVER w = 2 THEN l_quantity / greatest(sum(l_quantity) OVER w, 1) * 100 END AS share
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def two_candidate_share(spark, sf):
    """AGG-07."""
    return elections.two_candidate_shares(t(spark, sf, "lineitem"), "l_orderkey", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "share")


@query("""SELECT o_custkey, o_orderkey FROM (
  SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey % 1000 AS VARCHAR) DESC, o_orderkey) AS r
  FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) WHERE r = 1""")
def latest_contest(spark, sf):
    """WIN-03, JON-10: event ids compare as text."""
    contests = t(spark, sf, "orders").withColumn("event", F.col("o_orderkey") % 1000)
    current = t(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return elections.latest_contest(contests, current, "event", "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""SELECT user_id, event_id, event_type FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id) AS r FROM events) WHERE r = 1""")
def latest_open_seat(spark, sf):
    """WIN-04, WIN-06."""
    return ordering.latest_open(t(spark, sf, "events"), "user_id", "ts", ["event_id"]).select("user_id", "event_id", "event_type")


SLUG = "trim(regexp_replace(regexp_replace(lower({0}), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-')"


@query(f"""WITH s AS (SELECT p_partkey, {SLUG.format('p_name')} AS slug, {SLUG.format('p_brand')} AS suffix FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS nth FROM s),
a AS (SELECT *, row_number() OVER (PARTITION BY slug, suffix, nth > 1 ORDER BY p_partkey) AS again FROM n)
SELECT p_partkey, slug, CASE WHEN nth = 1 THEN slug WHEN again = 1 THEN slug || '-' || suffix ELSE slug || '-' || suffix || '-' || again END AS unique_slug FROM a""")
def slug_collisions(spark, sf):
    """WIN-05, STR-01."""
    rows = t(spark, sf, "part").select("p_partkey", text.slugify_ascii(F.col("p_name")).alias("slug"), text.slugify_ascii(F.col("p_brand")).alias("suffix"))
    return matching.unique_slugs(rows, "slug", "suffix", ["p_partkey"]).select("p_partkey", "slug", "unique_slug")


@query("SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_custkey")
def electorate_first_last(spark, sf):
    """AGG-17."""
    return elections.electorates_of(t(spark, sf, "orders"), "o_custkey", "o_orderstatus", ["o_orderkey"])


@query("""SELECT a.o_orderkey AS division, count(*) AS n, min(b.o_orderkey) AS first_other FROM orders a JOIN orders b
ON a.o_orderstatus = b.o_orderstatus AND a.o_orderpriority = b.o_orderpriority AND a.o_orderdate = b.o_orderdate AND a.o_orderkey <> b.o_orderkey GROUP BY 1""")
def same_day_ledger(spark, sf):
    """JON-20, AGG-16."""
    house = F.concat("o_orderstatus", "o_orderpriority")
    return linking.same_day_counts(t(spark, sf, "orders").select(house.alias("house"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("division")))


@query("""SELECT p_partkey AS bill_id, count(DISTINCT l_orderkey) AS n, coalesce(string_agg(DISTINCT l_orderkey, ',' ORDER BY l_orderkey), '') AS division_ids
FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey""")
def bill_division_links(spark, sf):
    """JON-08, JON-24, SET-04."""
    bills = t(spark, sf, "part").select(F.col("p_partkey").alias("bill_id"), F.lit(None).cast("array<string>").alias("division_ids"))
    named = t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("bill_ids"))
    divisions = named.select(F.col("l_orderkey").cast("string").alias("division"), F.col("l_orderkey").alias("ord"), "bill_ids")
    linked = linking.bill_divisions(bills, divisions)
    return linked.select("bill_id", F.size("division_ids").cast("long").alias("n"), F.concat_ws(",", "division_ids").alias("division_ids"))


@query("""SELECT p_partkey, CASE WHEN s_suppkey IS NOT NULL THEN 'id-' || s_suppkey WHEN n_name IS NOT NULL THEN 'name-' || lower(n_name) END AS person
FROM part LEFT JOIN supplier ON p_partkey = s_suppkey LEFT JOIN nation ON p_size = n_nationkey""")
def raiser_resolution(spark, sf):
    """JON-04: by id whatever its case, else by name, else nobody."""
    by_id = t(spark, sf, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("person_id"), F.concat(F.lit("id-"), "s_suppkey").alias("slug"))
    by_name = t(spark, sf, "nation").select(F.lit(None).cast("string").alias("person_id"), F.concat(F.lit("name-"), F.lower("n_name")).alias("slug"))
    names = t(spark, sf, "nation").select(F.col("n_nationkey").alias("p_size"), F.concat(F.lit("name-"), F.lower("n_name")).alias("name_slug"))
    rows = t(spark, sf, "part").join(names, "p_size", "left").select("p_partkey", F.concat(F.lit("S"), "p_partkey").alias("id"), "name_slug")
    return matching.resolve_by_id_then_slug(rows, by_id.unionByName(by_name)).select("p_partkey", "person")


@query("""WITH j AS (SELECT s.p_partkey AS source_id, p.p_partkey AS slug, count(*) OVER (PARTITION BY s.p_partkey) AS n, s.p_size = p.p_size AND s.p_brand = p.p_brand AS same
FROM part s JOIN part p ON p.p_name = s.p_name || CASE WHEN s.p_type = 'PROMO' THEN ' (late)' ELSE '' END OR CAST(p.p_partkey AS VARCHAR) = s.p_name)
SELECT source_id, min(slug) AS slug FROM j WHERE n = 1 OR same GROUP BY source_id""")
def name_then_seat_match(spark, sf):
    """JON-11: names that many bear are settled by seat; some sources bear a name that nobody has."""
    part = t(spark, sf, "part").select(F.col("p_partkey").alias("slug"), F.col("p_name").alias("name_slug"), F.col("p_size").alias("house"), F.col("p_brand").alias("seat"), F.lit(None).cast("string").alias("state"), F.col("p_partkey").alias("ord"), "p_type")
    late = F.concat("name_slug", F.when(F.col("p_type") == "PROMO", " (late)").otherwise(""))
    return matching.match_name_then_seat(part.withColumnRenamed("slug", "source_id").withColumn("name_slug", late), part)


@query(f"""WITH s AS (SELECT p_partkey, {SLUG.format('p_name')} AS slug, {SLUG.format('p_brand')} AS suffix, split_part(p_name, ' ', 2) AS family, p_brand || p_size AS seat, p_type FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS nth FROM s),
a AS (SELECT *, row_number() OVER (PARTITION BY slug, suffix, nth > 1 ORDER BY p_partkey) AS again FROM n),
p AS (SELECT *, CASE WHEN nth = 1 THEN slug WHEN again = 1 THEN slug || '-' || suffix ELSE slug || '-' || suffix || '-' || again END AS person FROM a),
f AS (SELECT s.p_partkey AS source_id, min(p.person) AS slug FROM s JOIN p USING (family, seat) WHERE s.p_type = 'PROMO' GROUP BY s.p_partkey HAVING count(*) = 1)
SELECT p_partkey AS source_id, slug FROM s WHERE p_type <> 'PROMO' UNION ALL SELECT * FROM f""")
def unique_family_fallback(spark, sf):
    """JON-12: full names by slug; other given names by family and seat where exactly one fits."""
    base = t(spark, sf, "part").select("p_partkey", "p_type", text.slugify_ascii(F.col("p_name")).alias("name_slug"), text.slugify_ascii(F.col("p_brand")).alias("suffix"), F.split("p_name", " ")[1].alias("family_slug"), F.concat("p_brand", "p_size").alias("seat"), F.lit(None).cast("string").alias("state"))
    people = matching.unique_slugs(base, "name_slug", "suffix", ["p_partkey"]).select(F.col("unique_slug").alias("slug"), "name_slug", "seat", "state", F.col("p_partkey").alias("ord"))
    given = F.when(F.col("p_type") == "PROMO", F.concat(F.lit("other-"), "family_slug")).otherwise(F.col("name_slug"))
    sources = base.select(F.col("p_partkey").alias("source_id"), given.alias("given_slug"), F.lit(None).cast("string").alias("preferred_slug"), "family_slug", "seat", "state")
    return matching.match_slug_then_family(sources, people)


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT c_custkey FROM customer)")
def stale_people(spark, sf):
    """JON-16, SET-05, INC-09: parts beyond the customers' keys."""
    return matching.stale(t(spark, sf, "part"), t(spark, sf, "customer").select(F.col("c_custkey").alias("p_partkey")), "p_partkey").select("p_partkey")


@query("""SELECT c_custkey, c_name, coalesce(s_nationkey, c_nationkey) AS c_nationkey, coalesce(s_acctbal, c_acctbal) AS c_acctbal
FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def ownership_merge(spark, sf):
    """JON-15, PRJ-22, JON-13."""
    stored = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("c_nationkey"), F.col("s_acctbal").alias("c_acctbal"))
    return matching.merge_owned(t(spark, sf, "customer"), stored, "c_custkey", ["c_nationkey", "c_acctbal"]).select("c_custkey", "c_name", "c_nationkey", "c_acctbal")


@query("""WITH n AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders),
s AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))
SELECT n.o_orderkey FROM n LEFT JOIN s ON n.o_orderkey = s.o_orderkey
WHERE s.o_orderkey IS NULL OR n.o_totalprice IS DISTINCT FROM s.o_totalprice OR n.o_orderstatus IS DISTINCT FROM s.o_orderstatus""")
def changed_only(spark, sf):
    """INC-02, INC-03: orders that were never stored, and those with another price."""
    rows = t(spark, sf, "orders")
    returned = t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    incoming = rows.withColumn("o_totalprice", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return incremental.changed_only(incoming, rows.join(returned, "o_orderkey", "left_semi"), "o_orderkey", ["o_totalprice", "o_orderstatus"]).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= DATE '1998-01-01' - INTERVAL 14 DAY")
def overlap_window(spark, sf):
    """INC-01, DT-02."""
    return incremental.overlap_window(t(spark, sf, "orders"), "o_orderdate", "1998-01-01").select("o_orderkey", "o_custkey")


@query("SELECT event_id FROM events WHERE epoch_ms(TIMESTAMP '2024-06-01') - epoch_ms(ts) >= 7 * 86400000")
def stale_profiles(spark, sf):
    """INC-04, DT-04."""
    rows = t(spark, sf, "events")
    return incremental.due(rows, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("2024-06-01 00:00:00").cast("timestamp")).select("event_id")


@query("""SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.quality IS DISTINCT FROM 1""")
def pending_versions(spark, sf):
    """INC-05."""
    notes = t(spark, sf, "labels").select("doc_id", F.col("quality").alias("version"))
    return incremental.pending(t(spark, sf, "documents"), notes, "doc_id", F.lit(1)).select("doc_id")


@query("""SELECT d.doc_id, coalesce(bool_or(b.text IS NOT NULL), false) AS transcript
FROM (SELECT doc_id, trim(unnest(string_split(text, chr(10))), ' ') AS line FROM documents) d LEFT JOIN (SELECT DISTINCT text FROM benchmark) b ON d.line = b.text GROUP BY d.doc_id""")
def transcript_lines(spark, sf):
    """PRJ-14: a line that is exactly a known text; the names are joined, not collected."""
    return linking.transcripts(t(spark, sf, "documents").select("doc_id", "text"), t(spark, sf, "benchmark"), "doc_id", "text", "text").select("doc_id", "transcript")


def _index(spark, sf):
    entry = lambda name, key, label, sub: t(spark, sf, name).select(F.col(key).cast("string").alias("slug"), F.col(label).alias("name"), F.col(sub).cast("string").alias("sub"))
    return ordering.search_index(entry("part", "p_partkey", "p_name", "p_brand"), entry("customer", "c_custkey", "c_name", "c_mktsegment"), entry("supplier", "s_suppkey", "s_name", "s_nationkey"))


INDEX = """WITH i AS (
  SELECT 'bill' AS t, CAST(p_partkey AS VARCHAR) AS slug, p_name AS name, p_brand AS sub, 0 AS rank FROM part
  UNION ALL SELECT 'person', CAST(c_custkey AS VARCHAR), c_name, c_mktsegment, 1 FROM customer
  UNION ALL SELECT 'electorate', CAST(s_suppkey AS VARCHAR), s_name, CAST(s_nationkey AS VARCHAR), 2 FROM supplier
)
"""


@query(INDEX + "SELECT * FROM i")
def search_index(spark, sf):
    """SET-01."""
    return _index(spark, sf)


@query(INDEX + "SELECT * FROM i WHERE contains(lower(name), '00') ORDER BY rank, name, slug LIMIT 8")
def quick_search(spark, sf):
    """TOP-04: eight rows are the feature."""
    return ordering.quick_search(_index(spark, sf), "00")


@query("SELECT c_custkey FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build') AND c_nationkey = 7")
def text_filter(spark, sf):
    """PRJ-23 to PRJ-27."""
    return ordering.text_filter(t(spark, sf, "customer"), text.search_text(F.col("c_name"), F.col("c_mktsegment")), "Build", c_nationkey="7").select("c_custkey")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY 1")
def month_runs(spark, sf):
    """AGG-10, PRJ-24."""
    return ordering.month_runs(t(spark, sf, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd")), "d")


@query("""SELECT user_id, strftime(ts, '%Y-%m-%d') AS date, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_activity(spark, sf):
    """AGG-11, AGG-12: the last of a tie."""
    steps = t(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("pos"), "event_type")
    return ordering.latest_step(steps, "user_id", "date", "pos", "event_type")


@query("""SELECT o_orderkey FROM orders
ORDER BY strftime(o_orderdate, '%Y-%m-%d') || '-' || lpad(CAST(o_orderkey AS VARCHAR), CAST(greatest(4, length(CAST(o_orderkey AS VARCHAR))) AS INTEGER), '0') || '-' || o_orderstatus DESC, o_orderkey DESC LIMIT 50""")
def newest_feed(spark, sf):
    """TOP-01 to TOP-03, SRT-03, SRT-06: fifty rows are the feature."""
    rows = t(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), F.col("o_orderkey").alias("number"), F.col("o_orderstatus").alias("house"), F.col("o_orderkey").alias("ord"), "o_orderkey")
    return ordering.divisions_newest_first(rows).limit(50).select("o_orderkey")


@query("""WITH e AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority,
    count(l_linestatus) FILTER (l_returnflag = 'A' AND l_linenumber = 1) AS assent, count(l_linestatus) FILTER (l_returnflag = 'R') AS thirds, count(l_linestatus) AS n
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL
)
SELECT o_orderkey, CAST(CASE WHEN assent > 0 THEN 4 ELSE greatest(CASE WHEN n > 0 AND n > thirds THEN 1 ELSE 0 END, CASE WHEN thirds >= 2 THEN 3 WHEN thirds = 1 THEN 2 ELSE 0 END,
  CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END) END AS INTEGER) AS stage FROM e""")
def bill_stage(spark, sf):
    """PRJ-17, PRJ-18."""
    event = F.when((F.col("l_returnflag") == "A") & (F.col("l_linenumber") == 1), "Assent").when(F.col("l_returnflag") == "R", "Third reading agreed").otherwise("First Reading")
    events = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(event).alias("events"))
    status = F.when(F.col("o_orderstatus") == "F", "Before Senate").when(F.col("o_orderstatus") == "O", "Before Reps").otherwise("Lapsed")
    bills = t(spark, sf, "orders").join(events, "o_orderkey", "left")
    return bills.select("o_orderkey", rules.bill_stage(F.coalesce("events", F.array().cast("array<string>")), status, F.lit("representatives")).alias("stage"))


STATUS = "CASE WHEN o_orderpriority LIKE '1%' THEN 'Before Senate' WHEN o_orderpriority LIKE '2%' THEN 'Act' WHEN o_orderpriority LIKE '3%' THEN 'Assent' ELSE o_orderpriority END"


@query(f"SELECT o_orderkey, CASE WHEN s LIKE 'Before%' THEN 'open' WHEN s IN ('Act', 'Assent') THEN 'act' ELSE 'other' END AS bucket FROM (SELECT o_orderkey, {STATUS} AS s FROM orders)")
def status_bucket(spark, sf):
    """PRJ-16."""
    p = F.substring("o_orderpriority", 1, 1)
    status = F.when(p == "1", "Before Senate").when(p == "2", "Act").when(p == "3", "Assent").otherwise(F.col("o_orderpriority"))
    return t(spark, sf, "orders").select("o_orderkey", rules.status_bucket(status).alias("bucket"))


@query("SELECT doc_id, CASE WHEN n <= 45 THEN 'l' WHEN n <= 90 THEN 'm' ELSE 's' END AS tier FROM (SELECT doc_id, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS n FROM documents)")
def title_tier(spark, sf):
    """PRJ-20, STR-16."""
    return t(spark, sf, "documents").select("doc_id", text.title_tier(F.col("text")).alias("tier"))


PROCEDURE_NAMES = {
    "Rearrangement of business": "Rearrangement", "suspension of standing orders": "Suspension of standing orders", "suspend the usual rules": "Suspension of standing orders",
    "That the question be now put": "Closure", "that the member be no longer heard": "Member no longer heard", "Debate be adjourned": "Adjournment",
    "Consideration in Detail": "Consideration in detail", "in Committee": "Committee of the whole", "First Reading": "First reading", "Second Reading": "Second reading",
    "third reading": "Third reading", "Order for the Production of Documents": "Order for the production of documents", "Disallowance motion": "Disallowance",
    "censure of a minister": "Censure", "Federation Chamber": "Federation Chamber referral", "Message from the Senate": "Message between the chambers", "other": None,
}
_LABELS = ", ".join("NULL" if x is None else f"'{x}'" for x in PROCEDURE_NAMES.values())


@query(f"SELECT event_id, ([{_LABELS}])[event_id % {len(PROCEDURE_NAMES)} + 1] AS procedure FROM events")
def procedure_label(spark, sf):
    """PRJ-19: each rule, and a name that none fits."""
    names = F.array(*[F.lit(x) for x in PROCEDURE_NAMES])
    return t(spark, sf, "events").select("event_id", rules.procedure(F.concat(F.lit("Bill - "), F.get(names, (F.col("event_id") % len(PROCEDURE_NAMES)).cast("int")))).alias("procedure"))


@query("""WITH r AS (SELECT user_id AS person, (['Prime Minister', 'Leader of the House', 'Member of a committee', 'Chief Whip', 'Deputy Speaker'])[event_id % 5 + 1] AS role, strftime(ts, '%Y-%m-%d') AS f FROM events)
SELECT person, role, min(f) AS since FROM r WHERE role <> 'Member of a committee' GROUP BY ALL""")
def leadership(spark, sf):
    """AGG-13."""
    roles = F.array(*[F.lit(x) for x in ("Prime Minister", "Leader of the House", "Member of a committee", "Chief Whip", "Deputy Speaker")])
    held = t(spark, sf, "events").select(F.col("user_id").alias("person"), F.get(roles, (F.col("event_id") % 5).cast("int")).alias("role"), F.date_format("ts", "yyyy-MM-dd").alias("from"), F.lit(None).cast("string").alias("to"))
    return ordering.leadership(held)


@query("""SELECT family, count(*) AS n FROM (SELECT p_name AS family FROM part) GROUP BY family HAVING count(*) >= 2""")
def title_families(spark, sf):
    """AGG-14, SRT-09."""
    return linking.title_families(t(spark, sf, "part").select(F.concat("p_name", F.lit(" (No. "), "p_size", F.lit(")")).alias("title")))


@query("""SELECT page_id, len(k) AS n, string_agg(CASE WHEN regexp_matches(x, '^[0-9]') THEN 'n' || coalesce(nullif(ltrim(x, '0'), ''), '0') ELSE 't' || x END, '|' ORDER BY i) AS key
FROM (SELECT page_id, k, unnest(k) AS x, unnest(range(len(k))) AS i FROM (SELECT page_id, regexp_extract_all(url || '/0' || repeat(CAST(page_id AS VARCHAR), 60), '([0-9]+|[^0-9]+)') AS k FROM pages)) GROUP BY page_id, k""")
def natural_order(spark, sf):
    """SRT-08: the parts of the sort key; numbers of sixty digits and more."""
    key = text.natural_key(F.concat("url", F.lit("/0"), F.repeat(F.col("page_id").cast("string"), F.lit(60))))
    value = lambda p: F.when(p["size"] == 0, "0").otherwise(p["digits"])
    shown = F.transform("key", lambda p: F.when(p["kind"] == 0, F.concat(F.lit("n"), value(p))).otherwise(F.concat(F.lit("t"), p["word"])))
    return t(spark, sf, "pages").withColumn("key", key).select("page_id", F.size("key").cast("long").alias("n"), F.array_join(shown, "|").alias("key"))


@query("SELECT p_name, row_number() OVER (ORDER BY p_name) AS rank FROM (SELECT DISTINCT p_name FROM part)")
def collated_rank(spark, sf):
    """SRT-01, SRT-02: names here are lower-case ASCII, where English collation and bytes agree; tests have others."""
    names = t(spark, sf, "part").select("p_name").distinct()
    return ordering.numbered(names, ordering.collated("p_name"), "p_name").select("p_name", (F.col("nth") + 1).alias("rank"))


@query(f"SELECT doc_id, {SLUG.format('source')} AS slug, lang FROM documents")
def slugify_names(spark, sf):
    """STR-01 with folding."""
    return t(spark, sf, "documents").select("doc_id", text.slugify(F.col("source")).alias("slug"), "lang")


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM part""")
def title_case_names(spark, sf):
    """STR-02."""
    return t(spark, sf, "part").select("p_partkey", text.title_case(F.upper("p_name")).alias("name"))


ENTITY_SQL = "html"
for _name, _char in (("nbsp", " "), ("quot", '"'), ("apos", "''"), ("lsquo", "‘"), ("rsquo", "’"), ("ldquo", "“"), ("rdquo", "”"), ("ndash", "–"), ("mdash", "—"), ("hellip", "…"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
    ENTITY_SQL = f"replace({ENTITY_SQL}, '&{_name};', '{_char}')"
STRIP_SQL = ENTITY_SQL.replace("html", "regexp_replace(html, '<[^>]*>', ' ', 'g')", 1)


@query(f"SELECT page_id, md5(trim(regexp_replace({STRIP_SQL} || ' ’–A&&eacute;<b> end', '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def strip_html_pages(spark, sf):
    """STR-04, STR-07: also decimal, hex, mixed-case, unknown and impossible entities."""
    html = F.concat("html", F.lit(" &#8217;&#x2013;&#X41;&AMP;&eacute;&#1114112;&#xD800;&#60;b&GT; end"))
    return t(spark, sf, "pages").select("page_id", F.md5(text.strip_html(html).cast("binary")).alias("text_md5"))


@query(f"SELECT page_id, md5(trim(regexp_replace({STRIP_SQL} || ' ’–A&AMP;é&lt; end', '\\s+', ' ', 'g'))) AS text_md5 FROM pages")
def profile_html_pages(spark, sf):
    """STR-05: case counts, and nothing is decoded twice."""
    html = F.concat("html", F.lit(" &rsquo;&#x2013;&#65;&AMP;&#233;&amp;lt;&#99999999999; end"))
    return t(spark, sf, "pages").select("page_id", F.md5(text.clean_profile_html(html).cast("binary")).alias("text_md5"))


@query("""SELECT page_id, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items, CAST(len(regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1)) AS BIGINT) AS pairs FROM pages""")
def label_value_pairs(spark, sf):
    """STR-12: tag contents by pattern."""
    inner = F.regexp_extract_all("html", F.lit("(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    return t(spark, sf, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("<li>"), F.lit(0))).cast("long").alias("items"), F.size(inner).cast("long").alias("pairs"))


@query("""SELECT c_custkey, 'Adviser' AS role, c_mktsegment AS org, '' AS period FROM customer WHERE c_custkey % 2 = 0
UNION ALL SELECT c_custkey, 'Clerk', c_mktsegment, '2003 – 2007' FROM customer WHERE c_custkey % 2 = 1""")
def occupation_parts(spark, sf):
    """STR-15, DT-06."""
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Adviser at the "), "c_mktsegment", F.lit("."))).otherwise(F.concat(F.lit("Clerk of the "), "c_mktsegment", F.lit(", 2003-2007")))
    return t(spark, sf, "customer").select("c_custkey", text.occupation(said, dates.dotted_date).alias("o")).select("c_custkey", "o.*")


@query("SELECT event_id, strftime(ts + INTERVAL 11 HOUR, '%Y-%m-%d') AS date FROM events")
def dotnet_dates(spark, sf):
    """DT-01."""
    value = F.concat(F.lit("/Date("), F.unix_millis(F.col("ts").cast("timestamp")).cast("string"), F.lit("+1100)/"))
    return t(spark, sf, "events").select("event_id", dates.dot_net_date(value).alias("date"))


@query("""SELECT o_orderkey, CAST(day(o_orderdate) AS VARCHAR) || ' ' || monthname(o_orderdate) || ' ' || year(o_orderdate) AS long_date,
  CAST(day(o_orderdate) AS VARCHAR) || ' ' || left(monthname(o_orderdate), 3) AS short_date, monthname(o_orderdate) || ' ' || year(o_orderdate) AS month FROM orders""")
def display_dates(spark, sf):
    """DT-05, DT-06."""
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t(spark, sf, "orders").select("o_orderkey", dates.format_date(d).alias("long_date"), dates.short_date(d).alias("short_date"), dates.month_label(d).alias("month"))


@query("""SELECT p_partkey, format('{:,}', p_partkey * 1237) AS grouped, CASE WHEN p_size > 25 THEN '+' ELSE '' END || CAST(p_size - 25 AS VARCHAR) AS swing,
  printf('%.1f', p_size / 4.0 + CASE WHEN p_size % 4 IN (1, 3) THEN 0.01 ELSE 0 END) AS fixed FROM part""")
def format_numbers(spark, sf):
    """NUM-02, NUM-04, NUM-05, NUM-07; a hundredth keeps quarters off the ties, which tests have."""
    swing = numbers.signed((F.col("p_size") - 25).cast("double"))
    value = F.col("p_size") / F.lit(4.0) + F.when((F.col("p_size") % 4).isin(1, 3), 0.01).otherwise(0.0)
    return t(spark, sf, "part").select("p_partkey", numbers.locale_int(F.col("p_partkey") * 1237).alias("grouped"), swing.alias("swing"), numbers.to_fixed(1)(value).alias("fixed"))


@query("""SELECT user_id, count(*) AS n, string_agg(event_id, ',' ORDER BY strftime(ts, '%Y-%m-%d') DESC, event_id % 3, event_id) AS ids FROM events GROUP BY user_id""")
def position_merge(spark, sf):
    """SET-02, SRT-05."""
    rows = t(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("from"), F.lit(None).cast("string").alias("to"), F.lit("x").alias("kind"), F.col("event_id").alias("pos"), F.col("event_id").cast("string").alias("role"))
    merged = ordering.merged_positions("user_id", *[rows.where(F.col("pos") % 3 == k) for k in range(3)])
    return merged.select("user_id", F.size("positions").cast("long").alias("n"), F.concat_ws(",", "positions.role").alias("ids"))


@query("""SELECT l_suppkey AS person, l_orderkey AS bill_id, CASE WHEN bool_or(l_returnflag = 'R') THEN 'Sponsor' ELSE 'Introduced' END AS role FROM lineitem GROUP BY ALL""")
def raised_bills(spark, sf):
    """JON-23."""
    kind = F.when(F.col("l_returnflag") == "R", "sponsor").otherwise("mover")
    return linking.raised_bills(t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("person"), F.col("l_orderkey").alias("bill_id"), kind.alias("kind")))


@query("SELECT p_partkey, (row_number() OVER (ORDER BY p_name, p_partkey) - 1) // 8 AS batch FROM part")
def batches_of_eight(spark, sf):
    """WIN-07."""
    return ordering.batches(t(spark, sf, "part"), 8, "p_name", "p_partkey").select("p_partkey", "batch")


@query("""SELECT c_custkey, 2 AS n, 'A <a href="/bills/' || n_nationkey || '/">' || lower(n_name) || '</a> &amp; ' || c_mktsegment || ' of <a href="/bills/' || n_nationkey || '/">' || n_name || '</a>' AS linked
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def mention_linker(spark, sf):
    """STR-18: known titles whatever their case, longest first; NATION_1 has no claim inside NATION_12."""
    titles = linking.title_links(t(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("title")))
    said = F.concat(F.lit("A "), F.lower("n_name"), F.lit(" & "), "c_mktsegment", F.lit(" of "), "n_name")
    texts = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", said.alias("text"))
    return linking.mentions(texts, titles, "c_custkey").select("c_custkey", F.size("mentions").alias("n"), "linked")


@query("""SELECT c_custkey AS slug, string_agg(o_orderkey, ',' ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey) AS contests
FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""")
def person_contests(spark, sf):
    """JON-05, SRT-05."""
    candidates = t(spark, sf, "orders").select(F.col("o_custkey").alias("name_slug"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("event_id"), F.col("o_orderkey").alias("ord"))
    people = t(spark, sf, "customer").select(F.col("c_custkey").alias("slug"))
    return linking.elections_of_people(candidates, people).select("slug", F.concat_ws(",", F.transform("elections", lambda e: e["ord"].cast("string"))).alias("contests"))


@query("""SELECT l_suppkey AS member, l_orderkey AS division, arg_min(l_linestatus, (l_linenumber, l_partkey, l_linestatus)) AS vote FROM lineitem GROUP BY ALL""")
def member_ballots(spark, sf):
    """JON-19: the first of a member's votes in a division."""
    rows = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("member"), F.col("l_orderkey").alias("division"), F.col("l_linestatus").alias("vote"), F.struct("l_linenumber", "l_partkey", "l_linestatus").alias("pos"))
    return linking.votes_of(rows)


@query("""WITH w AS (SELECT s_suppkey % 40 AS person_id, max(s_suppkey) AS slug FROM supplier GROUP BY 1)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN slug IS NULL THEN 'name-' || l_suppkey ELSE 'id-' || slug END AS member FROM lineitem LEFT JOIN w ON l_suppkey % 50 = person_id""")
def vote_crosswalk(spark, sf):
    """JON-18: the last slug of a shared id, else the name's slug."""
    ids = t(spark, sf, "supplier").select((F.col("s_suppkey") % 40).alias("person_id"), F.concat(F.lit("id-"), "s_suppkey").alias("slug"), F.col("s_suppkey").alias("ord"))
    rows = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_suppkey") % 50).alias("person_id"), F.concat(F.lit("name-"), "l_suppkey").alias("name_slug"))
    return matching.crosswalk(rows, ids).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "member")


@query("""SELECT c_custkey, coalesce(n_name, c_name) AS c_name, s_acctbal FROM customer LEFT JOIN nation ON c_custkey = n_nationkey LEFT JOIN supplier ON c_custkey = s_suppkey""")
def enriched_people(spark, sf):
    """JON-03, JON-06, JON-13, JON-14, JON-17."""
    overrides = t(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("c_custkey"), F.col("n_name").alias("c_name"))
    side = t(spark, sf, "supplier").withColumnRenamed("s_suppkey", "c_custkey")
    named = matching.with_overrides(t(spark, sf, "customer"), overrides, "c_custkey", "c_name")
    return matching.left_enrich(named, side, "c_custkey", ["s_acctbal"]).select("c_custkey", "c_name", "s_acctbal")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 1 ELSE 0 END AS v FROM orders")
def merged_versions(spark, sf):
    """INC-10, SET-03, INC-09: incoming rows before stored ones; orders of status F are in both."""
    rows = t(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    stored, incoming = rows.where("o_orderstatus in ('O', 'F')").withColumn("v", F.lit(0)), rows.where("o_orderstatus in ('F', 'P')").withColumn("v", F.lit(1))
    return incremental.upsert(stored, incoming, ["o_orderkey"], "o_orderdate").select("o_orderkey", "v")


@query("""SELECT user_id, strftime(max(ts), '%Y-%m-%d') AS last_day FROM events GROUP BY user_id""")
def user_cursors(spark, sf):
    """INC-01, AGG-11: the latest date of what was fetched."""
    days = t(spark, sf, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd").alias("d"))
    return days.groupBy("user_id").agg(F.max("d").alias("last_day"))


@query("""SELECT o.o_orderkey FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON o_orderkey = l_orderkey
WHERE o_orderkey % 4 = 0 OR n IS NULL""")
def stale_markers(spark, sf):
    """INC-03: another marker, or no step stored."""
    steps = t(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("timeline"))
    stored = t(spark, sf, "orders").join(steps, "o_orderkey").select("o_orderkey", F.lit("m1").alias("marker"), "timeline")
    incoming = t(spark, sf, "orders").withColumn("marker", F.when(F.col("o_orderkey") % 4 == 0, "m2").otherwise("m1"))
    return incremental.stale_marker(incoming, stored, "o_orderkey", "marker", "timeline").select("o_orderkey")


@query("SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS text FROM part WHERE p_partkey IN (SELECT c_custkey FROM customer)")
def accepted_answers(spark, sf):
    """JSN-05, INC-05: answers of the batch only, texts trimmed."""
    answer = F.to_json(F.array(F.struct(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit(" "), "p_name", F.lit(" ")).alias("summary"))))
    batch = t(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    return incremental.accepted_answers(t(spark, sf, "part").select(answer.alias("answer")), batch, False)


@query("""SELECT p_partkey, 'Alpha Act 1999' AS first_act, p_name AS first_item, 'Beta Code' AS second_act, p_brand || '; ' || p_type AS second_items FROM part""")
def summary_groups(spark, sf):
    """STR-13."""
    said = F.concat(F.lit("Amends the: Alpha Act 1999 to: "), "p_name", F.lit("; and Beta Code to "), "p_brand", F.lit("; "), "p_type", F.lit("."))
    g = t(spark, sf, "part").select("p_partkey", text.summary_groups(said).alias("g"))
    return g.select("p_partkey", F.expr("g[0].acts").alias("first_act"), F.concat_ws("; ", F.expr("g[0].items")).alias("first_item"), F.expr("g[1].acts").alias("second_act"), F.concat_ws("; ", F.expr("g[1].items")).alias("second_items"))


@query("""SELECT p_partkey, 'To:' AS lead, p_name || '|' || p_brand || '|' || p_type || '|end' AS items, p_name AS qual, p_brand AS institution FROM part""")
def summary_lists(spark, sf):
    """STR-14, STR-17."""
    said = F.concat(F.lit("To: "), "p_name", F.lit("; "), "p_brand", F.lit(";  and "), "p_type", F.lit("; end"))
    rows = t(spark, sf, "part").select("p_partkey", text.summary_list(said).alias("s"), text.qualification(F.concat("p_name", F.lit(", "), "p_brand")).alias("q"))
    return rows.select("p_partkey", "s.lead", F.concat_ws("|", "s.items").alias("items"), "q.qual", "q.institution")


@query("""SELECT c_custkey, upper(substr(c_name, 1, 1)) || upper(substr(c_mktsegment, 1, 1)) AS initials, replace(c_name, '#', '%23') || '%20%26%20(x)' AS coded,
  c_name || ' & (x)' AS decoded, '&lt;' || c_name || '&gt;' AS escaped, 'person-' || c_custkey AS key FROM customer""")
def text_codes(spark, sf):
    """STR-07, STR-08, STR-11, STR-20."""
    coded = text.encode_component(F.concat("c_name", F.lit(" & (x)")))
    return t(spark, sf, "customer").select(
        "c_custkey", text.initials(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("initials"), coded.alias("coded"), text.decode_component(coded).alias("decoded"),
        text.escape_html(F.concat(F.lit("<"), "c_name", F.lit(">"))).alias("escaped"), text.storage_key(F.concat(F.lit("person/"), "c_custkey")).alias("key"),
    )


@query("""SELECT s_suppkey, 'Given ' || upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def raiser_names(spark, sf):
    """STR-03, STR-02."""
    rows = t(spark, sf, "supplier").join(t(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", text.raiser_name(F.concat(F.upper("n_name"), F.lit(", the Hon. Dr Given Other, MP"))).alias("name"))


@query("""SELECT c_custkey, (['NSW', 'VIC', NULL])[c_custkey % 3 + 1] AS state, CASE WHEN c_custkey % 3 = 2 THEN 'Member for ' || c_name ELSE 'Senator for ' || (['New South Wales', 'Victoria'])[c_custkey % 3 + 1] END AS seat FROM customer""")
def seat_descriptors(spark, sf):
    """PRJ-09, PRJ-11, PRJ-29."""
    names = F.array(F.lit("New South Wales"), F.lit("victoria"), F.lit("Elsewhere"))
    rows = t(spark, sf, "customer").withColumn("state", text.as_state(F.get(names, (F.col("c_custkey") % 3).cast("int"))))
    house = F.when(F.col("c_custkey") % 3 == 2, "representatives").otherwise("senate")
    return rows.select("c_custkey", "state", rules.seat_descriptor(house, text.state_name(F.col("state")), F.col("c_name")).alias("seat"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE strftime(ts, '%Y-%m-%d') END AS day, strftime(ts, '%Y-%m-%d') || 'T00:00:00Z' AS stamp FROM events""")
def clean_dates(spark, sf):
    """DT-03, DT-08."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    given = F.when(F.col("event_id") % 3 == 0, "1900-01-01T00:00:00").otherwise(iso)
    return t(spark, sf, "events").select("event_id", dates.clean_date(given).alias("day"), dates.feed_timestamp(F.date_format("ts", "yyyy-MM-dd")).alias("stamp"))


@query("""SELECT word, count(DISTINCT item_id) AS n FROM (SELECT item_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM benchmark) WHERE word <> '' GROUP BY word""")
def word_index(spark, sf):
    """SNK-09."""
    from .views import word_index as index

    return index(t(spark, sf, "benchmark"), "item_id", "text")


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'application/json' ELSE 'text/csv' END AS kind FROM pages""")
def content_types(spark, sf):
    """SNK-04."""
    return t(spark, sf, "pages").select("page_id", text.content_type(F.concat("url", F.when(F.col("page_id") % 2 == 0, ".json").otherwise(".csv"))).alias("kind"))


@query("""SELECT p_partkey, CAST(2 AS BIGINT) AS n, p_type AS size, p_brand AS brand FROM part""")
def label_map(spark, sf):
    """STR-12: the last of equal labels counts, blanks don't."""
    html = F.concat(F.lit("<dl><dt>Size:</dt><dd>old</dd><dt>Brand </dt>\n<dd>"), "p_brand", F.lit("</dd><dt>None</dt><dd> </dd><dt>SIZE</dt><dd><b>"), "p_type", F.lit("</b></dd></dl>"))
    m = t(spark, sf, "part").select("p_partkey", text.label_values(html).alias("m"))
    return m.select("p_partkey", F.size("m").cast("long").alias("n"), F.expr("m['size']").alias("size"), F.expr("m['brand']").alias("brand"))


@query("""SELECT o_orderkey, CAST(epoch_ms(o_orderdate) AS BIGINT) // 86400000 AS days FROM orders""")
def epoch_days(spark, sf):
    """DT-07: milliseconds of a date text."""
    millis = F.unix_millis(F.try_to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return t(spark, sf, "orders").select("o_orderkey", F.floor(millis / 86_400_000).alias("days"))


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus || o_orderpriority AS house, o_orderdate AS d FROM orders)
SELECT a.o_orderkey AS division, coalesce(string_agg(b.o_orderkey, '; ' ORDER BY b.o_orderkey), '') AS ledger FROM o a LEFT JOIN o b ON a.house = b.house AND a.d = b.d AND a.o_orderkey <> b.o_orderkey GROUP BY 1""")
def prompt_ledger(spark, sf):
    """JON-25."""
    rows = t(spark, sf, "orders").select(F.col("o_orderkey").alias("division"), F.concat("o_orderstatus", "o_orderpriority").alias("house"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("number"), F.col("o_orderkey").cast("string").alias("name"), F.array(F.lit("b")).alias("bill_ids"))
    bills = spark.createDataFrame([("b", "A bill")], "bill_id string, title string")
    return linking.prompt_context(rows, bills).select("division", F.coalesce("ledger", F.lit("")).alias("ledger"))
