"""Operators on small inline tables, and the queries against DuckDB."""

import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from plenarium.operators import elections, linking, matching, ordering, votes
from plenarium.plans.queries import QUERIES, SQL
from plenarium.sources.published import Table, bucket_of
from plenarium.streaming import incremental

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        path = f"{SF}/{name}.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def shown(frame, columns):
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(str, plain.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert shown(ours, columns) == shown(theirs, columns)


def test_entry(spark):
    assert entry.entry(spark).count() == 10


def test_ties_have_no_side(spark):
    rows = [("d", 1, "x", "aye"), ("d", 2, "x", "no"), ("d", 3, "y", "aye"), ("d", 4, "y", "aye"), ("d", 5, "y", "no")]
    got = {r.member: (r.side, r.crossed) for r in votes.crossed_votes(spark.createDataFrame(rows, "division string, member int, party string, vote string")).collect()}
    assert got == {1: (None, None), 2: (None, None), 3: ("aye", None), 4: ("aye", None), 5: ("aye", True)}


def test_member_stats_count_any_house(spark):
    crossed = spark.createDataFrame([("a", True), ("a", None), ("b", None)], "member string, crossed boolean")
    divisions = spark.createDataFrame([("d1", "senate"), ("d2", "senate")], "division string, house string")
    people = spark.createDataFrame([("a", "senate"), ("b", "representatives"), ("c", "senate")], "slug string, house string")
    assert sorted(map(tuple, votes.member_stats(people, crossed, divisions).collect())) == [("a", 2, 2, 1), ("c", 2, 0, 0)]


def test_slug_collisions_get_suffix_then_number(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "x"), (4, "a", "y")], "k int, slug string, sfx string")
    got = [r.unique_slug for r in matching.unique_slugs(rows, "slug", "sfx", ["k"]).orderBy("k").collect()]
    assert got == ["a", "a-x", "a-x-2", "a-y"]


def test_seat_matching(spark):
    people = spark.createDataFrame([("p1", "jo", "s", None, "VIC", 1), ("p2", "jo", "r", "north", None, 2), ("p3", "al", "r", "south", None, 3)], "slug string, name_slug string, house string, seat string, state string, ord int")
    sources = spark.createDataFrame([(1, "jo", "r", "north", None), (2, "al", "s", "x", None), (3, "jo", "r", "east", None)], "source_id int, name_slug string, house string, seat string, state string")
    assert sorted(map(tuple, matching.match_name_then_seat(sources, people).collect())) == [(1, "p2"), (2, "p3")]


def test_family_fallback_needs_exactly_one(spark):
    people = spark.createDataFrame([("ann-lee", "ann-lee", "north", None, 1), ("bob-lee", "bob-lee", "south", "NSW", 2), ("cat-lee", "cat-lee", None, "NSW", 3), ("di-van-roy-2", "di-van-roy", "west", None, 4)], "slug string, name_slug string, seat string, state string, ord int")
    sources = spark.createDataFrame([(1, "ann-lee", None, "lee", "x", None), (2, "annie-lee", None, "lee", "north", None), (3, "z-lee", None, "lee", None, "NSW"), (4, "rob-lee", "bob-lee", "lee", None, None), (5, "d-van-roy", None, "van-roy", "west", None), (6, "d-roy", None, "roy", "west", None), (7, "d-oy", None, "oy", "west", None)], "source_id int, given_slug string, preferred_slug string, family_slug string, seat string, state string")
    assert sorted(map(tuple, matching.match_slug_then_family(sources, people).collect())) == [(1, "ann-lee"), (2, "ann-lee"), (4, "bob-lee"), (5, "di-van-roy-2"), (6, "di-van-roy-2")]


def brute_links(text, titles):
    """Titles by rank, then the longest first, each one's places from the left; claims never overlap."""
    low, spans = text.lower(), []
    for title, href, _ in sorted(titles, key=lambda t: (t[2], -len(t[0]), t[1])):
        at = low.find(title.lower())
        while at >= 0:
            end = at + len(title)
            free = all(end <= a or at >= b for a, b, _ in spans)
            if free:
                spans.append((at, end, href))
            at = low.find(title.lower(), end if free else at + 1)
    return [(a, b - a, h) for a, b, h in sorted(spans)]


@pytest.mark.parametrize("broadcast", [0, 100])
def test_mentions(spark, monkeypatch, broadcast):
    monkeypatch.setattr(linking, "BROADCAST", broadcast)
    titles = [("Alpha Beta", "/ab/", 0), ("beta", "/b/", 0), ("Beta Act", "/ba/", 0), ("alpha bills", "/f/", 1), ("Ωmega & Co", "/w/", 0), ("act alpha bills now", "/late/", 1)]
    texts = ["The alpha beta act and Beta", "beta act alpha bills now, ALPHA BILLS", "nothing <here>", "", "ωmega & co, BETA", "betabeta betaact beta act"]
    rows = spark.createDataFrame([*enumerate(texts), (99, None)], "i int, text string")
    got = {r.i: r for r in linking.mentions(rows, spark.createDataFrame(titles, "title string, href string, rank int"), "i").collect()}
    assert got[99].mentions is None and got[99].linked is None
    for i, text in enumerate(texts):
        want = brute_links(text, titles)
        assert [tuple(m) for m in got[i].mentions] == want
        shown, at = "", 0
        escape = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        for start, size, href in want:
            shown += escape(text[at:start]) + f'<a href="{href}">' + escape(text[start : start + size]) + "</a>"
            at = start + size
        assert got[i].linked == shown + escape(text[at:])


def test_mentions_of_many_titles(spark):
    """Titles of one to thirty characters out of the texts and beside them, some of one repeated character."""
    rng = random.Random(2)
    draw = lambda n: "".join(rng.choice("ab cé𝄞") for _ in range(n))
    texts = [draw(rng.choice([0, 3, 7, 8, 40, 300])) for _ in range(30)] + ["a" * 50, "aaaaaaaab" * 4]
    cut = lambda t: t[(at := rng.randrange(len(t))) : at + rng.choice([1, 2, 6, 7, 8, 9, 20, 30])]
    names = {cut(t) for t in texts if t} | {draw(rng.choice([5, 8, 12])) for _ in range(30)} | {"a" * 8, "a" * 11, "a" * 3}
    titles = [(n, f"/{i}/", i % 2) for i, n in enumerate(sorted(names))]
    got = {r.i: r for r in linking.mentions(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), spark.createDataFrame(titles, "title string, href string, rank int"), "i").collect()}
    for i, text in enumerate(texts):
        assert [tuple(m) for m in got[i].mentions] == brute_links(text, titles), text


def test_mentions_move_only_what_is_found(spark, monkeypatch):
    """Places at which a title may stand are compared beside their text; only those in long texts meet it by key."""
    monkeypatch.setattr(linking, "LONG", 77)
    texts = spark.createDataFrame([(str(i), "abababab abababac") for i in range(3)], "key string, low string")
    found = linking._occurrences(texts, spark.createDataFrame([("abababac", 0, "/c/"), ("abababad", 0, "/d/")], "low string, rank int, href string"))
    assert sorted(map(tuple, found.collect())) == [(str(i), 9, 8, 0, "/c/") for i in range(3)]
    by_key = re.split(r"Join Inner.*\(key#\d+ = key#\d+\)", found._jdf.queryExecution().optimizedPlan().toString())[1:]
    assert len(by_key) == 1 and "> 77" in by_key[0]


def test_mentions_in_long_texts(spark, monkeypatch):
    monkeypatch.setattr(linking, "LONG", 12)
    titles = [("beta", "/b/", 0), ("alpha beta", "/ab/", 0)]
    texts = ["beta", "the alpha beta act", "alpha beta", "beta and no more alpha"]
    got = {r.i: r for r in linking.mentions(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), spark.createDataFrame(titles, "title string, href string, rank int"), "i").collect()}
    assert [[tuple(m) for m in got[i].mentions] for i in range(4)] == [brute_links(text, titles) for text in texts]


def test_name_match_by_slug_too(spark):
    people = spark.createDataFrame([("jo-dee", "joanne-dee", "r", "north", None, 1)], "slug string, name_slug string, house string, seat string, state string, ord int")
    sources = spark.createDataFrame([(1, "jo-dee", "s", "x", None), (2, "joanne-dee", "r", "y", None), (3, None, "r", "north", None)], "source_id int, name_slug string, house string, seat string, state string")
    assert sorted(map(tuple, matching.match_name_then_seat(sources, people).collect())) == [(1, "jo-dee"), (2, "jo-dee")]


def test_crossed_votes_of_nobody(spark):
    """Ties have no side, and a missing party is a party."""
    rows = spark.createDataFrame([(1, "a", "x", "aye"), (1, "b", "x", "no"), (1, "c", None, "aye"), (1, "d", None, "aye"), (1, "e", None, "no")], "division int, member string, party string, vote string")
    assert {r.member: (r.side, r.crossed) for r in votes.crossed_votes(rows).collect()} == {"a": (None, None), "b": (None, None), "c": ("aye", None), "d": ("aye", None), "e": ("aye", True)}


def test_numbered(spark):
    """Places in English order, also in many ranges."""
    names = ["b", "ANZAC Day", "a", "B", "Aged Care", *(f"n{k:04d}" for k in range(500))]
    rows = spark.createDataFrame([(n,) for n in names], "n string").repartition(7)
    got = ordering.numbered(rows, ordering.collated("n"), "n").orderBy("nth").collect()
    assert [r.n for r in got[:5]] == ["a", "Aged Care", "ANZAC Day", "b", "B"] and [r.nth for r in got] == list(range(505))
    assert [r.n for r in got[5:]] == names[5:]
    assert ordering.numbered(rows.limit(0), "n").count() == 0


def test_budget():
    budget = incremental.Budget(2, 2)
    budget.spend()
    budget.spend()
    with pytest.raises(RuntimeError):
        budget.spend()
    budget.failure(ValueError("one"))
    with pytest.raises(RuntimeError, match="two"):
        budget.failure(ValueError("two"))


def test_run_sources():
    done = []

    def bad():
        raise OSError("no answer")

    assert incremental.run_sources({"a": lambda: done.append(1), "b": bad, "c": lambda: done.append(2)}) == [("a", True, None), ("b", False, "no answer"), ("c", True, None)]
    assert done == [1, 2]


def test_run_counters(spark):
    rows, seen = incremental.run_counters(spark.createDataFrame([("fetched",), ("fetched",), ("skipped",), ("unmatched",)], "status string"))
    assert rows.count() == 4 and seen.get == {"fetched": 2, "skipped": 1, "failed": 0, "unmatched": 1}


def test_bill_links_keep_what_was_there(spark):
    bills = spark.createDataFrame([("b", ["d9"]), ("c", None)], "bill_id string, division_ids array<string>")
    divisions = spark.createDataFrame([("d2", 2, ["b"]), ("d1", 1, ["b", "zz"])], "division string, ord int, bill_ids array<string>")
    assert {r.bill_id: r.division_ids for r in linking.bill_divisions(bills, divisions).collect()} == {"b": ["d9", "d1", "d2"], "c": []}


def test_shares_of_nothing(spark):
    rows = spark.createDataFrame([("e", 0), ("e", 0), ("f", 1), ("f", 2)], "e string, v int")
    assert sorted(r.pct for r in elections.candidate_shares(rows, "e", "v").collect()) == [0.0, 0.0, 33.33, 66.67]


def test_quick_search_needs_two_characters(spark):
    entry_ = lambda *n: spark.createDataFrame([(x, x, "s") for x in n], "slug string, name string, sub string")
    index = ordering.search_index(entry_("Abbey"), entry_("Abba"), entry_("Cab"))
    assert [r.t for r in ordering.quick_search(index, "AB").collect()] == ["bill", "person", "electorate"]
    assert ordering.quick_search(index, "a").count() == 0


def test_collation(spark):
    rows = spark.createDataFrame([("b",), ("ANZAC Day",), ("a",), ("B",), ("Aged Care",)], "n string")
    assert [r.n for r in ordering.in_order(rows, ordering.collated("n"), "n").collect()] == ["a", "Aged Care", "ANZAC Day", "b", "B"]


def test_incremental(spark):
    stored = spark.createDataFrame([(1, 5, 1), (2, 6, 1)], "k int, v int, ts int")
    new = spark.createDataFrame([(1, 5, 2), (2, 7, 2), (3, None, 2)], "k int, v int, ts int")
    assert sorted(r.k for r in incremental.changed_only(new, stored, "k", ["v"]).collect()) == [2, 3]
    assert sorted(map(tuple, incremental.upsert(stored, new.where("k > 1"), ["k"], "ts").collect()), key=str) == [(1, 5, 1), (2, 7, 2), (3, None, 2)]
    manifest = spark.createDataFrame([("a", "t0", False, "bad")], "source string, lastSync string, ok boolean, note string")
    assert sorted(map(tuple, incremental.record_sync(manifest, "a", "t1", True).collect())) == [("a", "t1", True, None)]
    answers = spark.createDataFrame([('[{"id":"1","summary":" x "},{"id":"9","summary":"y"},{"id":"2","summary":" "}]',)], "answer string")
    batch = spark.createDataFrame([("1",), ("2",)], "id string")
    assert [tuple(r) for r in incremental.accepted_answers(answers, batch, False).collect()] == [("1", "x")]
    assert incremental.accepted_answers(answers, batch, True).count() == 2


def test_upsert_stream(spark, tmp_path):
    source = tmp_path / "in"
    for i, rows in enumerate(([(1, "a", 1), (2, "b", 1)], [(1, "c", 2), (3, "d", 2)])):
        spark.createDataFrame(rows, "k int, v string, ts int").coalesce(1).write.mode("append").parquet(f"{source}/{i}")
    stream = spark.readStream.schema("k int, v string, ts int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(source))
    table = Table(spark, str(tmp_path / "table"))
    table.publish_buckets(spark.createDataFrame([(9, "there", 0), (2, "old", 0)], "k int, v string, ts int").withColumn("bucket", bucket_of(["k"], 4)), "bucket")
    for _ in range(2):
        incremental.upsert_stream(stream, table.root, str(tmp_path / "state"), ["k"], "ts", buckets=4).awaitTermination()
    assert sorted(map(tuple, table.read().collect())) == [(1, "c", 2), (2, "b", 1), (3, "d", 2), (9, "there", 0)]


def test_watermarked_streams(spark, tmp_path):
    """Streams give what the same batch gives once all days are final."""
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "ts")
    later = events.limit(1).selectExpr("-1L as user_id", "'end' as event_type", "timestamp_ntz'2099-01-01 00:00:00' as ts")
    for i, part in enumerate((events, later)):
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    days = incremental.daily_counts_stream(stream, "ts", "event_type")
    run = days.writeStream.format("memory").queryName("days").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {(r.d, r.event_type): r.n for r in spark.sql("select date(window.start) as d, event_type, n from days").collect()}
    want = {(r.d, r.event_type): r.n for r in events.selectExpr("date(ts) as d", "event_type").groupBy("d", "event_type").agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()}
    assert got == want
    last = incremental.latest_by_key_stream(stream, "ts", "user_id").writeStream.format("memory").queryName("last").outputMode("complete").option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start()
    last.awaitTermination()
    assert spark.sql("select sum(n) from last").first()[0] == events.count() + 1


def _plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def test_day_ledgers(spark):
    from plenarium.plans import flows

    schema = "division long, house string, date string, number long, name string"
    rows = [(1, "s", "d1", 1, "Ünë"), (2, "s", "d1", 2, "two; x"), (3, "s", "d1", 3, "三"), (4, "s", "d2", 1, "alone"), (5, None, "d1", 1, "no house"), (6, "r", "d1", 2, None), (7, "r", "d1", 1, "seven"), (8, "r", "d1", 3, "eight")]
    got = dict(linking.with_day_ledgers(spark.createDataFrame(rows, schema), F.col("name"), "; ").select("division", "ledger").collect())
    assert got == {1: "two; x; 三", 2: "Ünë; 三", 3: "Ünë; two; x", 4: None, 5: None, 6: "seven; eight", 7: "eight", 8: "seven"}
    divisions = spark.createDataFrame([(*r, "said", ["b"]) for r in rows], f"{schema}, summary string, bill_ids array<string>")
    bills = spark.createDataFrame([("b", "A bill", None)], "bill_id string, title string, summary string")
    prompts = flows.division_prompts(divisions, bills)
    found = {r.division: r for r in prompts.collect()}
    assert found[2].ledger == "- (division 1) Ünë\n- (division 3) 三" and found[4].ledger == "" and found[5].ledger == ""
    assert found[2].bills == "- A bill: no official summary" and found[2].excerpt == "said"
    # The ledgers, pairs of divisions by nature, are neither joined nor moved once they are made.
    for df in (prompts, linking.prompt_context(divisions, bills)):
        assert "Join" not in _plan(df).split("Window")[0] and "Window" in _plan(df)


def test_day_prompts_move_no_text(spark):
    """Rows go to their day in all partitions before lines, heads and excerpts are made of what moved."""
    from plenarium.plans import flows

    rows = [(1, "s", "d1", 1, "Ünë", ["b", "gone", "a"]), (2, "s", "d1", 2, "two", []), (3, None, "d1", 3, None, None), (None, "r", "d1", 4, "four", ["a"]), (None, "r", "d1", 5, "five 😀", None)]
    divisions = spark.createDataFrame(rows, "division long, house string, date string, number long, name string, bill_ids array<string>")
    bills = spark.createDataFrame([("a", "An act", "sums"), ("b", "A bill", None)], "bill_id string, title string, summary string")
    prompts = flows.division_prompts(divisions, bills, F.concat("name", F.lit(" said " + "é" * 2300)))
    found = {r.number: r for r in prompts.withColumn("number", F.regexp_extract("head", r"division (\d+)", 1)).collect()}
    assert len(found) == 5 and found[None].ledger == ""
    assert found["1"].ledger == "- (division 2) two" and found["2"].ledger == "- (division 1) Ünë" and found["1"].bills == "- A bill: no official summary\n- An act: sums"
    assert found["2"].excerpt == "two said " + "é" * 2191 and found["5"].excerpt == "five 😀 said " + "é" * 2187 and found["4"].bills == found["4"].ledger == ""
    after, before = _plan(prompts).split("Exchange hashpartitioning(house", 1)
    assert "REPARTITION_BY_NUM" in before and "said" in after and "- (division " in after
    assert " said " not in before and "- (division " not in before
    # A stored summary is cut before it moves.
    stored = flows.division_prompts(divisions.withColumn("summary", F.lit("x" * 2300)), bills)
    assert {len(r.excerpt) for r in stored.collect()} == {2200} and stored.columns == ["division", "head", "bills", "ledger", "excerpt"]


def test_family_by_counts(spark):
    """Those of a family are counted by place, so a common family isn't paired with all its sources."""
    seats = "slug string, name_slug string, seat string, state string, ord int"
    people = spark.createDataFrame([("a-lee", "a-lee", "s1", "NSW", 1), ("b-lee", "b-lee", "s2", "NSW", 2), ("c-lee", "c-lee", "s3", None, 3), ("d-roy", "d-roy", None, "VIC", 4), ("e-roy", "e-roy", "s1", "QLD", 5)], seats)
    asked = [(1, "s1", "NSW"), (2, "s1", None), (3, "s3", "NSW"), (4, "s3", "VIC"), (5, None, None), (6, "s2", "SA"), (7, "s9", "WA")]
    sources = [(i, "x-lee", None, "lee", seat, state) for i, seat, state in asked] + [(8, "x-roy", None, "roy", "s1", "QLD"), (9, "x-roy", None, "roy", "s1", "VIC"), (10, "x-roy", None, "roy", None, "VIC")]
    rows = spark.createDataFrame(sources, "source_id int, given_slug string, preferred_slug string, family_slug string, seat string, state string")
    found = matching.match_slug_then_family(rows, people)
    assert sorted(map(tuple, found.collect())) == [(2, "a-lee"), (4, "c-lee"), (6, "b-lee"), (8, "e-roy"), (10, "d-roy")]
    joins = [line for line in _plan(found).splitlines() if "Join" in line and "family_slug" in line]
    assert len(joins) == 3 and all("seat" in line or "state" in line for line in joins)
