"""End to end over a small store of invented entities."""

import json
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from plenarium import schemas
from plenarium.plans import gold, views
from plenarium.sources import files


def put(folder, name, entity):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{name}.json").write_text(json.dumps(entity, indent=1))


@pytest.fixture(scope="module")
def store(tmp_path_factory):
    root = tmp_path_factory.mktemp("store")
    person = lambda slug, name, house, **more: put(root / "people", slug, {"slug": slug, "name": name, "house": house, "group": "Reds", "groupSlug": "reds", "ids": {}, **more})
    person("ada-moss", "Ada Moss", "representatives", electorate="north", ids={"aph": "AB1"}, positions=[{"role": "Chief Whip", "kind": "position", "from": "2020-01-01"}])
    person("bo-reed", "Bo Reed", "senate", state="VIC", group="Independent", groupSlug="independent")
    put(root / "electorates", "north", {"slug": "north", "name": "North", "state": "NSW"})
    put(root / "electorates", "east", {"slug": "east", "name": "East", "state": "WA"})
    put(root / "divisions", "d1", {"id": "representatives/2025-05-01/1", "house": "representatives", "date": "2025-05-01", "number": 1, "name": "Second Reading", "summary": "x\n Ada Moss \ny", "result": "passed", "ayes": 1, "noes": 0, "billIds": ["b1", "gone"], "votes": [{"personSlug": "ada-moss", "vote": "aye", "againstGroupMajority": True}, {"personSlug": "no-body", "vote": "no"}]})
    put(root / "divisions", "d2", {"id": "senate/2025-06-02/3", "house": "senate", "date": "2025-06-02", "number": 3, "name": "Other", "summary": "plain", "result": "rejected", "ayes": 1, "noes": 1, "billIds": [], "votes": [{"personSlug": "bo-reed", "vote": "no"}]})
    put(root / "bills", "b1", {"id": "b1", "title": "A Bill (No. 1)", "parliament": 48, "chamber": "representatives", "status": "Before Senate", "timeline": [{"date": "2025-05-01", "event": "Third reading agreed"}], "sponsors": [{"name": "Someone", "phid": "ab1"}], "movers": [{"name": "Bo Reed"}, {"name": "Un Known"}]})
    put(root / "bills", "b2", {"id": "b2", "title": "b bill", "parliament": 48, "chamber": "senate", "status": "Act", "timeline": []})
    prefs = [{"name": "Ada Moss", "party": "Reds", "votes": 60, "pct": 60.0, "elected": True}, {"name": "Cy", "party": "Blues", "votes": 40, "pct": 40.0, "elected": False}]
    for event in ("9", "10"):
        put(root / "elections", f"north-{event}", {"eventId": event, "eventName": f"E{event}", "electorateSlug": "north", "electorateName": "North", "state": "NSW", "firstPrefs": prefs, "tcp": prefs})
    put(root / "elections", "old-9", {"eventId": "9", "eventName": "E9", "electorateSlug": "abolished", "electorateName": "Old", "state": "NSW", "firstPrefs": [], "tcp": []})
    (root / "division_notes.jsonl").write_text("\n".join(json.dumps({"slug": s, "note": {"text": x, "model": "m", "generatedAt": "t"}}) for s, x in (("representatives/2025-05-01/1", "short"), ("senate/2025-06-02/3", "hidden"))))
    (root / "party_reference.jsonl").write_text(json.dumps({"slug": "reds", "name": "The Reds", "code": "R", "colour": "#f00"}) + "\n")
    return str(root)


def test_derive(spark, store, tmp_path):
    t = gold.derive(gold.load(spark, store))
    people = {r.slug: r for r in t["people"].collect()}
    assert (people["ada-moss"].state, people["bo-reed"].state) == ("NSW", "VIC")
    assert tuple(people["ada-moss"].stats) == (1, 1, 1) and tuple(people["bo-reed"].stats) == (1, 1, 0)
    assert [e.event for e in people["ada-moss"].elections] == ["9", "10"] and people["bo-reed"].elections is None
    assert {r.slug: r.memberSlug for r in t["electorates"].collect()} == {"north": "ada-moss", "east": None}
    kinds = {r.id: (r.summaryKind, r.aiSummary and r.aiSummary.text) for r in t["divisions"].collect()}
    assert kinds == {"representatives/2025-05-01/1": ("transcript", "short"), "senate/2025-06-02/3": ("summary", None)}
    bills = {r.id: r for r in t["bills"].collect()}
    assert bills["b1"].sponsors[0].slug == "ada-moss" and [m.slug for m in bills["b1"].movers] == ["bo-reed", None]
    assert bills["b1"].divisionIds == ["representatives/2025-05-01/1"] and bills["b2"].divisionIds == []
    parties = {r.slug: (r.name, r.seats.representatives, r.seats.senate) for r in t["parties"].collect()}
    assert parties == {"reds": ("The Reds", 1, 0), "independent": ("Independent", 0, 1)}
    assert [(r.electorateSlug, r.eventId) for r in t["elections"].collect()] == [("north", "9")]
    gold.write(t, str(tmp_path / "out"))
    again = files.json_lines(spark, str(tmp_path / "out/divisions"), schemas.DIVISION)
    assert [r.date for r in again.collect()] == ["2025-06-02", "2025-05-01"]
    assert spark.read.json(str(tmp_path / "out/quick-search")).count() == 6


def test_views(spark, store):
    t = gold.derive(gold.load(spark, store))
    rows = lambda name, *columns: [tuple(r[c] for c in columns) for r in getattr(views, name)(t).collect()]
    d1, d2 = "representatives/2025-05-01/1", "senate/2025-06-02/3"
    assert sorted(rows("seat_bars", "house", "party", "seats", "total", "majority", "pct")) == [("representatives", "reds", 1, 1, 1, 100.0), ("senate", "independent", 1, 1, 1, 100.0)]
    assert rows("home_divisions", "id") == [(d2,), (d1,)] and rows("home_bills", "id", "moved") == [("b1", "2025-05-01")]
    assert rows("people_index", "slug", "search", "seat") == [("ada-moss", "ada moss north nsw", "Member for North"), ("bo-reed", "bo reed  vic", "Senator for Victoria")]
    assert sorted(rows("person_votes", "member", "division", "vote", "crossed")) == [("ada-moss", d1, "aye", True), ("bo-reed", d2, "no", False), ("no-body", d1, "no", False)]
    assert sorted(rows("division_page", "id", "procedure", "tier", "width", "day")) == [(d1, "Second reading", "l", 100.0, "1 May 2025"), (d2, None, "l", 50.0, "2 June 2025")]
    assert sorted(rows("division_votes", "division", "pos", "name", "vote")) == [(d1, 0, "Ada Moss", "aye"), (d1, 1, "no body", "no"), (d2, 0, "Bo Reed", "no")]
    assert rows("same_day", "division") == [] and rows("division_bills", "division", "bill_id") == [(d1, "b1")] and rows("bill_divisions", "bill_id", "division") == [("b1", d1)]
    assert rows("electorates_index", "slug", "member", "search") == [("east", None, "east wa western australia "), ("north", "Ada Moss", "north nsw new south wales ada moss")]
    assert sorted(rows("parties_index", "slug", "total")) == [("independent", 1), ("reds", 1)] and rows("feed", "id", "updated") == [(d2, "2025-06-02T00:00:00Z"), (d1, "2025-05-01T00:00:00Z")]
    assert rows("feed", "nth", "path", "summary") == [(1, "/divisions/senate/2025-06-02-3/", "Senate 1–1 · Negatived"), (2, "/divisions/representatives/2025-05-01-1/", "House 1–0 · Carried")]
    assert rows("bills_feed", "id", "updated", "path") == [("b1", "2025-05-01T00:00:00Z", "/bills/b1/")]
    assert sorted(rows("bill_page", "id", "groups")) == [("b1", None), ("b2", None)]
    assert sorted(rows("bill_rows", "id", "stage", "step", "day")) == [("b1", 2, "Third reading agreed", "1 May"), ("b2", 4, None, None)]
    assert sorted(rows("ledger_rows", "month", "day", "title")) == [("June 2025", "2 Jun", "Other"), ("May 2025", "1 May", "Second Reading")]
    assert sorted(rows("person_cards", "slug", "initials")) == [("ada-moss", "AM"), ("bo-reed", "BR")]
    assert [(r.id, r.stage) for r in views.bills_index(t).collect()] == [("b1", 2), ("b2", 4)]
    assert {(r.division, r.party): (r.ayes, r.noes) for r in views.division_groups(t).collect()} == {("representatives/2025-05-01/1", "Reds"): (1, 0), ("representatives/2025-05-01/1", "Unknown"): (0, 1), ("senate/2025-06-02/3", "Independent"): (0, 1)}
    assert [r.share for r in views.electorate_page(t).orderBy("pos").collect()] == [60.0, 40.0]
    assert {(r.person, r.role) for r in views.person_bills(t).collect()} == {("ada-moss", "Sponsor"), ("bo-reed", "Introduced")}
    assert sum(r.n for r in views.divisions_by_month(t).collect()) == 2
    assert [r.person for r in views.party_leaders(t).collect()] == ["ada-moss"]


def test_sitemap(spark):
    urls = spark.createDataFrame([("/a/10/", "2025-01-02"), ("/a/9/", None), ("/a/", "2025-03-01")], "url string, lastmod string")
    assert [r.url for r in views.sitemap(urls).collect()] == ["/a/", "/a/9/", "/a/10/"]
    assert tuple(views.sitemap_index(urls).first()) == ("2025-03-01", 3)


def test_object_store(spark, tmp_path):
    """Keys in order under a prefix; what isn't there is none; deleting again changes nothing."""
    store = files.Store(spark, f"file://{tmp_path}/objects")
    assert store.list("raw/").count() == 0 and store.get("raw/a.json") is None
    for key in ("raw/b/2.json", "raw/a.json", "rawer.json", "raw/b/10.json"):
        store.put(key, key.encode())
    assert [r.key for r in store.list("raw/").collect()] == ["raw/a.json", "raw/b/10.json", "raw/b/2.json"]
    assert [r.key for r in store.list("raw/b/1").collect()] == ["raw/b/10.json"] and store.list().count() == 4
    assert store.get("raw/a.json") == b"raw/a.json"
    store.put("raw/a.json", b"new")
    assert store.get("raw/a.json") == b"new"
    store.delete("raw/a.json")
    store.delete("raw/a.json")
    assert store.get("raw/a.json") is None and store.list("raw/").count() == 2


def test_dated_source(spark):
    """Windows of dates are walked apart, whatever their pages overlap."""

    class Dated(files.WindowSource):
        @staticmethod
        def fetch(start, end):
            ids = [i for i in range(28, 0, -1) if start <= f"2025-01-{i:02d}" <= end][:3]
            return [{"id": i, "date": f"2025-01-{i:02d}", "name": f"n{i}"} for i in ids]

        @classmethod
        def name(cls):
            return "dated_for_test"

    spark.dataSource.register(Dated)
    rows = spark.read.format("dated_for_test").option("start", "2025-01-01").option("end", "2025-01-28").option("days", "10").option("page", "3").load()
    assert rows.rdd.getNumPartitions() == 3 and sorted(int(r.id) for r in rows.collect()) == list(range(1, 29))
    assert files.first_of_each(rows.unionByName(rows), "id", "date").count() == 28
    with pytest.raises(ValueError):
        files.checked_list(rows.limit(0))


def test_flows_without_their_sources(spark):
    """What is missing is an error where nothing can be made without it, and unknown elsewhere."""
    from plenarium.plans import flows, silver

    people = spark.createDataFrame([("a-b", "A B", "senate", None, "NSW", 1)], "slug string, name string, house string, electorate string, state string, ord int")
    with pytest.raises(ValueError, match="people"):
        flows.rebuild_divisions(spark.createDataFrame([], silver.DIVISION_RAW), spark.createDataFrame([], silver.PERSON_RAW), people)
    seats = spark.createDataFrame([("north", "North", "NSW"), ("east", "East", "WA")], "slug string, name string, state string")
    pages = spark.createDataFrame([("north", "<dt>Area:</dt><dd>5 km&sup2;</dd>"), ("east", None)], "slug string, html string")
    got = {r.slug: r for r in flows.seat_profiles(seats, pages, None).collect()}
    assert (got["north"].profile.area, got["north"].enrolment, got["north"].status) == ("5 km&sup2;", None, "fetched")
    assert (got["east"].profile, got["east"].status) == (None, "failed")
    assert flows.profile_url("http://x", seats).where("slug = 'east'").first().url == "http://x/profiles/wa/east.htm"
    ids = spark.createDataFrame([("a-b", (None,)), ("c", ("OLD",))], "slug string, ids struct<aph: string>")
    assert {r.slug: r.ids.aph for r in flows.with_handbook_ids(ids, spark.createDataFrame([("a-b", "H1")], "slug string, PHID string")).collect()} == {"a-b": "H1", "c": "OLD"}


def test_bundle_meta(spark, tmp_path):
    assert tuple(files.bundle_meta(spark, str(tmp_path)).first())[:2] == ("", True)
    (tmp_path / "meta.json").write_text(json.dumps({"generatedAt": "t", "sample": False, "sources": {"a": {"lastSync": "x", "ok": True}}}))
    meta = files.bundle_meta(spark, str(tmp_path)).first()
    assert (meta.generatedAt, meta.sample, meta.sources["a"].ok) == ("t", False, True)


def test_empty_store(spark, tmp_path):
    assert all(df.count() == 0 for df in gold.derive(gold.load(spark, str(tmp_path / "none"))).values())


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text('Title, made today\nA,B,C\n1,2,3\n\n4\n"x, y",,"z"\n')
    rows = files.titled_csv(spark, str(tmp_path / "t.csv"), ["A", "B", "C"]).orderBy("ord").select("A", "B", "C").collect()
    assert [tuple(r) for r in rows] == [("1", "2", "3"), ("4", "", ""), ("x, y", "", "z")]
    (tmp_path / "p.csv").write_text("A,B\n1,2\n,\n3\n")
    assert [tuple(r) for r in files.plain_csv(spark, str(tmp_path / "p.csv"), ["A", "B"]).collect()] == [("1", "2"), ("3", "")]
    (tmp_path / "bad.jsonl").write_text('{"slug": "a"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILED_READ"):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), "slug string").collect()
    seen = []

    def fetch(start, end):
        seen.append(end)
        ids = [i for i in range(9, 0, -1) if f"2025-01-0{i}" <= end][:4]
        return [{"id": i, "date": f"2025-01-0{i}"} for i in ids]

    assert [r["id"] for r in files.window_walk(fetch, "2025-01-01", "2025-01-09", 4)] == list(range(9, 0, -1)) and len(seen) > 2


def test_paged_source(spark):
    class Pages(files.PagedSource):
        fetch = staticmethod(lambda url: f"body of {url}")

        @classmethod
        def name(cls):
            return "pages_for_test"

    spark.dataSource.register(Pages)
    rows = spark.read.format("pages_for_test").option("url", "x/{page}").option("pages", "2").load()
    assert sorted(map(tuple, rows.collect())) == [(1, "body of x/1"), (2, "body of x/2")]
    assert rows.select(F.max("page")).first()[0] == 2


def test_api_answers(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"results": {"bindings": [{"person": {"value": "p"}}, {"person": {"value": "q"}, "start": {"value": "2020"}}]}}))
    assert [tuple(r) for r in files.sparql_bindings(spark, str(tmp_path / "s.json"), ["person", "start"]).collect()] == [(0, "p", None), (1, "q", "2020")]
    (tmp_path / "o.json").write_text(json.dumps({"value": [{"PHID": "1"}, {"PHID": "2", "x": 1}]}))
    assert files.odata_values(spark, str(tmp_path / "o.json"), "PHID: string").count() == 2
    page = lambda title, licence, artist: {"title": title, "imageinfo": [{"extmetadata": {"LicenseShortName": licence and {"value": licence}, "Artist": artist and {"value": artist}}}]}
    (tmp_path / "l.json").write_text(json.dumps({"query": {"pages": {"1": page("File:A b.jpg", "CC0", "<a>Jo</a>"), "2": page("File:C.jpg", "PD", None), "3": page("File:D.jpg", None, None), "-1": {"title": "File:E.jpg"}}}}))
    assert sorted(map(tuple, files.image_licences(spark, str(tmp_path / "l.json")).collect())) == [("A b.jpg", "CC0", "Jo"), ("C.jpg", "PD", "Wikimedia Commons"), ("D.jpg", "unknown", "Wikimedia Commons")]
    (tmp_path / "people.jsonl").write_text('{"slug": "a", "name": "A", "undeclared": 1}\n\n{"slug": "b"}\n')
    tables = files.bundles(spark, str(tmp_path))
    assert tables["people"].count() == 2 and tables["bills"].count() == 0


def test_feed_text(spark):
    """Read by an XML parser: entries in order with what they say, marks escaped once; the last of a day's steps counts."""
    step = lambda *days: [(d, e) for d, e in days]
    bills = spark.createDataFrame([
        ("a", "Zoo & Co <1>", "Act", step(("2025-01-02", "In"), ("2025-03-01", "Moved"), ("2025-03-01", "Agreed \"so\""))),
        ("b", "apples", "Lapsed", step(("2025-03-01", "In"))), ("c", "Old", "Act", step(("2024-01-01", "In"))), ("d", "None", "Act", []),
    ], "id string, title string, status string, timeline array<struct<date: string, event: string>>")
    entries = views.bills_feed({"bills": bills})
    xml = views.feed_text(entries, "https://x.org/", "A & B", "/bills/", "me").first().xml
    root, ns = ElementTree.fromstring(xml.encode()), "{http://www.w3.org/2005/Atom}"
    said = [tuple(e.find(ns + x).text for x in ("title", "id", "updated", "summary")) for e in root.iter(ns + "entry")]
    assert said == [
        ("apples — In", "https://x.org/bills/b/", "2025-03-01T00:00:00Z", "In · Lapsed"), ("Zoo & Co <1> — Agreed \"so\"", "https://x.org/bills/a/", "2025-03-01T00:00:00Z", "Agreed \"so\" · Act"),
        ("Old — In", "https://x.org/bills/c/", "2024-01-01T00:00:00Z", "In · Act"),
    ]
    assert root.find(ns + "title").text == "A & B" and root.find(ns + "updated").text == "2025-03-01T00:00:00Z" and root.find(f"{ns}author/{ns}name").text == "me"
    assert [(x.get("rel"), x.get("href")) for x in root.findall(ns + "link")] == [("self", "https://x.org/bills/feed.xml"), (None, "https://x.org/bills/")]
    assert [r.id for r in views.bills_feed({"bills": bills}, 1).collect()] == ["b"]
    none = ElementTree.fromstring(views.feed_text(entries.limit(0), "https://x.org", "T", "/bills/", "me").first().xml.encode())
    assert none.find(ns + "updated").text == "1970-01-01T00:00:00Z" and none.find(ns + "entry") is None
