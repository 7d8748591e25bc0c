"""Raw extracts to canonical rows."""

import json

import pytest

from plenarium.plans import flows, silver


def read(spark, tmp_path, rows, schema):
    path = tmp_path / "rows.json"
    path.write_text("\n".join(json.dumps(r) for r in rows))
    return spark.read.schema(schema).json(str(path))


def test_divisions(spark, tmp_path):
    vote = lambda i, first, last, party, v: {"member": {"person": {"id": i}, "first_name": first, "last_name": last, "party": party}, "vote": v}
    raw = {
        "id": 5, "house": "senate", "date": "2025-05-01", "number": 2, "name": "N", "aye_votes": 2, "no_votes": 2, "summary": "  ",
        "votes": [vote(1, "Ada", "Moss", "R", "aye"), vote(2, "Bo", "Reed", "R", "aye"), vote(3, "Zoë", "Ray", "R", "no"), vote(4, "Di", "Lo", "S", "no")],
        "bills": [{"id": 7, "title": "t", "official_id": "s1"}, {"id": 8, "title": "t", "official_id": 44}, {"id": 9, "title": "t", "official_id": None}],
    }
    crosswalk = spark.createDataFrame([(1, "ada-x", 1)], "person_id long, slug string, ord long")
    got = silver.divisions(read(spark, tmp_path, [raw], silver.DIVISION_RAW), crosswalk).first()
    assert (got.id, got.summary, got.result, got.billIds) == ("senate/2025-05-01/2", None, "rejected", ["s1", "44", "9"])
    assert [(v.personSlug, v.vote, v.againstGroupMajority) for v in got.votes] == [("ada-x", "aye", None), ("bo-reed", "aye", None), ("zoe-ray", "no", True), ("di-lo", "no", None)]


def test_crosswalk_by_seat(spark, tmp_path):
    raw = [{"id": i, "latest_member": {"name": {"first": "Jo", "last": "Moss"}, "electorate": e, "house": h, "party": "R"}} for i, e, h in ((1, "Victoria", "senate"), (2, "North", "representatives"))]
    people = spark.createDataFrame([("jo-moss", "Jo Moss", "senate", None, "VIC", 1), ("jo-moss-north", "Jo Moss", "representatives", "north", "NSW", 2)], "slug string, name string, house string, electorate string, state string, ord long")
    assert sorted((r.person_id, r.slug) for r in silver.person_crosswalk(read(spark, tmp_path, raw, silver.PERSON_RAW), people).collect()) == [(1, "jo-moss"), (2, "jo-moss-north")]


def test_bills(spark, tmp_path):
    raw = [{"Id": "b1", "Title": "<i>A</i> &amp; B", "FormattedOriginatingChamber": "SENATE", "Status": "", "Summary": ""}, {"Id": "b2", "Title": "C", "Status": "Act", "Summary": "x"}]
    listed = silver.bills(read(spark, tmp_path, raw, silver.BILL_RAW), 48)
    (tmp_path / "d").mkdir()
    state = lambda d, ms: {"Description": d, "UpdateDate": ms and f"/Date({ms}+0000)/"}
    detail = {"Id": "b1", "Bill": {"ParlInfoUrl": "", "Sponsors": [{"DisplayName": "MOSS, Sen the Hon Ada", "Id": "AB"}, {"DisplayName": ""}], "GroupedProgressStates": [{"FormattedChamber": "Senate", "ProgressStates": [state("Second", 172800000), state("", 0), state("None", None)]}, {"FormattedChamber": "", "ProgressStates": [state("First", 86400000), state("Also second", 172800000)]}]}}
    full = {r.id: r for r in silver.with_detail(listed, read(spark, tmp_path / "d", [detail], silver.DETAIL_RAW)).collect()}
    b1, b2 = full["b1"], full["b2"]
    assert (b1.title, b1.chamber, b1.status, b1.summary) == ("A & B", "senate", "Before parliament", None)
    assert [(s.date, s.event) for s in b1.timeline] == [("1970-01-02", "First"), ("1970-01-03", "Second (Senate)"), ("1970-01-03", "Also second")]
    assert [(s.name, s.phid) for s in b1.sponsors] == [("Ada Moss", "AB")] and b1.movers == []
    assert (b2.chamber, b2.status, b2.timeline) == ("representatives", "Act", [])
    frame = silver.with_detail(listed, read(spark, tmp_path / "d", [detail], silver.DETAIL_RAW))
    assert frame.where(silver.has_entity(frame)).count() == 0


def test_people(spark):
    q = list(silver.HOUSES)
    rows = [
        (1, "w/P1", "Jo Moss", f"w/{q[0]}", "Reds", "North", "x/Special:FilePath/A%20b.jpg", "2019-01-01T00", None),
        (2, "w/P2", "Jo Moss", f"w/{q[0]}", None, "East", None, None, None),
        (3, "w/P1", "Jo Moss", f"w/{q[1]}", "Reds", "Victoria", "x/Special:FilePath/A%20b.jpg", "2022-01-01T00", None),
        (4, "w/P3", "Jo Moss", f"w/{q[0]}", "Reds", "East", "f", None, None),
        (5, "w/P4", "No Seat", "w/Q1", None, None, None, None, None),
    ]
    bindings = spark.createDataFrame(rows, "ord long, person string, personLabel string, houseQ string, partyLabel string, electorateLabel string, img string, start string, article string")
    licences = spark.createDataFrame([("A b.jpg", "CC BY-SA 4.0", "x"), ("f", "All rights reserved", "y")], "commonsFile string, licence string, attribution string")
    got = {r.wikidata: r for r in silver.people(silver.members(bindings), licences).collect()}
    assert {k: r.slug for k, r in got.items()} == {"P1": "jo-moss", "P2": "jo-moss-east", "P3": "jo-moss-east-2"}
    assert (got["P1"].house, got["P1"].state, got["P1"].electorate, got["P1"].since) == ("senate", "VIC", None, "2022-01-01")
    assert (got["P2"].groupSlug, got["P2"].electorate) == ("independent", "east")
    assert got["P1"].photo.licence == "CC BY-SA 4.0" and got["P3"].photo is None


def test_positions(spark):
    role = "struct<Role: string, Prep: string, Entity: string, Ministry: string, RDateStart: string, RDateEnd: string>"
    rows = [([("Minister", "for", "Art", "M1", "2020-01-01T0", "1900-01-01T0"), ("Old", "", None, "", "", None)], [("Shadow", None, None, None, "2021-02-03", "2022-01-01")], ["Whip"])]
    frame = spark.createDataFrame(rows, f"m array<{role}>, s array<{role}>, p array<string>")
    got = frame.select(silver.positions(frame["m"], frame["s"], frame["p"]).alias("x")).first().x
    assert [(p.role, p.kind, p["from"], p.to, p.ministry) for p in got] == [("Shadow", "shadow", "2021-02-03", "2022-01-01", None), ("Minister for Art", "ministry", "2020-01-01", None, "M1"), ("Old", "ministry", None, None, None), ("Whip", "position", None, None, None)]
    places = spark.createDataFrame([("A", "", "C"), ("", None, ""), ("A", "B", "C")], "p string, s string, c string")
    assert [r[0] for r in places.select(silver.birthplace(places["p"], places["s"], places["c"])).collect()] == ["A, C", None, "A, B"]


def test_candidates(spark):
    rows = [("VIC", "North", "MOSS", "ADA", "", "", "2", "", "N", 1), ("VIC", "North", "O'DELL", "BO", "Reds", "RD", "1", "-1.5", "Y", 2), ("NSW", "North", "LO", "DI", "Blues", "B", " ", "x", "N", 3)]
    frame = spark.createDataFrame(rows, "StateAb string, DivisionNm string, Surname string, GivenNm string, PartyNm string, PartyAb string, TotalVotes string, Swing string, Elected string, ord long")
    got = silver.contests(silver.candidates(frame)).first()
    assert got.state == "NSW" and [(c.name, c.party, c.partyCode, c.votes, c.pct, c.elected) for c in got.firstPrefs] == [("Ada Moss", "Independent", None, 2, 66.67, False), ("Bo O'Dell", "Reds", "RD", 1, 33.33, True), ("Di Lo", "Blues", "B", 0, 0.0, False)]
    assert silver.checked_states(silver.candidates(frame)).count() == 3
    with pytest.raises(Exception, match="unknown state"):
        silver.checked_states(spark.createDataFrame([("XX",)], "state string")).collect()
    e = spark.createDataFrame([("North", "10", None), ("", "5", None), ("East", None, "7"), ("West", "x", None)], "DivisionNm string, Enrolment string, CloseOfRollsEnrolment string")
    assert sorted(map(tuple, silver.enrolment(e).collect())) == [("east", 7), ("north", 10)]


def leaves(frame):
    return frame._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_event_results_read_each_count_once(spark):
    """A seat's pairs are its own by name, whatever slug other names have, and rows aren't read again for totals."""
    columns = "StateAb string, DivisionNm string, CandidateID string, Surname string, GivenNm string, PartyNm string, PartyAb string, Swing string, Elected string, OrdinaryVotes string, ord int"
    row = lambda seat, who, n, i: ("NSW", seat, who, "McMAHON", "JO ANN", None, "", "", "N", n, i)
    frame = spark.createDataFrame([row("O'Con", "1", "1", 1), row("O'Con", "1", "2", 2), row("O'Con", "2", "6", 3), row("OCon", "3", "4", 4), row("OCon", "4", "", 5)], columns)
    found = flows.event_results("28791", frame, frame)
    got = {r.electorateName: r for r in found.collect()}
    assert found.count() == 2 and {r.electorateSlug for r in got.values()} == {"ocon"}
    assert [(c.votes, c.pct, c.name) for c in got["O'Con"].firstPrefs] == [(6, 66.67, "Jo Ann McMahon"), (3, 33.33, "Jo Ann McMahon")]
    assert [(c.votes, c.pct) for c in got["OCon"].tcp] == [(4, 100.0), (0, 0.0)]
    assert leaves(found) == 2 and leaves(found.select("firstPrefs")) == 1


def test_votes_are_taken_apart_once(spark):
    raw = spark.createDataFrame([], silver.DIVISION_RAW)
    plan = silver.divisions(raw, spark.createDataFrame([], "person_id bigint, slug string, ord bigint"))._jdf.queryExecution().analyzed()
    assert plan.toString().count("Generate posexplode") == 1
