"""Request tables over a fake transport and clock, and runs of the note layer."""

import json
import os
import re
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from plenarium.plans import flows, note_runs
from plenarium.sources import requests


def test_turns_of_a_lane():
    """Lanes never share a turn, and all of them together use each interval once."""
    turns = set()
    for lane in range(3):
        at, mine = 100.3, []
        for _ in range(5):
            at = requests.next_turn(at, 2.0, lane, 3)
            mine.append(at)
            at += 0.1
        assert all(round(b - a, 6) == 6.0 for a, b in zip(mine, mine[1:], strict=False)) and mine[0] >= 100.3
        turns |= {round(t, 6) for t in mine}
    assert len(turns) == 15 and {round(b - a, 6) for a, b in zip(sorted(turns), sorted(turns)[1:], strict=False)} == {2.0}


def test_spacing_and_budget_over_tasks(spark):
    """Four tasks send to two hosts, each with a clock of its own that sleeping moves."""
    rows = [(f"r{i:03d}", f"h{i % 2}", f"http://h{i % 2}/{i}", None) for i in range(60)]
    table = spark.createDataFrame(rows, "id string, host string, url string, body string")

    class Clock:
        now = 1000.0

        def sleep(self, seconds):
            self.now += seconds

    clock = Clock()
    tell, wait = (lambda: clock.now), (lambda s: clock.sleep(s))
    transport = lambda url, body, timeout: (200, f"{url} in {timeout:g}")
    got = requests.answered(table, transport, interval=1.0, budget=25, clock=tell, sleep=wait).collect()
    for host in ("h0", "h1"):
        mine = [r for r in got if r.host == host]
        sent = sorted(r.at for r in mine if r.status == 200)
        assert len(mine) == 30 and len(sent) <= 25 and all(b - a >= 0.999 for a, b in zip(sent, sent[1:], strict=False))
        assert {r.error for r in mine if r.status is None} <= {"budget"} and len(sent) >= 20
    assert all(r.answer == f"http://{r.host}/{int(r.id[1:])} in 120" for r in got if r.status == 200)


def test_failed_requests_are_for_the_next_run(spark):
    """429, 5xx and errors of the transport are tried again within a run; 404 isn't; what failed is asked for in the next run only."""
    table = spark.createDataFrame([(n, "h", f"http://h/{n}", "b") for n in ("ok", "gone", "busy", "down", "away")], "id string, host string, url string, body string")
    waits = []

    def transport(url, body, timeout):
        name = url.rsplit("/", 1)[-1]
        if name == "away":
            raise OSError("no route")
        return {"ok": 200, "gone": 404, "busy": 429, "down": 503}[name], "text"

    first = requests.answered(table, transport, interval=0, lanes=1, sleep=waits.append, clock=lambda: 5.0)
    attempts = spark.createDataFrame(first.collect(), requests.ANSWERS)
    counts = {r.id: (r.n, r.error) for r in attempts.groupBy("id").agg(F.count("*").alias("n"), F.max("error").alias("error")).collect()}
    assert counts == {"ok": (1, None), "gone": (1, "status 404"), "busy": (4, "status 429"), "down": (4, "status 503"), "away": (4, "OSError: no route")}
    left = requests.unanswered(table, attempts)
    assert sorted(r.id for r in left.collect()) == ["away", "busy", "down", "gone"]
    second = requests.answered(left, lambda url, body, timeout: (200, body), interval=0)
    both = attempts.unionByName(spark.createDataFrame(second.collect(), requests.ANSWERS))
    assert requests.unanswered(table, both).count() == 0
    assert {(r.id, r.answer) for r in requests.answers(both).collect()} == {("ok", "text"), *((n, "b") for n in ("gone", "busy", "down", "away"))}


def test_party_requests(spark):
    """Names of groups in batches; the query asks for them and no more, and answers find their groups again."""
    names = ["Plain Party", 'The "Quoted" \\ Party', "Évora & Co"] + [f"Group {i:02d}" for i in range(60)]
    groups = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(names)], "slug string, name string")
    rows = requests.party_requests(groups, "https://query.example.org/sparql").orderBy("id").collect()
    assert [r.id for r in rows] == ["parties/0", "parties/1"] and {r.host for r in rows} == {"query.example.org"}
    found = []
    for r in rows:
        assert re.fullmatch(r"https://query\.example\.org/sparql\?query=[A-Za-z0-9%_.!~*'()-]+", r.url)
        values = re.search(r"VALUES \?label \{ (.*?) \}", unquote(r.url)).group(1)
        some = re.findall(r'"([^"]*)"@en', values)
        assert " ".join(f'"{n}"@en' for n in some) == values and len(some) <= 50
        found += some
    assert sorted(found) == sorted(re.sub(r'["\\]', "", n) for n in names)
    asked = spark.createDataFrame([("x", "O'Brien"), ("y", ""), ("y", "K1")], "slug string, PHID string")
    urls = {r.id: unquote(r.url) for r in requests.odata_requests(asked, "https://h.example.org/api", "roles", "PHID").collect()}
    assert urls == {"roles/O'Brien": "https://h.example.org/api/roles?$filter=PHID eq 'O''Brien'", "roles/K1": "https://h.example.org/api/roles?$filter=PHID eq 'K1'"}


def pending(spark, n):
    return spark.createDataFrame([(f"d{i:03d}", i, f"text {i}") for i in range(n)], "id string, nth int, prompt string")


def answering(folder, *broken):
    """A call that leaves a file for each request, so that calls can be counted; requests with a ``broken`` item fail."""

    def call(items):
        name = f"{items[0]['id']}-{len(os.listdir(folder))}"
        open(os.path.join(folder, name), "w").close()
        if any(i["id"] in broken for i in items):
            raise ValueError("bad request")
        return json.dumps([{"id": i["id"], "summary": f" about {i['prompt']} "} for i in items] + [{"id": "other", "summary": "ignored"}])

    return call


def test_the_cap_leaves_the_rest_pending(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    path, call = str(tmp_path / "progress"), answering(str(tmp_path / "calls"))
    assert note_runs.run_notes(pending(spark, 19), call, path, "nth", cap=2) == (2, 16, 0, 3)
    assert sorted(r.id for r in note_runs.notes_of(note_runs.progress_of(spark, path)).collect()) == [f"d{i:03d}" for i in range(16)]
    # A restart asks for nothing that was answered.
    assert note_runs.run_notes(pending(spark, 19), call, path, "nth", cap=2) == (1, 3, 0, 0)
    assert note_runs.run_notes(pending(spark, 19), call, path, "nth") == (0, 0, 0, 0)
    assert sorted(f[:4] for f in os.listdir(tmp_path / "calls")) == ["d000", "d008", "d016"]
    assert {(r.id, r.text) for r in note_runs.notes_of(note_runs.progress_of(spark, path)).collect()} == {(f"d{i:03d}", f"about text {i}") for i in range(19)}


def test_five_failed_requests_end_the_run(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    path, call = str(tmp_path / "progress"), answering(str(tmp_path / "calls"), *[f"d{i:03d}" for i in range(0, 48, 8)])
    with pytest.raises(note_runs.TooManyFailures, match="5 requests failed, of 5"):
        note_runs.run_notes(pending(spark, 48), call, path, "nth")
    assert len(os.listdir(tmp_path / "calls")) == 5 and note_runs.notes_of(note_runs.progress_of(spark, path)).count() == 0
    assert {r.error for r in note_runs.progress_of(spark, path).collect()} == {"ValueError: bad request"}


def test_one_failed_request_is_left_for_the_next_run(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    path = str(tmp_path / "progress")
    assert note_runs.run_notes(pending(spark, 20), answering(str(tmp_path / "calls"), "d009"), path, "nth", wave=3) == (3, 12, 1, 0)
    assert note_runs.run_notes(pending(spark, 20), answering(str(tmp_path / "calls")), path, "nth", wave=3) == (1, 8, 0, 0)
    assert sorted(f[:4] for f in os.listdir(tmp_path / "calls")) == ["d000", "d008", "d008", "d016"]


def test_answers_that_are_of_no_use(spark, tmp_path):
    """Prose fails its request; a blank note is a decision where it is asked to be one, else its item stays pending."""
    path = str(tmp_path / "progress")
    assert note_runs.run_notes(pending(spark, 3), lambda items: "Sorry, I cannot help.", path, "nth") == (1, 0, 1, 0)
    blank = lambda items: json.dumps([{"id": i["id"], "summary": "  "} for i in items])
    assert note_runs.run_notes(pending(spark, 3), blank, path, "nth") == (1, 0, 0, 0)
    assert note_runs.notes_of(note_runs.progress_of(spark, path)).count() == 0
    assert note_runs.run_notes(pending(spark, 3), blank, path, "nth", keep_empty=True) == (1, 0, 0, 0)
    assert note_runs.run_notes(pending(spark, 3), blank, path, "nth", keep_empty=True) == (0, 0, 0, 0)
    merged = flows.merged_notes(spark.createDataFrame([], "id string, text string, model string, generatedAt string, version int"), note_runs.notes_of(note_runs.progress_of(spark, path)), "m", "2025-01-01", keep_empty=True)
    assert merged.count() == 3
