"""Walks of unknown length, publishing after an audit, and a stream that goes by a date cursor."""

import json
import os

import pytest

from plenarium.sources import walks
from plenarium.sources.published import Table, bucket_of
from plenarium.sources.work import scope
from plenarium.streaming import incremental


def pages_of(items, size, key=None):
    """A listing of so many items, and the pages that were asked for."""

    def fetch(page):
        some = items[(page - 1) * size : page * size]
        return json.dumps(some if key is None else {key: some} if some else {})

    return fetch


@pytest.mark.parametrize("n", [0, 3, 4, 5, 8, 27, 28, 29])
@pytest.mark.parametrize("key", [None, "value"])
def test_walks_end_at_a_short_page(spark, n, key):
    """Also where the items are an exact multiple of a page."""
    items = [{"id": i} for i in range(n)]
    with scope():
        rows = walks.walked(spark, pages_of(items, 4, key), 4, key=key, widest=4).orderBy("page", "pos").collect()
    assert [json.loads(r.item) for r in rows] == items
    assert [(r.page, r.pos) for r in rows] == [(i // 4 + 1, i % 4) for i in range(n)]


def test_walks_have_a_last_page(spark):
    with scope():
        rows = walks.walked(spark, pages_of(list(range(100)), 4), 4, most=6).collect()
    assert sorted(int(r.item) for r in rows) == list(range(24))


def test_a_page_that_is_no_list(spark):
    """It is an error on the way, not beyond the end."""
    good = pages_of([1, 2, 3, 4, 5], 2)
    with scope(), pytest.raises(walks.NotAList, match="page 2"):
        walks.walked(spark, lambda page: good(page) if page != 2 else '{"error": "nope"}', 2)
    with scope():
        assert walks.walked(spark, lambda page: good(page) if page < 4 else "{}", 2).count() == 5


def test_nothing_is_published_over_what_is_stored(spark, tmp_path):
    table, schema = Table(spark, str(tmp_path / "bills")), "id string"
    stored = [{"id": "a"}, {"id": "b"}, {"id": "c"}]
    walks.publish_walk(spark, pages_of(stored, 2), 2, table, schema)
    look = lambda: sorted(r.id for r in table.read().collect())
    before = table.parts(), look()

    def broken(page):
        if page == 3:
            raise OSError("the host is away")
        return json.dumps([{"id": "x"}, {"id": "y"}])

    def audit(rows):
        if rows.where("id is null").count():
            raise ValueError("an item has no id")

    for fetch, error in ((lambda page: "[]", "no rows"), (lambda page: '{"error": "nope"}', "isn't a list"), (broken, "the host is away"), (pages_of([{"no": 1}], 2), "no id")):
        with pytest.raises(Exception, match=error):
            walks.publish_walk(spark, fetch, 2, table, schema, audit if error == "no id" else walks.not_empty)
        assert (table.parts(), look()) == before
    walks.publish_walk(spark, pages_of([{"id": "z"}], 2), 2, table, schema)
    assert look() == ["z"]
    # The version before stays for readers that have begun, older ones and what was left go.
    walks.publish_walk(spark, pages_of([{"id": "y"}], 2), 2, table, schema)
    assert look() == ["y"] and len([f for f in os.listdir(table.root) if f.startswith("v-")]) == 2


def test_buckets_are_replaced_alone(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"))
    assert table.parts() == {} and table.read("k int").count() == 0
    with pytest.raises(ValueError, match="nothing was published"):
        table.read()
    rows = lambda some: spark.createDataFrame(some, "k int, v string").withColumn("bucket", bucket_of(["k"], 4))
    table.publish_buckets(rows([(k, "old") for k in range(40)]), "bucket")
    one = rows([(k, "new") for k in range(40)]).where("bucket = 2")
    kept = dict(table.parts())
    table.publish_buckets(one, "bucket")
    assert {b for b, f in table.parts().items() if kept[b] != f} == {"2"}
    assert {(r.k, r.v) for r in table.read().collect()} == {(r.k, "new" if r.bucket == 2 else "old") for r in rows([(k, "") for k in range(40)]).collect()}
    assert table.read("k int, v string", [2]).count() == one.count()
    table.publish_buckets(one, "bucket")
    assert len(os.listdir(table.root + "/" + kept["2"].partition("/")[0])) <= 5 and not os.path.exists(f"{table.root}/{kept['2']}")


def test_cursor_stream(spark, tmp_path):
    """Three runs over a growing API: late rows within the overlap are taken, and it ends as the batch does."""
    store = tmp_path / "api.json"

    def records():
        return json.loads(store.read_text())

    def fetch(start, end):
        found = sorted((r for r in records() if start <= r["date"] <= end), key=lambda r: (r["date"], r["id"]), reverse=True)
        return found[:3]

    class Api(walks.CursorSource):
        pass

    Api.fetch, Api.latest = staticmethod(fetch), staticmethod(lambda: max((r["date"] for r in records()), default=None))
    spark.dataSource.register(Api)
    table = Table(spark, str(tmp_path / "table"))
    row = lambda i, day, v=0: {"id": i, "date": f"2025-{day}", "v": v}
    steps = [
        [],
        [row(1, "07-02"), row(2, "07-20"), row(3, "08-01"), row(4, "08-01")],
        # Late by twelve days, late by more than the overlap, and a change; the newest date hasn't moved.
        [row(1, "07-02"), row(2, "07-20"), row(3, "08-01", 1), row(4, "08-01"), row(5, "07-20"), row(6, "07-03")],
        [row(1, "07-02"), row(2, "07-20"), row(3, "08-01", 1), row(4, "08-01"), row(5, "07-20"), row(6, "07-03"), *[row(10 + k, "09-15", k) for k in range(3)]],
    ]
    for step in steps:
        store.write_text(json.dumps(step))
        stream = spark.readStream.format("cursor").options(start="2025-07-01", days="10", page="3").load()
        incremental.upsert_stream(stream, table.root, str(tmp_path / "checkpoint"), ["id"], "date", buckets=2).awaitTermination()
        if not step:
            assert table.read("id string").count() == 0
    got = {r.id: json.loads(r.body) for r in table.read().collect()}
    assert got == {str(r["id"]): r for r in steps[-1] if r["id"] != 6}
