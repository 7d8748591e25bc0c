"""Due copies by state and timers, against the batch operators' rules step by step."""

import datetime
import random

from plenarium.streaming import incremental, refreshing

START = datetime.datetime(2025, 7, 1)


def steps_of(seed, steps=7):
    """Listings with times: keys come and go, markers and versions change, gaps of hours to weeks."""
    rng, day, out = random.Random(seed), 0.0, []
    for _ in range(steps):
        keys = [k for k in range(8) if rng.random() < 0.5]
        out.append((day, [(f"k{k}", rng.choice(["a", "b", None]) if rng.random() < 0.3 else "a", "2" if day > 15 and k == 3 else "1") for k in keys]))
        day += rng.choice([0.25, 1, 3, 6.75, 7, 9])
    return out


def plain_due(steps, days=7):
    """What is due at each time, with every copy looked at."""
    held, out = {}, []
    for day, rows in steps:
        listed = {k for k, _, _ in rows}
        for key, (marker, version, stored) in list(held.items()):
            while stored + days < day or stored + days == day and key not in listed:
                stored += days
                out.append((key, stored, "aged"))
            held[key] = (marker, version, stored)
        for key, marker, version in rows:
            old = held.get(key)
            reason = "new" if old is None else "changed" if old[0] != marker else "version" if old[1] != version else "aged" if day - old[2] >= days else None
            if reason:
                held[key] = (marker, version, day)
                out.append((key, day, reason))
    return sorted(out)


def test_due_by_state(spark, tmp_path):
    refreshing.with_state_store(spark)
    schema = "id string, marker string, version string, at timestamp"
    for seed in (1, 2):
        steps = steps_of(seed)
        # A last row, whose own timers stay open, moves the clock to the last step's end.
        for n, (day, rows) in enumerate(steps):
            at = START + datetime.timedelta(days=day)
            some = [(*r, at) for r in rows] + [(None, "a", "1", at), ("no time", "a", "1", None), ("clock", str(n), "1", at)]
            spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{tmp_path}/{seed}/in/{n}")
        got = []
        # Two runs, the second from the checkpoint of the first.
        for upto in (4, len(steps)):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(f"{tmp_path}/{seed}/in/[0-{upto - 1}]")
            due = refreshing.due_stream(stream, "id", "marker", "version", "at")
            run = due.writeStream.format("parquet").option("path", f"{tmp_path}/{seed}/out").option("checkpointLocation", f"{tmp_path}/{seed}/state").trigger(availableNow=True).outputMode("append").start()
            run.awaitTermination()
        got = [(r.key, (r.at - START).total_seconds() / 86_400, r.reason) for r in spark.read.schema(refreshing.DUE).parquet(f"{tmp_path}/{seed}/out").collect() if r.key != "clock"]
        want = plain_due(steps)
        assert sorted(got) == want, f"GOT {sorted(set(got) - set(want))} WANT {sorted(set(want) - set(got))} DAYS {[(d, [r[0] for r in rs]) for d, rs in steps]}"
        assert {r for _, _, r in want} >= {"new", "changed", "aged"}


def test_a_step_is_the_batch_operators_set(spark):
    """One step of the plain rules is what the batch operators give for the same listing and store."""
    stored = spark.createDataFrame([("a", "m", ["x"], START), ("b", "m", ["x"], START), ("c", "m", ["x"], START + datetime.timedelta(days=5))], "id string, marker string, timeline array<string>, stored_at timestamp")
    incoming = spark.createDataFrame([("a", "m"), ("b", "other"), ("c", "m"), ("d", "m")], "id string, marker string")
    as_of = START + datetime.timedelta(days=8)
    from pyspark.sql import functions as F

    changed = {r.id for r in incremental.stale_marker(incoming, stored, "id", "marker", "timeline").collect()}
    joined = incoming.join(stored.select("id", "stored_at"), "id", "left")
    aged = {r.id for r in incremental.due(joined, F.col("stored_at"), F.lit(as_of)).collect()}
    steps = [(0, [("a", "m", "1"), ("b", "m", "1")]), (5, [("c", "m", "1")]), (8, [("a", "m", "1"), ("b", "other", "1"), ("c", "m", "1"), ("d", "m", "1")])]
    assert {k for k, day, _ in plain_due(steps) if day > 5} == changed | aged == {"a", "b", "d"}
