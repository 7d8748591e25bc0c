"""Substring search by trigrams against a scan, and how few rows it reads."""

import random

from plenarium.operators import substrings, text_index


def test_substrings(spark, tmp_path):
    rng = random.Random(4)
    values = {i: " ".join(rng.choice(["Alpha", "beta", "Été", "ab", "aaa", "x-ray", "Zulu", "committee"]) for _ in range(rng.choice([0, 1, 3, 6]))) for i in range(300)}
    values |= {400: None, 401: "", 402: "ab", 403: "a" * 500}
    rows = spark.createDataFrame([*values.items(), (None, "alpha")], "id long, name string")
    index = substrings.trigram_index(rows.repartition(3), "id", "name")
    text_index.write_index(index, str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    needles = {i: v for i, v in enumerate({v[a : a + n] for v in values.values() if v for a, n in ((rng.randrange(len(v)), rng.choice([1, 2, 3, 4, 7, 20])) for _ in range(2))})}
    needles |= {900: "", 901: None, 902: "MITTEE", 903: "aaaa", 904: "nowhere", 905: "été", 906: "é"}
    asked = spark.createDataFrame(list(needles.items()), "needle int, text string")
    got = sorted((r.needle, r.key) for r in substrings.found(rows, "id", "name", index, asked).collect())
    assert got == sorted((n, i) for n, t in needles.items() if t is not None for i, v in values.items() if v is not None and t.lower() in v.lower())
    # Rows read: little more than are found.
    long = {n for n, t in needles.items() if t and len(t) >= 3}
    read = substrings.candidates(index, asked.where("length(text) >= 3")).count()
    assert read <= 1.5 * sum(n in long for n, _ in got) + 10
