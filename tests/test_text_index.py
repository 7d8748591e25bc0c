"""The full-text index against plain lists, with blocks small and large."""

import math
import random
import re

import pyarrow as pa
import pytest

from plenarium.operators import text_index


def words(text):
    return re.findall(r"[^\W_]+", text.lower()) if text else []


@pytest.fixture(params=[(3, 12), (2048, 1 << 20)])
def pages(spark, request):
    rng = random.Random(8)
    texts = {i: " ".join(rng.choice(["the", "the", "a", "House", "bill,", "Été", "x1", "no-one", "vote."]) for _ in range(rng.choice([0, 1, 5, 9, 40]))) for i in range(60)}
    texts |= {70: None, 71: "...", 72: "the " * 300}
    frame = spark.createDataFrame([*texts.items(), (None, "the bill")], "id long, body string").repartition(3)
    return {i: words(t) for i, t in texts.items()}, text_index.postings(frame, "id", "body", *request.param).cache()


def test_postings(pages):
    plain, index = pages
    found, blocks = {}, index.select("block").distinct().count()
    for r in index.collect():
        assert len(r["keys"]) == len(r.tfs) and sum(r.tfs) == len(r.places)
        at = 0
        for key, tf in zip(r["keys"], r.tfs, strict=True):
            place, own = 0, []
            for step in r.places[at : at + tf]:
                place += step
                own.append(place)
            at += tf
            assert (r.word, key) not in found
            found[r.word, key] = own
    want = {}
    for key, some in plain.items():
        for i, w in enumerate(some):
            want.setdefault((w, key), []).append(i)
    assert found == want
    # A frequent word has a row for most blocks.
    assert blocks <= 4 or index.where("word = 'the'").count() > 10
    counts = {r.word: (r.pages, r.places) for r in text_index.word_counts(index).collect()}
    assert counts == {w: (sum(w == x for x, _ in want), sum(len(v) for (x, _), v in want.items() if x == w)) for w, _ in want}


@pytest.mark.parametrize("at_once", [2, text_index.PHRASES])
def test_phrases(spark, pages, at_once):
    plain, index = pages
    phrases = {1: "the bill", 2: "The  HOUSE; the", 3: "the the", 4: "no-one", 5: "vote", 6: "", 7: "absent bill", 8: "été"}
    got = {(r.phrase, r.key): r.n for r in text_index.phrase_hits(index, spark.createDataFrame(list(phrases.items()), "phrase int, text string"), at_once).collect()}
    want = {}
    for p, text in phrases.items():
        some = words(text)
        for key, page in plain.items():
            n = sum(page[i : i + len(some)] == some for i in range(len(page))) if some else 0
            if n:
                want[p, key] = n
    assert got == want and len(want) > 60


def test_no_phrases(spark, pages):
    """No phrases, and no pages."""
    _, index = pages
    one = spark.createDataFrame([("a", "the bill")], "phrase string, text string")
    assert text_index.phrase_hits(index, one.limit(0)).collect() == []
    none = text_index.phrase_hits(index.limit(0), one)
    assert none.collect() == [] and none.dtypes == [("phrase", "string"), ("key", "bigint"), ("n", "bigint")]


def test_a_block_is_sorted_by_word():
    """In itself, so that nothing has to sort blocks after it."""
    words, block, keys, tfs, places = text_index._block(pa.array([7, 5]), pa.array([["vote", "été", "Bill", "vote"], ["act", "vote"]]))
    assert words.to_pylist() == ["Bill", "act", "vote", "été"] and block.to_pylist() == ["7"] * 4
    assert keys.to_pylist() == [[7], [5], [7, 5], [7]] and tfs.to_pylist() == [[1], [1], [2, 1], [1]] and places.to_pylist() == [[2], [0], [0, 3, 1], [1]]


def test_blocks_are_written_as_they_come(spark, tmp_path):
    """A task's blocks follow one another, each sorted by word, so that writing holds one of them."""
    frame = spark.createDataFrame([(i, f"the {w} bill Été a{i}") for i, w in enumerate(["vote", "House", "act", "bill"] * 5)], "id long, body string").coalesce(1)
    index = text_index.postings(frame, "id", "body", most_pages=4)
    text_index.write_index(index, str(tmp_path / "index"), ranged=False)
    rows = [(int(r.block), r.word) for r in spark.read.parquet(str(tmp_path / "index")).collect()]
    assert rows == sorted(rows, key=lambda r: (r[0], r[1].encode())) and {b for b, _ in rows} == {0, 4, 8, 12, 16}
    text_index.write_index(index, str(tmp_path / "ranged"))
    assert sorted((int(r.block), r.word) for r in spark.read.parquet(str(tmp_path / "ranged")).collect()) == sorted(rows)


def test_ranked(spark, pages, tmp_path):
    """All pages scored give the same; the index may be a written one."""
    plain, index = pages
    text_index.write_index(index, str(tmp_path / "index"))
    stored = spark.read.parquet(str(tmp_path / "index"))
    queries = {1: "bill House", 2: "the the été", 3: "absent", 4: "x1"}
    n = sum(map(bool, plain.values()))
    for k, first in ((5, 2), (3, 1), (100, 4)):
        got = text_index.ranked(stored, spark.createDataFrame(list(queries.items()), "query int, text string"), n, k, first).collect()
        want = []
        for q, text in queries.items():
            df = {w: sum(w in p for p in plain.values()) for w in set(words(text))}
            idf = {w: math.log1p((n - d + 0.5) / (d + 0.5)) for w, d in df.items() if d}
            scores = {i: sum(idf[w] * p.count(w) / (p.count(w) + 1.2) for w in sorted(idf) if w in p) for i, p in plain.items()}
            best = sorted(((-s, i) for i, s in scores.items() if s), key=lambda x: (round(x[0], 12), x[1]))[:k]
            want += [(q, r, i, round(-s, 9)) for r, (s, i) in enumerate(best, 1)]
        assert sorted((r.query, r["rank"], r.key, round(r.score, 9)) for r in got) == want
