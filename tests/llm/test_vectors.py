"""Codes, hard negatives and near neighbours of vectors, against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenarium.llm import hard_negatives, neighbours, vector_codes

ODD = [(900, None, 1), (950, [1.0, None], 2), (1000, [float("nan")] * 6, 3), (1050, [float("inf")] * 6, 1)]
SCHEMA = "vec_id long, embedding array<double>, label int, code string, kept string, score string"


def frame(spark, rows):
    """Rows of (vec_id, embedding, label) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, v, label, "c", "k", "s") for i, v, label in rows], SCHEMA)


def grid(n, dims=6, seed=None, step=0.25):
    """Vectors on a coarse grid, so that many distances are equal."""
    rng = np.random.default_rng(n if seed is None else seed)
    return np.round(rng.standard_normal((n, dims)) / step) * step


def plain_rounds(x, parts, entries, rounds):
    """Lloyd's rounds with every distance, in Python's integers."""
    x = x.reshape(len(x), parts, -1)
    books = [[[int(c) for c in v] for v in x[:entries, p]] for p in range(parts)]
    nearest = lambda v, book: min((sum((int(a) - b) ** 2 for a, b in zip(v, e, strict=True)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        codes = [[nearest(v[p], books[p])[1] for p in range(parts)] for v in x]
        for p in range(parts):
            for j in range(len(books[p])):
                mine = [v[p] for v, c in zip(x, codes, strict=True) if c[p] == j]
                if mine:
                    books[p][j] = [int(sum(int(c) for c in d)) // len(mine) for d in zip(*mine, strict=True)]
    found = [[nearest(v[p], books[p]) for p in range(parts)] for v in x]
    return books, [[f[1] for f in row] for row in found], [sum(f[0] for f in row) for row in found]


@pytest.mark.parametrize(("n", "parts", "entries", "rounds"), [(0, 2, 4, 6), (3, 2, 4, 6), (150, 2, 8, 6), (150, 3, 16, 1), (80, 6, 5, 0)])
def test_codes(spark, n, parts, entries, rounds):
    x = grid(n)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)] + ODD
    # A row that repeats an id, a null id, one shorter and one too large to have errors that are longs.
    rows += [(2, x[2].tolist(), None), (None, x[1].tolist(), None), (n, [1.0], 0), (n + 1, [1e12] * 6, 0)] if n else []
    coded = vector_codes.compress(frame(spark, rows).repartition(3), ["vec_id", "label"], parts=parts, entries=entries, rounds=rounds)
    got = sorted(((r.vec_id is None, r.vec_id or 0), r.label is None, r.code, r.error) for r in coded.rows.collect())
    if not n:
        assert not got and coded.books.shape == (parts, 0, 0)
        return
    held = sorted((((i is None, i or 0), label is None, [*v, *[0.0] * (6 - len(v))]) for i, v, label in rows if i is None or i <= n), key=lambda r: (r[0], r[2]))
    whole = np.floor(4096 * np.array([v for _, _, v in held])).astype(np.int64)
    books, codes, errors = plain_rounds(whole, parts, entries, rounds)
    assert coded.books.tolist() == books
    assert got == sorted((i, label, c, e) for (i, label, _), c, e in zip(held, codes, errors, strict=True))


def test_bounds_spare_distances():
    """Clustered parts keep their entries without distances, and what is found is that of all distances."""
    rng = np.random.default_rng(5)
    x = np.floor(4096 * (rng.standard_normal((16, 2, 4))[rng.integers(0, 16, 3000)] + 0.02 * rng.standard_normal((3000, 2, 4)))).astype(np.int64)
    books = np.ascontiguousarray(x[rng.permutation(3000)[:16]].transpose(1, 0, 2))
    code, upper, lower = vector_codes.assign_anew(x, books)
    after = books + rng.integers(-400, 400, books.shape)
    again, up, low, taken = vector_codes.assign_again(x, code, upper, lower, after, vector_codes._moved(books, after))
    want, exact, _ = vector_codes.assign_anew(x, after)
    assert (again == want).all() and taken < 0.2 * x.shape[0] * 2 * 16
    squares = ((x[:, :, None, :] - after[None]) ** 2).sum(-1)
    assert (low.astype(float) ** 2 <= squares).all() and (up >= exact).all()


def test_roots_are_exact():
    n = np.array([0, 1, 2, 3, 4, 2**52 + 1, (2**28 - 1) ** 2 - 1, (2**28 - 1) ** 2, 2**62 - 1, 2**62])
    down, up = vector_codes.floor_root(n), vector_codes.ceil_root(n)
    assert all(d * d <= s < (d + 1) ** 2 and (u - 1) ** 2 < s <= u * u or s == u == 0 for s, d, u in zip(n.tolist(), down.tolist(), up.tolist(), strict=True))


def test_codes_of_other_rows(spark):
    """Rows are encoded by books they weren't trained on; decoded ones lie as far off as their error says."""
    rows = [(i, v.tolist(), 0) for i, v in enumerate(grid(60))]
    books = vector_codes.compress(frame(spark, rows[:40]), parts=3, entries=8).books
    coded = vector_codes.encode(frame(spark, rows[40:] + ODD), books, ["vec_id", "embedding"]).collect()
    assert sorted(r.vec_id for r in coded) == list(range(40, 60))
    back = vector_codes.decode(spark.createDataFrame(coded), books).collect()
    for r in back:
        x = np.floor(4096 * np.array(r.embedding))
        assert round(float(((np.array(r.vector) * 4096 - 0.5 - x) ** 2).sum())) == r.error


def test_code_query(spark, tmp_path):
    """Labels share a sum, nulls one of their own; the digest is that of the books."""
    rows = [(i, v.tolist(), [None, 1, 1, 2][i % 4]) for i, v in enumerate(grid(40, 16))]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in vector_codes.op11_vector_codes(spark, str(tmp_path)).collect()}
    books, codes, errors = plain_rounds(np.floor(4096 * np.array([v for _, v, _ in rows])).astype(np.int64), 8, 16, 6)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    for (i, _, label), code, error in zip(rows, codes, errors, strict=True):
        total = sum(e for e, (_, _, other) in zip(errors, rows, strict=True) if other == label)
        assert tuple(got[i]) == (i, "".join(f"{c:02x}" for c in code), error, total, digest)


def plain_negatives(x, labels, ids, positives=5, negatives=5):
    v = [[int(c) for c in row] for row in np.floor(256 * x)]
    out = []
    for a in (i for i in ids if i % 5 == 0):
        at = ids.index(a)
        scores = sorted(((-sum(p * q for p, q in zip(v[at], v[i], strict=True)), ids[i], labels[i]) for i in range(len(ids)) if i != at))
        for good, positive, _ in [s for s in scores if s[2] == labels[at]][:positives]:
            fitting = [s for s in scores if s[2] != labels[at] and 80 * -good <= 100 * -s[0] <= 100 * -good]
            out += [(a, positive, r, n, -good, -s) for r, (s, n, _) in enumerate(fitting[:negatives], 1)]
    return sorted(out)


@pytest.mark.parametrize(("n", "blocks", "together"), [(0, (4, 8), 64), (4, (4, 8), 64), (200, (8, 16), 3), (200, (4096, 8192), 64)])
def test_hard_negatives(spark, monkeypatch, n, blocks, together):
    """Ties, one label with most rows, labels of one row, and rows that take no part."""
    monkeypatch.setattr(hard_negatives, "TOGETHER", together)
    x, labels = grid(n, step=0.5), [0 if i % 3 else i % 7 if i % 13 else 100 + i for i in range(n)]
    rows = [(i, v.tolist(), label) for i, (v, label) in enumerate(zip(x, labels, strict=True))] + ODD + [(1100, [1.0] * 6, None), (None, [1.0] * 6, 1), (1200, [1e9] * 6, 1)]
    rows += [(2, x[2].tolist(), labels[2])] if n else []
    got = hard_negatives.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, query_block=blocks[0], candidate_block=blocks[1]).collect()
    assert sorted(map(tuple, got)) == plain_negatives(x, labels, list(range(n)))


def test_shorter_vectors_and_text_labels(spark):
    rows = [(0, [1.0, 0.0], "a"), (1, [1.0], "a"), (2, [0.9, 0.5], "b"), (3, [0.95], "b"), (4, [], "c")]
    frame_ = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = hard_negatives.hard_negatives(frame_, F.col("vec_id") == 0).collect()
    assert [(r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got] == [(1, 1, 3, 65536, 62208), (1, 2, 2, 65536, 58880)]


def test_planes_drop_candidates():
    """Fewer pairs are read with each plane, and large components stay exact."""
    rng = np.random.default_rng(3)
    x = np.floor(2.0**20 * rng.standard_normal((4000, 16))).astype(np.int64)
    bits = int(np.abs(x).max() + 1).bit_length() + 1
    planes = np.unpackbits(hard_negatives.slice_bits(x, bits), axis=2)[:, :, :16]
    assert (hard_negatives._joined(planes) == x).all()
    anchors, ids, scores = x[:20], np.arange(4000), x[:20] @ x.T
    low, high = np.full(20, hard_negatives.LOWEST), np.full(20, hard_negatives.HIGHEST)
    s, found, score, read = hard_negatives.sliced_best(anchors, np.arange(20), low, high, planes, ids, np.ones((20, 4000), bool), 5)
    assert read == sorted(read, reverse=True) and read[-1] < 0.01 * read[0]
    for a in range(20):
        want = np.lexsort((ids, -scores[a]))[:5]
        assert found[s == a].tolist() == want.tolist() and score[s == a].tolist() == scores[a][want].tolist()


def test_few_pairs_from_the_start():
    """Where few pairs take part, no plane is read densely, and negative anchors keep their candidates."""
    x = np.array([[-9, -7], [-8, 3], [5, -8], [-9, -9], [4, 4], [7, -1]])
    planes = np.unpackbits(hard_negatives.slice_bits(x, 5), axis=2)[:, :, :2]
    allowed = np.zeros((40, 6), bool)
    allowed[0] = True
    anchors = np.tile([[-9, -1]], (40, 1))
    s, found, score, _ = hard_negatives.sliced_best(anchors, np.arange(40), np.full(40, -1000), np.full(40, 88), planes, np.arange(6), allowed, 2)
    assert s.tolist() == [0, 0] and list(zip(found.tolist(), score.tolist(), strict=True)) == [(0, 88), (1, 69)]


def plain_neighbours(x, ids, queries, k):
    """(query, vec_id) to score of each query's nearest, ties to smaller ids."""
    out = {}
    for q in queries:
        at = ids.index(q)
        scores = [float(s) for s in neighbours.products(np.broadcast_to(x[at], x.shape), x)]
        best = sorted((-s, i) for s, i in zip(scores, ids, strict=True) if i != q)[:k]
        out |= {(q, i): -s for s, i in best}
    return out


def searched(got, x, ids, k, least):
    """Ranks, scores and number of what was found, and the share of the true neighbours in it."""
    queries = sorted({r.query_id for r in got})
    want, at = plain_neighbours(x, ids, queries, k), {i: j for j, i in enumerate(ids)}
    for q in queries:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, min(k, len(ids) - 1) + 1)) and len({r.vec_id for r in mine}) == len(mine)
        assert [(-r.score, r.vec_id) for r in mine] == sorted((-r.score, r.vec_id) for r in mine)
        assert all(r.score == neighbours.products(x[[at[q]]], x[[at[r.vec_id]]])[0] and r.vec_id != q for r in mine)
    met = sum((r.query_id, r.vec_id) in want for r in got)
    assert met >= least * len(want)
    return queries


@pytest.mark.parametrize("n", [0, 1, 7, 90])
def test_few_neighbours(spark, n):
    """Small tables give all there is: rows that take no part, repeats, ties and norms of all sizes."""
    x = grid(n) * np.array([10.0 ** (i % 4 - 2) for i in range(n)])[:, None] + (0.25 if n else 0)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + ODD + [(None, [1.0] * 6, 1), (1100, [0.0] * 6, 1), (1200, [], 1), (1300, [1e200] * 6, 1)]
    rows += [(0, x[0].tolist(), 3)] if n else []
    got = neighbours.neighbours(frame(spark, rows), F.col("vec_id") % 5 == 0, k=20, rows_per_list=16, slab=8, query_block=4).collect()
    assert searched(got, x, list(range(n)), 20, 1.0 if n < 20 else 0.95) == (list(range(0, n, 5)) if n > 1 else [])


def test_neighbours_of_clusters(spark):
    """Clustered rows, a third of them equal, are found with few lists; slabs and blocks are small."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20, 24))[rng.integers(0, 20, 3000)] + 0.2 * rng.standard_normal((3000, 24))
    x[::3] = x[0]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    got = neighbours.neighbours(frame(spark, rows), F.col("vec_id") % 50 == 1, rows_per_list=100, slab=64, query_block=16, sample=(4, 200, 400)).collect()
    assert searched(got, x, list(range(3000)), 20, 0.9) == list(range(1, 3000, 50))


def test_scan_gives_up_pairs():
    """Most pairs go before their last column block, and few true neighbours with them."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 128))[rng.integers(0, 40, 4000)] + 0.5 * rng.standard_normal((4000, 128))
    top, ids = float(np.sqrt((x**2).sum(1).max())), np.arange(4000)
    turn = neighbours.rotation(129)
    assert np.allclose(turn @ turn.T, np.eye(129))
    parts = neighbours.column_blocks(129)
    cut = lambda v: [np.ascontiguousarray((v @ turn).astype(np.float32)[:, p]) for p in parts]
    queries = x[:50]
    q, c, s, read = neighbours.scan(queries, ids[:50], cut(neighbours.asking(queries)), np.full(50, -np.inf), top, x, ids, cut(neighbours.lifted(x, top)), 10)
    want = {(int(i), int(j)) for i in range(50) for j in [j for j in np.argsort(-(x @ x[i]), kind="stable") if j != i][:10]}
    assert len(want & set(zip(q.tolist(), c.tolist(), strict=True))) >= 0.97 * len(want)
    assert sum(read[:-1]) < 0.6 * len(parts) * 50 * 4000 and read[-1] < 0.2 * 50 * 4000


def test_neighbour_query(spark):
    """Recall of the query itself on a whole table."""
    folder = "/root/testdata/sf0.1"
    got = neighbours.op13_near_neighbours(spark, folder).collect()
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    x, ids = np.array([r.embedding for r in rows], dtype=np.float64), [r.vec_id for r in rows]
    assert searched(got, x, ids, 20, 0.9) == sorted(i for i in ids if i % 20 == 0)
