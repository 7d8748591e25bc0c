"""Sharding, exact and near copies, repeated passages: small tables against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plenarium.llm import exact_dedup, line_dedup, near_dedup, sharding
from plenarium.llm.graph import components

SCHEMA = "doc_id long, text string, shard int, digest string, row string, doc long, component_id long"


def docs(spark, rows):
    """Rows of (doc_id, text) with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 7, "d", "r", 1, 2) for i, t in rows], SCHEMA)


ODD = [(1, "a b"), (2, None), (3, ""), (4, "a \t b"), (4, "a \t b"), (None, "a b"), (5, "x" * 300_000), (6, " \n"), (2**60 + 1, "a  b"), (7, "x" * 300_000 + " ")]


@pytest.mark.parametrize("rows", [[], ODD, [(i, "t") for i in range(200)]])
def test_shards(spark, rows):
    out = sharding.shuffle_shards(docs(spark, rows), shards=6, rows_per_cell=4, rows_per_file=9).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((len(slots.get(k, [])) for k in range(6)), reverse=True) == sharding.shard_sizes(len(rows), 6)


def test_shards_of_documents(spark):
    """The query's own law: sizes that differ by one at most, gapless slots, every row once, the same again."""
    run = lambda: sorted((r.doc_id, r.shard, r.slot) for r in sharding.op1_sharding(spark, "/root/testdata/sf0.01").collect())
    rows = run()
    assert [i for i, _, _ in rows] == sorted(r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect())
    slots = {}
    for _, shard, slot in rows:
        slots.setdefault(shard, []).append(slot)
    assert sorted(slots) == list(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {len(s) for s in slots.values()} <= {len(rows) // 40, len(rows) // 40 + 1}


def test_slots_are_uniform(spark):
    """Every row reaches every shard and slot about equally often over seeds."""
    frame = docs(spark, [(i, "t") for i in range(6)]).repartition(3)
    seen = Counter((r.doc_id, r.shard, r.slot) for seed in range(60) for r in sharding.shuffle_shards(frame, shards=2, seed=seed, rows_per_cell=2, rows_per_file=2).collect())
    assert len(seen) == 36 and sum((n - 10) ** 2 / 10 for n in seen.values()) < 60


def test_shards_are_uniform(spark):
    """Every row reaches every shard about equally often over seeds."""
    counts, sizes = [5, 7, 0, 12], sharding.shard_sizes(24, 4)
    sums = np.zeros((4, 4))
    for seed in range(600):
        m = np.array(sharding.communication_matrix(counts, sizes, seed))
        assert m.sum(1).tolist() == counts and m.sum(0).tolist() == sizes
        sums += m
    assert np.allclose(sums / 600, np.outer(counts, sizes) / 24, atol=0.15)


def test_large_hypergeometric():
    """Beyond numpy's limit the draws have the law's mean and spread."""
    rng = np.random.default_rng(0)
    good, bad, n = 3_000_000_000, 9_000_000_000, 40_000
    x = np.array([sharding.draw_hypergeometric(rng, good, bad, n) for _ in range(400)])
    assert abs(x.mean() - n / 4) < 20 and abs(x.std() - np.sqrt(n * 3 / 16)) < 15
    assert sharding.draw_hypergeometric(rng, 5, 2_000_000_000, 0) == 0


def same(a, b):
    return a is None and b is None or a == b


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.length(c).cast("string")])
@pytest.mark.parametrize("rows", [[], ODD, [(i, f"t{i % 3}") for i in range(90)]])
def test_exact_copies(spark, rows, digest):
    """Also with a digest that collides."""
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(normal(t), []).append(i)
    first = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = Counter((i, first[normal(t)], len(groups[normal(t)]), same(i, first[normal(t)])) for i, t in rows)
    out = exact_dedup.copy_groups(docs(spark, rows), digest=digest).collect()
    assert Counter(tuple(r)[:4] for r in out) == want
    if digest is exact_dedup.sha256:
        texts = {hashlib.sha256(normal(t).encode()).hexdigest() for _, t in rows}
        assert {r.text_digest for r in out} == texts


def test_dropping_copies(spark):
    out = exact_dedup.drop_copies(docs(spark, ODD))
    assert out.columns == docs(spark, []).columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 2, 5, 6, 7]


def test_one_row_of_equal_rows_stays(spark):
    """Rows that repeat a doc_id and a text, and rows without an id."""
    rows = [(5, "same text here"), (5, "same text here"), (6, "same  text here"), (None, "alone and without an id")] + [(None, "twice and without an id")] * 2
    want = [(None, "alone and without an id"), (None, "twice and without an id"), (5, "same text here")]
    for drop in (exact_dedup.drop_copies, near_dedup.drop_near_duplicates):
        got = [(r.doc_id, r.text) for r in drop(docs(spark, rows)).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_many_null_ids(spark):
    """Rows without an id are as many rows as any others; a third of all share one text."""
    family_texts = [t for _, t in family(9, 40, 0)]
    frame = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit(family_texts[0])).otherwise(F.concat(F.lit("row number "), F.col("id").cast("string"), F.lit(" of its own"))).alias("text"))
    frame = frame.unionByName(spark.createDataFrame([(None, t) for t in family_texts], "doc_id long, text string"))
    out = near_dedup.near_duplicates(frame, words=2).collect()
    assert len(out) == 9040 and all(r.component_id is None and r.kept for r in out)
    left = near_dedup.drop_near_duplicates(frame, words=2).count()
    links = brute_near([(i, t) for i, t in enumerate(family_texts)], 2, 80)
    assert left == 6000 + sum(n for (_, _, _, kept), n in links.items() if kept)


def brute_near(rows, words, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k)), same(i, least.get(find(k)))) for k, (i, _) in enumerate(rows))


def family(seed, n, start, length=60, edits=4, vocabulary=30):
    """Near copies of one text, some close and some just out of reach."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
    out = []
    for k in range(n):
        text = list(base)
        for _ in range(rng.randrange(edits + 1)):
            text[rng.randrange(length)] = f"v{rng.randrange(1000)}"
        out.append((start + k, " ".join(text)))
    return out


@pytest.mark.parametrize(("block", "block_shingles"), [(1024, 1 << 20), (4, 1 << 20), (1024, 500)])
def test_near_copies(spark, block, block_shingles):
    """Small blocks take the ways of large buckets and large clusters."""
    rows = [*family(1, 30, 100), *family(2, 12, 200, edits=9), (1, "One two"), (2, "one  TWO"), (3, "ONE"), (4, None), (5, ""), (6, " \n"), (7, "É b c"), (8, "é b c"), (9, "solo"), (9, "solo"), (2**60 + 1, "a b c d e"), (2**60, "a b c d e"), (11, "rep " * 5000)]
    out = near_dedup.near_duplicates(docs(spark, rows), words=2, block=block, block_shingles=block_shingles).collect()
    assert Counter(map(tuple, out)) == brute_near(rows, 2, 80)


def test_near_copies_of_documents(spark):
    """All pairs of a whole table by brute force."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    shingles = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        shingles[i] = {tuple(w[k : k + 2]) for k in range(max(1, len(w) - 1))} if w else set()
    root = {i: i for i in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(shingles, key=lambda i: len(shingles[i]))
    for n, a in enumerate(order):
        for b in order[n + 1 :]:
            if 100 * len(shingles[a]) < 80 * len(shingles[b]):
                break
            shared = len(shingles[a] & shingles[b])
            if shared and 100 * shared >= 80 * (len(shingles[a]) + len(shingles[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = near_dedup.op5_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(i, len(s), find(i), find(i) == i) for i, s in shingles.items()}


def test_near_copies_of_nothing(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).count() == 0
    assert [tuple(r) for r in near_dedup.near_duplicates(docs(spark, [(None, "a b c"), (None, None)])).orderBy("n_shingles").collect()] == [(None, 0, None, True), (None, 1, None, True)]


def test_needed_matches():
    """A pair at the threshold is rarely dropped, one far below it soon."""
    needed = near_dedup.needed_matches(80)
    rng = np.random.default_rng(1)
    at = rng.binomial(32, 0.8, 200_000)
    assert (at < needed[32]).mean() < 1e-4
    assert (rng.binomial(near_dedup.HASHES, 0.4, 10_000) < needed[near_dedup.HASHES]).mean() > 0.999


def test_word_hashes_of_long_texts():
    text = ("alpha Beta  gamma\n" * 40_000) + "z" * 400_000 + " end"
    hashes = near_dedup.word_hashes(text)
    assert len(hashes) == len(text.split()) and len(set(hashes.tolist())) == 5
    assert near_dedup.word_hashes("beta")[0] == hashes[1]


def test_words_without_algebraic_collisions(spark):
    """A Thue-Morse word and its complement, which every polynomial modulo 2^64 takes for one."""
    word = "a"
    while len(word) < 1024:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = (int(near_dedup.word_hashes(w)[0]) for w in (word, other))
    assert a != b and (a ^ b) & 0xFFFFFFFF and (a ^ b) >> 32
    got = near_dedup.near_duplicates(docs(spark, [(1, word), (2, other), (3, word.upper())])).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (2, 2), (3, 1)]
    # A word is the same word in a text that is worked on by parts.
    huge = word * 1000
    assert near_dedup.word_hashes(f"{word} {huge} {word}").tolist() == [a, int(near_dedup.word_hashes(huge)[0]), a]
    assert len({int(near_dedup.word_hashes(x)[0]) for x in (huge, huge[:-1] + "c", "c" + huge[1:], huge + "a")}) == 4


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(999, 500 + i) for i in range(90)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == {x: find(x) for x in linked}


def plain_chunks(text, mean_lines=line_dedup.MEAN_LINES):
    """Chunks as the rule says: a hash over a line and the one before it ends a chunk."""
    digest = lambda x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little")
    lines = text.split("\n")
    ends = [i for i, x in enumerate(lines) if ((((digest(lines[i - 1]) if i else 0) * line_dedup._STEP) ^ digest(x)) % 2**64 * line_dedup._STEP >> 40) % mean_lines == 0]
    starts = [0, *(e + 1 for e in ends)]
    return [lines[a:b] for a, b in zip(starts, [*starts[1:], len(lines)], strict=True) if lines[a:b]]


def brute_lines(rows):
    """Texts of all rows in the order given, without later places of chunks of two lines and more."""
    seen, out = set(), []
    for _, t in rows:
        kept = []
        for chunk in plain_chunks(t or ""):
            if sum(1 for x in chunk if x.strip()) > 1:
                if tuple(chunk) in seen:
                    continue
                seen.add(tuple(chunk))
            kept += chunk
        out.append(None if t is None else "\n".join(kept))
    return out


def test_repeated_passages(spark):
    rng = random.Random(2)
    passage = [f"line {k} of the passage" for k in range(14)]
    long_line = " ".join(f"word{k}" for k in range(60))
    rows = [(i, "\n".join([f"own {rng.random()}" for _ in range(rng.randrange(4))] + passage + [f"end {i}"])) for i in range(6)]
    rows += [(20, long_line), (21, f"x\n{long_line}\ny"), (22, None), (23, ""), (24, "\n\n"), (25, "a\n" * 3000), (26, f"{long_line}\n{long_line}")]
    out = line_dedup.remove_repeats(docs(spark, rows))
    assert out.columns == [*docs(spark, []).columns, "n_chunks_removed", "n_chars_removed"]
    got = {r.doc_id: r for r in out.collect()}
    assert [got[i].text for i, _ in rows] == brute_lines(rows)
    assert got[21].text == rows[7][1] and got[20].n_chunks_removed == 0
    assert sum("line 7 of the passage" in (r.text or "") for r in got.values()) == 1
    assert line_dedup.remove_repeats(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [49, 50, 51])
def test_passages_of_one_line(spark, n):
    """A repeated run of fifty words goes whether it is one line or several."""
    words = [f"word{k}" for k in range(n)]
    for shape in (" ".join(words), "\n".join([" ".join(words[:20]), " ".join(words[20:])])):
        rows = [(i, f"start {i}\n{shape}\nend {i}") for i in range(4)]
        got = {r.doc_id: r.text for r in line_dedup.remove_passages(docs(spark, rows), mean_lines=10**9).collect()}
        assert got == {i: t if i == 0 or n < 50 else f"start {i}\nend {i}" for i, t in rows}


def test_repeats_in_rows_without_an_id(spark):
    """Each row is a document, also rows that share an id or are equal altogether."""
    passage = "\n".join(f"line {k} of a passage that comes again" for k in range(12))
    rows = [(None, passage)] * 3 + [(None, f"own\n{passage}"), (5, passage), (5, passage), (6, f"{passage}\nend")]
    out = line_dedup.remove_passages(docs(spark, rows)).collect()
    assert Counter(r.text for r in out) == Counter([passage, "", "", "own", "", "", "end"]) or Counter(r.text for r in out) == Counter(["", "", "", f"own\n{passage}", "", "", "end"])
    many = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit(passage), F.when(F.col("id") % 3 > 0, F.concat(F.lit("\n"), F.col("id").cast("string"))).otherwise("")).alias("text"))
    left = [r.text for r in line_dedup.remove_passages(many).collect()]
    assert sum(len(t) > 20 for t in left) == 1 and len(left) == 6000


def test_cut_is_shift_resistant():
    passage = [f"line {k} of the passage" for k in range(40)]
    a = {c for c, ok in line_dedup.cut("\n".join(["p", "q", "r", *passage])) if ok}
    b = {c for c, ok in line_dedup.cut("\n".join(["other", *passage, "tail"])) if ok}
    assert len(a & b) >= 0.7 * min(len(a), len(b))
    text = "\n".join(passage)
    assert "\n".join(c for c, _ in line_dedup.cut(text)) == text


def brute_runs(rows, words=50):
    """Texts without the later place of every maximal run that two places share; for texts without repeated chunks outside runs."""
    lines = [(i, k, x) for i, t in sorted(rows) for k, x in enumerate(t.split("\n"))]
    gone = set()
    for b in range(len(lines)):
        for a in range(b):
            together = lambda p, q: 0 <= p < len(lines) and 0 <= q < len(lines) and lines[p][0] == lines[p - 1][0] and lines[q][0] == lines[q - 1][0]
            if lines[a][2] != lines[b][2] or a and together(a, b) and lines[a - 1][2] == lines[b - 1][2]:
                continue
            n = 1
            while together(a + n, b + n) and lines[a + n][2] == lines[b + n][2]:
                n += 1
            run = list(range(b, b + n))
            while run and not lines[run[-1]][2].strip():
                run.pop()
            while run and not lines[run[0]][2].strip():
                run.pop(0)
            if sum(len(lines[x][2].split()) for x in run) >= words:
                gone.update(run)
    return {i: "\n".join(x for p, (j, _, x) in enumerate(lines) if j == i and p not in gone) for i, _ in rows}


def test_repeated_runs_go_whole(spark):
    rng = random.Random(5)
    passages = [[" ".join(f"w{p}x{k}x{j}" for j in range(n)) for k in range(size)] for p, (size, n) in enumerate([(2, 25), (3, 20), (4, 13), (5, 11), (2, 24), (5, 30)])]
    rows = []
    for i in range(60):
        own = [[f"own {i} {rng.random()}"] * rng.randrange(2) for _ in range(3)]
        part = passages[rng.randrange(6)]
        # A cut passage shares less than the whole one, which can still be 50 words.
        rows.append((i, "\n".join([*own[0], *part[rng.randrange(2) :], *own[1], "", *passages[rng.randrange(6)], *own[2]])))
    rows += [(70, "a b c\n" * 40), (71, "a b c\n" * 40 + "tail")]
    out = {r.doc_id: r for r in line_dedup.remove_passages(docs(spark, rows), mean_lines=10**9).collect()}
    assert {i: r.text for i, r in out.items()} == brute_runs(rows)
    # With chunks of two lines and more as well, nothing of a later passage of 50 words is left.
    got = {r.doc_id: r for r in line_dedup.remove_passages(docs(spark, rows)).collect()}
    for p in (0, 1, 2, 3, 5):
        whole = [i for i, t in rows if "\n".join(passages[p]) in t]
        assert len(whole) > 2 and not any(x in got[i].text.split("\n") for i in whole[1:] for x in passages[p] if rows[i][1].count(x) == 1)
    kept = {x for r in got.values() for x in r.text.split("\n")}
    assert {x for _, t in rows for x in t.split("\n") if x} <= kept
    assert all(len(dict(rows)[i]) - len(r.text) == r.n_chars_removed for i, r in got.items())


def test_crc_of_query(spark):
    out = sharding.op1_sharding(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in out} == {(i, len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in texts.items()}
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}


def test_component_rounds_are_small_plans(spark, monkeypatch):
    """No step of a round holds another several times over; plans like that filled the driver's memory."""
    from plenarium.llm import graph

    shuffles, plain = [], graph.stage

    def counted(df, name, **more):
        shuffles.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return plain(df, name, **more)

    monkeypatch.setattr(graph, "stage", counted)
    got = components(spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == [(i, 0) for i in range(41)]
    assert len(shuffles) > 2 and max(shuffles) <= 8


def test_components_make_no_more_rows_than_links_and_nodes(spark, monkeypatch):
    """Nodes with a link for each of many leads soon have about one; no step doubles its rows."""
    from plenarium.llm import graph

    made, stage = [], graph.stage

    def counted(df, name):
        plan, out = df._jdf.queryExecution().optimizedPlan().toString(), stage(df, name)
        made.append((out.count(), "Generate" in plan))
        return out

    monkeypatch.setattr(graph, "stage", counted)
    edges = [(20 + i, j) for i in range(300) for j in range(20) if (i * 7 + j) % 3] + [(1000 + i, 1001 + i) for i in range(9)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{n: 0 for n in range(320)}, **{1000 + i: 1000 for i in range(10)}}
    assert not any(generated for _, generated in made) and all(n < 1000 for n, _ in made[1:])
