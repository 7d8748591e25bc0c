"""MinHash near-duplicates with sequential Bayesian verification.

1. Documents with the same set of word shingles form a class (equal 128-bit digests of
   the sorted set).
2. Classes that share a band of their MinHash signature are candidates.  Inside each
   bucket, pairs compare their signatures batch by batch; a pair is dropped as soon as
   its posterior probability of reaching the threshold falls under the miss probability.
   A bucket passes on one link for each class, to the least that it is connected with by
   what survives, never all its pairs.
3. Components of those links are clusters.  Inside a cluster the surviving pairs between
   classes that aren't connected yet are verified on their full shingle sets.
4. Components of the verified links are the result.

Buckets and clusters above a bound are never gathered whole: a large bucket becomes one
star, and a large cluster is verified in blocks (see ``_cluster_links``).  Full sets travel
only to blocks in which a pair of signatures survives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, discard, identified, stage, table
from .graph import components, join_groups

BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
BATCH = 32
#: Probability, at each look, of dropping a pair that reaches the threshold.
MISS = 1e-6
#: Classes that one task compares with one another.
BLOCK = 1024
#: Shingles that one task holds for them, in the mean, 8 bytes each.
BLOCK_SHINGLES = 4_000_000
LEADERS = 32
#: Characters of text whose sets a task has at a time, a longer text apart.
SET_BYTES = 4 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WHITE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _draws(at: np.ndarray) -> np.ndarray:
    """A random 64-bit number for each place in a word."""
    return _mix(at.astype(np.uint64) * np.uint64(_BASE) + np.uint64(0x6A09E667F3BCC909))


#: Random numbers for each byte, and for the first places.
_BYTES, _PLACES = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)), _draws(np.arange(4096))


def _segments(data: bytes) -> Iterator[bytes]:
    """Parts of the text that end between words."""
    at = 0
    while len(data) - at > _SEGMENT:
        part = data[at : at + _SEGMENT]
        cut = max(part.rfind(c) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) + 1
        if not cut:
            ends = [x for x in (data.find(c, at + _SEGMENT) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")) if x >= 0]
            cut = (min(ends) if ends else len(data)) - at
        yield data[at : at + cut]
        at += cut
    yield data[at:]


def _sums(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """For each word the sum of its bytes' draws times its places' draws.

    Two different words have equal sums with probability 2^-62 over the draws.  Powers of one
    base would do no such thing: modulo 2^64 whole families of words collide for all bases.
    """
    sizes = end - start
    if sizes.max() > _SEGMENT:
        # A word of megabytes is summed by parts.
        parts = [[(_BYTES[codes[at : min(at + _SEGMENT, e)]] * _draws(np.arange(at - s, min(at + _SEGMENT, e) - s))).sum(dtype=np.uint64) for at in range(s, e, _SEGMENT)] for s, e in zip(start, end, strict=True)]
        return np.array([np.sum(p, dtype=np.uint64) for p in parts], dtype=np.uint64)
    first = np.cumsum(sizes) - sizes
    place = np.arange(sizes.sum()) - np.repeat(first, sizes)
    draws = _PLACES[place] if sizes.max() <= len(_PLACES) else _draws(place)
    return np.add.reduceat(_BYTES[codes[place + np.repeat(start, sizes)]] * draws, first)


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased; words are runs of other than ASCII white space."""
    found = []
    for part in _segments(text.encode("utf-8", "surrogatepass").translate(_LOWER)):
        codes = np.frombuffer(part, dtype=np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], _WHITE[codes], [True]])))
        start, end = edge[::2], edge[1::2]
        if len(start):
            found.append(_mix(_sums(codes, start, end) + (end - start).astype(np.uint64)))
    return np.concatenate(found) if found else np.empty(0, np.uint64)


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle as a whole."""
    hashes = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(hashes):
        return hashes
    k = min(words, len(hashes))
    mixed = np.full(len(hashes) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        mixed = _mix(mixed * np.uint64(_BASE) + hashes[j : len(hashes) - k + 1 + j])
    return np.unique(mixed)


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    draw = lambda: rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
    return draw() | np.uint32(1), draw()


_FACTORS, _SHIFTS = _parameters()


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each."""
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, len(upper), 1024):
        some = upper[None, at : at + 1024] * _FACTORS[:, None] + _SHIFTS[:, None]
        np.minimum(least, some.min(axis=1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).astype(np.uint64).T:
        keys = _mix(keys * np.uint64(_BASE) + column)
    return keys.view(np.int64)


def needed_matches(percent: int, miss: float = MISS) -> list[int]:
    """For each number of compared hashes, the fewest matches that keep a pair.

    With a uniform prior, P(similarity >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, []
    for n in range(HASHES + 1):
        tail, m = (1 - t) ** (n + 1), 0
        while tail < miss and m < n:
            m += 1
            tail += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out.append(m)
    return out


def surviving(sketch: np.ndarray, left: np.ndarray, right: np.ndarray, needed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that no look drops, and their matches over all hashes.

    Sketches keep eight bits of each hash: chance matches only ever keep a pair longer.
    """
    alive, matches = np.arange(len(left)), np.zeros(len(left), dtype=np.int32)
    for at in range(0, HASHES, BATCH):
        part = slice(at, at + BATCH)
        matches = matches + (sketch[left[alive], part] == sketch[right[alive], part]).sum(1, dtype=np.int32)
        good = matches >= needed[min(HASHES, at + BATCH)]
        alive, matches = alive[good], matches[good]
        if not len(alive):
            break
    return alive, matches


def _near_sizes(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


class _Roots:
    """Union-find over the rows of one batch."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def of(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.of(a), self.of(b)
        self.up[max(a, b)] = min(a, b)
        return a != b

    def all(self) -> np.ndarray:
        return np.array([self.of(x) for x in range(len(self.up))], dtype=np.int64)


def _sketches(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, HASHES)


def _whole_groups(batches: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``keys`` in frames of about ``rows`` rows that cut no group."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        if sum(map(len, held)) >= rows:
            frame = pd.concat(held, ignore_index=True)
            last = (frame[keys] == frame[keys].iloc[-1]).all(axis=1).to_numpy()
            cut = len(frame) - int(last.sum())
            if cut:
                yield frame.iloc[:cut].reset_index(drop=True)
            held = [frame.iloc[cut:]]
    if held:
        yield pd.concat(held, ignore_index=True)


def _bucket_links(percent: int):
    needed = needed_matches(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, ["key"], 20_000):
            key, sketch = frame["key"].to_numpy(), _sketches(frame["sketch"])
            size, ids = frame["n_shingles"].to_numpy(), frame["cid"].to_numpy()
            # Rows of one class are one node, whatever bucket they stand in.
            names, node = np.unique(ids, return_inverse=True)
            roots, label = _Roots(len(names)), np.arange(len(names))
            for d in range(1, len(frame)):
                left = np.flatnonzero(key[:-d] == key[d:])
                if not len(left):
                    break
                left = left[(label[node[left]] != label[node[left + d]]) & _near_sizes(size[left], size[left + d], percent)]
                for at in range(0, len(left), 100_000):
                    some = left[at : at + 100_000]
                    alive, _ = surviving(sketch, some, some + d, needed)
                    for i in some[alive]:
                        roots.join(node[i], node[i + d])
                label = roots.all() if len(left) and d & (d - 1) == 0 else label
            label = roots.all()
            joined = np.flatnonzero(label != np.arange(len(names)))
            yield pd.DataFrame({"a": names[joined], "b": names[label[joined]]}, dtype="int64")

    return run


def _links_of(frame: pd.DataFrame, percent: int, needed: list[int]) -> list[tuple[int, int]]:
    """Links that connect what verified pairs connect among the rows of one block.

    ``label`` equal and not null: known to be connected.  ``part`` 0: compared with rows
    of part 1 only; null: compared with all.
    """
    frame = frame.drop_duplicates(["cid", "part"], ignore_index=True)
    n = len(frame)
    ids, size, sketch = frame["cid"].to_numpy(), frame["n_shingles"].to_numpy(), _sketches(frame["sketch"])
    sets = [np.frombuffer(s, dtype="<u8") for s in frame["shingles"]]
    part = frame["part"].to_numpy()
    root, label = np.arange(n), frame["label"].to_numpy()
    for value in np.unique(label[label >= 0]):
        same = np.flatnonzero(label == value)
        root[same] = same[0]
    for cid in ids[frame["cid"].duplicated().to_numpy()]:
        same = np.flatnonzero(ids == cid)
        root[np.isin(root, root[same])] = root[same[0]]
    links = []
    for i in range(1, n):
        others = np.flatnonzero((root[:i] != root[i]) & ((part[i] < 0) | (part[:i] == 1 - part[i])) & _near_sizes(size[:i], size[i], percent))
        if not len(others):
            continue
        alive, matches = surviving(sketch, others, np.full(len(others), i), needed)
        for j in others[alive][np.argsort(-matches, kind="stable")]:
            if root[j] != root[i]:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * shared >= percent * (size[i] + size[j] - shared):
                    links.append((ids[i], ids[j]))
                    root[root == root[i]] = root[j]
    if (label < 0).all() and (part < 0).all():
        # Nothing was connected before: to the least of each component instead.
        least = {r: ids[root == r].min() for r in np.unique(root[np.isin(ids, [x for link in links for x in link])])}
        links = [(i, least[r]) for i, r in zip(ids, root, strict=True) if r in least and i != least[r]]
    return links


def _block_links(percent: int):
    needed = needed_matches(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, ["cluster", "block"], 200):
            links: list[tuple[int, int]] = []
            for _, rows in frame.groupby(["cluster", "block"], sort=False):
                links.extend(_links_of(rows, percent, needed))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return run


def _block_survivors(percent: int):
    """Which rows of a block have a partner there that no look drops."""
    needed = needed_matches(percent)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _whole_groups(batches, ["cluster", "block"], 2_000):
            found = []
            for (cluster, block), rows in frame.groupby(["cluster", "block"], sort=False):
                size, sketch, label, part = rows["n_shingles"].to_numpy(), _sketches(rows["sketch"]), rows["label"].to_numpy(), rows["part"].to_numpy()
                gives, hit = np.flatnonzero(part == 1), np.zeros(len(rows), dtype=bool)
                for i in np.flatnonzero(part == 0):
                    others = gives[(label[gives] != label[i]) & _near_sizes(size[gives], size[i], percent)]
                    alive, _ = surviving(sketch, others, np.full(len(others), i), needed)
                    hit[others[alive]] = True
                    hit[i] |= len(alive) > 0
                some = rows[hit]
                found += zip([cluster] * len(some), [block] * len(some), some["cid"], some["part"], strict=True)
            yield pd.DataFrame(found, columns=["cluster", "block", "cid", "part"])

    return run


def _dealt(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("cluster", "block", "cid", "n_shingles", "sketch", "label", "part", *columns).repartition("cluster", "block").sortWithinPartitions("cluster", "block")


def _in_blocks(rows: DataFrame, percent: int) -> DataFrame:
    return _dealt(rows, ["shingles"]).mapInPandas(_block_links(percent), "a long, b long")


def _cluster_links(members: DataFrame, percent: int, block: int) -> DataFrame:
    """Verified links of all clusters; ``members``: cluster, cid, n_shingles, sketch, shingles, blocks.

    A cluster of several blocks is first verified block by block, with the same few leaders
    in each.  Then every class outside the cluster's largest component meets, in blocks,
    every class that it isn't connected with; two classes of the largest component need
    no further link.  They meet by signature first, and the sets of those that have a
    partner in a block follow.
    """
    order = F.pmod(F.xxhash64(F.col("cid"), F.lit(1)), F.lit(1 << 20))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    leads = (F.col("blocks") > 1) & (order * F.col("blocks") * block < F.lit(LEADERS) * (1 << 20))
    everywhere = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    first = members.withColumns({"label": F.lit(-1).cast("long"), "part": F.lit(-1)}).withColumn("block", F.explode(F.when(leads, everywhere).otherwise(F.array(own))))
    links = stage(_in_blocks(first, percent), "links")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return links
    roots = components(links, "rounds")
    plain = large.drop("shingles")
    labelled = stage(plain.join(roots, plain["cid"] == roots["node"], "left").withColumn("label", F.coalesce("root", "cid")).select(*plain.columns, "label"), "labelled")
    counts = labelled.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    main = counts.groupBy("cluster").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("inside"), F.sum("n").alias("n"))
    total = labelled.count()
    rest = join_groups(labelled, main.where("all > inside"), "cluster", total).drop("n")
    rest = rest.withColumn("outer", F.ceil(F.col("blocks") * (F.col("all") - F.col("inside")) / F.col("all")))
    outer = F.pmod(F.xxhash64(F.col("cid"), F.lit(2)), F.col("outer"))
    pair = lambda a, b: (a * F.col("blocks") + b).alias("block")
    asks = rest.where("label <> main").withColumns({"part": F.lit(0), "to": F.explode(everywhere)}).select("*", pair(outer, F.col("to")))
    gives = rest.withColumns({"part": F.lit(1), "to": F.explode(F.sequence(F.lit(0).cast("long"), F.col("outer") - 1))}).select("*", pair(F.col("to"), own))
    hits = stage(_dealt(asks.unionByName(gives), []).mapInPandas(_block_survivors(percent), "cluster long, block long, cid long, part int"), "hits")
    met = hits.join(labelled.drop("cluster"), "cid").join(members.select("cid", "shingles"), "cid")
    return links.unionByName(stage(_in_blocks(met, percent), "links"))


def _components_of(rows: DataFrame, words: int, percent: int, block: int, block_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their class, and classes with their component; ``rows``: row, file, place.

    The first: doc_id, file, place, n_shingles, digest.  The second: digest, copies (its
    rows), component_id, and first, the file and place of the component's row with the
    least (doc_id, file, place), null doc_ids last.
    """

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                shingles = shingle_set(text, words)
                least = signature(shingles)
                digest = hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()
                full = len(shingles) > 0
                out.append((len(shingles), digest, band_keys(least) if full else None, (least & np.uint32(255)).astype(np.uint8).tobytes() if full else None))
            frame = pd.DataFrame(out, columns=["n_shingles", "digest", "bands", "sketch"])
            yield frame.assign(doc_id=batch["doc_id"], file=batch["file"], place=batch["place"])

    # Ids cross into pandas as strings, where a null would turn longs into doubles.
    named = rows.select(F.col("row.doc_id").cast("string").alias("doc_id"), "file", "place", F.col("row.text").alias("text"))
    sketched = named.mapInPandas(sketch, "n_shingles long, digest binary, bands array<long>, sketch binary, doc_id string, file long, place long")
    sketched = stage(sketched.withColumn("doc_id", F.col("doc_id").cast("long")), "sketches")
    # The first row of a class stands for it; by its file and place its text is found again.
    first = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "file", "place")
    classes = stage(
        sketched.where("n_shingles > 0").groupBy("digest", "n_shingles")
        .agg(F.min(first).alias("first"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.count("*").alias("copies"))
        .withColumn("cid", F.monotonically_increasing_id()),
        "classes",
    )
    banded = classes.select("cid", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count("*").alias("rows"), F.min("cid").alias("lead")).where("rows > 1")
    shared = banded.join(buckets, "key")
    stars = shared.where((F.col("rows") > block) & (F.col("cid") != F.col("lead"))).select(F.col("lead").alias("a"), F.col("cid").alias("b"))
    small = shared.where(F.col("rows") <= block).select("key", "cid").join(classes.select("cid", "n_shingles", "sketch"), "cid")
    found_links = small.repartition("key").sortWithinPartitions("key").mapInPandas(_bucket_links(percent), "a long, b long")
    found = components(stars.unionByName(found_links), "clusters")
    clusters = found.withColumnsRenamed({"node": "cid", "root": "cluster"})
    plain = clusters.join(classes.select("cid", "n_shingles", "sketch", "first"), "cid")
    weights = plain.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    sizes = weights.select("cluster", "n", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("w") / block_shingles)).alias("blocks"))
    members = join_groups(plain, sizes, "cluster", clusters.count())

    def with_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            plain = batch.drop(columns="text")
            # Sets are larger than texts, so they leave a few at a time.
            for some in chunks(enumerate(batch["text"]), lambda x: len(x[1]), SET_BYTES):
                sets = [shingle_set(text, words).astype("<u8").tobytes() for _, text in some]
                yield plain.iloc[some[0][0] : some[-1][0] + 1].assign(shingles=sets)

    wanted = members.select("first.file", "first.place", "cluster", "blocks", "cid", "n_shingles", "sketch")
    texts = rows.select("file", "place", F.col("row.text").alias("text")).join(wanted, ["file", "place"]).drop("file", "place")
    schema = "cluster long, blocks long, cid long, n_shingles long, sketch binary, shingles binary"
    sets = stage(texts.select("cluster", "blocks", "cid", "n_shingles", "sketch", "text").mapInPandas(with_sets, schema), "sets")
    discard(found)
    linked = components(_cluster_links(sets, percent, block), "linked")
    discard(sets)
    named = classes.select("cid", "digest", "copies", "first").join(linked, classes["cid"] == linked["node"], "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("first").alias("first"), F.count("*").alias("n"))
    answer = join_groups(named.drop("first"), least, "root", classes.count())
    answer = stage(answer.select("digest", "copies", F.col("first.doc_id").alias("component_id"), F.struct("first.file", "first.place").alias("first")), "answers")
    discard(classes, linked)
    return sketched.select("doc_id", "file", "place", "n_shingles", "digest"), answer


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES, stored: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    A row's set holds the distinct hashes (64 bits) of its ``words``-word shingles; with
    fewer words the whole sequence is one; a null, empty or blank text has none and is
    linked with nothing.  Rows are linked when 100 * shared >= ``percent`` * union.
    component_id is the smallest doc_id reachable; kept: it is the row's own.  Rows that
    repeat a doc_id each get a row; a null doc_id is never a component_id unless nothing
    else is there.  An empty table gives an empty result; other columns are ignored.
    ``stored``: ``docs`` is a Parquet table as it was read (see ``common.identified``).

    A pair at the threshold shares no band with probability 3e-6 and is dropped by a look
    with at most ``MISS``; both fall fast above it.  All other steps are exact.
    """
    rows, answer = _components_of(identified(docs, stored), words, percent, block, block_shingles)
    full = join_groups(rows.where("n_shingles > 0"), answer.select("digest", "component_id", F.col("copies").alias("n")), "digest", rows.count())
    every = full.select("doc_id", "n_shingles", "component_id").unionByName(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, stored: bool = False) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest doc_id.

    Of rows that repeat a doc_id one stays as well, the first by file and place.  Rows
    without words are linked with nothing and all stay.
    """
    held = identified(docs, stored)
    rows, answer = _components_of(held, words, percent, BLOCK, BLOCK_SHINGLES)
    kept = answer.select("first.*").distinct().unionByName(rows.where("n_shingles = 0").select("file", "place"))
    return held.join(kept, ["file", "place"], "left_semi").select("row.*")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=2, stored=True)
