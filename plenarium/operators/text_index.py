"""A full-text index: positional posting lists in blocks of pages, phrase and ranked queries.

A task cuts its pages into blocks and turns each into posting lists, one row for each word:
the pages that hold it, how often, and where, as differences of positions.  So a frequent
word is as many rows as there are blocks, and no task ever holds one word's whole list.
Queries work block by block; a ranked one takes blocks in the order of the best score that
they allow, and leaves out those that can't reach the best pages of the first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

#: Pages and words of a block at most; a page of more words is a block of its own.
PAGES, WORDS = 2048, 1 << 20
WORD = r"[\p{L}\p{N}]+"
#: A page's tf counts as tf / (tf + SOFTEN), so that the tenth place of a word adds less than the first.
SOFTEN = 1.2
#: Rows of a word and a number or two that are sent to all tasks at most.
SENT = 200_000
#: Phrases that a block is searched for in one task, about.
PHRASES = 10_000


def words_of(body: Column) -> Column:
    """Runs of letters and digits, in lower case, in order."""
    return F.regexp_extract_all(F.lower(body), F.lit(WORD), F.lit(0))


def _cuts(sizes: np.ndarray, pages: int, words: int) -> list[tuple[int, int]]:
    """Runs of pages that make a block."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start == pages or held + n > words):
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(sizes))] if len(sizes) else []


def _block(keys: pa.Array, words: pa.ListArray) -> list[pa.Array]:
    """word, block, keys, tfs, places of some pages: sorted by word, then page, then position."""
    sizes = np.diff(words.offsets.to_numpy())
    coded = words.flatten().dictionary_encode()
    by_name = pc.sort_indices(coded.dictionary)
    code = np.argsort(by_name.to_numpy())[coded.indices.to_numpy(zero_copy_only=False)]
    page = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.argsort(code, kind="stable")
    code, page, place = code[order], page[order], place[order]
    word_starts = np.flatnonzero(np.diff(code, prepend=-1))
    in_page = np.flatnonzero((np.diff(code, prepend=-1) != 0) | (np.diff(page, prepend=-1) != 0))
    steps = np.diff(place, prepend=0)
    steps[in_page] = place[in_page]
    tfs = np.diff(in_page, append=len(code))
    of_word = np.append(np.searchsorted(in_page, word_starts), len(in_page)).astype(np.int32)
    name = str(keys[0])
    return [
        coded.dictionary.take(by_name).take(pa.array(code[word_starts])), pa.array([name] * len(word_starts), pa.string()),
        pa.ListArray.from_arrays(of_word, keys.take(pa.array(page[in_page]))), pa.ListArray.from_arrays(of_word, pa.array(tfs.astype(np.int32))),
        pa.ListArray.from_arrays(np.append(word_starts, len(code)).astype(np.int32), pa.array(steps.astype(np.int32))),
    ]


def postings(pages: DataFrame, key: str, body: str, most_pages: int = PAGES, most_words: int = WORDS) -> DataFrame:
    """word, block, keys, tfs, places: the index of ``pages``.

    ``keys`` are the block's pages that hold the word, ``tfs`` how often each does, ``places``
    the positions (words from 0) of all of them in turn, each page's first as it is and the
    others as differences.  Pages without a key, text or word aren't in it; ``key`` has to be
    unique.  A block is known by its first page's key.
    """
    return listed(pages.where(F.col(body).isNotNull()).select(F.col(key).alias("key"), words_of(F.col(body)).alias("words")), most_pages, most_words)


def listed(rows: DataFrame, most_pages: int = PAGES, most_words: int = WORDS) -> DataFrame:
    """The index of rows of key and words; see ``postings``."""
    kind = rows.schema["key"].dataType.simpleString()
    rows = rows.where(F.col("key").isNotNull() & (F.size("words") > 0))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column("words").offsets.to_numpy())
            for start, end in _cuts(sizes, most_pages, most_words):
                part = batch.slice(start, end - start)
                whole = pa.concat_arrays([part.column("words")])
                yield pa.RecordBatch.from_arrays(_block(pa.concat_arrays([part.column("key")]), _plain(whole)), names=["word", "block", "keys", "tfs", "places"])

    return rows.mapInArrow(build, f"word string, block string, keys array<{kind}>, tfs array<int>, places array<int>")


def _plain(lists: pa.ListArray) -> pa.ListArray:
    """Lists whose offsets begin at nought."""
    offsets = lists.offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), lists.flatten())


def write_index(index: DataFrame, path: str, ranged: bool = True) -> None:
    """Files of the index.

    ``ranged``: dealt into ranges of word and block and sorted by them, for an index that is
    read often, so that a query reads little beside its words; a frequent word has many files.
    Else each task writes its blocks one after another, each sorted by word, which moves
    nothing and holds one block at a time.
    """
    if ranged:
        index = index.repartitionByRange("word", "block").sortWithinPartitions("word", "block")
    index.write.mode("overwrite").parquet(path)


def word_counts(index: DataFrame) -> DataFrame:
    """word, pages, places: how many pages hold each word, and how often."""
    return index.groupBy("word").agg(F.sum(F.size("keys").cast("long")).alias("pages"), F.sum(F.size("places").cast("long")).alias("places"))


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """The lists' sizes and all their values."""
    return np.diff(lists.offsets.to_numpy()), lists.flatten()


def _spots(lists: pa.Table) -> tuple[pa.Array, dict[str, np.ndarray]]:
    """A block's pages, and for each word its places in order: the page's number, then 32 bits of the position."""
    (sizes, keys), (_, tfs), (_, steps) = (_flat(pa.concat_arrays(lists.column(c).chunks)) for c in ("keys", "tfs", "places"))
    pages = keys.dictionary_encode()
    tf, sums = tfs.to_numpy(zero_copy_only=False), np.cumsum(steps.to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(tf)])
    # Positions begin anew with each page, where sums don't.
    at = sums - np.repeat(np.concatenate([[0], sums])[ends[:-1]], tf)
    spots = (np.repeat(pages.indices.to_numpy(zero_copy_only=False).astype(np.int64), tf) << 32) | at
    of_word = ends[np.concatenate([[0], np.cumsum(sizes)])]
    return pages.dictionary, {w: np.sort(spots[i:j]) for w, i, j in zip(lists.column("word").to_pylist(), of_word, of_word[1:], strict=False)}


def _starts(words: list[str], spots: dict[str, np.ndarray]) -> np.ndarray:
    """Where all of ``words`` stand one after another, from the rarest one's places."""
    if any(w not in spots for w in words):
        return np.empty(0, np.int64)
    rare = min(range(len(words)), key=lambda i: len(spots[words[i]]))
    starts = spots[words[rare]] - rare
    for i, w in enumerate(words):
        if i != rare and len(starts):
            near = np.searchsorted(spots[w], starts + i)
            starts = starts[np.take(spots[w], near, mode="clip") == starts + i]
    # A start before its page's first word lies where the page before it has no word, so the first word has ruled it out.
    return starts


def sent(words: DataFrame) -> DataFrame:
    """What is asked for, by broadcast if it has SENT rows at most; else an index is dealt by word to meet it."""
    return F.broadcast(words) if words.limit(SENT + 1).count() <= SENT else words


def phrase_hits(index: DataFrame, phrases: DataFrame, at_once: int = PHRASES) -> DataFrame:
    """phrase, key, n: how often each of ``phrases`` (phrase, text) stands in each page that holds it, overlaps counted.

    A phrase is its text's words one after another, whatever stands between them; one without
    words is found nowhere.  ``phrase`` has to be unique.  Only blocks that hold all of a
    phrase's words are opened.  Lists go to their block once for each ``at_once`` phrases that
    ask for their word, however many phrases these are and however many pages hold the word;
    a task holds one block's lists.
    """
    asked = phrases.select("phrase", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    parts = max(1, -(-asked.count() // at_once))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("words"), F.lit(parts)))
    each = asked.select("part", "phrase", "words", F.explode(F.array_distinct("words")).alias("word"))
    # Blocks by word first, without their lists.
    held = index.select("word", "block").join(sent(each), "word").groupBy("part", "block", "phrase", "words").agg(F.count("*").alias("n"))
    whole = held.where(F.col("n") == F.size(F.array_distinct("words"))).drop("n")
    needed = whole.select("part", "block", F.explode("words").alias("word")).distinct()
    lists = index.join(sent(each.select("word", "part").distinct()), "word").join(sent(needed), ["part", "block", "word"], "left_semi")

    def found(lists: pa.Table, asked: pa.Table) -> pa.Table:
        # Without lists or phrases nothing is found.
        pages, spots = _spots(lists) if lists.num_rows else (pa.array([], lists.schema.field("keys").type.value_type), {})
        hits = [np.empty((3, 0), np.int64)]
        for row, words in enumerate(asked.column("words").to_pylist()):
            page, n = np.unique(_starts(words, spots) >> 32, return_counts=True)
            hits.append(np.stack([np.full(len(page), row), page, n]))
        row, page, n = np.concatenate(hits, axis=1)
        return pa.Table.from_arrays([asked.column("phrase").take(pa.array(row)), pages.take(pa.array(page)), pa.array(n)], names=["phrase", "key", "n"])

    kinds = StructType([StructField("phrase", phrases.schema["phrase"].dataType), StructField("key", index.schema["keys"].dataType.elementType), StructField("n", LongType())])
    # Named anew, as both sides stem from the index.
    lists = lists.select(F.col("part").alias("of_part"), F.col("block").alias("of_block"), "word", "keys", "tfs", "places")
    return lists.groupBy("of_part", "of_block").cogroup(whole.groupBy("part", "block")).applyInArrow(found, kinds)


def ranked(index: DataFrame, queries: DataFrame, pages: int, k: int = 10, first: int = 4) -> DataFrame:
    """query, rank (from 1), key, score: the ``k`` best pages for each of ``queries`` (query, text), ties to the smaller key.

    A page's score sums ln(1 + (N - df + 0.5) / (df + 0.5)) * tf / (tf + SOFTEN) over the
    query's different words, N being ``pages``.  The ``first`` blocks of the highest bounds
    are scored, and then those whose bound reaches the ``k``-th best score found there.
    """
    asked = queries.select("query", F.explode(F.array_distinct(words_of(F.col("text")))).alias("word"))
    df = index.join(sent(asked.select("word").distinct()), "word").groupBy("word").agg(F.sum(F.size("keys").cast("long")).alias("df"))
    idf = F.log1p((F.lit(pages) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = sent(asked.join(df, "word").select("query", "word", idf.alias("idf")))
    soft = lambda tf: tf / (tf + SOFTEN)
    listed = index.select("word", "block", "keys", "tfs").join(weights, "word")
    bounds = index.select("word", "block", F.array_max("tfs").alias("most")).join(weights, "word").groupBy("query", "block").agg(F.sum(F.col("idf") * soft(F.col("most"))).alias("bound"))
    bounds = bounds.withColumn("nth", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block")))

    def scored(blocks: DataFrame) -> DataFrame:
        one = listed.join(blocks.select("query", "block"), ["query", "block"]).select("query", "idf", "word", F.explode(F.arrays_zip("keys", "tfs")).alias("p"))
        # Terms in one order, so that equal pages have equal sums.
        terms = one.groupBy("query", F.col("p.keys").alias("key")).agg(F.array_sort(F.collect_list(F.struct("word", (F.col("idf") * soft(F.col("p.tfs"))).alias("term")))).alias("terms"))
        return terms.select("query", "key", F.aggregate("terms", F.lit(0.0), lambda s, t: s + t["term"]).alias("score"))

    nth = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "key"))
    best = scored(bounds.where(F.col("nth") <= first)).withColumn("rank", nth).where(F.col("rank") <= k)
    floors = best.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    # A bound is summed in another order than a score.
    rest = bounds.where(F.col("nth") > first).join(floors, "query", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-9))
    every = best.drop("rank").unionByName(scored(rest))
    return every.withColumn("rank", nth).where(F.col("rank") <= k).select("query", "rank", "key", "score")
