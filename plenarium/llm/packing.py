"""Documents packed into fixed windows by best-fit decreasing.

Tokenising cuts each document into full windows and one shorter rest; only the lengths
travel from there on.  Rests are dealt at random into groups of bounded size, and in each
group a segment tree over remaining capacities finds the tightest open window.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, discard, stage, table

WINDOW = 2048
END_ID = 1
#: Ids that leave a task at a time, a longer document's apart.
BATCH_BYTES = 4 << 20
#: Marks a document's first piece in the cache; texts that hold it take the general path.
FIRST = "\r"
_PLAIN_BREAK = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")
#: Texts whose white space isn't single spaces and line feeds between words alone.
_GENERAL = r"^$|^[ \n]|[ \n]$|[ \n][ \n]|[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Ids are strings in pandas, where a null would turn longs into doubles.
PIECES = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Words:
    """Different words and their ids, as columns."""

    def __init__(self, words: pa.Array | None = None, sizes: np.ndarray | None = None, ids: np.ndarray | None = None):
        self.words = pa.array([], pa.large_string()) if words is None else words
        self.sizes = np.empty(0, np.int64) if sizes is None else sizes
        self.ids = np.empty(0, "<u4") if ids is None else ids

    def __len__(self) -> int:
        return len(self.words)

    def __add__(self, other: Words) -> Words:
        return Words(pa.concat_arrays([self.words, other.words]), np.concatenate([self.sizes, other.sizes]), np.concatenate([self.ids, other.ids]))

    def find(self, words: pa.Array) -> np.ndarray:
        """Where each of ``words`` stands here, or -1."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False)

    def laid(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words one after another, and where each one's begin, with the end of all."""
        sizes = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        shift = (np.cumsum(self.sizes) - self.sizes)[at] - ends[:-1]
        return self.ids[np.repeat(shift, sizes) + np.arange(ends[-1])], ends

    def take(self, at: np.ndarray) -> Words:
        return Words(self.words.take(pa.array(at)), self.sizes[at], self.laid(at)[0])


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    The vocabulary's pre-tokeniser always breaks before a space or line feed that stands
    between other characters, so a text's ids are those of its words in turn, and each
    word is tokenised once while it is in the cache.  Words are split, told apart, looked up
    and put together as columns.  The cache has two generations; what the last one still
    uses outlives the change.
    """

    CACHED, LONGEST, SEGMENT, TOGETHER, AT_ONCE = 200_000, 200, 50_000, 1_000, 8_000_000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_truncation()
        self.young, self.old = Words(), Words()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.leads[[i for token, i in vocabulary.items() if token[0] in "ĠĊ"]] = True

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, words: pa.Array) -> Words:
        """Words as they stand in a text: after a space, or with their line feed or FIRST mark."""
        first = pc.starts_with(words, FIRST)
        inner, first = words.filter(pc.invert(first)), words.filter(first)
        sizes, ids = [np.empty(0, np.int64)], [np.empty(0, "<u4")]
        for at in range(0, len(inner), self.TOGETHER):
            some = inner[at : at + self.TOGETHER].to_numpy(zero_copy_only=False).tolist()
            together = self._ids(f" {' '.join(some)}".replace(" \n", "\n"))
            cuts = np.flatnonzero(self.leads[together])
            if len(cuts) == len(some):
                sizes.append(np.diff(cuts, append=len(together)))
                ids.append(together)
            else:
                apart = [self._ids(w if w.startswith("\n") else f" {w}") for w in some]
                sizes.append(np.array([len(x) for x in apart]))
                ids += apart
        encodings = self.tokenizer.encode_batch_fast([w[1:] for w in first.to_pylist()], add_special_tokens=False)
        sizes.append(np.array([len(e.ids) for e in encodings], np.int64))
        ids += [np.array(e.ids, dtype="<u4") for e in encodings]
        return Words(pa.concat_arrays([inner, first]), np.concatenate(sizes), np.concatenate(ids))

    def _any_text(self, text: str) -> bytes:
        """For texts with other white space; long ones in segments between two ASCII words."""
        out, at = [], 0
        while at < len(text):
            cut = _PLAIN_BREAK.search(text, at + self.SEGMENT)
            end = cut.start() if cut else len(text)
            out.append(self._ids(text[at:end]).tobytes())
            at = end
        return b"".join(out)

    def _known(self, words: pa.Array) -> tuple[Words, np.ndarray]:
        """Words with their ids, and where each of ``words``, which differ, stands among them."""
        at = self.young.find(words)
        missing = words.filter(pa.array(at < 0))
        back = self.old.find(missing)
        fresh = self.old.take(back[back >= 0]) + self._learn(missing.filter(pa.array(back < 0)))
        at = at.copy()
        at[at < 0] = len(self.young) + fresh.find(missing)
        known = self.young + fresh
        short = pc.less_equal(pc.utf8_length(known.words), self.LONGEST).to_numpy(zero_copy_only=False)
        self.young = known if short.all() else known.take(np.flatnonzero(short))
        if len(self.young) > self.CACHED:
            self.old, self.young = self.young, Words()
        return known, at

    def _by_words(self, texts: pa.Array) -> Iterator[bytes]:
        """For texts whose only white space is single spaces and line feeds between words."""
        first, nothing = pa.scalar(FIRST, texts.type), pa.scalar("", texts.type)
        split = pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(first, texts, nothing), "\n", " \n"), " ")
        coded = split.flatten().dictionary_encode()
        known, at = self._known(coded.dictionary)
        ids, ends = known.laid(at[coded.indices.to_numpy()])
        cuts = ends[split.offsets.to_numpy()].tolist()
        return (ids[i:j].tobytes() for i, j in zip(cuts, cuts[1:], strict=False))

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        column = pa.array(texts, pa.large_string())
        general = pc.match_substring_regex(column, _GENERAL)
        plain = self._by_words(column.filter(pc.invert(general)))
        return [self._any_text(t) if g else next(plain) for t, g in zip(texts, general.to_pylist(), strict=True)]

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, in order; about AT_ONCE characters are in work at a time."""
        some, size = [], 0
        for text in texts:
            some.append(text)
            size += len(text)
            if size >= self.AT_ONCE:
                yield from self._encode_some(some)
                some, size = [], 0
        yield from self._encode_some(some)

    def forget(self) -> None:
        """Drop the words; a worker's next task may be of another kind."""
        self.young, self.old = Words(), Words()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def document_ids(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, not null, and its ids as bytes, the end id last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end, words = END_ID.to_bytes(4, "little"), encoder(tokenizer)
        for batch in batches:
            for some in chunks(zip(batch["doc_id"], words.encode(batch["text"]), strict=True), lambda x: len(x[1]), BATCH_BYTES):
                yield pd.DataFrame({"doc_id": [i for i, _ in some], "ids": [ids + end for _, ids in some]})
        words.forget()

    return docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, ids binary")


def cut_documents(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """One row for each piece: full windows from the document's start, then its rest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end, step, words = END_ID.to_bytes(4, "little"), 4 * window, encoder(tokenizer)

        def rows(batch: pd.DataFrame) -> Iterator[tuple]:
            for doc_id, ids in zip(batch["doc_id"], words.encode(batch["text"]), strict=True):
                ids += end
                for at in range(0, len(ids), step):
                    part = ids[at : at + step]
                    yield doc_id, at // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4

        for batch in batches:
            for some in chunks(rows(batch), lambda _: 1, 50_000):
                yield pd.DataFrame(some, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        words.forget()

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, PIECES)


class TightestFit:
    """Open windows by remaining capacity: a segment tree that counts them."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, number: int, capacity: int) -> None:
        if capacity:
            self.windows[capacity].append(number)
            self._add(capacity, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The window with the least capacity of ``length`` or more."""
        count, node = self.count, length + self.leaves
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if count[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return self.windows[capacity].pop(), capacity


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The window and the offset of each piece, longest pieces placed first."""
    number = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    fit, opened = TightestFit(window), 0
    for at in np.argsort(-lengths, kind="stable"):
        length = int(lengths[at])
        found = fit.take(length)
        if found is None:
            found, opened = (opened, window), opened + 1
        number[at], offset[at] = found[0], window - found[1]
        fit.put(found[0], found[1] - length)
    return number, offset


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, group_rows: int = 20_000) -> DataFrame:
    """Every document's pieces with their sequence and offset.

    Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id (gapless from 0),
    offset.  Each id of a document, its end id included, lies in one piece; pieces of a
    sequence follow one another from offset 0 and take at most ``window`` ids.  A null or
    empty text is its end id alone; rows that repeat a doc_id are packed separately; a null
    doc_id stays null; an empty table gives an empty result; other columns are ignored.
    The same rows are packed the same way in every run.  ``write_sequences`` turns the result into token arrays.
    """
    pieces = stage(cut_documents(docs, tokenizer or default_tokenizer(), window), "pieces")
    groups = max(1, -(-pieces.count() // group_rows))
    # Dealt by content and, of equal pieces, by their number: the same documents are packed the
    # same way in every run, and equal rows spread like others.  Counts of a task come first,
    # so that numbering equal pieces never gathers them.
    names = PIECES.replace(",", "").split()[::2]
    counted = pieces.groupBy(*names, F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*names).orderBy("task"))
    numbered = counted.withColumn("upto", upto).select(*names, F.explode(F.sequence(F.col("upto") - F.col("n"), F.col("upto") - 1)).alias("copy"))
    dealt = numbered.withColumn("pack", F.pmod(F.xxhash64(*names, "copy"), F.lit(groups))).drop("copy")

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32", "doc_tokens"], ascending=[False, True, True, True, True], ignore_index=True)
        number, offset = best_fit_decreasing(rows["length"].to_numpy(), window)
        return rows.assign(number=number, offset=offset)

    placed = stage(dealt.groupBy("pack").applyInPandas(place, f"{PIECES}, pack long, number long, offset long"), "packs")
    discard(pieces)
    before = F.sum("n").over(Window.orderBy("pack").rowsBetween(Window.unboundedPreceding, -1))
    bases = placed.groupBy("pack").agg((F.max("number") + 1).alias("n")).select("pack", F.coalesce(before, F.lit(0)).alias("base"))
    return placed.join(bases, "pack").select(
        F.col("doc_id").cast("long").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("number")).alias("sequence_id"), "offset"
    )


def write_sequences(docs: DataFrame, packed: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Token arrays: sequence_id, ids, and the doc_ids and lengths of the pieces in order.

    ``doc_id`` has to be a key here, since a piece's ids are found by it.
    """
    ids = document_ids(docs, tokenizer or default_tokenizer())
    part = F.expr("substring(ids, cast(4 * start + 1 as int), cast(4 * length as int))")
    pieces = packed.join(ids, "doc_id").select("sequence_id", F.struct("offset", "doc_id", "length", part.alias("part")).alias("piece"))

    def numbers(parts: pd.Series) -> pd.Series:
        return pd.Series([np.frombuffer(b"".join(p), dtype="<u4").astype(np.int32) for p in parts])

    joined = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    return joined.select(
        "sequence_id",
        F.pandas_udf(numbers, "array<int>")("pieces.part").alias("ids"),
        F.col("pieces.doc_id").alias("doc_ids"),
        F.col("pieces.length").alias("lengths"),
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
