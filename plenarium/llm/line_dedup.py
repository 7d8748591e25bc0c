"""Repeated passages removed by content-defined chunks and windows of lines.

A rolling hash over each line and the one before it decides where a chunk ends, so the
same passage is cut the same way wherever it stands.  Chunks that occur more than once
anywhere are compared byte by byte, and all but the first are removed.

The edges of a passage share their chunks with what stands beside it, and a passage may be
one line.  So the shortest windows of lines with enough words that begin, and those that
end, at each line are pieces too: they cover exactly the lines of the maximal repeated runs
with as many words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, discard, identified, release, stage, table
from .graph import join_groups

#: A chunk has about so many lines.
MEAN_LINES = 3
#: A repeated run of lines goes whole if it has so many words.
RUN_WORDS = 50
#: Stands for a null doc_id, before all others.
NO_ID = -(1 << 63)
#: Bytes of pieces that leave a task at a time.
BATCH_BYTES = 4 << 20
_STEP = 0x9E3779B97F4A7C15


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def chunk_hash(chunk: str) -> int:
    return int.from_bytes(hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=8, person=b"chunk").digest(), "little", signed=True)


def cut(text: str, mean_lines: int = MEAN_LINES) -> list[tuple[str, bool]]:
    """The text's chunks in order, and whether each may be removed.

    Joined by line feeds they give the text again.  A chunk may be removed if it has two
    lines that aren't blank.
    """
    out: list[tuple[str, bool]] = []
    held: list[str] = []
    before = 0

    def close() -> None:
        if held:
            out.append(("\n".join(held), sum(bool(x.strip()) for x in held) > 1))
            held.clear()

    for line in text.split("\n"):
        held.append(line)
        own = line_hash(line)
        rolled = ((before * _STEP) ^ own) & 0xFFFFFFFFFFFFFFFF
        before = own
        if (rolled * _STEP >> 40) % mean_lines == 0:
            close()
    close()
    return out


def windows(lines: list[str], run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """First and last line of the shortest windows of ``run_words`` words from, and up to, each line.

    A window neither begins nor ends with a blank line.  Whether lines are a window depends
    on them alone, so equal lines are one wherever they stand; and every run of as many
    words between lines that aren't blank is the union of windows.
    """
    words = [(i, n) for i, line in enumerate(lines) if (n := len(line.split()))]
    out = set()

    def sweep(ordered: list[tuple[int, int]]) -> None:
        end = total = 0
        for line, n in ordered:
            while end < len(ordered) and total < run_words:
                total += ordered[end][1]
                end += 1
            if total < run_words:
                return
            last = ordered[end - 1][0]
            out.add((min(line, last), max(line, last)))
            total -= n

    sweep(words)
    sweep(words[::-1])
    return sorted(out)


def pieces(text: str, mean_lines: int, run_words: int | None) -> tuple[list[str], list[tuple[int, int, int]]]:
    """The text's lines; first line, line after the last, and hash of each piece that may be removed."""
    lines, out, start = text.split("\n"), [], 0
    for chunk, removable in cut(text, mean_lines):
        end = start + chunk.count("\n") + 1
        if removable:
            out.append((start, end, chunk_hash(chunk)))
        start = end
    if run_words is not None and (found := windows(lines, run_words)):
        own = b"".join(line_hash(line).to_bytes(8, "little") for line in lines)
        for first, last in found:
            digest = hashlib.blake2b(own[8 * first : 8 * last + 8], digest_size=8, person=b"window").digest()
            out.append((first, last + 1, int.from_bytes(digest, "little", signed=True)))
    return lines, out


def remove_repeats(docs: DataFrame, mean_lines: int = MEAN_LINES, stored: bool = False) -> DataFrame:
    """``docs`` with ``text`` cleaned of repeated chunks, and n_chunks_removed and n_chars_removed.

    Of equal chunks, the one with the smallest doc_id and place stays; later ones go, in
    the same document too.  A document all of whose chunks go has an empty text; a null
    text stays null.  A null doc_id comes first; rows that share a doc_id, or have none,
    come in the order of their file and place there, and each counts as a document.  An
    empty table gives an empty result; other columns stay, and input columns named as the
    two new ones are replaced.  ``stored``: ``docs`` is a Parquet table as it was read.
    """
    return _cleaned(docs, mean_lines, None, stored)


def remove_passages(docs: DataFrame, mean_lines: int = MEAN_LINES, run_words: int = RUN_WORDS, stored: bool = False) -> DataFrame:
    """As ``remove_repeats``, and every repeated run of lines with ``run_words`` words goes whole.

    A run is one or more neighbouring lines that stand in the same order and with the same
    bytes at an earlier place (doc_id, then line), taken as far as they agree; blank lines
    at its ends are not part of it.  Both places may overlap in one document.  Of every
    removed line an equal one stays at an earlier place.  n_chunks_removed counts the
    chunks that lost lines.
    """
    return _cleaned(docs, mean_lines, run_words, stored)


def _cleaned(docs: DataFrame, mean_lines: int, run_words: int | None, stored: bool) -> DataFrame:
    names = [c for c in docs.columns if c.lower() not in ("n_chunks_removed", "n_chars_removed")]
    held = identified(docs.select(*[F.col(f"`{c}`") for c in names]), stored)
    key = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NO_ID)).alias("doc")
    texts = held.where("row.text is not null").select("file", "place", key, F.col("row.text").alias("text"))

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (
                (file, place, h)
                for file, place, text in zip(batch["file"], batch["place"], batch["text"], strict=True)
                for _, _, h in pieces(text, mean_lines, run_words)[1]
            )
            for some in chunks(rows, lambda _: 1, 100_000):
                yield pd.DataFrame(some, columns=["file", "place", "hash"], dtype="int64")

    found = stage(texts.mapInPandas(hashes, "file long, place long, hash long"), "chunks")
    total = found.count()
    # Rows of a hash that very many share stay where they are.
    repeated = found.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1")
    # Staged, so that the plan that moves the texts has no broadcast, which would keep its files.
    wanted = stage(join_groups(found, repeated, "hash", total).groupBy("file", "place").agg(F.collect_set("hash").alias("hashes")), "wanted")

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for some in chunks(_repeated_pieces(batch), lambda x: len(x[1]), BATCH_BYTES):
                yield pd.DataFrame(some, columns=["hash", "chunk", "doc", "file", "place", "line"])

    def _repeated_pieces(batch: pd.DataFrame) -> Iterator[tuple]:
        for file, place, doc, text, wanted_hashes in zip(batch["file"], batch["place"], batch["doc"], batch["text"], batch["hashes"], strict=True):
            known = set(wanted_hashes)
            lines, all_pieces = pieces(text, mean_lines, run_words)
            for start, end, h in all_pieces:
                if h in known:
                    yield h, "\n".join(lines[start:end]), doc, file, place, start

    bytes_of = texts.join(wanted, ["file", "place"]).mapInPandas(contents, "hash long, chunk string, doc long, file long, place long, line long")
    # Grouped by the content itself: pieces of one hash that differ form several groups.
    same = bytes_of.groupBy("hash", "chunk").agg(F.min(F.struct("doc", "file", "place", "line")).alias("first"), F.count("*").alias("n"))
    contents_of = F.count("*").over(Window.partitionBy("hash"))
    one = F.struct("first.file", "first.place", "first.line", F.when(F.col("contents") > 1, F.col("chunk")).alias("chunk"))
    firsts = stage(same.withColumn("contents", contents_of).where("n > 1").groupBy("hash").agg(F.collect_list(one).alias("firsts"), F.sum("n").alias("n")), "firsts")
    # The first pass has moved the texts once; its files go before they move again.
    discard(wanted)
    del bytes_of, same, wanted, repeated
    release(docs.sparkSession)
    decided = join_groups(found, firsts, "hash", total).groupBy("file", "place").agg(F.collect_set(F.struct("hash", "firsts")).alias("repeats"))
    decided = stage(decided, "decided")
    discard(found, firsts)

    @F.pandas_udf("text string, chunks long, chars long")
    def clean(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for documents, files, places, repeats in batches:
            rows = []
            for text, file, place, known in zip(documents, files, places, repeats, strict=True):
                if text is None or known is None:
                    rows.append((text, 0, 0))
                    continue
                by_hash = {r["hash"]: r["firsts"] for r in known}
                lines, all_pieces = pieces(text, mean_lines, run_words)
                gone: set[int] = set()
                for start, end, h in all_pieces:
                    for r in by_hash.get(h, ()):
                        if r["chunk"] is None or r["chunk"] == "\n".join(lines[start:end]):
                            if (r["file"], r["place"], r["line"]) != (file, place, start):
                                gone.update(range(start, end))
                            break
                removed = start = 0
                for chunk, _ in cut(text, mean_lines) if gone else ():
                    end = start + chunk.count("\n") + 1
                    removed += not gone.isdisjoint(range(start, end))
                    start = end
                left = "\n".join(line for i, line in enumerate(lines) if i not in gone)
                rows.append((left, removed, len(text) - len(left)))
            yield pd.DataFrame(rows, columns=["text", "chunks", "chars"])

    joined = held.join(decided, ["file", "place"], "left").select("row", clean(F.col("row.text"), F.col("file"), F.col("place"), F.col("repeats")).alias("new"))
    columns = [F.col("new.text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names]
    return joined.select(*columns, F.col("new.chunks").alias("n_chunks_removed"), F.col("new.chars").alias("n_chars_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents"), stored=True).select("doc_id", "text", "n_chunks_removed", "n_chars_removed")
