"""CSV by its header's names, many tasks to a file, with line feeds inside quotes.

A byte range of a file doesn't know whether it begins inside a quoted value.  So every range
is first read for what it makes of either case, and whether a record ends in it: quotes are
followed line by line, both from outside and from inside.  These small functions, one for each
range, are put together in the files' order, which tells each range its own case.  Then all
ranges are parsed at once; a record that crosses ranges is put together from its pieces.
"""

from __future__ import annotations

import csv
import sys
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The place of a record that ends in a later range: after all others of its own.
LAST = 1 << 62


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a value is still quoted at the end of ``line``, which begins in one (``inside``) or with a record."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at)
            if at < 0:
                return True
            if line.startswith('""', at):
                at += 2
                continue
            # What follows the closing quote belongs to the value, up to the next comma.
            at = line.find(",", at + 1) + 1
            if not at:
                return False
            inside = False
        elif line.startswith('"', at):
            at, inside = at + 1, True
        else:
            at = line.find(',"', at) + 1
            if not at:
                return False


def records(text: list[str]) -> Iterator[list[str]]:
    """The records of whole lines."""
    csv.field_size_limit(sys.maxsize)
    return csv.reader(line + "\n" for line in text)


class _Range:
    """What is known of a range so far: its ends for either start, and whether a record ends if it starts inside."""

    def __init__(self, file: int, block: int, titled: bool):
        self.file, self.block, self.ends, self.closes = file, block, [False, True], False
        self.skip, self.head, self.header = titled and block == 0, [], None

    def add(self, lines: pa.Array) -> None:
        start = 0
        if self.block == 0 and self.header is None:
            start = self._read_header(lines)
        quoted = np.flatnonzero(pc.match_substring(lines, '"').to_numpy(zero_copy_only=False)) if len(lines) else []
        # Lines without quotes change nothing.
        for i in quoted:
            if i >= start:
                self.ends = [ends_inside(lines[int(i)].as_py(), e) for e in self.ends]
                self.closes |= not self.ends[1]

    def _read_header(self, lines: pa.Array) -> int:
        """Takes lines up to the header's end; how many that were."""
        for i, line in enumerate(lines.to_pylist()):
            line = line.removeprefix("\ufeff") if not self.head and i == 0 else line
            if self.skip:
                self.skip = False
                continue
            if not self.head and not line.strip("\r"):
                continue
            self.head.append(line)
            self.ends[0] = ends_inside(line, self.ends[0])
            if not self.ends[0]:
                self.header = next(records(self.head))
                return i + 1
        return len(lines)


class _Plan(NamedTuple):
    """For each range: whether it starts inside, and the range whose record it then continues; for each file its columns and place."""

    inside: dict[tuple[int, int], bool]
    group: dict[tuple[int, int], int]
    columns: dict[int, list[int]]
    place: dict[int, int]

    def row(self, file: int, block: int, line: int, record: list[str]) -> tuple:
        return self.place[file], block, line, None, [record[i] if i < len(record) else "" for i in self.columns[file]]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array]]:
    """A batch's lines by range."""
    file, block = (batch.column(c).to_numpy() for c in ("file", "block"))
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(block) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(file)], strict=True):
        if b > a:
            yield int(file[a]), int(block[a]), batch.column("value").slice(a, b - a)


def _scan(titled: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None
        done: list[_Range] = []
        for batch in batches:
            for file, block, lines in _runs(batch):
                if now is None or (now.file, now.block) != (file, block):
                    now = _Range(file, block, titled)
                    done.append(now)
                now.add(lines)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r.file for r in done], pa.int64()), pa.array([r.block for r in done], pa.int64()), *[pa.array([r.ends[i] for r in done], pa.bool_()) for i in (0, 1)],
             pa.array([r.closes for r in done], pa.bool_()), pa.array([r.header for r in done], pa.list_(pa.string()))],
            names=["file", "block", "from_out", "from_in", "closes", "header"],
        )

    return run


def _planned(ranges: list, columns: list[str], place: dict[int, int], name_of) -> _Plan:
    """Ranges put together in order; a column that a file's header doesn't have is an error."""
    plan, state, group = _Plan({}, {}, {}, place), False, 0
    for k, r in enumerate(ranges):
        key = r["file"], r["block"]
        if not k or ranges[k - 1]["file"] != r["file"]:
            state, group = False, r["block"]
            if r["header"] is not None:
                places = {name: i for i, name in enumerate(r["header"])}
                for c in columns:
                    if c not in places:
                        raise ValueError(f"{name_of(r['file'])} has no column {c!r}")
                plan.columns[r["file"]] = [places[c] for c in columns]
        plan.inside[key], plan.group[key] = state, group
        if not state or r["closes"]:
            # What is open at the end began here.
            group = r["block"]
        state = r["from_in"] if state else r["from_out"]
    return plan


class _Parse:
    """The lines of one range: whole records, and what belongs to records of other ranges."""

    def __init__(self, plan: _Plan, file: int, block: int, titled: bool, goes_on: bool):
        self.plan, self.file, self.block, self.goes_on = plan, file, block, goes_on
        self.tail = self.inside = plan.inside[file, block]
        self.first, self.title, self.header = block == 0, titled and block == 0, block == 0
        self.held: list[str] = []
        self.line = 0

    def add(self, text: list[str], pieces: bool) -> Iterator[tuple]:
        if self.first:
            text, self.first = [text[0].removeprefix("\ufeff"), *text[1:]], False
        if self.title:
            # It goes whatever it holds.
            text, self.title = text[1:], False
        at, whole = len(self.held), 0
        self.held += text
        for i in range(at, len(self.held)):
            if self.inside or '"' in self.held[i]:
                self.inside = ends_inside(self.held[i], self.inside)
            if not self.inside:
                whole = i + 1
                if self.tail:
                    if pieces:
                        yield self.file, self.plan.group[self.file, self.block], self.block, "\n".join(self.held[:whole]), None
                    self.held[:whole], self.tail = [""] * whole, False
        done, self.held = self.held[:whole], self.held[whole:]
        for record in [] if pieces else records(done):
            if self.header and record:
                self.header = False
            elif any(record):
                yield self.plan.row(self.file, self.block, self.line, record)
                self.line += 1

    def end(self, pieces: bool) -> Iterator[tuple]:
        """A piece of a record that goes on or began before, or, at a file's end, an open record."""
        if not self.held:
            return
        if pieces and (self.tail or self.goes_on):
            yield self.file, self.plan.group[self.file, self.block] if self.tail else self.block, self.block, "\n".join(self.held), None
        if not pieces and not self.tail and not self.goes_on:
            yield from (self.plan.row(self.file, self.block, LAST, r) for r in records(self.held) if any(r))


def _parsed(plan: _Plan, titled: bool, pieces: bool, opens: set[tuple[int, int]]):
    """Records of each range, or only the pieces of those that cross ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Parse | None = None
        for batch in batches:
            out: list[tuple] = []
            for file, block, lines in _runs(batch):
                if file not in plan.columns:
                    continue
                if now is None or (now.file, now.block) != (file, block):
                    out += now.end(pieces) if now else []
                    now = _Parse(plan, file, block, titled, (file, block) in opens)
                out += now.add(lines.to_pylist(), pieces)
            yield _rows(out)
        yield _rows(list(now.end(pieces)) if now else [])

    return run


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(5)], names=["file", "block", "line", "piece", "row"])


def header_csv(spark: SparkSession, path: str | list[str], columns: list[str], titled: bool = False) -> DataFrame:
    """ord and ``columns``, all strings, of every record of CSV files; ``titled``: a line precedes each file's header.

    Columns are found by their names in each file's own header, whatever their order; of a
    name that is there twice the last counts, and further ones are left out.  A column that a
    file doesn't have is an error that names both, before anything is parsed.  Short records
    are filled with '', what a record has beyond the header goes, and so do records without
    any value.  A byte order mark goes.  Line feeds end records, with or without a carriage
    return, except inside quotes; a doubled quote stands for one; a quote that stays open ends
    with its file, after a line feed.  ``ord`` (file, block, line) orders records as they are in their files,
    which are in order of their paths.  A file without a header has no records, and without
    any file the read is Spark's own error.

    Files are cut by ``spark.sql.files.maxPartitionBytes`` and read twice, once for quotes; the
    driver holds a few values for each range.  Ranges that a record crosses are read once more.
    """
    read = spark.read.option("lineSep", "\n").text(path)
    own = read.metadataColumn("_metadata")
    lines = read.select("value", _number(own["file_path"]).alias("file"), own["file_block_start"].alias("block"), own["file_path"].alias("path"))
    plain = lines.drop("path")
    ranges = plain.mapInArrow(_scan(titled), "file long, block long, from_out boolean, from_in boolean, closes boolean, header array<string>").collect()
    ranges.sort(key=lambda r: (r["file"], r["block"]))
    plan = _planned(ranges, columns, _places(spark, read.inputFiles()), lambda file: lines.where(F.col("file") == file).select("path").first()[0])
    opens = {(a["file"], a["block"]) for a, b in zip(ranges, ranges[1:], strict=False) if a["file"] == b["file"] and plan.inside[b["file"], b["block"]]}
    kind = "file long, block long, line long, piece string, row array<string>"
    rows = plain.mapInArrow(_parsed(plan, titled, False, opens), kind)
    if opens:
        crossed = opens | {key for key, inside in plan.inside.items() if inside}
        concerned = plain.where(F.struct("file", "block").isin([F.struct(F.lit(f).cast("long"), F.lit(b).cast("long")) for f, b in sorted(crossed)]))
        # block: where the record began, line: the range of the piece.
        pieces = concerned.mapInArrow(_parsed(plan, titled, True, opens), kind).groupBy("file", "block")
        joined = pieces.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "piece"))), lambda p: p["piece"]), "\n").alias("piece"))

        def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for file, block, text in zip(*(batch.column(c).to_pylist() for c in ("file", "block", "piece")), strict=True):
                    out += [plan.row(file, block, LAST, r) for r in records(text.split("\n")) if any(r)]
                yield _rows(out)

        rows = rows.unionByName(joined.mapInArrow(put, kind))
    return rows.select(F.struct("file", "block", "line").alias("ord"), *[F.col("row")[i].alias(c) for i, c in enumerate(columns)])


def _number(path: Column) -> Column:
    """A file's number; file:/x and file:///x are one path."""
    return F.xxhash64(F.regexp_replace(path, "^([A-Za-z0-9]+):/+", "$1:/"))


def _places(spark: SparkSession, paths: list[str]) -> dict[int, int]:
    """The places of files in the order of their paths, by the number that rows know them by."""
    named = [(i, form) for i, p in enumerate(sorted(paths)) for form in {p, unquote(p)}]
    return {r["h"]: r["i"] for r in spark.createDataFrame(named, "i int, p string").select("i", _number(F.col("p")).alias("h")).collect()} if named else {}
