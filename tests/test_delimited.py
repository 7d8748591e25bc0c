"""CSV by header names, cut into ranges, against Python's own reader."""

import csv
import io
import random

import pytest

from plenarium.sources import files
from plenarium.sources.delimited import ends_inside, header_csv


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few lines, several to a task."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def put(folder, name, text):
    (folder / name).write_bytes(text.encode())
    return str(folder / name)


def plain(text, columns, titled=False):
    """The same rows by Python's csv over the whole text."""
    text = text.removeprefix("\ufeff")
    rows = [r for r in csv.reader(io.StringIO(text.partition("\n")[2] if titled else text, newline="")) if r]
    places = {name: i for i, name in enumerate(rows[0])} if rows else {}
    return [tuple(r[places[c]] if places[c] < len(r) else "" for c in columns) for r in rows[1:] if any(r)]


def read(spark, path, columns, titled=False):
    return [tuple(r) for r in header_csv(spark, path, columns, titled).orderBy("ord").select(*columns).collect()]


def drawn(rng, records):
    """Values with quotes, commas and line feeds, long ones over several ranges, short, blank and long records."""
    kinds = ["plain", "", "a,b", 'say ""x""', "two\nlines", "three\n\r\nlines,\n", "\n" * 5, "much " * 60, "deep\n" * 80, "é" * 30]
    lines = []
    for _ in range(records):
        values = [rng.choice(kinds) for _ in range(rng.choice([0, 1, 2, 3, 3, 3, 4]))]
        lines.append(",".join(f'"{v}"' if rng.random() < 0.3 or set(v) & set('",\n') else v for v in values))
    return lines


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_ranges_against_the_whole(spark, small_ranges, tmp_path, seed, end):
    rng = random.Random(seed)
    text = ("\ufeff" if seed % 2 else "") + end.join(['"B",A,"C\nc"', *drawn(rng, 60)]) + end * (seed % 3)
    path = put(tmp_path, "t.csv", text)
    assert spark.read.option("lineSep", "\n").text(path).rdd.getNumPartitions() > 20
    columns = ["A", "C\nc", "B"]
    assert read(spark, path, columns) == plain(text, columns)


def test_titles_files_and_columns(spark, small_ranges, tmp_path):
    """Each file by its own header; further columns go, the last of two names counts; a title may hold anything."""
    texts = {
        "a.csv": 'A "title, made today\nB,A\n1,2\n,\n3\n',
        "b c%.csv": 'Other\n\nA,X,A,B\n9,8,"7\n7",6,5\n1,2,3,"open, to the end\nof it',
        "c.csv": "",
        "d.csv": "only a title",
        "e.csv": "title\nA,B\n",
    }
    for name, text in texts.items():
        put(tmp_path, name, text)
    assert read(spark, str(tmp_path), ["A", "B"], True) == [("2", "1"), ("", "3"), ("7\n7", "6"), ("3", "open, to the end\nof it\n")]
    rows = files.titled_csv(spark, str(tmp_path), ["B"])
    assert rows.columns == ["ord", "B"] and rows.count() == 4
    with pytest.raises(ValueError, match="[ae].csv has no column 'X'"):
        header_csv(spark, str(tmp_path), ["A", "X"], True)


def test_order_of_columns(spark, tmp_path):
    path = put(tmp_path, "p.csv", "B,A\n1,2\n,\n")
    assert [tuple(r) for r in files.plain_csv(spark, path, ["A", "B"]).collect()] == [("2", "1")]


def test_quotes_inside_unquoted_values(spark, small_ranges, tmp_path):
    text = "A,B\n" + '5" pipe,6" pipe\n"x" y,"a ""b"" c"d\n' * 40
    path = put(tmp_path, "q.csv", text)
    assert read(spark, path, ["B", "A"]) == plain(text, ["B", "A"])
    for line in ['5" pipe,x', '"a" "b', '"a"",', '"",""', 'x,"', '"a","b', '"', '""', ""]:
        opened = next(csv.reader(io.StringIO(line + "\n|", newline="")), [""])
        assert ends_inside(line, False) == (bool(opened) and opened[-1].endswith("\n|")), line
    assert ends_inside('a"",b', True) and not ends_inside('a",b', True) and ends_inside('a","b', True) and ends_inside("", True)


def test_no_single_task_and_no_window(spark, small_ranges, tmp_path):
    path = put(tmp_path, "n.csv", "A,B\n" + "1,2\n" * 500)
    rows = header_csv(spark, path, ["A", "B"])
    assert rows.rdd.getNumPartitions() > 4 and "Window" not in rows._jdf.queryExecution().toString() and rows.count() == 500
