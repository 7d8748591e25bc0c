"""Scalar rules with known answers."""

import datetime
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from plenarium.functions import dates, numbers, rules, text


def values(spark, cases, rule, kind="string"):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, x {kind}")
    return [r[1] for r in sorted(rows.select("i", rule(F.col("x")).alias("y")).collect())]


@pytest.mark.parametrize(
    ("rule", "cases"),
    [
        (text.slugify, {"Zoë O’Neil-Brown": "zoe-oneil-brown", "  A & B  ": "a-b", "": "", "Ünder_score": "under-score"}),
        (text.title_case, {"O'BRIEN-SMITH": "O'Brien-Smith", "MICHAEL MCCORMACK": "Michael McCormack", "de groot": "De Groot"}),
        (text.raiser_name, {"GREENWOOD, the Hon. Dr Ada Mary": "Ada Greenwood", "O'DELL, Max, MP": "Max O'Dell", "SOLO": "Solo", "": ""}),
        (text.strip_html, {"<p>A&nbsp;&amp; B</p>": "A & B", "x&#8217;s &#x2013; &bogus; &#xD800;y": "x’s – &bogus; y", " a \n b ": "a b"}),
        (text.clean_profile_html, {"a &amp;ndash; b": "a &ndash; b", "a &ndash; &#233; &NBSP;": "a – é &NBSP;"}),
        (text.strip_html, {"<b>A</b>&NBSP;B &LT;x&gt; &other; &amp;amp;": "A B <x> &other; &amp;", "&#38;lt; &#X1F600;&#65279;. &#99999999999999999999;&#xFFFFFFFFFFF; &#0065;": "< 😀\ufeff. A", "no entity": "no entity", "": ""}),
        (text.clean_profile_html, {"&amp;#8217;": "&#8217;", "&#x26;lt;": "&lt;"}),
        (lambda c: text.utf16_slice(c, 4), {"abcdef": "abcd", "ab😀c": "ab😀", "abc😀": "abc", "😀😀😀": "😀😀", "": "", "ab": "ab"}),
        (text.state_path, {"NSW": "nsw", "Elsewhere": ""}),
        (text.attribution, {"<a>Jo</a>": "Jo", "<b></b> ": "Wikimedia Commons"}),
        (text.escape_html, {"<a href='x'>&\"": "&lt;a href=&#39;x&#39;&gt;&amp;&quot;"}),
        (text.encode_component, {"a b/ç(1)'~!*": "a%20b%2F%C3%A7(1)'~!*"}),
        (text.decode_component, {"a%20b+c": "a b+c", "%zz": "%zz"}),
        (text.title_from_slug, {"new-south-seat": "New South Seat"}),
        (text.event_description, {"Introduced (Senate)": "Introduced", "Read (Other)": "Read (Other)"}),
        (text.title_tier, {"a" * 45: "l", "a" * 46: "m", "😀" * 46: "s", "a" * 90: "m"}),
        (text.as_state, {"victoria": "VIC", "VIC": "VIC", "vic": None, "Tasmania": "TAS"}),
        (text.content_type, {"a/b.json": "application/json", "x.jpeg": "image/jpeg", "x": "application/octet-stream"}),
        (text.initials, {"ada b lovelace": "AB"}),
        (dates.dot_net_date, {"/Date(1764075600000+1100)/": "2025-11-26", "/Date(0)/": "1970-01-01", "x": None, "/Date(0-0030)/": "1969-12-31"}),
        (dates.clean_date, {"1900-01-01T00:00": None, " ": None, "2020-05-06T00:00:00": "2020-05-06"}),
        (dates.format_date, {"2025-05-03": "3 May 2025", "2025-02-31": "31 February 2025", "soon": "soon", "2025-13-01": "2025-13-01"}),
        (dates.dotted_date, {"29.8.2022": "29 August 2022", "2022": "2022"}),
        (dates.month_label, {"2025-05": "May 2025"}),
        (rules.status_bucket, {"Before Senate": "open", "Act": "act", "Assent": "act", "Lapsed": "other"}),
        (rules.procedure, {"X - Third Reading": "Third reading", "Motion to suspend the usual procedural rules": "Suspension of standing orders", "Message from the Senate": "Message between the chambers", "Y": None}),
    ],
)
def test_rule(spark, rule, cases):
    assert values(spark, list(cases), rule) == list(cases.values())


def test_numbers(spark):
    assert values(spark, ["", "x", "1,2", " 12 ", None], numbers.count_of) == [0, 0, 0, 12, 0]
    assert values(spark, [1.005, 2.675, 0.125], numbers.round2, "double") == [1.0, 2.68, 0.13]
    assert values(spark, [1.005, 0.5, -0.04, 2.5], numbers.to_fixed(0), "double") == ["1", "1", "-0", "3"]
    assert values(spark, [1.005, 1.25], numbers.to_fixed(1), "double") == ["1.0", "1.3"]
    assert values(spark, [52.0, 1.5, -2.0], numbers.signed, "double") == ["+52", "+1.5", "-2"]
    assert values(spark, [1234567], numbers.locale_int, "long") == ["1,234,567"]


def test_summaries(spark):
    grouped = "Amends the: Alpha Act 1999 to: do one; do two; and Beta Act 2001 to make three."
    rows = values(spark, [grouped, "Amends the: Alpha Act 1999 to: do one; do two", "plain; text", None], text.summary_groups)
    assert [(g["acts"], g["items"]) for g in rows[0]] == [("Alpha Act 1999", ["do one", "do two"]), ("Beta Act 2001", ["make three"])]
    assert rows[1:] == [None, None, None]
    flat = values(spark, ["To: a; b; c; and d", "a; b; c; d", "a; b"], text.summary_list)
    assert (flat[0]["lead"], flat[0]["items"]) == ("To:", ["a", "b", "c", "d"])
    assert (flat[1]["lead"], flat[1]["items"], flat[2]) == ("a", ["b", "c", "d"], None)


def test_occupations(spark):
    cases = ["Member of the Board at Example Co from 1.2.2003 to 4.5.2006.", "Clerk of Works, 2003–2007", "Farmer", "Adviser at Org, from 2001"]
    out = values(spark, cases, lambda x: text.occupation(x, dates.dotted_date))
    assert tuple(out[0]) == ("Member of the Board", "Example Co", "1 February 2003 – 4 May 2006")
    assert tuple(out[1]) == ("Clerk", "Works", "2003 – 2007")
    assert out[2] is None
    assert tuple(out[3]) == ("Adviser", "Org", "from 2001")
    assert tuple(values(spark, ["Dip, Arts, Uni X"], text.qualification)[0]) == ("Dip, Arts", "Uni X")


def test_label_values(spark):
    html = "<dl><dt>Area: </dt><dd>10 &amp; more</dd><dt>Name</dt><dd> </dd><dt>AREA</dt> <dd>20</dd></dl>"
    assert values(spark, [html], text.label_values) == [{"area": "20"}]


def test_natural_key(spark):
    rows = spark.createDataFrame([("a10",), ("a9",), ("9",), ("b",)], "u string")
    assert [r.u for r in rows.orderBy(text.natural_key(F.col("u"))).collect()] == ["9", "a9", "a10", "b"]
    long = ["a" + "0" * 70 + "b", "a1b", "a" + "0" * 30 + "9" * 59 + "c", "a1" + "0" * 59, "a1" + "0" * 58 + "1x", "a2" + "0" * 59, "a" + "1" * 61]
    rows = spark.createDataFrame([(x,) for x in reversed(long)], "u string")
    assert [r.u for r in rows.orderBy(text.natural_key(F.col("u"))).collect()] == long


def test_bill_stage(spark):
    cases = [(["Introduced"], "Before Reps", 1), (["x third reading"], "Before Senate", 2), (["Third Reading", "third reading"], "", 3), (["Royal Assent"], "", 4), ([], "Act", 4), (["Passed both houses"], "", 3), ([], "", 0)]
    rows = spark.createDataFrame(cases, "events array<string>, status string, want int")
    assert rows.where(rules.bill_stage(F.col("events"), F.col("status"), F.lit("representatives")) != F.col("want")).count() == 0


def test_as_of(spark):
    row = spark.sql("select '2020-01-01T00:00:00Z' as a, 'x' as b, timestamp '2021-01-01' as now")
    got = row.select(dates.age_days(F.col("a"), F.col("now")), dates.age_days(F.col("b"), F.col("now")), dates.service_years(F.col("a"), F.col("now"))).first()
    assert (got[0], got[1], got[2]) == (366.0, float("inf"), "1")
    assert datetime.date(2020, 1, 1).isoformat() == "2020-01-01"


def test_slug_of_every_character(spark):
    """Each character of Unicode between letters, against the rule in plain Python; no Python worker in the plan."""

    def plain(given):
        folded = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", given))
        # Lower case of single letters, as the other alphabets become hyphens anyway.
        return re.sub("[^a-z0-9]+", "-", re.sub("['’]", "", folded.lower())).strip("-")

    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = [".".join(f"{k:x}{c}Q" for k, c in enumerate(chars[i : i + 64])) for i in range(0, len(chars), 64)]
    texts += ["".join(chars[i : i + 64]) for i in range(0, 0x3000, 64)]
    rows = spark.createDataFrame([(x,) for x in texts], "given string").select("given", text.slugify(F.col("given")).alias("slug"))
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()
    assert [(r.given, r.slug) for r in rows.collect() if r.slug != plain(r.given)] == []


def test_stamps_without_offset_read_no_offset(spark):
    """An empty offset isn't read as a number, which would raise and catch an exception for each stamp."""
    rows = spark.createDataFrame([(1, "/Date(86399999)/"), (2, "/Date(82800000+0100)/"), (3, "/Date(86400000-0030)/"), (4, "/Date(x)/"), (5, ""), (6, None), (7, "/Date(99999999999999999999)/")], "i int, s string")
    found = rows.select("i", dates.dot_net_date(F.col("s")).alias("d"))
    assert dict(found.collect()) == {1: "1970-01-01", 2: "1970-01-02", 3: "1970-01-01", 4: None, 5: None, 6: None, 7: None}
    assert "try_cast(substring" not in found._jdf.queryExecution().analyzed().toString().lower()


def test_white_space_and_entities_cheaply(spark):
    texts = [" a ", "a b", "a  b", "a ", "’x", "", None, "&#8217;&#X41;&AMP;", "a & b", "a&#", "\ta"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", text.strip_html(F.col("s")).alias("s"))
    assert dict(rows.collect()) == dict(enumerate(["a", "a b", "a b", "a", "’x", "", None, "’A&", "a & b", "a&#", "a"]))
