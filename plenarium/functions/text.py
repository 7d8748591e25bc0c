"""Text rules as column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity names and what they stand for.
ENTITIES = {
    "amp": "&", "nbsp": " ", "quot": '"', "apos": "'", "lsquo": "‘", "rsquo": "’", "ldquo": "“",
    "rdquo": "”", "ndash": "–", "mdash": "—", "hellip": "…", "lt": "<", "gt": ">",
}
# Words before a given name.
HONORIFICS = ["the", "hon", "hon.", "sen", "senator", "dr", "mr", "ms", "mrs", "mp"]
# State codes and names.
STATES = {
    "NSW": "New South Wales", "VIC": "Victoria", "QLD": "Queensland", "WA": "Western Australia",
    "SA": "South Australia", "TAS": "Tasmania", "ACT": "Australian Capital Territory", "NT": "Northern Territory",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeezed(text: Column) -> Column:
    """Runs of any Unicode white space as one space, none at the ends."""
    odd = lambda t: F.contains(t, F.lit("  ")) | t.rlike(r"(?U)[^\S ]")
    return let(text, lambda t: F.when(odd(t), F.regexp_replace(F.regexp_replace(t, r"(?U)\s+", " "), "^ | $", "")).otherwise(F.trim(t)))


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def slugify_ascii(text: Column) -> Column:
    """Slug of a text without letters beyond ASCII, inside the JVM."""
    joined = F.regexp_replace(F.regexp_replace(F.lower(text), "['’]", ""), "[^a-z0-9]+", "-")
    return F.regexp_replace(joined, "^-+|-+$", "")


@cache
def _folds() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition without combining accents makes of characters: one ASCII character or none, and more.

    Those that stay as they are, or become something that is no letter, digit or apostrophe,
    are left out, as a slug has a hyphen for both.
    """
    short, long = {}, {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if "\u0300" <= c <= "\u036f":
            short[c] = ""
        elif unicodedata.decomposition(c):
            made = re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", c))
            if len(made) < 2 and (made.isascii() or made == "’"):
                short[c] = made
            elif re.search("[A-Za-z0-9'’]", made):
                long[c] = made
    return short, long


def _folded(text: Column) -> Column:
    """Accents folded and compatibility forms spelled out, as far as slugs need it, inside the JVM."""
    short, long = _folds()
    table = F.str_to_map(F.lit("\n".join(f"{c}\t{made}" for c, made in long.items())), F.lit("\n"), F.lit("\t"))
    spelled = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    spelled = F.when(text.rlike(f"[{''.join(long)}]"), spelled).otherwise(text)
    gone = "".join(c for c, made in short.items() if not made)
    kept = {c: made for c, made in short.items() if made}
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(spelled, "".join(kept) + gone, "".join(kept.values()))).otherwise(text)


def slugify(text: Column) -> Column:
    """Lower-case ASCII words joined by hyphens; accents folded, apostrophes dropped."""
    return slugify_ascii(_folded(text))


def capitalised_after(text: Column, boundary: str) -> Column:
    """Lower case with a capital after each boundary; boundaries stay."""
    words = F.split(F.lower(text), f"(?<=[{boundary}])")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), "")


def title_case(text: Column) -> Column:
    """``O'BRIEN-SMITH`` as ``O'Brien-Smith``, ``MCCORMACK`` as ``McCormack``.

    Plain words without either need no pieces.
    """
    return F.when(text.rlike("^[A-Za-z ]*$") & ~text.rlike("(?i)mc"), F.initcap(text)).otherwise(_title_case(text))


def _title_case(text: Column) -> Column:
    parts = F.split(capitalised_after(text, r"\s\-'"), r"(?<=\bMc)(?=[a-z])")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i > 0, F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))).otherwise(p)), "")


def raiser_name(display: Column) -> Column:
    """``FAMILY, the Hon. Given Other`` as ``Given Family``."""
    parts = F.split(display, ",")
    family = capitalised_after(F.trim(F.get(parts, F.lit(0))), "\\s\\-'’")
    words = F.split(F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), r"\s+")
    bare = lambda w: F.regexp_replace(F.lower(w), r"\.$", "")
    given = F.get(F.filter(words, lambda w: ~bare(w).isin(HONORIFICS)), F.lit(0))
    return F.concat_ws(" ", non_empty(given), non_empty(family))


def replaced(text: Column, pattern: str, change: Callable[[Column], Column], mark: str = "") -> Column:
    """``text`` with each match of ``pattern`` changed; the text and its matches are found once.  Every match holds ``mark``."""

    def put(found: Column) -> Column:
        pieces = F.transform(found["gaps"], lambda gap, i: F.when(i == 0, gap).otherwise(F.concat(F.get(found["new"], i - 1), gap)))
        return F.array_join(pieces, "")

    def changed(value: Column) -> Column:
        new = F.transform(F.regexp_extract_all(value, F.lit(pattern), F.lit(0)), change)
        return F.when(F.contains(value, F.lit(mark)) & value.rlike(pattern), let(F.struct(F.split(value, pattern, -1).alias("gaps"), new.alias("new")), put)).otherwise(value)

    return let(text, changed)


def code_point(number: Column) -> Column:
    """The character of a code point; empty where there is none."""
    known = number.between(0, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    # Read as UTF-32 this one would be a byte order mark.
    char = F.when(number == 0xFEFF, "\ufeff").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
    return F.when(F.coalesce(known, F.lit(False)), char).otherwise("")


def _number_of(entity: Column) -> Column:
    """The code point of ``&#38;`` or ``&#x26;``, null beyond longs."""
    digits = F.regexp_extract(entity, "^&#([xX]?)([0-9a-fA-F]+);$", 2)
    return F.when(entity.rlike("^&#[xX]"), F.conv(F.when(F.length(F.ltrim(digits, F.lit("0"))) <= 8, digits), 16, 10).cast("bigint")).otherwise(digits.try_cast("bigint"))


def _named(entity: Column, any_case: bool, kept: tuple[str, ...] = ()) -> Column:
    """What a named entity stands for; itself where it is unknown or ``kept``."""
    table = F.create_map(*[F.lit(x) for name, value in ENTITIES.items() if name not in kept for x in (name, value)])
    name = F.regexp_extract(entity, "^&([A-Za-z]+);$", 1)
    return F.coalesce(F.try_element_at(table, F.lower(name) if any_case else name), entity)


def _decoded(html: Column, passes: Callable[[Column], Column]) -> Column:
    """Tags to spaces and white space collapsed; ``passes`` where there is an entity at all."""
    plain = lambda t: F.when(F.contains(t, F.lit("&")), passes(t)).otherwise(t)
    return squeezed(let(F.regexp_replace(html, "<[^>]*>", " "), plain))


def strip_html(html: Column) -> Column:
    """Tags to spaces, then decimal, hex and named entities (any case; unknown ones stay), white space collapsed."""

    def passes(text: Column) -> Column:
        text = replaced(text, "&#[0-9]+;", lambda e: code_point(_number_of(e)), "&#")
        text = replaced(text, "&#[xX][0-9a-fA-F]+;", lambda e: code_point(_number_of(e)), "&#")
        return replaced(text, "&[A-Za-z]+;", lambda e: _named(e, True), "&")

    return _decoded(html, passes)


def clean_profile_html(html: Column) -> Column:
    """As strip_html, but named entities come first and case counts, and &amp; is decoded last, so nothing is decoded twice."""

    def passes(text: Column) -> Column:
        text = replaced(text, "&[a-z]+;", lambda e: _named(e, False, ("amp",)))
        text = replaced(text, "&#(?:[0-9]+|[xX][0-9a-fA-F]+);", lambda e: code_point(_number_of(e)))
        return F.replace(text, F.lit("&amp;"), F.lit("&"))

    return _decoded(html, passes)


def attribution(html: Column) -> Column:
    """Tags out without a space; nothing left stands for the commons."""
    return F.coalesce(non_empty(F.trim(F.regexp_replace(html, "<[^>]*>", ""))), F.lit("Wikimedia Commons"))


def escape_html(text: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def escape_attribute(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def encode_component(text: Column) -> Column:
    """Percent-encoding that keeps ``- _ . ! ~ * ' ( )``."""
    out = F.url_encode(text)
    for coded, plain in (("+", "%20"), ("%21", "!"), ("%7E", "~"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(coded), F.lit(plain))
    return out


def decode_component(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def title_from_slug(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def event_description(event: Column) -> Column:
    return F.regexp_replace(event, r" \((House of Representatives|Senate)\)$", "")


def storage_key(division_id: Column) -> Column:
    return F.replace(division_id, F.lit("/"), F.lit("-"))


def division_key(date: Column, number: Column) -> Column:
    return F.concat(date, F.lit("-"), number.cast("string"))


def label_values(html: Column, label_tag: str = "dt", value_tag: str = "dd", clean: Callable[[Column], Column] = clean_profile_html) -> Column:
    """map of label to value from pairs of tags; the last of equal labels counts, blanks don't."""
    pattern = F.lit(rf"(?is)<{label_tag}[^>]*>(.*?)</{label_tag}>\s*<{value_tag}[^>]*>(.*?)</{value_tag}>")
    labels = F.transform(F.regexp_extract_all(html, pattern, F.lit(1)), lambda x: squeezed(F.lower(F.regexp_replace(clean(x), ":$", ""))))
    values = F.transform(F.regexp_extract_all(html, pattern, F.lit(2)), clean)
    pairs = F.filter(F.zip_with(labels, values, lambda k, v: F.struct(k.alias("key"), v.alias("value"))), lambda p: (p["key"] != "") & (p["value"] != ""))

    def last(found: Column) -> Column:
        keys = F.transform(found, lambda p: p["key"])
        # array_position counts from the end of the reversed keys: a key's last place.
        return let(keys, lambda k: F.map_from_entries(F.filter(found, lambda _, i: F.array_position(F.reverse(k), F.get(k, i)) == F.size(k) - i)))

    return let(pairs, last)


# Fixed value: how a bill summary begins.
SUMMARY_START = r"(?i)^Amends the:?\s*"
#: Fixed value: one or more act names, then what is done to them.
ACT_HEADING = (
    "^((?:[A-Z][A-Za-z0-9_'’()–\\- ]*?(?:Act|Code|Regulations?)(?: \\d{4})?)"
    "(?:,? and [A-Z][A-Za-z0-9_'’()–\\- ]*?(?:Act|Code|Regulations?)(?: \\d{4})?)*) to:?\\s*(.*)$"
)


def summary_parts(summary: Column) -> Column:
    parts = F.split(F.regexp_replace(summary, SUMMARY_START, ""), r";\s+")
    bare = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(F.trim(p), r"(?i)^and\s+", ""), r"\.$", ""))
    return F.filter(bare, lambda p: p != "")


def summary_groups(summary: Column) -> Column:
    """array of struct acts, items: a bill summary's items under the acts they amend.

    Null unless there are two acts at least and the first part names one.
    """
    parts = summary_parts(summary)
    heads = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, ACT_HEADING, 1).alias("acts"), F.when(p.rlike(ACT_HEADING), F.regexp_extract(p, ACT_HEADING, 2)).otherwise(p).alias("item")))

    def group(all_heads: Column) -> Column:
        def grouped(starts: Column) -> Column:
            def one(at: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(all_heads))
                items = F.transform(F.slice(all_heads, at + 1, end - at), lambda h: h["item"])
                return F.struct(F.get(all_heads, at)["acts"].alias("acts"), F.filter(items, lambda x, n: (n > 0) | (x != "")).alias("items"))

            fits = (F.size(starts) >= 2) & (F.get(starts, F.lit(0)) == 0)
            return F.when(fits, F.transform(starts, one))

        return let(F.filter(F.transform(all_heads, lambda h, i: F.when(h["acts"] != "", i)), lambda i: i.isNotNull()), grouped)

    return let(heads, group)


def summary_list(summary: Column) -> Column:
    """struct lead, items for a flat list of four parts or more; null otherwise.

    The lead is the first part up to its last colon, whose rest is the first item; without
    a colon the whole first part leads.
    """
    parts = F.filter(F.split(summary, r";\s+"), lambda x: F.trim(x) != "")
    plain = lambda x: F.regexp_replace(x, r"(?i)^and\s+", "")

    def listed(p: Column) -> Column:
        first = F.get(p, F.lit(0))
        lead = F.regexp_extract(first, "(?s)^(.+:) ", 1)
        own = F.when(lead != "", F.array(F.substr(first, F.length(lead) + 2, F.length(first)))).otherwise(F.array().cast("array<string>"))
        items = F.transform(F.concat(own, F.slice(p, F.lit(2), F.size(p))), plain)
        return F.when(F.size(p) >= 4, F.struct(F.when(lead != "", lead).otherwise(first).alias("lead"), items.alias("items")))

    return let(parts, listed)


# How occupations are written.
OCCUPATION_AT = r"^(.+?) (?:at|for|with) (?:the )?(.+?)(?: from (.+?))?(?: to (.+))?$"
OCCUPATION_OF = r"^(.+?) of (?:the )?(.+?)(?: from (.+?))?(?: to (.+))?$"
OCCUPATION_YEARS = "^(.*?),\\s*((?:1[89]|20)\\d{2})(?:\\s*[-–—]\\s*((?:1[89]|20)\\d{2}))?$"


def occupation(text: Column, dotted: Callable[[Column], Column]) -> Column:
    """struct role, org, period; null where the text doesn't follow the grammar."""
    bare = lambda x: F.trim(F.regexp_replace(F.trim(x), ",+$", ""))

    def read(plain: Column, pattern: str) -> Column:
        def placed(x: Column) -> Column:
            dated = (x["spoken"] == "") & x["org"].rlike(OCCUPATION_YEARS)
            year = lambda i: F.regexp_extract(x["org"], OCCUPATION_YEARS, i)
            period = F.when(dated, F.concat_ws(" – ", year(2), non_empty(year(3)))).otherwise(x["spoken"])
            place = F.when(dated, bare(year(1))).otherwise(x["org"])
            return let(F.struct(x["role"].alias("role"), place.alias("org"), period.alias("period")), lambda o: F.when(o["org"] != "", o))

        def grouped(g: Column) -> Column:
            spoken = F.when((g["from"] != "") & (g["to"] != ""), F.concat(dotted(g["from"]), F.lit(" – "), dotted(g["to"]))).when(g["from"] != "", F.concat(F.lit("from "), dotted(g["from"]))).otherwise("")
            return let(F.struct(F.trim(g["role"]).alias("role"), bare(g["org"]).alias("org"), spoken.alias("spoken")), placed)

        names = ("role", "org", "from", "to")
        return let(F.struct(*[F.regexp_extract(plain, pattern, i).alias(name) for i, name in enumerate(names, 1)]), grouped)

    return let(F.regexp_replace(F.trim(text), r"\.$", ""), lambda p: F.when(p.rlike(OCCUPATION_AT), read(p, OCCUPATION_AT)).when(p.rlike(OCCUPATION_OF), read(p, OCCUPATION_OF)))


def qualification(text: Column) -> Column:
    """struct qual, institution: cut at the last comma and space."""
    last = F.regexp_extract(text, r"(?s)^.*, (.*)$", 1)
    has = F.contains(text, F.lit(", "))
    qual = F.when(has, F.regexp_extract(text, r"(?s)^(.*), .*$", 1)).otherwise(text)
    return F.struct(qual.alias("qual"), F.when(has, last).otherwise("").alias("institution"))


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_slice(text: Column, units: int) -> Column:
    """The first ``units`` UTF-16 units; a pair that would be cut goes."""

    def cut(head: Column) -> Column:
        kept = F.aggregate(
            F.split(head, ""),
            F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars")),
            lambda s, c: let(s["n"] + utf16_length(c), lambda n: F.struct(n.alias("n"), (s["chars"] + F.when(n <= units, 1).otherwise(0)).alias("chars"))),
        )
        # A text of one byte a character has no pairs, and is told by its length.
        paired = (F.octet_length(head) > F.char_length(head)) & head.rlike(r"[\x{10000}-\x{10FFFF}]")
        return F.when(paired, F.substr(head, F.lit(1), kept["chars"])).otherwise(head)

    return let(F.substring(text, 1, units), cut)


def title_tier(title: Column) -> Column:
    size = utf16_length(title)
    return F.when(size <= 45, "l").when(size <= 90, "m").otherwise("s")


def initials(name: Column) -> Column:
    return F.array_join(F.transform(F.slice(F.split(F.trim(name), r"\s+"), 1, 2), lambda w: F.upper(F.substring(w, 1, 1))), "")


def website_label(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"^https?://(?:www\.)?", ""), "/$", "")


def last_segment(url: Column) -> Column:
    return F.substring_index(url, "/", -1)


def preferred_name(text: Column) -> Column:
    return F.trim(F.translate(text, "()", ""))


def search_text(*columns: Column) -> Column:
    """Lower-cased, with an empty slot for each null."""
    slots = [F.coalesce(c, F.lit("")) for c in columns]
    return F.lower(F.concat(*[x for i, c in enumerate(slots) for x in ((F.lit(" "), c) if i else (c,))]))


def state_code(name: Column) -> Column:
    """Code of a state's full name, whatever its case."""
    out = None
    for code, full in STATES.items():
        here = F.lower(F.trim(name)) == full.lower()
        out = F.when(here, code) if out is None else out.when(here, code)
    return out


def as_state(name: Column) -> Column:
    return F.coalesce(F.when(name.isin(list(STATES)), name), state_code(name))


def state_path(code: Column) -> Column:
    """A state's part of an address: its code in lower case, nothing for other texts."""
    return F.when(code.isin(list(STATES)), F.lower(code)).otherwise("")


def state_name(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def content_type(key: Column) -> Column:
    # Suffixes and media types.
    kinds = {"json": "application/json", "jsonl": "application/x-ndjson", "csv": "text/csv", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "xml": "application/xml"}
    table = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.substring_index(key, ".", -1)), F.lit("application/octet-stream"))


def natural_key(text: Column) -> Column:
    """array of struct kind, size, digits, word: digit runs by value, however long, and before words.

    Of numbers without leading zeros the longer one is larger, and of equally long ones the
    digits tell; nought has none.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    number = lambda t: F.when(t.rlike("^[0-9]"), F.regexp_replace(t, "^0+", "")).otherwise("")
    return F.transform(tokens, lambda t: F.struct(
        F.when(t.rlike("^[0-9]"), 0).otherwise(1).alias("kind"), F.length(number(t)).alias("size"), number(t).alias("digits"), F.when(t.rlike("^[0-9]"), "").otherwise(t).alias("word"),
    ))
