"""Personal data replaced by format-preserving pseudonyms, with SQL functions only.

What a pattern finds is validated (check digits, calendar, ranges) and then permuted by a
keyed Feistel network inside the set of valid values of its format.  The permutation
depends on key and kind alone, so equal values stay linked across documents, and two
values never share a pseudonym.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
ROUNDS = 8
#: Dates are the LAST days from EPOCH, to 2099-12-31; 213 * 343 is the network's own domain.
EPOCH, LAST, DAYS = "1900-01-01", 73_049, (213, 343)

#: Country codes of telephone numbers have one, two or three digits, and none begins another.
COUNTRY_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
SECRET_NAME = r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[\x22']?\s{0,3}[=:]\s{0,3}[\x22']?"
#: Runs of these, joined by single dots, one of them of 8 or more after shorter ones; to its end, with = padding.
IN_SECRET = "[A-Za-z0-9+/_-]"
SECRET_VALUE = rf"(?=(?:{IN_SECRET}{{1,7}}\.)*+{IN_SECRET}{{8}}){IN_SECRET}++(?:\.{IN_SECRET}++)*+={{0,2}}+"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": SECRET_NAME + SECRET_VALUE,
    "ipv4": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])",
    "iso_date": r"(?<![0-9-])(?:19|20)\d\d-\d\d-\d\d(?![0-9-])|(?<![0-9./-])(?:19|20)\d\d(?:/\d\d/\d\d|\.\d\d\.\d\d)(?![0-9/-]|\.[0-9])",
    "date": r"(?<![0-9./])\d{1,2}([./])\d{1,2}\1(?:19|20)\d\d(?![0-9/])|(?<![0-9./-])\d{1,2}-\d{1,2}-(?:19|20)\d\d(?![0-9/-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9-])",
    "us_phone": r"(?<![0-9+])(?:\+1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![0-9])",
    "card": r"(?<![0-9])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![0-9])",
    "phone": r"(?<![0-9+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?![0-9])",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(digest: Column, start: Column | int, hexits: int) -> Column:
    return F.conv(F.substring(digest, start, hexits) if isinstance(start, int) else F.substr(digest, start, F.lit(hexits)), 16, 10).cast("long")


def permuted_number(left: Column, right: Column, sizes: tuple, key: str, kind: str | Column) -> Column:
    """A keyed permutation of pairs (left, right) below ``sizes`` (numbers or columns), as struct l, r."""
    below = [s if isinstance(s, Column) else F.lit(s).cast("long") for s in sizes]

    def draw(r: Column, side: str, other: Column) -> Column:
        named = kind if isinstance(kind, Column) else F.lit(kind)
        return _number(F.sha2(F.concat_ws("|", F.lit(key), named, r.cast("string"), F.lit(side), other.cast("string")).cast("binary"), 256), 1, 12)

    def step(pair: Column, r: Column) -> Column:
        new_left = F.pmod(pair["l"] + draw(r, "l", pair["r"]), below[0])
        return let(new_left, lambda x: F.struct(x.alias("l"), F.pmod(pair["r"] + draw(r, "r", x), below[1]).alias("r")))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS // 2)), start, step)


def _few(chars: Column, key: str, kind: Column) -> Column:
    """One or two characters, which leave a half of a network empty or tiny: a permutation of the numbers they stand for.

    The network's own domain is the next square; what falls outside is permuted again.
    """
    size = lambda i: F.coalesce(F.length(F.get(chars, F.lit(i))["al"]), F.lit(1)).cast("long")
    place = lambda i: F.coalesce(F.instr(F.get(chars, F.lit(i))["al"], F.get(chars, F.lit(i))["c"]) - 1, F.lit(0)).cast("long")
    letter = lambda i, at: F.coalesce(F.substr(F.get(chars, F.lit(i))["al"], at.cast("int") + 1, F.lit(1)), F.lit(""))
    domain = F.struct((size(0) * size(1)).alias("n"), F.ceil(F.sqrt(size(0) * size(1))).cast("long").alias("side"), size(1).alias("second"), (place(0) * size(1) + place(1)).alias("x"))

    def run(d: Column) -> Column:
        moved = lambda x: let(permuted_number(F.floor(x / d["side"]), x % d["side"], (d["side"], d["side"]), key, kind), lambda y: y["l"] * d["side"] + y["r"])
        walk = F.sequence(F.lit(0).cast("long"), d["side"] * d["side"] - d["n"])
        last = F.aggregate(walk, d["x"], lambda x, i: F.when((i > 0) & (x < d["n"]), x).otherwise(moved(x)))
        return let(last, lambda x: F.concat(letter(0, F.floor(x / d["second"])), letter(1, x % d["second"])))

    return let(domain, run)


def permuted_text(text: Column, alphabet: Callable[[Column, Column], Column], key: str, kind: str | Column, tweak: Column | None = None) -> Column:
    """A keyed permutation of strings: each character moves inside its own alphabet.

    ``alphabet`` gives it from the character and its place from 0; every character has to be
    in its own.  ``tweak`` is what else the permutation depends on.
    """
    named = F.concat_ws("|", kind if isinstance(kind, Column) else F.lit(kind), F.lit("") if tweak is None else tweak)
    chars = F.transform(F.split(text, ""), lambda c, i: F.struct(c.alias("c"), alphabet(c, i).alias("al")))

    def word(half: Column) -> Column:
        return F.array_join(F.transform(half, lambda x: x["c"]), "")

    def moved(half: Column, digests: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            by = _number(F.get(digests, F.floor(i / 32).cast("int")), 4 * (i % 32) + 1, 4)
            place = F.pmod(F.instr(x["al"], x["c"]) - 1 + by, F.length(x["al"])).cast("int") + 1
            return F.struct(F.substr(x["al"], place, F.lit(1)).alias("c"), x["al"].alias("al"))

        return F.transform(half, one)

    def step(halves: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), named, r.cast("string"), word(halves["b"])).cast("binary"), 512)
        # A digest moves 32 characters; each further 32 have one of their own.
        more = lambda d: F.transform(F.sequence(F.lit(0), F.floor((F.size(halves["a"]) - 1) / 32).cast("int")), lambda k: F.when(k == 0, d).otherwise(F.sha2(F.concat_ws("|", d, k.cast("string")).cast("binary"), 512)))
        own = lambda d: F.when(F.size(halves["a"]) > 32, more(d)).otherwise(F.array(d))
        return let(let(digest, own), lambda d: F.struct(halves["b"].alias("a"), moved(halves["a"], d).alias("b")))

    def run(all_chars: Column) -> Column:
        half = F.floor(F.size(all_chars) / 2).cast("int")
        start = F.struct(F.slice(all_chars, F.lit(1), half).alias("a"), F.slice(all_chars, half + 1, F.size(all_chars) - half).alias("b"))
        halves = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)
        return F.when(F.size(all_chars) < 3, _few(all_chars, key, named)).otherwise(let(halves, lambda h: F.concat(word(h["a"]), word(h["b"]))))

    return F.when(F.length(text) == 0, text).otherwise(let(chars, run))


def _letters(c: Column) -> Column:
    """The character's own kind: lower or upper case, else digit."""
    return F.when(c.rlike("^[a-z]$"), LOWER).when(c.rlike("^[A-Z]$"), UPPER).otherwise(DIGITS)


def _digits_of(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def respelled(text: Column, bare: Column, kept: str = "[A-Za-z0-9]") -> Column:
    """``text`` with its characters of ``kept`` replaced in turn by those of ``bare``; all between them stays."""
    pairs = F.zip_with(F.split(text, kept, -1), F.split(bare, ""), lambda gap, c: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(c, F.lit(""))))
    return F.array_join(pairs, "")


def luhn_digit(payload: Column) -> Column:
    """The check digit that follows a string of digits."""
    values = F.transform(
        F.split(F.reverse(payload), ""),
        lambda c, i: F.when(i % 2 == 1, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)),
    )
    return F.pmod(-F.aggregate(values, F.lit(0), lambda s, v: s + v), F.lit(10)).cast("string")


def iban_rest(country_and_check: Column, account: Column) -> Column:
    """The number's remainder by 97; letters count from A = 10."""
    chars = F.split(F.concat(account, country_and_check), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda s, c: F.pmod(s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def _card(m: Column, key: str) -> Column:
    """The number whatever its spelling; the last digit is the check."""
    digits = _digits_of(m)
    payload = F.substr(digits, F.lit(1), F.length(digits) - 1)
    whole = let(permuted_text(payload, lambda c, i: F.lit(DIGITS), key, "card"), lambda x: respelled(m, F.concat(x, luhn_digit(x)), "[0-9]"))
    return F.when(luhn_digit(payload) == F.right(digits, F.lit(1)), whole).otherwise(m)


def _iban(m: Column, key: str) -> Column:
    """The account whatever its spelling, within its country; the check is worked out again."""
    plain = _bare(m)
    country, account = F.substring(plain, 1, 2), F.substr(plain, F.lit(5), F.length(plain))
    check = lambda x: F.lpad((98 - iban_rest(F.concat(country, F.lit("00")), x)).cast("string"), 2, "0")
    whole = let(permuted_text(account, lambda c, i: _letters(c), key, "iban", country), lambda x: respelled(m, F.concat(country, check(x), x)))
    return F.when(iban_rest(F.substring(plain, 1, 4), account) == 1, whole).otherwise(m)


def _ipv4(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    at = lambda p, i: F.element_at(p, i)
    new = let(parts, lambda p: permuted_number(at(p, 1) * 256 + at(p, 2), at(p, 3) * 256 + at(p, 4), (65536, 65536), key, "ipv4"))
    high, low = lambda x: F.shiftright(x, 8), lambda x: x.bitwiseAND(F.lit(255).cast("long"))
    return let(new, lambda x: F.concat_ws(".", *[f(x[s]).cast("string") for s in "lr" for f in (high, low)]))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, *at).cast("int") for at in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    new = permuted_number(place * 99 + group - 1, serial - 1, (898 * 99, 9999), key, "ssn")

    def shown(x: Column) -> Column:
        a = F.floor(x["l"] / 99) + 1
        three = a + F.when(a > 665, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(three.cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

    return F.when(valid, let(new, shown)).otherwise(m)


def _day(day: Column, key: str) -> Column:
    """Another day from 1900-01-01 to 2099-12-31, whatever way the day was written.

    A day beyond them is permuted again: the network's domain has so few of them that their
    number bounds the walk.
    """
    moved = lambda n: let(permuted_number(F.floor(n / DAYS[1]), n % DAYS[1], DAYS, key, "date"), lambda x: x["l"] * DAYS[1] + x["r"])
    walk = F.sequence(F.lit(0), F.lit(DAYS[0] * DAYS[1] - LAST))
    n = F.datediff(day, F.lit(EPOCH).cast("date")).cast("long")
    last = F.aggregate(walk, n, lambda x, k: F.when((k > 0) & (x < LAST), x).otherwise(moved(x)))
    return let(last, lambda x: F.date_add(F.lit(EPOCH).cast("date"), x.cast("int")))


def _iso_date(m: Column, key: str) -> Column:
    day, mark = F.try_to_date(F.regexp_replace(m, "[./]", "-"), "yyyy-MM-dd"), F.substring(m, 5, 1)
    return F.when(day.isNotNull(), F.replace(F.date_format(_day(day, key), "yyyy-MM-dd"), F.lit("-"), mark)).otherwise(m)


def _date(m: Column, key: str) -> Column:
    """Day first if that is a date, else month first; without leading zeros if day or month has one digit, else with them."""
    mark = F.regexp_extract(m, r"([./-])", 1)
    parts = F.split(m, "[./-]")
    first, second, year = (F.element_at(parts, i) for i in (1, 2, 3))
    parse = lambda d, mo: F.try_to_date(F.concat_ws("-", year, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    width = F.least(F.length(first), F.length(second))
    wide = lambda value: F.lpad(value.cast("string"), F.greatest(width, F.length(value.cast("string"))), F.lit("0"))

    european, american = parse(first, second), parse(second, first)

    def write(x: Column) -> Column:
        day, month = wide(F.dayofmonth(x)), wide(F.month(x))
        one, two = F.when(european.isNotNull(), day).otherwise(month), F.when(european.isNotNull(), month).otherwise(day)
        return F.concat(one, mark, two, mark, F.year(x).cast("string"))

    return let(F.coalesce(european, american), lambda x: F.when(x.isNotNull(), let(_day(x, key), write)).otherwise(m))


def _us_digits(c: Column, i: Column) -> Column:
    """Area code and exchange don't begin with 0 or 1, or begin with one of these again."""
    return F.when(~i.isin(0, 3), DIGITS).when(c.isin("0", "1"), DIGITS[:2]).otherwise(DIGITS[2:])


def _us_phone(m: Column, key: str) -> Column:
    """The ten digits, whatever their spelling, with or without the country's 1."""
    skip = F.length(F.regexp_extract(m, r"^\+1[ .-]?", 0))
    rest = F.substr(m, skip + 1, F.length(m))
    return F.concat(F.substr(m, F.lit(1), skip), respelled(rest, permuted_text(_digits_of(rest), _us_digits, key, "us_phone"), "[0-9]"))


def _phone(m: Column, key: str) -> Column:
    """The digits after the country code, whatever their spelling; a US number gets the same as without its code."""
    digits = _digits_of(m)
    code = F.regexp_extract(digits, COUNTRY_CODE, 0)
    rest = F.substr(digits, F.length(code) + 1, F.length(digits))
    us = digits.rlike(r"^1\d{10}$")
    moved = permuted_text(rest, lambda c, i: F.when(us, _us_digits(c, i)).otherwise(DIGITS), key, F.when(us, "us_phone").otherwise("phone"), F.when(us, "").otherwise(code))
    return F.when(F.length(digits).between(8, 15), respelled(m, F.concat(code, moved), "[0-9]")).otherwise(m)


def _email(m: Column, key: str) -> Column:
    """Letters and digits of the local part; the domain (whatever its case) and other characters are what they depend on."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    tweak = F.concat_ws("@", F.regexp_replace(local, "[A-Za-z0-9]", "x"), F.lower(domain))
    return F.concat(respelled(local, permuted_text(_bare(local), lambda c, i: _letters(c), key, "email", tweak)), F.lit("@"), domain)


def _access_key(m: Column, key: str) -> Column:
    start = F.substring(m, 1, 4)
    return F.concat(start, permuted_text(F.substr(m, F.lit(5), F.length(m)), lambda c, i: F.lit(UPPER + DIGITS), key, "access_key", start))


def _secret(m: Column, key: str) -> Column:
    name = F.regexp_extract(m, "^" + SECRET_NAME, 0)
    value = F.substr(m, F.length(name) + 1, F.length(m))
    hexits = lambda x: x.rlike("^[0-9a-f]+$")
    move = lambda x: permuted_text(x, lambda c, i: F.when(hexits(value), HEX).otherwise(_letters(c)), key, "secret", F.when(hexits(value), "hex").otherwise(""))
    # Others don't become hexadecimal, so that they never meet one: permuted again while they are,
    # which 40 times in a row leave at most one in 1e25.
    done = lambda y: hexits(value) | ~hexits(y) | ~value.rlike("^[A-Za-z0-9]+$")
    moved = F.aggregate(F.sequence(F.lit(0), F.lit(40)), _bare(value), lambda y, k: F.when((k > 0) & done(y), y).otherwise(move(y)))
    return F.concat(name, respelled(value, moved))


PSEUDONYMS: dict[str, Callable[[Column, str], Column]] = {
    "email": _email,
    "access_key": _access_key,
    "secret": _secret,
    "ipv4": _ipv4,
    "iso_date": _iso_date,
    "date": _date,
    "iban": _iban,
    "ssn": _ssn,
    "us_phone": _us_phone,
    "card": _card,
    "phone": _phone,
}


#: All kinds; where several match at one place, the first.  The only capturing group is the date's mark.
ANY = "|".join(PATTERNS.values())
#: Kinds whose candidates can fail their check, and the patterns of all the others.
CHECKED = {failed: "|".join(p for kind, p in PATTERNS.items() if kind != failed) for failed in ("iso_date", "date", "iban", "ssn", "card", "phone")}


def pseudonym(m: Column, key: str) -> Column:
    """Of the first kind that ``m`` is and whose check it passes, else ``m``."""
    tried = []
    for kind, change in PSEUDONYMS.items():
        new = let(change(m, key), lambda x: F.when(x != m, x)) if kind in CHECKED else change(m, key)
        tried.append(F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), new))
    return F.coalesce(*tried, m)


def _scanned(text: Column, pattern: Column, key: str, inside: bool) -> Column:
    """struct text, n: what matches ``pattern`` changed; ``inside``: also the other kinds in what fails its check."""

    def place(m: Column, before: Column, after: Column) -> Column:
        whole = let(pseudonym(m, key), lambda x: F.struct(x.alias("text"), (x != m).cast("long").alias("n")))
        if not inside:
            return whole
        others = F.coalesce(*[F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(rest)) for kind, rest in CHECKED.items()])
        # Two characters at either side are what the patterns look at; what takes them in is left.
        left, right = F.right(before, F.lit(2)), F.left(after, F.lit(2))
        within = let(_scanned(F.concat(left, m, right), others, key, False), lambda x: F.when(
            x["text"].startswith(left) & x["text"].endswith(right) & (F.length(x["text"]) >= F.length(left) + F.length(right)),
            F.struct(F.substr(x["text"], F.length(left) + 1, F.length(x["text"]) - F.length(left) - F.length(right)).alias("text"), x["n"].alias("n")),
        ))
        return let(whole, lambda x: F.when((x["n"] == 0) & others.isNotNull(), F.coalesce(within, x)).otherwise(x))

    def put(gaps: Column, new: Column) -> Column:
        pieces = F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(F.get(new, i - 1)["text"], g)))
        return F.struct(F.array_join(pieces, "").alias("text"), F.aggregate(new, F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n"))

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    return let(F.split(text, pattern, -1), lambda gaps: let(F.transform(found, lambda m, i: place(m, F.get(gaps, i), F.get(gaps, i + 1))), lambda new: put(gaps, new)))


_built: dict[tuple[str, str, str], Column] = {}


def pseudonymised(text: str, key: str) -> Column:
    """struct text, n: the text of a column with pseudonyms, and how many places changed.

    Building the expression takes seconds, so it is kept as long as the driver's context lasts.
    """
    one = SparkContext.getOrCreate().applicationId, text, key
    if one not in _built:
        if len(_built) == 8:
            _built.clear()
        _built[one] = _scanned(F.col(text), F.lit(ANY), key, True)
    return _built[one]


def pseudonymise(docs: DataFrame, key: str = "plenarium") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and ``n_pseudonyms``: how many places changed.

    Emails, access keys, named secrets, IPv4 addresses, dates (1900 to 2099), IBANs, US
    social security and phone numbers, international phone numbers and card numbers are
    replaced; what looks like one of them but fails its check stays as it is, except for
    other kinds inside it.  Dates are yyyy-mm-dd, yyyy/mm/dd, yyyy.mm.dd and d.m.yyyy,
    d/m/yyyy, d-m-yyyy (or month first); dates with month names stay.  A date's pseudonym is
    a date of the same years in the same form, whichever that is; one whose day or month has
    a single digit is written without leading zeros again.  Card numbers, IBANs and phone
    numbers get the same pseudonym however they are spaced, a US number also with or without
    +1; case, spaces and marks stay as written.  An email keeps its domain.  A named
    secret is letters, digits and + / _ - of any length, inner dots and = padding included;
    it ends at any other character.  ``key`` has to be kept secret for production use.

    A null text stays null, with 0 places; texts without any of them, empty ones included,
    are unchanged; rows, their order in groups and all other columns stay.  An input column
    named ``n_pseudonyms`` is replaced.
    """
    done = F.when(F.col("text").rlike("[0-9@=:]|A[KS]IA"), pseudonymised("text", key)).otherwise(F.struct(F.col("text").alias("text"), F.lit(0).cast("long").alias("n")))
    names = [c for c in docs.columns if c.lower() != "n_pseudonyms"]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], done.alias("n_pseudonyms"))
    return rows.select(*[F.col("n_pseudonyms.text").alias("text") if c == "text" else F.col(f"`{c}`") for c in names], F.col("n_pseudonyms.n").alias("n_pseudonyms"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_pseudonyms")
