"""Rule tables of the domain: bill stages and statuses, procedures, roles, chambers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

# Procedures in the order in which they are tried.
PROCEDURES = [
    (r"(?i)rearrangement", "Rearrangement"),
    (r"(?i)suspen(?:sion of|d) standing (?:and sessional )?orders|standing (?:and sessional )?orders be suspended|suspend the usual(?: procedural)? rules", "Suspension of standing orders"),
    (r"(?i)be now put", "Closure"),
    (r"(?i)no longer be heard|be no longer heard", "Member no longer heard"),
    (r"(?i)debate be adjourned|adjournment", "Adjournment"),
    (r"(?i)consideration in detail", "Consideration in detail"),
    (r"(?i)in committee|committee of the whole", "Committee of the whole"),
    (r"(?i)first reading", "First reading"),
    (r"(?i)second reading", "Second reading"),
    (r"(?i)third reading", "Third reading"),
    (r"(?i)production of documents|order for the production", "Order for the production of documents"),
    (r"(?i)disallow", "Disallowance"),
    (r"(?i)censure", "Censure"),
    (r"(?i)federation chamber", "Federation Chamber referral"),
    (r"(?i)senate message|message from the senate|senate amendments|house of representatives message", "Message between the chambers"),
]
# Fixed value: roles that count as leadership.
LEADERSHIP = r"(?i)prime minister|^leader|^deputy leader|^manager of (government|opposition) business|whip|president of the senate|^speaker|^deputy speaker"
# Fixed value: licences under which a photo may be kept.
FREE_LICENCE = r"(?i)^(cc0|cc.by(.sa)?.\d|public domain|pd|no restrictions|attribution)"


def first_match(name: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first pattern that matches; null for none."""
    out = None
    for pattern, label in rules:
        here = name.rlike(pattern)
        out = F.when(here, label) if out is None else out.when(here, label)
    return out


def procedure(name: Column) -> Column:
    return first_match(name, PROCEDURES)


def status_bucket(status: Column) -> Column:
    return F.when(F.startswith(status, F.lit("Before")), "open").when(status.isin("Act", "Assent"), "act").otherwise("other")


def status_chamber(status: Column) -> Column:
    low = F.lower(status)
    return F.when(F.contains(low, F.lit("senate")), "senate").when(low.rlike("house|representatives|reps"), "representatives")


def bill_stage(events: Column, status: Column, chamber: Column) -> Column:
    """0 to 4 from a bill's events in order, its status and its own chamber."""
    def kind(e: Column) -> Column:
        return F.when(F.contains(e, F.lit("assent")), "assent").when(F.contains(e, F.lit("passed both houses")), "both").when(F.contains(e, F.lit("third reading")), "third").when(e.rlike("introduced|first reading"), "first").otherwise("")

    said = F.lower(status)
    elsewhere = F.coalesce(status_chamber(status) != chamber, F.lit(False))
    by_status = F.when(F.contains(said, F.lit("assent")) | F.startswith(said, F.lit("act")), 4).when(F.startswith(said, F.lit("before ")), F.when(elsewhere, 2).otherwise(1)).otherwise(0)

    def stage(kinds: Column) -> Column:
        has = lambda k: F.array_contains(kinds, k)
        thirds = F.size(F.array_remove(kinds, "third"))
        by_third = F.least(F.size(kinds) - thirds, F.lit(2))
        by_events = F.greatest(F.when(has("first"), 1).otherwise(0), F.when(by_third > 0, by_third + 1).otherwise(0), F.when(has("both"), 3).otherwise(0))
        return F.when(has("assent"), 4).otherwise(F.greatest(by_events, by_status))

    return text.let(F.transform(events, lambda e: text.let(F.lower(e), kind)), stage)


def chamber_of(name: Column) -> Column:
    return F.when(F.lower(name) == "senate", "senate").otherwise("representatives")


def seat_descriptor(house: Column, state: Column, electorate: Column) -> Column:
    return F.when(house == "senate", F.concat(F.lit("Senator for "), state)).otherwise(F.concat(F.lit("Member for "), electorate))


# Elections by id, those held in single seats, and the one that defines the seats.
EVENTS = {
    "31633": "2026 Farrer by-election", "31496": "2025 federal election", "29807": "2024 Cook by-election", "29778": "2024 Dunkley by-election",
    "29422": "2023 Fadden by-election", "28791": "2023 Aston by-election", "27966": "2022 federal election", "24310": "2019 federal election",
}
BY_ELECTIONS = ["31633", "29807", "29778", "29422", "28791", "25881", "25820"]
SEAT_EVENT = "31496"


def event_name(event: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in EVENTS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, event), F.concat(F.lit("AEC event "), event))
