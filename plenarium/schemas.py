"""Schemas of the entities, field order as exported."""

from __future__ import annotations

PERSON_IDS = "struct<wikidata: string, tvfy: bigint, aph: string, aecCandidate: bigint>"
PHOTO = "struct<commonsFile: string, url: string, licence: string, attribution: string, thumb: string, thumbLarge: string>"
POSITION = "struct<role: string, ministry: string, kind: string, `from`: string, `to`: string>"
BACKGROUND = "struct<born: string, birthplace: string, occupations: array<string>, qualifications: array<string>, honours: array<string>, serviceStart: string, parliaments: array<bigint>>"
CONTEST = "struct<event: string, eventName: string, electorateSlug: string, electorateName: string, party: string, votes: bigint, pct: double, swing: double, elected: boolean>"
AI_TEXT = "struct<text: string, model: string, generatedAt: string>"
STATS = "struct<divisionsEligible: bigint, divisionsVoted: bigint, againstGroupMajority: bigint>"
CANDIDATE = "struct<name: string, party: string, partyCode: string, votes: bigint, pct: double, swing: double, elected: boolean>"
RAISER = "struct<name: string, phid: string, slug: string>"

PERSON = (
    "slug string, name string, house string, state string, electorate string, `group` string, groupSlug string, since string, "
    f"ids {PERSON_IDS}, photo {PHOTO}, links struct<wikipedia: string, aph: string, website: string>, aiNote {AI_TEXT}, background {BACKGROUND}, "
    f"positions array<{POSITION}>, elections array<{CONTEST}>, stats {STATS}"
)
PARTY = "slug string, name string, code string, colour string, seats struct<representatives: bigint, senate: bigint>, facts struct<founded: string, website: string, wikipedia: string>"
PROFILE = "struct<nameDerivation: string, location: string, area: string, gazetted: string, firstContested: string, demographic: string>"
ELECTORATE = f"slug string, name string, state string, memberSlug string, profile {PROFILE}, enrolment bigint"
DIVISION = (
    "id string, house string, date string, number bigint, name string, summary string, summaryKind string, "
    f"aiSummary {AI_TEXT}, result string, ayes bigint, noes bigint, billIds array<string>, links struct<hansard: string, tvfy: string>, "
    "votes array<struct<personSlug: string, vote: string, teller: boolean, againstGroupMajority: boolean>>"
)
BILL = (
    "id string, title string, parliament bigint, chamber string, type string, sponsor string, portfolio string, summary string, "
    f"aiSummary {AI_TEXT}, status string, timeline array<struct<date: string, event: string>>, links struct<aph: string, text: string, em: string, parlinfo: string>, "
    f"listUpdated string, sponsors array<{RAISER}>, movers array<{RAISER}>, divisionIds array<string>"
)
ELECTION = f"eventId string, eventName string, electorateSlug string, electorateName string, state string, firstPrefs array<{CANDIDATE}>, tcp array<{CANDIDATE}>"
HANDBOOK = f"slug string, phid string, storedAt string, background {BACKGROUND}, positions array<{POSITION}>"
MANIFEST = "source string, lastSync string, ok boolean, note string"

ENTITIES = {"people": PERSON, "parties": PARTY, "electorates": ELECTORATE, "divisions": DIVISION, "bills": BILL, "elections": ELECTION}
