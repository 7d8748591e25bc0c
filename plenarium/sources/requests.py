"""Requests as rows: built from data, dealt to hosts and lanes, spaced without a coordinator, answered as rows.

A host takes one request an ``interval``.  Its requests are dealt to lanes, each a part of
some task, and lane l of n may send only at the l-th of every n intervals since the epoch of
the clock.  So no two requests to a host are closer than its interval, whichever tasks run
when, as long as their machines' clocks agree; a lane that comes late waits for its next turn.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import encode_component

#: What a transport gives for (url, body, seconds until it gives up): status and body.
Transport = Callable[[str, str | None, float], tuple[int, str]]
# Attempts, seconds to wait after the n-th refusal or failure, times n, and a request's time limit.
ATTEMPTS, REFUSED_WAIT, FAILED_WAIT, TIMEOUT = 4, 20.0, 2.0, 120.0
ANSWERS = "id string, host string, attempt int, status int, answer string, error string, at double"


def next_turn(now: float, interval: float, lane: int, lanes: int) -> float:
    """The first moment from ``now`` on at which the lane may send."""
    whole = interval * lanes
    turn = (now // whole) * whole + lane * interval
    return turn if turn >= now else turn + whole


class _Lane:
    def __init__(self, lane: int, lanes: int, interval: float, budget: int, transport: Transport, clock, sleep):
        self.lane, self.lanes, self.interval, self.left = lane, lanes, interval, budget
        self.transport, self.clock, self.sleep, self.last = transport, clock, sleep, -1.0

    def _turn(self) -> None:
        if not self.interval:
            return
        # A turn is used once, however soon the answer came.
        at = next_turn(max(self.clock(), self.last + self.interval / 2), self.interval, self.lane, self.lanes)
        while (early := at - self.clock()) > 0:
            self.sleep(early)
        self.last = at

    def ask(self, id_: str, host: str, url: str, body: str | None) -> Iterator[tuple]:
        """A row for each attempt; 429, 5xx and what the transport raises are tried again, other errors aren't."""
        for attempt in range(1, ATTEMPTS + 1):
            if not self.left:
                yield id_, host, attempt, None, None, "budget", self.clock()
                return
            self._turn()
            self.left -= 1
            at = self.clock()
            try:
                status, answer = self.transport(url, body, TIMEOUT)
                error = None if status < 400 else f"status {status}"
            except Exception as raised:  # noqa: BLE001 - every failure is an answer's error
                status, answer, error = None, None, f"{type(raised).__name__}: {raised}"
            yield id_, host, attempt, status, answer if error is None else None, error, at
            if error is None or status is not None and status != 429 and status < 500 or attempt == ATTEMPTS:
                return
            self.sleep(attempt * (REFUSED_WAIT if status == 429 else FAILED_WAIT))


def answered(requests: DataFrame, transport: Transport, interval: float = 1.0, budget: int = 500, lanes: int = 4, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """A row for each attempt of each request, failed ones too: id, host, attempt, status, answer, error, at.

    ``requests``: id, host, url, body.  A host gets at most ``budget`` requests, attempts
    counted, which its lanes share; what is beyond it has the error ``budget`` and no status,
    and no attempt was made.  The result makes its requests each time it is computed, so write
    it once; ``unanswered`` tells what is left for the next run.
    """
    dealt = requests.select("id", "host", "url", F.col("body").cast("string").alias("body"), F.pmod(F.xxhash64("id"), F.lit(lanes)).cast("int").alias("lane"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[tuple[str, int], _Lane] = {}
        for batch in batches:
            for id_, host, url, body, lane in batch[["id", "host", "url", "body", "lane"]].itertuples(index=False):
                if (host, lane) not in open_:
                    open_[host, lane] = _Lane(lane, lanes, interval, budget // lanes + (lane < budget % lanes), transport, clock, sleep)
                rows = list(open_[host, lane].ask(id_, host, url, body))
                # One by one: what has been answered leaves the task.
                yield pd.DataFrame(rows, columns=["id", "host", "attempt", "status", "answer", "error", "at"]).astype({"attempt": "int32", "status": "Int32"})

    return dealt.repartition("host", "lane").sortWithinPartitions("host", "lane", "id").mapInPandas(run, ANSWERS)


def answers(attempts: DataFrame) -> DataFrame:
    """id, answer of the requests that were answered."""
    return attempts.where("error is null").select("id", "answer")


def unanswered(requests: DataFrame, attempts: DataFrame) -> DataFrame:
    """Requests without an answer so far, whatever came of them: those for the next run."""
    return requests.join(answers(attempts).select("id"), "id", "left_anti")


def quoted(value: Column) -> Column:
    """Text inside the quotes of an OData condition."""
    return F.replace(value, F.lit("'"), F.lit("''"))


def odata_requests(rows: DataFrame, base: str, path: str, key: str) -> DataFrame:
    """A request for the records of each ``key`` that isn't empty."""
    condition = F.concat(F.lit("PHID eq '"), quoted(F.col(key)), F.lit("'"))
    url = F.concat(F.lit(f"{base}/{path}?$filter="), encode_component(condition))
    some = rows.where(F.col(key) != "").select(key).distinct()
    return some.select(F.concat(F.lit(f"{path}/"), key).alias("id"), F.lit(base.split("/")[2]).alias("host"), url.alias("url"), F.lit(None).cast("string").alias("body"))


# The kinds of item that are a party, and the properties of founding and website.
PARTY_KINDS, FOUNDED, WEBSITE = ("wd:Q7278", "wd:Q124964", "wd:Q1140229"), "wdt:P571", "wdt:P856"


def party_requests(groups: DataFrame, base: str, size: int = 50) -> DataFrame:
    """Requests for founding date, website and article of groups (slug, name), ``size`` names each."""
    from ..operators.ordering import batches

    # A quote can't stand in a label, nor can a backslash or a line's end.
    label = F.concat(F.lit('"'), F.regexp_replace("name", '["\\\\\\\\\\n\\r]', ""), F.lit('"@en'))
    lists = batches(groups.select("name").distinct(), size, "name").groupBy("batch").agg(F.array_join(F.array_sort(F.collect_list(label)), " ").alias("labels"))
    text = F.concat(
        F.lit("SELECT ?label ?inception ?website ?article WHERE { VALUES ?label { "), "labels", F.lit(" } ?item rdfs:label ?label ; wdt:P31 ?kind . "),
        F.lit(f"FILTER(?kind IN ({', '.join(PARTY_KINDS)})) OPTIONAL {{ ?item {FOUNDED} ?inception . }} OPTIONAL {{ ?item {WEBSITE} ?website . }} "),
        F.lit("OPTIONAL { ?article schema:about ?item ; schema:isPartOf <https://en.wikipedia.org/> . } }"),
    )
    url = F.concat(F.lit(f"{base}?query="), encode_component(text))
    return lists.select(F.concat(F.lit("parties/"), F.col("batch").cast("string")).alias("id"), F.lit(base.split("/")[2]).alias("host"), url.alias("url"), F.lit(None).cast("string").alias("body"))
