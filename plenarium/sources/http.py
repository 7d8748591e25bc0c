"""A fetcher for the driver: spacing, retries, agents and request budgets round a given transport.

Tasks don't fetch by it; where pages are partitions, each reader has a fetcher of its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import quote, urlsplit

from ..streaming.incremental import Budget

#: What a transport gives for (url, headers): status and body.
Transport = Callable[[str, dict[str, str]], tuple[int, str]]
# Attempts, and seconds to wait after the n-th refusal or failure, times n.
ATTEMPTS, REFUSED_WAIT, FAILED_WAIT = 4, 20.0, 2.0


@dataclass
class Fetcher:
    """``get(url)`` waits ``interval`` seconds between requests to one host and retries what may pass.

    429 and 5xx are tried again up to ATTEMPTS times, waiting longer each time; other errors
    are raised at once.  A 403 is tried once more with ``other_agent``, which then stays.
    """

    transport: Transport
    interval: float = 1.0
    headers: dict[str, str] = field(default_factory=dict)
    other_agent: str | None = None
    budget: Budget | None = None
    sleep: Callable[[float], None] = time.sleep
    clock: Callable[[], float] = time.monotonic
    _last: dict[str, float] = field(default_factory=dict)

    def _once(self, url: str, headers: dict[str, str]) -> tuple[int, str]:
        host = urlsplit(url).netloc
        early = self._last.get(host, float("-inf")) + self.interval - self.clock()
        if early > 0:
            self.sleep(early)
        self._last[host] = self.clock()
        if self.budget:
            self.budget.spend()
        return self.transport(url, headers)

    def get(self, url: str, **headers: str) -> str:
        """The body of ``url``; ``headers`` replace the fetcher's own."""
        for attempt in range(1, ATTEMPTS + 1):
            status, body = self._once(url, {**self.headers, **headers})
            if status == 403 and self.other_agent and self.headers.get("User-Agent") != self.other_agent:
                self.headers["User-Agent"] = self.other_agent
                status, body = self._once(url, {**self.headers, **headers})
            if status < 400:
                return body
            if attempt == ATTEMPTS or status != 429 and status < 500:
                break
            self.sleep(attempt * (REFUSED_WAIT if status == 429 else FAILED_WAIT))
        raise FetchError(status, url)

    def odata(self, base: str, condition: str, skip: int = 0) -> str:
        """A page of an OData answer; hosts that refuse a percent-encoded filter are asked with a plain one."""
        tail = f"&$skip={skip}" if skip else ""
        try:
            return self.get(f"{base}?$filter={quote(condition, safe='')}{tail}")
        except FetchError as error:
            if error.status != 400:
                raise
            return self.get(f"{base}?$filter={condition}{tail}")


class FetchError(RuntimeError):
    def __init__(self, status: int, url: str):
        super().__init__(f"{status} from {url}")
        self.status = status
