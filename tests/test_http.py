"""The driver's fetcher over an invented transport and clock."""

import pytest

from plenarium.sources.http import Fetcher, FetchError
from plenarium.streaming.incremental import Budget


class World:
    """Answers by url in turn, and a clock that sleeping moves."""

    def __init__(self, **answers):
        self.answers, self.asked, self.now, self.slept = answers, [], 100.0, []

    def transport(self, url, headers):
        self.asked.append((url, headers.get("User-Agent")))
        statuses = self.answers.get(url.split("?")[0].rsplit("/", 1)[-1], [200])
        status = statuses.pop(0) if len(statuses) > 1 else statuses[0]
        return (status(url, headers) if callable(status) else status), "body"

    def sleep(self, seconds):
        self.slept.append(seconds)
        self.now += seconds

    def fetcher(self, **more):
        return Fetcher(self.transport, sleep=self.sleep, clock=lambda: self.now, **more)


def test_spacing_by_host():
    world = World()
    fetcher = world.fetcher(interval=2.0)
    for url in ("http://a/x", "http://b/x", "http://a/y", "http://a/z"):
        assert fetcher.get(url) == "body"
    assert world.slept == [2.0, 2.0]


def test_retries():
    world = World(busy=[429, 429, 200], down=[500, 503, 502, 500], gone=[404])
    fetcher = world.fetcher(interval=0)
    assert fetcher.get("http://a/busy") == "body" and world.slept == [20.0, 40.0]
    world.slept.clear()
    with pytest.raises(FetchError, match="500"):
        fetcher.get("http://a/down")
    assert world.slept == [2.0, 4.0, 6.0]
    world.asked.clear()
    with pytest.raises(FetchError, match="404"):
        fetcher.get("http://a/gone")
    assert len(world.asked) == 1


def test_the_other_agent_stays():
    world = World(picky=[lambda url, headers: 200 if headers.get("User-Agent") == "browser" else 403])
    fetcher = world.fetcher(interval=0, headers={"User-Agent": "robot"}, other_agent="browser")
    fetcher.get("http://a/open")
    fetcher.get("http://a/picky")
    fetcher.get("http://a/open")
    assert [agent for _, agent in world.asked] == ["robot", "robot", "browser", "browser"]


def test_budget_and_plain_filters():
    world = World(people=[lambda url, headers: 400 if "%20" in url else 200])
    assert world.fetcher(interval=0).odata("http://a/people", "PHID eq 'X'", 100) == "body"
    assert [url for url, _ in world.asked] == ["http://a/people?$filter=PHID%20eq%20%27X%27&$skip=100", "http://a/people?$filter=PHID eq 'X'&$skip=100"]
    fetcher = world.fetcher(interval=0, budget=Budget(2))
    fetcher.get("http://a/x")
    fetcher.get("http://a/x")
    with pytest.raises(RuntimeError, match="budget"):
        fetcher.get("http://a/x")
