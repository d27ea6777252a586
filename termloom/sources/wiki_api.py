"""Online scan of a wiki's API: an HTTP client with retries and politeness, and a
Python data source over it. Needs a network; nothing else in the engine does."""

from __future__ import annotations

import json
import math
import threading
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Delays and limits of the crawl, and below the service's parameter names.
MAX_BACKOFF = 60.0
MAX_RETRY_AFTER = 600.0  # a server that asks for more is asked again after so long
DELAY = 0.5
MAX_ATTEMPTS = 3
PAGE_SIZE = 500
CATEGORY = 14


def backoff(attempt: int, retry_after: str | None = None) -> float:
    """Seconds to wait after a failed attempt (from 0): what the server asks for
    if it is a finite number, at most MAX_RETRY_AFTER, else 2 to the power of the
    attempt, at most MAX_BACKOFF."""
    if retry_after is not None:
        try:
            asked = float(retry_after)
        except ValueError:
            asked = math.nan
        if math.isfinite(asked):
            return min(max(0.0, asked), MAX_RETRY_AFTER)
    return min(2.0**attempt, MAX_BACKOFF)


def _open(url: str, timeout: float) -> bytes:
    request = urllib.request.Request(url, headers={"User-Agent": "termloom/1.0"})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.read()


class LostPageError(RuntimeError):
    """An answer that could not be had after all attempts; what came before it is incomplete."""


class PoliteClient:
    """Fetches JSON; requests of all threads keep ``delay`` seconds apart."""

    def __init__(self, base: str, delay: float = DELAY, attempts: int = MAX_ATTEMPTS, fetch: Callable[[str, float], bytes] = _open, sleep: Callable[[float], None] = time.sleep):
        self.base, self.delay, self.attempts, self.fetch, self.sleep = base, delay, attempts, fetch, sleep
        self._lock, self._last = threading.Lock(), 0.0

    def get(self, params: dict[str, str], timeout: float = 30.0) -> dict | None:
        """The answer, or None after the last failed attempt."""
        url = f"{self.base}?{urllib.parse.urlencode(params | {'format': 'json'})}"
        for attempt in range(self.attempts):
            with self._lock:
                wait = self._last + self.delay - time.monotonic()
                if wait > 0:
                    self.sleep(wait)
                self._last = time.monotonic()
            asked = None
            try:
                return json.loads(self.fetch(url, timeout))
            except urllib.error.HTTPError as e:
                asked = e.headers.get("Retry-After") if e.headers else None
            except (OSError, ValueError):
                pass
            if attempt + 1 < self.attempts:
                self.sleep(backoff(attempt, asked))
        return None

    def members(self, category: str) -> Iterator[tuple[int, str]]:
        """(namespace, title) of a category's members, page after page. Raises
        LostPageError if a page can't be had: a part is never taken for the whole."""
        params = {"action": "query", "list": "categorymembers", "cmtitle": f"Category:{category}", "cmlimit": str(PAGE_SIZE)}
        while True:
            answer = self.get(params)
            if answer is None:
                raise LostPageError(f"category {category!r}: no answer to {params}")
            for m in answer.get("query", {}).get("categorymembers", []):
                yield int(m.get("ns", 0)), m["title"]
            following = answer.get("continue")
            if not following:
                return
            params = params | {k: str(v) for k, v in following.items()}

    def extract(self, title: str) -> tuple[str | None, str | None]:
        """(extract, url) of an article, (None, None) if there is none. Raises
        LostPageError if there is no answer."""
        answer = self.get({"action": "query", "prop": "extracts|info", "inprop": "url", "explaintext": "1", "titles": title})
        if answer is None:
            raise LostPageError(f"article {title!r}: no answer")
        page = next(iter(answer.get("query", {}).get("pages", {}).values()), {})
        return page.get("extract"), page.get("fullurl")


class _Share(InputPartition):
    def __init__(self, items: list[str], workers: int):
        self.items, self.workers = items, workers


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        items = json.loads(self.options.get("items", "[]"))
        n = max(1, int(self.options.get("workers", "4")))
        shares = [items[i::n] for i in range(n) if items[i::n]]
        return [_Share(own, len(shares)) for own in shares] or [_Share([], 1)]

    def read(self, share: _Share) -> Iterator[tuple]:
        """Rows (item, …, error). All workers together keep ``delay`` between two
        requests: each waits that long for every one of them. An item that is lost
        gives, after what it had, a row with the error; ``on_error=fail`` ends the scan."""
        client = PoliteClient(self.options["url"], share.workers * float(self.options.get("delay", DELAY)))
        members = self.options.get("what", "members") == "members"
        for item in share.items:
            try:
                if members:
                    for ns, title in client.members(item):
                        yield item, ns, title, None
                else:
                    yield item, *client.extract(item), None
            except LostPageError as e:
                if self.options.get("on_error", "row") == "fail":
                    raise
                yield item, None, None, str(e)


class WikiApi(DataSource):
    """format("wiki_api"), options url, what (members or extracts), items (JSON list),
    workers, delay (between two requests of all workers), on_error (row or fail)."""

    @classmethod
    def name(cls) -> str:
        return "wiki_api"

    def schema(self) -> str:
        return "cat string, ns int, title string, error string" if self.options.get("what", "members") == "members" else "title string, extract string, source_url string, error string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WikiApi)
