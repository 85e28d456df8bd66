"""Connectors to paged record sources.

A source turns a cursor into a request and a reply into (records, next cursor). Fetching is a function
given by the caller, so that transport, keys and proxies stay outside; `patient` adds throttling and
retries to any such function. land() writes pages as JSON lines into a landing folder, where the readers
and the stream take over, and notes its cursor after each page, so that a broken load goes on.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession

from brindle.sources.store import Store

#: (url, parameters) -> (status, decoded JSON body)
Fetch = Callable[[str, dict[str, Any]], tuple[int, Any]]


class FetchFailed(RuntimeError):
    pass


def patient(fetch: Fetch, pause: float = 0.0, attempts: int = 5, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> Callable[[str, dict[str, Any]], Any]:
    """fetch with a pause between calls; busy (429) and failing (5xx) servers are asked again, after
    waits that double; other refusals end at once."""

    def ask(url: str, params: dict[str, Any]) -> Any:
        status = 0
        for k in range(attempts):
            sleep(pause if k == 0 else wait * 2 ** (k - 1))
            status, body = fetch(url, params)
            if status < 400:
                return body
            if status != 429 and status < 500:
                break
        raise FetchFailed(f"{url}: status {status}")

    return ask


@dataclass(frozen=True)
class Source:
    """Where a source's pages are, under which key they hold records, and how they name the next one."""

    name: str
    url: str
    records: str
    first: dict[str, Any]
    following: Callable[[dict[str, Any], Any, int], dict[str, Any] | None]

    def pages(self, ask: Callable[[str, dict[str, Any]], Any], cursor: dict[str, Any] | None = None) -> Iterator[tuple[list[dict], dict[str, Any] | None]]:
        """(records, cursor of the next page) until there is none."""
        at = cursor or dict(self.first)
        while at is not None:
            body = ask(self.url, at)
            rows = body if isinstance(body, list) else body.get(self.records) or []
            at = self.following(at, body, len(rows))  # type: ignore[assignment]
            yield rows, at


def by_next_link(parameter: str) -> Callable:
    """The reply holds the next page's address, which holds its cursor."""
    from urllib.parse import parse_qs, urlparse

    def following(at: dict, body: Any, _: int) -> dict | None:
        link = body.get("next") or body.get("nextPage")
        got = parse_qs(urlparse(link).query).get(parameter) if link else None
        return at | {parameter: got[0]} if got else None

    return following


def by_offset(size: str = "limit", start: str = "offset") -> Callable:
    """Pages by offset end with the first that isn't full."""
    return lambda at, body, got: at | {start: at[start] + at[size]} if got >= at[size] else None


def by_number(parameter: str = "page") -> Callable:
    """Numbered pages end with the first empty one."""
    return lambda at, body, got: at | {parameter: at[parameter] + 1} if got else None


def once(at: dict, body: Any, got: int) -> None:
    return None


# Public services, where they keep records, and how they page.
SOURCES = {
    s.name: s
    for s in (
        Source("courtlistener", "https://www.courtlistener.com/api/rest/v4/search/", "results", {"type": "o"}, by_next_link("cursor")),
        Source("congress", "https://api.congress.gov/v3/bill", "bills", {"limit": 250, "offset": 0}, by_offset()),
        Source("govinfo", "https://api.govinfo.gov/collections/USCOURTS", "packages", {"pageSize": 100, "offsetMark": "*"}, by_next_link("offsetMark")),
        Source("ecfr", "https://www.ecfr.gov/api/admin/v1/agencies.json", "agencies", {}, once),
        Source("oyez", "https://api.oyez.org/cases", "cases", {"per_page": 100, "page": 0}, by_number()),
    )
}


def land(spark: SparkSession, source: Source, ask: Callable[[str, dict[str, Any]], Any], folder: str, store: Store, most_pages: int | None = None) -> int:
    """Pages into the landing folder from where the last load came to; the number of records landed."""
    lane, done = f"land:{source.name}", 0
    held = store.cursor(lane)
    if held == "done":
        return 0
    for k, (rows, following) in enumerate(source.pages(ask, json.loads(held) if held else None)):
        if rows:
            # one file a page: the stream's unit of work
            spark.createDataFrame([(json.dumps(r),) for r in rows], "value string").coalesce(1).write.mode("append").text(folder)
        done += len(rows)
        store.checkpoint(lane, json.dumps(following) if following is not None else "done", len(rows))
        if most_pages is not None and k + 1 >= most_pages:
            break
    return done


def load(spark: SparkSession, names: list[str], fetch: Fetch, folder: str, store: Store, keys: dict[str, str] | None = None) -> dict[str, str]:
    """Every named source in turn; one that fails, or lacks its key, doesn't stop the others. The
    report says of each how many records came, or why none did."""
    report = {}
    for name in names:
        source = SOURCES.get(name)
        if source is None:
            report[name] = "unknown source"
        elif keys is not None and not keys.get(name):
            report[name] = "skipped: no key"
        else:
            try:
                report[name] = f"{land(spark, source, patient(fetch), f'{folder}/{name}', store)} records"
            except FetchFailed as e:
                report[name] = f"failed: {e}"
    return report
