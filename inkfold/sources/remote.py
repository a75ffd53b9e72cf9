"""Pages from a service: the fetching function is given, so no network is needed here."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Takes an address, gives status and content, or raises.
Fetcher = Callable[[str], tuple[int, str]]
FETCHED = "url string, status int, content string, attempts int, error string"


def fetched(fetch: Fetcher, url: str, attempts: int = 3, pause: float = 0.0) -> tuple:
    """One address: called again after an exception or a status of 429 or 500 and above, with a pause that grows."""
    status, content, error, k = None, None, None, 0
    for k in range(1, attempts + 1):
        try:
            status, content = fetch(url)
            error = None if status < 400 else f"status {status}"
            if status != 429 and status < 500:
                break
        except Exception as e:  # whatever the injected function raises becomes a row
            status, content, error = None, None, str(e)[:200] or type(e).__name__
        if k < attempts:
            time.sleep(pause * k)
    return url, status, content if error is None else None, k, error


def fetch_pages(urls: DataFrame, fetch: Fetcher, attempts: int = 3, pause: float = 0.0) -> DataFrame:
    """``FETCHED`` of each row of ``url``; partitions are the concurrency, and no address fails the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        for b in batches:
            rows = [fetched(fetch, u, attempts, pause) for u in b.column(0).to_pylist()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, types)], ["url", "status", "content", "attempts", "error"])

    return urls.select("url").where("url IS NOT NULL").mapInArrow(run, FETCHED)


def watch(done: Callable[[], bool], attempts: int = 40, pause: float = 1800.0, sleep: Callable[[float], None] = time.sleep) -> int:
    """Ask until something is done, ``attempts`` times at most; the number of times it was asked, negative if in vain."""
    for k in range(1, attempts + 1):
        if done():
            return k
        if k < attempts:
            sleep(pause)
    return -attempts
