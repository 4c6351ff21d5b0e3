"""Bodies from a cache table and, for what it lacks, from a getter that is handed in.

The engine has no HTTP client of its own: `get` is any function of an address that returns
(status, headers, body). Retries follow fixed rules, and only what looks like a payload is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators import store

# Attempts, the longest wait that a server may ask for, the wait after a failure (seconds), the largest body.
ATTEMPTS, LONGEST_WAIT, WAIT, LARGEST = 60, 5.0, 1.0, 50 << 20

Get = Callable[[str], tuple[int, dict, str]]


def retrying(get: Get, url: str, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """The body, or None when it is refused, too large, or never comes. 429 waits as long as the server
    asks, 5 seconds at most; server errors and timeouts wait a second."""
    for _ in range(ATTEMPTS):
        try:
            status, headers, body = get(url)
        except (TimeoutError, ConnectionError):
            sleep(WAIT)
            continue
        if status == 429:
            asked = str(headers.get("Retry-After", ""))
            sleep(min(float(asked), LONGEST_WAIT) if asked.replace(".", "", 1).isdigit() else WAIT)
        elif status >= 500:
            sleep(WAIT)
        else:
            return body if status < 400 and len(body.encode()) <= LARGEST else None
    return None


def fetch(requests: DataFrame, cache: DataFrame, get: Get, now: Column, ttl: int = store.TTL_SEARCH) -> DataFrame:
    """(cache_key, url, body, fetched_at) for requests (cache_key, url): fresh rows of the cache, and what the
    getter has for the others. Bodies that begin with neither {, [ nor < are left out."""
    fresh = store.cache_hits(cache, now, ttl).join(requests.select("cache_key"), "cache_key", "left_semi")
    missing = requests.join(fresh, "cache_key", "left_anti").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b[["cache_key", "url"]].assign(body=[retrying(get, u) for u in b["url"]])

    got = missing.select("cache_key", "url").mapInPandas(run, "cache_key string, url string, body string")
    kept = got.where(F.col("body").rlike(r"^\s*[{\[<]")).select("cache_key", "url", "body", now.alias("fetched_at"))
    return fresh.select("cache_key", "url", "body", "fetched_at").unionByName(kept)


def inside(root: str, path: str, suffix: str | None = None) -> Path:
    """The path, resolved, if it is below the root (links followed) and has the suffix; else ValueError."""
    whole, top = (Path(root) / path).resolve(), Path(root).resolve()
    if not whole.is_relative_to(top):
        raise ValueError(f"{path} is outside of {root}")
    if suffix is not None and whole.suffix != suffix:
        raise ValueError(f"{path} is no {suffix} file")
    return whole
