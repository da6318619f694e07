"""Pages over HTTP, as captures: retries, a gap between requests to one host, blocks told from missing pages.

``capture`` turns a DataFrame of addresses into captures. All addresses of a host go to one task, which keeps the
gap; hosts go to tasks of their own, so how many are read at once is the number of tasks. Requests
are made while the result is written; write it before parsing, as reading it twice asks twice.
"""

from __future__ import annotations

import json
import random
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pages import BLOCK_PAGE, decode_bytes

#: Seconds: of a request, the first pause before a retry, the longest, its random share; retries; gap between requests to a host (fixed values).
TIMEOUT, PAUSE, LONGEST, JITTER, RETRIES, GAP = 25.0, 0.6, 8.0, 0.4, 4, 0.35
HTML, JSON = "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "application/json"
AGENT = "Mozilla/5.0 (compatible; lotewise)"


class HttpError(Exception):
    """An answer that is no success."""

    def __init__(self, status: int, url: str, said: str = ""):
        super().__init__(f"HTTP {status} from {url}" + (f": {said[:200]}" if said else ""))
        self.status, self.url = status, url


class Blocked(HttpError):
    """An anti-bot page: no proof that there are no results."""


class Fetcher:
    """Requests with retries on network errors, 429 and server errors, a gap apart for each host."""

    def __init__(self, gap: float = GAP, pause: float = PAUSE, retries: int = RETRIES, timeout: float = TIMEOUT, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.pause, self.retries, self.timeout, self.sleep = gap, pause, retries, timeout, sleep
        self.next: dict[str, float] = {}

    def wait(self, url: str) -> None:
        """Until the host's next turn."""
        host, now = urlsplit(url).netloc, time.monotonic()
        at = max(now, self.next.get(host, 0.0))
        self.next[host] = at + self.gap
        if at > now:
            self.sleep(at - now)

    def request(self, url: str, body: bytes | None = None, **headers: str) -> tuple[int, str | None, bytes]:
        """(status, content type, body) of the last try."""
        delay = self.pause
        for attempt in range(self.retries + 1):
            self.wait(url)
            ask = urllib.request.Request(url, data=body, headers={"User-Agent": AGENT, "Accept-Language": "pt-BR,pt;q=0.9,en;q=0.5", **{k.replace("_", "-"): v for k, v in headers.items()}})
            try:
                with urllib.request.urlopen(ask, timeout=self.timeout) as r:
                    return r.status, r.headers.get("Content-Type"), r.read()
            except urllib.error.HTTPError as e:
                if (e.code != 429 and e.code < 500) or attempt == self.retries:
                    return e.code, e.headers.get("Content-Type"), e.read()
            except OSError as e:
                if attempt == self.retries:
                    raise ConnectionError(f"no answer from {url}: {e}") from e
            self.sleep(delay + random.random() * JITTER)
            delay = min(delay * 2, LONGEST)
        raise AssertionError

    def _good(self, status: int, url: str, text: str) -> str:
        if status in (403, 503) and re.search(BLOCK_PAGE, text[:20000]):
            raise Blocked(status, url)
        if not 200 <= status < 300:
            raise HttpError(status, url, text)
        return text

    def html(self, url: str) -> str | None:
        """A page's text; none where it is gone."""
        status, kind, body = self.request(url, Accept=HTML)
        return None if status in (404, 410) else self._good(status, url, decode_bytes(body, kind))

    def json(self, url: str, body: object = None):
        """A JSON answer; none where a page that was asked for is gone."""
        status, _, got = self.request(url, **({"Accept": JSON} if body is None else {"body": json.dumps(body).encode(), "Accept": JSON, "Content_Type": JSON}))
        if status == 404 and body is None:
            return None
        try:
            return json.loads(self._good(status, url, got.decode("utf-8", "replace")))
        except json.JSONDecodeError as e:
            raise ValueError(f"no JSON from {url}") from e


def each(items: list, limit: int, f: Callable) -> list:
    """``f`` of every item, ``limit`` at a time, in the items' order."""
    with ThreadPoolExecutor(max(1, min(limit, len(items) or 1))) as pool:
        return list(pool.map(f, items))


def capture(addresses: DataFrame, at_once: int = 4, **settings) -> DataFrame:
    """``addresses`` (column ``url``) with ``status`` (0 without an answer), ``html`` and ``erro``; other columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fetcher = Fetcher(**settings)

        def one(url: str) -> tuple[int, str | None, str | None]:
            try:
                text = fetcher.html(url)
                return (404, None, None) if text is None else (200, text, None)
            except HttpError as e:
                return e.status, None, "bloqueado" if isinstance(e, Blocked) else str(e)
            except (OSError, ValueError) as e:
                return 0, None, str(e)

        for b in batches:
            got = [one(u) for u in b.column("url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.int32()), *[pa.array([g[i] for g in got], pa.string()) for i in (1, 2)]], names=[*b.schema.names, "status", "html", "erro"])

    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in addresses.schema)
    return addresses.repartition(at_once, host).mapInArrow(run, f"{schema}, status int, html string, erro string")
