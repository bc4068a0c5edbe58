"""Pages by URL (SRC-5 to SRC-7, FLT-12, ERR-1): a table of URLs becomes url, html, status, fetch_error, duration_ms.

The client is a function given by the caller, so that browsers and sessions stay out of the engine; one is made in each
task. A failed fetch is a row with its error's name, never a failed job.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable
from urllib.parse import urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "url string, html string, status int, fetch_error string, duration_ms long"
# Answers that are asked for once more with plain headers, and the time for one fetch.
RETRIED = (400, 403, 406, 451)
TIMEOUT_SECONDS = 45


# Fixed value: the host whose pages are asked for without Brotli at first.
NO_BROTLI_HOST = "metacareers.com"


class Refused(Exception):
    def __init__(self, status: int):
        super().__init__(status)
        self.status = status


def headers_of(url: str, plain: bool, more: dict[str, str] | None = None, json: bool = False) -> dict[str, str]:
    """Headers of the first try, or of the plain second one (which has the site as referer)."""
    headers = {"User-Agent": "Mozilla/5.0", "Accept": "application/json" if json else "*/*"}
    parts = urlsplit(url)
    if plain:
        headers |= {"Referer": f"{parts.scheme}://{parts.netloc}/", "Accept-Encoding": "gzip, deflate"}
    else:
        headers["Accept-Encoding"] = "gzip, deflate" if NO_BROTLI_HOST in parts.netloc.lower() else "gzip, deflate, br"
        if not json:
            headers["Accept"] = "text/html,application/json;q=0.9,*/*;q=0.8"
    return headers | (more or {})


def with_params(url: str, params: dict[str, str] | None) -> str:
    """The URL with parameters added at the end of its query."""
    if not params:
        return url
    front, mark, fragment = url.partition("#")
    return front + ("&" if "?" in front else "?") + urlencode(params) + mark + fragment


def http_client() -> Callable[..., str]:
    """fetch(url, plain, headers, body): the standard library's client; a body makes it a POST."""

    def fetch(url: str, plain: bool, headers: dict[str, str] | None = None, body: str | None = None) -> str:
        sent = {k: v for k, v in (headers or headers_of(url, plain)).items() if k != "Accept-Encoding"}  # the library decodes none
        request = urllib.request.Request(url, headers=sent, data=None if body is None else body.encode())
        try:
            with urllib.request.urlopen(request, timeout=TIMEOUT_SECONDS) as answer:
                return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except urllib.error.HTTPError as e:
            raise Refused(e.code) from e

    return fetch


def _asked(fetch: Callable[[bool], str]) -> tuple[str | None, int | None, str | None, int]:
    """What a call gives: text, status, error, milliseconds; some refusals are tried once more with plain headers."""
    began, text, status, error = time.perf_counter(), None, 200, None
    for plain in (False, True):
        try:
            text, status, error = fetch(plain), 200, None
        except Refused as e:
            status, error = e.status, type(e).__name__
            if e.status in RETRIED:
                continue
        except Exception as e:  # noqa: BLE001  any failure is a row
            status, error = None, type(e).__name__
        break
    return text, status, error, int((time.perf_counter() - began) * 1000)


def _answers(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int64())
    names = ["url", "html", "status", "fetch_error", "duration_ms"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _wanted(requests: DataFrame) -> DataFrame:
    """url, params, headers, body of requests; what is not there is null."""
    none = F.lit(None).cast("map<string,string>")
    return requests.select(
        "url", *(F.col(c) if c in requests.columns else none.alias(c) for c in ("params", "headers")),
        F.col("body") if "body" in requests.columns else F.lit(None).cast("string").alias("body"),
    )


def fetched(urls: DataFrame, client: Callable[[], Callable[..., str]] = http_client) -> DataFrame:
    """SRC-5: the pages of URLs; params and headers (maps of strings) are added, if those columns are there."""

    def run(batches):
        fetch = client()
        for batch in batches:
            rows = []
            for url, params, headers, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole, more = with_params(url, dict(params or ())), dict(headers or ())
                rows.append((url, *_asked(lambda plain, w=whole, m=more: fetch(w, plain, *([headers_of(w, plain, m)] if m else [])))))
            yield _answers(rows)

    return _wanted(urls).mapInArrow(run, SCHEMA)


def fetched_json(requests: DataFrame, client: Callable[[], Callable[..., str]] = http_client) -> DataFrame:
    """SRC-6: answers (url, json as a variant, status, fetch_error, duration_ms) to requests.

    requests: url, and if there params and headers (maps of strings) and body (a string: the request is a POST). An
    answer that is no JSON has the error `ValueError`.
    """
    def run(batches):
        fetch = client()
        for batch in batches:
            rows = []
            for url, params, headers, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                whole = with_params(url, dict(params or ()))
                more = dict(headers or ()) | ({"Content-Type": "application/json"} if body is not None else {})
                rows.append((url, *_asked(lambda plain, w=whole, m=more, b=body: fetch(w, plain, headers_of(w, plain, m, True), b))))
            yield _answers(rows)

    found = _wanted(requests).mapInArrow(run, SCHEMA).withColumn("json", F.try_parse_json("html"))
    bad = F.col("json").isNull() & F.col("html").isNotNull()
    return found.select("url", "json", "status", F.when(bad, "ValueError").otherwise(F.col("fetch_error")).alias("fetch_error"), "duration_ms")


def stored(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """JOIN-11: the pages of the URLs that are stored; the others have no html."""
    return urls.select("url").join(pages.select("url", "html"), "url", "left")
