"""A data source of postings by sites' public JSON interface (SRC-10, FLT-10): planned partitions, pushed filters, paging inside a partition.

    register(spark)
    spark.read.format("lever_postings").option("sites", "acme,globex").load().where("location IN ('Berlin', 'Paris') AND team = 'Data'")

asks for `/v0/postings/acme?mode=json&location=Berlin&location=Paris&team=Data&skip=0&limit=50` and so on. Equality and IN on the five
parameters of the interface go to it (values of one are alternatives there, parameters all hold), on `site` they choose the sites to
ask; Spark evaluates them again over the rows, so an interface that takes them loosely changes nothing. Contradictory filters ask for
nothing. Options:

  sites            names, separated by commas; equal and empty ones are dropped. The driver plans them, a table of URLs goes by
                   adapters.lever_requests() instead.
  region           `eu` asks the European host first; the other one is asked when a call fails, and stays from then on
  maxPages         pages a site at most, 5 as in the adapters; a site that has more gives a row with the error `MorePages`
  sitesPerPartition  16
  base, other      the two interfaces' addresses, if they are others

A task holds one page at a time. What failed is a row of its own with `error` (the name of the error, `ValueError` for no JSON,
`Malformed` for an item that is no object or has no title or link), its `raw` text, and nulls; no answer ends the job.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from urllib.parse import quote, urlencode

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from jobtide.operators.adapters import LEVER_FILTERS, LEVER_LIMIT
from jobtide.sources import fetch

SCHEMA = f"site string, page_no int, pos int, title string, link string, {', '.join(f'{c} string' for c in LEVER_FILTERS)}, error string, raw string"
HOSTS = ("https://api.lever.co/v0/postings", "https://api.eu.lever.co/v0/postings")
_EMPTY = (None,) * len(LEVER_FILTERS)


@dataclass
class Sites(InputPartition):
    names: tuple[str, ...]

    def __init__(self, names):
        super().__init__(names)
        self.names = tuple(names)


class Reader(DataSourceReader):
    def __init__(self, options):
        hosts = HOSTS[::-1] if options.get("region", "").lower() == "eu" else HOSTS
        self.hosts = (options.get("base", hosts[0]).rstrip("/"), options.get("other", hosts[1]).rstrip("/"))
        self.sites = list(dict.fromkeys(s.strip() for s in options.get("sites", "").split(",") if s.strip()))
        self.max_pages, self.width = int(options.get("maxPages", 5)), int(options.get("sitesPerPartition", 16))
        if self.max_pages < 1 or self.width < 1:
            raise ValueError("maxPages and sitesPerPartition are 1 or more")
        self.allowed: dict[str, list[str]] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name == "site" or name in LEVER_FILTERS:
                values = [v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
                # the interface takes no empty value; such a filter is left to Spark
                if name == "site" or "" not in values:
                    held = self.allowed.get(name)
                    self.allowed[name] = list(dict.fromkeys(values)) if held is None else [v for v in held if v in values]
            yield f

    def partitions(self):
        if any(not values for values in self.allowed.values()):
            return [Sites(())]
        asked = [s for s in self.sites if s in self.allowed.get("site", self.sites)]
        return [Sites(asked[i : i + self.width]) for i in range(0, len(asked), self.width)] or [Sites(())]

    def read(self, partition):
        client = fetch.http_client()
        for site in partition.names:
            yield from self._site(client, site)

    def _site(self, client, site):
        params = [("mode", "json"), *((k, v) for k in LEVER_FILTERS for v in self.allowed.get(k, ()))]
        hosts = list(self.hosts)
        for page in range(self.max_pages):
            tail = f"/{quote(site, safe='')}?" + urlencode([*params, ("skip", page * LEVER_LIMIT), ("limit", LEVER_LIMIT)])
            text, error = self._call(client, hosts[0] + tail)
            if error and len(hosts) > 1:
                hosts.pop(0)
                text, error = self._call(client, hosts[0] + tail)
            items, error = (None, error) if error else _items(text)
            if error:
                yield (site, page, None, None, None, *_EMPTY, error, text)
                return
            for pos, item in enumerate(items):
                yield (site, page, pos, *_posting(site, item))
            if len(items) < LEVER_LIMIT:
                return
        yield (site, self.max_pages, None, None, None, *_EMPTY, "MorePages", None)

    @staticmethod
    def _call(client, url):
        text, _, error, _ = fetch._asked(lambda plain: client(url, plain, fetch.headers_of(url, plain, None, True)))
        return text, error


def _items(text: str):
    """(items of an answer, error)."""
    try:
        found = json.loads(text)
    except (ValueError, RecursionError):
        return None, "ValueError"
    found = found.get("data") if isinstance(found, dict) else found
    return (found or [], None) if isinstance(found, list | None) else (None, "Malformed")


def _posting(site, item):
    """title, link, the five categories, error and raw text of an item."""
    said = item if isinstance(item, dict) else {}
    text = lambda x: x.encode("utf-8", "replace").decode() if isinstance(x, str) and x else None
    title, given = text(said.get("text")), text(said.get("id"))
    title = title and (title.strip() or None)
    link = text(said.get("hostedUrl")) or text(said.get("applyUrl")) or (given and f"https://jobs.lever.co/{site}/{given}")
    if not (title and link):
        return (None, None, *_EMPTY, "Malformed", json.dumps(item))
    told = said.get("categories") if isinstance(said.get("categories"), dict) else {}
    return (title, link, *(text(told.get(k)) for k in LEVER_FILTERS), None, None)


class LeverPostings(DataSource):
    @classmethod
    def name(cls):
        return "lever_postings"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return Reader(self.options)


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let it take filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LeverPostings)
