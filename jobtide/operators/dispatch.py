r"""Pages of all systems together: adapters by name, rules that deal pages to them, boards told by selectors (JOIN-4).

    boards = Boards()
    boards.add("acme", host=r"^jobs\.acme\.example$", read=by_selectors("div.opening", "a.apply", "span.role"))
    boards.postings(pages, details)

A rule is a pattern of the host and one of the path; added rules come before the known systems', the later before the earlier, and an
added name may be that of a known system, whose rule then stays as another. Pages without a rule, and those of systems that only a
browser or an interface answers for, are read by the general extractors (LIM-3).

Pages are written once, parted by adapter, so each adapter's plan scans its own pages and parses each once; rules are conditions
on the URL in the JVM. In SQL, `register(spark)` gives a table function of a page's nodes:

    SELECT p.page_id, n.attrs['href'] FROM pages p, LATERAL page_nodes(p.html, 'a') n WHERE n.tag = 'a'

A page with a null URL or null HTML gives no postings, an empty table no rows; rows that repeat a page_id and a URL are one page's,
so their postings count once; columns beside page_id, url and html are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from jobtide.functions import urls
from jobtide.operators import adapters, dom, extract, selectors
from jobtide.operators.dom import PAGE, attr
from jobtide.operators.history import first_wins
from jobtide.operators.stored import stored

GENERAL = "generic"
#: Readers of the known systems: from nodes of list pages and nodes of detail pages to page_id, url, pos, title, link.
KNOWN: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "microsoft": lambda nodes, _: adapters.from_microsoft(nodes), "proton": lambda nodes, _: adapters.from_proton(nodes), "workday": lambda nodes, _: adapters.from_workday(nodes),
    "join": adapters.from_join, "greenhouse": adapters.from_greenhouse, "ashby": adapters.from_ashby,
}


def by_selectors(item: str, link: str | None = None, title: str | None = None) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A reader of items: of each the first link inside it (its own, without a selector) and the first title that is not empty (the link's text)."""
    for selector in filter(None, (item, link, title)):
        selectors.parsed(selector)

    def read(nodes: DataFrame, _: DataFrame) -> DataFrame:
        def inside(selector, value):
            if selector is None:
                return items.where(value.isNotNull() & (value != "")).select(*PAGE, "node_id", F.struct(value.alias("v"), "text").alias("x"))
            chosen = selectors.select(nodes, selector).where(value.isNotNull() & (value != "")).select(*PAGE, F.col("node_id").alias("x_id"), F.struct(value.alias("v"), "text").alias("x"))
            return selectors.contained(items.select(*PAGE, "node_id", "last_desc"), chosen, "x_id").groupBy(*PAGE, "node_id").agg(F.min_by("x", "x_id").alias("x"))

        items = selectors.select(nodes, item)
        found = inside(link, attr("href")).withColumnRenamed("x", "a")
        found = found.join(inside(title, F.col("text")), [*PAGE, "node_id"], "left") if title else found.withColumn("x", F.lit(None).cast("struct<v string>"))
        linked = urls.canonical(urls.absolute(urls.unescaped(F.col("a.v")), F.col("url")))
        placed = found.select(*PAGE, F.col("node_id").cast("long").alias("pos"), F.trim(F.coalesce("x.v", "a.text")).alias("title"), linked.alias("link"))
        return first_wins(placed.where("title <> '' AND link IS NOT NULL"), [*PAGE, "link"], ["pos"])

    return read


class Boards:
    """The known systems and what a caller adds to them."""

    def __init__(self):
        self._rules: list[tuple[str, Callable[[Column], Column]]] = []
        self._readers: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = dict(KNOWN)

    def add(self, name: str, read: Callable[[DataFrame, DataFrame], DataFrame], host: str | None = None, path: str | None = None) -> Boards:
        if not name or name == GENERAL:
            raise ValueError("an adapter needs a name of its own")
        if host is None and path is None:
            raise ValueError("a rule needs a pattern of the host or the path")

        def rule(url: Column) -> Column:
            of_host = urls.host(url).rlike("(?i)" + host) if host else F.lit(True)
            return F.coalesce(of_host & (urls.path(url).rlike(path) if path else F.lit(True)), F.lit(False))

        self._rules.insert(0, (name, rule))
        self._readers[name] = read
        return self

    def adapter(self, url: Column) -> Column:
        """The name of the adapter that reads a URL's page; generic, if none does."""
        known = urls.adapter(url)
        found = F.when(known.isin(*self._readers), known).otherwise(GENERAL)
        for name, rule in reversed(self._rules):
            found = F.when(rule(url), name).otherwise(found)
        return found

    def postings(self, pages: DataFrame, details: DataFrame | None = None) -> DataFrame:
        """page_id, url, adapter, pos, title, link of the postings of pages (page_id, url, html); details: detail pages, for systems that need them."""
        columns = ["page_id", "url", "html"]
        named = pages.select(*columns).where("url IS NOT NULL AND html IS NOT NULL").withColumn("adapter", self.adapter(F.col("url")))
        named = stored(named, by=["adapter"])
        details = pages.limit(0) if details is None else details
        titles = dom.nodes(details.select(*columns), tags=("h1",))
        readers = {**self._readers, GENERAL: lambda nodes, _: extract.postings(nodes)}
        found = None
        # only the systems that pages are of; as many names as rules at most
        for name in sorted(r[0] for r in named.select("adapter").distinct().collect()):
            own = readers[name](dom.nodes(named.where(F.col("adapter") == name).select(*columns)), titles)
            own = own.select(*PAGE, F.lit(name).alias("adapter"), F.col("pos").cast("long").alias("pos"), "title", "link")
            found = own if found is None else found.unionByName(own)
        none = pages.sparkSession.createDataFrame([], "page_id long, url string, adapter string, pos long, title string, link string")
        return none if found is None else found


@udtf(returnType="node_id int, parent_id int, last_desc int, tag string, attrs map<string,string>, own_text string, text string")
class PageNodes:
    """Nodes of a page; tags: names of the elements wanted, separated by commas, all if it is null."""

    def eval(self, html: str, tags: str):
        wanted = None if tags is None else {t.strip().lower() for t in tags.split(",")}
        for node, parent, last, tag, attrs, own, text in dom.parse(html or "", wanted):
            yield node, parent, last, tag, dict(attrs), own, text


def register(spark: SparkSession) -> None:
    """Make page_nodes(html, tags) known to SQL."""
    spark.udtf.register("page_nodes", PageNodes)
