"""The next page of a list (PAG-1 to PAG-4) and the crawl over stored pages (PAG-5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.functions import texts, urls
from jobtide.operators.dom import PAGE, attr, has_class
from jobtide.operators.stored import stored

# Words on links to a next page, and the keys of page numbers and offsets.
NEXT_WORDS = r"(?iU)\b(next|go to next page|weiter|suivant|siguiente)\b"
PAGE_KEYS = ("page", "p", "pg", "pageNo", "pageNumber", "currentPage")
OFFSET_KEYS = ("start", "offset", "from", "startrow")
MAX_PAGES = 5


def page_facts(nodes: DataFrame) -> DataFrame:
    """DOM-7, STR-15: current page, pages, and the results window of each page."""
    pager = (F.col("tag") == "input") & ((attr("data-autom") == "paginationPageInput") | has_class("rc-pagination-pageinput"))
    typed = attr("value").try_cast("int")
    spoken = F.when(attr("aria-live").isNotNull(), F.regexp_extract("text", r"(?i)page\s+(\d+)", 1).try_cast("int"))
    window = texts.results_window(F.col("own_text"))
    total = F.when(has_class("rc-pagination-total-pages"), texts.whole_number(F.col("text")))

    def first(x):
        return F.min_by(x, F.when(x.isNotNull(), F.col("node_id")))

    return nodes.groupBy(*PAGE).agg(
        F.coalesce(first(F.when(pager, typed)), first(spoken)).alias("page"), first(total).alias("pages"), first(window).alias("window")
    )


def explicit_next(nodes: DataFrame, facts: DataFrame) -> DataFrame:
    """PAG-1: the href of the first tier that has one."""
    links = nodes.where((F.col("tag") == "a") & attr("href").isNotNull())
    label = F.lower(F.coalesce(attr("aria-label"), F.lit("")))
    off = F.lower(F.coalesce(attr("aria-disabled"), F.lit(""))).isin("true", "1") | has_class("disabled")
    pagers = nodes.where(((F.col("tag") == "nav") & F.lower(attr("aria-label")).contains("pagination")) | has_class("pagination"))
    pagers = pagers.select(*PAGE, F.col("node_id").alias("p"), F.col("last_desc").alias("p_last"))
    wrapped = nodes.where((attr("data-analytics-pagination") == "next") | has_class("VfPpkd-wZVHld-gruSEe"))
    wrapped = wrapped.select(*PAGE, F.col("node_id").alias("p"), F.col("last_desc").alias("p_last"), (attr("data-analytics-pagination") == "next").alias("sure"))
    inner = "node_id > p AND node_id <= p_last"
    tier = lambda df, k, order: df.select(*PAGE, F.lit(k).alias("tier"), order.alias("rank"), attr("href").alias("href"))
    position = F.col("node_id").cast("long")
    keyed = links.where(attr("aria-label").isNotNull()).join(pagers, PAGE).where(inner)
    number = F.coalesce(*(F.nullif(F.regexp_extract(attr("href"), rf"[?&]{k}=(\d+)\b", 1), F.lit("")) for k in PAGE_KEYS)).cast("long")
    keyed = keyed.withColumn("n", number).join(facts.select(*PAGE, "page"), PAGE, "left").where("n IS NOT NULL AND (page IS NULL OR n > page)")
    nav = links.join(pagers, PAGE).where(inner).where(F.lower(attr("rel")).contains("next") | label.contains("next"))
    found = (
        tier(links.where(F.lower(attr("rel")).contains("next")), 1, position)
        .unionByName(tier(links.where(label.rlike(NEXT_WORDS) & ~off), 2, position))
        .unionByName(tier(links.join(wrapped, PAGE).where(inner).where(F.coalesce("sure", F.lit(False)) | label.contains("next")), 3, position))
        .unionByName(tier(nav, 4, position))
        .unionByName(tier(keyed, 5, F.col("n")))
    )
    return found.groupBy(*PAGE).agg(F.min_by("href", F.struct("tier", "rank", "href")).alias("href"))


def next_pages(nodes: DataFrame) -> DataFrame:
    """page_id, url, next_url: the explicit link, else a page key or offset raised within the known bounds, else a found key."""
    facts = page_facts(nodes)
    keyed = nodes.where((F.col("tag") == "a") & attr("href").rlike(r"[?&](\w+)=\d+\b"))
    keyed = keyed.groupBy(*PAGE).agg(F.min_by(F.regexp_extract(attr("href"), r"[?&](\w+)=\d+\b", 1), "node_id").alias("key"))
    rows = facts.join(explicit_next(nodes, facts), PAGE, "left").join(keyed, PAGE, "left")
    rows = rows.withColumn("q", urls.pairs(F.col("url")))
    url, found = F.col("url"), F.col("q")

    def value(key):
        return F.try_element_at(F.filter(found, lambda p: p["k"] == key), F.lit(-1))["v"]

    def change(key, after, stop):
        return F.struct(F.lit(key).alias("k"), after.alias("v"), F.coalesce(stop, F.lit(False)).alias("stop"))

    size, total, options = F.col("window.size"), F.col("window.total"), []
    for key in PAGE_KEYS:
        after = value(key).try_cast("int") + 1
        options.append(F.when(after.isNotNull(), change(key, after, (F.col("pages") > 0) & (after > F.col("pages")))))
    for key in OFFSET_KEYS:
        after = F.coalesce(value(key).try_cast("int"), F.lit(0)) + size
        options.append(F.when(value(key).isNotNull() & size.isNotNull(), change(key, after, after >= total)))
    rows = rows.withColumn("change", F.coalesce(*options))
    made = F.when(F.col("change").isNotNull(), urls.with_param(url, F.col("change.k"), F.col("change.v")))
    stop = F.coalesce("change.stop", F.lit(False))
    more = F.col("page").isNotNull() & (F.col("pages").isNull() | (F.col("page") < F.col("pages")))
    last = F.when(more & F.col("key").isNotNull(), urls.with_param(url, F.col("key"), F.col("page") + 1))
    return rows.select(*PAGE, F.coalesce(urls.absolute(F.col("href"), url), F.when(~stop, F.coalesce(made, last))).alias("next_url"))


def crawl(starts: DataFrame, following: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """PAG-5: start, url, page_no of the pages reached from each start on one host: one recursive plan, whatever max_pages is.

    starts: url. following: url, next_url; of several next pages of a URL the first in text order counts. Pages are told apart
    by their identity; a crawl ends at a page it knows, at another host, or after max_pages. A row carries the identities of
    its crawl, so it holds max_pages of them at most. Spark ends recursions at a million rows by default; here the bound is
    max_pages, so that limit is lifted for the session.
    """
    spark = starts.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    links = following.where("url IS NOT NULL AND next_url IS NOT NULL").groupBy("url").agg(F.min("next_url").alias("next_url"))
    # all pages of a crawl are on its start's host, so a link needs to stay on its own
    links = links.where(urls.host(F.col("next_url")) == urls.host(F.col("url")))
    links = stored(links.withColumn("next_id", urls.page_identity(F.col("next_url"))))
    fronts = starts.select("url", urls.page_identity(F.col("url")).alias("id"))
    return spark.sql(
        f"""WITH RECURSIVE reached(start, url, page_no, seen) MAX RECURSION LEVEL {max_pages + 1} AS (
          SELECT url, url, 1, array(id) FROM {{fronts}}
          UNION ALL
          SELECT r.start, l.next_url, r.page_no + 1, array_append(r.seen, l.next_id) FROM reached r JOIN {{links}} l ON r.url = l.url
          WHERE r.page_no < {max_pages} AND NOT array_contains(r.seen, l.next_id))
        SELECT start, url, page_no FROM reached""",
        fronts=fronts, links=links,
    )
