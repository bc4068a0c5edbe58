"""Postings of the boards of known systems, from stored list pages and detail pages (ADP-1, ADP-3 to ADP-8).

Each function takes nodes of pages (dom.nodes) and gives page_id, url, pos, title, link. Which anchors or items count is
a filter by range within the page; postings that repeat an id are one, the first that has a title. Rendering is outside:
the pages are given as a browser would leave them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.functions import texts, urls
from jobtide.operators import places
from jobtide.operators.dom import PAGE, attr, has_class, without
from jobtide.operators.history import first_wins
from jobtide.operators.selectors import contained, met, within
from jobtide.operators.stored import stored

# The parameters of a list that the postings service filters by, and the rows of one of its pages.
LEVER_FILTERS = ("location", "department", "team", "commitment", "level")
LEVER_LIMIT = 50
MICROSOFT_LINK = "https://jobs.careers.microsoft.com/global/en/job/"


def inside(inner: DataFrame, *outer: DataFrame) -> DataFrame:
    """Nodes of `inner` that lie in a node of the last of `outer`, which lies in one of the one before it, and so on."""
    area = outer[0]
    for nodes in outer[1:]:
        area = within(nodes, area)
    return within(inner, area)


def links(nodes: DataFrame) -> DataFrame:
    return nodes.where((F.col("tag") == "a") & attr("href").isNotNull())


def in_page_urls(nodes: DataFrame) -> DataFrame:
    """SRC-12: page_id, url, link of the distinct absolute links of a page whose path has /jobs/ and something after it."""
    found = links(nodes).withColumn("link", urls.absolute(attr("href"), F.col("url")))
    return found.where(urls.path(F.col("link")).rlike(r"/jobs/[^/]+")).select(*PAGE, "link").distinct()


def detail_titles(nodes: DataFrame) -> DataFrame:
    """link, title: the text of the first h1 of each detail page; one page for each URL, the first by page_id."""
    first = nodes.where("tag = 'h1'").groupBy(*PAGE).agg(F.min_by("text", "node_id").alias("title"))
    first = first.where("title <> ''")
    return first.groupBy("url").agg(F.min_by("title", "page_id").alias("title")).withColumnRenamed("url", "link")


def _titled(listed: DataFrame, details: DataFrame) -> DataFrame:
    """JOIN-11: listed (page, pos, link, key) with the titles of their detail pages; of each key the first that has one."""
    joined = listed.join(detail_titles(details), "link")
    return first_wins(joined, [*PAGE, "key"], ["pos"]).select(*PAGE, "pos", "title", "link")


def _hosted(found: DataFrame, link, key) -> DataFrame:
    placed = found.select(*PAGE, F.col("node_id").cast("long").alias("pos"), link.alias("bare"))
    placed = placed.where("bare IS NOT NULL").withColumn("link", urls.canonical(F.col("bare")))
    return placed.select(*PAGE, "pos", "link", F.coalesce(key(F.col("bare")), F.col("link")).alias("key"))


def from_greenhouse(nodes: DataFrame, details: DataFrame) -> DataFrame:
    """ADP-7: anchors in cells of posting rows; titles from the detail pages."""
    rows = nodes.where((F.col("tag") == "tr") & has_class("job-post"))
    cells = nodes.where((F.col("tag") == "td") & has_class("cell"))
    found = inside(links(nodes), rows, cells)
    return _titled(_hosted(found, urls.greenhouse_link(attr("href"), F.col("url")), urls.greenhouse_id), details)


def from_ashby(nodes: DataFrame, details: DataFrame) -> DataFrame:
    """ADP-8: anchors below the organisation with a dash; on pages without any, anchors with an id in their path."""
    href, org = attr("href"), urls.org_slug(F.col("url"))
    found = links(nodes).withColumn("own", F.coalesce(href.startswith(F.concat(F.lit("/"), org, F.lit("/"))) & href.contains("-"), F.lit(False)))
    some = found.where("own").select(*PAGE).distinct()
    other = found.join(some, PAGE, "left_anti").where(urls.path(href).rlike(urls.ASHBY_PATH))
    chosen = found.where("own").unionByName(other)
    return _titled(_hosted(chosen, urls.ashby_link(attr("href"), F.col("url")), urls.ashby_id), details)


def from_join(nodes: DataFrame, details: DataFrame) -> DataFrame:
    """ADP-6: anchors marked as links of cards; titles from the detail pages."""
    # written, so that no task parses and resolves at once, each in a Python process of its own
    found = stored(links(nodes).where(attr("data-testid") == "Link").select(*PAGE, "node_id", "attrs"))
    return _titled(_hosted(found, urls.join_link(attr("href"), F.col("url")), lambda x: F.lit(None).cast("string")), details)


def from_workday(nodes: DataFrame) -> DataFrame:
    """ADP-5: anchors marked as job titles; requisition ids, sought in link, title and address, tell postings apart."""
    found = links(nodes).where((attr("data-automation-id") == "jobTitle") & (F.col("text") != ""))
    whole = urls.absolute(urls.unescaped(attr("href")), F.col("url"))
    placed = found.select(*PAGE, F.col("node_id").cast("long").alias("pos"), F.col("text").alias("title"), whole.alias("whole"))
    placed = placed.where("whole IS NOT NULL").withColumn("link", urls.canonical(urls.details_url(F.col("whole"))))
    key = F.coalesce(*(urls.requisition_id(F.col(c)) for c in ("link", "title", "whole")), F.col("link"))
    return first_wins(placed.withColumn("key", key), [*PAGE, "key"], ["pos"]).select(*PAGE, "pos", "title", "link", "key")


def from_microsoft(nodes: DataFrame) -> DataFrame:
    """ADP-3: list cells with a heading and an id in a label or, failing that, in any attribute."""
    cell = (attr("role") == "listitem") & has_class("ms-List-cell")
    app = nodes.where(attr("id") == "job-search-app")
    items = nodes.where(cell & (F.col("tag") == "div")).unionByName(inside(nodes.where(cell), app)).select(*PAGE, F.col("node_id").alias("i"), F.col("last_desc").alias("e")).distinct()
    within = items.join(nodes, PAGE).where("node_id > i AND node_id <= e")
    label = F.nullif(F.regexp_extract(attr("aria-label"), r"(?iU)\bJob item\s+(\d{6,})\b", 1), F.lit(""))
    # digit runs of the attributes in their order: 6 to 8 digits first, then the shortest, then the first
    values = F.map_values("attrs")
    runs = F.flatten(F.transform(values, lambda v: F.regexp_extract_all(v, F.lit(r"(\d{6,})"), 1)))
    ranked = F.transform(runs, lambda d, k: F.struct((F.length(d) > 8).cast("int").alias("l"), F.length(d).alias("n"), F.col("node_id").alias("at"), k.alias("k"), d.alias("d")))
    facts = within.groupBy(*PAGE, "i").agg(
        F.min_by(label, F.when(label.isNotNull(), F.col("node_id"))).alias("said"), F.min(F.array_min(ranked)).alias("best"),
        F.min_by("text", F.when(F.col("tag") == "h2", F.col("node_id"))).alias("title"),
    )
    found = facts.withColumn("key", F.coalesce("said", "best.d")).where("key IS NOT NULL AND title <> ''")
    link = urls.canonical(F.concat(F.lit(MICROSOFT_LINK), F.col("key"), F.lit("/"), urls.microsoft_slug(F.col("title"))))
    placed = found.select(*PAGE, F.col("i").cast("long").alias("pos"), "title", link.alias("link"), "key")
    return first_wins(placed, [*PAGE, "key"], ["pos"])


def from_proton(nodes: DataFrame, terms: list[str] | None = None, most: int = 2) -> DataFrame:
    """ADP-4: anchors of the rows of the departments' tables, badges left out, filtered by location if there are terms."""
    nodes = stored(nodes)  # what follows reads them many times: they are parsed once
    clean = stored(without(nodes, "tag-container"))
    tables = nodes.where(has_class("job-posts--table--department"))
    rows = nodes.where((F.col("tag") == "tr") & has_class("job-post"))
    found = inside(links(clean), tables, rows)
    bodies = clean.where(has_class("body")).select(*PAGE, F.col("node_id").alias("b"), "attrs", "text")
    parts = contained(found.select(*PAGE, "node_id", "last_desc"), bodies, "b").withColumnRenamed("node_id", "a")
    body = has_class("body--medium")
    place = has_class("body__secondary") & has_class("body--metadata")
    told = parts.groupBy(*PAGE, "a").agg(
        F.min_by("text", F.when(body, F.col("b"))).alias("medium"), F.min_by("text", F.when(place, F.col("b"))).alias("place"),
    )
    # an anchor's own text stands for a title that is not marked
    plain = nodes.select(*PAGE, F.col("node_id").alias("a"), F.col("text").alias("whole"))
    found = found.select(*PAGE, F.col("node_id").alias("a"), attr("href").alias("href"))
    found = met(met(found, told, [*PAGE, "a"], "left"), plain, [*PAGE, "a"])
    link = urls.canonical(urls.absolute(F.col("href"), urls.proton_list(F.col("url"))))
    listed = found.select(
        *PAGE, F.col("a").cast("long").alias("pos"), F.coalesce("medium", "whole").alias("title"), link.alias("link"),
        texts.split_locations(F.col("place")).alias("places"),
    ).where("title <> '' AND link <> ''")
    return places.at_places(listed, "places", terms or [], most)


def until_nothing_new(rows: DataFrame, pages: DataFrame, board: str = "board") -> DataFrame:
    """LIM-5, PAG-6: of a board's pages, in order, the rows with a key that no earlier one has, up to the first page
    that adds none.

    rows: board, page_no, pos, key and others; pages: board, page_no of all pages there are. Counts are by page, so a
    board's window holds its pages, not its postings.
    """
    new = first_wins(rows, [board, "key"], ["page_no", "pos"])
    added = pages.select(board, "page_no").distinct().join(new.groupBy(board, "page_no").agg(F.count("*").alias("n")), [board, "page_no"], "left")
    stops = added.where("n IS NULL").groupBy(board).agg(F.min("page_no").alias("stop"))
    return new.join(stops, board, "left").where("stop IS NULL OR page_no < stop").drop("stop")


def lever_requests(boards: DataFrame, max_pages: int = 5) -> DataFrame:
    """SRC-10, FLT-10: url, site, posting, page_no, api_url, other_url of the calls that a board's URL asks for.

    other_url is the same call in the other region, for a call that fails. A URL with a second segment asks for one
    posting; else pages of a list, filtered by the allowed parameters of the URL (several values of one are alternatives).
    """
    url = F.col("url")
    parts = urls.segments(urls.path(url))
    allowed = F.filter(urls.pairs(url), lambda p: p["k"].isin(*LEVER_FILTERS) & (p["v"] != ""))
    # grouped by parameter in the order of the allowed ones, values in the order of the URL
    of = lambda k: F.filter(allowed, lambda p: p["k"] == k)
    ordered = F.flatten(F.array(*map(of, LEVER_FILTERS)))
    params = F.transform(ordered, lambda p: F.concat(F.lit("&"), p["k"], F.lit("="), urls.quoted(p["v"], "+")))
    rows = boards.select(
        "url", F.get(parts, 0).alias("site"), F.get(parts, 1).alias("posting"), urls.api_host(urls.host(url)).alias("host"), F.array_join(params, "").alias("params")
    ).where("site IS NOT NULL")
    pages = F.when(F.col("posting").isNull(), F.sequence(F.lit(0), F.lit(max_pages - 1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("page_no", F.explode(pages))
    skip = F.concat(F.lit("&skip="), F.col("page_no") * LEVER_LIMIT, F.lit(f"&limit={LEVER_LIMIT}"))
    tail = F.when(F.col("posting").isNull(), F.concat(F.lit("?mode=json"), F.col("params"), skip)).otherwise(F.concat(F.lit("/"), F.col("posting")))
    call = lambda host: F.concat(F.lit("https://"), host, F.lit("/v0/postings/"), F.col("site"), tail)
    other = F.when(F.col("host") == "api.lever.co", "api.eu.lever.co").otherwise("api.lever.co")
    return rows.select("url", "site", "posting", "page_no", call(F.col("host")).alias("api_url"), call(other).alias("other_url"))


def from_lever_pages(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """ADP-1: postings (url, page_no, pos, title, link) of the answers (url, status, html) to lever_requests().

    A call that failed is answered by the other region's. A list ends at its first page with fewer rows than a full one.
    Of calls alone it is told first who answers them; answers then stream past a table of those, and no join sorts their texts or rows.
    """
    good = answers.where("status = 200 AND html IS NOT NULL").select(F.col("url").alias("call"), F.col("html").alias("json"))
    known = good.select("call").distinct().withColumn("_known", F.lit(True))
    asked = requests.join(known.toDF("api_url", "_own"), "api_url", "left").join(known.toDF("other_url", "_other"), "other_url", "left")
    asked = asked.select("url", "site", "posting", "page_no", F.when(F.col("_own"), F.col("api_url")).when(F.col("_other"), F.col("other_url")).alias("call"))
    got = good.join(asked.where("call IS NOT NULL").hint("shuffle_hash"), "call")
    item = "struct<id:string,text:string,hostedUrl:string,applyUrl:string>"
    listed = (
        F.when(F.col("posting").isNotNull(), F.array(F.from_json("json", item)))
        .when(F.col("json").rlike(r"^\s*\["), F.from_json("json", f"array<{item}>"))
        .otherwise(F.from_json("json", f"struct<data:array<{item}>>")["data"])
    )
    got = got.select("url", "site", "posting", "page_no", F.coalesce(listed, F.array().cast(f"array<{item}>")).alias("rows"))
    # written, so that answers are parsed once and their rows need not be read for the stops
    got = stored(got.withColumn("n", F.size("rows")))
    short = got.where(F.col("n") < LEVER_LIMIT).select("url", "page_no").unionByName(asked.where("call IS NULL").select("url", "page_no"))
    stops = short.groupBy("url").agg(F.min("page_no").alias("stop"))
    got = got.join(stops.hint("shuffle_hash"), "url", "left").where("stop IS NULL OR page_no <= stop")
    rows = got.select("url", "site", "posting", "page_no", F.posexplode("rows").alias("pos", "p"))
    filled = lambda c: F.nullif(c, F.lit(""))
    made = F.concat(F.lit("https://jobs.lever.co/"), F.col("site"), F.lit("/"), F.col("p.id"))
    link = F.when(F.col("posting").isNotNull(), filled(F.col("p.hostedUrl"))).otherwise(F.coalesce(filled(F.col("p.hostedUrl")), filled(F.col("p.applyUrl")), made))
    placed = rows.select("url", "page_no", "pos", F.trim("p.text").alias("title"), link.alias("link"))
    return placed.where("title <> '' AND link IS NOT NULL")
