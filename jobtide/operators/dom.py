"""HTML pages as tables of nodes (DOM-1, DOM-2), and questions about single pages (FLT-5, DOM-4 to DOM-7, STR-6/7).

No page ends a job: markup that the parser does not know is a comment, as it is in browsers, and what nests deeper than
Python's JSON reader goes, or holds half a character, is skipped or replaced. A page's texts are kept once while it is read; nodes
are handed on in batches of bounded text, so memory is linear in the page however deep it nests.

Nodes are numbered in document order, and a node's descendants are those up to last_desc, so that `inside` is a range
condition within a page. Text is that of text nodes, stripped and joined by spaces; the text of scripts and styles is
their own only. Parsing is per page and Python's own parser; everything after it is in the JVM. A page is known by its
page_id and URL together, so rows that share a URL stay apart.
"""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions import texts
from jobtide.operators.selectors import PAGE, contained, met, within
from jobtide.operators.stored import stored

SCHEMA = "page_id long, url string, node_id int, parent_id int, last_desc int, tag string, attrs map<string,string>, own_text string, text string"
# Fixed values of the HTML standard: elements without an end tag.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
# Signs of a page that scripts fill.
MOUNT_IDS = ("__next", "root", "app")
MOUNT_ATTRIBUTES = ("data-reactroot", "ng-app", "data-buycard-app")
MOUNT_CLASS, SPINNER_CLASS = "search-results-app", "app-loading-spinner"
SCRIPT_HINTS = (
    "enable javascript", "turn on javascript", "requires javascript",
    "needs javascript", "please enable cookies", "disabled scripts",
)
#: Characters of text that are handed on at once.
BATCH_TEXT = 4_000_000
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[list] = []  # parent, last, tag, attrs, own text parts, first and end of the texts inside
        self.open: list[int] = []
        self.texts: list[str] = []  # in document order, so those inside a node are neighbours

    def handle_starttag(self, tag, attrs):
        found = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        self.nodes.append([self.open[-1] if self.open else -1, len(self.nodes), tag, found, [], len(self.texts), len(self.texts)])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def _close(self, at):
        for k in self.open[at:]:
            self.nodes[k][1], self.nodes[k][6] = len(self.nodes) - 1, len(self.texts)
        del self.open[at:]

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1):
            if self.nodes[self.open[at]][2] == tag:
                return self._close(at)

    def parse_marked_section(self, i, report=1):
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # an unknown keyword
            return self.parse_bogus_comment(i)

    def handle_data(self, data):
        if self.open and (text := data.strip()):
            self.nodes[self.open[-1]][4].append(text)
            if self.nodes[self.open[-1]][2] not in ("script", "style"):
                self.texts.append(text)


def parse(html: str, tags: set[str] | None = None, text_of: set[str] | None = None):
    """Rows of the nodes with these tags (all, if None), one by one; the text of what lies inside only for the tags of text_of."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree._close(0)
    for k, (parent, last, tag, attrs, parts, first, end) in enumerate(tree.nodes):
        if tags is None or tag in tags or "role" in attrs:
            wanted = text_of is None or tag in text_of or "role" in attrs
            yield k, parent, last, tag, list(attrs.items()), " ".join(parts), " ".join(tree.texts[first:end]) if wanted else None


def nodes(pages: DataFrame, tags: tuple[str, ...] | None = None, text_of: tuple[str, ...] | None = None) -> DataFrame:
    """pages (url, html, and page_id, if there) as nodes; a page without HTML has none.

    tags: the elements wanted, those with a role besides (all, if None). text_of: those whose text is wanted.
    """
    names, named = (None if x is None else set(x) for x in (tags, text_of))
    page_id = F.col("page_id").cast("long") if "page_id" in pages.columns else F.lit(0).cast("long")

    def run(batches):
        schema = pa.schema([
            ("page_id", pa.int64()), ("url", pa.string()), ("node_id", pa.int32()), ("parent_id", pa.int32()), ("last_desc", pa.int32()),
            ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())), ("own_text", pa.string()), ("text", pa.string()),
        ])
        def table(page, url, rows):
            columns = list(zip(*rows, strict=True))
            own = pa.array([page] * len(rows), pa.int64()), pa.array([url] * len(rows), pa.string())
            return pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(columns, schema.types[2:], strict=True))], schema=schema)

        for batch in batches:
            for page, url, html in ((x.as_py() for x in row) for row in zip(*batch.columns, strict=True)):  # one page at a time
                rows, size = [], 0
                for row in parse(html or "", names, named):
                    rows.append(row)
                    size += len(row[-1] or "") + len(row[-2])
                    if size > BATCH_TEXT:
                        yield table(page, url, rows)
                        rows, size = [], 0
                if rows:
                    yield table(page, url, rows)

    return pages.select(F.coalesce(page_id, F.lit(-1).cast("long")).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), "html").mapInArrow(run, SCHEMA)


def once(found: DataFrame, is_container, heads) -> tuple[DataFrame, DataFrame]:
    """Containers and headings of nodes, from one reading of them."""
    read = stored(found)
    return read.where(is_container).select(*PAGE, "node_id", "last_desc"), heads(read)


def attr(name: str) -> Column:
    return F.col("attrs")[name]


def has_class(name: str) -> Column:
    return F.coalesce(F.array_contains(F.split(attr("class"), r"\s+"), name), F.lit(False))


def headings(found: DataFrame) -> DataFrame:
    """Headings with text."""
    level = F.substring("tag", 2, 1).cast("int")
    return found.where(F.col("tag").isin(*HEADINGS)).select(*PAGE, F.col("node_id").alias("h"), level.alias("level"), F.regexp_replace("text", r"(?U)\s+", " ").alias("heading"))


def heading_texts(containers: DataFrame, heads: DataFrame) -> DataFrame:
    """STR-6, STR-7, AGG-10: for each container (page, node_id, last_desc) its longest and its highest heading's text.

    Of each level only the first heading counts for the highest; ties in length go to the first.
    """
    c = containers.select(*PAGE, "node_id", "last_desc").distinct()
    inside = contained(c, heads, "h")
    first = inside.groupBy(*PAGE, "node_id", "level").agg(
        F.min_by("heading", "h").alias("first"), F.max_by("heading", F.struct(F.length("heading"), -F.col("h"))).alias("longest"), F.min("h").alias("h")
    )
    filled = F.when(F.col("first") != "", F.col("first"))
    return first.groupBy(*PAGE, "node_id").agg(
        F.max_by("longest", F.struct(F.length("longest"), -F.col("h"))).alias("longest"),
        F.min_by(filled, F.when(filled.isNotNull(), F.col("level")).otherwise(9)).alias("highest"),
    )


def shell_features(found: DataFrame) -> DataFrame:
    """FLT-5, AGG-13: what tells a page that only scripts can fill; needs_script is the verdict."""
    mount = attr("id").isin(*MOUNT_IDS) | F.arrays_overlap(F.map_keys("attrs"), F.array(*map(F.lit, MOUNT_ATTRIBUTES))) | has_class(MOUNT_CLASS)
    body = F.lower(F.min_by("text", F.when(F.col("tag") == "body", F.col("node_id"))))
    content = F.coalesce(
        F.min_by(F.when(F.col("tag") == "main", F.col("text")), F.when(F.col("tag") == "main", F.col("node_id"))),
        F.min_by(F.when(F.col("tag") == "body", F.col("text")), F.when(F.col("tag") == "body", F.col("node_id"))), F.lit(""),
    )
    made = found.groupBy(*PAGE).agg(
        F.count_if(~F.col("tag").isin("script", "style")).alias("nodes"), F.count_if(F.col("tag") == "script").alias("scripts"),
        F.length(content).alias("text_length"), F.coalesce(body.rlike("|".join(SCRIPT_HINTS)), F.lit(False)).alias("hint"),
        F.bool_or(F.coalesce(mount, F.lit(False))).alias("mount"), F.bool_or(has_class(SPINNER_CLASS)).alias("spinner"),
    )
    small = (F.col("nodes") < 15) & (F.col("scripts") >= 3)
    thin = (F.col("nodes") > 200) & (F.col("text_length") < 800) & (F.col("scripts") >= 3)
    return made.withColumn("needs_script", small | thin | F.col("hint") | F.col("mount") | F.col("spinner"))


SHELL_TEXT = ("body", "main")


def keyed(pages: DataFrame) -> DataFrame:
    """pages with page_id and url as nodes() has them."""
    page_id = F.col("page_id").cast("long") if "page_id" in pages.columns else F.lit(0).cast("long")
    return pages.withColumns({"page_id": F.coalesce(page_id, F.lit(-1).cast("long")), "url": F.coalesce("url", F.lit(""))})


def shells(pages: DataFrame) -> DataFrame:
    """FLT-5 for every page (url, html and its other columns): one without HTML needs scripts, one without nodes has counts of 0."""
    features = shell_features(nodes(pages, text_of=SHELL_TEXT))
    found = keyed(pages).join(features, PAGE, "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("nodes", "scripts", "text_length")}
    signs = {c: F.coalesce(c, F.lit(False)) for c in ("hint", "mount", "spinner")}
    needs = F.coalesce(F.col("html") == "", F.lit(True)) | F.coalesce("needs_script", F.lit(False))
    return found.withColumns({**counts, **signs, "needs_script": needs})


def whole_characters(text: str) -> str:
    """text with ? for halves of surrogate pairs, which no column can hold."""
    return text.encode("utf-8", "replace").decode()


@F.udf(T.StringType(), useArrow=True)
def _jsonld_title(scripts):
    """JSN-4: of the scripts' items the first one's title or name; a script that cannot be read ends the search."""
    try:
        for script in scripts:
            data = json.loads(script)
            for item in data if isinstance(data, list) else [data]:
                if isinstance(item, dict) and (title := (item.get("title") or item.get("name") or "").strip()):
                    return whole_characters(title)
    except (AttributeError, RecursionError, ValueError):
        pass
    return None


#: Elements that detail_titles() looks at, besides those with a role.
TITLE_TAGS = ("div", "h1", "h2", "script", "meta", "title")


def detail_titles(found: DataFrame) -> DataFrame:
    """DOM-4, DOM-6, JSN-4: a page's title from the first source that has one: marked div, role, h1, h2, JSON-LD, og:title, title.

    A source is its first element, cleaned (STR-12): a boilerplate title falls through to the next source.
    """
    def cleaned(value):
        return F.nullif(texts.cleaned_title(value), F.lit(""))

    def first(condition, value="text"):
        return F.min_by(value, F.when(condition, F.col("node_id")))

    tag = F.col("tag")
    is_jsonld = (tag == "script") & (attr("type") == "application/ld+json")
    sources = found.groupBy(*PAGE).agg(
        first((tag == "div") & attr("class").contains("_army")).alias("marked"), first(attr("role") == "heading").alias("role"),
        first(tag == "h1").alias("h1"), first(tag == "h2").alias("h2"),
        F.array_sort(F.collect_list(F.when(is_jsonld, F.struct("node_id", "own_text")))).alias("scripts"),
        first((tag == "meta") & (attr("property") == "og:title"), attr("content")).alias("og"), first(tag == "title").alias("document"),
    )
    sources = sources.withColumn("jsonld", _jsonld_title("scripts.own_text"))
    return sources.select(*PAGE, F.coalesce(*map(cleaned, ("marked", "role", "h1", "h2", "jsonld", "og", "document"))).alias("title"))


def without(found: DataFrame, class_name: str) -> DataFrame:
    """DOM-5: nodes less those inside an element of a class, and that element; their texts are made anew of what is left.

    found: all nodes of a page, with their texts.
    """
    removed = found.where(has_class(class_name)).select(*PAGE, "node_id", "last_desc")
    gone = within(found, removed).select(*PAGE, "node_id").unionByName(removed.select(*PAGE, "node_id")).distinct()
    left = met(found, gone, [*PAGE, "node_id"], "left_anti")
    holders = contained(left.select(*PAGE, "node_id", "last_desc"), removed.select(*PAGE, F.col("node_id").alias("r")), "r").drop("r").distinct()
    said = left.where(~F.col("tag").isin("script", "style") & (F.col("own_text") != "")).select(*PAGE, F.col("node_id").alias("t"), "own_text")
    parts = contained(holders, said, "t").unionByName(met(holders, said.withColumn("node_id", F.col("t")), [*PAGE, "node_id"]))
    made = parts.groupBy(*PAGE, "node_id").agg(F.array_sort(F.collect_list(F.struct("t", "own_text"))).alias("p"))
    made = made.select(*PAGE, "node_id", F.array_join("p.own_text", " ").alias("_text"))
    held = holders.select(*PAGE, "node_id", F.lit(True).alias("_held"))
    out = met(met(left, held, [*PAGE, "node_id"], "left"), made, [*PAGE, "node_id"], "left")
    return out.withColumn("text", F.when(F.col("_held"), F.coalesce("_text", F.lit(""))).otherwise(F.col("text"))).drop("_held", "_text")
