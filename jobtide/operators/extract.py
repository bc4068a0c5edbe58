"""Postings from nodes of pages: four extractors, of which a page's first non-empty one wins (LIM-3, EXP-2).

Each gives (page_id, url, priority, pos, title, link). Anchors are resolved and judged once, in the JVM; what lies inside a list,
an item or an anchor is joined by aligned stretches of the page, and every choice of `the first` is an aggregate with an order.
"""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.functions import texts, urls
from jobtide.operators.dom import HEADINGS, PAGE, attr, has_class, heading_texts, headings, whole_characters
from jobtide.operators.history import first_wins
from jobtide.operators.selectors import contained, met
from jobtide.operators.stored import stored

# Fixed value. Words in the label of a list of postings.
LIST_WORDS = "job|career|vacan|opening|position"
LEAST_CHILDREN = 3
#: Elements whose text the extractors read, besides those with a role.
TEXT_OF = ("a", "span", *HEADINGS)


def flattened(payload) -> list[dict]:
    """JSN-1: every object reached through lists, @graph, mainEntity and item, in order."""
    out, todo = [], [payload]
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            out.append(x)
            inner = [*(x["@graph"] if isinstance(x.get("@graph"), list) else ()), *(x[k] for k in ("mainEntity", "item") if isinstance(x.get(k), dict))]
            todo += reversed(inner)
    return out


def postings_in(raw: str | None) -> list[dict]:
    """JSN-2, JSN-3: title and url of the postings of a JSON-LD script; malformed JSON and odd types give none."""
    try:
        found = flattened(json.loads((raw or "").strip()))
    except (RecursionError, ValueError):
        return []
    out = []
    for x in found:
        kind = x.get("@type")
        if kind == "JobPosting" or isinstance(kind, list) and "JobPosting" in kind:
            title, link = x.get("title") or x.get("name"), x.get("url") or x.get("applicationUrl")
            if isinstance(title, str) and isinstance(link, str) and title.strip() and link.strip():
                out.append({"title": whole_characters(title.strip()), "ref": whole_characters(link.strip())})
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("ref", T.StringType())])))
def _postings(raw: pd.Series) -> pd.Series:
    return raw.map(postings_in)


def anchors(nodes: DataFrame) -> DataFrame:
    """Anchors with a link: resolved, judged (URL-7), canonical (URL-3), with the titles of their attributes and text."""
    found = nodes.where((F.col("tag") == "a") & attr("href").isNotNull()).withColumn("ref", urls.absolute(attr("href"), F.col("url")))
    return found.where("ref IS NOT NULL").select(
        *PAGE, F.col("node_id").alias("a"), F.col("last_desc").alias("a_last"), urls.canonical(F.col("ref")).alias("link"), urls.is_detail(F.col("ref")).alias("detail"),
        F.coalesce(attr("data-automation-id") == "jobTitle", F.lit(False)).alias("marked"), has_class("jobTitle").alias("classed"),
        has_class("posting-title").alias("posting"), texts.label_title(attr("aria-label")).alias("label"),
        texts.anchor_title(F.col("text"), attr("title")).alias("words"),
        texts.attribute_title(attr("data-component-link"), attr("aria-label"), attr("title")).alias("named"),
    )


def _filled(*columns):
    return F.coalesce(*(F.nullif(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns))


def from_jsonld(nodes: DataFrame) -> DataFrame:
    scripts = nodes.where((F.col("tag") == "script") & (attr("type") == "application/ld+json"))
    # written, so that no task parses pages and scripts at once, each in a Python process of its own
    found = stored(scripts.select(*PAGE, "node_id", "own_text")).select(*PAGE, "node_id", F.posexplode(_postings("own_text")).alias("i", "p")).withColumn("ref", urls.absolute(F.col("p.ref"), F.col("url")))
    kept = found.where(urls.is_detail(F.col("ref")))
    return kept.select(*PAGE, F.lit(1).alias("priority"), (F.col("node_id").cast("long") * 1_000_000 + F.col("i")).alias("pos"), "p.title", urls.canonical(F.col("ref")).alias("link"))


def from_lists(nodes: DataFrame, found: DataFrame, heads: DataFrame) -> DataFrame:
    lists = nodes.where(F.col("tag").isin("ul", "ol"))
    labelled = lists.where(F.lower(attr("aria-label")).rlike(LIST_WORDS)).select(*PAGE, "node_id", "last_desc")
    counted = contained(lists.select(*PAGE, "node_id", "last_desc"), found, "a").groupBy(*PAGE, "node_id", "last_desc")
    several = counted.agg(F.count_if("marked").alias("m"), F.count_if("detail").alias("d")).where("m >= 2 OR d >= 2")
    # written, as what follows reads both several times, and a plan that held each reading would outgrow the driver
    chosen = stored(labelled.unionByName(several.select(*PAGE, "node_id", "last_desc")).distinct())
    items = nodes.where((F.col("tag") == "li") | ((F.col("tag") == "div") & (attr("role") == "listitem"))).select(*PAGE, "node_id", "last_desc")
    within = contained(chosen, items.toDF(*PAGE, "item", "item_last"), "item").select(*PAGE, F.col("node_id").alias("list"), F.col("item").alias("node_id"), F.col("item_last").alias("last_desc"))
    others = met(items, chosen.select(*PAGE).distinct(), PAGE, "left_anti").withColumn("list", F.lit(0))
    items = stored(within.select(*PAGE, "list", "node_id", "last_desc").unionByName(others.select(*PAGE, "list", "node_id", "last_desc")))
    first = F.struct((~F.col("marked")).cast("int"), "a")
    usable = contained(items, found, "a")
    other = F.when(_filled("label", "words").isNotNull(), F.col("a"))
    picked = usable.groupBy(*PAGE, "list", "node_id", "last_desc").agg(
        F.min_by(F.struct("link", "label", "words"), F.when(F.col("marked") | F.col("detail"), first)).alias("p"),
        F.max((F.col("marked") | F.col("detail"))).alias("has"), F.min_by(_filled("label", "words"), other).alias("other"),
    ).where("has")
    titled = met(picked, heading_texts(items, heads), [*PAGE, "node_id"], "left")
    spans = nodes.where((F.col("tag") == "span") & attr("class").contains("title") & (F.trim("text") != "")).select(*PAGE, F.col("node_id").alias("s"), F.col("text").alias("span_text"))
    spans = contained(items.select(*PAGE, "node_id", "last_desc").distinct(), spans, "s").groupBy(*PAGE, "node_id").agg(F.min_by("span_text", "s").alias("span"))
    titled = met(titled, spans, [*PAGE, "node_id"], "left").withColumn("title", F.trim(F.coalesce(_filled("longest", "p.label", "p.words"), "span", "other")))
    placed = titled.where("title <> ''").select(*PAGE, F.lit(2).alias("priority"), (F.col("list").cast("long") * 10_000_000 + F.col("node_id")).alias("pos"), "title", "p.link")
    return first_wins(placed, [*PAGE, "link"], ["pos"])


def prototypes(nodes: DataFrame, least: int = LEAST_CHILDREN) -> DataFrame:
    """AGG-8: (page_id, url, kind, key): tags and classes that several children of one container share."""
    containers = nodes.where(F.col("tag").isin("div", "section", "main", "article")).select(*PAGE, F.col("node_id").alias("parent_id"))
    children = met(nodes.withColumn("key", texts.class_key(attr("class"))).where(~texts.is_generic_class(F.col("key"))), containers, [*PAGE, "parent_id"])
    grouped = children.groupBy(*PAGE, "parent_id", F.col("tag").alias("kind"), "key").count()
    return grouped.where(F.col("count") >= least).select(*PAGE, "kind", "key").distinct()


def from_repeated(nodes: DataFrame, found: DataFrame, heads: DataFrame, least: int = LEAST_CHILDREN) -> DataFrame:
    keyed = nodes.withColumn("classes", F.split(F.coalesce(attr("class"), F.lit("")), r"\s+"))
    items = met(keyed, prototypes(nodes, least), PAGE).where((F.col("tag") == F.col("kind")) & (F.size(F.array_except(F.split("key", " "), "classes")) == 0))
    items = stored(items.select(*PAGE, "node_id", "last_desc").distinct())
    first = F.struct((~F.col("marked")).cast("int"), (~F.col("posting")).cast("int"), "a")
    picked = contained(items, found, "a").groupBy(*PAGE, "node_id", "last_desc").agg(F.min_by(F.struct("a", "link", "detail", "named", "words"), first).alias("p"))
    picked = met(picked.where("p.detail"), heading_texts(items, heads).select(*PAGE, "node_id", "longest"), [*PAGE, "node_id"], "left")
    in_anchor = heading_texts(found.select(*PAGE, F.col("a").alias("node_id"), F.col("a_last").alias("last_desc")), heads).select(*PAGE, F.col("node_id").alias("a"), F.col("longest").alias("inner"))
    titled = met(picked.withColumn("a", F.col("p.a")), in_anchor, [*PAGE, "a"], "left").withColumn("title", _filled("longest", "p.named", "p.words", "inner"))
    placed = titled.where("title IS NOT NULL").select(*PAGE, F.lit(3).alias("priority"), F.col("node_id").cast("long").alias("pos"), "title", "p.link")
    return first_wins(placed, [*PAGE, "link"], ["pos"])


def from_anchors(found: DataFrame, heads: DataFrame) -> DataFrame:
    own = heading_texts(found.select(*PAGE, F.col("a").alias("node_id"), F.col("a_last").alias("last_desc")), heads).select(*PAGE, F.col("node_id").alias("a"), "highest")
    judged = met(found, own, [*PAGE, "a"], "left").where(F.col("marked") | F.col("classed") | F.col("detail") | texts.is_heading(F.col("highest")))
    titled = judged.withColumn("title", _filled(F.trim("highest"), "label", "words")).where("title IS NOT NULL")
    return first_wins(titled.select(*PAGE, F.lit(4).alias("priority"), F.col("a").cast("long").alias("pos"), "title", "link"), [*PAGE, "link"], ["pos"])


def first_filled(candidates: DataFrame) -> DataFrame:
    """LIM-3: of each page the candidates of its smallest priority; pages are joined to a minimum, not sorted."""
    best = candidates.groupBy(*PAGE).agg(F.min("priority").alias("priority"))
    return met(candidates, best, [*PAGE, "priority"])


def postings(nodes: DataFrame) -> DataFrame:
    # resolving and judging links is the dearest part, and every extractor but the first reads them
    found, heads = stored(anchors(nodes)), stored(headings(nodes))
    # one plan for each extractor: that of all four, twice over for the minimum, is kept and planned anew in the driver as each stage ends
    every = (stored(x) for x in (from_jsonld(nodes), from_lists(nodes, found, heads), from_repeated(nodes, found, heads), from_anchors(found, heads)))
    return first_filled(reduce(DataFrame.unionByName, every))


def from_lever(payloads: DataFrame) -> DataFrame:
    """JSN-5: payloads (site, host, json) of postings, listed plainly or under `data`."""
    item = "struct<id:string,text:string,hostedUrl:string,applyUrl:string>"
    plain = F.col("json").rlike(r"^\s*\[")
    listed = F.when(plain, F.from_json("json", f"array<{item}>")).otherwise(F.from_json("json", f"struct<data:array<{item}>>")["data"])
    kept = payloads.select("site", "host", F.posexplode(listed).alias("pos", "p"))
    link = _filled("p.hostedUrl", "p.applyUrl", F.concat(F.lit("https://"), F.col("host"), F.lit("/"), F.col("site"), F.lit("/"), F.col("p.id")))
    placed = kept.select("site", "pos", F.trim("p.text").alias("title"), urls.canonical(link).alias("link")).where("title <> '' AND link IS NOT NULL")
    return first_wins(placed, ["site", "link"], ["pos"])
