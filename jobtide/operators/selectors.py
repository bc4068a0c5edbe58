"""Structure within pages in linear work, and nodes chosen by CSS selectors (DOM-1, DOM-3, EXT-3, JOIN-5).

A node's descendants are those numbered from node_id + 1 to last_desc. Whether a node lies in any of some others is one
running maximum over its page in document order: of the chosen nodes before it, does one reach as far as it? Pairs of
nodes, one inside the other, are a join by equality: the range of descendants is made of aligned stretches, at most two
of a length, and an inner node looks for the stretches that it is in. Neither pairs all nodes of a page.

Selectors know elements, *, #id, .class, [attribute] with =, ^=, $=, *=, ~= and |=, :not(...) of a compound, descendants (a space),
children (>) and alternatives (,). Anything else is an error.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = ["page_id", "url"]
_STEP = re.compile(r"\s*(>|,|\s)\s*")
_PART = re.compile(
    r"""(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<class>[\w-]+)|:not\((?P<no>(?:[^()"']|"[^"]*"|'[^']*')*)\)"""
    r"""|\[\s*(?P<name>[\w:-]+)\s*(?:(?P<how>[~|^$*]?=)\s*(?:"(?P<d>[^"]*)"|'(?P<s>[^']*)'|(?P<b>[^\]\s"']+))\s*)?\]"""
)


def met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left joined with right by a shuffle: both grow with the pages, and a written table's size on disk tells little of what it takes in the driver."""
    return left.join(right.hint("merge"), on, how)


def _shifted(x: Column, k: Column) -> Column:
    return F.call_function("shiftright", x, k)


def _levels(x: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.log2(F.greatest(x, F.lit(1)))).cast("int")))


def contained(outer: DataFrame, inner: DataFrame, at: str) -> DataFrame:
    """Rows of outer (page, node_id, last_desc and others) with the rows of inner (page, at and others) that lie inside."""
    lo, hi = F.col("node_id") + 1, F.col("last_desc") + 1
    stretch = lambda k, b: F.struct(k.alias("k"), b.alias("b"))

    def of(k):
        first, end = _shifted(lo + F.call_function("shiftleft", F.lit(1), k) - 1, k), _shifted(hi, k)
        some = first < end
        return F.array(F.when(some & (first % 2 == 1), stretch(k, first)), F.when(some & (end % 2 == 1), stretch(k, end - 1)))

    cut = F.filter(F.flatten(F.transform(_levels(hi), of)), lambda x: x.isNotNull())
    # a stretch that begins at the first node is in no range, so an inner node looks up as many lengths as its number has digits
    bins = F.when(F.col(at) > 0, F.transform(_levels(F.col(at)), lambda k: stretch(k, _shifted(F.col(at), k)))).otherwise(F.array())
    left = outer.withColumn("_e", F.explode(cut)).withColumns({"_k": F.col("_e.k"), "_b": F.col("_e.b")}).drop("_e")
    right = inner.withColumn("_e", F.explode(bins)).withColumns({"_k": F.col("_e.k"), "_b": F.col("_e.b")}).drop("_e")
    return met(left, right, [*PAGE, "_k", "_b"]).drop("_k", "_b")


def _within(chosen: Column) -> Column:
    """Whether a node lies inside a chosen one of its page."""
    before = Window.partitionBy(*PAGE).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(chosen, F.col("last_desc"))).over(before) >= F.col("node_id"), F.lit(False))


def within(nodes: DataFrame, area: DataFrame) -> DataFrame:
    """The nodes that lie inside a node of area (page, node_id, last_desc)."""
    marks = area.select(*PAGE, "node_id", F.col("last_desc").alias("_last")).distinct()
    every = nodes.select(*PAGE, "node_id").unionByName(marks, True)
    # of one number the node itself comes before its mark: no node is inside itself
    order = Window.partitionBy(*PAGE).orderBy("node_id", F.col("_last").isNotNull())
    reach = F.max("_last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    good = every.withColumn("_reach", reach).where("_last IS NULL AND _reach >= node_id")
    return met(nodes, good.select(*PAGE, "node_id"), [*PAGE, "node_id"], "left_semi")


def _compound(text: str) -> Column:
    """The condition on a node of a compound selector."""
    attrs, good, at = F.col("attrs"), F.lit(True), 0
    classes = F.coalesce(F.split(F.trim(attrs["class"]), r"\s+"), F.array().cast("array<string>"))
    while at < len(text):
        m = _PART.match(text, at)
        if not m or m["tag"] and at:
            raise ValueError(f"not a selector: {text!r}")
        at = m.end()
        if m["tag"]:
            good = good if m["tag"] == "*" else good & (F.col("tag") == m["tag"].lower())
        elif m["id"]:
            good = good & F.coalesce(attrs["id"] == m["id"], F.lit(False))
        elif m["class"]:
            good = good & F.array_contains(classes, m["class"])
        elif m["no"] is not None:
            good = good & ~_compound(m["no"].strip())
        else:
            value = attrs[m["name"].lower()]
            wanted = next((m[k] for k in ("d", "s", "b") if m[k] is not None), None)
            found = {
                None: value.isNotNull(), "=": value == wanted, "^=": value.startswith(wanted or ""), "$=": value.endswith(wanted or ""), "*=": value.contains(wanted or ""),
                "~=": F.array_contains(F.split(F.trim(value), r"\s+"), wanted or ""), "|=": (value == wanted) | value.startswith(f"{wanted}-"),
            }[m["how"]]
            if m["how"] in ("^=", "$=", "*=", "~=") and not wanted:
                found = F.lit(False)
            good = good & F.coalesce(found, F.lit(False))
    return good


def parsed(selector: str) -> list[list[tuple[str, str]]]:
    """Alternatives, each a list of (how it follows the one before: '' first, ' ' or '>', compound)."""
    out: list[list[tuple[str, str]]] = [[]]
    how, at, text = "", 0, selector.strip()
    while True:
        begun = at
        while at < len(text) and (m := _PART.match(text, at)):
            at = m.end()
        if at == begun:
            raise ValueError(f"not a selector: {selector!r}")
        out[-1].append((how, text[begun:at]))
        if at == len(text):
            return out
        step = _STEP.match(text, at)
        if not step:
            raise ValueError(f"not a selector: {selector!r}")
        at, how = step.end(), step[1] if step[1] in (">", ",") else " "
        if how == ",":
            out.append([])
            how = ""


def select(nodes: DataFrame, selector: str) -> DataFrame:
    """The nodes that a selector matches, each once. nodes: of whole pages, or of all elements that the selector names."""
    chains = parsed(selector)
    found = nodes
    for i, chain in enumerate(chains):
        for how, text in chain:
            good = _compound(text)
            if how == " ":
                good = good & _within(F.col(f"_m{i}"))
            elif how == ">":
                parents = found.where(f"_m{i}").select(*PAGE, F.col("node_id").alias("parent_id"), F.lit(True).alias("_up"))
                found = met(found, parents, [*PAGE, "parent_id"], "left")
                good = good & F.coalesce("_up", F.lit(False))
            found = found.withColumn(f"_m{i}", good).drop("_up")
    return found.where(" OR ".join(f"_m{i}" for i in range(len(chains)))).select(*nodes.columns)
