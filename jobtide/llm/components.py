"""Connected components by contraction: no links, components or labels come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.batches import Scratch


def _roots(merged: DataFrame, scratch: Scratch) -> DataFrame:
    """from, to with every `to` followed to its end, by pointer doubling: the steps are the logarithm of the longest way."""
    while True:
        further = merged.toDF("to", "next")
        doubled = scratch.table(merged.join(further, "to").select("from", F.col("next").alias("to"), (F.col("next") != F.col("to")).alias("moved")))
        scratch.drop(merged)
        merged = doubled.select("from", "to")
        merged._scratch_path = doubled._scratch_path
        if not doubled.where("moved").limit(1).count():
            return merged


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """v, label of every end of links (a long, b long); label is the smallest id that v reaches.

    In each round every vertex merges into its smallest neighbour (or stays, if it is smaller) and on along the way of
    such steps to its end, a vertex smaller than all its neighbours; the links between what is left are deduplicated,
    and the labels follow. Each end takes a neighbour at least with it, so a round at least halves the vertices that
    still have links, and the smallest of a component survives to its end. Ways are followed by pointer doubling, so a
    path in the order of its ids is one round. What a round leaves is written to the shared folder.

    Edge cases: links of a vertex with itself are no links; repeated links count once; no links give no rows.
    """
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = scratch.table(links)
    labels = scratch.table(
        links.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("label"))
    )
    while links.limit(1).count():
        ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        merged = ends.groupBy(F.col("e.a").alias("from")).agg(F.least(F.col("from"), F.min("e.b")).alias("to"))
        merged = _roots(scratch.table(merged), scratch)
        moved = (
            links.join(merged.toDF("a", "x"), "a").join(merged.toDF("b", "y"), "b").where("x <> y")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        new_links = scratch.table(moved)
        followed = labels.join(merged.toDF("label", "next"), "label", "left")
        new_labels = scratch.table(followed.select("v", F.coalesce("next", "label").alias("label")))
        scratch.drop(links, labels, merged)
        links, labels = new_links, new_labels
    scratch.drop(links)
    return labels
