"""Prefix trie of conversations: succinct level-order tries in shards of prefixes, heavy upper levels merged apart.

Conversations are rebuilt first: conversation c takes the first h turns of c - c % 5 (all, if there are fewer; none, if there is
no such conversation) and then its own after its first h, h being the unsigned crc32 of its decimal id modulo 9. All of this
happens within a family c - c % 5, so one exchange serves it. A node is known by its depth and 128 bits: the exclusive or of
hashes of (place, role, text) over its turns, a running aggregate along the conversation. Counts, smallest member and what a node
itself saves are map-side sums by node, so that copies of a conversation are folded before they meet.

Sums over subtrees are made in shards. A node's weight is the number of turns at and below it in all conversations that pass
through it, which bounds the nodes of its subtree; nodes of weight up to LIGHT are light, heavier ones lie in higher tiers, each
tier STEP times as heavy (the root always on top). The part of a tier below one topmost node is a tree of at most LIGHT nodes, or STEP
a level; such trees are dealt by hash into shards of about SHARD_NODES nodes. A shard's forest becomes a LOUDS bit vector (level order, a 1 for each child and a 0 after
them) with label arrays, built by numpy; parents are read off the bits, and one pass from the last level to the first adds children to
their parents. What the topmost nodes of a tier's trees hold is summed by parent before the next tier takes it over, so a node with
many children never meets them in one task. There are as many tiers as the logarithm of the heaviest weight.

The ids that end at a node are joined by ranges of 4096 ids first; a node's digest is then a stream over its ranges.

Edge cases: null roles and texts are empty; a null turn comes first; equal turns are ordered by role, then text, and repeated rows
are turns each; rows without a conversation's id belong to none and are left out; a negative id's family is the next multiple of 5 below; an empty
table has no node, not even a root; other columns of the input are not read. A very long text is hashed once; a very long
conversation is a sorted run of its task, on disk if it must.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.batches import Scratch, partitions

FAMILY, BORROWED = 5, 9
#: Weight over which nodes are merged apart, how many times as heavy the next tier is, and nodes of a shard, about.
LIGHT, STEP, SHARD_NODES = 2_000, 64, 50_000
#: Heavy nodes up to this number are broadcast (counted first), more are joined by an exchange.
FEW_HEAVY = 100_000
ID_RANGE = 4096
NODE = ["depth", "x", "y"]


def borrowed(c: Column) -> Column:
    """How many turns conversation c takes from the head of its family."""
    return (F.crc32(c.cast("string").cast("binary")) % BORROWED).cast("long")


def rebuilt(turns: DataFrame) -> DataFrame:
    """g, c, depth (from 0, a conversation without turns has this row only), x, y (of the sequence so far), size of its last text, total turns."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    c = F.col("conv_id")
    marked = turns.where(c.isNotNull()).select(
        (c - F.pmod(c, F.lit(FAMILY))).alias("g"), c.alias("c"), "turn", F.xxhash64(role, text).alias("u"), F.xxhash64(text, F.lit(1), role).alias("v"), F.octet_length(text).cast("long").alias("size"), role.alias("role"), text.alias("text")
    )
    family = Window.partitionBy("g")
    own = Window.partitionBy("g", "c").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    # of a repartition by g each window by g and more keeps the rows where they are
    placed = marked.repartition("g").withColumn("r", F.row_number().over(own).cast("long")).drop("role", "text", "turn")
    head = F.col("c") == F.col("g")
    placed = placed.withColumns({
        "head": F.coalesce(F.max(F.when(head, F.col("r"))).over(family), F.lit(0)),
        "there": F.array_sort(F.collect_set((F.col("c") - F.col("g")).cast("int")).over(family)),  # five at most
    })
    h = borrowed(F.col("c"))
    taken = F.least("head", h)
    # a head's own turns go to each of its family that borrows them; others' own turns follow what they borrowed
    to = F.when(head, F.filter("there", lambda d: (d == 0) | (F.col("r") <= borrowed(F.col("g") + d)))).otherwise(F.when(F.col("r") > h, F.array((F.col("c") - F.col("g")).cast("int"))).otherwise(F.expr("array()")))
    at = F.when(head, F.col("r")).otherwise(F.col("r") - h + taken)
    parts = F.transform(to, lambda d: F.struct(d.alias("d"), at.alias("depth"), F.col("u").alias("u"), F.col("v").alias("v"), F.col("size").alias("size")))
    # the first of each conversation's own turns brings its root along
    start = F.when(F.col("r") == 1, F.array(F.struct((F.col("c") - F.col("g")).cast("int").alias("d"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("u"), F.lit(0).cast("long").alias("v"), F.lit(0).cast("long").alias("size")))).otherwise(F.expr("array()"))
    spread = placed.select("g", F.explode(F.concat(start, parts)).alias("e")).select("g", (F.col("g") + F.col("e.d")).alias("c"), "e.depth", "e.u", "e.v", "e.size")
    way = Window.partitionBy("g", "c").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    salted = lambda *x: F.when(F.col("depth") > 0, F.xxhash64(*x)).otherwise(F.lit(0).cast("long"))
    spread = spread.withColumns({"x": salted("depth", "u", "v"), "y": salted("v", "u", "depth", F.lit(1))})
    return spread.select("g", "c", "depth", F.bit_xor("x").over(way).alias("x"), F.bit_xor("y").over(way).alias("y"), F.col("x").alias("own_x"), F.col("y").alias("own_y"), "size", F.max("depth").over(Window.partitionBy("g", "c")).alias("turns"))


def louds(parents: np.ndarray) -> np.ndarray:
    """The bits of a forest in level order below a super-root: for the super-root and each node, a 1 for each child and a 0.

    parents: of each node in level order the position of its parent, -1 for the topmost ones.
    """
    degrees = np.bincount(parents + 1, minlength=len(parents) + 1)
    bits = np.zeros(len(parents) * 2 + 1, np.uint8)
    bits[:] = 1
    bits[np.cumsum(degrees + 1) - 1] = 0
    return bits


def louds_parents(bits: np.ndarray) -> np.ndarray:
    """Of each node in level order the position of its parent, -1 for the topmost: the zeros before its own 1."""
    return np.cumsum(bits == 0)[bits == 1] - 1


def level_order(depth: np.ndarray, keys: np.ndarray, above: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parents, levels) of a forest: nodes by level, then by their parent's place; parents as places there, and where each level begins.

    keys, above: records that name a node and its parent; topmost nodes are those whose parent is not among the nodes.
    """
    by_key = np.argsort(keys, kind="stable")
    spot = np.searchsorted(keys[by_key], above).clip(0, max(len(keys) - 1, 0))
    parent = by_key[spot] if len(keys) else spot
    parent = np.where(keys[parent] == above, parent, -1)
    level = np.full(len(keys), -1)
    waiting = np.flatnonzero(parent < 0)
    children = np.argsort(parent, kind="stable")
    bounds = np.searchsorted(parent[children], np.arange(len(keys) + 1))
    order, parents, levels, placed = [], [], [0], 0
    while len(waiting):
        order.append(waiting)
        level[waiting] = placed + np.arange(len(waiting))
        parents.append(np.where(parent[waiting] < 0, -1, level[parent[waiting]]))
        placed += len(waiting)
        levels.append(placed)
        n = bounds[waiting + 1] - bounds[waiting]
        firsts = np.repeat(bounds[waiting] - np.cumsum(n) + n, n)
        waiting = children[firsts + np.arange(len(firsts))]
    return np.concatenate(order) if order else np.zeros(0, int), np.concatenate(parents) if parents else np.zeros(0, int), np.array(levels)


_SUMS = ["n_children", "n_leaves", "saved"]


def rolled_up(nodes: pd.DataFrame) -> pd.DataFrame:
    """A shard's nodes with sums over their subtrees and their parent's smallest member (null for topmost ones).

    n_children, n_leaves and saved come in with what lower tiers have added to each node.
    """
    key = np.dtype([("depth", "i8"), ("x", "i8"), ("y", "i8")])
    keys, above = np.empty(len(nodes), key), np.empty(len(nodes), key)
    for name, up in (("depth", "depth"), ("x", "up_x"), ("y", "up_y")):
        keys[name], above[name] = nodes[name], nodes[up]
    above["depth"] -= 1
    order, parents, levels = level_order(keys["depth"], keys, above)
    nodes = nodes.iloc[order].reset_index(drop=True)
    parents = louds_parents(louds(parents))  # the trie itself is the bits and the arrays of labels
    inner = parents >= 0
    children = nodes["n_children"].to_numpy().copy()
    np.add.at(children, parents[inner], 1)
    leaves = nodes["n_leaves"].to_numpy() + (children == 0)
    saved = nodes["saved"].to_numpy().copy()
    for a, b in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
        np.add.at(leaves, parents[a:b], leaves[a:b])
        np.add.at(saved, parents[a:b], saved[a:b])
    smallest = nodes["conv_id"].to_numpy()
    up = pd.array(np.where(inner, smallest[parents.clip(0)], 0) if len(nodes) else [], "Int64")
    up[~inner] = pd.NA
    return nodes.assign(n_children=children, n_leaves=leaves, saved=saved, parent_conv_id=up)[[*NODE, "up_x", "up_y", "conv_id", "n_convs", *_SUMS, "parent_conv_id"]]


def _beside(rows: DataFrame, heavy: DataFrame, n: int, on: list[str], how: str = "left") -> DataFrame:
    return rows.join(F.broadcast(heavy) if n <= FEW_HEAVY else heavy, on, how)


def ends_digest(ends: DataFrame) -> DataFrame:
    """depth, x, y, ends_sha256 of ends (depth, x, y, c; an id once): a node's ids in order, in ranges and then as a stream."""
    ranges = ends.groupBy(*NODE, F.floor(F.col("c") / ID_RANGE).alias("part")).agg(F.array_join(F.array_sort(F.collect_list("c")), ",").alias("ids"))

    def digests(batches):
        last, state = None, None
        for batch in batches:
            done, told = [], []
            for *node, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if node != last:
                    if last:
                        done.append(last)
                        told.append(state.hexdigest())
                    last, state = node, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([*(pa.array([d[k] for d in done], pa.int64()) for k in range(3)), pa.array(told, pa.string())], [*NODE, "ends_sha256"])
        if last:
            yield pa.RecordBatch.from_arrays([*(pa.array([last[k]], pa.int64()) for k in range(3)), pa.array([state.hexdigest()])], [*NODE, "ends_sha256"])

    streams = ranges.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "ids")
    return streams.mapInArrow(digests, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(turns: DataFrame, light: int = LIGHT, scratch: Scratch | None = None) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of each node of the rebuilt
    conversations of turns (conv_id, turn, role, text).
    """
    spark = turns.sparkSession
    scratch = scratch or Scratch(spark)
    rows = scratch.table(rebuilt(turns))
    below = F.col("turns") - F.col("depth") + 1
    weights = rows.groupBy(*NODE).agg(F.sum(below).alias("weight"))
    heavy = scratch.table(weights.where((F.col("weight") > light) | (F.col("depth") == 0)))
    n_heavy, top, bound = heavy.count(), 1, light
    most = heavy.agg(F.max("weight")).first()[0] or 0
    tier = F.lit(0)
    while bound < most:  # tiers are few: their bounds grow by a factor
        tier = F.when(F.col("weight") > bound, top).otherwise(tier)
        top, bound = top + 1, bound * STEP
    tier = F.when(F.col("depth") == 0, top).when(F.col("weight").isNull(), 0).otherwise(tier)
    marked = _beside(rows, heavy, n_heavy, NODE).withColumn("tier", tier).drop("weight")
    topmost = Window.partitionBy("g", "c", "tier").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("tree", F.first(F.xxhash64(*NODE)).over(topmost))
    nodes = marked.groupBy(*NODE).agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("size"), F.max("tier").alias("tier"), F.max("tree").alias("tree"),
        F.max(F.col("x").bitwiseXOR(F.col("own_x"))).alias("up_x"), F.max(F.col("y").bitwiseXOR(F.col("own_y"))).alias("up_y"),
    )
    saved = (F.col("n_convs") - 1) * F.col("size")
    zero = F.lit(0).cast("long")
    nodes = scratch.table(nodes.select(*NODE, "up_x", "up_y", "conv_id", "n_convs", zero.alias("n_children"), zero.alias("n_leaves"), saved.alias("saved"), "tier", "tree"))
    counts = {r["tier"]: r["n"] for r in nodes.groupBy("tier").agg(F.count("*").alias("n")).collect()}
    names = scratch.table(_beside(nodes, heavy.select(*NODE), n_heavy, NODE, "left_semi").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("up_x"), F.col("y").alias("up_y"), F.col("conv_id").alias("above")))
    schema = "depth long, x long, y long, up_x long, up_y long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, parent_conv_id long"
    tiers: list[DataFrame] = []
    for t in sorted(counts):
        mine = nodes.where(F.col("tier") == t)
        if tiers:
            risen = tiers[0]
            for other in tiers[1:]:
                risen = risen.unionByName(other)
            # by parent first: a node with many children gets one row
            risen = risen.where("parent_conv_id IS NULL AND depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("up_x").alias("x"), F.col("up_y").alias("y")).agg(
                F.count("*").alias("more"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved")
            )
            mine = mine.join(risen, NODE, "left").withColumns({
                "n_children": F.col("n_children") + F.coalesce("more", zero), "n_leaves": F.col("n_leaves") + F.coalesce("more_leaves", zero), "saved": F.col("saved") + F.coalesce("more_saved", zero),
            })
        shards = max(partitions(spark), -(-counts[t] // SHARD_NODES))
        mine = mine.withColumn("shard", F.pmod("tree", F.lit(shards)).cast("int")).drop("tier", "tree", "more", "more_leaves", "more_saved")
        tiers.append(scratch.table(mine.groupBy("shard").applyInPandas(rolled_up, schema)))
    if not tiers:
        every = spark.createDataFrame([], schema)
    else:
        every = tiers[0]
        for other in tiers[1:]:
            every = every.unionByName(other)
    every = _beside(every, names, n_heavy, ["depth", "up_x", "up_y"])
    digests = ends_digest(rows.where("depth = turns").select(*NODE, "c"))
    found = every.join(digests, NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "above")).alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )
