"""Sharding by a minimax contiguous partition.

Rows with equal texts are an atomic group; groups are ordered by a 64-bit hash of the text (texts of one hash stay
together). The smallest capacity for which a greedy pass over the ordered group sizes needs no more than the wanted
number of shards is found by binary search, and the order is cut where that pass cuts it, so that the largest shard is
as small as any contiguous partition allows.

The group sizes stay distributed. The driver sees sums over ranges of hashes: at first 4096 ranges, then the parts of
those ranges that a greedy pass cuts, until every cut falls between two groups. A range that is still whole may be cut
anywhere, so each search gives a lower bound, which the last one reaches. Slots are gapless without a global sort: rows
are dealt into cells by a hash of their id, and a cell's offset is the sum of the cells before it.

Edge cases: null texts and ids have size 1 and form a group with empty texts; a very long text is a group like any other,
and one larger than an even share makes its shard so large; ties need no rule, as the order of hashes is total; repeated
rows each get a slot; fewer groups than shards leave shards empty; an empty table has no rows; columns of the input
named as an added one are replaced, others stay whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.batches import Scratch, quoted

LAW = "bytes"
#: Ranges that a range is split into, and the groups below which a range is split into its groups.
FAN = 4096
FEW = 20_000
#: Rows of a slot cell, about.
CELL_ROWS = 10_000
_LEAST = -(1 << 63)


def greedy(sizes: list[int], whole: list[bool], shards: int, capacity: int) -> list[tuple[int, bool]] | None:
    """Where a greedy pass cuts: (range, whether inside it) for each full shard; None if the shards do not suffice.

    sizes: of the ranges in order; whole: which cannot be cut inside.
    """
    ends = [0, *accumulate(sizes)]
    at, cuts = 0, []
    for _ in range(shards):
        goal = at + capacity
        if goal >= ends[-1]:
            return cuts
        k = bisect_right(ends, goal) - 1  # ranges before k fit
        if whole[k]:
            if ends[k] <= at:
                return None
            at = ends[k]
            cuts.append((k, False))
        else:
            at = goal
            cuts.append((k, ends[k] != goal))
    return cuts if at >= ends[-1] else None


def smallest(sizes: list[int], whole: list[bool], shards: int) -> int:
    low, high = 0, sum(sizes)
    while low < high:
        middle = (low + high) // 2
        if greedy(sizes, whole, shards, middle) is None:
            low = middle + 1
        else:
            high = middle
    return low


def cuts(groups: DataFrame, shards: int) -> list[int]:
    """The hashes at which the shards from the second on begin. groups: h long, size long, one row for each group."""

    def summed(lo: int, hi: int, rows: int) -> list[tuple[int, int, int, int]]:
        """(first hash, end, size, groups) of the parts of [lo, hi) that have groups."""
        part = groups.where((F.col("h") >= lo) & (F.col("h") <= hi - 1))
        if rows <= FEW:
            return [(r["h"], r["h"] + 1, r["size"], 1) for r in part.orderBy("h").collect()]
        step = -(-(hi - lo) // FAN)
        # h - lo can pass the largest long, so halves of both are taken
        index = F.floor((F.expr("h div 2") - F.lit(lo // 2)) / F.lit(step / 2)).cast("long")
        found = part.groupBy(index.alias("k")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n"), F.min("h").alias("a"), F.max("h").alias("b")
        )
        return [(r["a"], r["b"] + 1, r["size"], r["n"]) for r in found.orderBy("a").collect()]

    ranges = summed(_LEAST, 1 << 63, FEW + 1)
    while ranges:
        sizes, whole = [r[2] for r in ranges], [r[3] == 1 for r in ranges]
        places = greedy(sizes, whole, shards, smallest(sizes, whole, shards))
        inside = sorted({k for k, split in places if split})
        if not inside:
            return [ranges[k][0] for k, _ in places]
        for k in reversed(inside):
            lo, hi, _, n = ranges[k]
            ranges[k : k + 1] = summed(lo, hi, n)
    return []


def assign_shards(
    df: DataFrame, shards: int = 8, text_col: str = "text", keep: list[str] | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """df with size, text_crc32, shard and slot. keep: the columns of df to carry (all, if None)."""
    scratch = scratch or Scratch(df.sparkSession)
    added = ("size", "text_crc32", "shard", "slot")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    hashed = F.xxhash64(text)
    size = (F.octet_length(text) + 1).cast("long")
    groups = scratch.table(df.select(hashed.alias("h"), size.alias("size")).groupBy("h").agg(F.sum("size").alias("size")))
    begins = cuts(groups, shards)
    scratch.drop(groups)
    shard = F.lit(0)
    for begin in begins:
        shard = shard + F.when(F.col("h") >= begin, 1).otherwise(0)
    placed = df.select(
        *(F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(kept)), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        hashed.alias("h"), F.monotonically_increasing_id().alias("row"),
    ).withColumn("shard", shard.cast("int"))
    placed = scratch.table(placed.drop("h"))
    cells = max(1, -(-placed.count() // CELL_ROWS))
    placed = placed.withColumn("cell", F.pmod(F.xxhash64("row"), F.lit(cells)).cast("int"))
    by_cell = Window.partitionBy("shard").orderBy("cell")
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    counts = counts.select("shard", "cell", (F.sum("n").over(by_cell) - F.col("n")).alias("before"))
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "cell").orderBy("row")) - 1)
    return ranked.join(counts, ["shard", "cell"]).select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), "size", "text_crc32", "shard", (F.col("before") + F.col("rank")).alias("slot")
    )


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
