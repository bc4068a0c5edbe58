"""As-of joins (JOIN-7, WIN-10): for each row the latest row of another table at or before its time, without a grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.operators.scans import bucket, carried, with_carry


def latest_before(
    left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, right_seq: str, tolerance_seconds: float | None = None,
    width_seconds: float = 86_400,
) -> DataFrame:
    """Every row of left with the columns of the row of right with its key that is latest at or before left_at.

    Ties in time go to the greater right_seq. A row of right that is older than the tolerance counts as none; rows of left
    without a match, and those with a null key or time, have nulls. Both tables are dealt by key and bucket of time, so a hot
    key is many tasks; what a bucket begins with is carried over from the buckets before it. Names of right that left
    has too (but the key) are an error.
    """
    taken = [c for c in right.columns if c not in key]
    if clash := sorted({c.lower() for c in taken} & {c.lower() for c in left.columns}):
        raise ValueError(f"both tables have {', '.join(clash)}")
    names = [f"_k{i}" for i in range(len(key))]
    usable = F.lit(True)
    for c in key:
        usable = usable & F.col(c).isNotNull()
    row = F.struct(*(F.col(c) for c in taken)).alias("_row")
    keys = [F.col(c).alias(n) for c, n in zip(key, names, strict=True)]
    source = right.where(usable & F.col(right_at).isNotNull()).select(*keys, F.col(right_at).alias("_at"), F.col(right_seq).alias("_seq"), row)
    source = source.withColumn("bucket", bucket(F.col("_at"), width_seconds))
    asked = left.select(
        *keys, F.when(usable, F.col(left_at)).alias("_at"), F.struct(*(F.col(c) for c in left.columns)).alias("_asked")
    ).withColumn("bucket", bucket(F.col("_at"), width_seconds))
    span = ["bucket", *names]
    last = source.groupBy(*span).agg(F.max_by("_row", F.struct("_at", "_seq")).alias("summary"))
    wanted = asked.where("_at IS NOT NULL").select(*span).distinct().join(last.select(*span), span, "left_anti")
    carry = carried(last.unionByName(wanted, True), names, lambda a, b: b)
    every = source.unionByName(asked, True)
    # at one moment rows of right come first, the greatest sequence last of them
    order = Window.partitionBy(*span).orderBy("_at", F.col("_asked").isNotNull(), "_seq").rowsBetween(Window.unboundedPreceding, 0)
    found = every.withColumn("_last", F.last("_row", True).over(order)).where("_asked IS NOT NULL")
    found = with_carry(found, carry, names)
    match = F.when(F.col("_at").isNotNull(), F.coalesce("_last", "carry"))
    if tolerance_seconds is not None:
        near = F.unix_micros("_at") - F.unix_micros(match[right_at]) <= int(tolerance_seconds * 1_000_000)
        match = F.when(near, match)
    found = found.withColumn("_match", match)
    return found.select("_asked.*", *(F.col("_match")[c].alias(c) for c in taken))
