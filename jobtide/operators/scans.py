"""Scans along keys that may hold any number of rows: summaries of stretches, merged in a tree of bounded groups.

A key's rows are cut into buckets of time; each bucket has one summary. A scan gives every bucket what all earlier buckets of its
key come to. Summaries are merged upwards, FAN neighbours into one, until a key has a single group, and downwards
again each group gets what came before it and hands it on to its members. No step holds more than FAN summaries of a key
in one place, so a key with most of the rows is as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.operators.stored import stored

FAN = 64


def bucket(at: Column, width_seconds: float) -> Column:
    """The number of the stretch of time that a timestamp is in."""
    return F.floor(F.unix_micros(at) / F.lit(int(width_seconds * 1_000_000))).cast("long")


def carried(found: DataFrame, key: list[str], merge: Callable[[Column, Column], Column], fan: int = FAN) -> DataFrame:
    """key, bucket, carry: for each row of found (key, bucket, summary; a bucket once) the merge of the summaries before it.

    merge(a, b) gives the summary of a stretch and the one after it; it must be associative. carry is null for a key's first
    bucket. Null keys are keys like others.
    """
    kind = found.schema["summary"].dataType.simpleString()
    names = [f"k{i}" for i in range(len(key))]

    def both(a: Column, b: Column) -> Column:
        return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merge(a, b)).cast(kind)

    def grouped(level: DataFrame) -> DataFrame:
        members = F.array_sort(F.collect_list(F.struct("bucket", "summary"))).alias("members")
        return level.groupBy(*names, F.floor(F.col("bucket") / F.lit(fan)).cast("long").alias("up")).agg(members)

    none = F.lit(None).cast(kind)
    level = stored(found.select(*(F.col(c).alias(n) for c, n in zip(key, names, strict=True)), "bucket", "summary"))
    groups: list[DataFrame] = []
    while True:
        made = stored(grouped(level))
        groups.append(made)
        ends = made.agg(F.min("up").alias("a"), F.max("up").alias("b")).first()
        if ends["a"] == ends["b"] or ends["a"] is None or (ends["a"], ends["b"]) == (-1, 0):
            break
        whole = F.aggregate("members", none, lambda a, m: both(a, m["summary"]))
        level = made.select(*names, F.col("up").alias("bucket"), whole.alias("summary"))
    if ends["a"] != ends["b"]:  # stretches on both sides of the first moment of the calendar
        left = groups[-1].where("up = -1").select(*names, F.lit(0).cast("long").alias("up"), F.aggregate("members", none, lambda a, m: both(a, m["summary"])).alias("carry"))
    else:
        left = groups[-1].select(*names, "up").limit(0).withColumn("carry", none)
    for made in reversed(groups):
        before = left.toDF(*(f"u{i}" for i in range(len(key))), "_up", "carry")
        on = F.col("up") == F.col("_up")
        for i, n in enumerate(names):
            on = on & F.col(n).eqNullSafe(F.col(f"u{i}"))
        held = made.join(before, on, "left").select(*names, "members", "carry")
        start = F.struct(F.col("carry").alias("s"), F.expr(f"cast(array() as array<struct<bucket:bigint,carry:{kind}>>)").alias("out"))
        steps = F.aggregate(
            "members", start,
            lambda a, m: F.struct(both(a["s"], m["summary"]).alias("s"), F.concat(a["out"], F.array(F.struct(m["bucket"].alias("bucket"), a["s"].alias("carry")))).alias("out")),
            lambda a: a["out"],
        )
        told = held.select(*names, F.explode(steps).alias("e")).select(*names, F.col("e.bucket").alias("up"), "e.carry")
        left = stored(told)
    return left.select(*(F.col(n).alias(c) for c, n in zip(key, names, strict=True)), F.col("up").alias("bucket"), "carry")


def with_carry(rows: DataFrame, carry: DataFrame, key: list[str]) -> DataFrame:
    """rows (key, bucket and others) with the carry of their bucket."""
    told = carry.toDF(*(f"_c{i}" for i in range(len(key))), "_bucket", "carry")
    on = F.col("bucket") == F.col("_bucket")
    for i, c in enumerate(key):
        on = on & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    return rows.join(told, on, "left").drop(*(f"_c{i}" for i in range(len(key))), "_bucket")
