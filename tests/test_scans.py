"""Scans along hot keys, intervals by aligned bins and as-of joins, against plain Python."""

import random
from bisect import bisect_right
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobtide.operators import asof, health, health_scan, history, scans

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("fan", [2, 64])
def test_carry_is_the_fold_of_what_came_before(spark, fan):
    draw = random.Random(fan)
    rows = {(k, b): chr(97 + draw.randrange(26)) for k in ("x", "y", None) for b in draw.sample(range(-40, 300), 60)}
    df = spark.createDataFrame([(k, b, s) for (k, b), s in rows.items()], "k string, bucket long, summary string")
    found = {(r["k"], r["bucket"]): r["carry"] for r in scans.carried(df, ["k"], F.concat, fan).collect()}
    for (k, b), carry in found.items():
        assert carry == ("".join(s for _, s in sorted((c, s) for (j, c), s in rows.items() if j == k and c < b)) or None)
    assert len(found) == len(rows) and scans.carried(df.limit(0), ["k"], F.concat, fan).count() == 0


def logs(seed, boards=6, longest=140):
    draw = random.Random(seed)
    rows = []
    for board in range(boards):
        at = T0 - timedelta(days=draw.choice([0, 20_000]))  # some start before 1970
        zeros = draw.random()
        for seq in range(draw.randrange(1, longest)):
            at += timedelta(hours=draw.choice([0, 1, 3, 30]))
            rows.append((board, at, seq, draw.random() < 0.8, 0 if draw.random() < zeros else draw.randrange(1, 20), draw.random() < 0.2))
    return rows


COLUMNS = ["board", "at", "seq", "previous", "last_nonzero_count", "last_nonzero_at", "baseline", "streak", "first_zero_at", "flagged_until", "status", "reason"]


@pytest.mark.parametrize("seed,hours", [(1, 1), (2, 17), (3, 24), (4, 400), (5, 10**6)])
def test_health_by_buckets_is_health(spark, seed, hours):
    df = spark.createDataFrame(logs(seed), "board int, at timestamp, seq int, ok boolean, n long, manual boolean")
    want = health.states(df).select(*COLUMNS)
    found = health_scan.states(df, width_seconds=hours * 3600).select(*COLUMNS)
    key = lambda r: (r["board"], r["at"], r["seq"])
    assert sorted(map(tuple, found.collect()), key=lambda r: r[:3]) == sorted(map(tuple, want.collect()), key=lambda r: r[:3])
    assert len({key(r) for r in found.collect()}) == df.count()


def test_health_of_one_board_is_many_tasks(spark):
    rows = [(0, T0 + timedelta(hours=k), k, True, k % 7, False) for k in range(600)]
    df = spark.createDataFrame(rows, "board int, at timestamp, seq int, ok boolean, n long, manual boolean")
    assert df.select(scans.bucket(F.col("at"), 86_400)).distinct().count() == 25
    assert health_scan.states(df).count() == 600 and health_scan.states(df.drop("manual").limit(0)).count() == 0


def test_summary_of_boards(spark):
    df = spark.createDataFrame(logs(9), "board int, at timestamp, seq int, ok boolean, n long, manual boolean")
    by_log, by_bucket = (sorted(map(tuple, health.summary(f(df)).collect())) for f in (health.states, health_scan.states))
    assert by_log == by_bucket and len(by_log) == 6


@pytest.mark.parametrize("lo,hi", [(0, 1), (0, 64), (3, 61), (5, 6), (7, 9), (1, 1023), (9, 9), (-5, 6)])
def test_cover_is_exact_and_short(spark, lo, hi):
    found = spark.range(1).select(F.explode(history.cover(F.lit(lo), F.lit(hi), list(range(12)))).alias("e")).select("e.*").collect()
    inside = [x for r in found for x in range(r["bin"] << r["level"], (r["bin"] + 1) << r["level"])]
    assert sorted(inside) == list(range(lo, hi)) and len(found) <= 2 * 11


def test_spans_of_years_and_many_moments(spark):
    draw = random.Random(5)
    rows = []
    for k in range(300):
        start = T0 + timedelta(minutes=draw.randrange(0, 60 * 24 * 2000))
        rows.append((k % 200, start, start + timedelta(minutes=draw.choice([0, 1, 59, 60 * 30, 60 * 24 * 900, -5]))))
    spans = spark.createDataFrame(rows, "k int, start timestamp, end timestamp")
    moments = [T0 + timedelta(minutes=30 * k) for k in range(100_000)]
    df = spark.range(100_000).select(F.timestamp_micros(F.unix_micros(F.lit(T0)) + F.col("id") * 1_800_000_000).alias("moment"))
    found = history.active_at(spans, df, ["k"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    want = set()
    for k, start, end in rows:
        for i in range(max(0, -(-(start - T0) // timedelta(minutes=30))), 100_000):
            if moments[i] >= end:
                break
            want.add((moments[i], k))
    assert found.count() == len(want)
    assert {tuple(r) for r in found.where("k < 5").collect()} == {x for x in want if x[1] < 5}


def asof_rows(draw, n, keys):
    return [(draw.choice(keys), T0 + timedelta(minutes=draw.choice([draw.randrange(0, 20_000), 777])) if draw.random() < 0.97 else None, k) for k in range(n)]


@pytest.mark.parametrize("width,tolerance", [(60, None), (86_400, 7200), (10**9, None)])
def test_asof_join(spark, width, tolerance):
    draw = random.Random(width)
    left, right = asof_rows(draw, 400, ["a", "b", "c", None]), asof_rows(draw, 200, ["a", "b", "d", None])
    a = spark.createDataFrame(left, "k string, at timestamp, id int")
    b = spark.createDataFrame([(k, at, i, None if i % 5 == 0 else f"v{i}") for k, at, i in right], "k string, since timestamp, seq int, value string")
    found = asof.latest_before(a, b, ["k"], "at", "since", "seq", tolerance, width)
    assert found.columns == ["k", "at", "id", "since", "seq", "value"]
    got = {r["id"]: (r["seq"], r["value"]) for r in found.collect()}
    for k, at, i in left:
        past = [(t, s) for j, t, s in right if j == k and k is not None and at is not None and t is not None and t <= at]
        best = max(past, default=None)
        if best and tolerance is not None and at - best[0] > timedelta(seconds=tolerance):
            best = None
        assert got[i] == ((best[1], None if best[1] % 5 == 0 else f"v{best[1]}") if best else (None, None))
    assert len(got) == len(left)


def test_asof_of_one_key_is_many_tasks(spark):
    n = 50_000
    left = spark.range(n).selectExpr("'x' AS k", "timestamp_seconds(id * 60 + 30) AS at", "id")
    right = spark.range(n // 10).selectExpr("'x' AS k", "timestamp_seconds(id * 600) AS since", "id AS seq")
    found = asof.latest_before(left, right, ["k"], "at", "since", "seq", None, 86_400)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        per_task = [r["count"] for r in found.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(per_task) == n and max(per_task) < 0.6 * n
    starts = [600 * k for k in range(n // 10)]
    assert all(r["seq"] == bisect_right(starts, r["id"] * 60 + 30) - 1 for r in found.collect())


def test_asof_refuses_clashing_names(spark):
    a = spark.createDataFrame([("x", T0, 1)], "k string, at timestamp, seq int")
    with pytest.raises(ValueError, match="seq"):
        asof.latest_before(a, a, ["k"], "at", "at", "seq")
