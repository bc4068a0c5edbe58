"""Streams replayed in random micro-batches with restarts against the batch over the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobtide.operators import health, history
from jobtide.streaming import ordered

T0 = datetime(2024, 1, 1)
HEALTH = ("board", "at", "seq", "status", "reason", "streak", "first_zero_at", "flagged_until", "last_nonzero_count", "last_nonzero_at", "baseline")


def replay(spark, root, parts, schema, build):
    """What a stream gives for parts that come one after another, the query ended and started again between them."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{root}/in")
        made = build(spark.readStream.schema(schema).parquet(f"{root}/in"))
        with ordered.rocksdb(spark):
            made.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/out").awaitTermination(240)
    return spark.read.schema(made.schema).parquet(f"{root}/out")


def late_rows(parts, hours):
    """Rows that come when the watermark, hours behind the latest row before their batch, has passed them; and the watermark at the end."""
    late, latest = [], None
    for part in parts:
        if latest:
            late += [r for r in part if r[1] < latest - timedelta(hours=hours)]
        latest = max([r[1] for r in part] + ([latest] if latest else []))
    return late, latest - timedelta(hours=hours)


def attempts(pick, boards, count):
    rows = []
    for b in boards:
        at = T0
        for i in range(count):
            at += timedelta(hours=pick.choice([0, 1, 2, 9]), seconds=pick.random())
            rows.append((b, at.replace(microsecond=at.microsecond // 1000 * 1000), i, pick.random() < 0.9, pick.choice([0, 0, 3, 7, 12]), pick.random() < 0.1))
    return rows


ATTEMPT = "board string, at timestamp, seq int, ok boolean, n long, manual boolean"


@pytest.mark.parametrize("known", [False, True])
def test_health_in_any_micro_batches_is_the_batch(spark, tmp_path, known):
    pick = random.Random(3 + known)
    rows = sorted(attempts(pick, ["a", "b", None], 90), key=lambda r: r[1])
    first, rows = (rows[:80], rows[80:]) if known else ([], rows)
    moved = sorted(rows, key=lambda r: r[1] + timedelta(hours=pick.choice([0, 5, 11, 11, 40])))
    cut = sorted(pick.sample(range(1, len(moved)), 2))
    parts = [moved[a:b] for a, b in zip([0, *cut], [*cut, len(moved)], strict=True)]
    before = ordered.handed_on(spark.createDataFrame(first, ATTEMPT)) if known else None
    told, late = ordered.split(replay(spark, str(tmp_path), parts, ATTEMPT, lambda s: ordered.health(s, "12 hours", before)))
    gone, mark = late_rows(parts, 12)
    assert sorted(map(repr, (tuple(r)[:6] for r in late.collect()))) == sorted(map(repr, gone)) and gone
    whole = spark.createDataFrame([*first, *(r for r in rows if r not in gone)], ATTEMPT)
    want = [tuple(r) for r in health.states(whole).select(*HEALTH).collect() if r["at"] < mark and not any(r["at"] == f[1] and r["board"] == f[0] and r["seq"] == f[2] for f in first)]
    assert sorted(map(repr, map(tuple, told.select(*HEALTH).collect()))) == sorted(map(repr, want)) and want


def test_changes_in_any_micro_batches_are_the_folded_history(spark, tmp_path):
    pick = random.Random(8)
    rows = []
    for k in range(12):
        at = T0
        for i in range(25):
            at += timedelta(hours=pick.choice([1, 2, 6, 6, 9]))
            rows.append((f"l{k}", at, i, pick.choice(["active", "inactive"])))
    rows.sort(key=lambda r: r[1])
    moved = sorted(rows, key=lambda r: r[1] + timedelta(hours=pick.choice([0, 5, 11, 60])))
    parts = [moved[:90], moved[90:200], moved[200:]]
    build = lambda s: ordered.changes(s.withColumn("board", F.lit(1)), "12 hours")
    told, late = ordered.split(replay(spark, str(tmp_path), parts, "link string, at timestamp, seq int, status string", build))
    gone, mark = late_rows(parts, 12)
    assert sorted((r["link"], r["at"], r["status"]) for r in late.collect()) == sorted((r[0], r[1], r[3]) for r in gone) and gone
    whole = spark.createDataFrame([(1, *r) for r in rows if r not in gone], "board int, link string, at timestamp, seq int, status string")
    want = [tuple(r) for r in history.normalized(whole, ["board", "link"], from_active=True).select("link", "status", "at").collect()]
    settled = []
    for k in {r[0] for r in want}:
        for _, status, at in sorted((r for r in want if r[0] == k), key=lambda r: r[2]):
            if at >= mark or (status == "inactive" and at + timedelta(hours=6) >= mark):
                break
            settled.append((k, status, at))
    assert sorted(map(tuple, told.select("link", "status", "at").collect())) == sorted(settled) and settled


def test_changes_after_known_states(spark, tmp_path):
    """A known active posting does not start again; one that ends within a flap does not end; times before 1970 and nulls are late."""
    hour = lambda h: T0 + timedelta(hours=h)
    rows = [("x", hour(1), 0, "active"), ("x", hour(2), 1, "inactive"), ("y", hour(1), 2, "inactive"), ("y", hour(7), 3, "active"), ("z", hour(1), 4, "active")]
    odd = [("o", None, 0, "active"), ("o", datetime(1960, 1, 1), 1, "active"), ("w", hour(90), 9, None)]
    known = spark.createDataFrame([("x", "active"), ("y", "active"), ("never", "active")], "link string, status string")
    build = lambda s: ordered.changes(s, "1 hour", known, keys=["link"])
    found = replay(spark, str(tmp_path), [rows + odd], "link string, at timestamp, seq int, status string", build)
    told, late = ordered.split(found)
    assert sorted(map(tuple, told.select("link", "status", "at").collect())) == [("x", "inactive", hour(2)), ("z", "active", hour(1))]
    assert sorted(r["at"] is None for r in late.collect()) == [False, True]


def test_rocksdb_gives_the_setting_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with pytest.raises(ZeroDivisionError), ordered.rocksdb(spark):
        1 / 0  # noqa: B018
    assert spark.conf.get(name) == before


def test_results_are_given_as_they_are_made():
    """A fold holds no list of what it gives: its first result is there before its second row is read."""
    read = []

    def rows():
        for k in range(3):
            read.append(k)
            yield k * 1_000_000, k, True, 5, False

    folded = ordered._Health(["board"]).fold(None, rows(), 10_000_000)
    assert next(folded)["status"] == "normal" and read == [0]
