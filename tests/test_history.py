"""Histories, health and merges: hand-made cases, and windows against the fold by random histories."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from jobtide.operators import health, history, merge

T0 = datetime(2024, 1, 1)
KEY = ["link"]


def frame(spark, histories):
    rows = [(k, s, T0 + timedelta(hours=h), i) for k, events in histories.items() for i, (s, h) in enumerate(events)]
    return spark.createDataFrame(rows, "link string, status string, at timestamp, seq int")


def told(df):
    out = {}
    for r in df.orderBy("link", "at", "seq").collect():
        out.setdefault(r["link"], []).append((r["status"][0], (r["at"] - T0).total_seconds() / 3600))
    return out


A, I = "active", "inactive"


def test_normalized_cases(spark):
    second = 1 / 3600
    cases = {
        "inside": [(A, 0), (I, 10), (A, 16)], "outside": [(A, 0), (I, 10), (A, 16 + second)], "runs": [(A, 0), (A, 1), (I, 2), (I, 3)],
        "leading": [(I, 0), (A, 1), (A, 2)], "ties": [(A, 0), (I, 5), (A, 5)],
    }
    got = told(history.normalized(frame(spark, cases), KEY))
    assert got == {"inside": [("a", 0)], "outside": [("a", 0), ("i", 10), ("a", pytest.approx(16 + second))], "runs": [("a", 0), ("i", 2)], "ties": [("a", 0)]}
    folded = frame(spark, cases).groupBy("link").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "status"))).alias("h"))
    fold = {r["link"]: len(r["h"]) for r in folded.select("link", history.folded(F.col("h")).alias("h")).collect()}
    assert fold == {"inside": 1, "outside": 3, "runs": 2, "leading": 1, "ties": 1}


def test_windows_are_the_fold(spark):
    pick = random.Random(1)
    cases = {f"k{k}": [(A, 0)] + sorted(((pick.choice([A, I]), pick.randint(0, 60)) for _ in range(pick.randint(0, 9))), key=lambda x: x[1]) for k in range(300)}
    df = frame(spark, cases)
    folded = df.groupBy("link").agg(F.collect_list(F.struct("seq", "at", "status")).alias("h")).select("link", history.folded(F.array_sort("h")).alias("h"))
    want = {r["link"]: [(e["status"][0], (e["at"] - T0).total_seconds() / 3600) for e in r["h"]] for r in folded.collect()}
    assert told(history.normalized(df, KEY)) == want


def test_intervals_counts_and_metrics(spark):
    df = frame(spark, {"a": [(A, 0.2), (I, 10)], "b": [(A, 3)], "c": [(A, 1), (I, 1)]}).withColumn("board", F.lit("x"))
    now = F.lit(T0 + timedelta(hours=12)).cast("timestamp")
    spans = history.intervals(df, ["board", "link"], now)
    lengths = {r["link"]: (r["end"] - r["start"]).total_seconds() / 3600 for r in spans.collect()}
    assert lengths == pytest.approx({"a": 9.8, "b": 9})
    got = [(r["time"], r["active"]) for r in history.step_counts(spans, "board", 30).orderBy("time").collect()]
    rows = spans.collect()
    first = min(r["start"] for r in rows)
    assert got[0][0] == first and len(got) == 24
    assert all(n == sum(r["start"] <= t < r["end"] for r in rows) for t, n in got)
    m = history.metrics(df, ["board", "link"], now).first()
    assert (m["active_now"], m["new_now"], m["active_before"]) == (1, 1, 0)


@pytest.mark.parametrize("unit", [1, 3600, 10**7])
def test_moments_in_spans(spark, unit):
    pick = random.Random(4)
    rows = [(k, T0 + timedelta(hours=h), T0 + timedelta(hours=h + pick.choice([0, 3, 60]))) for k in range(40) for h in [pick.randint(0, 300)]]
    spans = spark.createDataFrame(rows, "k int, start timestamp, end timestamp")
    times = [T0 + timedelta(hours=h, minutes=30 * (h % 2)) for h in range(0, 320, 7)]
    moments = spark.createDataFrame([(t,) for t in [*times, times[0], None]], "moment timestamp")
    found = sorted(map(tuple, history.active_at(spans, moments, ["k"], unit).collect()))
    assert found == sorted((t, k) for k, a, b in rows for t in times if a <= t < b) and found
    zoneless = spans.select("k", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"))
    assert sorted(map(tuple, history.active_at(zoneless, moments.select(F.col("moment").cast("timestamp_ntz").alias("moment")), ["k"], unit).collect())) == found


def machine(attempts):
    """The state machine, attempt by attempt."""
    log, streak, first, last, base, held, flag, out = [], 0, None, None, None, "normal", None, []
    for at, ok, n, manual in attempts:
        prior = log[-1] if log else None
        log = [*log, (ok, n)][-50:]
        if manual:
            held = "down" if held == "down" else "suspect"
            out.append((held, "MANUAL", streak, base))
            continue
        if ok and n > 0:
            recent = sorted([x for o, x in log if o and x > 0][-10:])
            base = (recent[(len(recent) - 1) // 2] + recent[len(recent) // 2]) // 2
            streak, first, last, held, reason = 0, None, n, "normal", "NONE"
        else:
            first = at if streak == 0 else first
            streak += 1
            reason = "ZERO_SPIKE" if prior and prior[0] and prior[1] > 0 and n == 0 else "EMPTY_STREAK"
            if (last or 0) >= 3:
                held = "down" if at - first <= 24 and streak >= 5 else "suspect"
            else:
                held = "suspect" if streak >= 2 else "normal"
        out.append((held, reason, streak, base))
    return out


def test_health_is_the_state_machine(spark):
    pick = random.Random(2)
    boards = {}
    for b in range(12):
        hours, rows = 0, []
        for _ in range(90):
            hours += pick.choice([1, 2, 9])
            good = pick.random() < (0.7 if b % 2 else 0.3)
            rows.append((hours, pick.random() < 0.9, pick.randint(1, 12) if good else 0, False))
        boards[f"b{b}"] = rows
    boards["zeros"] = [(0, True, 12, False), *((h, True, 0, False) for h in range(1, 40))]
    boards["manual"] = [(0, True, 12, False), (1, True, 0, True), (2, True, 0, False)]
    rows = [(b, T0 + timedelta(hours=h), i, ok, n, m) for b, x in boards.items() for i, (h, ok, n, m) in enumerate(x)]
    df = spark.createDataFrame(rows, "board string, at timestamp, seq int, ok boolean, n long, manual boolean")
    got = {}
    for r in health.states(df).orderBy("board", "seq").collect():
        got.setdefault(r["board"], []).append((r["status"], r["reason"], r["streak"], r["baseline"]))
    assert got == {b: machine(x) for b, x in boards.items()}
    assert got["zeros"][5][0] == "down" and got["zeros"][-1][0] == "suspect"


def test_merge(spark):
    content = spark.createDataFrame([("x", "a", "A", True, 1), ("x", "b", "B", False, 2), ("x", "c", "C", True, 3), ("y", "q", "Q", True, 4)], "board string, link string, title string, active boolean, seq int")
    scrape = spark.createDataFrame([("x", "b", "B2", 1), ("x", "d", "old", 2), ("x", "d", "D", 3)], "board string, link string, title string, seq int")
    gate = spark.createDataFrame([("y", False)], "board string, open boolean")
    got = {r["link"]: (r["title"], r["active"], r["event"], r["is_new"]) for r in merge.merged(content, scrape, ["board", "link"], gate).collect()}
    assert got == {"a": ("A", False, I, False), "b": ("B2", True, A, False), "c": ("C", False, I, False), "d": ("D", True, A, True), "q": ("Q", True, None, False)}
    assert {r["link"] for r in merge.missing(content, scrape, ["board", "link"]).collect()} == {"a", "c", "q"}


def test_schedule(spark):
    rows = spark.createDataFrame([("b", None), ("a", T0), ("c", T0 + timedelta(days=2))], "file string, next_scrape_at timestamp")
    now = F.lit(T0 + timedelta(days=1)).cast("timestamp")
    assert [r["file"] for r in health.due(rows, now).collect()] == ["a", "b"]
    made = rows.select("file", health.next_scrape(F.col("next_scrape_at"), now).alias("n")).orderBy("file").collect()
    assert [r["n"] - T0 for r in made] == [timedelta(days=1, minutes=5), timedelta(days=1, hours=1), timedelta(days=2, hours=1)]
    assert rows.select(health.minutes_since(F.col("next_scrape_at"), now).alias("m")).where("file = 'a'").first()["m"] == 1440


def test_board_edits(spark):
    boards = spark.createDataFrame([("a", "A", "i", "w")], "slug string, title string, icon_url string, website_url string")
    fresh = spark.createDataFrame([("a", "X", "i", "w"), ("b", "B", "i", "w"), ("b", "C", "i", "w"), ("c", "", "i", "w")], boards.schema)
    assert sorted((r["slug"], r["title"]) for r in merge.added(boards, fresh).collect()) == [("a", "A"), ("b", "B")]
    assert merge.removed(boards, "a").count() == 0
