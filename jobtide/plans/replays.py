"""Queries of streams that come in several runs, each from where the last one ended, with DuckDB SQL over what must count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.operators.stored import scratch
from jobtide.plans.catalogue import _HISTORY, _SHOW, attempts, observations, query, shown, table
from jobtide.streaming import ordered

# Events come in three runs: signups before the 25th come with what is later than the 14th, two days after which the first run ends.
_RUNS = """r0 AS (SELECT *, CASE WHEN ts >= '2024-01-25' THEN 2 WHEN ts >= '2024-01-15' OR event_type = 'signup' THEN 1 ELSE 0 END AS run FROM main.events),
r1 AS (SELECT (epoch_ms(max(ts) FILTER (WHERE run = 0)) - 172800000) * 1000 AS m1, (epoch_ms(max(ts) FILTER (WHERE run <= 1)) - 172800000) * 1000 AS m2,
  (epoch_ms(max(ts)) - 172800000) * 1000 AS m3 FROM r0),
r2 AS (SELECT r0.*, m3, coalesce((run = 1 AND epoch_us(ts) < m1) OR (run = 2 AND epoch_us(ts) < m2), false) AS late FROM r0, r1),
events AS (SELECT * FROM r2 WHERE NOT late)"""


def _runs(spark, rows: DataFrame, build) -> DataFrame:
    """What build gives for a stream of rows (at, run), started anew for each run, by way of a written table."""
    root = scratch(spark)
    rows = rows.withColumn("at", F.col("at").cast("timestamp"))
    for run in range(3):
        rows.where(F.col("run") == run).drop("run").write.mode("append").parquet(f"{root}/in")
        made = build(spark.readStream.schema(rows.drop("run").schema).parquet(f"{root}/in"))
        with ordered.rocksdb(spark):
            writer = made.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True)
            writer.start(f"{root}/out").awaitTermination()
    return spark.read.schema(made.schema).parquet(f"{root}/out")


def _numbered(spark, sf_dir, rows: DataFrame) -> DataFrame:
    """rows (seq) of events with the run in which they come, and whether they are signups of more than 60."""
    run = F.when(F.col("ts") >= "2024-01-25", 2).when((F.col("ts") >= "2024-01-15") | (F.col("event_type") == "signup"), 1).otherwise(0)
    told = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), run.alias("run"), ((F.col("event_type") == "signup") & (F.col("value") > 60)).alias("manual"))
    return rows.join(told, "seq")


@query(f"""WITH {_RUNS}, a AS (SELECT user_id % 10 AS board, ts AS tm, event_id AS seq, m3, NOT (event_type = 'error' AND event_id % 3 = 0) AS ok, event_type = 'signup' AND value > 60 AS manual,
  CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value / 10) AS BIGINT) END AS n FROM events),
x AS (SELECT *, ok AND n > 0 AS filled, ok AND n > 0 AND NOT manual AS good, NOT (ok AND n > 0) AND NOT manual AS bad FROM a),
y AS (SELECT *, sum(CASE WHEN good THEN 1 ELSE 0 END) OVER w AS island, lag(filled) OVER (PARTITION BY board ORDER BY tm, seq) AS was,
  last_value(CASE WHEN good THEN n END IGNORE NULLS) OVER w AS last_nonzero_count, last_value(CASE WHEN good THEN tm END IGNORE NULLS) OVER w AS last_nonzero_at,
  list_filter(list(CASE WHEN filled THEN n END) OVER (PARTITION BY board ORDER BY tm, seq ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), lambda q: q IS NOT NULL) AS recent
  FROM x WINDOW w AS (PARTITION BY board ORDER BY tm, seq ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, list_sort(recent[greatest(len(recent) - 9, 1):]) AS srt FROM y),
z AS (SELECT *, CASE WHEN good THEN (srt[(len(srt) + 1) // 2] + srt[len(srt) // 2 + 1]) // 2 END AS base, sum(CASE WHEN bad THEN 1 ELSE 0 END) OVER i AS streak,
  min(CASE WHEN bad THEN tm END) OVER i AS first_zero, max(CASE WHEN bad THEN tm END) OVER i + INTERVAL 1 DAY AS flagged
  FROM b WINDOW i AS (PARTITION BY board, island ORDER BY tm, seq ROWS UNBOUNDED PRECEDING)),
o AS (SELECT *, CASE WHEN manual THEN NULL WHEN good THEN 'normal' WHEN coalesce(last_nonzero_count, 0) >= 3 THEN
  CASE WHEN tm - first_zero <= INTERVAL 24 HOURS AND streak >= 5 THEN 'down' ELSE 'suspect' END WHEN streak >= 2 THEN 'suspect' ELSE 'normal' END AS own FROM z),
v AS (SELECT *, last_value(base IGNORE NULLS) OVER w AS baseline, last_value(own IGNORE NULLS) OVER w AS held FROM o WINDOW w AS (PARTITION BY board ORDER BY tm, seq ROWS UNBOUNDED PRECEDING))
SELECT board, seq, false AS late, CAST(streak AS BIGINT) AS streak, strftime(first_zero, {_SHOW}) AS first_zero_at, strftime(flagged, {_SHOW}) AS flagged_until,
  CAST(last_nonzero_count AS BIGINT) AS last_nonzero_count, strftime(last_nonzero_at, {_SHOW}) AS last_nonzero_at, CAST(baseline AS BIGINT) AS baseline,
  CASE WHEN manual THEN CASE WHEN held = 'down' THEN 'down' ELSE 'suspect' END ELSE own END AS status,
  CASE WHEN manual THEN 'MANUAL' WHEN good THEN 'NONE' WHEN coalesce(was, false) AND n = 0 THEN 'ZERO_SPIKE' ELSE 'EMPTY_STREAK' END AS reason FROM v WHERE epoch_us(tm) < m3
UNION ALL SELECT user_id % 10, event_id, true, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM r2 WHERE late""")
def ordered_health(spark, sf_dir):
    """STM-3, STM-6, STM-10: health under overrides from attempts out of order, the stream started three times; late ones told apart."""
    rows = _numbered(spark, sf_dir, attempts(spark, sf_dir))
    found = _runs(spark, rows, lambda stream: ordered.health(stream, "2 days"))
    times = {c: shown(c) for c in ("first_zero_at", "flagged_until", "last_nonzero_at")}
    return found.withColumns(times).select("board", "seq", "late", "streak", *times, "last_nonzero_count", "baseline", "status", "reason")


@query(f"""WITH {_RUNS}, {_HISTORY}, k AS (SELECT any_value(m3) AS mark FROM r2),
x AS (SELECT h.*, epoch_us(tm) + CASE WHEN status = 'inactive' THEN 21600000000 ELSE 0 END >= mark AS waits FROM h, k),
y AS (SELECT * FROM x QUALIFY NOT bool_or(waits) OVER (PARTITION BY link ORDER BY tm, seq ROWS UNBOUNDED PRECEDING))
SELECT board, link, status, strftime(tm, {_SHOW}) AS "at", false AS late FROM y
UNION ALL SELECT user_id % 10, user_id, CASE WHEN event_type = 'error' THEN 'inactive' ELSE 'active' END, strftime(ts, {_SHOW}), true FROM r2 WHERE late""")
def ordered_changes(spark, sf_dir):
    """STM-4, STM-5, STM-7, STM-10: status changes that last, by timers, from events out of order; late ones told apart."""
    rows = _numbered(spark, sf_dir, observations(spark, sf_dir)).drop("manual")
    found = _runs(spark, rows, lambda stream: ordered.changes(stream, "2 days"))
    return found.select("board", "link", "status", shown("at").alias("at"), "late")
