"""Health of boards whose logs are too long for one task: mergeable summaries of stretches of attempts (section H, WIN-5 to WIN-7).

A board's log is cut into buckets of time. A bucket's summary says all that later attempts can ask of it: the last counts of the
log, the last attempt, the last success with the counts before it, the failures since, and the last attempt without
an override. Summaries merge associatively, a scan over buckets carries the state into each of them, and each bucket is then
replayed by windows of its own, from the state carried in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.functions.texts import floor_median
from jobtide.operators.health import BASELINE_WINDOW, DOWN_AFTER, FLAG_SECONDS, LEAST_BASELINE, LOG_LENGTH
from jobtide.operators.scans import bucket, carried, with_carry
from jobtide.operators.stored import stored

#: Fields of a summary. log: the last attempts' counts, null where there was none, the latest last; good_log: the same up
#: to and with the last success; of a stretch without a success streak, zero_at and fail_at cover all of it.
SUMMARY = (
    "struct<log:array<int>,last:struct<ok:boolean,n:bigint>,good:struct<at:timestamp,n:bigint>,good_log:array<int>,"
    "streak:bigint,zero_at:timestamp,fail_at:timestamp,own:struct<at:timestamp,success:boolean>>"
)


#: Rows that a task replays, about.
TASK_ROWS = 200_000


def _tail(x: Column, n: int) -> Column:
    return F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), n)


def merged(a: Column, b: Column) -> Column:
    """The summary of a stretch and the one after it."""
    quiet = b["good"].isNull()
    return F.struct(
        _tail(F.concat(a["log"], b["log"]), LOG_LENGTH - 1).alias("log"), b["last"].alias("last"), F.coalesce(b["good"], a["good"]).alias("good"),
        F.when(quiet, a["good_log"]).otherwise(_tail(F.concat(a["log"], b["good_log"]), LOG_LENGTH)).alias("good_log"),
        (b["streak"] + F.when(quiet, a["streak"]).otherwise(0)).alias("streak"),
        F.when(quiet, F.coalesce(a["zero_at"], b["zero_at"])).otherwise(b["zero_at"]).alias("zero_at"),
        F.coalesce(b["fail_at"], F.when(quiet, a["fail_at"])).alias("fail_at"), F.coalesce(b["own"], a["own"]).alias("own"),
    )


def _judged(success: Column, at: Column, zero_at: Column, streak: Column, last_nonzero: Column) -> Column:
    """The status after an attempt without an override."""
    inside = F.unix_micros(at) - F.unix_micros(zero_at) <= FLAG_SECONDS * 1_000_000
    known = F.coalesce(last_nonzero, F.lit(0)) >= LEAST_BASELINE
    return (
        F.when(success, "normal").when(known, F.when(inside & (streak >= DOWN_AFTER), "down").otherwise("suspect"))
        .otherwise(F.when(streak >= 2, "suspect").otherwise("normal"))
    )


def _baseline(log: Column) -> Column:
    counts = F.filter(log, lambda n: n.isNotNull())
    return F.when(F.size(counts) > 0, floor_median(_tail(counts, BASELINE_WINDOW)))


def _marked(attempts: DataFrame, width_seconds: float) -> DataFrame:
    if "manual" not in attempts.columns:
        attempts = attempts.withColumn("manual", F.lit(False))
    good = F.col("ok") & (F.col("n") > 0)
    return attempts.withColumns({
        "bucket": bucket(F.col("at"), width_seconds), "_good": good, "success": good & ~F.col("manual"), "failure": ~good & ~F.col("manual"),
    })


def summaries(marked: DataFrame, board: str) -> DataFrame:
    """board, bucket, summary of attempts with bucket, success and failure."""
    span = Window.partitionBy(board, "bucket")
    order = F.struct("at", "seq")
    found = marked.withColumns({
        "_from_end": F.row_number().over(span.orderBy(F.col("at").desc(), F.col("seq").desc())),
        "_later": F.sum(F.col("success").cast("long")).over(span.orderBy(F.col("at").desc(), F.col("seq").desc()).rowsBetween(Window.unboundedPreceding, -1)),
    }).withColumn("_later", F.coalesce("_later", F.lit(0)))  # successes after it
    # places before the last success, counted from it, are those whose later successes are one or more
    found = found.withColumn("_rank", F.row_number().over(Window.partitionBy(board, "bucket", (F.col("_later") > 0) | F.col("success")).orderBy(F.col("at").desc(), F.col("seq").desc())))
    entry = F.struct("at", "seq", F.when(F.col("_good"), F.col("n").cast("int")).alias("c"))
    before = (F.col("_later") > 0) | F.col("success")
    tail = F.col("failure") & (F.col("_later") == 0)
    own = ~F.col("manual")
    listed = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, entry))), lambda e: e["c"])
    return found.groupBy(board, "bucket").agg(F.struct(
        listed(F.col("_from_end") < LOG_LENGTH).alias("log"), F.max_by(F.struct("ok", F.col("n").cast("long").alias("n")), order).alias("last"),
        F.max_by(F.when(F.col("success"), F.struct("at", F.col("n").cast("long").alias("n"))), F.when(F.col("success"), order)).alias("good"),
        listed(before & (F.col("_rank") <= LOG_LENGTH)).alias("good_log"), F.count_if(tail).alias("streak"),
        F.min(F.when(tail, F.col("at"))).alias("zero_at"), F.max(F.when(tail, F.col("at"))).alias("fail_at"),
        F.max_by(F.when(own, F.struct("at", F.col("success").alias("success"))), F.when(own, order)).alias("own"),
    ).cast(SUMMARY).alias("summary"))


def states(attempts: DataFrame, board: str = "board", width_seconds: float = 86_400) -> DataFrame:
    """health.states() of attempts, a task a bucket of a board's time, not a task a board.

    width_seconds: what a task takes of a board's log; any width gives the same result.
    """
    columns = [c for c in attempts.columns if c != "manual"]
    marked = stored(_marked(attempts, width_seconds))
    x = with_carry(marked, carried(summaries(marked, board), [board], merged), [board])
    # the windows keep this dealing, so what a task sorts does not grow with the log as long as it has buckets to deal
    tasks = max(int(marked.sparkSession.conf.get("spark.sql.shuffle.partitions")), marked.count() // TASK_ROWS + 1)
    x = x.repartition(tasks, board, "bucket")
    log = Window.partitionBy(board, "bucket").orderBy("at", "seq")
    so_far = log.rowsBetween(Window.unboundedPreceding, 0)
    # collect_list leaves nulls out, so an attempt without a count is -1
    entry = F.coalesce(F.when(F.col("_good"), F.col("n").cast("int")), F.lit(-1))
    recent = F.collect_list(entry).over(log.rowsBetween(1 - LOG_LENGTH, 0))
    before = F.transform(F.coalesce("carry.log", F.array().cast("array<int>")), lambda n: F.coalesce(n, F.lit(-1)))
    held = F.transform(_tail(F.concat(before, recent), LOG_LENGTH), lambda n: F.when(n >= 0, n))
    x = x.withColumns({
        "previous": F.coalesce(F.lag(F.struct("ok", F.col("n").cast("long").alias("n"))).over(log), F.col("carry.last")),
        "island": F.sum(F.col("success").cast("int")).over(so_far), "_base": F.when(F.col("success"), _baseline(held)),
        "last_nonzero_count": F.coalesce(F.last(F.when(F.col("success"), F.col("n")), True).over(so_far), F.col("carry.good.n")),
        "last_nonzero_at": F.coalesce(F.last(F.when(F.col("success"), F.col("at")), True).over(so_far), F.col("carry.good.at")),
    })
    streak = Window.partitionBy(board, "bucket", "island").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    open_before = F.col("island") == 0
    failed_at = F.when(F.col("failure"), F.col("at"))
    x = x.withColumns({
        "baseline": F.coalesce(F.last("_base", True).over(so_far), _baseline(F.col("carry.good_log"))),
        "streak": F.sum(F.col("failure").cast("int")).over(streak) + F.when(open_before, F.coalesce("carry.streak", F.lit(0))).otherwise(0),
        "first_zero_at": F.coalesce(F.when(open_before, F.col("carry.zero_at")), F.min(failed_at).over(streak)),
        "flagged_until": F.coalesce(F.max(failed_at).over(streak), F.when(open_before, F.col("carry.fail_at"))) + F.expr(f"INTERVAL {FLAG_SECONDS} SECONDS"),
    })
    own = _judged(F.col("success"), F.col("at"), F.col("first_zero_at"), F.col("streak"), F.col("last_nonzero_count"))
    x = x.withColumn("_own", F.when(~F.col("manual"), own))
    carried_own = F.when(
        F.col("carry.own").isNotNull(),
        _judged(F.col("carry.own.success"), F.col("carry.own.at"), F.col("carry.zero_at"), F.col("carry.streak"), F.col("carry.good.n")),
    )
    standing = F.coalesce(F.last("_own", True).over(so_far), carried_own)
    status = F.when(F.col("manual"), F.when(standing == "down", "down").otherwise("suspect")).otherwise(F.col("_own"))
    spike = F.col("previous.ok") & (F.col("previous.n") > 0) & (F.col("n") == 0)
    reason = F.when(F.col("manual"), "MANUAL").when(F.col("success"), "NONE").when(F.coalesce(spike, F.lit(False)), "ZERO_SPIKE").otherwise("EMPTY_STREAK")
    x = x.withColumns({"status": status, "reason": reason})
    return x.select(
        *columns, "manual", "previous", "last_nonzero_count", "last_nonzero_at", "baseline", "streak", "first_zero_at", "flagged_until", "status", "reason"
    )
