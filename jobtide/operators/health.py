"""Health of boards from their attempts (section H of the survey), as windows over each board's log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.functions.texts import floor_median

# The default policy.
FLAG_SECONDS = 86_400
DOWN_AFTER = 5
BASELINE_WINDOW = 10
LEAST_BASELINE = 3
LOG_LENGTH = 50


def states(attempts: DataFrame, board: str = "board") -> DataFrame:
    """attempts (board, at, seq, ok, n, and manual, if there) with the health after each of them.

    Attempts under a manual override change no counter, but are the previous attempt of the next one.
    """
    if "manual" not in attempts.columns:
        attempts = attempts.withColumn("manual", F.lit(False))
    log = Window.partitionBy(board).orderBy("at", "seq")
    so_far = log.rowsBetween(Window.unboundedPreceding, 0)
    success = F.col("ok") & (F.col("n") > 0) & ~F.col("manual")
    failure = ~(F.col("ok") & (F.col("n") > 0)) & ~F.col("manual")
    x = attempts.withColumns({"success": success, "failure": failure})
    recent = F.collect_list(F.when(F.col("ok") & (F.col("n") > 0), F.col("n").cast("int"))).over(log.rowsBetween(1 - LOG_LENGTH, 0))
    x = x.withColumns({
        "previous": F.lag(F.struct("ok", "n")).over(log),
        "island": F.sum(F.col("success").cast("int")).over(so_far),
        "_base": F.when(F.col("success"), floor_median(F.slice(recent, F.greatest(F.size(recent) - BASELINE_WINDOW + 1, F.lit(1)), F.lit(BASELINE_WINDOW)))),
        "last_nonzero_count": F.last(F.when(F.col("success"), F.col("n")), True).over(so_far),
        "last_nonzero_at": F.last(F.when(F.col("success"), F.col("at")), True).over(so_far),
    })
    streak = Window.partitionBy(board, "island").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumns({
        "baseline": F.last("_base", True).over(so_far),
        "streak": F.sum(F.col("failure").cast("int")).over(streak),
        "first_zero_at": F.min(F.when(F.col("failure"), F.col("at"))).over(streak),
        "flagged_until": F.max(F.when(F.col("failure"), F.col("at") + F.expr(f"INTERVAL {FLAG_SECONDS} SECONDS"))).over(streak),
    })
    inside = F.unix_micros("at") - F.unix_micros("first_zero_at") <= FLAG_SECONDS * 1_000_000
    known = F.coalesce("last_nonzero_count", F.lit(0)) >= LEAST_BASELINE
    own = (
        F.when(F.col("success"), "normal")
        .when(known, F.when(inside & (F.col("streak") >= DOWN_AFTER), "down").otherwise("suspect"))
        .otherwise(F.when(F.col("streak") >= 2, "suspect").otherwise("normal"))
    )
    spike = F.col("previous.ok") & (F.col("previous.n") > 0) & (F.col("n") == 0)
    reason = F.when(F.col("manual"), "MANUAL").when(F.col("success"), "NONE").when(F.coalesce(spike, F.lit(False)), "ZERO_SPIKE").otherwise("EMPTY_STREAK")
    x = x.withColumn("_own", F.when(~F.col("manual"), own))
    held = F.last("_own", True).over(so_far)
    status = F.when(F.col("manual"), F.when(held == "down", "down").otherwise("suspect")).otherwise(F.col("_own"))
    return x.withColumns({"status": status, "reason": reason}).drop("success", "failure", "_base", "_own", "island")


def may_deactivate(two_zeros: bool = True):
    """M2: whether a snapshot without rows may deactivate, from the columns of states()."""
    normal = F.col("status") == "normal"
    if not two_zeros:
        return normal
    return F.coalesce(F.col("ok") & F.col("previous.ok") & (F.col("previous.n") == 0) & normal, F.lit(False))


def due(boards: DataFrame, now, limit: int | None = 6) -> DataFrame:
    """FLT-2, LIM-1: boards to scrape now, in the order of their files."""
    found = boards.where(F.col("next_scrape_at").isNull() | (F.col("next_scrape_at") <= now)).orderBy("file")
    return found if limit is None else found.limit(limit)


def next_scrape(last_scraped, now, base_minutes: int = 60, jitter_minutes: int = 30, least_minutes: int = 5, draw=None):
    """DT-8, STM-8: last (or now) + base + draw * jitter, at least now + least (and then up to 30 s later).

    draw: a column in [-1, 1] (a hash of the board repeats its jitter; None: none).
    """
    draw = F.lit(0.0) if draw is None else draw
    micros = F.unix_micros(F.coalesce(last_scraped, now)) + F.round(F.lit(base_minutes * 60e6) + draw * F.lit(jitter_minutes * 60e6)).cast("long")
    floor = F.unix_micros(now) + least_minutes * 60_000_000
    later = floor + F.round((draw + 1) * F.lit(15e6)).cast("long") * F.when(draw == 0, 0).otherwise(1)
    return F.timestamp_micros(F.when(micros < floor, later).otherwise(micros))


def minutes_since(last, now):
    """DT-7, over whole days as well."""
    return F.floor((F.unix_micros(now) - F.unix_micros(last)) / 60_000_000)


def next_after_error(now, draw=None, base_minutes: int = 20, jitter_minutes: int = 5, least_minutes: int = 5):
    """STM-8: after an error now + base + draw * jitter, but not before now + least; draw: a column in [-1, 1] or None."""
    draw = F.lit(0.0) if draw is None else draw
    wait = F.round(F.lit(base_minutes * 60e6) + draw * F.lit(jitter_minutes * 60e6)).cast("long")
    return F.timestamp_micros(F.unix_micros(now) + F.greatest(wait, F.lit(least_minutes * 60_000_000)))


def summary(found: DataFrame, board: str = "board") -> DataFrame:
    """H8: of states() the health of each board after its last attempt; all of it sums on the map side, no window over a board."""
    good, order = F.col("ok") & (F.col("n") > 0), F.struct("at", "seq")
    fields = (
        "status", "reason", "first_zero_at", F.col("streak").alias("consecutive_zero_attempts"), "flagged_until", "last_nonzero_at",
        "last_nonzero_count", F.col("baseline").alias("baseline_nonzero_count"),
    )
    told = found.groupBy(board).agg(
        F.max_by(F.struct(*fields), order).alias("h"), F.max_by(F.when(good, F.struct("at", "n")), F.when(good, order)).alias("s")
    )
    return told.select(board, "h.*", F.col("s.at").alias("last_success_at"), F.col("s.n").alias("last_success_count"))
