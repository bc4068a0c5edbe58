"""Live boards: health and histories as state, and windowed counts of late events (STM-1 to STM-8, STM-10)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from jobtide.operators.health import BASELINE_WINDOW, DOWN_AFTER, FLAG_SECONDS, LEAST_BASELINE, LOG_LENGTH, due
from jobtide.operators.history import FLAP_SECONDS

_HEALTH_OUT = "board string, at timestamp, seq long, ok boolean, n long, status string, reason string, streak long, baseline long, last_nonzero_count long"
_HEALTH_STATE = "log array<long>, streak long, first_zero long, last_nonzero long, baseline long, was_spike boolean"
#: Rows of results that are handed on at once.
HANDED_ON = 10_000
_FLAP_OUT = "board string, link string, status string, at timestamp"
_FLAP_STATE = "last string, pending long, given struct<status:string,at:long>, times array<long>, kinds array<string>"


def health(attempts: DataFrame) -> DataFrame:
    """attempts (board, at, ok, n, and seq, if there), a stream: the health after each, as the batch windows give it.

    State is a board's last LOG_LENGTH counts (-1 for what was no success) and five scalars. Attempts of one micro-batch
    are taken in the order of (at, seq), a null seq first, and keep their seq, which tells those of one time apart.
    """
    window = FLAG_SECONDS * 1_000_000_000

    def frame(out):
        made = pd.DataFrame(out, columns=["board", "at", "seq", "ok", "n", "status", "reason", "streak", "baseline", "last_nonzero_count"])
        return made.astype({"seq": "Int64", "baseline": "Int64", "last_nonzero_count": "Int64"})

    def step(key, groups, state: GroupState):
        log, streak, first_zero, last, baseline, spike = state.get if state.exists else ([], 0, None, None, None, False)
        log, out = list(log), []
        for r in pd.concat(list(groups)).astype({"seq": "Int64"}).sort_values(["at", "seq"], kind="stable", na_position="first").itertuples():
            at, good = r.at.value, bool(r.ok and r.n > 0)
            log = [*log, int(r.n) if good else -1][-LOG_LENGTH:]
            if good:
                recent = sorted([x for x in log if x > 0][-BASELINE_WINDOW:])
                baseline = (recent[(len(recent) - 1) // 2] + recent[len(recent) // 2]) // 2
                streak, first_zero, last, status, reason = 0, None, int(r.n), "normal", "NONE"
            else:
                first_zero = at if not streak else first_zero
                streak += 1
                reason = "ZERO_SPIKE" if spike and r.n == 0 else "EMPTY_STREAK"
                if (last or 0) >= LEAST_BASELINE:
                    status = "down" if at - first_zero <= window and streak >= DOWN_AFTER else "suspect"
                else:
                    status = "suspect" if streak >= 2 else "normal"
            spike = good
            if len(out) == HANDED_ON:
                yield frame(out)
                out = []
            out.append((key[0], r.at, r.seq, r.ok, r.n, status, reason, streak, baseline, last))
        state.update((log, streak, first_zero, last, baseline, spike))
        yield frame(out)

    seq = F.col("seq").cast("long") if "seq" in attempts.columns else F.lit(None).cast("long")
    grouped = attempts.select("board", "at", seq.alias("seq"), "ok", F.col("n").cast("long")).groupBy("board")
    found = grouped.applyInPandasWithState(step, _HEALTH_OUT, _HEALTH_STATE, "append", GroupStateTimeout.NoTimeout)
    return found if "seq" in attempts.columns else found.drop("seq")


def changes(events: DataFrame, late: str = "6 hours") -> DataFrame:
    """STM-4 to STM-7: events (board, link, status, at), a stream: status changes that last, flaps left out.

    Events that the watermark has not passed are kept in state in the order of their times, and each batch folds them
    anew from what is settled, so an event that comes late, but before the watermark, counts as if it had come in time. An
    inactive event is given when the watermark is past its flap window; an active one as soon as what is before it is
    settled. What was given stays: an active event that comes later with an earlier time does not give another one. Events
    later than the watermark are left to late_events().
    """
    gap = FLAP_SECONDS * 1_000_000_000

    def fold(status, pending, rows):
        """Changes in order, and the settled status and undecided inactive time after them."""
        out = []
        for at, now in rows:
            if pending is not None and at - pending > gap:
                out.append(("inactive", pending))
                status, pending = "inactive", None
            if now == "active":
                if pending is None and status != "active":
                    out.append(("active", at))
                status, pending = "active", None
            elif status == "active" and pending is None:
                pending = at
        return out, status, pending

    def step(key, groups, state: GroupState):
        last, pending, given, times, kinds = state.get if state.exists else (None, None, None, [], [])
        rows = list(zip(times, kinds, strict=True))
        if not state.hasTimedOut:
            rows += [(r.at.value, r.status) for r in pd.concat(list(groups)).itertuples()]
        rows.sort(key=lambda r: r[0])
        mark = state.getCurrentWatermarkMs() * 1_000_000
        found, _, waiting = fold(last, pending, rows)
        if waiting is not None:
            found.append(("inactive", waiting))
        out, due = [], None
        for status, at in found:
            if status == "inactive" and mark <= at + gap:
                due = at + gap
                break
            if given is None or (status != given[0] and at > given[1]):
                out.append((*key, status, pd.Timestamp(at)))
                given = (status, at)
        settled = [r for r in rows if r[0] <= mark]
        _, last, pending = fold(last, pending, settled)
        left = rows[len(settled) :]
        state.update((last, pending, given, [r[0] for r in left], [r[1] for r in left]))
        if due is not None:
            state.setTimeoutTimestamp(max(due // 1_000_000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["board", "link", "status", "at"])

    marked = events.select("board", "link", "status", "at").withWatermark("at", late).groupBy("board", "link")
    return marked.applyInPandasWithState(step, _FLAP_OUT, _FLAP_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def late_events(batch: DataFrame, seen_until, time_col: str = "at") -> tuple[DataFrame, DataFrame]:
    """STM-10: a micro-batch as (in time, late): late rows are those before seen_until, the watermark that the caller keeps."""
    late = F.coalesce(F.col(time_col) < seen_until, F.lit(False))
    return batch.where(~late), batch.where(late)


def schedule(ticks: DataFrame, boards, each_due, checkpoint: str, once: bool = False, seconds: int = 1):
    """STM-1, STM-2, STM-8: for each micro-batch of ticks (at) the boards that are due at its last one go to each_due(df, now).

    boards(): the table (file, next_scrape_at and others) as it is; boards that were never scraped are due at once.
    """

    def run(batch, number):
        now = batch.agg(F.max("at")).first()[0]  # one row
        if now is not None:
            each_due(due(boards(), F.lit(now), None), now)

    return poll(ticks, run, checkpoint, once, seconds)


def tumbling(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts by window and type; a slide makes the windows overlap."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", size, slide or size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "10 minutes") -> DataFrame:
    """Counts by user and session."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))


def poll(stream: DataFrame, each_batch, checkpoint: str, once: bool = False, seconds: int = 1):
    """STM-1: a running query that hands each micro-batch to each_batch(df, id); once: what is there, then it ends."""
    writer = stream.writeStream.foreachBatch(each_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()

