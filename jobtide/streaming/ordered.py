"""Health and histories in the order of event time, as named state with timers (STM-3 to STM-7, STM-10).

Rows wait in a list state of their key until the watermark has passed them; a timer then folds them in the order of (at, seq), and
what the fold must remember is a value state. So neither the cut into micro-batches, nor the order of rows in them, nor a restart
changes what is given, and it is what the batch windows give for the same rows. A row whose time the watermark has passed when it
comes is given at once with late = true, changes nothing, and can be split off by that column; so can rows without a time or from
before 1970. A key's task holds what one micro-batch brings and what the delay keeps waiting of it, never its history.

Named state needs RocksDB: start the query inside rocksdb(spark). Columns beyond those named are ignored.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor
from pyspark.sql.types import StructType

from jobtide.operators import health as batch
from jobtide.operators.history import FLAP_SECONDS

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_FLAP = FLAP_SECONDS * 1_000_000
_FLAG = batch.FLAG_SECONDS * 1_000_000


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB; the session's own setting comes back after it."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def _order(row):
    return row[0], row[1] is not None, row[1] or 0


class _InOrder(StatefulProcessor):
    """Rows (at in microseconds, seq, and others) of a key, handed to fold() in order once the watermark has passed them."""

    row, state, names = "", "", ()

    def __init__(self, keys: list[str]):
        self.keys = keys

    def init(self, handle):
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)
        self.alarm = handle.getValueState("alarm", "at_ms long")
        self.known = handle.getValueState("known", self.state)

    def fold(self, known, rows, mark):
        """Yields what to give as dicts; returns the state after it and the time in microseconds by which to call again without rows, or None."""
        raise NotImplementedError

    def handleInitialState(self, key, initialState, timerValues):
        self.known.update(tuple(initialState[len(key) :]))

    def handleInputRows(self, key, rows, timerValues):
        mark, kept = timerValues.getCurrentWatermarkInMs() * 1000, []
        for r in rows:
            row = tuple(r[len(key) :])
            if row[0] is None or row[0] < mark:
                yield self._given(key, dict(zip(self.row_names, row, strict=True)) | {"late": True})
            else:
                kept.append(row)
        if kept:
            self.waiting.appendList(kept)
            self._wake(min(r[0] for r in kept))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=_order)
        ready = [r for r in rows if r[0] < mark]
        left = rows[len(ready) :]
        folded = self.fold(self.known.get() if self.known.exists() else None, ready, mark)
        known, again = yield from self._told(key, folded)
        self.known.update(known)
        self.waiting.put(left) if left else self.waiting.clear()
        self.alarm.clear()
        times = [t for t in (left[0][0] if left else None, again) if t is not None]
        if times:
            self._wake(min(times))

    def _told(self, key, folded):
        """What a fold gives, row by row; what it returns."""
        while True:
            try:
                out = next(folded)
            except StopIteration as end:
                return end.value
            yield self._given(key, out | {"late": False})

    def close(self):
        pass

    @property
    def row_names(self):
        return [part.split()[0] for part in self.row.split(",")]

    def _given(self, key, values):
        return Row(**dict(zip(self.keys, key, strict=True)), **{name: values.get(name) for name in self.names})

    def _wake(self, at):
        """The key's only timer is the earliest one; it rings when the watermark, in whole milliseconds, is past at."""
        ms = at // 1000 + 1  # one that rang before all rows up to it are ready would be set to its own time, and deleted with it
        held = self.alarm.get()[0] if self.alarm.exists() else None
        if held is None or ms < held:
            if held is not None:
                self.handle.deleteTimer(held)
            self.handle.registerTimer(ms)
            self.alarm.update((ms,))


class _Health(_InOrder):
    row = "at long, seq long, ok boolean, n long, manual boolean"
    state = """streak long, first_zero long, flagged long, last_n long, last_at long, baseline long, held string, before_ok boolean,
      before_n long, log array<long>"""
    names = (
        "at", "seq", "ok", "n", "manual", "late", "status", "reason", "streak", "first_zero_at", "flagged_until", "last_nonzero_count",
        "last_nonzero_at", "baseline",
    )

    def fold(self, known, rows, mark):
        streak, first, flagged, last, last_at, base, held, was_ok, was_n, log = known or (0, None, None, None, None, None, None, None, None, [])
        log = list(log or [])
        for at, seq, ok, n, manual in rows:
            filled = ok and n > 0
            log = [*log, n if filled else -1][-batch.LOG_LENGTH :]
            if manual:
                status, reason = "down" if held == "down" else "suspect", "MANUAL"
            elif filled:
                recent = sorted([x for x in log if x > 0][-batch.BASELINE_WINDOW :])
                base = (recent[(len(recent) - 1) // 2] + recent[len(recent) // 2]) // 2
                streak, first, flagged, last, last_at = 0, None, None, n, at
                status, reason = "normal", "NONE"
                held = status
            else:
                first = at if not streak else first
                streak, flagged = streak + 1, at + _FLAG
                reason = "ZERO_SPIKE" if was_ok and was_n > 0 and n == 0 else "EMPTY_STREAK"
                if (last or 0) >= batch.LEAST_BASELINE:
                    status = "down" if at - first <= _FLAG and streak >= batch.DOWN_AFTER else "suspect"
                else:
                    status = "suspect" if streak >= 2 else "normal"
                held = status
            was_ok, was_n = ok, n
            values = (at, seq, ok, n, manual, None, status, reason, streak, first, flagged, last, last_at, base)
            yield dict(zip(self.names, values, strict=True))
        return (streak, first, flagged, last, last_at, base, held, was_ok, was_n, log), None


class _Changes(_InOrder):
    row = "at long, seq long, status string"
    state = "status string, pending long"
    names = ("status", "at", "late")

    def fold(self, known, rows, mark):
        status, pending = known or (None, None)

        def lasting(until):
            nonlocal status, pending
            if pending is not None and until - pending > _FLAP:
                yield {"status": "inactive", "at": pending}
                status, pending = "inactive", None

        for at, _, now in rows:
            yield from lasting(at)
            if now == "active":
                if status != "active":
                    yield {"status": "active", "at": at}
                status, pending = "active", None
            elif status == "active" and pending is None:
                pending = at
        yield from lasting(mark)
        return (status, pending), None if pending is None else pending + _FLAP


def _kept(table: DataFrame, keys: list[str], row: dict) -> DataFrame:
    return table.select(*keys, *(c.alias(name) for name, c in row.items()))


def _micros(x):
    return F.unix_micros(x.cast("timestamp"))


def _run(rows: DataFrame, keys: list[str], made: _InOrder, types: str, late: str, known: DataFrame | None) -> DataFrame:
    out = StructType([rows.schema[k] for k in keys] + list(StructType.fromDDL(types).fields))
    # the watermark is that of a column which ends here, so that late rows reach the operator
    marked = rows.withColumn("_mark", F.timestamp_micros("at")).withWatermark("_mark", late).drop("_mark")
    before = None if known is None else known.groupBy(*keys)
    return marked.groupBy(*keys).transformWithState(made, out, "Append", "EventTime", before)


def _attempts(table: DataFrame, keys: list[str], at) -> DataFrame:
    manual = F.coalesce("manual", F.lit(False)) if "manual" in table.columns else F.lit(False)
    row = {"at": at, "seq": F.col("seq").cast("long"), "ok": F.coalesce("ok", F.lit(False)), "n": F.coalesce(F.col("n").cast("long"), F.lit(0)), "manual": manual}
    return _kept(table, keys, row)


def handed_on(attempts: DataFrame, board: str = "board") -> DataFrame:
    """The state after a table of attempts, one row a board, for health(known=...): by the windows of the batch."""
    found = batch.states(_attempts(attempts, [board], F.col("at").cast("timestamp")), board)
    order, filled = F.struct("at", "seq"), F.col("ok") & (F.col("n") > 0)
    place = F.row_number().over(Window.partitionBy(board).orderBy(F.desc("at"), F.desc("seq")))
    found = found.withColumns({"_place": place, "_count": F.when(filled, F.col("n")).otherwise(-1)})
    own = F.when(~F.col("manual"), order)  # max_by passes over null orders
    log = F.array_sort(F.collect_list(F.when(F.col("_place") <= batch.LOG_LENGTH, F.struct(-F.col("_place"), "_count"))))
    end = F.struct("streak", _micros(F.col("first_zero_at")).alias("f"), _micros(F.col("flagged_until")).alias("u"), "last_nonzero_count", _micros(F.col("last_nonzero_at")).alias("l"), F.col("baseline").cast("long").alias("b"), "ok", "n")
    told = found.groupBy(board).agg(F.max_by(end, order).alias("e"), F.max_by("status", own).alias("held"), F.transform(log, lambda x: x["_count"]).alias("log"))
    return told.select(
        board, F.col("e.streak").alias("streak"), F.col("e.f").alias("first_zero"), F.col("e.u").alias("flagged"), F.col("e.last_nonzero_count").alias("last_n"),
        F.col("e.l").alias("last_at"), F.col("e.b").alias("baseline"), "held", F.col("e.ok").alias("before_ok"), F.col("e.n").alias("before_n"), "log",
    )


def health(attempts: DataFrame, late: str = "10 minutes", known: DataFrame | None = None, board: str = "board") -> DataFrame:
    """attempts (board, at, seq, ok, n, and manual, if there), a stream: the health after each, as health.states() gives it.

    late: how long the watermark waits. known: handed_on() of the attempts before the stream, a table; they must be older.
    Null ok, n and manual are false and 0; a null seq comes first; equal (at, seq) come in any order.
    """
    types = """at long, seq long, ok boolean, n long, manual boolean, late boolean, status string, reason string, streak long, first_zero_at long,
      flagged_until long, last_nonzero_count long, last_nonzero_at long, baseline long"""
    found = _run(_attempts(attempts, [board], _micros(F.col("at"))), [board], _Health([board]), types, late, known)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("at", "first_zero_at", "flagged_until", "last_nonzero_at")})


def changes(events: DataFrame, late: str = "6 hours", known: DataFrame | None = None, keys=("board", "link")) -> DataFrame:
    """events (keys, status, at, and seq, if there), a stream: the status changes that last, flaps left out, and late events.

    A change is given when it cannot be undone any more: active once the watermark has passed it, inactive once it has passed the
    flap window after it. known: (keys, status) before the stream, a table, such as the last status of each folded history. Any
    status but `active` is inactive; a history starts with its first active event.
    """
    keys = list(keys)
    seq = F.col("seq").cast("long") if "seq" in events.columns else F.lit(None).cast("long")
    rows = _kept(events, keys, {"at": _micros(F.col("at")), "seq": seq, "status": F.col("status")})
    before = None if known is None else _kept(known, keys, {"status": F.col("status"), "pending": F.lit(None).cast("long")})
    found = _run(rows, keys, _Changes(keys), "status string, at long, late boolean", late, before)
    return found.withColumn("at", F.timestamp_micros("at"))


def split(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results, late rows) of a table or micro-batch that health() or changes() gave."""
    return found.where(~F.col("late")), found.where("late")
