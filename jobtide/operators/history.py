"""Status histories: run-length collapse, flap removal, intervals, step counts, metrics (WIN, JOIN-7/8, AGG, SRT).

Histories stay in long form (key columns, status, at, seq); seq breaks ties in `at`. All windows partition by the key,
so one posting's events are all that a task needs together, and counts over time are sums of +1 and -1 by board.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobtide.operators.stored import stored

FLAP_SECONDS = 6 * 3600
NEW_HOURS = 24
NEW_BEFORE_HOURS = 48


def _micros(x) -> Column:
    return F.unix_micros(x)


def normalized(events: DataFrame, key: list[str], flap_seconds: int = FLAP_SECONDS, from_active: bool = False) -> DataFrame:
    """WIN-2, WIN-3: equal neighbours collapse to the first; inactive and active within the flap window go, both.

    from_active: events before a key's first active one are dropped first; else a key that starts inactive and becomes
    active within the window loses both events.
    """
    by_key = Window.partitionBy(*key).orderBy("at", "seq")
    if from_active:
        seen = F.max((F.col("status") == "active").cast("int")).over(by_key.rowsBetween(Window.unboundedPreceding, 0))
        events = events.withColumn("_seen", seen).where("_seen = 1").drop("_seen")
    runs = events.withColumn("_last", F.lag("status").over(by_key)).where("_last IS NULL OR _last <> status").drop("_last")
    gap = flap_seconds * 1_000_000
    before, after = F.lag("at").over(by_key), F.lead("at").over(by_key)
    marked = runs.withColumn("_before", before).withColumn("_after", after)
    flap = (
        ((F.col("status") == "inactive") & (_micros(F.col("_after")) - _micros(F.col("at")) <= gap))
        | ((F.col("status") == "active") & (_micros(F.col("at")) - _micros(F.col("_before")) <= gap))
    )
    return marked.where(~F.coalesce(flap, F.lit(False))).drop("_before", "_after")


def folded(history, flap_seconds: int = FLAP_SECONDS) -> Column:
    """The same on an array of structs (status, at), event by event; differs only for histories that start inactive."""
    kind = F.slice(history, 1, 0)
    placed = F.transform(history, lambda e, i: F.struct(e["at"].alias("at"), i.alias("i"), e.alias("e")))
    ordered = F.transform(F.array_sort(placed), lambda p: p["e"])

    def step(done, e):
        last = F.element_at(done, -1)
        flap = (e["status"] == "active") & (last["status"] == "inactive") & (_micros(e["at"]) - _micros(last["at"]) <= flap_seconds * 1_000_000)
        return (
            F.when(F.size(done) == 0, F.array(e)).when(last["status"] == e["status"], done)
            .when(flap, F.slice(done, F.lit(1), F.size(done) - 1)).otherwise(F.concat(done, F.array(e)))
        )

    return F.aggregate(ordered, kind, step)


def intervals(history: DataFrame, key: list[str], as_of) -> DataFrame:
    """WIN-8: key, start, end of each active stretch of a normalised history; the last may still be open at as_of."""
    by_key = Window.partitionBy(*key).orderBy("at", "seq")
    paired = history.withColumn("_end", F.lead("at").over(by_key)).where("status = 'active'")
    paired = paired.where(F.col("_end").isNull() | (F.col("_end") > F.col("at")))
    return paired.select(*key, F.col("at").alias("start"), F.coalesce("_end", as_of).alias("end"))


def step_counts(spans: DataFrame, board: str, minutes: int = 30, until=None) -> DataFrame:
    """SET-1, GEN-1, JOIN-7, WIN-9, WIN-10: active spans of each board at each tick of a grid from the first start on.

    The grid's ticks join the deltas as rows of 0, so the running sum by board is the as-of value at each tick. Ticks
    and deltas are summed into grid cells first: a board's window holds its ticks, however many postings it has.
    """
    step = minutes * 60_000_000
    moving = spans.where(F.col("end") > F.col("start"))
    last = F.max("end") if until is None else F.greatest(F.max("end"), until)
    reach = spans.agg(F.min("start").alias("first"), last.alias("last"))
    cell = lambda x: F.greatest(F.lit(0), F.ceil((_micros(x) - _micros(F.col("first"))) / F.lit(step)))
    deltas = moving.crossJoin(F.broadcast(reach)).select(  # one row
        board, F.explode(F.array(F.struct(cell(F.col("start")).alias("tick"), F.lit(1).alias("d")),
                                 F.struct(cell(F.col("end")).alias("tick"), F.lit(-1).alias("d")))).alias("e")
    ).groupBy(board, "e.tick").agg(F.sum("e.d").alias("d"))
    ticks = F.sequence(F.lit(0).cast("long"), F.floor((_micros(F.col("last")) - _micros(F.col("first"))) / F.lit(step)))
    grid = spans.select(board).distinct().crossJoin(F.broadcast(reach))
    grid = grid.select(board, "first", F.explode(ticks).alias("tick"))
    by_board = Window.partitionBy(board).orderBy("tick").rowsBetween(Window.unboundedPreceding, 0)
    counted = grid.join(deltas, [board, "tick"], "left").withColumn("n", F.sum(F.coalesce("d", F.lit(0))).over(by_board))
    at = F.timestamp_micros(_micros(F.col("first")) + F.col("tick") * F.lit(step))
    return counted.select(board, at.alias("time"), F.col("n").cast("long").alias("active"))


def cover(lo: Column, hi: Column, levels: list[int]) -> Column:
    """(level, bin) of the aligned stretches of 2^level units that make up [lo, hi) exactly; at most two of a level.

    levels: those looked at, from 0 on without a gap, up to one whose stretches are longer than hi - lo.
    """
    def of(level):
        unit = F.lit(1 << level)
        first, end = F.ceil(lo / unit).cast("long"), F.floor(hi / unit).cast("long")
        some = first < end
        at = lambda x: F.struct(F.lit(level).alias("level"), x.alias("bin"))
        return [F.when(some & (first % 2 != 0), at(first)), F.when(some & (end % 2 != 0), at(end - 1))]

    return F.filter(F.array(*(x for level in levels for x in of(level))), lambda x: x.isNotNull())


def active_at(spans: DataFrame, moments: DataFrame, key: list[str], unit_seconds: int = 3600) -> DataFrame:
    """JOIN-8: (moment, key) with some span start <= moment < end. moments: one column.

    A span is cut into aligned stretches of 2^level units, at most two of a level, and a moment looks for the stretch that
    it is in on each level that the spans have: a join by equality, as many rows a span as the logarithm of its length.
    Units at the edges are tested. Times without a zone are placed by the session's, an hour wider for clocks that are set back.
    """
    at = moments.columns[0]
    micros = unit_seconds * 1_000_000
    unit = lambda x: F.floor(_micros(x.cast("timestamp")) / F.lit(micros)).cast("long")
    zoneless = "timestamp_ntz" in (dict(spans.dtypes)["start"], dict(spans.dtypes)["end"], moments.dtypes[0][1])
    slack = -(-3600 // unit_seconds) if zoneless else 0
    moving = spans.where(F.col("end") > F.col("start")).withColumns({"_lo": unit(F.col("start")) - slack, "_hi": unit(F.col("end")) + 1 + slack})
    longest = moving.agg(F.max(F.col("_hi") - F.col("_lo"))).first()[0] or 1
    levels = list(range(longest.bit_length() + 1))
    cut = moving.withColumn("_e", F.explode(cover(F.col("_lo"), F.col("_hi"), levels))).drop("_lo", "_hi")
    cut = cut.withColumns({"_level": F.col("_e.level"), "_bin": F.col("_e.bin")}).drop("_e")
    bins = F.array(*(F.struct(F.lit(n).alias("level"), F.floor(unit(F.col(at)) / F.lit(1 << n)).cast("long").alias("bin")) for n in levels))
    asked = moments.where(F.col(at).isNotNull()).distinct().select(at, F.explode(bins).alias("_e")).select(at, F.col("_e.level").alias("_level"), F.col("_e.bin").alias("_bin"))
    within = (F.col("start") <= F.col(at)) & (F.col(at) < F.col("end"))
    return cut.join(asked, ["_level", "_bin"]).where(within).select(at, *key).distinct()


def jobs(history: DataFrame, key: list[str], as_of) -> DataFrame:
    """DT-3, DT-4, FLT-1, AGG-14: for each key whether it is active, its first active time and its age in seconds."""
    active = F.when(F.col("status") == "active", F.col("at"))
    found = history.groupBy(*key).agg(
        F.max_by("status", F.struct("at", "seq")).alias("status"),
        F.coalesce(F.min(active), F.min("at")).alias("since"), F.min(active).alias("first_active"),
    )
    age = F.greatest(F.lit(0.0), (_micros(as_of) - _micros(F.col("since"))) / 1e6)
    return found.select(
        *key, (F.col("status") == "active").alias("active"), "first_active", age.alias("age_seconds"),
        (age <= NEW_HOURS * 3600).alias("is_new"),
    )


def metrics(history: DataFrame, key: list[str], as_of) -> DataFrame:
    """AGG-2, AGG-3: active and new postings now, a day ago, and the differences."""
    ago = as_of - F.expr("INTERVAL 24 HOURS")
    spans = intervals(history, key, as_of)
    then = spans.groupBy(*key).agg(F.bool_or((F.col("start") <= ago) & (ago < F.col("end"))).alias("then"))
    found = jobs(history, key, as_of).join(then, key, "left")
    old = _micros(ago) - _micros(F.col("first_active"))
    was_new = F.col("then") & (old >= 0) & (old <= NEW_BEFORE_HOURS * 3_600_000_000)
    counted = found.agg(
        F.count_if("active").alias("active_now"), F.count_if(F.coalesce("then", F.lit(False))).alias("active_before"),
        F.count_if(F.col("active") & F.col("is_new")).alias("new_now"), F.count_if(F.coalesce(was_new, F.lit(False))).alias("new_before"),
    )
    return counted.select(
        "*", (F.col("active_now") - F.col("active_before")).alias("active_delta"), (F.col("new_now") - F.col("new_before")).alias("new_delta")
    )


def listed(found: DataFrame, only_active: bool = True, only_new: bool = False) -> DataFrame:
    """FLT-3: the rows of jobs() that pass both filters; the first is on by default."""
    good = F.lit(True)
    if only_active:
        good = good & F.col("active")
    if only_new:
        good = good & F.col("is_new")
    return found.where(good)


def ranked(df: DataFrame, order: list, column: str = "place", within: list[str] | None = None) -> DataFrame:
    """SRT-3, SRT-4: df with each row's place in a total order from 1 on, over all rows or for each key of `within`.

    Rows are dealt by ranges of key and order, so no task sees all rows, nor all of a key that has many; what a window adds up is
    a row for each range and key in it. A null key is a key like others.
    """
    within = within or []
    by = [*(F.col(c) for c in within), *order]
    dealt = df.repartitionByRange(*by).sortWithinPartitions(*by).select("*", F.spark_partition_id().alias("_part"))
    # one dealing serves the places and the counts
    dealt = stored(dealt.withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    before = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("_part", *within).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    met = F.col("d._part") == F.col("c._part")
    for c in within:
        met = met & F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}"))
    # without keys there is a row a range; with keys Spark chooses by the size that it finds
    placed = dealt.alias("d").join((counts if within else F.broadcast(counts)).alias("c"), met)
    return placed.select(*(f"d.{c}" for c in df.columns), (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int").alias(column))


def first_wins(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """WIN-1: of the rows of a key the first in an explicit order; a map-side minimum, not a window over the key."""
    columns = [F.col(c) for c in df.columns]
    return df.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")).select("_row.*")


def latest(df: DataFrame, key: list[str], order: list, n: int) -> DataFrame:
    """WIN-11, LIM-4: the last n rows of each key; Spark keeps n per task before it shuffles."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*(F.col(c).desc() for c in order)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
