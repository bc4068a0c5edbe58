"""Snapshot merge (section M of the survey): content meets scrape by board and link, giving status events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.operators import health
from jobtide.operators.history import first_wins, latest, normalized


def last_wins(df: DataFrame, key: list[str], seq: str) -> DataFrame:
    """M3."""
    return first_wins(df, key, [-F.col(seq)])


def merged(content: DataFrame, scrape: DataFrame, key: list[str], gate: DataFrame | None = None) -> DataFrame:
    """JOIN-1, M3 to M6: key, title, active, event (active, inactive or null), is_new of each posting after a snapshot.

    content: key, title, active, seq; scrape: key, title, seq. gate: board columns and `open`; boards whose gate is
    shut keep their content as it is.
    """
    old = last_wins(content, key, "seq").select(*key, F.col("title").alias("old_title"), "active", F.lit(True).alias("known"))
    new = last_wins(scrape, key, "seq").select(*key, F.col("title").alias("new_title"), F.lit(True).alias("seen"))
    both = old.join(new, key, "full_outer")
    if gate is not None:
        both = both.join(gate, [c for c in gate.columns if c != "open"], "left").withColumn("open", F.coalesce("open", F.lit(True)))
    else:
        both = both.withColumn("open", F.lit(True))
    event = (
        F.when(~F.col("open"), None)
        .when(F.col("seen") & ~F.coalesce("active", F.lit(False)), "active")
        .when(F.col("seen").isNull() & F.col("active"), "inactive")
    )
    title = F.coalesce(F.when(F.col("open"), F.nullif("new_title", F.lit(""))), "old_title", "new_title")
    return both.where(F.col("open") | F.col("known")).withColumn("event", event).select(
        *key, title.alias("title"), F.coalesce(F.col("event") == "active", "active", F.lit(False)).alias("active"), "event",
        F.col("known").isNull().alias("is_new"),
    )


def missing(content: DataFrame, scrape: DataFrame, key: list[str]) -> DataFrame:
    """JOIN-2."""
    return content.join(scrape.select(*key), key, "left_anti")


def applied(history: DataFrame, changes: DataFrame, key: list[str], at) -> DataFrame:
    """M7: the events of a merge appended to the history; normalise afterwards."""
    events = changes.where("event IS NOT NULL").select(*key, F.col("event").alias("status"), at.alias("at"), F.lit((1 << 31) - 1).alias("seq"))
    return history.select(*key, "status", "at", "seq").unionByName(events)


def content_order() -> list:
    """SRT-2, M9."""
    return [F.col("active").desc(), F.lower("title")]


def added(boards: DataFrame, fresh: DataFrame) -> DataFrame:
    """SNK-3, FLT-11: boards with the fresh ones whose slug is not there and whose fields are filled."""
    filled = F.lit(True)
    for c in ("title", "icon_url", "website_url"):
        filled = filled & (F.coalesce(F.trim(c), F.lit("")) != "")
    new = fresh.where(filled).join(boards.select("slug"), "slug", "left_anti")
    return boards.unionByName(first_wins(new, ["slug"], ["title"]), allowMissingColumns=True)


def removed(boards: DataFrame, slug: str) -> DataFrame:
    """SNK-4."""
    return boards.where(F.col("slug") != slug)


def reset(boards: DataFrame) -> DataFrame:
    """SNK-5: content emptied and both scrape times cleared; attempts, health and policy stay."""
    return boards.withColumns({
        "content": F.slice("content", 1, 0), "last_scraped": F.lit(None).cast("timestamp"), "next_scrape_at": F.lit(None).cast("timestamp"),
    })


def refreshed(boards: DataFrame, slug: str) -> DataFrame:
    """SNK-6."""
    cleared = {c: F.when(F.col("slug") != slug, F.col(c)) for c in ("last_scraped", "next_scrape_at")}
    return boards.withColumns(cleared)


def apply_scrape(
    content: DataFrame, history: DataFrame, attempts: DataFrame, attempt: DataFrame, scrape: DataFrame, board: str = "board", two_zeros: bool = True
) -> dict[str, DataFrame]:
    """M1 to M9 for one snapshot of each board, in this order: attempt, health, gate, merge, history, markers.

    content: board, link, title, active, seq; history: board, link, status, at, seq; attempts: board, at, seq, ok, n;
    attempt: board, at, ok (one row for each board that was scraped); scrape: board, link, title, seq. The attempt is
    recorded first, whatever it brings, and the log keeps its last rows. A snapshot without rows only deactivates if the
    gate is open; one with rows merges even if it is marked as failed, as the model of the boards has it.

    Gives `attempts`, `health` (after the attempt), `content`, `history`, and `markers` (the boards whose last success
    this is: at and number of postings).
    """
    key = [board, "link"]
    counted = attempt.join(scrape.select(board, "link").distinct().groupBy(board).agg(F.count("*").alias("n")), board, "left")
    counted = counted.withColumn("n", F.coalesce("n", F.lit(0)))
    log = attempts.select(board, "at", "seq", "ok", "n").unionByName(counted.select(board, "at", F.lit((1 << 31) - 1).alias("seq"), "ok", "n"))
    log = latest(log, [board], ["at", "seq"], health.LOG_LENGTH)
    now = health.states(log, board).join(attempt.select(board, "at"), [board, "at"], "left_semi").where(F.col("seq") == (1 << 31) - 1)
    gate = now.select(board, ((F.col("n") > 0) | health.may_deactivate(two_zeros)).alias("open"))
    own = content.join(attempt.select(board), board, "left_semi")
    changed = merged(own, scrape, key, gate)
    untouched = last_wins(content.join(attempt.select(board), board, "left_anti"), key, "seq")
    nothing = untouched.select(*key, "title", "active", F.lit(None).cast("string").alias("event"), F.lit(False).alias("is_new"))
    events = changed.where("event IS NOT NULL").join(attempt.select(board, "at"), board)
    events = events.select(*key, F.col("event").alias("status"), "at", F.lit((1 << 31) - 1).alias("seq"))
    told = normalized(history.select(*key, "status", "at", "seq").unionByName(events), key)
    markers = now.where("ok AND n > 0").select(board, F.col("at").alias("last_success_at"), F.col("n").alias("last_success_count"))
    return {"attempts": log, "health": now, "content": changed.unionByName(nothing), "history": told, "markers": markers}


def replayed(log: DataFrame, scrapes: DataFrame, board: str = "board", two_zeros: bool = True) -> DataFrame:
    """Status events (board, link, status, at) of many snapshots of each board merged in their order.

    log: board, at, seq, ok of all attempts; scrapes: board, seq, link of what each of them brought. A snapshot counts if
    it has rows or the gate is open (M2); of those that count a link becomes active at the first that has it after one
    that has not, and inactive at the first that has it no more. Work is by the rows of the scrapes: no link is paired
    with the snapshots that lack it.
    """
    rows = scrapes.select(board, "seq", "link").distinct()
    attempts = log.join(rows.groupBy(board, "seq").agg(F.count("*").alias("n")), [board, "seq"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    states = health.states(attempts, board)
    counts = states.where((F.col("n") > 0) | health.may_deactivate(two_zeros))
    in_order = Window.partitionBy(board).orderBy("at", "seq")
    placed = counts.select(board, "seq", "at", F.row_number().over(in_order).alias("k"), F.lead("at").over(in_order).alias("next_at"))
    seen = rows.join(placed, [board, "seq"])
    by_link = Window.partitionBy(board, "link").orderBy("k")
    seen = seen.withColumns({"before": F.lag("k").over(by_link), "after": F.lead("k").over(by_link)})
    begins = seen.where("before IS NULL OR before < k - 1").select(board, "link", F.lit("active").alias("status"), "at")
    ends = seen.where("(after IS NULL OR after > k + 1) AND next_at IS NOT NULL").select(board, "link", F.lit("inactive").alias("status"), F.col("next_at").alias("at"))
    return begins.unionByName(ends)
