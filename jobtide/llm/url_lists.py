"""URL filters by a temporal list join, in DataFrame functions only.

A list is a log of dated entries: kind (`domain`: a host and all hosts below it, `host`: one host, `prefix`: a host and
the first segments of a path), value, action (`block`, `allow`, or `remove`, which ends the entry before it) and the
time of listing. Per kind and value each entry is valid from its own time until the next one's. Every capture (a URL
and when it was fetched) is joined with the entries of its keys that are valid at its fetch time, and the most specific
one decides: the longest prefix, else the host, else the longest domain.

A URL gives keys only as deep as the list's deepest domain and prefix, so a very long URL gives few and short ones. The
validity intervals are broadcast if they are few (BROADCAST_ENTRIES, counted first). Else the keys that no entry has are
left out where they arise, by the hashed SLOTS of the list's keys (at most SLOTS numbers, broadcast), and the rest meet
the intervals by key, salted so that a host with a third of all captures is spread over SALTS tasks.

Edge cases: a null or unparsable URL, and a capture without a fetch time, match nothing and are kept; a very long URL is
matched by its whole host and the segments that prefixes reach; entries with a null value, action or time, or an unknown
kind or action, are ignored; of entries of one key and time `block` wins, then `allow`; repeated captures each get a
row; an empty list decides nothing, and no captures give no rows; columns of the captures named as an added one are
replaced, others stay whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.batches import quoted

KINDS = ("domain", "host", "prefix")
BROADCAST_ENTRIES = 50_000
SALTS = 16
SLOTS = 1 << 20
#: Scheme, user, host; then the path after it. Port, query and fragment are left out.
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/[^?#]*)"

#: The production list: kind, value, action, day of listing.
PRODUCTION_LIST = (
    ("domain", "casino-win.example.com", "block", "2024-01-10"),
    ("domain", "casino-win.example.com", "remove", "2024-09-01"),
    ("domain", "free-bets.example.com", "block", "2024-02-01"),
    ("domain", "free-bets.example.com", "allow", "2024-05-01"),
    ("domain", "free-bets.example.com", "block", "2024-06-15"),
    ("domain", "example.org", "block", "2024-03-01"),
    ("domain", "example.org", "remove", "2024-03-15"),
    ("domain", "example.org", "block", "2024-11-01"),
    ("host", "m.casino-win.example.com", "allow", "2024-04-01"),
    ("host", "m.casino-win.example.com", "remove", "2024-04-20"),
    ("host", "tionsh.example.net", "block", "2024-07-01"),
    ("host", "tionsh.example.net", "allow", "2024-08-01"),
    ("host", "blog.tionble.example.com", "block", "2024-02-20"),
    ("host", "m.thther.example.org", "allow", "2024-11-10"),
    ("prefix", "tionsh.example.net/en", "block", "2024-10-01"),
    ("prefix", "ththon.example.com/en", "block", "2024-05-05"),
    ("prefix", "ththon.example.com/en", "remove", "2024-05-25"),
)


def intervals(entries: DataFrame) -> DataFrame:
    """key, kind, value, action, valid_from, valid_to (null: still valid) of entries (kind, value, action, listed_at)."""
    value = F.regexp_replace(F.lower("value"), r"\.?(/.*?)?/*$", "$1")
    rank = F.when(F.col("action") == "block", 2).when(F.col("action") == "allow", 1).when(F.col("action") == "remove", 0)
    known = entries.select("kind", value.alias("value"), rank.alias("rank"), F.col("listed_at").alias("valid_from"))
    known = known.where(F.col("kind").isin(*KINDS)).dropna()
    known = known.groupBy("kind", "value", "valid_from").agg(F.max("rank").alias("rank"))
    following = Window.partitionBy("kind", "value").orderBy("valid_from")
    dated = known.withColumn("valid_to", F.lead("valid_from").over(following)).where("rank > 0")
    return dated.select(
        F.concat_ws("|", "kind", "value").alias("key"), "kind", "value",
        F.when(F.col("rank") == 2, "block").otherwise("allow").alias("action"), "valid_from", "valid_to",
    )


def keys(url, labels_deep: int, segments_deep: int) -> F.Column:
    """The keys of a URL: its host, the domains above it of at most so many labels, and its path's prefixes likewise."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"\.+$", "")
    labels = F.split(host, r"\.")
    deepest = F.least(F.size(labels), F.lit(max(1, labels_deep)))
    domains = F.transform(
        F.sequence(F.lit(1), deepest), lambda k: F.concat(F.lit("domain|"), F.array_join(F.slice(labels, F.size(labels) - k + 1, k), "."))
    )
    segments = F.filter(F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/"), lambda s: s != "")
    prefixes = F.transform(
        F.sequence(F.lit(0), F.least(F.size(segments), F.lit(segments_deep))),
        lambda k: F.concat(F.lit("prefix|"), F.array_join(F.concat(F.array(host), F.slice(segments, F.lit(1), k)), "/")),
    )
    return F.when(
        F.coalesce(host, F.lit("")) != "", F.concat(F.array(F.concat(F.lit("host|"), host)), domains, prefixes)
    )


def filter_urls(
    captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at",
    keep: list[str] | None = None, broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """captures with decision (block, allow or none), list_kind, list_value and listed_at of the entry that decided."""
    added = ("decision", "list_kind", "list_value", "listed_at")
    kept = [c for c in (captures.columns if keep is None else keep) if c.lower() not in added]
    listed = intervals(entries)
    few = listed.limit(broadcast_entries + 1).count() <= broadcast_entries
    deep = listed.agg(
        F.max(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\.")))).alias("labels"),
        F.max(F.when(F.col("kind") == "prefix", F.size(F.split("value", "/")) - 1)).alias("segments"),
    ).first()  # one row
    rows = captures.select(
        F.struct(*(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(kept))).alias("row"),
        F.col(quoted(time_col)).alias("at"), keys(F.col(quoted(url_col)), deep["labels"] or 0, deep["segments"] or 0).alias("keys"),
        F.monotonically_increasing_id().alias("id"),
    )
    spread = rows.select("id", "row", "at", F.explode_outer("keys").alias("key"))
    valid = (F.col("valid_from") <= F.col("at")) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    if few:
        met = spread.join(F.broadcast(listed), (spread["key"] == listed["key"]) & valid, "left")
    else:
        slot = F.pmod(F.xxhash64("key"), F.lit(SLOTS)).cast("int")
        there = F.broadcast(listed.select(slot.alias("slot"), F.lit(True).alias("hit")).distinct())  # SLOTS numbers at most
        # each capture also goes on once without a key
        every = F.concat(F.coalesce("keys", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))
        spread = rows.select("id", "row", "at", F.explode(every).alias("key")).withColumn("slot", slot)
        spread = spread.join(there, "slot", "left").where("key IS NULL OR hit").select("id", "row", "at", "key")
        salted = listed.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        spread = spread.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
        met = spread.join(salted, (spread["key"] == salted["key"]) & (F.col("own") == F.col("salt")) & valid, "left")
    specific = F.when(F.col("kind") == "prefix", 2).when(F.col("kind") == "host", 1).otherwise(0)
    entry = F.struct(specific.alias("s"), F.length("value").alias("n"), "action", "kind", "value", "valid_from")
    best = F.max(F.when(F.col("kind").isNotNull(), entry)).alias("best")
    decided = met.groupBy("id").agg(F.first("row").alias("row"), best)
    return decided.select(
        *(F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)),
        F.coalesce("best.action", F.lit("none")).alias("decision"),
        F.col("best.kind").alias("list_kind"), F.col("best.value").alias("list_value"),
        F.col("best.valid_from").alias("listed_at"),
    )


def production_list(spark) -> DataFrame:
    rows = ", ".join(f"('{k}', '{v}', '{a}', TIMESTAMP '{d} 00:00:00')" for k, v, a, d in PRODUCTION_LIST)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(kind, value, action, listed_at)")


def dated_captures(pages: DataFrame) -> DataFrame:
    """The table has no fetch times: the k-th page of each 366 counts as fetched at noon of day k of 2024."""
    at = F.timestamp_seconds(F.lit(1704110400) + F.pmod(F.col("page_id"), F.lit(366)) * 86400)
    return pages.select("page_id", "url", at.alias("fetched_at"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "page_id", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "decision", "list_kind", "list_value",
        F.date_format("listed_at", "yyyy-MM-dd").alias("listed_on"), (F.col("decision") != "block").alias("kept"),
    )


_VALUES = ", ".join(f"('{k}', '{v}', '{a}', TIMESTAMP '{d} 00:00:00')" for k, v, a, d in PRODUCTION_LIST)
ORACLE = rf"""
WITH e AS (SELECT * FROM (VALUES {_VALUES}) AS t(kind, value, action, valid_from)),
i AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY kind, value ORDER BY valid_from) AS valid_to FROM e),
p AS (
  SELECT page_id, TIMESTAMP '2024-01-01 12:00:00' + INTERVAL 1 DAY * CAST(page_id % 366 AS INTEGER) AS fetched,
    regexp_extract(lower(url), '{HOST}', 1) AS host,
    rtrim(regexp_extract(lower(url), '{PATH}', 1), '/') || '/' AS path FROM pages),
m AS (
  SELECT p.page_id, i.*, row_number() OVER (PARTITION BY p.page_id ORDER BY
    CASE kind WHEN 'prefix' THEN 2 WHEN 'host' THEN 1 ELSE 0 END DESC, length(value) DESC) AS rn
  FROM p JOIN i ON valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to) AND action <> 'remove' AND (
    (kind = 'host' AND host = value) OR (kind = 'domain' AND (host = value OR ends_with(host, '.' || value)))
    OR (kind = 'prefix' AND starts_with(host || path, value || '/'))))
SELECT p.page_id, strftime(fetched, '%Y-%m-%d') AS fetched_on, coalesce(action, 'none') AS decision, kind AS list_kind,
  value AS list_value, strftime(valid_from, '%Y-%m-%d') AS listed_on, coalesce(action, 'none') <> 'block' AS kept
FROM p LEFT JOIN (SELECT * FROM m WHERE rn = 1) AS m USING (page_id)
"""
