"""Board documents (SRC-1 to SRC-3, SNK-1, SNK-2, SNK-7): nested JSON in, tables out and back."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.operators.history import first_wins

SCHEMA = """title STRING, icon_url STRING, website_url STRING,
attempts ARRAY<STRUCT<at TIMESTAMP, ok BOOLEAN, count INT, duration_ms INT, renderer_used BOOLEAN, error_kind STRING>>,
scrape_health STRUCT<status STRING, reason STRING, first_zero_at TIMESTAMP, consecutive_zero_attempts INT,
  flagged_until TIMESTAMP, last_nonzero_at TIMESTAMP, last_nonzero_count INT, baseline_nonzero_count INT,
  last_success_at TIMESTAMP, last_success_count INT>,
policy STRUCT<time_flag_duration_s INT, attempt_threshold_for_down INT, attempt_window_size INT,
  min_baseline_to_flag INT, require_two_successful_zeros_to_deactivate BOOLEAN, manual_override BOOLEAN>,
last_scraped TIMESTAMP, last_success_at TIMESTAMP, next_scrape_at TIMESTAMP,
content ARRAY<STRUCT<title STRING, link STRING, history ARRAY<STRUCT<status STRING, at TIMESTAMP>>>>"""
STATUSES = ("active", "inactive")
HEALTH = ("normal", "suspect", "down")


def read(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(valid boards with file and slug, quarantined documents): malformed JSON or a broken rule quarantines a document."""
    raw = (
        spark.read.schema(SCHEMA + ", _corrupt STRING").option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    )
    raw = raw.withColumn("file", F.col("_metadata.file_name")).withColumn("slug", F.regexp_replace("file", r"\.json$", ""))
    named = F.forall(F.coalesce("content", F.array()), lambda j: (F.length(j["title"]) >= 1) & F.forall(F.coalesce(j["history"], F.array()), lambda h: h["status"].isin(*STATUSES)))
    health = F.coalesce(F.col("scrape_health.status").isin(*HEALTH), F.lit(True))
    valid = F.coalesce(F.col("_corrupt").isNull() & (F.length("title") >= 1) & named & health, F.lit(False))
    return raw.where(valid).drop("_corrupt"), raw.where(~valid).select("file", "_corrupt")


def attempts(boards: DataFrame) -> DataFrame:
    return boards.select("slug", F.posexplode("attempts").alias("seq", "a")).select(F.col("slug").alias("board"), "seq", "a.at", "a.ok", F.col("a.count").alias("n"), "a.duration_ms", "a.renderer_used", "a.error_kind")


def jobs(boards: DataFrame) -> DataFrame:
    return boards.select("slug", F.posexplode("content").alias("pos", "j")).select(F.col("slug").alias("board"), "pos", "j.title", "j.link")


def with_boards(postings: DataFrame, boards: DataFrame) -> DataFrame:
    """JOIN-12: postings (board and others) with their board's title, icon and URL."""
    told = boards.select(F.col("slug").alias("board"), F.col("title").alias("board_title"), "icon_url", "website_url")
    return postings.join(told, "board")


def by_slug(boards: DataFrame, slug: str) -> DataFrame:
    """JOIN-10."""
    return boards.where(F.col("slug") == slug)


def totals(found: DataFrame) -> DataFrame:
    """AGG-6, AGG-12, AGG-15, AGG-16: one row: boards in order of name, attempts, those that rendered, postings found.

    found: board, renderer_used, n of all attempts; the list holds each board once.
    """
    return found.agg(
        F.array_sort(F.collect_set("board")).alias("boards"), F.count("*").alias("attempted"),
        F.count_if(F.coalesce("renderer_used", F.lit(False))).alias("rendered"), F.coalesce(F.sum("n"), F.lit(0)).alias("found"),
    )


def by_content(files: DataFrame, column: str = "content") -> DataFrame:
    """SNK-10: files with the address of their bytes (sha256, lowercase hex); of equal ones the first path stays."""
    addressed = files.withColumn("address", F.sha2(F.col(column), 256))
    return first_wins(addressed, ["address"], ["path"])


def images(sources: DataFrame) -> DataFrame:
    """SRC-13: sources (source) with the bytes of data URIs, percent-encoded or in base64; others have none here.

    Bytes of files come from spark.read.format("binaryFile"), those of URLs from fetch.
    """
    source = F.col("source")
    head, body = (F.regexp_extract(source, r"(?is)^data:([^,]*),(.*)$", k) for k in (1, 2))
    plain = F.encode(F.coalesce(F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))), body), "UTF-8")
    based = F.try_to_binary(F.regexp_replace(body, r"\s+", ""), F.lit("base64"))
    return sources.withColumn("bytes", F.when(source.rlike(r"(?is)^data:[^,]*,"), F.when(F.lower(head).endswith(";base64"), based).otherwise(plain)))


class Cached:
    """SRC-4: a table that is read anew when it is older than its time; what was given out before does not change."""

    def __init__(self, read, seconds: float = 30.0, clock=time.monotonic):
        self._read, self._seconds, self._clock, self._at, self._held = read, seconds, clock, None, None

    def get(self) -> DataFrame:
        if self._at is None or self._clock() - self._at >= self._seconds:
            self.refresh()
        return self._held

    def refresh(self) -> None:
        self._held, self._at = self._read(), self._clock()


def events(boards: DataFrame) -> DataFrame:
    """EXP-1: board, link, status, at, seq."""
    content = boards.select(F.col("slug").alias("board"), F.explode("content").alias("j"))
    placed = content.select("board", "j.link", F.posexplode("j.history").alias("seq", "h"))
    return placed.select("board", "link", "h.status", "h.at", "seq")


def assembled(content: DataFrame, history: DataFrame) -> DataFrame:
    """slug and content arrays from postings (board, title, link, active) and events: active first, then by title."""
    told = history.groupBy("board", "link").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "status"))).alias("h"))
    told = told.select("board", "link", F.transform("h", lambda e: F.struct(e["status"].alias("status"), e["at"].alias("at"))).alias("history"))
    order = F.struct((~F.col("active")).alias("inactive"), F.lower("title").alias("lower"), "link", F.struct("title", "link", "history").alias("job"))
    grouped = content.join(told, ["board", "link"], "left").groupBy("board").agg(F.array_sort(F.collect_list(order)).alias("c"))
    return grouped.select(F.col("board").alias("slug"), F.transform("c", lambda x: x["job"]).alias("content"))


def write(boards: DataFrame, folder: str, dry_run: bool = False) -> None:
    """One JSON line for each board, written whole or not at all; nothing in a dry run."""
    if not dry_run:
        boards.write.mode("overwrite").json(folder)


def write_tsv(postings: DataFrame, folder: str) -> None:
    postings.select(F.translate("title", "\t", " ").alias("title"), "link").write.mode("overwrite").option("sep", "\t").csv(folder)
