"""Benchmark decontamination by Wu-Manber search over words.

A test item gives windows of ten consecutive words (an item of fewer words, but not none, is one window).
Windows of ten words and shorter ones are searched apart, so that short items do not shorten the shifts.
For each set the first m words of every window (m: the shortest length) fill a block-shift table: a block is two
words (one, where m is 1), and a block that no window has lets the search skip m - 1 words. Where the shift is 0,
the block's hash selects the windows that end so at word m, and each is confirmed by comparing the words.

A searcher keeps the items' bytes, hashes and places of words in flat arrays, less than ten times the items' bytes in all,
and is built once in each worker; a benchmark of more than BLOCK_BYTES is searched in several jobs, one block in memory at a time.

Edge cases: a null or wordless text has no words and no hits; an empty table gives no rows; a very long text is worked
on alone; repeated rows are searched each; a null item text has no windows; the windows of an item without an id are
searched, but name no item; repeated items count once, and windows that items share name all of them; an empty benchmark
hits nothing; columns of the input named as an added one are replaced, others stay whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.batches import Scratch, Texts, Words, add_columns, mixed, quoted

WINDOW = 10
#: Bytes of benchmark texts that are searched for in one job; larger benchmarks take more jobs.
BLOCK_BYTES = 16 << 20
_BITS = 20
_ADDED = "n_words long, hit_spans array<struct<start:int,end:int>>, item_ids array<string>"


def _blocks(hashes: np.ndarray, size: int) -> np.ndarray:
    """For each word the table slot of the block that ends there (of no use for the first word if size is 2)."""
    x = hashes.copy()
    if size == 2 and len(x):
        x[1:] += hashes[:-1] * np.uint64(0xD6E8FEB86659FD93)
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int32)


def _joined(words: Words | Packed, first: int, n: int) -> bytes:
    """Consecutive words with a space between each two."""
    low, starts, ends = words.low, words.starts, words.ends
    return b" ".join(low[starts[k] : ends[k]].tobytes() for k in range(first, first + n))


class Packed:
    """The words of texts, as Words has them: bytes in lower case, where words begin and end, each text's first word."""

    def __init__(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.low, self.starts, self.ends, self.first = low, starts, ends, first


def _packed(texts: list[bytes]) -> tuple[Packed, np.ndarray]:
    """The words of all texts and their hashes, made of some texts at a time."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])
    whole = Texts(np.frombuffer(b"".join(texts), np.uint8), bounds, np.ones(len(texts), bool))
    low, starts, ends, hashes, counts = [], [], [], [], []
    for at, _, part in whole.chunks(1 << 18):
        words = Words(part)
        low.append(words.low)
        starts.append((words.starts + bounds[at]).astype(np.int32))
        ends.append((words.ends + bounds[at]).astype(np.int32))
        hashes.append(words.hashes())
        counts.append(np.diff(words.first))
    joined = [np.concatenate(x) if x else np.zeros(0, t) for x, t in zip((low, starts, ends, hashes, counts), (np.uint8, np.int32, np.int32, np.uint64, int), strict=True)]
    return Packed(*joined[:3], np.concatenate([[0], np.cumsum(joined[4])])), joined[3]


class WuManber:
    """Searches texts, given as words, for windows: starts and lengths (in words) within the words of items."""

    def __init__(self, items: Packed, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.items, self.starts, self.lengths = items, starts, lengths
        self.m = m = int(lengths.min())
        self.block = min(2, m)
        slots = _blocks(hashes, self.block)
        self.shift = np.full(1 << _BITS, m - self.block + 1, np.uint8)
        for j in range(self.block - 1, m):  # falling shifts, so what is written last is least
            self.shift[slots[starts + j]] = m - 1 - j
        last = slots[starts + m - 1]
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.first = np.searchsorted(last[self.order], np.arange((1 << _BITS) + 1)).astype(np.int32)
        self.hashes = hashes

    def search(self, words: Words, hashes: np.ndarray):
        """(text, first word within the text, words, window) of every occurrence, in order of text and place."""
        m, first = self.m, words.first.tolist()
        slots = _blocks(hashes, self.block)
        skip = self.shift[slots].tobytes()
        for doc in range(len(first) - 1):
            lo, hi = first[doc], first[doc + 1]
            i = lo + m - 1
            while i < hi:
                if step := skip[i]:
                    i += step
                    continue
                a, slot = i - m + 1, slots[i]
                for k in self.order[self.first[slot] : self.first[slot + 1]].tolist():
                    if self.hashes[self.starts[k]] == hashes[a]:
                        n = int(self.lengths[k])
                        if a + n <= hi and _joined(words, a, n) == _joined(self.items, int(self.starts[k]), n):
                            yield doc, a - lo, n, k
                i += 1


class Searcher:
    """Both matchers over the windows of some items, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        words, hashes = _packed([t for _, t in items])
        counts = np.diff(words.first)
        made = np.where(counts > WINDOW, counts - WINDOW + 1, (counts > 0).astype(np.int64))
        ends = np.cumsum(made)
        owner = np.repeat(np.arange(len(items), dtype=np.int32), made)
        starts = np.repeat((words.first[:-1] - ends + made).astype(np.int32), made)
        starts += np.arange(len(starts), dtype=np.int32)
        lengths = np.minimum(counts, WINDOW).astype(np.uint8)[owner]
        self.names = [name for name, _ in items]
        self.matchers = []
        for full in (True, False):
            chosen = np.flatnonzero((lengths == WINDOW) == full).astype(np.int32)
            if len(chosen):
                kept, told, of = self._distinct(words, hashes, starts[chosen], lengths[chosen], owner[chosen])
                self.matchers.append((WuManber(words, hashes, starts[chosen][kept], lengths[chosen][kept]), told, of))

    @staticmethod
    def _distinct(words: Packed, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray):
        """Windows less those that repeat the words of another; the owners of each, and where each one's begin."""
        keys = lengths.astype(np.uint64)
        for lo in range(0, len(keys), 1 << 16):
            part, first, n = keys[lo : lo + (1 << 16)], starts[lo : lo + (1 << 16)], lengths[lo : lo + (1 << 16)]
            for j in range(int(n.max())):
                inside = np.flatnonzero(j < n)
                part[inside] = mixed(part[inside] * np.uint64(0x9E3779B97F4A7C15) + hashes[first[inside] + j])
        order = np.argsort(keys).astype(np.int32)
        keys = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        del keys
        for k in np.flatnonzero(~new).tolist():  # equal hashes, so equal words but for the rarest chance
            a, b = order[k - 1], order[k]
            new[k] = lengths[a] != lengths[b] or _joined(words, starts[a], lengths[a]) != _joined(words, starts[b], lengths[b])
        first = np.flatnonzero(new)
        return order[first], owner[order], np.append(first, len(order)).astype(np.int32)

    def hits(self, texts: Texts) -> tuple[np.ndarray, list[list[tuple[int, int]]], list[set]]:
        """Words of each text, the spans of words within occurrences, and the items that occur."""
        words = Words(texts)
        hashes = words.hashes()
        spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
        items: list[set] = [set() for _ in range(len(texts))]
        for matcher, told, of in self.matchers:
            for doc, at, n, k in matcher.search(words, hashes):
                spans[doc].append((at, at + n))
                items[doc].update(self.names[o] for o in told[of[k] : of[k + 1]].tolist())
        return np.diff(words.first), spans, [x - {None} for x in items]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _pass(df: DataFrame, text_col: str, shared, keep: list[str] | None) -> DataFrame:
    token = uuid.uuid4().hex

    def factory(held):
        searcher = held(token, lambda: Searcher(shared.value))

        def process(texts: Texts) -> list:
            counts, spans, items = [], [], []
            for _, _, part in texts.chunks():
                n, s, i = searcher.hits(part)
                counts.append(n)
                spans += s
                items += i
            return [
                pa.array(np.concatenate(counts) if counts else [], pa.int64()),
                [[{"start": s, "end": e} for s, e in merged(x)] if x else [] for x in spans],
                [sorted(x) for x in items],
            ]

        return process

    return add_columns(df, text_col, _ADDED, factory, keep)


def _shared(items: DataFrame):
    """A block's items on all executors; the block is bounded."""
    rows = [(r["item"], bytes(r["text"])) for r in items.distinct().collect()]
    return items.sparkSession.sparkContext.broadcast(rows)


def find_benchmark(
    df: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """df with n_words, hit_spans (merged spans of words inside occurrences) and item_ids (sorted) of each text.

    keep: the columns of df to carry (all, if None). A benchmark of one block is one narrow pass over df, so documents are
    not shuffled. A larger one is read in blocks, each a job of its own that writes its hits, so that at any time the driver
    and each worker hold one block; the documents are written once, and their hits joined by a number of the row.
    """
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item"), F.encode("text", "UTF-8").alias("text")
    ).where("text IS NOT NULL")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    return _pass(df, text_col, _shared(items), keep) if blocks == 1 else _in_blocks(df, items, text_col, keep, blocks)


def _in_blocks(df: DataFrame, items: DataFrame, text_col: str, keep: list[str] | None, blocks: int) -> DataFrame:
    scratch = Scratch(df.sparkSession)
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("n_words", "hit_spans", "item_ids")]
    others = F.struct(F.lit(True).alias("_"), *(F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(names) if c != text_col))
    texts = scratch.table(df.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(text_col)).alias("text"), others.alias("others")))
    parted = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(blocks)))
    counts, hits = None, []
    for k in range(blocks):
        shared = _shared(parted.where(F.col("block") == k).select("item", "text"))
        found = _pass(texts.select("row", "text"), "text", shared, ["row"])
        if counts is None:  # every block counts the same words
            counts = scratch.table(found)
            hits.append(counts.where(F.size("hit_spans") > 0).drop("n_words"))
        else:
            hits.append(scratch.table(found.where(F.size("hit_spans") > 0).drop("n_words")))
        shared.destroy()
    every = hits[0]
    for more in hits[1:]:
        every = every.unionByName(more)
    spans = every.select("row", F.inline("hit_spans"))
    earlier = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(earlier.rowsBetween(Window.unboundedPreceding, -1))
    apart = spans.withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    apart = apart.withColumn("island", F.sum("new").over(earlier.rowsBetween(Window.unboundedPreceding, 0)))
    whole = apart.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    whole = whole.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hit_spans"))
    named = every.select("row", F.explode("item_ids").alias("item")).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    told = counts.select("row", "n_words").join(whole, "row", "left").join(named, "row", "left")
    kept = [F.col("text" if c == text_col else f"others.c{i}").alias(c) for i, c in enumerate(names)]
    return texts.join(told, "row").select(
        *kept, "n_words", F.coalesce("hit_spans", F.array().cast("array<struct<start:int,end:int>>")).alias("hit_spans"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )


def drop_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df whose text holds no window of the benchmark, with the columns of df."""
    names = df.columns
    df = df.toDF(*(f"k{i}" for i in range(len(names))))
    found = find_benchmark(df, benchmark, df.columns[names.index(text_col)])
    return found.where(F.size("hit_spans") == 0).select(*df.columns).toDF(*names)


def digest(found: DataFrame) -> DataFrame:
    spans = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        spans.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.encode(F.array_join("item_ids", ","), "UTF-8"), 256).alias("items_sha256"),
        (F.size("hit_spans") > 0).alias("contaminated"),
    )
