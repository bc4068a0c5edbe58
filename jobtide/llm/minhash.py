"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, then verified.

A shingle is five consecutive words (all words, of a text with fewer). Its weight in a text is (1 + ln tf) * idf. The
idf falls with the share of the texts that have the shingle, df / N, from 2 at LEAST_SHARE and below to 1 at all of
them: 1 + ln(1 / share) / ln(1 / LEAST_SHARE). Only shares count, so a table of any size weighs alike, and only the
shingles above LEAST_SHARE need a number. They are found exactly in two passes: SLOTS hashed counters over all texts tell
which slots can hold one, then the shingles of these slots are counted by their hash. At most mean shingles of a text
/ LEAST_SHARE can be that frequent, however many texts there are; these are broadcast.

HASHES consistent weighted samples of a text are grouped in BANDS; texts that agree in a band meet in a bucket. Each
member is paired with its bucket's smallest member, the pairs are verified by exact weighted Jaccard similarity, and
verified links give components. Where a bucket still holds several components, blocks of its members (of BLOCK_BYTES of
text) meet in tasks, which find all similar pairs of different components and give the links only. So every pair of
different texts that meets in a bucket is compared or already connected. Comparing leaves out only pairs that cannot be
similar: whose total weights are too far apart, or that share none of the rarest shingles that make up more of a text
than it may lack.

Edge cases: equal texts, empty ones included, are always of one class; a null text is a class of its own for each row;
a text without words has no shingles and is like equal texts only; a very long text is worked on alone and takes memory
in proportion to its words; repeated rows are of one class and keep one row; the smallest id stands for a class, null
ids last; an empty table gives no rows; columns of the input named as an added one are replaced, others stay whatever
their names.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.batches import Scratch, Texts, Words, add_columns, mixed, quoted, trim
from jobtide.llm.components import components

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 12, 4
HASHES = BANDS * ROWS
SLOTS = 1 << 20
LEAST_SHARE = 1 / 512
#: Bytes of text of a bucket's members that are compared at once with as many others.
BLOCK_BYTES = 8 << 20
_PART = 4096
#: Distinct shingles that a task counts before it passes their counts on.
_HELD = 1 << 20
_POOL_BITS = 16


def shingles(texts: Texts, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all shingles, and for each text its first shingle's index (one more at the end)."""
    words = Words(texts)
    hashes = words.hashes()
    counts = np.diff(words.first)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(made)])
    padded = np.append(hashes, np.zeros(size, np.uint64))
    at = np.arange(first[-1]) + np.repeat(words.first[:-1] - first[:-1], made)
    left = np.repeat(counts, made)
    total = np.zeros(len(at), np.uint64)
    for k in range(size):
        word = padded[at + k]
        if k:
            word = np.where(left > k, word, np.uint64(0))  # a short text's shingle ends with the text
        total = total * np.uint64(0x9E3779B97F4A7C15) + word
    return mixed(total), first


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)


class Idf:
    """Inverse document frequencies: of N texts, `found` (sorted hashes) occur in `counts`; all others are rare."""

    def __init__(self, texts_n: int, found: np.ndarray, counts: np.ndarray):
        self.found = found
        share = np.maximum(counts / max(1, texts_n), LEAST_SHARE)
        self.value = np.append(1 - np.log(share) / -np.log(LEAST_SHARE), 2).astype(np.float32)
        self.heavy = np.zeros(SLOTS, bool)
        self.heavy[slots(found)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), self.value[-1])
        at = np.flatnonzero(self.heavy[slots(hashes)])
        place = np.searchsorted(self.found, hashes[at])
        same = place < len(self.found)
        same[same] = self.found[place[same]] == hashes[at[same]]
        out[at[same]] = self.value[place[same]]
        return out


def features(texts: Texts, idf: Idf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, their weights, and each text's first index."""
    hashes, first = shingles(texts)
    kept, weights, ends = [], [], [0]
    for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        own = np.sort(hashes[lo:hi])
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        kept.append(own[starts])
        weights.append(np.diff(np.append(starts, len(own))))
        ends.append(ends[-1] + len(starts))
    found = np.concatenate(kept or [np.zeros(0, np.uint64)])
    tf = np.concatenate(weights or [np.zeros(0)])
    return found, (1 + np.log(tf)) * idf.of(found), np.array(ends)


class Sampler:
    """Improved consistent weighted sampling; each random number is drawn by bits of its own of the shingle's hash."""

    def __init__(self, hashes: int = HASHES, seed: int = 20_240_501):
        draw = np.random.default_rng(seed)
        n = 1 << _POOL_BITS
        self.r = draw.gamma(2, 1, n).astype(np.float32)
        self.log_c = np.log(draw.gamma(2, 1, n)).astype(np.float32)
        self.odd = draw.integers(0, 1 << 63, hashes, np.uint64) * np.uint64(2) + np.uint64(1)

    def samples(self, found: np.ndarray, weights: np.ndarray, first: np.ndarray) -> np.ndarray:
        """int32 [texts, hashes]; texts without shingles have zeros."""
        counts = np.diff(first)
        full = np.flatnonzero(counts)
        out = np.zeros((len(counts), len(self.odd)), np.int32)
        if not len(full):
            return out
        starts, counts = first[:-1][full], counts[full]
        log_w = np.log(weights).astype(np.float32)
        for k, odd in enumerate(self.odd):
            drawn = mixed_by(found, odd)
            high = (drawn >> np.uint64(32)).astype(np.uint32)
            r = self.r[high >> np.uint32(_POOL_BITS)]
            beta = (drawn & np.uint64(0xFFFFFFFF)).astype(np.float32) * np.float32(2**-32)
            t = np.floor(log_w / r + beta)
            log_a = self.log_c[high & np.uint32((1 << _POOL_BITS) - 1)] - r * (t - beta + 1)
            least = np.repeat(np.minimum.reduceat(log_a, starts), counts)
            ties = np.flatnonzero(log_a == least)
            owner = np.searchsorted(starts, ties, "right") - 1
            # of ties the one with the smallest hash, whatever its place
            order = np.lexsort((drawn[ties], owner))
            owner, ties = owner[order], ties[order]
            chosen = ties[np.concatenate([[True], owner[1:] != owner[:-1]])]
            value = mixed(found[chosen] + t[chosen].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            out[full, k] = (value >> np.uint64(32)).astype(np.uint32).view(np.int32)
        return out


def mixed_by(found: np.ndarray, odd: np.uint64) -> np.ndarray:
    x = found * odd
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of (sorted distinct hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = float(np.minimum(a[1][i], b[1][j]).sum())
    total = float(a[1].sum() + b[1].sum()) - least
    return least / total if total else 0.0


def _slot_counts(df: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Texts with a word, and for each slot how many shingles of texts are in it (one for each text that has it)."""

    def count(batches):
        total, texts_n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for _, _, part in Texts.of(batch.column(0)).chunks():
                hashes, first = shingles(part)
                total += np.bincount(slots(_distinct(hashes, first)), minlength=SLOTS)
                texts_n += int((np.diff(first) > 0).sum())
        for k, part in enumerate(total.reshape(-1, _PART)):
            at = np.flatnonzero(part)
            if len(at) or not k:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([at.astype(np.uint16).tobytes()], pa.binary()),
                     pa.array([part[at].astype(np.uint32).tobytes()], pa.binary()), pa.array([0 if k else texts_n], pa.int64())],
                    ["part", "at", "n", "texts"],
                )

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        texts_n: dict[int, int] = {}
        for batch in batches:
            for k, at, n, texts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total = sums.setdefault(k, np.zeros(_PART, np.int64))
                total[np.frombuffer(at, np.uint16)] += np.frombuffer(n, np.uint32)
                texts_n[k] = texts_n.get(k, 0) + texts
        for k, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary()), pa.array([texts_n[k]], pa.int64())],
                ["part", "n", "texts"],
            )

    parts = df.select(quoted(text_col)).mapInArrow(count, "part int, at binary, n binary, texts long")
    sums = parts.repartition("part").mapInArrow(add, "part int, n binary, texts long").collect()  # SLOTS numbers
    table = np.zeros((SLOTS // _PART, _PART), np.int64)
    for r in sums:
        table[r["part"]] = np.frombuffer(r["n"], np.int64)
    return sum(r["texts"] for r in sums), table.reshape(-1)


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The shingles of all texts, each once for each text that has it."""
    own = np.repeat(np.arange(len(first) - 1, dtype=np.uint64), np.diff(first))
    order = np.lexsort((hashes, own))
    hashes, own = hashes[order], own[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1])
    return hashes[keep]


def inverse_frequencies(df: DataFrame, text_col: str) -> Idf:
    """The idf of all shingles, from all texts of df: exact for those that more than LEAST_SHARE of the texts have."""
    texts_n, table = _slot_counts(df, text_col)
    heavy = df.sparkSession.sparkContext.broadcast(table > LEAST_SHARE * texts_n)  # SLOTS flags

    def count(batches):
        keep, held, n = heavy.value, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def passed():
            return pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(n)], ["h", "n"])

        for batch in batches:
            for _, _, part in Texts.of(batch.column(0)).chunks():
                hashes, first = shingles(part)
                wanted = np.flatnonzero(keep[slots(hashes)])
                own = np.searchsorted(wanted, first)
                held, at = np.unique(np.concatenate([held, _distinct(hashes[wanted], own)]), return_inverse=True)
                n = np.bincount(at, np.concatenate([n, np.ones(len(at) - len(n), np.int64)]), len(held)).astype(np.int64)
                if len(held) > _HELD:
                    yield passed()
                    held, n = held[:0], n[:0]
        yield passed()
        trim()

    counted = df.select(quoted(text_col)).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    rows = counted.where(F.col("n") > LEAST_SHARE * texts_n).toPandas()  # mean shingles of a text / LEAST_SHARE at most
    found, counts = rows["h"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(found)
    return Idf(texts_n, found[order], counts[order])


def _verified(pairs: DataFrame, texts: DataFrame, shared, threshold: float) -> DataFrame:
    """Pairs (a, b) of ids that are similar; texts: id, text of every id."""
    # the many members of a bucket first, so that a leader's text is not dealt out with each of them
    both = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b")
    both = both.join(texts.select(F.col("id").alias("a"), F.col("text").alias("left")), "a")

    def judge(batches):
        idf = shared.value
        for batch in batches:
            ids, left, right = batch.column(0).to_numpy(), batch.column(2), Texts.of(batch.column(3))
            good = np.zeros(len(right), bool)
            for lo, hi, part in right.chunks():
                f2, w2, first2 = features(part, idf)
                heads = np.flatnonzero(np.diff(ids[lo:hi], prepend=-1))  # one text for each run of pairs with one leader
                f, w, first = features(Texts.of(left.take(pa.array(lo + heads))), idf)
                of = np.searchsorted(heads, np.arange(hi - lo), "right") - 1
                for i, j in enumerate(of.tolist()):
                    s, s2 = slice(first[j], first[j + 1]), slice(first2[i], first2[i + 1])
                    good[lo + i] = similarity((f[s], w[s]), (f2[s2], w2[s2])) >= threshold
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good))
        trim()

    return both.select("a", "b", "left", "right").mapInArrow(judge, "a long, b long")


def _linked(rows, idf: Idf, threshold: float):
    """Links between the rows of a block pair: the table has own, id, label and text.

    Rows of one label are connected already, as are those that a link found here has connected. Of the others those are
    compared that share one of a row's rarest shingles, taken until they weigh more than a similar text may lack.
    """
    block, ids, labels = (rows.column(k).to_numpy() for k in ("own", "id", "label"))
    left, right = np.flatnonzero(block == block.min()), block == block.max()
    labels = labels.copy()
    if (labels == labels[0]).all():
        return
    hashes, weights, first = features(Texts.of(rows.column("text")), idf)
    total = np.add.reduceat(weights, first[:-1])
    every, codes = np.unique(hashes, return_inverse=True)
    owner = np.repeat(np.arange(len(labels)), np.diff(first))
    postings = owner[np.argsort(codes, kind="stable")]
    lengths = np.bincount(codes, minlength=len(every))
    begins = np.cumsum(lengths) - lengths
    held = np.zeros(len(every))  # the weights of one text, by shingle
    for i in left.tolist():
        own, own_w = codes[first[i] : first[i + 1]], weights[first[i] : first[i + 1]]
        order = np.argsort(lengths[own], kind="stable")
        lacks = np.cumsum(own_w[order])
        rare = own[order[: int(np.searchsorted(lacks, (1 - threshold) * total[i] * (1 + 1e-6))) + 1]]
        n = lengths[rare]
        found = postings[np.repeat(begins[rare] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        marked = np.zeros(len(labels), bool)
        marked[found] = True
        marked &= right & (labels != labels[i]) & (np.minimum(total, total[i]) >= threshold * np.maximum(total, total[i]) * (1 - 1e-6))
        good = np.flatnonzero(marked)
        held[own] = own_w
        for lo in range(0, len(good), 256):
            part = good[lo : lo + 256]
            counts = first[part + 1] - first[part]
            starts = np.cumsum(counts) - counts
            at = np.arange(counts.sum()) + np.repeat(first[part] - starts, counts)
            least = np.add.reduceat(np.minimum(held[codes[at]], weights[at]), starts)
            for j in part[least >= threshold * (total[i] + total[part] - least)].tolist():
                if labels[j] != labels[i]:
                    labels[labels == labels[j]] = labels[i]
                    yield min(ids[i], ids[j]), max(ids[i], ids[j])
        held[own] = 0


def _across(members: DataFrame, shared, threshold: float) -> DataFrame:
    """Links (a, b) between a bucket's members of different labels, block by block. members: bucket, blocks, id, label, text."""
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    spread = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "label", "text"
    )

    def compare(batches):
        rest = None
        for batch in chain(batches, [None]):
            table = rest if batch is None else pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
            if table is None or not len(table):
                continue
            keys = np.stack([table.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
            end = len(table) if batch is None else int(edges[-1]) if len(edges) else 0
            edges = [0, *edges[edges < end].tolist(), end] if end else [0]
            found = [x for lo, hi in zip(edges, edges[1:], strict=False) for x in _linked(table.slice(lo, hi - lo), shared.value, threshold)]
            a, b = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            rest = table.slice(end)
        trim()

    dealt = spread.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(compare, "a long, b long")


def text_key(column) -> list:
    """96 bits of a text."""
    return [F.xxhash64(column).alias("h"), F.crc32(column.cast("binary")).alias("c")]


def classes(df: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str = "doc_id", threshold: float = SIMILARITY) -> DataFrame:
    """For each text that is not null: h, c (its key), class_id (the smallest id of its class), class_rows, least_rows.

    class_rows: rows of the class; least_rows: those that have the smallest id (more than one if rows repeat).
    """
    spark = df.sparkSession
    docs = df.select(F.col(quoted(id_col)).alias("doc"), F.col(quoted(text_col)).alias("text")).where("text IS NOT NULL")
    keyed = docs.select("doc", "text", *text_key(F.col("text")))
    order = F.coalesce("doc", F.lit((1 << 63) - 1))
    ids = keyed.groupBy("h", "c", order.alias("doc")).agg(F.count("*").alias("n"))
    ids = ids.groupBy("h", "c").agg(F.min(F.struct("doc", "n")).alias("least"), F.sum("n").alias("n"))
    ids = scratch.table(ids.select("h", "c", "least", "n", F.monotonically_increasing_id().alias("id")))

    shared = spark.sparkContext.broadcast(inverse_frequencies(docs, "text"))

    def factory(_):
        sampler = Sampler()

        def process(texts: Texts) -> list:
            made, totals = [], []
            for _, _, part in texts.chunks():
                found, weights, first = features(part, shared.value)
                samples = sampler.samples(found, weights, first)
                made += [row if n else None for row, n in zip(samples, np.diff(first), strict=True)]
                totals.append(np.bincount(np.repeat(np.arange(len(part)), np.diff(first)), weights, len(part)))
            return [pa.array(made, pa.list_(pa.int32())), pa.array(np.concatenate(totals or [[]]))]

        return process

    sampled = add_columns(keyed, "text", "samples array<int>, total double", factory, ["h", "c"]).where("samples IS NOT NULL")
    sampled = sampled.groupBy("h", "c").agg(F.first("samples").alias("samples"), F.first("total").alias("total"))
    sampled = scratch.table(sampled.join(ids, ["h", "c"]).select("id", "h", "c", "samples", "total"))

    band = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.slice("samples", 1 + k * ROWS, ROWS).alias("s")) for k in range(BANDS))))
    met = sampled.select("id", band.alias("band")).select("id", F.xxhash64("band.k", "band.s").alias("bucket"))
    full = met.groupBy("bucket").agg(F.min("id").alias("leader"), F.count("*").alias("n")).where("n > 1")
    full = scratch.table(full)
    met = scratch.table(met.join(full, "bucket"))
    scratch.drop(full)
    side = sampled.select("id", "total")
    pairs = met.where("id <> leader").select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    # similarity is at most the ratio of the total weights
    possible = F.least("x", "y") >= threshold * F.greatest("x", "y") * (1 - 1e-6)
    pairs = pairs.join(side.toDF("b", "y"), "b").join(side.toDF("a", "x"), "a").where(possible)
    pairs = scratch.table(pairs.select("a", "b"))
    # one text for each id that shares a bucket, found by the least id as well, which deals out equal texts
    wanted = met.select("id").distinct().join(ids, "id").select("id", "h", "c", F.col("least.doc").alias("doc"))
    texts = keyed.select("h", "c", order.alias("doc"), "text").join(wanted, ["h", "c", "doc"])
    texts = texts.groupBy("h", "c", "doc", "id").agg(F.first("text").alias("text"))
    texts = scratch.table(texts.select("id", "text", F.octet_length("text").alias("size")))
    links = scratch.table(_verified(pairs, texts, shared, threshold))
    labels = components(links, scratch)

    labelled = met.join(labels.toDF("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = labelled.groupBy("bucket").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q")
    mixed_up = scratch.table(labelled.join(several.select("bucket"), "bucket").select("bucket", "id", "label"))
    sizes = mixed_up.join(texts.select("id", "size"), "id").groupBy("bucket").agg(F.sum("size").alias("size"))
    blocks = scratch.table(sizes.select("bucket", F.ceil(F.col("size") / BLOCK_BYTES).cast("int").alias("blocks")).where("blocks > 0"))
    members = mixed_up.join(blocks, "bucket").join(texts.select("id", "text"), "id")
    links = scratch.table(links.unionByName(_across(members, shared, threshold)))
    labels = components(links, scratch)
    scratch.drop(met, texts, pairs, sampled, links, mixed_up, blocks)

    placed = ids.join(labels.toDF("id", "label"), "id", "left").withColumn("label", F.coalesce("label", "id"))
    placed = scratch.table(placed)
    scratch.drop(ids, labels)
    of_class = placed.groupBy("label").agg(F.min("least").alias("least"), F.sum("n").alias("class_rows"))
    found = placed.select("h", "c", "label").join(scratch.table(of_class), "label")
    return scratch.table(
        found.select("h", "c", F.col("least.doc").alias("class_id"), "class_rows", F.col("least.n").alias("least_rows"))
    )


def near_duplicates(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", keep: list[str] | None = None, scratch: Scratch | None = None
) -> DataFrame:
    """df with class_id (the smallest id of the row's class), class_rows and kept (whether the row has that id).

    A null text has its own id as class.
    """
    found = classes(df, scratch or Scratch(df.sparkSession), text_col, id_col)
    added = ("class_id", "class_rows", "kept")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    text, doc = F.col(quoted(text_col)), F.col(quoted(id_col))
    rows = df.select(*(F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(kept)), doc.alias("doc"), *text_key(text), text.isNull().alias("none"))
    rows = rows.withColumn("h", F.when(F.col("none"), None).otherwise(F.col("h")))
    rows = rows.join(found, ["h", "c"], "left").withColumn("own", F.coalesce("doc", F.lit((1 << 63) - 1)))
    rows = rows.withColumn("class_id", F.coalesce("class_id", "own"))
    return rows.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)),
        F.nullif(F.col("class_id"), F.lit((1 << 63) - 1)).alias("class_id"),
        F.coalesce("class_rows", F.lit(1)).alias("class_rows"),
        (F.col("class_id") == F.col("own")).alias("kept"),
    )


def keep_one_of_each(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", scratch: Scratch | None = None) -> DataFrame:
    """The rows of df less near-duplicates: of each class one row with its smallest id; null texts all stay."""
    names = df.columns
    df = df.toDF(*(f"k{i}" for i in range(len(names))))  # no column of df can clash with those used here
    text_col, id_col = (df.columns[names.index(c)] for c in (text_col, id_col))
    found = classes(df, scratch or Scratch(df.sparkSession), text_col, id_col)
    text = F.col(text_col)
    rows = df.where(text.isNotNull()).select("*", *text_key(text), F.coalesce(id_col, F.lit((1 << 63) - 1)).alias("own"))
    joined = rows.join(found, ["h", "c"]).where("class_id = own")
    single = joined.where("least_rows = 1").select(*df.columns).unionByName(df.where(text.isNull()))
    if found.where("least_rows > 1").limit(1).count():
        # of the rows that repeat the smallest id one stays
        first = joined.where("least_rows > 1").groupBy("class_id").agg(F.first(F.struct(*df.columns)).alias("row"))
        single = single.unionByName(first.select("row.*"))
    return single.toDF(*names)
