"""Packing of documents into windows by non-negative least squares over their lengths.

A document's ids are those of a byte-level vocabulary and one end id. Its whole windows fill sequences by themselves; what
is left of it (fewer ids than a window) is its rest. All that the driver sees is the histogram of the rests' lengths,
one count for each length below a window. Combinations of lengths that fill a window exactly are enumerated (pairs, triples,
and repeats of one length with another), non-negative least squares finds how often each is to be repeated so that the
histogram is used up, and the counts are rounded, never beyond what is there. What the histogram then still holds is
packed greedily: the longest length with the longest that fits beside it and so on, where that fills a window exactly, as often
as it can; the remaining rests lie one after the other on a line that is cut at each window. The end of the line is cut at
powers of two, so that no sequence needs padding.

No task sees all documents: a rest is known by its place among the rests of its length (a count in its task, and the sums
of the tasks before), and the plan says for places of a length which sequence they are in.

Edge cases: a null or empty text is the end id alone; a very long text is a row of windows; ties in length are dealt in the
order of tasks and rows; repeated rows are documents each; an empty table has no pieces; columns of the input named as an
added one are replaced, others stay whatever their names. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import json
from collections import Counter

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jobtide.llm.batches import Scratch, Texts, add_columns, quoted
from jobtide.llm.byte_bpe import SPACED_PATTERN

WINDOW = 1024
END = 0
#: Distinct lengths in a combination, at most.
DEPTH = 3
#: Gain of a combination, in documents, below which least squares ends.
LEAST_GAIN = 0.5

Pattern = tuple[int, tuple[tuple[int, int], ...]]


def read_ranks(path: str) -> dict[bytes, int]:
    """Byte strings and ids of a tokenizer file whose ids are in the order of its merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file shows as their own character
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(shown))}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"][a + b] for a, b in merges]
    if made != sorted(made):
        raise ValueError("the ids do not follow the order of the merges")
    whole = [t for t, i in model["vocab"].items() if len(t) == 1 and i < 256] + [a + b for a, b in merges]
    return {bytes(byte[c] for c in t): model["vocab"][t] for t in whole}


def combinations(lengths: np.ndarray, window: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, repeats), three a row: what fills a window exactly with lengths that are there; no length twice in a row."""
    there = np.zeros(window + 1, bool)
    there[lengths] = True
    rows: list[np.ndarray] = []
    for a in lengths.tolist():
        k = np.arange(1, window // a + 1)
        rest = window - k * a
        whole = rest == 0
        good = whole | (there[rest] & (rest != a) & ((k > 1) | (rest > a)))
        rows.append(np.stack([np.full(good.sum(), a), rest[good], np.zeros(good.sum(), int), k[good], (~whole)[good], np.zeros(good.sum(), int)], 1))
        if depth > 2:
            b = np.arange(a + 1, (window - a + 1) // 2 + 1)
            c = window - a - b
            good = there[b] & there[c] & (c > b)
            b, c = b[good], c[good]
            rows.append(np.stack([np.full(len(b), a), b, c, *[np.ones(len(b), int)] * 3], 1))
    found = np.concatenate(rows) if rows else np.zeros((0, 6), int)
    return found[:, :3], found[:, 3:]


def least_squares(parts: np.ndarray, times: np.ndarray, wanted: np.ndarray, tolerance: float = LEAST_GAIN) -> np.ndarray:
    """Non-negative repeats x for which the lengths used, A x, are nearest to `wanted`, by an active set.

    Columns of A are combinations. The inverse of the Gram matrix of the chosen columns is kept and bordered or cut as columns come
    and go; the basis never has more columns than there are lengths.
    """
    x = np.zeros(len(parts))
    if not len(parts):
        return x
    norms = np.sqrt((times**2).sum(1))
    barred = np.zeros(len(parts), bool)
    chosen: list[int] = []
    columns, inverse = np.zeros((0, len(wanted))), np.zeros((0, 0))
    tolerance = max(tolerance, 1e-9 * wanted.max())

    def solved() -> np.ndarray:
        return inverse @ (columns @ wanted)

    for _ in range(3 * len(wanted)):
        left = wanted - columns.T @ x[chosen]
        gain = (times * left[parts]).sum(1) / norms
        gain[barred] = gain[chosen] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        column = np.zeros(len(wanted))
        np.add.at(column, parts[j], times[j])
        across = columns @ column
        way = inverse @ across
        own = column @ column - across @ way
        if own < 1e-9:  # no new direction
            barred[j] = True
            continue
        inverse = np.block([[inverse + np.outer(way, way) / own, -way[:, None] / own], [-way[None, :] / own, np.array([[1 / own]])]])
        columns = np.vstack([columns, column])
        chosen.append(j)
        while len(chosen):
            goal, now = solved(), x[chosen]
            if (goal > 0).all():
                x[chosen] = goal
                break
            down = goal <= 0
            step = float((now[down] / np.maximum(now[down] - goal[down], 1e-300)).min())
            now = now + step * (goal - now)
            gone = down & (now <= 1e-9)
            x[chosen] = np.where(gone, 0, now)
            for q in np.flatnonzero(gone)[::-1].tolist():
                inverse = inverse - np.outer(inverse[:, q], inverse[q]) / inverse[q, q]
                inverse = np.delete(np.delete(inverse, q, 0), q, 1)
                barred[chosen[q]] |= chosen[q] == j  # it left at once
                del chosen[q]
            columns = columns[~gone]
    return x


def greedy(left: Counter, window: int) -> list[Pattern]:
    """Combinations for what is left, the longest length first and beside it the longest that fits; takes them out of `left`."""
    out: list[Pattern] = []
    lengths = sorted((n for n in left if left[n] > 0), reverse=True)
    for first in lengths:
        while left[first]:
            taken, room = Counter({first: 1}), window - first
            for other in lengths:
                while other <= room and left[other] > taken[other]:
                    k = min(room // other, left[other] - taken[other])
                    taken[other] += k
                    room -= k * other
            if room:
                break  # cut on the line instead
            n = min(left[length] // k for length, k in taken.items())
            left.subtract({length: k * n for length, k in taken.items()})
            out.append((n, tuple(taken.items())))
    return out


def plan(histogram: dict[int, int], window: int = WINDOW, depth: int = DEPTH) -> tuple[list[Pattern], Counter]:
    """(combinations with their repeats, what stays for the line) for a number of rests of each length below the window."""
    left = Counter({n: k for n, k in histogram.items() if k > 0})
    wanted = np.zeros(window + 1)
    wanted[list(left)] = list(left.values())
    parts, times = combinations(np.array(sorted(left), int), window, depth)
    x = np.rint(least_squares(parts, times, wanted))
    out: list[Pattern] = []
    for j in np.argsort(-x, kind="stable").tolist():
        if x[j] <= 0:
            break
        taken = {int(n): int(k) for n, k in zip(parts[j], times[j], strict=True) if k}
        if (n := min(int(x[j]), *(left[length] // k for length, k in taken.items()))) > 0:
            left.subtract({length: k * n for length, k in taken.items()})
            out.append((n, tuple(taken.items())))
    return out + greedy(left, window), +left


def line_end(tokens: int, window: int) -> list[int]:
    """Where the sequences of the last, unfinished window of the line begin: its powers of two, the largest first."""
    at, out = tokens - tokens % window, []
    for bit in reversed(range(window.bit_length())):
        if tokens % window >> bit & 1:
            out.append(at)
            at += 1 << bit
    return [*out, at]


def coded(df: DataFrame, path: str, window: int, text_col: str, end: int) -> DataFrame:
    """df with ids (unsigned 32-bit, little-endian, with the end id), windows, rest, and its places in its task."""
    shared = df.sparkSession.sparkContext.broadcast(read_ranks(path))  # as large as the file

    def factory(held):
        encoder = held((path, "packing"), lambda: tiktoken.Encoding("own", pat_str=SPACED_PATTERN, mergeable_ranks=shared.value, special_tokens={}))
        part = TaskContext.get().partitionId()
        seen: Counter = Counter()

        def process(texts: Texts) -> list:
            ids, windows, rests, window_at, rest_at = [], [], [], [], []
            for i in range(len(texts)):
                found = encoder.encode_ordinary(texts.text(i))
                found.append(end)
                ids.append(np.array(found, "<u4").tobytes())
                n, rest = divmod(len(found), window)
                windows.append(n)
                rests.append(rest)
                window_at.append(seen[window])
                rest_at.append(seen[rest] if rest else 0)
                seen[window] += n
                if rest:
                    seen[rest] += 1
            return [[part] * len(ids), windows, rests, window_at, rest_at, pa.array(ids, pa.binary())]

        return process

    return add_columns(df, text_col, "part int, windows long, rest int, window_at long, rest_at long, ids binary", factory, [c for c in df.columns if c != text_col])


def pack(
    df: DataFrame, path: str, window: int = WINDOW, text_col: str = "text", end: int = END, depth: int = DEPTH,
    keep: list[str] | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """Pieces of the documents of df: start and length in the document, its doc_tokens, sequence_id, offset there, and the
    piece's ids (unsigned 32-bit, little-endian). keep: the columns of df to carry (all, if None).
    """
    scratch = scratch or Scratch(df.sparkSession)
    added = ("start", "length", "doc_tokens", "sequence_id", "offset", "ids")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    hidden = df.select(*(F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(kept)), F.col(quoted(text_col)).alias("t"))
    documents = scratch.table(coded(hidden, path, window, "t", end))

    of_part = documents.groupBy("part", "rest").agg(F.count("*").alias("n"), F.sum("windows").alias("w"))
    of_part = of_part.select("part", F.explode(F.array(F.struct(F.col("rest").alias("length"), "n"), F.struct(F.lit(window).alias("length"), F.col("w").alias("n")))).alias("e"))
    of_part = scratch.table(of_part.where("e.length > 0 AND e.n > 0").groupBy("part", "e.length").agg(F.sum("e.n").alias("n")))
    histogram = {r["length"]: r["n"] for r in of_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row a length
    histogram.pop(window, None)
    patterns, line = plan(histogram, window, depth)

    # for each length the places from which on its rests are in a pattern's sequences, or on the line (repeats 0)
    places: dict[int, list[tuple[int, int, int, int]]] = {n: [] for n in histogram}
    used: Counter = Counter()
    sequences = 0
    for n, taken in patterns:
        offset = 0
        for length, k in taken:
            places[length].append((used[length], k, sequences, offset))
            used[length] += n * k
            offset += length * k
        sequences += n
    on_line = 0
    for length in sorted(line, reverse=True):
        places[length].append((used[length], 0, 0, on_line))
        on_line += line[length] * length
    whole, ends = on_line // window, line_end(on_line, window)
    line_at, window_at = sequences, sequences + whole + len(ends) - 1

    ranked = of_part.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    bases = ranked.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "before"))).alias("bases"))  # a window of lengths at most
    told = df.sparkSession.createDataFrame([(n, p) for n, p in places.items()], "rest int, places array<struct<begin:long,k:int,sequence:long,at:long>>")
    found = documents.join(bases, "part").join(F.broadcast(told), "rest", "left")  # as many rows as a window has lengths
    found = found.withColumn("rank", F.col("rest_at") + F.coalesce(F.col("bases")[F.col("rest")], F.lit(0)))
    found = found.withColumn("p", F.element_at(F.filter("places", lambda p: p["begin"] <= F.col("rank")), -1)).withColumn("k", F.col("rank") - F.col("p.begin"))

    def piece(start, length, sequence, offset):
        cut = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"), sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), cut.alias("ids"))

    none = F.expr("array()")
    done = F.col("windows") * window
    first = F.lit(window_at) + F.col("window_at") + F.coalesce(F.col("bases")[F.lit(window)], F.lit(0))
    full = F.transform(F.sequence(F.lit(0).cast("long"), F.col("windows") - 1), lambda i: piece(i * window, F.lit(window), first + i, F.lit(0)))
    one = F.array(piece(done, F.col("rest"), F.expr("p.sequence + k div p.k"), F.col("p.at") + F.expr("k % p.k") * F.col("rest")))
    lo = F.col("p.at") + F.col("k") * F.col("rest")
    hi = lo + F.col("rest")
    begins = F.array(*(F.lit(e).cast("long") for e in ends))

    def segment(x):
        return F.when(x < whole * window, F.floor(x / window)).otherwise(F.lit(whole - 1) + F.size(F.filter(begins, lambda e: e <= x)))

    def begin(s):
        return F.when(s <= whole, s * window).otherwise(F.get(begins, (s - whole).cast("int")))

    def line_piece(s):
        a, b = F.greatest(begin(s), lo), F.least(begin(s + 1), hi)
        return piece(done + a - lo, b - a, F.lit(line_at) + s, a - begin(s))

    several = F.transform(F.sequence(segment(lo), segment(hi - 1)), line_piece)
    pieces = F.concat(
        F.when(F.col("windows") > 0, full).otherwise(none), F.when(F.col("rest") == 0, none).when(F.col("p.k") > 0, one).otherwise(several),
    )
    tokens = (done + F.col("rest")).alias("doc_tokens")
    out = found.select(*(f"k{i}" for i in range(len(kept))), tokens, F.explode(pieces).alias("e"))
    return out.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), "e.start", "e.length", "doc_tokens", "e.sequence_id", "e.offset", "e.ids"
    )


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
