"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding.

A text is cut by the tokenizer's pattern and each match is merged on its own. Leaf i of the segment tree holds the
rank of the pair that starts at byte i (infinite where no live pair starts), inner nodes the minimum, so the root
gives the next merge and the descent to the left on ties finds its leftmost place. A merge changes three leaves:
the merged pair's, the swallowed neighbour's and the left neighbour's, each in logarithmic time. Many short matches
have their trees as rows of one array. A worker merges each distinct match once and remembers its ids in a table, so
that the ids of a batch are one gather.

The public pattern is cut by runs of letters, digits, white space and others in numpy; any other by its own regular
expression.

Edge cases: a null text encodes as an empty text; an empty text has no ids; a very long text is worked on alone, and a
very long match is merged alone and not remembered; repeated rows are encoded each; an empty table gives no rows;
columns of the input named as an added one are replaced, all others stay whatever their names; null ids decode to no
bytes; an id outside the vocabulary is an error, as it is in the public library.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm.batches import Texts, add_columns

_NONE = 1 << 60
#: Matches that a worker remembers; then it starts anew. Long ones are forgotten at once.
CACHED, CACHED_BYTES = 150_000, 64
#: The public pattern, which is cut without a regular expression.
SPACED_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _DIGIT, _OTHER, _SPACE = range(4)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@cache
def kinds() -> np.ndarray:
    """Of every code point whether it is a letter, a digit, white space or other, as the pattern has it."""
    out = np.full(0x110000, _OTHER, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = "".join(map(chr, points.tolist()))
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_DIGIT, r"\p{N}+"), (_SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[points[m.start() : m.end()]] = kind
    return out


def spaced_matches(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Where the matches of SPACED_PATTERN begin (bytes) in all texts, one after the other, and how many each text has.

    A match is a run of one kind, but: the last of several white space characters before something else stands apart,
    and joins what follows if it is a space; a lone apostrophe that no space precedes takes the letters of a
    contraction from what follows.
    """
    points = np.frombuffer(texts.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    plain = len(points) == len(texts.data)
    if plain:
        begins, places = texts.bounds, None
    else:
        lengths = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        places = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        begins = np.searchsorted(places, texts.bounds)
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    kind = kinds()[points]
    edge = np.zeros(n + 1, bool)
    edge[begins] = True
    flag = edge.copy()
    flag[1:n] |= kind[1:] != kind[:-1]
    starts = np.flatnonzero(flag[:n])
    ends = np.append(starts[1:], n)
    of_run = kind[starts]
    last_in_text = edge[ends]
    space = (of_run == _SPACE) & ~last_in_text
    flag[ends[space] - 1] = True
    joins = np.flatnonzero(space & (points[ends - 1] == 0x20))
    flag[starts[joins + 1]] = False
    quotes = np.flatnonzero((of_run == _OTHER) & (ends - starts == 1) & (points[starts] == 0x27) & flag[starts] & ~last_in_text)
    quotes = quotes[of_run[np.minimum(quotes + 1, len(starts) - 1)] == _LETTER]
    if len(quotes):
        after, end = starts[quotes + 1], ends[quotes + 1]
        one, two = points[after], np.where(after + 1 < end, points[np.minimum(after + 1, n - 1)], 0)
        single = np.isin(one, list(map(ord, "stmd")))
        double = np.isin(one, list(map(ord, "rv"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        taken = single + 2 * (double & ~single)
        cut = taken > 0
        flag[after[cut]] = False
        flag[(after + taken)[cut]] = True  # where the letters end, something else begins anyway
    found = np.flatnonzero(flag[:n])
    counts = np.diff(np.searchsorted(found, begins))
    return (found if plain else places[found]), counts


class Numbered(dict):
    """Numbers of matches; notes those that are new, which get the next ones."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []
        self.used = 0

    def __missing__(self, match: bytes) -> int:
        self[match] = k = self.used
        self.used += 1
        self.fresh.append(match)
        return k

    def forget(self, match: bytes) -> None:
        """The match will be new again; its number stays used."""
        del self[match]


class PairTrees:
    """The same segment tree for many short matches at once: a row of each array is a match."""

    def __init__(self, ranks: dict[bytes, int]):
        joins = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (left := ranks.get(token[:k])) is not None and (right := ranks.get(token[k:])) is not None:
                    joins[left << 32 | right] = rank
        keys = np.fromiter(joins, np.int64, len(joins))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.int64((1 << 62) + 1))
        self.values = np.append(np.fromiter(joins.values(), np.int64, len(joins))[order], _NONE)
        self.single = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def merge(self, pieces: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces (each of 2 to `size` bytes, a power of two) one after the other, and how many each has."""
        g = len(pieces)
        n = np.fromiter(map(len, pieces), np.int64, g)
        held = np.arange(size + 1) < n[:, None]
        ids = np.full((g, size + 1), -1, np.int64)
        ids[held] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, size + 2), (g, 1))
        before = np.tile(np.arange(-1, size), (g, 1))
        tree = np.full((g, 2 * size), _NONE, np.int64)
        pair = held[:, 1:]
        tree[:, size:][pair] = self.rank(ids[:, :-1][pair], ids[:, 1:][pair])
        k = size
        while k > 1:
            k //= 2
            tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            least = tree[rows, 1]
            k = np.ones(len(rows), np.int64)
            while k[0] < size:
                k *= 2
                k += tree[rows, k] != least
            i = k - size
            j = after[rows, i]
            end = after[rows, j]
            ids[rows, i], ids[rows, j], after[rows, i] = least, -1, end
            more = end < n[rows]
            before[rows[more], end[more]] = i[more]
            p = before[rows, i]
            prior = p >= 0
            fresh = np.full(len(rows), _NONE, np.int64)
            fresh[more] = self.rank(least[more], ids[rows[more], end[more]])
            tree[rows, size + i] = fresh
            dead = j < size
            tree[rows[dead], size + j[dead]] = _NONE
            tree[rows[prior], size + p[prior]] = self.rank(ids[rows[prior], p[prior]], least[prior])
            for leaf in (i, np.minimum(j, size - 1), np.maximum(p, 0)):
                k = (size + leaf) >> 1
                while k[0]:
                    tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])
                    k >>= 1
            rows = rows[tree[rows, 1] < _NONE]
        live = ids >= 0
        return ids[live], live.sum(1)


class ByteBPE:
    """Encodes by a pattern and ranks. apart: whether the pattern is cut by runs (by default, if it is the public one)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, apart: bool | None = None):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.apart = pattern == SPACED_PATTERN if apart is None else apart
        self.pieces = {i: t for t, i in ranks.items()}
        self.trees = PairTrees(ranks)
        self.decoder, self.decimals = Spelling(ranks.items()), Spelling((b"%d," % i, i) for i in ranks.values())
        self.known = Numbered()
        self.clear()

    def clear(self) -> None:
        """Forget all matches; the table holds the ids of match k at first[k] to first[k + 1]."""
        self.known = Numbered()
        self.first, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def merge(self, piece: bytes) -> list[int]:
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        size = 1 << max(0, n - 2).bit_length()
        rank = ranks.get
        tree = [_NONE] * size + [rank(piece[i : i + 2], _NONE) for i in range(n - 1)]
        tree += [_NONE] * (2 * size - len(tree))
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a <= b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (least := tree[1]) < _NONE:
            k = 1
            while k < size:
                k *= 2
                if tree[k] != least:
                    k += 1
            i = k - size
            j = after[i]
            end = after[j]
            after[i] = end
            changed = [(i, _NONE), (j, _NONE)]
            if end < n:
                before[end] = i
                changed[0] = (i, rank(piece[i : after[end]], _NONE))
            if (p := before[i]) >= 0:
                changed.append((p, rank(piece[p:end], _NONE)))
            for at, value in changed:
                k = at + size
                if k == size * 2:
                    continue
                tree[k] = value
                while k > 1:
                    other = tree[k ^ 1]
                    if other < value:
                        value = other
                    k >>= 1
                    if tree[k] == value:
                        break
                    tree[k] = value
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : after[i]]])
            i = after[i]
        return out

    def learn(self, matches: list[bytes]) -> None:
        """Add matches to the table, in their order."""
        ranks = self.ranks
        whole = np.fromiter((ranks.get(m, -1) for m in matches), np.int64, len(matches))
        sizes = np.fromiter(map(len, matches), np.int64, len(matches))
        counts, made = np.ones(len(matches), np.int64), [(np.flatnonzero(whole >= 0), whole[whole >= 0])]
        for low, size in ((0, 8), (8, 16), (16, 32)):
            chosen = np.flatnonzero((whole < 0) & (sizes > low) & (sizes <= size))
            if len(chosen):
                ids, counts[chosen] = self.trees.merge([matches[k] for k in chosen.tolist()], size)
                made.append((chosen, ids))
        for k in np.flatnonzero((whole < 0) & (sizes > 32)).tolist():
            ids = np.array(self.merge(matches[k]))
            counts[k] = len(ids)
            made.append((np.array([k]), ids))
        ends = np.cumsum(counts)
        table = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for chosen, ids in made:
            n = counts[chosen]
            table[np.repeat(ends[chosen] - n - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        self.ids = np.concatenate([self.ids, table])
        self.first = np.concatenate([self.first, self.first[-1] + ends])

    def matches(self, texts: Texts) -> tuple[list[bytes], np.ndarray]:
        """The matches of all texts, one after the other, and how many each text has."""
        if self.apart:
            starts, counts = spaced_matches(texts)
            data, starts = texts.data.tobytes(), starts.tolist()
            return [data[a:b] for a, b in zip(starts, [*starts[1:], len(data)], strict=True)] if starts else [], counts
        found = [self.find(texts.text(i)) for i in range(len(texts))]
        return [m.encode() for m in chain.from_iterable(found)], np.fromiter(map(len, found), np.int64, len(found))

    def encoded(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (and the end)."""
        found, counts = self.matches(texts)
        if self.known.used > CACHED:
            self.clear()
        known = self.known
        places = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        fresh, known.fresh = known.fresh, []
        if fresh:
            self.learn(fresh)
        first = self.first[places]
        lengths = self.first[places + 1] - first
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(first - ends + lengths, lengths) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        for m in fresh:
            if len(m) > CACHED_BYTES:
                known.forget(m)
        return ids, bounds

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, bounds = self.encoded(Texts.of(pa.array(texts, pa.large_string())))
        return np.split(ids, bounds[1:-1]) if texts else []

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


class Spelling:
    """A byte string for each id, and what an array of ids spells."""

    def __init__(self, pairs):
        found = {i: t for t, i in pairs}
        most = max(found, default=-1) + 1
        spelt = [found.get(i, b"") for i in range(most)]
        self.length = np.fromiter(map(len, spelt), np.int32, most)
        self.first = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(spelt), np.uint8)
        self.there = np.fromiter((i in found for i in range(most)), bool, most)

    def spell(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids, one after the other, and where those of each text begin (and the end)."""
        if len(ids) and not (0 <= ids.min() and ids.max() < len(self.there) and self.there[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        lengths = self.length[ids]
        ends = np.cumsum(lengths, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        index = np.int32 if total + len(self.data) < 1 << 31 else np.int64
        at = np.repeat((self.first[ids] - ends + lengths).astype(index), lengths)
        at += np.arange(total, dtype=index)
        return self.data[at], np.concatenate([[0], ends])[bounds]


def _coder(held, shared, path: str, pattern: str) -> ByteBPE:
    """One for each worker process, as building it and filling its memory take time."""
    return held((path, pattern), lambda: ByteBPE(shared.value, pattern))


def _lists(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for _, b in parts] or [np.zeros(0, np.int64)]))])
    flat = np.concatenate([i for i, _ in parts] or [np.zeros(0, np.int32)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def ranks_of(spark: SparkSession, path: str):
    """The vocabulary for the executors; its size is that of the file, some hundred thousand entries at most."""
    return spark.sparkContext.broadcast(read_ranks(path))


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with `ids`, the token ids of each whole text. keep: the columns of df to carry (all, if None)."""
    shared = ranks_of(df.sparkSession, path)

    def factory(held):
        coder = _coder(held, shared, path, pattern)
        return lambda texts: [_lists([coder.encoded(part) for _, _, part in texts.chunks()])]

    return add_columns(df, text_col, "ids array<int>", factory, keep)


def round_trip(
    df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """df with `ids` and, decoded from them in the same pass, `decoded` bytes."""
    shared = ranks_of(df.sparkSession, path)

    def factory(held):
        coder = _coder(held, shared, path, pattern)

        def process(texts: Texts) -> list:
            made, decoded = [], []
            for _, _, part in texts.chunks():
                made.append(coder.encoded(part))
                data, bounds = coder.decoder.spell(*made[-1])
                decoded += [data[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            return [_lists(made), decoded]

        return process

    return add_columns(df, text_col, "ids array<int>, decoded binary", factory, keep)


def digests(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256 (of the bytes decoded from them)."""
    shared = ranks_of(df.sparkSession, path)

    def factory(held):
        coder = _coder(held, shared, path, pattern)

        def process(texts: Texts) -> list:
            counts, of_ids, of_bytes = [], [], []
            for _, _, part in texts.chunks():
                ids, bounds = coder.encoded(part)
                counts += np.diff(bounds).tolist()
                data, ends = coder.decimals.spell(ids, bounds)
                of_ids += [_sha256(data[a : max(a, b - 1)]) for a, b in zip(ends, ends[1:], strict=False)]
                data, ends = coder.decoder.spell(ids, bounds)
                of_bytes += [_sha256(data[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            return [counts, of_ids, of_bytes]

        return process

    return add_columns(df, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", factory, keep)


def _sha256(data: np.ndarray) -> str:
    return hashlib.sha256(data).hexdigest()


def verified(df: DataFrame, path: str, pattern: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with n_tokens, `ids`, and `decodes`: whether the bytes decoded from the ids are the text's."""
    shared = ranks_of(df.sparkSession, path)

    def factory(held):
        coder = _coder(held, shared, path, pattern)

        def process(texts: Texts) -> list:
            made, same = [], []
            for _, _, part in texts.chunks():
                made.append(coder.encoded(part))
                data, ends = coder.decoder.spell(*made[-1])
                equal = np.array_equal(ends, part.bounds) and np.array_equal(data, part.data)
                same += [equal or data[ends[i] : ends[i + 1]].tobytes() == part.bytes(i) for i in range(len(part))]
            return [np.concatenate([np.diff(b) for _, b in made] or [[]]).astype(np.int64), _lists(made), same]

        return process

    return add_columns(df, text_col, "n_tokens long, ids array<int>, decodes boolean", factory, keep)


def decode(df: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """df with `decoded`, the bytes that the ids stand for."""
    shared = ranks_of(df.sparkSession, path)
    fixed = {c.lower() for c in df.columns}
    none = next(x for k in range(len(fixed) + 1) if (x := f"__none{k}") not in fixed)
    kept = [c for c in df.columns if c.lower() != "decoded"]

    def factory(_):
        pieces = {i: t for t, i in shared.value.items()}
        return lambda _, ids: [[b"".join(map(pieces.__getitem__, x or ())) for x in ids.to_pylist()]]

    return add_columns(df.withColumn(none, F.lit("")), none, "decoded binary", factory, kept, [ids_col])


def digest(coded: DataFrame) -> DataFrame:
    """The digests of round_trip()'s columns, made by SQL functions."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(joined, "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
