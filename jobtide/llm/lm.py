"""Language-model scores: a gated recurrent network with a class-factored output, trained in numpy.

Tokens are runs of other than white space, A-Z lower-cased, and one end per text. The SHORT commonest tokens have
inputs and outputs of their own, in classes of about equal mass of square-rooted counts; every other token belongs to
one of TAILS classes by its last three bytes. The network predicts the class, then the token within the class: by a
second softmax for the common tokens, by its smoothed count for the others, (c + 1) / (class total + class types + 1),
so that an unknown token of a class has the share of one more type.

Counts cover all training texts. Texts are then read once more and written as codes, which training and scoring share.
The weights are trained on all training texts: a sample by hash of about WARM_TOKENS tokens gives a common start, then
groups of about GROUP_TOKENS tokens, dealt by hash, each train on from there in the order of their hashes, by truncated
backpropagation over WINDOW steps (up to WIDEST where few texts are left) with the state carried on. The groups' weights are averaged by tokens in the order of
the groups. Groups and orders depend on the texts (and ids, if given) alone, so another layout of files or number of
tasks gives the same model. Scoring carries the state through each whole text.

The KNOWN commonest counts are broadcast (those above a threshold that a histogram of counts gives, and a share by hash
of those at it); other tokens of a text are joined with the table of counts, which stays distributed. The driver holds weights and KNOWN counts only.

Edge cases: null and empty texts have the end token only; without training texts N and V are 0 and the model is what
its starting weights give; an empty table gives no rows; repeated rows are scored each, and trained on each; a very
long text fills a lane of its own in windows and takes memory in proportion to its tokens; tokens of equal count are
ranked by their bytes; columns of the input named as an added one are replaced.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.llm.batches import Scratch, Texts, partitions, quoted, trim

END = b""  # no token is empty
SHORT, CLASSES, TAILS, HIDDEN = 4096, 48, 48, 16
#: Steps of a window, and at most so many where few lanes are left; lanes of texts that advance together.
WINDOW, WIDEST, LANES = 32, 256, 512
#: The same in scoring, which does not depend on them.
SCORE_WINDOW, SCORE_WIDEST, SCORE_LANES = 64, 2048, 1024
KNOWN = 1 << 18
WARM_TOKENS, WARM_PASSES = 2_000_000, 2
GROUP_TOKENS = 4_000_000
RATE, CLIP = 0.004, 1.0
#: Distinct tokens that a task counts before it passes their counts on.
HELD = 200_000
#: Parts of an octave that the histogram of counts tells apart.
_OCTAVE = 8
_PIECE = 4096
_ROWS = 1024
_LOG10 = float(np.log(10))


def tokens(text: bytes) -> list[bytes]:
    return text.lower().split() + [END]


def tail_class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % TAILS


class Vocabulary:
    """Common tokens with counts, in order of count: the first `short` are the shortlist, END among them."""

    def __init__(self, common: list[tuple[bytes, int]], short: int = SHORT):
        counts = dict(common)
        first = sorted((t for t in counts if t != END), key=lambda t: (-counts[t], t))
        end_at = next((k for k, t in enumerate(first) if counts[t] < counts.get(END, 0)), len(first))
        first.insert(min(end_at, short - 1), END)
        self.short = first[:short]
        self.counts = [counts.get(t, 0) for t in self.short]
        mass = np.sqrt(np.array(self.counts, float) + 1)
        own = np.minimum((np.cumsum(mass) - mass) / mass.sum() * CLASSES, CLASSES - 1).astype(int)
        self.starts = np.searchsorted(own, np.arange(CLASSES + 1))
        self.classes = CLASSES + TAILS
        # codes: shortlist words first, then one for each tail class; the input that begins a text comes last
        self.code = {t: k for k, t in enumerate(self.short)}
        self.class_of = np.concatenate([own, CLASSES + np.arange(TAILS)])
        self.begin = len(self.short) + TAILS
        self.rest = {t: c for t, c in common if t not in self.code}

    def encode(self, found: list[bytes]) -> list[int]:
        code, n = self.code.get, len(self.short)
        return [k if (k := code(t)) is not None else n + tail_class(t) for t in found]


class Network:
    #: The update, reset and candidate gates have tables and matrices of their own, so that all steps run through flat memory.
    SHAPES = ("in_z", "in_r", "in_c", "state_z", "state_r", "state_c", "to_class", "class_bias", "to_word", "word_bias")

    def __init__(self, vocabulary: Vocabulary, tail_mass: np.ndarray | None = None, seed: int = 7):
        draw = np.random.default_rng(seed)
        v, h = vocabulary, HIDDEN
        self.v = v
        small = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
        words = np.log(np.array(v.counts, float) + 1).astype(np.float32)
        mass = [np.sum(np.array(v.counts[a:b], float) + 1) if b > a else 1e-9 for a, b in zip(v.starts, v.starts[1:], strict=False)]
        tails = np.ones(TAILS) if tail_mass is None else np.asarray(tail_mass, float) + 1
        self.w = {
            **{f"in_{g}": small(v.begin + 1, h) for g in "zrc"}, **{f"state_{g}": small(h, h) for g in "zrc"}, "to_class": small(h, v.classes),
            "class_bias": np.log(np.concatenate([mass, tails])).astype(np.float32), "to_word": small(len(v.short), h),
            "word_bias": words,
        }
        self.w["class_bias"] -= self.w["class_bias"].max()
        for a, b in zip(v.starts, v.starts[1:], strict=False):
            if b > a:
                words[a:b] -= words[a:b].max()

    def flat(self, of: dict | None = None) -> np.ndarray:
        return np.concatenate([(of or self.w)[k].ravel() for k in self.SHAPES])

    def parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """What flat() has joined."""
        out, at = {}, 0
        for k in self.SHAPES:
            size = self.w[k].size
            out[k] = flat[at : at + size].reshape(self.w[k].shape).astype(np.float32)
            at += size
        return out

    def load(self, flat: np.ndarray) -> None:
        self.w = self.parts(flat)

    def forward(self, inputs: np.ndarray, begins: np.ndarray, h: np.ndarray, keep: bool = True):
        """States after each of the steps [steps, lanes], the last one, and what backward() needs (if kept)."""
        w = self.w
        in_z, in_r, in_c = (np.take(w[k], inputs, 0) for k in ("in_z", "in_r", "in_c"))
        goes_on, fresh = 1 - begins, begins.any(1)
        kept = []
        out = np.empty((*inputs.shape, HIDDEN), h.dtype)
        for t in range(len(inputs)):
            if fresh[t]:
                h = h * goes_on[t][:, None]
            z, r, c = in_z[t], in_r[t], in_c[t]
            z += h @ w["state_z"]
            z *= 0.5
            np.tanh(z, out=z)
            z += 1
            z *= 0.5
            r += h @ w["state_r"]
            r *= 0.5
            np.tanh(r, out=r)
            r += 1
            r *= 0.5
            un = h @ w["state_c"]
            c += r * un
            np.tanh(c, out=c)
            if keep:
                kept.append((h, z, r, un, c))
            h = h - c
            h *= z
            h += c
            out[t] = h
        return out, h, kept

    def outputs(self, states: np.ndarray, targets: np.ndarray, gradient: bool):
        """log probability (natural) of each target; gradients by the states and by the output weights."""
        w, v, n = self.w, self.v, HIDDEN
        classes = np.take(v.class_of, targets)
        # the biases are the weights of a last state of 1
        s = np.ones((len(states), n + 1), states.dtype)
        s[:, :n] = states
        to_class = np.concatenate([w["to_class"], w["class_bias"][None]])
        to_word = np.concatenate([w["to_word"], w["word_bias"][:, None]], 1)
        safe = _moderate(to_class.T)
        scores, back = np.empty(len(s), s.dtype), np.empty_like(s) if gradient else None
        by_class, by_word, across = np.zeros_like(to_class), np.zeros_like(to_word), to_class.T.copy()
        for lo in range(0, len(s), _ROWS):  # blocks that fit a processor's cache
            block = s[lo : lo + _ROWS]
            scores[lo : lo + _ROWS], e = _softmax(block @ to_class, classes[lo : lo + _ROWS], safe, gradient)
            if gradient:
                by_class += block.T @ e
                np.matmul(e, across, out=back[lo : lo + _ROWS])
        order = np.argsort(classes.astype(np.int16), kind="stable")
        edges = np.searchsorted(np.take(classes, order), np.arange(CLASSES + 1))
        # within classes, in the order of classes; put back into the order of the tokens at once
        sorted_states, sorted_targets = np.take(s, order, 0), np.take(targets, order)
        inner, inner_back = np.zeros(len(s), s.dtype), np.zeros_like(s) if gradient else None
        for k in np.flatnonzero((edges[1:] > edges[:-1]) & (np.diff(v.starts) > 1)).tolist():
            a, b = v.starts[k], v.starts[k + 1]
            words = to_word[a:b]
            safe = _moderate(words)
            for lo in range(edges[k], edges[k + 1], _ROWS):
                part = slice(lo, min(lo + _ROWS, edges[k + 1]))
                block = sorted_states[part]
                inner[part], e = _softmax(block @ words.T, sorted_targets[part] - a, safe, gradient)
                if gradient:
                    by_word[a:b] += e.T @ block
                    np.matmul(e, words, out=inner_back[part])
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        scores += np.take(inner, place)
        if not gradient:
            return scores
        back += np.take(inner_back, place, 0)
        grads = {"to_class": by_class[:n], "class_bias": by_class[n], "to_word": by_word[:, :n], "word_bias": by_word[:, n]}
        return scores, back[:, :n], {k: np.ascontiguousarray(g) for k, g in grads.items()}

    def backward(self, inputs: np.ndarray, begins: np.ndarray, kept: list, back: np.ndarray) -> dict:
        w = self.w
        by_in = {g: np.empty((*inputs.shape, HIDDEN), back.dtype) for g in "zrc"}
        by_state = {g: np.zeros((HIDDEN, HIDDEN), back.dtype) for g in "zrc"}
        across = {g: w[f"state_{g}"].T.copy() for g in "zrc"}
        goes_on, fresh = 1 - begins, begins.any(1)
        dh = np.zeros((inputs.shape[1], HIDDEN), back.dtype)
        for t in range(len(inputs) - 1, -1, -1):
            h, z, r, un, c = kept[t]
            dh += back[t]
            at_z, at_r, at_c = (by_in[g][t] for g in "zrc")
            dz = dh * z
            np.subtract(dh, dz, out=at_c)  # dh (1 - z)
            np.multiply(at_c, h - c, out=at_z)
            at_z *= z
            c *= c
            np.subtract(1, c, out=c)
            at_c *= c
            np.multiply(at_c, un, out=at_r)
            du = at_c * r
            at_r *= r
            np.subtract(1, r, out=r)
            at_r *= r
            back_to = h.T
            by_state["z"] += back_to @ at_z
            by_state["r"] += back_to @ at_r
            by_state["c"] += back_to @ du
            dz += at_z @ across["z"]
            dz += at_r @ across["r"]
            dz += du @ across["c"]
            dh = dz
            if fresh[t]:
                dh *= goes_on[t][:, None]
        flat = inputs.ravel()
        order = np.argsort(flat.astype(np.int16), kind="stable")
        codes, first = np.unique(np.take(flat, order), return_index=True)
        sums = np.add.reduceat(np.concatenate([np.take(x.reshape(-1, HIDDEN), order, 0) for x in by_in.values()], 1), first)
        grads = {f"state_{g}": x for g, x in by_state.items()}
        for k, g in enumerate(by_in):
            grads[f"in_{g}"] = np.zeros_like(w[f"in_{g}"])
            grads[f"in_{g}"][codes] = sums[:, k * HIDDEN : (k + 1) * HIDDEN]
        return grads


def _moderate(weights: np.ndarray) -> bool:
    """Whether the logits of these outputs stay where exp neither overflows nor loses every term, for states within (-1, 1)."""
    return bool(np.abs(weights[:, :-1]).sum(1).max() + abs(weights[:, -1].max()) < 60)


def _softmax(logits: np.ndarray, places: np.ndarray, safe: bool, gradient: bool):
    """log probabilities of one place of each row, and by the logits their gradients (of the negative), in place."""
    if not safe:
        logits -= logits.max(1, keepdims=True)
    at = np.arange(0, logits.size, logits.shape[1]) + places
    chosen = np.take(logits, at)
    e = np.exp(logits, out=logits)
    total = e @ np.ones(e.shape[1], e.dtype)
    if gradient:
        e *= (1 / total)[:, None]
        e.reshape(-1)[at] -= 1
    return chosen - np.log(total), e


class Lanes:
    """Texts one after the other in lanes of about equal length; codes stay one flat array, in the order of lanes.

    codes: of all texts one after the other; bounds: where each begins, and the end.
    """

    def __init__(self, codes: np.ndarray, bounds: np.ndarray, begin: int, most: int):
        lengths = np.diff(bounds)
        n = int(max(1, min(most, len(lengths), lengths.sum() // (2 * WINDOW) + 1)))
        heap, lane = [(0, k) for k in range(n)], np.zeros(len(lengths), np.int64)
        order = np.argsort(-lengths, kind="stable")
        for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
            filled, k = heap[0]
            lane[i] = k
            heapq.heapreplace(heap, (filled + length, k))
        filled = np.bincount(lane, lengths, n).astype(np.int64)
        rank = np.empty(n, np.int64)
        rank[np.argsort(-filled, kind="stable")] = np.arange(n)
        self.filled = np.sort(filled)[::-1]
        self.starts = np.cumsum(self.filled) - self.filled
        self.texts = order[np.argsort(rank[lane[order]], kind="stable")]  # in the order of lanes, and within each
        own = lengths[self.texts]
        self.firsts = np.cumsum(own) - own
        self.targets = codes[np.arange(int(own.sum())) + np.repeat(bounds[:-1][self.texts] - self.firsts, own)]
        self.inputs = np.empty_like(self.targets)
        self.inputs[1:] = self.targets[:-1]
        self.begins = np.zeros(len(self.targets), np.float32)
        self.inputs[self.firsts], self.begins[self.firsts] = begin, 1

    def windows(self, least: int, most: int, tokens: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, real): places of the tokens [steps, lanes] of the lanes that go on, and which are there.

        A window has `least` steps, or up to `most` if the lanes that are left then have `tokens` at most.
        """
        at, end = 0, int(self.filled.max(initial=0))
        while at < end:
            left = self.filled[self.filled > at] - at
            reach = np.arange(min(int(left.max()), max(least, min(most, tokens // len(left)))))[:, None]
            real = reach < left
            yield np.where(real, self.starts[: len(left)] + at + reach, 0), real
            at += len(reach)


class Trainer:
    """Adam over windows; each window is one step."""

    def __init__(self, network: Network, rate: float = RATE):
        self.net, self.rate, self.steps = network, rate, 0
        self.first = {k: np.zeros_like(w) for k, w in network.w.items()}
        self.second = {k: np.zeros_like(w) for k, w in network.w.items()}

    def train(self, codes: np.ndarray, bounds: np.ndarray) -> float:
        """One pass over texts; the sum of their tokens' log probabilities."""
        net, total = self.net, 0.0
        lanes = Lanes(codes, bounds, net.v.begin, LANES)
        h = np.zeros((len(lanes.filled), HIDDEN), np.float32)
        for places, real in lanes.windows(WINDOW, WIDEST, WINDOW * LANES // 2):
            inputs, begins = np.take(lanes.inputs, places), np.take(lanes.begins, places)
            states, h, kept = net.forward(inputs, begins, h[: places.shape[1]])
            there = np.flatnonzero(real)
            flat = states.reshape(-1, HIDDEN)
            flat = flat if len(there) == len(flat) else np.take(flat, there, 0)
            scores, back, grads = net.outputs(flat, np.take(lanes.targets, places.ravel()[there]), True)
            spread = np.zeros((states.size // HIDDEN, HIDDEN), np.float32)
            spread[there] = back
            grads |= net.backward(inputs, begins, kept, spread.reshape(states.shape))
            self.step(grads, len(scores))
            total += float(scores.sum(dtype=np.float64))
        return total

    def step(self, grads: dict, n: int) -> None:
        self.steps += 1
        n = max(n, WINDOW * LANES)  # windows of few lanes, the ends of long texts, weigh as many tokens as they have
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values())) / n
        scale = np.float32((1 if norm <= CLIP else CLIP / norm) / n)
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps))
        for k, g in grads.items():
            g *= scale
            m, s = self.first[k], self.second[k]
            m *= np.float32(0.9)
            m += np.float32(0.1) * g
            s *= np.float32(0.999)
            g *= g
            g *= np.float32(0.001)
            s += g
            np.sqrt(s, out=g)
            g += np.float32(1e-8)
            np.divide(m, g, out=g)
            g *= rate
            self.net.w[k] -= g


def scores_of(network: Network, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log probability of each text, the state carried from its first token to its end."""
    lanes = Lanes(codes, bounds, network.v.begin, SCORE_LANES)
    h = np.zeros((len(lanes.filled), HIDDEN), np.float32)
    by_token = np.zeros(len(codes))
    for places, real in lanes.windows(SCORE_WINDOW, SCORE_WIDEST, SCORE_WINDOW * SCORE_LANES):
        states, h, _ = network.forward(np.take(lanes.inputs, places), np.take(lanes.begins, places), h[: places.shape[1]], False)
        there = np.flatnonzero(real)
        own = places.ravel()[there]
        by_token[own] = network.outputs(np.take(states.reshape(-1, HIDDEN), there, 0), np.take(lanes.targets, own), False)
    out = np.zeros(len(bounds) - 1)
    out[lanes.texts] = np.bincount(np.repeat(np.arange(len(lanes.texts)), np.diff(bounds)[lanes.texts]), by_token, len(lanes.texts))
    return out


def flattened(coded: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = [len(c) for c in coded]
    return np.fromiter(chain.from_iterable(coded), np.int32, sum(lengths)), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])


def log_likelihoods(network: Network, coded: list[list[int]]) -> np.ndarray:
    """scores_of() for texts given as lists of codes."""
    return scores_of(network, *flattened(coded))


def _count(batches):
    held: Counter = Counter()

    def passed():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["token", "c"])

    for batch in batches:
        for _, _, part in Texts.of(batch.column(0)).chunks():
            for i in range(len(part)):
                held.update(part.bytes(i).lower().split())
            held[END] += len(part)
            if len(held) > HELD:
                yield passed()
                held.clear()
    yield passed()
    held.clear()
    trim()


class Coding:
    """What encoding needs: the KNOWN tokens with their logs of counts, codes, and tail classes' totals."""

    def __init__(self, vocabulary: Vocabulary, n: int, v: int, tails: np.ndarray):
        self.v, self.n, self.types, self.tails = vocabulary, n, v, tails
        self.tokens = [*vocabulary.short, *vocabulary.rest]
        counts = np.array([*vocabulary.counts, *vocabulary.rest.values()], np.float64)
        self.logs, self.seen = np.log10(counts + 1), counts > 0
        self.codes = np.array(vocabulary.encode(self.tokens), np.int16)
        self.base_log = float(np.log10(n + v + 1))


class Numbered(dict):
    """Numbers of known tokens; others are numbered on as they come, until forget()."""

    def __init__(self, known: list[bytes]):
        super().__init__((t, k) for k, t in enumerate(known))
        self.fresh: list[bytes] = []

    def __missing__(self, token: bytes) -> int:
        self[token] = k = len(self)
        self.fresh.append(token)
        return k

    def forget(self) -> None:
        for token in self.fresh:
            del self[token]
        self.fresh = []


_ENCODED = "n long, known long, base double, tail double, codes binary, rare array<struct<token:binary,n:long>>"


def _encoder(shared):
    def run(batches):
        coding = shared.value
        numbered, short = Numbered(coding.tokens), len(coding.v.short)
        tail_logs = np.log10(coding.tails)
        get = numbered.__getitem__
        for batch in batches:
            for lo, hi, part in Texts.of(batch.column(0)).chunks(4 << 20):
                words = [part.bytes(i).lower().split() for i in range(len(part))]
                for x in words:
                    x.append(END)
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                found = np.fromiter(map(get, chain.from_iterable(words)), np.int32, int(lengths.sum()))
                bounds = np.concatenate([[0], np.cumsum(lengths)])
                fresh, known = numbered.fresh, len(coding.tokens)
                codes = np.concatenate([coding.codes, np.array(coding.v.encode(fresh), np.int16)])[found]
                logs = np.concatenate([coding.logs, np.zeros(len(fresh))])[found]
                starts = bounds[:-1]
                base = np.add.reduceat(logs, starts) - lengths * coding.base_log  # no text is without tokens
                shares = np.where(codes >= short, logs - tail_logs[np.maximum(codes.astype(np.int64) - short, 0)], 0)
                seen = np.concatenate([coding.seen, np.zeros(len(fresh), bool)])[found]
                rare = np.flatnonzero(found >= known)
                own = np.searchsorted(bounds, rare, "right") - 1
                keys, times = np.unique(own * max(1, len(fresh)) + (found[rare] - known), return_counts=True)
                of_text, of_token = np.divmod(keys, max(1, len(fresh)))
                told = pa.StructArray.from_arrays(
                    [pa.array(fresh, pa.binary()).take(pa.array(of_token)), pa.array(times, pa.int64())], ["token", "n"]
                )
                edges = pa.array(np.searchsorted(of_text, np.arange(len(words) + 1)), pa.int32())
                numbered.forget()
                coded = pa.Array.from_buffers(
                    pa.binary(), len(words), [None, pa.py_buffer((2 * bounds).astype(np.int32)), pa.py_buffer(codes.astype(np.int16))]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(lo, hi - lo).columns[1:], pa.array(lengths), pa.array(np.add.reduceat(seen.astype(np.int64), starts)),
                        pa.array(base), pa.array(np.add.reduceat(shares, starts)), coded, pa.ListArray.from_arrays(edges, told),
                    ],
                    ["train", "h", "row", "n", "known", "base", "tail", "codes", "rare"],
                )
        trim()

    return run


def _coded(column: pa.Array, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, codes, bounds) of the texts of a column `codes`, at most `most` tokens or one text at once."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    if not len(column):
        return
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] // 2
    codes = np.frombuffer(data, np.int16)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + most, "right")) - 1)
        yield at, end, codes[bounds[at] : bounds[end]].astype(np.int32), bounds[at : end + 1] - bounds[at]
        at = end


class Model:
    """What scoring needs: the network, what encoding needs, and the table of all counts (token, c)."""

    def __init__(self, network: Network, coding: Coding):
        self.network, self.coding, self.n, self.v, self.tails = network, coding, coding.n, coding.types, coding.tails


def count_texts(df: DataFrame, scratch: Scratch, text_col: str = "text") -> DataFrame:
    """The table of counts (token, c) of df's texts."""
    texts = df.select(F.coalesce(F.col(quoted(text_col)), F.lit("")))
    return scratch.table(texts.mapInArrow(_count, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c")))


def coding_of(counts: DataFrame) -> tuple[Coding, np.ndarray]:
    """The vocabulary of a table of counts, and the mass of each tail class."""
    spark = counts.sparkSession
    octave = F.floor(F.log2("c") * _OCTAVE + 1e-9).cast("int")
    steps = counts.groupBy(octave.alias("k")).agg(F.min("c").alias("c"), F.count("*").alias("n")).orderBy(F.desc("k")).collect()
    chosen, total = F.lit(False), 0
    for r in steps:  # some hundred rows
        chosen = F.col("c") >= r["c"]
        if (total := total + r["n"]) > KNOWN:  # of the last step that has room, a share by hash
            share = int(0.9 * (KNOWN - total + r["n"]) / r["n"] * (1 << 30))
            chosen = (octave > r["k"]) | (octave == r["k"]) & (F.pmod(F.xxhash64("token"), F.lit(1 << 30)) < share)
            break
    common = counts.where(chosen).toArrow()  # KNOWN rows at most, or but for chance
    vocabulary = Vocabulary(list(zip(common["token"].to_pylist(), common["c"].to_pylist(), strict=True)))
    short = spark.createDataFrame([(bytearray(t),) for t in vocabulary.short], "token binary")
    tail = F.pmod(F.crc32(F.expr("substring(token, greatest(octet_length(token) - 2, 1), 3)")), F.lit(TAILS)).cast("int")
    sums = counts.join(F.broadcast(short.withColumn("s", F.lit(True))), "token", "left")  # SHORT rows
    sums = sums.groupBy(F.when(F.col("s").isNull(), tail).alias("t")).agg(F.sum("c").alias("n"), F.count("*").alias("v"))
    mass, tails, n, v = np.zeros(TAILS), np.ones(TAILS), 0, 0
    for r in sums.collect():
        n, v = n + r["n"], v + r["v"]
        if r["t"] is not None:
            mass[r["t"]], tails[r["t"]] = r["n"], r["n"] + r["v"] + 1
    return Coding(vocabulary, int(n), int(v), tails), mass


def encode(
    df: DataFrame, coding: Coding, scratch: Scratch, train, text_col: str = "text", id_col: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """df as codes: id, train (the boolean column given), h (a hash of text and id), row (the columns of keep), n, ..."""
    shared = df.sparkSession.sparkContext.broadcast(coding)
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    hashed = F.xxhash64(text, *([F.col(quoted(id_col))] if id_col else []))
    rows = df.select(
        text.alias("text"), train.alias("train"), hashed.alias("h"),
        F.struct(F.lit(0).alias("none"), *(F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(df.columns if keep is None else keep))).alias("row"),
    )
    kind = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(_encoder(shared), f"train boolean, h long, row {kind}, {_ENCODED}")
    return scratch.table(made.withColumn("id", F.monotonically_increasing_id()))


_WEIGHTS = "g long, piece int, w binary, n long"


def _trained(spark: SparkSession, coded: DataFrame, start: tuple, passes: int, moments: bool) -> DataFrame:
    """coded (g, h, codes), sorted by g and h: for each g the weights after its texts, in pieces, with its tokens.

    moments: the trainer's moments as well.
    """
    shared = spark.sparkContext.broadcast(start)

    def finished(g: int, trainer: Trainer, n: int):
        told = (trainer.net.w, trainer.first, trainer.second) if moments else (trainer.net.w,)
        flat = np.concatenate([trainer.net.flat(x) for x in told])
        pieces = [flat[at : at + _PIECE].tobytes() for at in range(0, len(flat), _PIECE)]
        return pa.RecordBatch.from_arrays(
            [pa.array([g] * len(pieces), pa.int64()), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary()),
             pa.array([n] * len(pieces), pa.int64())], ["g", "piece", "w", "n"],
        )

    def begun() -> Trainer:
        network, first, second, steps = shared.value
        own = Network(network.v)
        own.w = {k: x.copy() for k, x in network.w.items()}
        trainer = Trainer(own)
        trainer.first, trainer.second = ({k: x.copy() for k, x in of.items()} for of in (first, second))
        trainer.steps = steps
        return trainer

    def run(batches):
        current, trainer, held, size, total = None, None, [], 0, 0

        def flush():
            nonlocal held, size, total
            if size:
                lengths = np.concatenate([np.diff(b) for _, b in held])
                codes, bounds = np.concatenate([c for c, _ in held]), np.concatenate([[0], np.cumsum(lengths)])
                for _ in range(passes):
                    trainer.train(codes, bounds)
                total += size
            held, size = [], 0

        for batch in batches:
            groups = batch.column(0).to_numpy()
            for lo in np.concatenate([[0], np.flatnonzero(np.diff(groups)) + 1]).tolist() if len(groups) else []:
                hi = lo + int(np.searchsorted(groups[lo:], groups[lo], "right"))
                if groups[lo] != current:
                    if trainer:
                        flush()
                        yield finished(current, trainer, total)
                    current, trainer, total = int(groups[lo]), begun(), 0
                for a, b, codes, bounds in _coded(batch.column(1).slice(lo, hi - lo), 1 << 18):
                    held.append((codes, bounds))
                    if (size := size + len(codes)) >= 2 * GROUP_TOKENS:  # a text of many copies, or a long one
                        flush()
        if trainer:
            flush()
            yield finished(current, trainer, total)
        trim()

    return coded.select("g", "codes").mapInArrow(run, _WEIGHTS)


def _averaged(weights: DataFrame, network: Network) -> tuple[dict, ...] | None:
    """The groups' weights averaged by tokens, added up in the order of the groups."""

    def add(batches):
        sums, total, at = None, 0, None
        for batch in batches:
            for g, piece, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if piece != at:
                    if at is not None:
                        yield packed(at, sums / total)
                    at, sums, total = piece, 0.0, 0
                sums, total = sums + np.frombuffer(w, np.float32).astype(np.float64) * n, total + n
        if at is not None:
            yield packed(at, sums / total)

    def packed(piece, mean):
        return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["piece", "w"])

    found = weights.repartition("piece").sortWithinPartitions("piece", "g").mapInArrow(add, "piece int, w binary").collect()  # one set of weights, or three
    if not found:
        return None
    flat = np.concatenate([np.frombuffer(r["w"], np.float32) for r in sorted(found, key=lambda r: r["piece"])])
    return tuple(network.parts(x) for x in np.split(flat, len(flat) // len(network.flat())))


def train(coded: DataFrame, coding: Coding, mass: np.ndarray) -> Network:
    """A network trained on all rows of encode() that are marked for training."""
    spark = coded.sparkSession
    network = Network(coding.v, mass)
    trainer = Trainer(network)
    start = (network, trainer.first, trainer.second, 0)
    if not coding.n:
        return network
    texts = coded.where("train").select("h", "codes")
    share = min(1.0, WARM_TOKENS / coding.n)
    chosen = F.pmod(F.xxhash64("h", F.lit("warm")), F.lit(1 << 32)) < int(share * (1 << 32))
    sample = texts.where(chosen).select(F.lit(0).cast("long").alias("g"), "h", "codes")
    sample = sample.repartition(1).sortWithinPartitions("h", "codes")  # about WARM_TOKENS tokens
    if warmed := _averaged(_trained(spark, sample, start, WARM_PASSES, True), network):
        network.w = warmed[0]
        start = (network, *warmed[1:], WARM_PASSES * max(1, int(share * coding.n) // (WINDOW * LANES)))
    groups = max(1, -(-coding.n // GROUP_TOKENS))
    dealt = texts.withColumn("g", F.pmod(F.xxhash64("h", F.lit("group")), F.lit(groups)))
    dealt = dealt.repartitionById(min(groups, 8 * partitions(spark)), (F.col("g") % min(groups, 8 * partitions(spark))).cast("int"))
    if made := _averaged(_trained(spark, dealt.sortWithinPartitions("g", "h", "codes"), start, 1, False), network):
        network.w = made[0]
    return network


def learn(df: DataFrame, scratch: Scratch, text_col: str = "text", id_col: str | None = None) -> tuple[Model, DataFrame]:
    """The model of df's texts and the table of counts (token, c)."""
    counts = count_texts(df, scratch, text_col)
    coding, mass = coding_of(counts)
    coded = encode(df, coding, scratch, F.lit(True), text_col, id_col, [])
    network = train(coded, coding, mass)
    scratch.drop(coded)
    return Model(network, coding), counts


def score_coded(coded: DataFrame, model: Model, counts: DataFrame, scratch: Scratch, kept: list[str]) -> DataFrame:
    """The rows of encode() with n_tokens, n_known, train_tokens, base_score and score (both log10)."""
    shared = coded.sparkSession.sparkContext.broadcast(model.network)

    def run(batches):
        network = shared.value
        for batch in batches:
            scores = [scores_of(network, codes, bounds) for _, _, codes, bounds in _coded(batch.column(0), 1 << 22)]
            scores = np.concatenate(scores) / _LOG10 if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores)], [*batch.schema.names[1:], "net"])
        trim()

    rows = coded.select("codes", "id", "row", "n", "known", "base", "tail")
    kind = rows.schema["row"].dataType.simpleString()
    made = rows.mapInArrow(run, f"id long, row {kind}, n long, known long, base double, tail double, net double")
    rare = coded.select("id", F.explode("rare").alias("r")).select("id", "r.token", "r.n")
    rare = rare.join(counts, "token").groupBy("id")  # what has no count adds log10(1)
    rare = rare.agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"), F.sum("n").alias("seen"))
    out = made.join(rare, "id", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        *(F.col(f"row.k{i}").alias(c) for i, c in enumerate(kept)), F.col("n").alias("n_tokens"),
        (F.col("known") + F.coalesce("seen", F.lit(0))).alias("n_known"), F.lit(model.n).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("net") + F.col("tail") + more).alias("score"),
    )


_ADDED = ("n_tokens", "n_known", "train_tokens", "base_score", "score")


def score_texts(
    df: DataFrame, model: Model, counts: DataFrame, scratch: Scratch, text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """df with n_tokens, n_known, train_tokens, base_score and score (both log10) of each whole text."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in _ADDED]
    coded = encode(df, model.coding, scratch, F.lit(False), text_col, None, kept)
    return score_coded(coded, model, counts, scratch, kept)


def learn_and_score(
    df: DataFrame, training, scratch: Scratch, text_col: str = "text", id_col: str | None = None, keep: list[str] | None = None
) -> DataFrame:
    """score_texts() of all rows of df by a model of those for which the condition `training` holds, encoded once."""
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in _ADDED]
    training = F.coalesce(training, F.lit(False))
    counts = count_texts(df.where(training), scratch, text_col)
    coding, mass = coding_of(counts)
    coded = encode(df, coding, scratch, training, text_col, id_col, kept)
    return score_coded(coded, Model(train(coded, coding, mass), coding), counts, scratch, kept)
