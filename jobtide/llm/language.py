"""Language identification: script ranges, then Viterbi over per-word scores with a switching penalty.

Learning counts byte trigrams of words (with their edges) by language over all labelled texts, in a table of FEATURES
hashed slots for each language, and the words of each script. A language is a candidate for a word if at least
SCRIPT_SHARE of the language's words have the word's script; if none is, all are. A word's score under a language is
the sum of its trigrams' smoothed log probabilities; Viterbi finds the labelling with the greatest sum of scores less
SWITCH for each change of language, so runs of words become spans. A text's language has the most bytes of words;
`score` is its share of them.

The driver holds FEATURES counts for each distinct language, so labels are meant to be languages, not free text.

Edge cases: null texts and texts without a letter are `und` with score 0; ties go to the language that sorts first;
without any labelled text all texts are `und`; a very long text is worked on alone, whole; repeated rows are counted and
judged each; an empty table gives no rows; columns of the input named as an added one are replaced, others stay whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.batches import IN_WORD, Texts, Words, add_columns, quoted

UNDETERMINED = "und"
FEATURES = 1 << 15
SMOOTHING = 0.5
SCRIPT_SHARE = 0.01
#: Natural log units that a change of language costs.
SWITCH = 12.0
#: Texts with a lower score are rejected: less than this share of the text is in the language.
LEAST_SCORE = 0.3
#: Bytes worked on at once, divided by the number of languages.
_WORK_BYTES = 8 << 20

#: First code points of the ranges of scripts (fixed values of the Unicode standard's blocks); 0: no letters.
SCRIPT_RANGES = (
    (0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xB5, 1), (0xB6, 0), (0xBA, 1),
    (0xBB, 0), (0xC0, 1), (0xD7, 0), (0xD8, 1), (0xF7, 0), (0xF8, 1), (0x300, 0), (0x370, 2), (0x400, 3), (0x530, 4),
    (0x590, 5), (0x600, 6), (0x700, 7), (0x900, 8), (0x980, 9), (0xA00, 10), (0xA80, 11), (0xB00, 12), (0xB80, 13),
    (0xC00, 14), (0xC80, 15), (0xD00, 16), (0xD80, 17), (0xE00, 18), (0xE80, 19), (0xF00, 20), (0x1000, 21),
    (0x10A0, 22), (0x1100, 23), (0x1200, 24), (0x13A0, 25), (0x1780, 26), (0x1800, 27), (0x1E00, 1), (0x1F00, 2),
    (0x2000, 0), (0x2C60, 1), (0x2C80, 2), (0x2D00, 22), (0x2D80, 24), (0x2DE0, 3), (0x2E00, 0), (0x3040, 28),
    (0x30A0, 29), (0x3100, 30), (0x3130, 23), (0x3190, 0), (0x3400, 30), (0x4DC0, 0), (0x4E00, 30), (0xA000, 31),
    (0xA640, 3), (0xA720, 1), (0xA800, 31), (0xAC00, 23), (0xD7B0, 0), (0xF900, 30), (0xFB00, 1), (0xFB13, 4),
    (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFE70, 6), (0xFF00, 0), (0xFF21, 1), (0xFF5B, 0), (0xFF66, 29),
    (0xFFA0, 23), (0xFFF0, 0), (0x10000, 31), (0x1F000, 0), (0x20000, 30), (0xE0000, 0),
)
SCRIPTS = 32
_FIRST = np.array([a for a, _ in SCRIPT_RANGES])
_SCRIPT = np.array([s for _, s in SCRIPT_RANGES], np.int8)
_LETTERS = IN_WORD.copy()
_LETTERS[48:58] = False


class Analysed:
    """Words of texts (runs of letters and non-ASCII bytes that have a script) and their trigram slots."""

    def __init__(self, texts: Texts):
        words = Words(texts, _LETTERS)
        low = words.low
        script = np.zeros(len(words), np.int8)
        if len(words):
            plain = (low >= 97) & (low <= 122)
            script = (np.add.reduceat(plain.astype(np.int32), words.starts) > 0).astype(np.int8)
            leads = np.flatnonzero(low >= 0xC2)
            if len(leads):
                own = np.searchsorted(words.starts, leads, "right") - 1
                padded = np.append(low, np.zeros(3, np.uint8)).astype(np.int32)
                a, b, c, d = (padded[leads + k] for k in range(4))
                code = np.where(
                    a < 0xE0, (a & 0x1F) << 6 | b & 0x3F,
                    np.where(a < 0xF0, (a & 15) << 12 | (b & 63) << 6 | c & 63,
                             (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63),
                )
                np.maximum.at(script, own, _SCRIPT[np.searchsorted(_FIRST, code, "right") - 1])
        real = np.flatnonzero(script > 0)
        self.plain = np.zeros(len(words), bool)
        if len(words):
            self.plain = np.add.reduceat(plain.astype(np.int32), words.starts) > 0
        self.plain = self.plain[real]
        self.script = script[real]
        self.starts, self.ends = words.starts[real], words.ends[real]
        self.first = np.searchsorted(self.starts, texts.bounds)
        self.lengths = self.ends - self.starts
        self.at = np.cumsum(self.lengths) - self.lengths
        within = np.repeat(self.starts - self.at, self.lengths) + np.arange(int(self.lengths.sum()))
        letters = low[within].astype(np.uint32)
        before = np.append(np.uint32(32), letters[:-1])
        after = np.append(letters[1:], np.uint32(32))
        if len(letters):
            before[self.at] = 32
            after[self.at[1:] - 1] = 32
        slots = (before << 16 | letters << 8 | after) * np.uint32(0x9E3779B1)
        self.slots = (slots >> np.uint32(32 - FEATURES.bit_length() + 1)).astype(np.int32)


class Model:
    def __init__(self, counts: dict[str, np.ndarray]):
        """counts: for each language FEATURES counts of trigrams, then SCRIPTS of words."""
        self.languages = sorted(counts)
        table = np.array([counts[x][:FEATURES] for x in self.languages], np.float64).reshape(-1, FEATURES)
        table = (table + SMOOTHING) / (table.sum(1, keepdims=True) + SMOOTHING * FEATURES)
        self.commonest = max(self.languages, key=lambda x: (int(counts[x][FEATURES:].sum()), x), default=UNDETERMINED)
        self.scores = np.log(table).astype(np.float32)
        scripts = np.array([counts[x][FEATURES:] for x in self.languages], np.float64).reshape(-1, SCRIPTS)
        self.candidate = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))).T.copy()
        self.candidate[~self.candidate.any(1)] = True

    def word_scores(self, found: Analysed) -> np.ndarray:
        out = np.empty((len(found.starts), len(self.languages)), np.float32)
        for k, scores in enumerate(self.scores):
            out[:, k] = np.add.reduceat(scores[found.slots], found.at) if len(found.at) else 0
        out[~self.candidate[found.script]] = -np.inf
        # a word whose script is no candidate's has finite scores, as then all languages are candidates
        return out


def viterbi(scores: np.ndarray, first: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best label of each word; words first[i] to first[i+1] are a text. Texts advance together."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    start, lengths = first[:-1][order], lengths[order]
    labels = np.zeros(len(scores), np.int32)
    if not len(scores):
        return labels
    active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), "right")
    back = np.empty(scores.shape, np.int16 if scores.shape[1] < 1 << 15 else np.int32)
    every = np.arange(scores.shape[1])
    best = scores[start[: active[0]]].astype(np.float64)
    for t in range(1, len(active)):
        n = active[t]
        v, rows = best[:n], start[:n] + t
        top = v.argmax(1)
        changed = v[np.arange(n), top][:, None] - switch
        stays = v >= changed
        back[rows] = np.where(stays, every, top[:, None])
        best[:n] = np.where(stays, v, changed) + scores[rows]
    label = best.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        rows = start[:n] + t
        labels[rows] = label[:n]
        if t:
            label[:n] = back[rows, label[:n]]
    return labels


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows of df with a text and a language; the table has FEATURES slots for each language."""

    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for lo, hi, part in Texts.of(batch.column(0)).chunks():
                found = Analysed(part)
                names = sorted(set(langs[lo:hi]))
                codes = {x: k for k, x in enumerate(names)}
                of_text = np.array([codes[x] for x in langs[lo:hi]])
                of_word = np.repeat(of_text, np.diff(found.first))
                of_slot = np.repeat(of_word, found.lengths)
                width = FEATURES + SCRIPTS
                sums = np.bincount(of_slot * width + found.slots, minlength=len(names) * width)
                sums += np.bincount(of_word * width + FEATURES + found.script, minlength=len(names) * width)
                for x, row in zip(names, sums.reshape(-1, width), strict=True):
                    totals[x] = totals.get(x, 0) + row
        for x, row in totals.items():
            slots = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(row[slots], pa.int64())],
                ["lang", "slot", "n"],
            )

    labelled = df.select(F.col(quoted(text_col)).alias("t"), F.col(quoted(lang_col)).alias("l")).dropna()
    sums = labelled.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    counts: dict[str, np.ndarray] = {}
    rows = sums.toPandas()  # FEATURES rows for each language at most
    for x, part in rows.groupby("lang"):
        counts[x] = np.zeros(FEATURES + SCRIPTS, np.int64)
        counts[x][part["slot"].to_numpy()] = part["n"].to_numpy()
    return Model(counts)


def judge(model: Model, texts: Texts, spans: bool = False) -> tuple[list[str], np.ndarray, list]:
    names = model.languages
    predicted, scores, marked, plain = [], [], [], []
    most = max(1 << 20, _WORK_BYTES // max(4, len(names)))
    for _, _, part in texts.chunks(most):
        if not names:
            predicted += [UNDETERMINED] * len(part)
            scores.append(np.zeros(len(part)))
            marked += [[] for _ in range(len(part))]
            plain.append(np.ones(len(part), bool))
            continue
        found = Analysed(part)
        labels = viterbi(model.word_scores(found), found.first)
        of_text = np.repeat(np.arange(len(part)), np.diff(found.first))
        held = np.bincount(of_text * len(names) + labels, found.lengths, len(part) * len(names)).reshape(len(part), -1)
        total = held.sum(1)
        predicted += [names[k] if n else UNDETERMINED for k, n in zip(held.argmax(1).tolist(), total.tolist(), strict=True)]
        plain.append(np.bincount(of_text, found.plain, len(part)) > 0)
        scores.append(held.max(1) / np.maximum(total, 1))
        if spans:
            places = np.concatenate([[0], np.cumsum((part.data & 0xC0) != 0x80)])
            for i in range(len(part)):
                lo, hi = found.first[i], found.first[i + 1]
                cuts = np.flatnonzero(np.diff(labels[lo:hi])) + 1
                edges = [0, *cuts.tolist(), hi - lo] if hi > lo else []
                zero = places[part.bounds[i]]
                marked.append([
                    {"lang": names[labels[lo + a]], "start": int(places[found.starts[lo + a]] - zero),
                     "end": int(places[found.ends[lo + b - 1]] - zero)}
                    for a, b in zip(edges, edges[1:], strict=False)
                ])
    flat = np.concatenate(scores or [[]])
    for i in np.flatnonzero(~np.concatenate(plain or [np.zeros(0, bool)])).tolist():  # letters, if any, are not ASCII
        if not any(map(str.isalpha, texts.text(i))):
            predicted[i], flat[i] = UNDETERMINED, 0
        elif predicted[i] == UNDETERMINED:
            predicted[i] = model.commonest
    return predicted, flat, marked


def identify(
    df: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, spans: bool = False
) -> DataFrame:
    """df with lang_pred and score of each whole text, and lang_spans (code points) if asked for."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def factory(_):
        def process(texts: Texts) -> list:
            predicted, scores, marked = judge(shared.value, texts, spans)
            return [predicted, scores, *([marked] if spans else [])]

        return process

    added = "lang_pred string, score double" + ", lang_spans array<struct<lang:string,start:int,end:int>>" * spans
    return add_columns(df, text_col, added, factory, keep)


def remainder(doc_id, n: int):
    """crc32(doc_id as text) mod n; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def accepted():
    """Of identify()'s columns: the text has a language, and enough of it."""
    return (F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= LEAST_SCORE)


def keep_accepted(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of df whose text has a language, and at least LEAST_SCORE of it, with the columns of df."""
    names = [f"c{i}" for i in range(len(df.columns))]
    found = identify(df.toDF(*names), model, names[df.columns.index(text_col)])
    return found.where(accepted()).select(*names).toDF(*df.columns)
