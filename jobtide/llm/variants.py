"""Spelling variants: words one edit apart, found by an even-partition pigeonhole join, and the forms they lead to.

Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF; only A-Z is lower-cased). A damaged run loses one code point: where
97 divides h, the unsigned crc32 of `<doc_id>:<run>`, the one at h % length. A word counts if it has 5 code points and occurs
3 times in all texts.

A word of n code points is cut into two even segments, of n // 2 and of the rest. If two words differ by one edit, one
of the shorter word's segments is whole in the other, as its beginning or as its end. So each word is indexed by
(length, segment number, segment) and probes the segments of words of equal length and of words one shorter with the
beginning and the end of such lengths that it has itself. The join is by equality of these three. A candidate that
both segments propose is taken from the first, so nothing is deduplicated by a shuffle, and every candidate is verified
by its edit distance. Large groups of one key are dealt to many tasks: the probing side carries a number by hash of the word,
and the indexed words of a key that has more than GROUP of them are repeated for each number.

Of the words near to a word the one that occurs most (ties: the first in code-point order) is its form if it occurs at
least twice as often; forms are followed to their end by pointer doubling, in as many joins as the logarithm of the
longest way.

Edge cases: null and empty texts have no words; a null doc_id counts as empty text before the colon; a run that loses its
only code point is no word; a very long text is read in parts that are cut between runs; repeated rows count each; an
empty table has no words; other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.batches import Scratch, Texts, quoted, trim
from jobtide.llm.components import _roots

LEAST_LENGTH, LEAST_COUNT = 5, 3
DAMAGED = 97
#: Distinct words that a worker counts before it hands them on, and bytes of a text that it reads at once.
HELD_WORDS, READ_BYTES = 200_000, 4 << 20
#: Indexed words of a key beyond which its group is dealt to several tasks, and to how many at most.
GROUP, PARTS = 256, 64

#: U+00C0 to U+00FF are the bytes C3 80 to C3 BF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
_OTHER_LEAD = re.compile(rb"[\xc2\xc4-\xf4]")
_KEPT = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or 0x80 <= b <= 0xBF or b == 0xC3 else 32 for b in range(256))


def runs(text: bytes) -> list[bytes]:
    """The lower-cased runs of letters of a text."""
    if _OTHER_LEAD.search(text):
        return _RUN.findall(text.lower())
    return text.translate(_KEPT).split()


def _parts(text: bytes):
    """A text in parts of about READ_BYTES, cut where no run is."""
    at = 0
    while len(text) - at > READ_BYTES:
        cut = at + READ_BYTES
        while cut < len(text) and (text[cut] >= 0x80 or chr(text[cut]).isalpha()):
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def damaged(run: bytes, h: int) -> bytes:
    """The run without its code point h % length, if 97 divides h."""
    if h % DAMAGED:
        return run
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def counted_words(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word, n (long) for every word of any length and count, in the texts of df."""

    def count(batches):
        seen: Counter = Counter()

        def told():
            found = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()).cast(pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return found

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, texts in Texts.of(batch.column(1)).chunks(READ_BYTES):
                for i, doc in enumerate(ids[lo:hi]):
                    begun = zlib.crc32(b"%s:" % ("" if doc is None else str(doc)).encode())
                    for part in _parts(texts.bytes(i)):
                        for run, n in Counter(runs(part)).items():
                            seen[damaged(run, zlib.crc32(run, begun))] += n
                        if len(seen) > HELD_WORDS:
                            yield told()
        yield told()
        trim()

    source = df.select(F.col(quoted(id_col)).cast("string"), F.col(quoted(text_col)))
    return source.mapInArrow(count, "word string, n long").where("word <> ''").groupBy("word").agg(F.sum("n").alias("n"))


def _segments(length):
    """(number, first code point from 1 on, length) of the two segments of a word of some length."""
    half = F.floor(length / 2).cast("int")
    return ((1, F.lit(1), half), (2, half + 1, length - half))


def near_pairs(words: DataFrame) -> DataFrame:
    """a, na, b, nb: each two words of words (word, n; distinct words) that are one edit apart, once."""
    sized = words.withColumn("size", F.char_length("word"))
    index = sized.select(
        "word", "n", F.explode(F.array(*(F.struct(F.col("size"), F.lit(i).alias("part"), F.substring("word", at, n).alias("segment")) for i, at, n in _segments(F.col("size"))))).alias("e")
    ).select("e.*", F.col("word").alias("a"), F.col("n").alias("na"))
    probes = []
    for shorter in (0, 1):  # words of equal length, and those one shorter
        size = F.col("size") - shorter
        for i, at, n in _segments(size):
            probes.append(F.struct(size.cast("int").alias("size"), F.lit(i).alias("part"), F.substring("word", at + (shorter if i == 2 else 0), n).alias("segment")))
    probe = sized.select("word", "n", F.explode(F.array(*probes)).alias("e")).select("e.*", F.col("word").alias("b"), F.col("n").alias("nb"))
    key = ["size", "part", "segment"]
    large = index.groupBy(*key).agg(F.count("*").alias("many")).where(F.col("many") > GROUP)
    dealt = F.least(F.ceil(F.col("many") / GROUP), F.lit(PARTS)).cast("int")
    large = large.select(*key, dealt.alias("parts"))
    index = index.join(large, key, "left").withColumn("at", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    probe = probe.join(large, key, "left").withColumn("at", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    # equal words meet once each way: the smaller one is the indexed one; what the first segment proposes is left to it
    size, half = F.char_length("a"), F.floor(F.char_length("a") / 2).cast("int")
    once = (F.char_length("b") > size) | (F.col("a") < F.col("b"))
    first = (F.col("part") == 1) | (F.substring(F.col("a"), F.lit(1), half) != F.substring(F.col("b"), F.lit(1), half))
    met = index.join(probe, [*key, "at"])
    return met.where(once & first & (F.levenshtein("a", "b", 1) == 1)).select("a", "na", "b", "nb")


def variants(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
    scratch: Scratch | None = None,
) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the texts of df."""
    scratch = scratch or Scratch(df.sparkSession)
    words = counted_words(df, text_col, id_col).where((F.char_length("word") >= least_length) & (F.col("n") >= least_count))
    words = scratch.table(words)
    pairs = scratch.table(near_pairs(words))
    ends = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("nb").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("na").alias("n")),
    )).alias("e")).select("e.*")
    best = ends.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "other")).alias("best"))
    told = words.join(best, "word", "left")
    formed = F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False))
    told = told.select(
        "word", F.when(formed, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.less")).alias("form_n")
    )
    told = scratch.table(told)
    roots = _roots(scratch.table(told.select(F.col("word").alias("from"), F.coalesce("form", "word").alias("to"))), scratch)
    scratch.drop(pairs, words)
    return told.join(roots.toDF("word", "root"), "word").select("word", "form", "root", "n", "n_near", "form_n")
