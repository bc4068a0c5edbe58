"""Shared by the text operators: Arrow batches of texts, word spans in numpy, scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that numpy works on at once; a longer text is worked on alone.
CHUNK_BYTES = 2 << 20
#: Bytes of text that a processor gets, and gives results for, at once.
BATCH_BYTES = 4 << 20


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class Texts:
    """Consecutive texts of a batch: UTF-8 bytes in one array, bounds, and which are not null."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, valid: np.ndarray):
        self.data, self.bounds, self.valid = data, bounds, valid

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        valid = np.asarray(column.is_valid())
        column = column.cast(pa.large_string()).cast(pa.large_binary())
        _, offsets, data = column.buffers()
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64), valid)
        bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        return cls(data[bounds[0] : bounds[-1]], bounds - bounds[0], valid)

    def chunks(self, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
        """(first, end, texts) in order, each of at most `most` bytes or of one text."""
        at = 0
        while at < len(self):
            end = max(at + 1, int(np.searchsorted(self.bounds, self.bounds[at] + most, "right")) - 1)
            lo, hi = self.bounds[at], self.bounds[end]
            yield at, end, Texts(self.data[lo:hi], self.bounds[at : end + 1] - lo, self.valid[at:end])
            at = end

    def bytes(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()

    def text(self, i: int) -> str:
        return self.bytes(i).decode()


#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, a-z after lower-casing, and every byte of a character from U+0080 on.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
#: Bytes that are not white space (U+0020 and U+0009 to U+000D).
IN_TOKEN = np.ones(256, bool)
IN_TOKEN[[32, 9, 10, 11, 12, 13]] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        base = np.full(max(n, 64), 0x9E3779B97F4A7C15, np.uint64)
        base[0] = 1
        _POWERS = np.cumprod(base, dtype=np.uint64)
    return _POWERS


class Words:
    """Spans of the words of some texts: starts, ends, and for each text its first word's index."""

    def __init__(self, texts: Texts, kind: np.ndarray = IN_WORD):
        self.low = low = LOWER[texts.data]
        inside = kind[low]
        edge = texts.bounds[:-1][texts.bounds[:-1] < texts.bounds[1:]]
        before = np.empty_like(inside)
        before[1:] = inside[:-1]
        before[edge] = False
        self.starts = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[:-1] = inside[1:]
        after[texts.bounds[1:][texts.bounds[:-1] < texts.bounds[1:]] - 1] = False
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, texts.bounds)
        self._inside = inside

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> bytes:
        return self.low[self.starts[i] : self.ends[i]].tobytes()

    def hashes(self) -> np.ndarray:
        """64 bits for each word."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        lengths = self.ends - self.starts
        firsts = np.cumsum(lengths) - lengths
        letters = self.low[self._inside].astype(np.uint64)
        within = np.arange(len(letters)) - np.repeat(firsts, lengths)
        letters += np.uint64(1)
        letters *= powers(int(lengths.max()) + 1)[within]
        return mixed(np.add.reduceat(letters, firsts))


_HELD: dict = {}


def held(key, make: Callable):
    """What make() gives, kept in the worker for its next tasks; a worker keeps one such thing at a time."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def trim() -> None:
    """Give memory that is free back to the system: the worker stays for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def add_columns(
    df: DataFrame,
    text_col: str,
    added: str | T.StructType,
    factory: Callable[[Callable], Callable[[Texts], list]],
    keep: list[str] | None = None,
    also: list[str] | None = None,
) -> DataFrame:
    """The columns `keep` of df (all, if None) and those that a processor makes of each batch of texts.

    An input column named as an added one is replaced. `factory(held)` runs once per task, where held(key, make) keeps
    things for the worker's next tasks; the processor gets a batch's texts (and the Arrow columns `also`, if named) and
    returns one array for each added column.
    """
    fields = T._parse_datatype_string(added) if isinstance(added, str) else added
    taken = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in taken]
    read = [quoted(c) for c in kept]
    extra = [*([text_col] if text_col not in kept else []), *(c for c in also or [] if c not in kept)]
    names = {c: f"__in{i}" for i, c in enumerate(extra)}
    source = df.select(*read, *(F.col(quoted(c)).alias(names[c]) for c in extra))
    position = {c: i for i, c in enumerate([*kept, *extra])}
    types = [to_arrow_type(f.dataType) for f in fields]
    out = T.StructType([*(df.schema[c] for c in kept), *fields])

    def run(batches):
        before = dict(_HELD)
        _HELD.clear()
        process = factory(lambda key, make: held(key, lambda: before.get(key) or make()))
        before.clear()  # what another operator has kept goes
        for batch in batches:
            for lo, hi, texts in Texts.of(batch.column(position[text_col])).chunks(BATCH_BYTES):
                columns = batch.slice(lo, hi - lo).columns
                made = process(texts, *(columns[position[c]] for c in also or []))
                made = [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns[: len(kept)], *made], [*kept, *(f.name for f in fields)])
        trim()

    return source.mapInArrow(run, out)


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of its own where that is unset and all runs on one machine."""
    context = spark.sparkContext
    if root := context.getConf().get("spark.checkpoint.dir"):
        return root
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not getattr(context, "_own_scratch", None):
        context._own_scratch = "file://" + tempfile.mkdtemp(prefix="jobtide-")
        context.setCheckpointDir(context._own_scratch)
    return context._own_scratch


class Scratch:
    """Tables written to the shared folder: they cut lineage and survive a lost executor.

    What an operator returns reads them until clear(), which the end of a `with` block calls, or else the interpreter's
    end; a long session gives its operators a Scratch of its own and clears it when the results are written.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{scratch_root(spark).rstrip('/')}/{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.clear)

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.at}/{self._n}"
        self._n += 1
        df.write.parquet(path)
        found = self.spark.read.schema(df.schema).parquet(path)
        found._scratch_path = path
        return found

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in tables:
            self._delete(df._scratch_path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def clear(self) -> None:
        with contextlib.suppress(Exception):  # the session may have ended before the interpreter
            self._delete(self.at)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
