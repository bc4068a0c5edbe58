"""A table that is saved by key (SNK-1, SNK-10): versions appear whole, unchanged rows are not written again, a batch counts once.

    save(documents, root, ["slug"])
    stream.writeStream.foreachBatch(lambda rows, n: save(rows, root, ["slug"], writer="boards", batch=n))
    read(spark, root)

A save writes the rows whose key is new or whose content has another address (sha256 of the columns beside the key) to a folder of
its own by an ordinary Parquet write, of whose tasks Spark keeps one attempt each. Then a file of the version, which names the folders
that make it up, is renamed into place; a rename does not replace, so of two saves at once one begins anew from the other's version.
Readers see folders that a version names, so never a part of a save, and what a failed save leaves is never read. The driver handles
names of folders only. A version of MOST_FOLDERS folders is rewritten as one. Nothing is deleted: earlier versions stay readable.

Null keys are keys like others. Of rows with equal keys in one save the one with the smallest address stays; an empty table gives a
version without rows. A batch of a writer that is not above its last one changes nothing. Columns and their types stay those of the first
save, else ValueError. Added columns are `_address` and `_saved`, the version that wrote a row; columns of these names are replaced.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobtide.operators.history import first_wins

MOST_FOLDERS = 32
ATTEMPTS = 8
ADDED = ("_address", "_saved")


class _Files:
    """The few operations on Hadoop's file systems that Spark's readers and writers do not give."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf, self.root = spark.sparkContext._jsc.hadoopConfiguration(), root.rstrip("/")
        self.system = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        where = self.path(folder)
        return [f.getPath().getName() for f in self.system.listStatus(where)] if self.system.exists(where) else []

    def publish(self, name: str, text: str) -> bool:
        """Write a file that appears whole; False if there is one of this name."""
        draft, final = self.path(f"drafts/{uuid.uuid4().hex}"), self.path(name)
        self.system.mkdirs(final.getParent())
        out = self.system.create(draft, False)
        out.write(text.encode())
        out.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        plain = self.gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self.system.makeQualified(draft), self.system.makeQualified(final), plain)
        except Py4JJavaError as error:
            self.system.delete(draft, False)
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the versions, oldest first; the first is 1."""
    return sorted(int(n.removesuffix(".json")) for n in _Files(spark, root).names("versions") if n.endswith(".json"))


def _told(spark: SparkSession, root: str, version: int) -> dict:
    return json.loads(spark.read.text(f"{root.rstrip('/')}/versions/{version}.json", wholetext=True).first()[0])


def _rows(spark: SparkSession, root: str, told: dict) -> DataFrame:
    """Rows of all folders of a version, replaced ones too."""
    schema = T.StructType.fromJson(told["schema"]).add("_address", T.StringType()).add("_saved", T.LongType())
    if not told["folders"]:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{root.rstrip('/')}/rows/{f}" for f in told["folders"]))


def _same(key: list[str], left: str, right: str):
    met = F.lit(True)
    for k in key:
        met = met & F.col(f"{left}.`{k}`").eqNullSafe(F.col(f"{right}.`{k}`"))
    return met


def _newest(rows: DataFrame, told: dict) -> DataFrame:
    """Of each key the row saved last; keys are aggregated without the rows' content."""
    if len(told["folders"]) <= 1:
        return rows
    key = told["key"]
    last = rows.groupBy(*(f"`{k}`" for k in key)).agg(F.max("_saved").alias("_last"))
    return rows.alias("r").join(last.alias("l"), _same(key, "r", "l") & (F.col("r._saved") == F.col("l._last"))).select("r.*")


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version, the newest if none is given, with _address and _saved."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {version or ''} in {root}")
    told = _told(spark, root, version or known[-1])
    return _newest(_rows(spark, root, told), told)


def save(rows: DataFrame, root: str, key: list[str], writer: str = "", batch: int | None = None) -> int:
    """Save rows by key; the number of the version that holds them. batch: a number that grows with every batch of this writer."""
    spark, rows = rows.sparkSession, rows.drop(*ADDED)
    held = [c for c in rows.columns if c not in key]
    address = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in held))) if held else F.lit(""), 256)
    rows = first_wins(rows.withColumn("_address", address), [f"`{k}`" for k in key], ["_address"])
    schema = _plain(rows.drop("_address").schema.jsonValue())
    for _ in range(ATTEMPTS):
        known = versions(spark, root)
        told = _told(spark, root, known[-1]) if known else {"schema": schema, "key": key, "folders": [], "applied": {}}
        if (told["schema"], told["key"]) != (schema, key):
            raise ValueError("key, columns and types are those of the first save")
        if batch is not None and batch <= told["applied"].get(writer, batch - 1):
            return known[-1]
        after, fresh = (known[-1] if known else 0) + 1, rows
        if told["folders"]:
            now = _rows(spark, root, told)
            now = now.groupBy(*(f"`{k}`" for k in key)).agg(F.max_by("_address", "_saved").alias("_now"))
            fresh = rows.alias("r").join(now.alias("n"), _same(key, "r", "n"), "left").where(~F.col("n._now").eqNullSafe(F.col("r._address"))).select("r.*")
        folders = [*told["folders"], _written(spark, root, fresh.withColumn("_saved", F.lit(after).cast("long")))]
        if len(folders) >= MOST_FOLDERS:
            joined = told | {"folders": folders}
            folders = [_written(spark, root, _newest(_rows(spark, root, joined), joined))]
        applied = told["applied"] | ({} if batch is None else {writer: batch})
        if _Files(spark, root).publish(f"versions/{after}.json", json.dumps(told | {"folders": folders, "applied": applied})):
            return after
    raise RuntimeError(f"{ATTEMPTS} other saves to {root} came first")


def _written(spark: SparkSession, root: str, rows: DataFrame) -> str:
    name = uuid.uuid4().hex
    rows.write.parquet(f"{root.rstrip('/')}/rows/{name}")
    return name


def _plain(told):
    """A schema as Parquet gives it back: everything may be null, so that saves compare by names and types."""
    if isinstance(told, dict):
        return {k: True if k in ("nullable", "containsNull", "valueContainsNull") else {} if k == "metadata" else _plain(v) for k, v in told.items()}
    return [_plain(x) for x in told] if isinstance(told, list) else told
