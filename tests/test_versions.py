"""Saved tables: versions that are whole, unchanged rows, repeated batches, failed and competing saves."""

import pytest
from pyspark.sql import functions as F

from jobtide.sources import versions

SHAPE = "slug string, title string, _saved string"


@pytest.fixture
def root(tmp_path):
    return f"file://{tmp_path}/saved"


def made(spark, *rows):
    return spark.createDataFrame([(*r, "own") for r in rows], SHAPE)


def held(spark, root, version=None):
    return sorted(((r.slug, r.title, r._saved) for r in versions.read(spark, root, version).collect()), key=repr)


def test_changed_rows_alone_are_written(spark, root):
    assert versions.save(made(spark, ("a", "1"), ("b", "2"), (None, None)), root, ["slug"]) == 1
    assert versions.save(made(spark, ("a", "1"), ("b", "3"), ("c", None), (None, None)), root, ["slug"]) == 2
    assert held(spark, root) == sorted([("a", "1", 1), ("b", "3", 2), ("c", None, 2), (None, None, 1)], key=repr)
    assert held(spark, root, 1) == sorted([("a", "1", 1), ("b", "2", 1), (None, None, 1)], key=repr)
    newest = versions._told(spark, root, 2)["folders"][-1]
    assert spark.read.parquet(f"{root}/rows/{newest}").count() == 2
    # back to what it once was is a change
    versions.save(made(spark, ("b", "2")), root, ["slug"])
    assert ("b", "2", 3) in held(spark, root)


def test_ties_repeats_and_empty_tables(spark, root):
    assert versions.save(made(spark), root, ["slug"]) == 1 and held(spark, root) == []
    rows = made(spark, ("a", "1"), ("a", "1"), ("a", "2"))
    versions.save(rows, root, ["slug"])
    least = min(("1", "2"), key=lambda t: __import__("hashlib").sha256(f'{{"title":"{t}"}}'.encode()).hexdigest())
    assert held(spark, root) == [("a", least, 2)]
    versions.save(made(spark), root, ["slug"])
    assert held(spark, root) == [("a", least, 2)]


def test_a_batch_counts_once(spark, root):
    save = lambda title, writer, n: versions.save(made(spark, ("a", title)), root, ["slug"], writer, n)
    assert save("1", "x", 0) == 1 and save("2", "x", 0) == 1 and save("3", "x", 5) == 2 and save("4", "x", 4) == 2
    assert save("5", "y", 0) == 3
    assert held(spark, root) == [("a", "5", 3)]


def test_a_failed_save_leaves_the_version(spark, root):
    versions.save(made(spark, ("a", "1")), root, ["slug"])
    broken = made(spark, ("a", "2"), ("b", "2")).withColumn("title", F.when(F.col("slug") == "b", F.raise_error(F.lit("killed"))).otherwise(F.col("title")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        versions.save(broken, root, ["slug"], "x", 1)
    assert versions.versions(spark, root) == [1] and held(spark, root) == [("a", "1", 1)]
    assert versions.save(made(spark, ("a", "2"), ("b", "2")), root, ["slug"], "x", 1) == 2
    assert held(spark, root) == [("a", "2", 2), ("b", "2", 2)]


def test_of_two_saves_at_once_one_begins_anew(spark, root, monkeypatch):
    versions.save(made(spark, ("a", "1"), ("b", "1")), root, ["slug"])
    written, others = versions._written, [made(spark, ("a", "other"), ("b", "other"))]

    def meanwhile(*args):
        if others:
            versions.save(others.pop(), root, ["slug"])
        return written(*args)

    monkeypatch.setattr(versions, "_written", meanwhile)
    # b is unchanged against the version that this save began from, and changed against the one that it meets
    assert versions.save(made(spark, ("a", "mine"), ("b", "1")), root, ["slug"]) == 3
    assert held(spark, root) == [("a", "mine", 3), ("b", "1", 3)]


def test_many_folders_become_one(spark, root, monkeypatch):
    monkeypatch.setattr(versions, "MOST_FOLDERS", 3)
    for k in range(4):
        versions.save(made(spark, ("a", str(k)), (f"own{k}", "x")), root, ["slug"])
    assert [len(versions._told(spark, root, v)["folders"]) for v in (1, 2, 3, 4)] == [1, 2, 1, 2]
    assert held(spark, root) == [("a", "3", 4), *((f"own{k}", "x", k + 1) for k in range(4))]


def test_other_columns_are_refused(spark, root):
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, root)
    versions.save(made(spark, ("a", "1")), root, ["slug"])
    with pytest.raises(ValueError, match="first save"):
        versions.save(made(spark, ("a", "1")).withColumn("more", F.lit(1)), root, ["slug"])


def test_a_stream_started_again(spark, root, tmp_path):
    told = made(spark).schema
    for k in range(3):
        made(spark, ("a", str(k)), (f"own{k}", "x")).write.mode("append").parquet(f"{tmp_path}/in")
        rows = spark.readStream.schema(told).parquet(f"{tmp_path}/in")
        each = lambda batch, n: versions.save(batch, root, ["slug"], "stream", n)
        rows.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert held(spark, root) == [("a", "2", 3), *((f"own{k}", "x", k + 1) for k in range(3))]
