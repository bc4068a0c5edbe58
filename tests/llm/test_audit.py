"""The audit of op5_hnsw sees isolated pairs beside a large group, and rare ones; a beam that fails gives way."""

import numpy as np
import pytest

from jobtide.llm import hnsw


@pytest.fixture
def lost(monkeypatch):
    """Graphs that find pairs of the large group only, whatever the beam."""
    whole = hnsw._search

    def search(nodes, shards, cosine, beam, scratch, *rest):
        found = whole(nodes, shards, cosine, beam, scratch, *rest)
        large = nodes.where("abs(v[0]) > 50").selectExpr("id AS a")
        return found if beam is None else scratch.table(found.join(large, "a", "left_semi").select(*found.columns))

    monkeypatch.setattr(hnsw, "_search", search)  # in the driver: workers do not see patches
    monkeypatch.setattr(hnsw, "WIDEST", hnsw.BEAM)


def links(spark, x):
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["n_links"] for r in hnsw.near_vectors(df).collect()}
    return [found[i] for i in range(len(x))]


@pytest.mark.parametrize("large, single", [(200, 1500), (0, 1500)])
def test_isolated_pairs_are_found(spark, lost, monkeypatch, large, single):
    monkeypatch.setattr(hnsw, "AUDIT_LEAST", 4)
    draw = np.random.default_rng(3)
    x = draw.normal(size=(large + single + 16, 24))
    x[:large] = 100 * np.eye(24)[0] + draw.normal(0, 1, (large, 24))
    x[-8:] = x[-16:-8] + 0.01 * draw.normal(size=(8, 24))  # eight pairs
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert links(spark, x) == ((unit @ unit.T >= 0.9).sum(1) - 1).tolist()


def test_graphs_serve_a_table_of_rare_pairs(spark, monkeypatch):
    """No audit is the result: every search of all nodes has a beam, and probes measure what few pairs cannot."""
    whole, asked = hnsw._search, []

    def search(nodes, shards, cosine, beam, scratch, count, queries=None, graphs=None):
        asked.append((beam, queries is None))
        return whole(nodes, shards, cosine, beam, scratch, count, queries, graphs)

    monkeypatch.setattr(hnsw, "_search", search)
    served = []
    real = hnsw.Served
    monkeypatch.setattr(hnsw, "Served", lambda *x: served.append(real(*x)) or served[-1])
    draw = np.random.default_rng(4)
    x = draw.normal(size=(2500, 32))
    x[-5:] = x[:5] + 0.05 * draw.normal(size=(5, 32))  # five pairs
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert links(spark, x) == ((unit @ unit.T >= 0.9).sum(1) - 1).tolist()
    assert [b for b, every in asked if every] and all(b for b, every in asked if every)
    assert served[0].beam and served[0].recall >= hnsw.AUDIT_RECALL


def test_probes_are_at_their_cosine(spark):
    draw = np.random.default_rng(6)
    v = draw.normal(size=(50, 8))
    rows = [(8, i, x.tolist()) for i, x in enumerate(v)] + [(1, 100, [-3.0])]
    found = {r["id"]: np.array(r["v"]) for r in hnsw._probes(spark.createDataFrame(rows, "size int, id long, v array<double>")).collect()}
    for i, x in enumerate(v):
        assert 0.9 <= found[-i - 1] @ x / np.linalg.norm(x) <= 0.951
    assert found[-101].tolist() == [-1.0] and len(found) == 51


def test_odd_rows_of_vectors(spark):
    """Null ids come last, rows of one id are other vectors, clashing names are replaced."""
    rows = [(None, [1.0, 0.1], 7), (5, [1.0, 0.1], 7), (5, [1.0, 0.11], 7), (2, [-1.0, 5.0], 7), (None, [0.0, 0.0], 7), (3, [5.0], 7), (3, [2.0], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, N_LINKS int")
    found = hnsw.near_vectors(df)
    assert found.columns == ["vec_id", "embedding", "n_links", "component_id", "kept"]
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in found.collect()} == {(2, 0, 2), (3, 1, 3), (5, 2, 5), (None, 0, None), (None, 2, 5)}
