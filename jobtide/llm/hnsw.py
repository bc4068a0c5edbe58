"""Embedding near-duplicates: hierarchical navigable small-world graphs per shard.

Equal vectors are one node. Nodes are dealt into shards by hash; a task builds the graph of a shard and writes it, and
tasks of one shard and one part of the queries answer the queries of all nodes: descent through the upper layers, a
beam of `beam` in the lowest, and from there on through every node within FLOOD of the threshold, so that a large group
is found whole. Each pair found is verified in double precision.

A query that finds at most FEW nodes in a shard gives the pairs, in both directions; one that finds more gives their
number, so a large group does not become all its pairs. Each task joins what it has found to a spanning forest, and the
forests' links give the components.

The graphs serve every table, whatever its size and however rare its pairs. An audit compares AUDIT_ROWS nodes, chosen by
hash, with all vectors by exact blocks. Its recall is the mean over audited nodes that have links, taken apart for nodes of at most
SPARSE_LINKS and for those of large groups, and the lower of the two counts: a large group cannot hide isolated pairs that are missed.
Where fewer than AUDIT_LEAST of the audited nodes are of the sparse kind, probes are planted: copies of the audited vectors, turned away
from them to a cosine of 0.9 to 0.95, ask the graphs and the exact blocks alike, and their recall counts as a third kind. While recall is
below AUDIT_RECALL, the beam is doubled and the same graphs are searched again; only past WIDEST all is searched by exact blocks.

A shard's size is bounded, so the number of shards grows with the table beyond FEWEST_SHARDS * SHARD_ROWS nodes.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths never link; repeated rows count as other vectors, but keep their one id; ties in cosine do not matter,
as all links from the threshold on count; null ids come last; an empty table gives no rows; columns of the input named
as an added one are replaced, others stay whatever their names.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm.batches import Scratch, mixed, quoted
from jobtide.llm.components import components

COSINE = 0.9
FLOOD = 0.03
FEWEST_SHARDS = 8
SHARD_ROWS = 20_000
NEIGHBOURS = 12
BUILD_BEAM = 40
BEAM = 20
BLOCK = 256
#: Nodes that a query may find in a shard and still give pairs.
FEW = 16
#: Queries of a task, about, and the pairs that a flood goes on from at once.
QUERY_ROWS = 50_000
_WAVE = 1 << 16
AUDIT_ROWS = 1024
AUDIT_RECALL = 0.97
AUDIT_LEAST = 256
SPARSE_LINKS = 64
WIDEST = 5120


class Graph:
    """A graph over unit vectors; inserts and searches work on blocks of vectors at a time."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, neighbours: int = NEIGHBOURS, beam: int = BUILD_BEAM):
        exact = np.asarray(vectors, np.float64)
        self.exact = exact / np.linalg.norm(exact, axis=1, keepdims=True)
        self.x = self.exact.astype(np.float32)
        self.ids, self.m = ids, neighbours
        n = len(self.x)
        chance = (mixed(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        self.level = np.minimum(12, -np.log(np.maximum(chance, 1e-300)) / np.log(neighbours)).astype(np.int64)
        self.links = [np.full((n, neighbours * (1 if k else 2)), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.top = int(np.argmax(self.level)) if n else 0
        order = np.argsort(-self.level, kind="stable")  # upper layers are whole before the lower ones fill
        at = 0
        while at < n:
            size = 1 if not at else min(BLOCK, max(8, at // 4))
            self._insert(order[at : at + size], at, beam)
            at += size

    def _insert(self, new: np.ndarray, there: int, beam: int) -> None:
        q = self.x[new]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        entry = np.full(len(new), self.top)
        for k in range(len(self.links) - 1, -1, -1):
            mine = np.flatnonzero(self.level[new] >= k)
            if not there:
                return
            found, sims = self._beam(q, entry, k, beam if len(mine) else 1)
            entry = np.where(found[:, 0] >= 0, found[:, 0], entry)
            if not len(mine):
                continue
            others = np.where((self.level[new] >= k)[None, :], among, -np.inf)
            near = np.argsort(-others, axis=1)[:, :beam]
            sims = np.concatenate([sims, np.take_along_axis(others, near, 1)], 1)[mine]
            found = np.concatenate([found, np.where(np.isfinite(np.take_along_axis(others, near, 1)), new[near], -1)], 1)[mine]
            chosen = self._choose(found, sims, self.links[k].shape[1] // (1 if k else 2))
            self.links[k][new[mine], : chosen.shape[1]] = chosen
            self._back(k, np.repeat(new[mine], chosen.shape[1]), chosen.ravel())

    def _back(self, k: int, source: np.ndarray, target: np.ndarray) -> None:
        """Links from targets to sources; full lists are chosen anew."""
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        links = self.links[k]
        width = links.shape[1]
        for lo in range(0, len(nodes), BLOCK):
            part = slice(lo, lo + BLOCK)
            most = int(counts[part].max())
            place = np.arange(most)[None, :]
            fresh = np.where(place < counts[part][:, None], source[np.minimum(first[part][:, None] + place, len(source) - 1)], -1)
            held = links[nodes[part]]
            fresh[(fresh[:, :, None] == held[:, None, :]).any(2)] = -1
            every = np.concatenate([held, fresh], 1)
            sims = np.where(every >= 0, np.einsum("nd,nmd->nm", self.x[nodes[part]], self.x[np.maximum(every, 0)]), -np.inf)
            links[nodes[part]] = self._choose(every, sims, width)

    def _choose(self, found: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of each row's candidates those nearer to it than to any chosen one, then the nearest others, up to most."""
        order = np.argsort(-sims, axis=1, kind="stable")[:, : max(3 * most, BUILD_BEAM)]
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        real = np.isfinite(sims) & (found >= 0)
        x = self.x[np.maximum(found, 0)]
        between = np.matmul(x, x.transpose(0, 2, 1))
        chosen = np.zeros(found.shape, bool)
        closest = np.full(found.shape, -np.inf, np.float32)
        for c in range(found.shape[1]):
            good = real[:, c] & (closest[:, c] < sims[:, c]) & (chosen.sum(1) < most)
            chosen[good, c] = True
            closest[good] = np.maximum(closest[good], between[good, c])
        rank = np.where(chosen, 0, np.where(real, 1, 2))
        order = np.argsort(rank, axis=1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(real, order, 1), np.take_along_axis(found, order, 1), -1)
        if out.shape[1] < most:
            out = np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1)
        return out

    def _beam(self, q: np.ndarray, entry: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(q)
        links = self.links[k]
        seen = np.zeros((n, len(self.x)), bool)
        ids = np.full((n, beam), -1)
        sims = np.full((n, beam), -np.inf, np.float32)
        opened = np.zeros((n, beam), bool)
        every = np.arange(n)
        ids[:, 0], sims[:, 0] = entry, np.einsum("nd,nd->n", q, self.x[entry])
        seen[every, entry] = True
        live = every
        while len(live):
            waiting = ~opened[live] & (ids[live] >= 0)
            some = waiting.any(1)
            live = live[some]
            if not len(live):
                break
            place = waiting[some].argmax(1)
            opened[live, place] = True
            near = links[ids[live, place]]
            fresh = (near >= 0) & ~seen[live[:, None], near]
            to = np.maximum(near, 0)
            seen[live[:, None], to] |= fresh
            own = np.where(fresh, np.matmul(self.x[to], q[live][:, :, None])[:, :, 0], -np.inf)
            all_sims = np.concatenate([sims[live], own], 1)
            best = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            sims[live] = np.take_along_axis(all_sims, best, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], 1), best, 1)
            opened[live] = np.take_along_axis(np.concatenate([opened[live], np.zeros(own.shape, bool)], 1), best, 1)
        return ids, sims

    def within(self, queries: np.ndarray, cosine: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(query's place, node's place) of all pairs found with at least this cosine."""
        exact = np.asarray(queries, np.float64)
        exact = exact / np.linalg.norm(exact, axis=1, keepdims=True)
        q = exact.astype(np.float32)
        entry = np.full(len(q), self.top)
        for k in range(len(self.links) - 1, 0, -1):
            entry = self._beam(q, entry, k, 1)[0][:, 0]
        ids, sims = self._beam(q, entry, 0, beam)
        near = (ids >= 0) & (sims >= cosine - FLOOD)
        rows, nodes = np.nonzero(near)[0], ids[near]
        n = len(self.x)
        seen = np.zeros(len(q) * n, bool)
        seen[rows * n + nodes] = True
        found, waiting = [rows * n + nodes], [rows * n + nodes]
        while waiting:
            wave = waiting.pop()
            if len(wave) > _WAVE:
                waiting.append(wave[_WAVE:])
            rows, nodes = np.divmod(wave[:_WAVE], n)
            near = self.links[0][nodes]
            rows = np.repeat(rows, near.shape[1])[near.ravel() >= 0]
            near = near.ravel()[near.ravel() >= 0]
            keys = rows * n + near
            keys = np.unique(keys[~seen[keys]])
            seen[keys] = True
            close = np.zeros(len(keys), bool)
            for lo in range(0, len(keys), 1 << 15):
                r, v = np.divmod(keys[lo : lo + (1 << 15)], n)
                close[lo : lo + (1 << 15)] = np.einsum("nd,nd->n", q[r], self.x[v]) >= cosine - FLOOD
            if close.any():
                found.append(keys[close])
                waiting.append(found[-1])
        rows, nodes = np.divmod(np.concatenate(found), n)
        good = np.zeros(len(rows), bool)
        for lo in range(0, len(rows), 1 << 15):
            part = slice(lo, lo + (1 << 15))
            good[part] = np.einsum("nd,nd->n", exact[rows[part]], self.exact[nodes[part]]) >= cosine
        return rows[good], nodes[good]


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


class Exact:
    """What Graph.within finds, by comparing all."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.exact, self.ids = vectors / np.linalg.norm(vectors, axis=1, keepdims=True), ids

    def within(self, queries: np.ndarray, cosine: float, beam: None) -> tuple[np.ndarray, np.ndarray]:
        q = queries / np.linalg.norm(queries, axis=1, keepdims=True)
        found = []
        for lo in range(0, len(self.exact), 4096):
            rows, nodes = np.nonzero(q @ self.exact[lo : lo + 4096].T >= cosine)
            found.append((rows, nodes + lo))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


class Forest:
    """Joins numbers into components and keeps the links that joined two."""

    def __init__(self, size: int):
        self.root = np.arange(size)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links a[i] to b[i]; in each round every root takes over from the greater roots that it has a link with."""
        while True:
            x, y = self._find(a), self._find(b)
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            first = order[np.flatnonzero(np.diff(high[order], prepend=-1))]
            self.links.append((a[first], b[first]))
            self.root[high[first]] = low[first]

    def _find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while len(left := np.flatnonzero(self.root[r] != r)):
            r[left] = self.root[r[left]]
        self.root[x] = r
        return r


def _built(nodes: DataFrame, shards: int, beam: int | None, scratch: Scratch) -> DataFrame:
    """size, shard, graph of the shards of nodes (id, size, v, n): a pickled Graph, or without a beam an Exact."""
    dealt = nodes.select("size", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), "id", "n", "v")
    dealt = dealt.repartitionById(shards, "shard").sortWithinPartitions("size", "shard", "id")

    def run(batches):
        current, parts = None, []

        def packed():
            vectors, ids, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            made = (Graph if beam else Exact)(vectors, ids)
            made.counts = counts
            return pa.RecordBatch.from_arrays(
                [pa.array([current[0]], pa.int32()), pa.array([current[1]], pa.int32()), pa.array([pickle.dumps(made, 5)], pa.binary())],
                ["size", "shard", "graph"],
            )

        for batch in batches:
            sizes, of, ids, counts = (batch.column(k).to_numpy() for k in range(4))
            change = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(of) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, len(ids)], strict=True) if len(ids) else ():
                if (key := (int(sizes[lo]), int(of[lo]))) != current:
                    if parts:
                        yield packed()
                    current, parts = key, []
                parts.append((_matrix(batch.column(4).slice(lo, hi - lo), key[0]), ids[lo:hi], counts[lo:hi]))
        if parts:
            yield packed()

    return scratch.table(dealt.mapInArrow(run, "size int, shard int, graph binary"))


_FOUND = "a long, shard int, nodes long, rows long, near array<long>, b long"


def _search(
    nodes: DataFrame, shards: int, cosine: float, beam: int | None, scratch: Scratch, count: int, queries: DataFrame | None = None,
    graphs: DataFrame | None = None,
) -> DataFrame:
    """What every shard's graph finds for every query (all nodes by default), by exact comparison without a beam.

    graphs: those of _built(), if they are there. For each query a and shard with a find: how many nodes, their rows, and the nodes if they are few (`near`); and
    links (a, b) of a spanning forest, with a null shard.
    """
    graphs = graphs or _built(nodes, shards, beam, scratch)
    asked = nodes if queries is None else queries
    splits = max(1, -(-count // QUERY_ROWS))
    built = graphs.select(
        "size", "shard", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"), F.lit(0).alias("kind"),
        F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), "graph",
    )
    split = F.pmod(F.xxhash64("id", F.lit("split")), F.lit(splits)).cast("int")
    asked = asked.select(
        "size", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), split.alias("split"), F.lit(1).alias("kind"), "id", "v",
        F.lit(None).cast("binary").alias("graph"),
    )
    tasks = shards * splits
    dealt = built.unionByName(asked).repartitionById(tasks, F.col("shard") * splits + F.col("split"))
    dealt = dealt.sortWithinPartitions("size", "shard", "split", "kind", "id")

    def run(batches):
        current = graph = forest = numbers = None

        def links():
            a, b = (np.concatenate(x) for x in zip(*forest.links, strict=True)) if forest and forest.links else (np.zeros(0, np.int64),) * 2
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(numbers[a]), pa.nulls(len(a), pa.int32()), none, none, pa.nulls(len(a), pa.list_(pa.int64())), pa.array(numbers[b])],
                ["a", "shard", "nodes", "rows", "near", "b"],
            )

        def begun(blob: bytes):
            made = pickle.loads(blob)  # noqa: S301  written by _built
            return made, Forest(len(made.ids)), made.ids

        for batch in batches:
            sizes, of, splits_of, kinds = (batch.column(k).to_numpy() for k in range(4))
            change = np.flatnonzero((np.diff(sizes) != 0) | (np.diff(of) != 0) | (np.diff(splits_of) != 0) | (np.diff(kinds) != 0)) + 1
            for lo, hi in zip([0, *change], [*change, len(sizes)], strict=True) if len(sizes) else ():
                if kinds[lo] == 0:
                    if forest:
                        yield links()
                    current = sizes[lo], of[lo], splits_of[lo]
                    graph, forest, numbers = begun(batch.column(6)[lo].as_py())
                    continue
                if current != (sizes[lo], of[lo], splits_of[lo]):
                    continue  # a shard without nodes
                every = batch.column(4).slice(lo, hi - lo).to_numpy()
                v = _matrix(batch.column(5).slice(lo, hi - lo), int(sizes[lo]))
                for at in range(0, hi - lo, BLOCK):
                    ids = every[at : at + BLOCK]
                    rows, found = graph.within(v[at : at + BLOCK], cosine, beam)
                    other = ids[rows] != graph.ids[found]
                    rows, found = rows[other], found[other]
                    order = np.argsort(rows, kind="stable")
                    rows, found = rows[order], found[order]
                    n = np.bincount(rows, minlength=len(ids))
                    weight = np.bincount(rows, graph.counts[found], len(ids)).astype(np.int64)
                    own = len(forest.root) + np.arange(len(ids))  # queries are numbered on from the shard's nodes
                    forest.root = np.append(forest.root, own)
                    numbers = np.append(numbers, ids)
                    forest.add(own[rows], found)
                    some = np.flatnonzero(n)
                    few = n[rows] <= FEW
                    ends = np.cumsum(np.where(n <= FEW, n, 0)[some])
                    near = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(graph.ids[found[few]]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[some]), pa.array(np.full(len(some), of[lo], np.int32)), pa.array(n[some]), pa.array(weight[some]), near,
                         pa.nulls(len(some), pa.int64())], ["a", "shard", "nodes", "rows", "near", "b"],
                    )
        if forest:
            yield links()

    return scratch.table(dealt.mapInArrow(run, _FOUND))


def _probes(chosen: DataFrame) -> DataFrame:
    """size, id, v: a vector at a cosine of 0.9 to 0.95 from each chosen one, in a direction that its id draws; one of a single component is itself."""

    def turned(batches):
        for batch in batches:
            out = []
            for i, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                draw = np.random.default_rng(i)
                v = np.array(v) / np.linalg.norm(v)
                away = draw.normal(size=len(v))
                away -= (away @ v) * v
                if (norm := np.linalg.norm(away)) > 1e-9 and len(v) > 1:
                    c = draw.uniform(COSINE + 0.001, COSINE + 0.05)
                    v = c * v + np.sqrt(1 - c * c) * away / norm
                out.append(v.tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.float64()))], ["size", "id", "v"])

    # negative ids: no node has one
    return chosen.select("size", "id", "v").mapInArrow(turned, "size int, id long, v array<double>").withColumn("id", -F.col("id") - 1)


def _audit(nodes: DataFrame, count: int, shards: int, cosine: float, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """What is true of the audited nodes, and probes with what is true of them where few of those are sparse."""
    exact = _built(nodes, shards, None, scratch)
    chosen = nodes.where(F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(max(count, 1))) < AUDIT_ROWS)
    truth = _search(nodes, shards, cosine, None, scratch, min(AUDIT_ROWS, count), chosen, exact)
    linked = truth.where("shard IS NOT NULL").groupBy("a").agg(F.sum("nodes").alias("n"))
    if linked.where(F.col("n") <= SPARSE_LINKS).count() >= AUDIT_LEAST:
        return truth, None
    return truth, scratch.table(_probes(chosen))


def _linked(found: DataFrame, nodes: DataFrame, shards: int) -> DataFrame:
    """a, shard, nodes, rows: the links of each node into each shard, those included that only the other end has found."""
    finds = found.where("shard IS NOT NULL")
    pairs = finds.select("a", "shard", F.explode("near").alias("b"))
    back = pairs.select(F.col("b").alias("a"), F.pmod(F.xxhash64("a"), F.lit(shards)).cast("int").alias("shard"), F.col("a").alias("b"))
    many = finds.where(F.col("nodes") > FEW).select("a", "shard", "nodes", "rows")
    pairs = pairs.unionByName(back.join(many.select("a", "shard"), ["a", "shard"], "left_anti")).distinct()
    counted = pairs.join(nodes.select(F.col("id").alias("b"), "n"), "b").groupBy("a", "shard")
    return counted.agg(F.count("*").alias("nodes"), F.sum("n").alias("rows")).unionByName(many)


def _recall(truth: DataFrame, linked: DataFrame) -> float:
    """Mean recall of the audited nodes with links: the lower one of sparse nodes and of large groups' nodes."""
    true = truth.where("shard IS NOT NULL").groupBy("a").agg(F.sum("nodes").alias("n"))
    held = linked.groupBy("a").agg(F.sum("nodes").alias("held"))  # every link found is true
    by_node = true.join(held, "a", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    kinds = by_node.groupBy((F.col("n") <= SPARSE_LINKS).alias("sparse")).agg(F.avg(F.col("held") / F.col("n")).alias("recall"))
    return min((r["recall"] for r in kinds.collect()), default=1.0)


class Served:
    """How a table was served: the beam (None: exact blocks), and the recall that the audit measured for it."""

    def __init__(self, beam: int | None, recall: float | None):
        self.beam, self.recall = beam, recall


def links(nodes: DataFrame, count: int, shards: int, cosine: float, beam: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, Served]:
    """What graphs find for all nodes, the links of each node into each shard, and how they were served."""
    truth, probes = _audit(nodes, count, shards, cosine, scratch)
    of_probes = None if probes is None else _search(nodes, shards, cosine, None, scratch, AUDIT_ROWS, probes)
    graphs = _built(nodes, shards, beam, scratch)
    while True:
        wide = beam if beam <= WIDEST else None
        recall = 1.0
        if wide and of_probes is not None:  # cheap, so first
            recall = _recall(of_probes, _search(nodes, shards, cosine, wide, scratch, AUDIT_ROWS, probes, graphs).where("shard IS NOT NULL"))
        if recall >= AUDIT_RECALL:
            found = _search(nodes, shards, cosine, wide, scratch, count, None, graphs if wide else None)
            linked = scratch.table(_linked(found, nodes, shards))
            if wide is None:
                return found, linked, Served(None, None)
            recall = min(recall, _recall(truth, linked))
            if recall >= AUDIT_RECALL:
                return found, linked, Served(wide, recall)
            scratch.drop(found, linked)
        beam *= 2


def near_vectors(
    df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", cosine: float = COSINE, beam: int = BEAM,
    keep: list[str] | None = None, scratch: Scratch | None = None,
) -> DataFrame:
    """df with n_links (other vectors linked directly), component_id (smallest id that links reach) and kept."""
    scratch = scratch or Scratch(df.sparkSession)
    added = ("n_links", "component_id", "kept")
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in added]
    vector, own = F.col(quoted(vector_col)), F.col(quoted(id_col)).cast("long")
    doubles = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))  # -0.0 + 0.0 is 0.0
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    key = F.when(finite & F.exists("v", lambda x: x != 0), F.col("v"))
    rows = df.select(*(F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(kept)), own.alias("own"), doubles.alias("v"))
    rows = rows.withColumn("v", key)
    last = F.coalesce("own", F.lit((1 << 63) - 1))
    nodes = rows.where("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"), F.min(last).alias("least"))
    nodes = scratch.table(nodes.select(F.monotonically_increasing_id().alias("id"), F.size("v").alias("size"), "v", "n", "least"))
    count = nodes.count()
    shards = max(FEWEST_SHARDS, -(-count // SHARD_ROWS))
    found, linked, _ = links(nodes, count, shards, cosine, beam, scratch)
    direct = linked.groupBy("a").agg(F.sum("rows").alias("others")).withColumnRenamed("a", "id")
    labels = components(found.where("b IS NOT NULL").select("a", "b"), scratch)
    joined = nodes.join(direct, "id", "left").join(labels.toDF("id", "label"), "id", "left")
    joined = joined.withColumn("label", F.coalesce("label", "id"))
    joined = scratch.table(joined.select("v", "label", "least", (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    least = scratch.table(joined.groupBy("label").agg(F.min("least").alias("component_id")))
    placed = scratch.table(joined.join(least, "label").select("v", "n_links", "component_id"))
    scratch.drop(nodes, found, linked, labels, joined, least)
    out = rows.join(placed, "v", "left")
    return out.select(
        *(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.nullif(F.coalesce("component_id", "own"), F.lit((1 << 63) - 1)).alias("component_id"),
        F.coalesce(F.coalesce("component_id", "own") == last, F.lit(True)).alias("kept"),
    )
