"""Approximate nearest neighbours by inner product with robust-pruned directed graphs.

Equal vectors are one node that carries the smallest few ids it stands for. Nodes are dealt by hash
to shards of about ``SHARD`` nodes, and a shard's nodes to bands of like norms. In each band a
directed graph is built in batches over the directions of its nodes: a greedy search from fixed entry
nodes proposes neighbours, and relaxed distance pruning keeps those that no kept neighbour is much
nearer to, so that edges stay diverse; reverse edges are pruned the same way. A search follows them
by inner product, which one more coordinate turns into a Euclidean distance; within a band that
coordinate is small, so the graph leads the right way however much norms differ. Graphs are written
to the shared folder, one row a shard.

A task takes one shard: its graph comes first in the partition, and the queries stream past it.
Each beam search gives a query's best ``k`` of a band, scored again in double precision on the
original vectors; while the last of a beam ties with the k-th, the query is searched again with a
wider beam. Bands come by falling norm, and a query leaves out those whose largest norm cannot give
its k-th score of this shard. A ranking over shards keeps ``k``.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component take no
part, nor do null ids; only vectors of equal length meet; a repeated row counts once; a query id
with several vectors asks with the smallest of them; of equal scores those with the smaller ids
come first and stay; with fewer than ``k`` candidates all are returned; further input columns are
ignored; no vectors give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.common import map_batches, stored

SHARD = 4_096
#: Edges of a node, width of the beam when building and when searching, relaxation of pruning.
DEGREE, BUILD_BEAM, SEARCH_BEAM, RELAX = 32, 64, 80, 1.2
#: Nodes from which every search starts, nodes expanded at once, searches run at once.
ENTRIES, EXPAND, LOCKSTEP = 32, 4, 256
#: A band ends where norms are below its largest by this factor, but has at least so many nodes.
BAND_RATIO, BAND_NODES = 1.25, 128
K = 20


def _distance(base: np.ndarray, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of (n, m) rows of the base to (n, d) points."""
    near = base[rows]
    return (near * near).sum(-1) - 2 * np.einsum("nmd,nd->nm", near, to) + (to * to).sum(-1)[:, None]


def beam_search(base: np.ndarray, edges: np.ndarray, points: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Searches in lockstep: the rows of each beam, nearest first (-1: none), and all rows expanded."""
    n, count = len(points), len(base)
    entry = np.linspace(0, count - 1, min(ENTRIES, count)).astype(np.int64)
    seen = np.zeros((n, count), bool)
    seen[:, entry] = True
    rows = np.full((n, beam), -1, np.int64)
    far = np.full((n, beam), np.inf, np.float32)
    done = np.zeros((n, beam), bool)
    first = np.broadcast_to(entry, (n, len(entry)))
    rows[:, : len(entry)], far[:, : len(entry)] = first[:, :beam], _distance(base, first, points)[:, :beam]
    expanded, me = [], np.arange(n)[:, None]
    while True:
        open_far = np.where(done, np.inf, far)
        pick = np.argpartition(open_far, EXPAND, axis=1)[:, :EXPAND]
        live = np.isfinite(np.take_along_axis(open_far, pick, 1))
        if not live.any():
            break
        np.put_along_axis(done, pick, True, 1)
        parents = np.where(live, np.take_along_axis(rows, pick, 1), -1)
        expanded.append(parents)
        fresh = np.where((parents >= 0)[..., None], edges[np.maximum(parents, 0)], -1).reshape(n, -1)
        fresh = np.sort(fresh, 1)
        known = (fresh < 0) | seen[me, np.maximum(fresh, 0)]
        known[:, 1:] |= fresh[:, 1:] == fresh[:, :-1]
        q, at = np.nonzero(~known)
        found = fresh[q, at]
        seen[q, found] = True
        gap = np.full(fresh.shape, np.inf, np.float32)
        near = base[found]
        gap[q, at] = ((near - points[q]) ** 2).sum(-1)
        rows, far = np.concatenate([rows, fresh], 1), np.concatenate([far, gap], 1)
        done = np.concatenate([done, np.zeros(fresh.shape, bool)], 1)
        keep = np.argpartition(far, beam - 1, axis=1)[:, :beam]
        rows, far, done = (np.take_along_axis(a, keep, 1) for a in (rows, far, done))
        done |= ~np.isfinite(far)
    order = np.argsort(far, 1, kind="stable")
    rows, far = np.take_along_axis(rows, order, 1), np.take_along_axis(far, order, 1)
    return np.where(np.isfinite(far), rows, -1), np.concatenate(expanded, 1)


def robust_prune(base: np.ndarray, own: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Up to DEGREE diverse neighbours for each of the own rows out of its pool (-1: none)."""
    pool = np.sort(pool, 1)
    bad = (pool < 0) | (pool == own[:, None])
    bad[:, 1:] |= pool[:, 1:] == pool[:, :-1]
    far = np.where(bad, np.inf, _distance(base, np.maximum(pool, 0), base[own]))
    order = np.argsort(far, 1)
    pool, far = np.take_along_axis(pool, order, 1), np.take_along_axis(far, order, 1)
    width = max(1, int(np.isfinite(far).sum(1).max()))
    pool, far = pool[:, :width], far[:, :width]
    near = base[np.maximum(pool, 0)]
    square = (near * near).sum(-1)
    alive, me = np.isfinite(far), np.arange(len(own))
    out = np.full((len(own), DEGREE), -1, np.int64)
    for k in range(DEGREE):
        pick = alive.argmax(1)
        some = alive[me, pick]
        if not some.any():
            break
        out[:, k] = np.where(some, pool[me, pick], -1)
        chosen = near[me, pick]
        gap = square - 2 * np.einsum("ncd,nd->nc", near, chosen) + square[me, pick][:, None]
        alive &= RELAX * RELAX * gap > far
        alive[me, pick] = False
    return out


def build_graph(base: np.ndarray, seed: int = 7) -> np.ndarray:
    """(n, DEGREE) edges of every row, -1 where there are fewer."""
    n = len(base)
    if n <= DEGREE + 1:
        every = np.broadcast_to(np.arange(n), (n, n))
        return np.pad(np.where(every == np.arange(n)[:, None], -1, every), ((0, 0), (0, max(0, DEGREE - n))), constant_values=-1)[:, : max(DEGREE, n)]
    rng = np.random.default_rng(seed)
    edges = np.full((n, DEGREE), -1, np.int64)
    edges[:, : DEGREE // 4] = rng.integers(0, n, (n, DEGREE // 4))
    for own in np.array_split(rng.permutation(n), -(-n // LOCKSTEP)):
        rows, expanded = beam_search(base, edges, base[own], BUILD_BEAM)
        edges[own] = robust_prune(base, own, np.concatenate([rows, expanded, edges[own]], 1))
        # Reverse edges, grouped by the node that they leave from.
        source, target = np.repeat(own, DEGREE), edges[own].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        node, start, count = np.unique(target, return_index=True, return_counts=True)
        for wide in (False, True):
            pick = np.flatnonzero((count > DEGREE) == wide)
            for part in np.array_split(pick, max(1, len(pick) // (32 if wide else 512))):
                if not len(part):
                    continue
                width = count[part].max()
                at = start[part][:, None] + np.arange(width)
                added = np.where(np.arange(width) < count[part][:, None], source[np.minimum(at, len(source) - 1)], -1)
                both = np.concatenate([edges[node[part]], added], 1)
                ordered = np.sort(both, 1)
                ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
                fits = (ordered >= 0).sum(1) <= DEGREE
                edges[node[part[fits]]] = -np.sort(-ordered[fits], 1)[:, :DEGREE]
                if (~fits).any():
                    edges[node[part[~fits]]] = robust_prune(base, node[part[~fits]], both[~fits])
    return edges


def norms(vectors: np.ndarray) -> np.ndarray:
    """Lengths, also of vectors whose squares are out of range."""
    top = np.abs(vectors).max(1)
    return top * np.sqrt(((vectors / top[:, None]) ** 2).sum(1))


def bands(norm: np.ndarray) -> list[int]:
    """Where bands of like norms begin, and the end of the last; norms fall."""
    cuts = [0]
    for at in np.flatnonzero(np.diff(norm) < 0) + 1:
        if norm[at] * BAND_RATIO < norm[cuts[-1]] and at - cuts[-1] >= BAND_NODES and len(norm) - at >= BAND_NODES:
            cuts.append(int(at))
    return [*cuts, len(norm)]


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors, divided by the largest norm, with one more coordinate that makes all norms equal."""
    vectors = vectors / norms(vectors).max()
    square = (vectors**2).sum(1)
    return np.concatenate([vectors, np.sqrt(np.maximum(square.max() - square, 0))[:, None]], 1).astype(np.float32)


def usable(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(id, v) of the rows that take part, v in double precision."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(vectors[key].cast("bigint").alias("id"), vectors[vector].cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def graphs(nodes: DataFrame, shards: int, k: int = K) -> DataFrame:
    """(shard, dim, n, ids, vectors, cuts, edges): the bands' graphs of a shard and vector length, stored."""
    place = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = nodes.distinct().withColumn("place", place).where(F.col("place") <= k + 1)
    merged = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    dealt = merged.select(F.pmod(F.xxhash64(F.col("ids")[0]), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("dim"), "ids", "v")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # A partition is one shard.
        frames = [f for f in batches if len(f)]
        for _, frame in pd.concat(frames).groupby(["shard", "dim"]) if frames else ():
            yield built(frame)

    def built(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ids", key=lambda c: c.map(lambda x: x[0]), kind="stable")
        base = np.stack(frame["v"].to_numpy()).astype(np.float64)
        order = np.argsort(-norms(base), kind="stable")
        frame, base = frame.iloc[order], base[order]
        ids = np.full((len(frame), k + 1), np.iinfo(np.int64).min)
        for row, own in enumerate(frame["ids"]):
            ids[row, : len(own)] = own
        cuts = bands(norms(base))
        edges = np.full((len(base), DEGREE + 1), -1, "<i4")
        for low, high in zip(cuts, cuts[1:]):
            own = build_graph((base[low:high] / norms(base[low:high])[:, None]).astype(np.float32))
            edges[low:high, : own.shape[1]] = own
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "dim": [base.shape[1]], "n": [len(frame)], "ids": [ids.astype("<i8").tobytes()], "vectors": [base.astype("<f8").tobytes()], "cuts": [np.array(cuts, "<i4").tobytes()], "edges": [edges.tobytes()]})

    return stored(dealt.repartitionById(shards, "shard").mapInPandas(build, "shard int, dim int, n int, ids binary, vectors binary, cuts binary, edges binary"))


class Graph:
    """One shard's graphs, ready to be searched."""

    def __init__(self, n: int, ids: bytes, vectors: bytes, cuts: bytes, edges: bytes):
        self.base = np.frombuffer(vectors, "<f8").reshape(n, -1)
        self.ids = np.frombuffer(ids, "<i8").reshape(n, -1)
        cuts = np.frombuffer(cuts, "<i4").tolist()
        self.bands = list(zip(cuts, cuts[1:]))
        edges = np.frombuffer(edges, "<i4").reshape(n, -1).astype(np.int64)
        self.edges = [edges[low:high] for low, high in self.bands]
        self.space = [lifted(self.base[low:high]) for low, high in self.bands]
        self.norm = norms(self.base)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, id, score): each query's best k, by exact score and then id."""
        parts = [self._search(own[at : at + LOCKSTEP], queries[at : at + LOCKSTEP], k) for at in range(0, len(queries), LOCKSTEP)]
        return tuple(np.concatenate(c) for c in zip(*parts))

    def _search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = norms(queries)
        # Length of a query doesn't change its order of neighbours; a common one keeps distances alike.
        points = np.concatenate([queries / size[:, None], np.zeros((len(queries), 1))], 1).astype(np.float32)
        best, least = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), np.full(len(own), -np.inf)
        for band, (low, _) in enumerate(self.bands):
            with np.errstate(over="ignore"):
                todo = np.flatnonzero(size * self.norm[low] * (1 + 1e-9) >= least)
            found = [best]
            beam = SEARCH_BEAM
            while len(todo):
                rows, _ = beam_search(self.space[band], self.edges[band], points[todo], beam)
                rows = np.where(rows >= 0, rows + low, -1)
                score = np.where(rows >= 0, np.einsum("nbd,nd->nb", self.base[np.maximum(rows, 0)], queries[todo]), -np.inf)
                sorted_score = -np.sort(-score, 1)
                # Its own node may be among the first k + 1; a full beam that ends in a tie with them goes on.
                tied = (sorted_score[:, -1] == sorted_score[:, min(k, beam - 1)]) & np.isfinite(sorted_score[:, -1]) & (beam < len(self.space[band]))
                found.append(self._members(todo[~tied], own[todo[~tied]], rows[~tied], score[~tied]))
                todo, beam = todo[tied], 2 * beam
            q, vec, value = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((vec, -value, q))
            q, vec, value = q[order], vec[order], value[order]
            place = np.arange(len(q)) - np.searchsorted(q, np.arange(len(own)))[q]
            least[q[place == k - 1]] = value[place == k - 1]
            best = tuple(c[place < k] for c in (q, vec, value))
        return own[best[0]], best[1], best[2]

    def _members(self, at: np.ndarray, own: np.ndarray, rows: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's place, id, score) of the ids that found nodes stand for."""
        member = self.ids[np.maximum(rows, 0)]
        q, b, m = np.nonzero((member != np.iinfo(np.int64).min) & (rows >= 0)[..., None] & (member != own[:, None, None]))
        return at[q], member[q, b, m], score[q, b]


def _streamed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Searches of a partition's rows: graphs, each followed by the queries of its shard and length."""
    graph, of = None, None
    for b in batches:
        shard, dim, kind = (b.column(n).to_numpy(zero_copy_only=False) for n in ("shard", "dim", "kind"))
        new = (kind == 0) | np.concatenate([[True], (np.diff(shard) != 0) | (np.diff(dim) != 0) | (np.diff(kind) != 0)])
        cuts = [*np.flatnonzero(new).tolist(), b.num_rows]
        for low, high in zip(cuts, cuts[1:]):
            part = b.slice(low, high - low)
            if kind[low] == 0:
                graph, of = Graph(*(part.column(n)[0].as_py() for n in ("n", "ids", "vectors", "cuts", "edges"))), (shard[low], dim[low])
            elif of == (shard[low], dim[low]):
                vectors = part.column("v").flatten().to_numpy().reshape(high - low, -1)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in graph.search(part.column("id").to_numpy(), vectors, k)], ["query_id", "vec_id", "score"])


def nearest(vectors: DataFrame, queries: DataFrame, vector: str = "embedding", key: str = "vec_id", k: int = K) -> DataFrame:
    """(query_id, rank, key, score): the k nearest found of each query, its own id left out."""
    nodes = stored(usable(vectors, vector, key))
    asked = usable(queries, vector, key).groupBy("id").agg(F.min("v").alias("v"))
    shards = max(1, -(-nodes.count() // SHARD))
    graph = graphs(nodes, shards, k).withColumn("kind", F.lit(0))
    every = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    dealt = asked.select("id", "v", F.size("v").alias("dim"), F.lit(1).alias("kind"), every)
    both = graph.unionByName(dealt, allowMissingColumns=True).repartitionById(shards, "shard").sortWithinPartitions("shard", "dim", "kind")
    found = map_batches(both, lambda batches: _streamed(batches, k), "query_id bigint, vec_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("vec_id").alias(key), "score")
