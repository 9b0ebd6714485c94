"""Approximate nearest neighbours by cosine in robust-pruned directed graphs.

Equal vectors are one point that knows its k + 1 smallest ids, so thousands of copies
neither clog the graph nor are lost. Points are dealt into shards of about SHARD_ROWS by
a hash. In each shard a graph is built: points are inserted in batches, a greedy search
of the graph so far proposes neighbours, and pruning keeps a candidate only if no kept
one is nearer to it by the factor ALPHA; links back are added and pruned alike. Then
the queries stream through the shard, each by a beam search from the medoid, and the
best of all shards are ranked by their exact cosine in double precision.

Vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor do
NULL ids. An id with several vectors counts with the largest of them in array order.
Vectors of other lengths are never neighbours. Ties go to the smaller id. A query with
no candidate has no row; with fewer than k, all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 4096
DEGREE = 32
BEAM = 64
#: Beam of the searches that propose neighbours.
BUILD_BEAM = 48
ALPHA = 1.2
_BATCH = 256
_WIDTH = 4


class Graph:
    """Directed graph over unit vectors; rows of ``out`` are padded with the point count."""

    def __init__(self, points: np.ndarray, seed: int):
        unit = points / np.linalg.norm(points, axis=1, keepdims=True)
        n = len(unit)
        # One more row, at no angle to anything, stands for empty places.
        self.unit = np.vstack((unit, np.zeros((1, unit.shape[1])))).astype(np.float32)
        self.n = n
        rng = np.random.default_rng(seed)
        self.out = np.full((n + 1, DEGREE), n)
        degree = min(DEGREE, n - 1)
        if degree > 0:
            # Random links to start with: a point may be drawn twice, never itself.
            self.out[:n, :degree] = (np.arange(n)[:, None] + rng.integers(1, n, (n, degree))) % n
        self.entry = int((unit @ unit.mean(0)).argmax())
        if n > DEGREE + 1:
            for alpha in (1.0, ALPHA):
                order = rng.permutation(n)
                for at in range(0, n, _BATCH):
                    self._insert(order[at : at + _BATCH], alpha)
        elif n > 1:
            self.out[:n, : n - 1] = np.array([[j for j in range(n) if j != i] for i in range(n)])

    def beam(self, queries: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(points, distances) of the beam around each unit query, nearest first."""
        n, q = self.n, len(queries)
        rows = np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), bool)
        seen[:, n] = True
        seen[:, self.entry] = True
        ids = np.full((q, size), n)
        far = np.full((q, size), np.inf, np.float32)
        done = np.ones((q, size), bool)
        ids[:, 0], done[:, 0] = self.entry, False
        far[:, 0] = 1 - queries @ self.unit[self.entry]
        live = np.arange(q)
        while len(live):
            # The nearest few that are not expanded yet; the others' places point nowhere.
            wait = np.where(done[live], np.inf, far[live])
            pick = np.argpartition(wait, _WIDTH - 1, axis=1)[:, :_WIDTH] if size > _WIDTH else np.argsort(wait, axis=1)
            good = np.take_along_axis(wait, pick, 1) < np.inf
            some = good.any(1)
            live, pick, good = live[some], pick[some], good[some]
            if not len(live):
                break
            mine = live[:, None]
            source = np.where(good, ids[mine, pick], n)
            done[mine, pick] = True
            near = self.out[source].reshape(len(live), -1)
            near = np.where(seen[mine, near], n, near)
            near.sort(axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = n
            seen[mine, near] = True
            d = 1 - np.einsum("qrd,qd->qr", self.unit[near], queries[live])
            d[near == n] = np.inf
            every = np.concatenate((far[live], d), 1)
            best = np.argpartition(every, size - 1, axis=1)[:, :size]
            far[live] = np.take_along_axis(every, best, 1)
            ids[live] = np.take_along_axis(np.concatenate((ids[live], near), 1), best, 1)
            flag = np.concatenate((done[live], near == n), 1)
            done[live] = np.take_along_axis(flag, best, 1)
        order = np.argsort(far, axis=1, kind="stable")
        return ids[rows, order], far[rows, order]

    def _prune(self, points: np.ndarray, near: np.ndarray, alpha: float) -> np.ndarray:
        """The neighbours that each point keeps of its candidates."""
        n = self.n
        near = np.where(near == points[:, None], n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        x = self.unit[near]
        d = 1 - np.einsum("qrd,qd->qr", x, self.unit[points])
        d[near == n] = np.inf
        order = np.argsort(d, axis=1, kind="stable")
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        x = self.unit[near]
        between = 1 - x @ x.transpose(0, 2, 1)
        alive = near < n
        kept = np.zeros(len(points), np.int64)
        out = np.full((len(points), DEGREE), n)
        for i in range(near.shape[1]):
            take = np.flatnonzero(alive[:, i] & (kept < DEGREE))
            if len(take):
                out[take, kept[take]] = near[take, i]
                kept[take] += 1
                alive[take] &= alpha * between[take, i] > d[take]
        return out

    def _insert(self, points: np.ndarray, alpha: float) -> None:
        near, _ = self.beam(self.unit[points], min(BUILD_BEAM, self.n))
        self.out[points] = self._prune(points, np.concatenate((near, self.out[points]), 1), alpha)
        source = np.repeat(points, DEGREE)
        target = self.out[points].ravel()
        real = target < self.n
        source, target = source[real], target[real]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        to, first, number = np.unique(target, return_index=True, return_counts=True)
        for at in np.array_split(np.arange(len(to)), max(1, len(to) // 64)):
            more = np.full((len(at), number[at].max()), self.n)
            column = np.arange(more.shape[1])
            inside = column < number[at][:, None]
            more[inside] = source[(first[at][:, None] + column)[inside]]
            every = np.concatenate((self.out[to[at]], more), 1)
            self.out[to[at]] = self._prune(to[at], every, alpha)


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v): one vector of doubles for each id that takes part."""
    v = F.col("v")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return (
        vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
        .filter(F.col("vec_id").isNotNull() & F.coalesce(ok, F.lit(False)))
        .groupBy("vec_id").agg(F.max("v").alias("v"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    flat = column.flatten().to_numpy()
    return flat.reshape(n, -1) if n else np.zeros((0, 0))


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, beam: int = BEAM, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest vectors of each query but its own id."""
    every = usable(vectors, vec_id, embedding)
    # Only the k + 1 smallest ids of equal vectors can be among the nearest.
    w = Window.partitionBy("v").orderBy("vec_id")
    points = (
        every.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k + 1)
        .groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    )
    sizes = every.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
    if not sizes:
        return every.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    shards = {r["d"]: -(-r["n"] // SHARD_ROWS) for r in sizes}
    number = F.create_map(*[F.lit(x) for d, n in shards.items() for x in (d, n)])
    d = F.size("v")
    stored = points.select(
        d.alias("d"), F.pmod(F.xxhash64(F.col("ids")[0]), number[d]).cast("int").alias("shard"), "v", "ids", F.lit(0).alias("asks")
    )
    asked = usable(queries, vec_id, embedding).filter(number[d].isNotNull()).select(
        d.alias("d"), F.explode(F.sequence(F.lit(0), (number[d] - 1).cast("int"))).alias("shard"), "v",
        F.array("vec_id").alias("ids"), F.lit(1).alias("asks"),
    )
    # Shards of all lengths are numbered through, and each is a partition of its own.
    sizes_in_order = sorted(shards)
    first = F.create_map(*[F.lit(x) for i, d in enumerate(sizes_in_order) for x in (d, sum(shards[e] for e in sizes_in_order[:i]))])
    dealt = stored.union(asked).repartitionById(sum(shards.values()), (first[F.col("d")] + F.col("shard")).cast("int"))
    dealt = dealt.sortWithinPartitions("d", "shard", "asks")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per shard: its points come first, then the queries."""
        here, graph, points, ids = None, None, [], []
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in (0, 1, 4)], 1)
            edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
            for a, b in zip(edge, np.append(edge[1:], len(key))):
                part = batch.slice(a, b - a)
                if here != tuple(key[a, :2]):
                    here, graph, points, ids = tuple(key[a, :2]), None, [], []
                if key[a, 2] == 0:
                    points.append(_matrix(part.column(2)))
                    ids += part.column(3).to_pylist()
                    continue
                if not points:
                    continue
                if graph is None:
                    points = [np.concatenate(points)]
                    graph = Graph(points[0], int(here[1]))
                    length = np.linalg.norm(points[0], axis=1)
                for at in range(0, b - a, _BATCH):
                    own = part.slice(at, _BATCH)
                    q, of = _matrix(own.column(2)), own.column(3).flatten().to_pylist()
                    norm = np.linalg.norm(q, axis=1)
                    near, _ = graph.beam((q / norm[:, None]).astype(np.float32), min(beam, graph.n))
                    rows = []
                    for i, query in enumerate(of):
                        found = near[i][near[i] < graph.n]
                        score = (points[0][found] * q[i]).sum(1) / (length[found] * norm[i])
                        # The places of the k + 1 nearest points hold the k nearest other ids.
                        best = sorted(
                            ((-s, x) for s, p in zip(score.tolist(), found.tolist()) for x in ids[p] if x != query)
                        )[:k]
                        rows += [(query, x, -s) for s, x in best]
                    columns = list(zip(*rows)) or [[]] * 3
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
                        ["query_id", "vec_id", "score"],
                    )

    found = dealt.mapInArrow(searched, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def digest(embeddings: DataFrame) -> DataFrame:
    """The 5 nearest of each vector whose id is divisible by 50."""
    return search(embeddings.filter(F.col("vec_id") % 50 == 0), embeddings, 5)
