"""Approximate nearest neighbours by cosine: a vantage-point tree in every shard.

On unit vectors cosine order is Euclidean order, so the triangle inequality prunes.  A node keeps a vantage point and
the median distance to it; a query at distance d leaves out the inner half when ``d - radius > factor * tau`` and the
outer half when ``radius - d > factor * tau``, tau being the distance of its k-th best so far.  ``factor`` 1 is the
exact search, smaller factors visit fewer leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readlake.llm.shared import written

FOUND = "query_id long, vec_id long, score double"


class VantageTree:
    """The tree over one shard.  Every leaf holds about ``leaf`` vectors; halves are cut by position, so that any
    number of equal vectors still splits."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = 32):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.norms = np.sqrt((self.vectors**2).sum(axis=1))
        self.unit = self.vectors / self.norms[:, None]
        self.vantage: list[int] = []
        self.radii: list[tuple[float, float]] = []  # largest inner, least outer distance
        self.leaves: list[tuple[np.ndarray, list[tuple[int, bool]]]] = []
        rng = np.random.default_rng(0)
        stack: list[tuple[np.ndarray, list[tuple[int, bool]]]] = [(np.arange(len(ids)), [])]
        while stack:
            rows, path = stack.pop()
            if len(rows) <= leaf:
                self.leaves.append((np.sort(rows), path))
                continue
            point = int(rows[rng.integers(len(rows))])
            gap = np.sqrt(np.maximum(((self.unit[rows] - self.unit[point]) ** 2).sum(axis=1), 0))
            by = np.argsort(gap, kind="stable")
            half = len(rows) // 2
            node = len(self.vantage)
            self.vantage.append(point)
            self.radii.append((float(gap[by[half - 1]]), float(gap[by[half]])))
            stack += [(rows[by[:half]], [*path, (node, True)]), (rows[by[half:]], [*path, (node, False)])]

    def bounds(self, unit: np.ndarray) -> np.ndarray:
        """For each query and leaf, the least distance that the triangle inequality leaves open."""
        gap = np.sqrt(np.maximum(2 - 2 * unit @ self.unit[self.vantage].T, 0)) if self.vantage else np.zeros((len(unit), 0))
        out = np.zeros((len(unit), len(self.leaves)))
        for k, (_, path) in enumerate(self.leaves):
            for node, inner in path:
                near, far = self.radii[node]
                np.maximum(out[:, k], gap[:, node] - near if inner else far - gap[:, node], out=out[:, k])
        return out

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, cosine) of the best ``k`` found for each query, its own id left out."""
        norms = np.sqrt((queries**2).sum(axis=1))
        unit = queries / norms[:, None]
        low = self.bounds(unit)
        best = np.full((len(queries), k), -np.inf)
        best_id = np.full((len(queries), k), np.iinfo(np.int64).max)

        def visit(leaf: int, at: np.ndarray) -> None:
            rows = self.leaves[leaf][0]
            # einsum adds in one fixed order, so equal vectors get equal cosines wherever they lie
            cos = np.einsum("qd,vd->qv", queries[at], self.vectors[rows]) / (norms[at][:, None] * self.norms[rows])
            cos = np.where(self.ids[rows] == query_ids[at][:, None], -np.inf, cos)
            every = np.concatenate([best[at], cos], axis=1)
            names = np.concatenate([best_id[at], np.where(np.isfinite(cos), self.ids[rows], np.iinfo(np.int64).max)], axis=1)
            top = np.lexsort((names, -every), axis=-1)[:, :k]
            best[at], best_id[at] = np.take_along_axis(every, top, 1), np.take_along_axis(names, top, 1)

        first = low.argmin(axis=1)
        for leaf in np.unique(first):
            visit(leaf, np.flatnonzero(first == leaf))
        for leaf in np.argsort(low.mean(axis=0)):
            tau = np.sqrt(np.maximum(2 - 2 * best[:, -1], 0))
            at = np.flatnonzero((first != leaf) & (low[:, leaf] <= factor * tau + 1e-9))
            if len(at):
                visit(leaf, at)
        row, col = np.nonzero(np.isfinite(best))
        return row, best_id[row, col], best[row, col]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec as doubles) of rows with an id and a vector that is neither null, empty nor zero, all finite."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, factor: float = 0.5, least_rows: int = 2048, most_shards: int = 4096, most_rows: int = 262_144) -> DataFrame:
    """query_id, rank, vec_id, score: for each of ``queries(id, vec)`` the nearest of ``vectors(id, vec)``.

    Ties go to the smaller id; a vector with the query's id is no candidate; vectors meet only others of their
    length; repeated rows of an id count once for each different vector.  No vectors or no queries give no rows.
    A shard gets ``least_rows`` or more until there are ``most_shards``, then shards grow to ``most_rows`` before
    their number does.  Shards are dealt by a hash of the id, so equal vectors spread.  Every query visits every
    shard and brings ``k`` rows back.
    """
    n = vectors.count()
    shards = max(-(-n // most_rows), min(most_shards, -(-n // least_rows)), 1)
    kept = vectors.distinct().withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")).withColumn("asks", F.lit(False))
    asked = queries.distinct().withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("asks", F.lit(True))
    rows = kept.unionByName(asked).withColumn("size", F.size("vec"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, tree = None, [], None
        for batch in batches:
            shard, size, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "size", "asks"))
            key = np.stack([shard, size, asks.astype(np.int32)], axis=1)
            edges = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if (shard[a], size[a]) != now:
                    now, own, tree = (shard[a], size[a]), [], None
                ids = batch.column("id").slice(a, b - a).to_numpy()
                vecs = batch.column("vec").slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                if not asks[a]:
                    own.append((ids, vecs))
                    continue
                if tree is None:
                    if not own:
                        continue
                    tree = VantageTree(np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own]))
                for c in range(0, len(ids), 512):
                    row, found, score = tree.search(ids[c : c + 512], vecs[c : c + 512], k, factor)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[c : c + 512][row]), pa.array(found), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = rows.repartition("shard").sortWithinPartitions("shard", "size", "asks").select("shard", "size", "asks", "id", "vec").mapInArrow(run, FOUND)
    # a vector id that repeats with other vectors is one candidate, by its best
    one = written(found).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
