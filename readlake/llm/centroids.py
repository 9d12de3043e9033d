"""Exact integer k-means: nearest centroids by progressive search in the Walsh-Hadamard domain.

The transform H of 64 integers is exact in integers and ``H Hᵀ = 64 I``, so a squared distance is a 64th of the squared
difference of coefficients, and any part of those squares is a lower bound of it.  A vector meets all centroids on its
coarsest coefficients first, the nearest of them is finished at once, and a centroid goes as soon as its part is
strictly worse than that; the rest pass on to finer coefficients until all 64 are in.  Equal distances survive to the
end, where the smaller number wins.

Vectors are transformed once, in coarse-to-fine order, and written; a round is one scan of that table.  Each task adds
up the coefficients of its vectors by cluster, which the transform turns back into sums of components, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.shared import discard, written

SIZE = 64
#: Where the coefficients' blocks end; the first is the coarsest.
BLOCKS = (4, 16, 64)
#: Squares of coefficients under this stay in 64 bits when 64 of their differences are added.
_NARROW = 1 << 27
ROWS = 4096


def _matrix(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The Walsh-Hadamard matrix and the order of its rows by number of sign changes, coarse first."""
    out = np.ones((1, 1), np.int64)
    while len(out) < size:
        out = np.block([[out, out], [out, -out]])
    return out, np.argsort((np.diff(out, axis=1) != 0).sum(axis=1), kind="stable")


def transform(vectors: np.ndarray) -> np.ndarray:
    """Coefficients of integer rows, by sums and differences of halves, coarse first."""
    n, size = vectors.shape
    out, half = vectors, 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return out[:, _matrix(size)[1]]


def nearest_centroids(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of and squared distance to each row's nearest centroid, and how many coefficients were compared.

    Both sides are coefficients in the order of ``transform``.  Values beyond 27 bits are taken as whole numbers of any size.
    """
    wide = max((int(np.abs(a).max()) for a in (vectors, centroids) if a.size), default=0) >= _NARROW
    if wide:
        vectors, centroids = vectors.astype(object), centroids.astype(object)
    n, k = len(vectors), len(centroids)
    first = BLOCKS[0]
    part = ((vectors[:, None, :first] - centroids[None, :, :first]) ** 2).sum(axis=2)
    guess = part.argmin(axis=1)
    bound = part[np.arange(n), guess] + ((vectors[:, first:] - centroids[guess, first:]) ** 2).sum(axis=1)
    alive = part <= bound[:, None]
    seen = n * k * first + n * (SIZE - first)
    for begin, end in zip(BLOCKS[:-1], BLOCKS[1:], strict=True):
        row, col = np.nonzero(alive)
        part[row, col] += ((vectors[row, begin:end] - centroids[col, begin:end]) ** 2).sum(axis=1)
        alive[row, col] = part[row, col] <= bound[row]
        seen += len(row) * (end - begin)
    # what is alive has all 64 coefficients; of equal ones the first is taken
    cluster = np.where(alive, part, bound[:, None] + 1).argmin(axis=1)
    return cluster, part[np.arange(n), cluster] // SIZE, seen


def usable(vectors: DataFrame, id_col: str, vec_col: str, size: int = SIZE) -> DataFrame:
    """(id, vec as doubles) of rows with ``size`` components exactly, none null, NaN or infinite; a null id is kept."""
    vec = F.col(vec_col).cast("array<double>")
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where((F.size("vec") == size) & ~bad)


def seed_hash(seed: int, ident: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), ident.cast("string")), 256)


def _integers(vec: np.ndarray, scale: int) -> np.ndarray:
    out = np.floor(vec * scale)
    if out.size and np.abs(out).max() >= 1 << 56:
        raise OverflowError(f"a component of {np.abs(vec).max()} is too large for exact 64-bit coefficients")
    return out.astype(np.int64)


def _rows(column: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, SIZE)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every row of ``vectors(id, vec)``.

    Components are ``floor(scale * x)``.  The ``k`` first centroids are the vectors with the smallest hashes of seed
    and id; equal ids follow their components, null ids come last.  Rows that repeat count each.  Fewer than ``k``
    vectors are as many centroids, none give no rows.  A component of 2^56 or more after scaling, or a distance or
    inertia that 64 bits can't hold, is an error rather than a wrong number.
    """
    spark = vectors.sparkSession

    def coefficients(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = transform(_integers(_rows(batch.column("vec")), scale))
            at = pa.array(np.arange(len(own) + 1, dtype=np.int32) * SIZE)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(at, pa.array(own.ravel()))], names=["id", "coef"])

    first = vectors.orderBy(F.asc_nulls_last(seed_hash(seed, F.col("id"))), "vec").limit(k).select("vec").collect()
    table = written(vectors.mapInArrow(coefficients, "id long, coef array<long>"))
    centroids = _integers(np.array([r["vec"] for r in first], float).reshape(len(first), SIZE), scale)

    def assigned(current: np.ndarray):
        """Rows of a batch with their clusters; ``current`` has at most k centroids."""

        def run(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
            for begin in range(0, batch.num_rows, ROWS):
                part = batch.slice(begin, ROWS)
                own = _rows(part.column("coef"))
                yield part, own, *nearest_centroids(own, current)[:2]

        return run

    matrix, order = _matrix(SIZE)
    back = matrix[order].T.astype(object)  # times the coefficients: the components, 64 times

    for _ in range(rounds if len(first) else 0):
        nearest = assigned(transform(centroids))

        def add(batches: Iterator[pa.RecordBatch], nearest=nearest) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, SIZE), object)
            number = np.zeros(k, np.int64)
            for batch in batches:
                for _, own, which, _ in nearest(batch):
                    for c in np.unique(which):
                        rows = own[which == c]
                        # halves of 32 bits each, so that no sum of a batch leaves 64 bits
                        total[c] += (rows >> 32).sum(axis=0).astype(object) * (1 << 32) + (rows & 0xFFFFFFFF).sum(axis=0).astype(object)
                        number[c] += len(rows)
            at = np.flatnonzero(number)
            cells = [(int(c), j, int(number[c]), Decimal(int(total[c][j]))) for c in at for j in range(SIZE)]
            yield pa.RecordBatch.from_pylist(
                [{"cluster": c, "place": j, "n": n, "total": t} for c, j, n, t in cells],
                schema=pa.schema([("cluster", pa.int32()), ("place", pa.int32()), ("n", pa.int64()), ("total", pa.decimal128(38, 0))]),
            )

        sums = table.mapInArrow(add, "cluster int, place int, n long, total decimal(38,0)")
        fresh = sums.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("total").cast("decimal(38,0)").alias("total"))
        totals: dict[int, list[int]] = {}
        number: dict[int, int] = {}
        for row in fresh.collect():  # 64 rows a cluster
            totals.setdefault(row["cluster"], [0] * SIZE)[row["place"]] = int(row["total"])
            number[row["cluster"]] = row["n"]
        for c, coefs in totals.items():
            components = back.dot(np.array(coefs, object)) // SIZE
            centroids[c] = [int(x) // number[c] for x in components]

    nearest = assigned(transform(centroids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, which, distance in nearest(batch):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(which.astype(np.int32)), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    final = written(table.mapInArrow(place, "vec_id long, cluster int, distance long"))
    discard(table)
    sums = {r["cluster"]: int(r["d"]) for r in final.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    rows = [(c, d, sum(sums.values()), sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sorted(sums.items())]
    described = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # at most k rows
    return final.join(F.broadcast(described), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def brute_force_clusters(vectors: list[list[int]], first: list[int], rounds: int = 10) -> tuple[list[int], list[int], list[list[int]]]:
    """Clusters, distances and centroids by plain loops over whole numbers: for tests."""
    centroids = [list(vectors[i]) for i in first]

    def near() -> list[tuple[int, int]]:
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for v in vectors]

    for _ in range(rounds):
        at = [j for _, j in near()]
        for j in range(len(centroids)):
            own = [v for v, c in zip(vectors, at, strict=True) if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = near()
    return [j for _, j in got], [d for d, _ in got], centroids


def _oracle(rounds: int = 10, k: int = 8, seed: int = 3, scale: int = 1024) -> str:
    """The same by plain distances in DuckDB, one common table a round."""
    integers = f"list_transform(embedding, lambda x: cast(floor(cast({scale} as double) * cast(x as double)) as bigint))"
    bad = "len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x)))"
    distance = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"x as materialized (select row_number() over () as r, vec_id, {integers} as v from embeddings where len(embedding) = {SIZE} and {bad} = 0)",
        f"c0 as materialized (select cast(row_number() over (order by h nulls last, v) - 1 as integer) as j, v as c from (select sha256('{seed}:' || vec_id) as h, v from x) order by h nulls last, v limit {k})",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} as materialized (select r, min(struct_pack(d := d, j := j)) as m from (select r, j, {distance} as d from x cross join c{i}) group by r)")
        if i < rounds:
            parts.append(f"s{i} as (select m.j as j, p, sum(v[p]) as s, count(*) as n from x join a{i} using (r), range(1, {SIZE + 1}) as g(p) group by all)")
            parts.append(f"n{i} as (select j, list((s - ((s % n) + n) % n) // n order by p) as c from s{i} group by j)")
            parts.append(f"c{i + 1} as materialized (select j, cast(coalesce(n{i}.c, c{i}.c) as bigint[]) as c from c{i} left join n{i} using (j))")
    last = f"a{rounds}"
    parts.append(f"f as (select vec_id, m.j as j, cast(m.d as bigint) as d from x join {last} using (r))")
    return (
        "with " + ",\n".join(parts) + f"""
select vec_id, j as cluster, d as distance, cast(sum(d) over (partition by j) as bigint) as cluster_inertia, cast(sum(d) over () as bigint) as inertia,
 sha256(array_to_string(c, ',')) as centroid_sha256 from f join c{rounds} using (j)"""
    )


ORACLE = _oracle()
