"""Centroid clustering against plain loops over whole numbers."""

import math
import random
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from readlake.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, cluster int, distance string"


def brute(rows, k=8, rounds=10):
    """The contract's rows from (vec_id, components) by loops."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, sha256(f"3:{kept[r][0]}".encode()).hexdigest(), kept[r][1]))
    if not kept:
        return []
    which, far, centers = centroids.brute_force_clusters([v for _, v in kept], hashed[:k], rounds)
    per = {c: sum(d for d, w in zip(far, which, strict=True) if w == c) for c in set(which)}
    name = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, per[c], sum(far), name[c]) for (i, _), c, d in zip(kept, which, far, strict=True)), key=str)


def run(spark, rows):
    table = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(centroids.usable(table, "vec_id", "embedding")).collect()), key=str)


def vectors(seed, n, spread=1.0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, 64)) * spread
    return [(i, (centers[i % 5] + rng.normal(size=64) * 0.2).tolist()) for i in range(n)]


def test_clusters_match_loops_on_messy_rows(spark):
    rows = vectors(1, 120)
    rows += [(200, rows[3][1]), (201, rows[3][1]), (7, rows[9][1]), (7, rows[7][1]), (7, rows[7][1])]  # ties, repeated ids and rows
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [float("nan")] * 64), (305, [float("-inf")] + [0.0] * 63), (306, [None] + [0.0] * 63)]
    rows += [(307, [0.0] * 64), (308, [-0.0] * 64), (309, [-1 / 4096] * 64), (None, rows[5][1])]
    assert run(spark, rows) == brute(rows)


def test_few_vectors_empty_clusters_and_none(spark):
    for rows in ([], vectors(2, 1), vectors(2, 5), [(i, [1.0] * 64) for i in range(20)]):
        assert run(spark, rows) == brute(rows)


def test_values_beyond_narrow_integers(spark):
    rows = [(i, [x * 3e5 for x in v]) for i, v in vectors(3, 30)]
    assert run(spark, rows) == brute(rows)
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30] * 64)])


def test_transform_is_exact_and_progressive_search_agrees():
    rng = random.Random(5)
    rows = np.array([[rng.randrange(-2000, 2000) for _ in range(64)] for _ in range(50)])
    coefs = centroids.transform(rows)
    assert ((coefs**2).sum(axis=1) == 64 * (rows**2).sum(axis=1)).all()
    smooth = np.cumsum(rows, axis=1) // 8
    for data in (rows, smooth, np.repeat(rows[:5], 4, axis=0)):
        centers = data[::7]
        which, far, seen = centroids.nearest_centroids(centroids.transform(data), centroids.transform(centers))
        plain = ((data[:, None] - centers[None]) ** 2).sum(axis=2)
        assert (which == plain.argmin(axis=1)).all() and (far == plain.min(axis=1)).all()
    # on smooth vectors most centroids go on their coarse coefficients
    assert centroids.nearest_centroids(centroids.transform(smooth), centroids.transform(smooth[::7]))[2] < 0.6 * 50 * 8 * 64


def test_oracle_counts_the_same(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    got = centroids.cluster(centroids.usable(spark.read.parquet(f"{sf}/embeddings.parquet"), "vec_id", "embedding"))
    cur = con.execute(centroids.ORACLE)
    assert [d[0] for d in cur.description] == got.columns
    assert sorted(cur.fetchall()) == sorted(map(tuple, got.collect()))
