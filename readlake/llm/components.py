"""Connected components of a link table by star contraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.shared import discard, written

_CHUNK_EDGES = 1_000_000  # edges that a task contracts at once


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of these edges and the smallest node of what they connect, for every node but those."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, other, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(one):
        x, y = root[one], root[other]
        apart = x != y
        one, other = one[apart], other[apart]
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]
    below = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[below], nodes[root[below]]


def _in_tasks(ends: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Contracts the edges that ``ends`` makes of a task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if wait:
                u, v = contracted(*(np.concatenate(x) for x in zip(*wait, strict=True)))
                wait.clear()
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for batch in batches:
            wait.append(ends(batch))
            if sum(len(a) for a, _ in wait) > _CHUNK_EDGES:
                yield from flush()
        yield from flush()

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links(a, b)`` but the roots; a root is the smallest node of its component.

    Tasks contract the edges that they hold to stars.  A round takes each node's smallest neighbour (a minimum, summed
    before the shuffle), joins it to the edges, ties both ends of an edge to it and contracts again in the same tasks;
    no neighbour list is ever gathered.  Stars are done when every node has either larger neighbours alone or a single
    one.  Rounds grow with the logarithm of the longest chain, and each is written to the shared folder; loops and
    repeated links are harmless, no links give no rows.
    """
    numbers = lambda batch, *columns: (batch.column(c).to_numpy() for c in columns)

    def both_ends(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        u, v, m = numbers(batch, "u", "v", "m")
        return np.concatenate([u, v]), np.concatenate([m, m])

    edges = written(links.where("a <> b").select("a", "b").mapInArrow(_in_tasks(lambda batch: tuple(numbers(batch, "a", "b"))), "u long, v long"))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")))
        if low.where("m < u and m < most").isEmpty():
            discard(edges)
            return low.where("m < u").select(F.col("u").alias("node"), F.col("m").alias("root"))
        near = both.join(low.select("u", F.least("u", "m").alias("m")), "u").select("u", "v", "m")
        before, edges = edges, written(near.mapInArrow(_in_tasks(both_ends), "u long, v long"))
        for done in (before, low):
            discard(done)
