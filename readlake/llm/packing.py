"""Best-fit packing of token pieces into sequences of bounded length.

Best-fit decreasing depends only on how many pieces there are of each length, so the search runs once, on a histogram
of at most ``max_tokens`` rows, for all documents together: open bins are counted by what they have left, a segment
tree over those capacities finds the tightest one that fits, and bins filled alike move as one range of ids.
The outcome is a table of rules (length, ranks) -> (bins, offset); every piece finds its place by its rank among the
pieces of its length.  No task, group or driver step sees the pieces of all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readlake.llm.encode import encoder
from readlake.llm.shared import give_back, written
from readlake.llm.textkit import binary_column, ragged, text_bytes

PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, local_rank long"
_RULES = "length long, rank_from long, rank_to long, per_bin long, bin_from long, fill long"


def token_pieces(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: each document's ids and ``end_id``, cut every ``max_tokens`` ids.

    ``ids`` holds little-endian unsigned 32-bit ids.  Null and empty texts give one piece with the end alone; rows
    that repeat are kept; null doc_ids stay null; other columns of ``docs`` are not read.
    ``part`` and ``local_rank`` number the pieces of a length within a task.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(max_tokens + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                ids, total = enc.encode_with_end(*text_bytes(rows.column("text")), end_id)
                pieces = -(-total // max_tokens)
                piece = ragged(np.zeros(len(total), np.int64), pieces)
                length = np.minimum(np.repeat(total, pieces) - piece * max_tokens, max_tokens)
                order = np.argsort(length, kind="stable")
                run = length[order]
                rank = np.empty(len(run), np.int64)
                rank[order] = np.arange(len(run)) - np.searchsorted(run, run) + seen[run]
                seen += np.bincount(length, minlength=max_tokens + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column("doc_id").take(pa.array(np.repeat(np.arange(len(total)), pieces))),
                        pa.array(piece.astype(np.int32)),
                        pa.array(piece * max_tokens),
                        pa.array(length),
                        binary_column(ids.astype("<u4").view(np.uint8), length * 4),
                        pa.array(np.full(len(length), part, np.int32)),
                        pa.array(rank),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "local_rank"],
                )
        give_back()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


class _Capacities:
    """Segment tree over remaining capacities; a leaf lists the ranges of bins that have that much left."""

    def __init__(self, top: int):
        self.size = 1 << max(1, top).bit_length()
        self.any = [False] * (2 * self.size)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def add(self, capacity: int, first: int, count: int) -> None:
        self.bins.setdefault(capacity, []).append((first, count))
        node = capacity + self.size
        while node and not self.any[node]:
            self.any[node] = True
            node //= 2

    def take(self, capacity: int) -> tuple[int, int]:
        got = self.bins[capacity].pop()
        if not self.bins[capacity]:
            node = capacity + self.size
            self.any[node] = False
            while node > 1:
                node //= 2
                self.any[node] = self.any[2 * node] or self.any[2 * node + 1]
        return got

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of ``need`` or more with an open bin."""
        node = need + self.size
        if self.any[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit_rules(counts: dict[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` pieces of each length.

    Rules (length, rank_from, rank_to exclusive, per_bin, bin_from, fill): the pieces of these ranks go to bins from
    ``bin_from`` on, ``per_bin`` to each, behind ``fill`` tokens.  A size opens or splits at most three ranges of
    bins and a range takes a size once, so the rules depend on ``max_tokens`` and not on the number of pieces.
    """
    tree, rules, bins = _Capacities(max_tokens), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]

        def put(first: int, count: int, capacity: int, per_bin: int) -> None:
            nonlocal rank, left
            rules.append((length, rank, rank + count * per_bin, per_bin, first, max_tokens - capacity))
            rank, left = rank + count * per_bin, left - count * per_bin
            if rest := capacity - per_bin * length:
                tree.add(rest, first, count)

        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = max_tokens, bins
                count = -(-left // (max_tokens // length))
                bins += count
            else:
                first, count = tree.take(capacity)
            fit = capacity // length
            full = min(count, left // fit)
            if full:
                put(first, full, capacity, fit)
            used = full
            if left and used < count:
                put(first + used, 1, capacity, left)
                used += 1
            if used < count:
                tree.add(capacity, first + used, count - used)
    return rules


def place(pieces: DataFrame, max_tokens: int = 2048) -> DataFrame:
    """``pieces`` (length, part, local_rank and more; a stored table) with sequence_id and offset.

    Two shuffles: the histogram, and the pieces' small columns on (part, length).  To the driver go at most
    ``max_tokens`` counts; back come the rules, whose number ``max_tokens`` bounds, so they are broadcast.
    An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rules = F.broadcast(spark.createDataFrame(best_fit_rules(counts, max_tokens), _RULES))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))
    on = (ranked["length"] == rules["length"]) & (ranked["rank"] >= rules["rank_from"]) & (ranked["rank"] < rules["rank_to"])
    within = F.col("rank") - F.col("rank_from")
    return (
        ranked.join(rules, on)
        .withColumn("sequence_id", F.col("bin_from") + F.expr("(rank - rank_from) div per_bin"))
        .withColumn("offset", F.col("fill") + within % F.col("per_bin") * ranked["length"])
        .drop(rules["length"])
        .drop("rank", "rank_from", "rank_to", "per_bin", "bin_from", "fill", "base", "part", "local_rank")
    )


def pack_documents(docs: DataFrame, tokenizer: str, max_tokens: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece with its ids and its place: doc_id, piece, start, length, ids, sequence_id, offset."""
    return place(written(token_pieces(docs, tokenizer, max_tokens, end_id)), max_tokens)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: sequence_id, n_tokens, ids.  A group is one bin, so its size is bounded."""
    inside = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(inside, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))
