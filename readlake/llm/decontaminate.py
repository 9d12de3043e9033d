"""Benchmark passages inside documents: item-sized windows, SimHash, exact check.

A benchmark item of n words is looked for in windows of n words.  Its shingles are runs of ``shingle`` words (all its
words, if it has fewer); a window that shares none with any item has similarity 0, so only windows laid along a shared
shingle get a fingerprint.  Fingerprints are 64-bit SimHashes of the window's shingles, each weighted by how often it
comes.  The items' fingerprints are indexed by ``radius + 1`` bit blocks: two fingerprints at most ``radius`` bits
apart agree in one block at least, so the index finds all of them.  A candidate counts when its weighted Jaccard
similarity, sum of least over sum of largest shingle counts, is ``percent`` or more.

At similarity 0.8 the expected distance is 10 bits with deviation 3, so 21 bits pass all but about 1 in 20,000.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.shared import give_back
from readlake.llm.textkit import LOWER, U64, ragged, shingle_hashes, slices, span_hashes, text_bytes, word_spans

_FILTER_BITS = 22
HITS = "doc_id long, item_id long, start_word long, n_words long, similarity double"
#: Bytes of benchmark text in one index; a larger benchmark takes several passes over the documents.
INDEX_BYTES = 32 << 20


def simhash(shingles: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The SimHash of each run of ``shingles``; run i starts at ``begins[i]`` and none is empty."""
    if not len(begins):
        return np.zeros(0, U64)
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    return np.packbits(np.add.reduceat(bits, begins, axis=0) > 0, axis=1).view(U64).ravel()


def _block_bits(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of ``radius + 1`` blocks that cover 64 bits."""
    edges = np.linspace(0, 64, radius + 2).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]


@dataclass
class ItemIndex:
    """Items with the same shingle length, their shingles, fingerprints and the multi-index over them."""

    k: int
    ids: np.ndarray
    sizes: np.ndarray  # words
    shingles: list[np.ndarray]  # in order of place
    radius: int
    percent: int

    def __post_init__(self):
        n = np.array([len(s) for s in self.shingles])
        flat = np.concatenate(self.shingles)
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
        order = np.lexsort((place, owner, flat))
        self.keys, self.owner, self.place = flat[order], owner[order], place[order]
        self.prints = simhash(flat, np.cumsum(n) - n)
        self.filter = np.zeros(1 << _FILTER_BITS, bool)
        self.filter[(self.keys >> U64(64 - _FILTER_BITS)).astype(np.int64)] = True
        self.blocks = []
        for shift, width in _block_bits(self.radius):
            part = (self.prints >> U64(shift)) & U64((1 << width) - 1)
            by = np.argsort(part, kind="stable")
            self.blocks.append((shift, width, np.searchsorted(part[by], np.arange((1 << width) + 1)), by))

    def windows(self, words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, word count and row of every item-sized window along a shared shingle, and all shingles."""
        keys, first = shingle_hashes(words, rows, self.k)
        near = np.flatnonzero(self.filter[(keys >> U64(64 - _FILTER_BITS)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, keys[near]), np.searchsorted(self.keys, keys[near], "right")
        hit = ragged(lo, hi - lo)
        word = np.repeat(first[near], hi - lo)
        row = rows[word]
        count = np.bincount(rows, minlength=int(rows[-1]) + 1 if len(rows) else 0)
        begin = np.cumsum(count) - count
        size = self.sizes[self.owner[hit]]
        start = np.maximum(word - self.place[hit], begin[row])
        size = np.minimum(size, begin[row] + count[row] - start)
        got = np.unique(np.stack([start, size, row]), axis=1) if len(start) else np.zeros((3, 0), np.int64)
        all_keys = np.zeros(len(words), U64)
        all_keys[first] = keys
        return got[0], got[1], got[2], all_keys

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) pairs with fingerprints at most ``radius`` bits apart."""
        pairs = []
        for shift, width, starts, by in self.blocks:
            part = ((prints >> U64(shift)) & U64((1 << width) - 1)).astype(np.int64)
            n = starts[part + 1] - starts[part]
            window, item = np.repeat(np.arange(len(prints)), n), by[ragged(starts[part], n)]
            ok = np.bitwise_count(prints[window] ^ self.prints[item]) <= self.radius
            pairs.append(window[ok] * len(self.ids) + item[ok])
        both = np.unique(np.concatenate(pairs))
        return both // len(self.ids), both % len(self.ids)

    def find(self, words: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, int, int, float]]:
        """(row, item, first word, words, similarity), the best window of each row and item."""
        start, size, row, keys = self.windows(words, rows)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for at in range(0, len(start), 4096):
            s, n = start[at : at + 4096], size[at : at + 4096] - self.k + 1
            flat = keys[ragged(s, n)]
            begins = np.cumsum(n) - n
            window, item = self.near(simhash(flat, begins))
            alike = np.abs(n[window] - (self.sizes[item] - self.k + 1)) * 100 <= (100 - self.percent) * np.maximum(n[window], self.sizes[item])
            for w, i in zip(window[alike].tolist(), item[alike].tolist(), strict=True):
                a, b = flat[begins[w] : begins[w] + n[w]], self.shingles[i]
                if (same := weighted_jaccard(a, b)) * 100 >= self.percent:
                    key = (int(row[at + w]), i)
                    best[key] = max(best.get(key, (-1.0, 0, 0)), (same, -int(s[w]), int(size[at + w])))
        return [(r, int(self.ids[i]), -s, n, same) for (r, i), (same, s, n) in sorted(best.items())]


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of least over sum of largest counts of the two lists' values."""
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum())


def text_hashes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = LOWER[buf]
    starts, ends, rows = word_spans(low, offsets)
    return span_hashes(low, starts, ends), rows


def build_index(items: list[tuple[int, str]], shingle: int, percent: int, radius: int) -> list[ItemIndex]:
    """An index for each shingle length that the items need; items without words match nothing."""
    found: dict[int, list] = {}
    for item_id, text in items:
        words, rows = text_hashes(*text_bytes(pa.array([text], pa.string())))
        if len(words):
            k = min(shingle, len(words))
            found.setdefault(k, []).append((item_id, len(words), shingle_hashes(words, rows, k)[0]))
    return [ItemIndex(k, np.array([i for i, _, _ in own]), np.array([n for _, n, _ in own]), [s for _, _, s in own], radius, percent) for k, own in sorted(found.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80, radius: int = 21) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: each benchmark item found in a document, its best window.

    Of equal windows the first counts.  Null texts and ids of items match nothing; null and empty documents have no
    windows; rows that repeat report as often as they come.  The benchmark is a stated query set: it goes to the tasks
    in indexes over at most ``INDEX_BYTES`` of text each, one pass over the documents for each.
    """
    spark = docs.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(total) // INDEX_BYTES))
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    out = None
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) if passes > 1 else items
        index = spark.sparkContext.broadcast(build_index([tuple(r) for r in part.collect()], shingle, percent, radius))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                buf, offsets = text_bytes(batch.column("text"))
                for i, j in slices(offsets):
                    words, rows = text_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    first = np.searchsorted(rows, np.arange(j - i))
                    hits = [h for part in index.value for h in part.find(words, rows)]
                    ids = batch.column("doc_id").slice(i, j - i).to_pylist() if hits else []
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[h[0]] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64()), pa.array([h[2] - int(first[h[0]]) for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int64()), pa.array([h[4] for h in hits], pa.float64())],
                        names=["doc_id", "item_id", "start_word", "n_words", "similarity"],
                    )

        got = own.mapInArrow(scan, HITS)
        out = got if out is None else out.unionByName(got)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, percent: int = 80, radius: int = 21) -> DataFrame:
    """The rows of ``docs``, all columns as they are, in which no item was found.

    Rows are filtered where they are read: no join, whatever ids repeat or are null.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = max(1, -(-int(total) // INDEX_BYTES))
    for p in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p) if passes > 1 else items
        index = docs.sparkSession.sparkContext.broadcast(build_index([tuple(r) for r in part.collect()], shingle, percent, radius))

        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                buf, offsets = text_bytes(batch.column("text").cast(pa.string()))
                clean = np.ones(batch.num_rows, bool)
                for i, j in slices(offsets):
                    words, rows = text_hashes(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    for own in index.value:
                        for h in own.find(words, rows):
                            clean[i + int(h[0])] = False
                yield batch.filter(pa.array(clean))
            give_back()

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
