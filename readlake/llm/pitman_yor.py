"""Language-model scores by a hierarchical Pitman-Yor model.

A text is its words, lower-cased (A-Z), and an end.  Words are customers of the restaurant of the word before them
(a start before the first); new tables there take their word from one restaurant of words, whose customers are the
tables of all contexts.  A new table there takes its word from a spelling model, and that writes a word byte by byte (a blank
closes it), every byte from the restaurant of the ``order - 1`` bytes before it.  A spelling restaurant of context u takes its new tables from that
of u without its oldest byte, so contexts with the same suffix share a parent, down to the empty context over a
uniform base.  Known words get what was counted, unseen ones what their spelling deserves.

Customers of a parent are tables below it.  Seating is sampled by Gibbs rounds: in each one all customers of every
dish leave and sit down again, in blocks where there are many; dishes move together within a round.  Predictive
weights are averaged over the rounds after the burn-in.

Contexts of three bytes or more that end in the same three bytes form a block, and blocks are sampled apart, in
tasks.  Contexts of two bytes or fewer (2^24 entries at the very most, whatever the corpus) are sampled on the driver.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readlake.llm.labelled import fold
from readlake.llm.shared import discard, giving_back, without_shuffles, written
from readlake.llm.textkit import LOWER, U64, binary_column, mix, ragged, slices, span_hashes, text_bytes, word_spans

#: Discount and strength of restaurants by context length.
DISCOUNTS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8)
STRENGTH = 1.0
_TOP = 2  # longest context sampled on the driver
_END = 1  # the end token's key among word hashes
_START = 2  # the key of the context before a text's first word
_HOT = 500_000  # most frequent pairs, at most, that go to every task
_BUCKET_TOKENS = 2_000_000  # training tokens a bucket of pairs, about
_COUNT_WORDS = 500_000  # different words of slices of text that a task gathers before it adds them up
_CHUNK_TOKENS = 1_000_000  # tokens that a task gathers before it deals them over the buckets
_SPAN = 1 << 18  # places of the lexicon whose sums are a row
_RANGE_WORDS = 1_200_000  # words of a range of a lexicon that no array holds, at most; a cell has two
_SEED = 0x9E3779B97F4A7C15


def text_tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; start, end, row and key of every word."""
    low = LOWER[buf]
    starts, ends, rows = word_spans(low, offsets)
    return low, starts, ends, rows, span_hashes(low, starts, ends).view(np.int64)


def spelling_grams(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram key (``order`` bytes, the newest lowest) and row of every byte written for the rows' words.

    A word is its bytes and a blank, the end token its newline alone; newlines stand before a word's first byte.
    """
    size, pad = np.diff(offsets), order - 1
    total = pad + size + 1
    stream = np.full(int(total.sum()), 0x0A, np.uint8)
    begin = np.cumsum(total) - total + pad
    stream[ragged(begin, size)] = buf
    is_end = (size == 1) & (buf[np.minimum(offsets[:-1], len(buf) - 1)] == 0x0A) if len(buf) else np.zeros(len(size), bool)
    stream[begin + size] = 0x20
    size = size + np.where(is_end, 0, 1)
    own = ragged(begin, size)
    wide = stream.astype(np.int64)
    key = np.zeros(len(own), np.int64)
    for back in range(pad, -1, -1):
        key = key << 8 | wide[own - back]
    return key, np.repeat(np.arange(len(size)), size)


def _uniform(keys: np.ndarray, seed: int) -> np.ndarray:
    """A number in (0, 1) for each key, the same in every run, plan and partitioning."""
    bits = mix(keys.astype(np.int64).view(U64) ^ mix(np.array([seed], U64) * U64(_SEED)))
    return ((bits >> U64(11)).astype(float) + 0.5) / (1 << 53)


def _successes(m: np.ndarray, p: np.ndarray, keys: np.ndarray, seed: int) -> np.ndarray:
    """Binomial draws: by inversion where few are expected, else by the normal limit."""
    u, out = _uniform(keys, seed), np.zeros(len(m), np.int64)
    one = m == 1
    out[one] = u[one] < p[one]
    many = ~one & (m * p * (1 - p) > 25)
    if many.any():
        z = np.sqrt(-2 * np.log(u[many])) * np.cos(2 * np.pi * _uniform(keys[many], ~seed & 0xFFFFFFFF))
        mean = m[many] * p[many]
        out[many] = np.clip(np.rint(mean + z * np.sqrt(mean * (1 - p[many]))), 0, m[many])
    left = np.flatnonzero(~one & ~many)
    flip = p[left] > 0.5
    q, size, rest = np.where(flip, 1 - p[left], p[left]), m[left].astype(float), u[left].copy()
    mass, got = np.exp(size * np.log1p(-q)), np.zeros(len(left), np.int64)
    open_ = np.arange(len(left))
    while len(open_ := open_[(rest[open_] >= mass[open_]) & (got[open_] < size[open_])]):
        rest[open_] -= mass[open_]
        mass[open_] *= (size[open_] - got[open_]) / (got[open_] + 1) * q[open_] / (1 - q[open_])
        got[open_] += 1
    out[left] = np.where(flip, m[left] - got, got)
    return out


def reseat(n: np.ndarray, parent: np.ndarray, elsewhere: np.ndarray, discount: float, keys: np.ndarray, seed: int) -> np.ndarray:
    """Tables of each dish after all its ``n`` customers left and sat down again.

    ``elsewhere`` is the number of tables that the restaurant has for other dishes.  Customers sit down one by one
    while there are few, then in blocks of an eighth of those seated: in a block the chance of a new table is that of its middle.
    """
    t = np.minimum(n, 1).astype(np.int64)
    live = np.flatnonzero(n > 1)
    seated, size, base, others, own, tables, step = np.ones(len(live), np.int64), n[live], parent[live], elsewhere[live], keys[live], np.ones(len(live), np.int64), 0
    while len(live):
        block = np.minimum(np.maximum(seated // 8, 1), size - seated)
        new = (STRENGTH + discount * (others + tables)) * base
        middle = seated + (block - 1) / 2
        tables = tables + _successes(block, new / (new + middle - discount * tables), own, seed * 4096 + step)
        seated, step = seated + block, step + 1
        done = seated == size
        if done.any():
            t[live[done]] = tables[done]
            live, seated, size, base, others, own, tables = (x[~done] for x in (live, seated, size, base, others, own, tables))
    return t


class _Level:
    """The restaurants of one context length."""

    def __init__(self, keys: np.ndarray, customers: np.ndarray, depth: int):
        self.keys, self.c, self.depth = keys, customers.astype(np.int64), depth
        self.contexts, self.house = np.unique(keys >> 8, return_inverse=True)
        self.t = np.minimum(self.c, 1)
        self.discount = DISCOUNTS[depth]
        self.alpha, self.gamma, self.samples = np.zeros(len(keys)), np.zeros(len(self.contexts)), 0

    def tables(self) -> np.ndarray:
        return np.bincount(self.house, self.t, len(self.contexts))

    def reseat(self, parent: np.ndarray, seed: int) -> None:
        self.t = reseat(self.c, parent, self.tables()[self.house] - self.t, self.discount, self.keys, seed * 16 + self.depth)

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        """alpha of each dish and gamma of each context: P(w | u) = alpha + gamma P(w | parent)."""
        full = STRENGTH + np.bincount(self.house, self.c, len(self.contexts))
        return (self.c - self.discount * self.t) / full[self.house], (STRENGTH + self.discount * self.tables()) / full

    def keep(self) -> None:
        a, g = self.weights()
        self.alpha, self.gamma, self.samples = self.alpha + a, self.gamma + g, self.samples + 1


class Restaurants:
    """All levels above ``floor``: counts of the longest n-grams come in, the base for the shortest from outside."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, floor: int):
        self.levels, self.up = [_Level(keys, counts, depth)], []
        while depth > floor:
            depth -= 1
            short = keys & ((1 << 8 * (depth + 1)) - 1)
            keys, parent = np.unique(short, return_inverse=True)
            self.up.append(parent)
            self.levels.append(_Level(keys, np.bincount(parent, minlength=len(keys)), depth))

    def _parents(self, base: np.ndarray, averaged: bool = False) -> list[np.ndarray]:
        """For each level the parent's probability of every dish."""
        out = [base]
        for level, up in zip(self.levels[:0:-1], self.up[::-1], strict=True):
            a, g = (level.alpha / level.samples, level.gamma / level.samples) if averaged else level.weights()
            out.append((a + g[level.house] * out[-1])[up])
        return out[::-1]

    def sample(self, base: np.ndarray, rounds: int, burn_in: int) -> None:
        for r in range(rounds):
            parents = self._parents(base)
            for k, level in enumerate(self.levels):
                if k:
                    level.c = np.bincount(self.up[k - 1], self.levels[k - 1].t, len(level.keys)).astype(np.int64)
                level.reseat(parents[k], r)
            if r >= burn_in:
                for level in self.levels:
                    level.keep()

    def model(self, base: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(depth, dish keys, their probability, contexts, their gamma) of every level."""
        for level, parent in zip(self.levels, self._parents(base, averaged=True), strict=True):
            a, g = level.alpha / level.samples, level.gamma / level.samples
            yield level.depth, level.keys, a + g[level.house] * parent, level.contexts, g


@dataclass
class Tables:
    """Sorted arrays for each context length: dishes with probabilities, contexts with back-off weights."""

    order: int
    dishes: dict[int, tuple[np.ndarray, np.ndarray]]
    contexts: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def _get(table: tuple[np.ndarray, np.ndarray] | None, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if table is None or not len(table[0]):
            return np.zeros(len(wanted), bool), np.ones(len(wanted))
        at = np.minimum(np.searchsorted(table[0], wanted), len(table[0]) - 1)
        return table[0][at] == wanted, table[1][at]

    def probability(self, keys: np.ndarray, depth: int | None = None) -> np.ndarray:
        """P(last byte | up to ``depth`` bytes before it) for n-gram keys."""
        out, factor, open_ = np.zeros(len(keys)), np.ones(len(keys)), np.arange(len(keys))
        for d in range(self.order - 1 if depth is None else depth, -1, -1):
            part = keys[open_] & ((1 << 8 * (d + 1)) - 1)
            hit, p = self._get(self.dishes.get(d), part)
            out[open_[hit]] = factor[open_[hit]] * p[hit]
            open_, part = open_[~hit], part[~hit]
            known, g = self._get(self.contexts.get(d), part >> 8)
            factor[open_[known]] *= g[known]
        out[open_] = factor[open_] / 256
        return out


def _summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    codes, unique = pd.factorize(keys)
    return unique, np.bincount(codes, counts, len(unique)).astype(np.int64)


def word_counts(docs: DataFrame, learn: Column) -> DataFrame:
    """(word, n): every token of the texts and how often rows where ``learn`` holds have it; the end is a newline.

    A task sums its own words before the shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[tuple[np.ndarray, ...]] = []
        ends_seen = [0, 0]  # texts, learned ones

        def summed(low: np.ndarray, starts: np.ndarray, size: np.ndarray, keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
            """Bytes of the different words one after another, and their sizes, keys and sums of ``n``."""
            codes, unique = pd.factorize(keys)
            first = np.empty(len(unique), np.int64)
            first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            return low[ragged(starts[first], size[first])], size[first], unique, np.bincount(codes, n, len(unique)).astype(np.int64)

        def flush() -> Iterator[pa.RecordBatch]:
            if not wait:
                return
            low, size, keys, n = (np.concatenate(x) for x in zip(*wait, strict=True))
            wait.clear()
            low, size, _, n = summed(low, np.cumsum(size) - size, size, keys, n)
            yield pa.RecordBatch.from_arrays([binary_column(low, size), pa.array(n)], names=["word", "n"])

        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            learns = batch.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            ends_seen[0], ends_seen[1] = ends_seen[0] + len(learns), ends_seen[1] + int(learns.sum())
            for i, j in slices(offsets):
                low, starts, ends, rows, keys = text_tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                wait.append(summed(low, starts, ends - starts, keys, learns[i:j][rows]))
                if sum(len(w[1]) for w in wait) > _COUNT_WORDS:
                    yield from flush()
        yield from flush()
        if ends_seen[0]:
            yield pa.RecordBatch.from_arrays([pa.array([b"\n"], pa.binary()), pa.array([ends_seen[1]], pa.int64())], names=["word", "n"])

    rows = docs.select("text", F.coalesce(learn, F.lit(False)).alias("learn"))
    return rows.mapInArrow(giving_back(count), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def gram_counts(words: DataFrame, order: int) -> DataFrame:
    """(key, n): the n-grams of the spellings, each word once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait, waiting = [], 0
        for batch in batches:
            key, n = _summed(spelling_grams(*text_bytes(batch.column("word")), order)[0])
            wait.append((key, n))
            waiting += len(key)
            if waiting > 2_000_000:
                wait = [_summed(np.concatenate([k for k, _ in wait]), np.concatenate([n for _, n in wait]))]
                waiting = len(wait[0][0])
                if waiting > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(wait[0][0]), pa.array(wait[0][1])], names=["key", "n"])
                    wait, waiting = [], 0
        if wait:
            key, n = _summed(np.concatenate([k for k, _ in wait]), np.concatenate([n for _, n in wait]))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])

    return words.select("word").mapInArrow(giving_back(count), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def fit_spelling(grams: DataFrame, order: int, rounds: int = 12, burn_in: int = 4) -> tuple[DataFrame, Tables]:
    """The spelling model: a table (depth, is_context, key, value) of contexts over ``_TOP`` bytes, and the shorter ones."""
    spark = grams.sparkSession
    mask = (1 << 8 * (_TOP + 2)) - 1
    shorter = grams.select(F.col("key").bitwiseAND(mask).alias("key")).distinct().groupBy(F.col("key").bitwiseAND(mask >> 8).alias("key")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    keys, n = shorter.column("key").to_numpy().astype(np.int64), shorter.column("n").to_numpy().astype(np.int64)
    by = np.argsort(keys)
    top = Tables(order, {}, {})
    if len(keys):
        rooms = Restaurants(keys[by], n[by], _TOP, 0)
        base = np.full(len(rooms.levels[-1].keys), 1 / 256)
        rooms.sample(base, rounds, burn_in)
        for depth, dishes, p, contexts, g in rooms.model(base):
            top.dishes[depth], top.contexts[depth] = (dishes, p), (contexts, g)
    shared = spark.sparkContext.broadcast(top)

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Runs of whole blocks, about half a million n-grams each."""
            kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for batch in batches:
                kept.append(tuple(batch.column(c).to_numpy() for c in ("block", "key", "n")))
                if sum(len(k[0]) for k in kept) > 500_000:
                    block, key, n = (np.concatenate(x) for x in zip(*kept, strict=True))
                    cut = int(np.searchsorted(block, block[-1]))
                    if cut:
                        yield key[:cut], n[:cut]
                    kept = [(block[cut:], key[cut:], n[cut:])]
            if kept:
                yield np.concatenate([k[1] for k in kept]), np.concatenate([k[2] for k in kept])

        for key, n in blocks():
            if not len(key):
                continue
            by = np.argsort(key)
            rooms = Restaurants(key[by], n[by], order - 1, _TOP + 1)
            base = shared.value.probability(rooms.levels[-1].keys, _TOP)
            rooms.sample(base, rounds, burn_in)
            for depth, dishes, p, contexts, g in rooms.model(base):
                for is_context, k, v in ((False, dishes, p), (True, contexts, g)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), depth, np.int8)), pa.array(np.full(len(k), is_context)), pa.array(k), pa.array(v)], names=["depth", "is_context", "key", "value"])

    block = F.shiftright("key", 8).bitwiseAND((1 << 8 * (_TOP + 1)) - 1)
    dealt = grams.select(block.alias("block"), "key", "n").repartition("block").sortWithinPartitions("block", "key")
    return written(dealt.mapInArrow(giving_back(seat), "depth tinyint, is_context boolean, key long, value double")), top


def _in_arrays(model: DataFrame, top: Tables) -> Tables:
    got = model.toArrow()
    depth, is_context, key, value = (got.column(c).to_numpy() for c in ("depth", "is_context", "key", "value"))
    del got
    out = Tables(top.order, dict(top.dishes), dict(top.contexts))
    for d in np.unique(depth):
        for flag, into in ((False, out.dishes), (True, out.contexts)):
            own = (depth == d) & (is_context == flag)
            by = np.argsort(key[own])
            into[int(d)] = (key[own][by], value[own][by])
    del depth, is_context, key, value
    pa.default_memory_pool().release_unused()
    return out


def _spelled_in_tasks(words: DataFrame, shared: Broadcast, keyed: bool = False) -> DataFrame:
    """``words`` with ``spelled``, the natural logarithm of the spelling's probability; ``keyed``: as ``_keyed`` has them.

    One Python worker of a task does both: with two, an executor would keep twice the workers to the end of the job.
    """

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column("word"))
            for i, j in slices(offsets, 1 << 18):
                keys, rows = spelling_grams(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], shared.value.order)
                codes, unique = pd.factorize(keys)
                logs = np.log(shared.value.probability(unique))[codes]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in ("word", "n")] + [pa.array(np.bincount(rows, logs, j - i))], names=["word", "n", "spelled"])

    if keyed:
        return words.mapInArrow(giving_back(lambda batches: _by_key(spell(batches))), _KEYED)
    return words.mapInArrow(giving_back(spell), "word binary, n long, spelled double")


def _spelled_by_join(words: DataFrame, model: DataFrame, top: Tables) -> DataFrame:
    """(key, n, spelled) by joins with the model's table, of any size: every n-gram takes its probability once, and
    words are two numbers for each of theirs."""
    order, shared = top.order, words.sparkSession.sparkContext.broadcast(top)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(shared.value.probability(batch.column("key").to_numpy(), _TOP))], names=["gram", "short"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column("word"))
            key, n = _word_keys(buf, offsets), batch.column("n").to_numpy()
            for i, j in slices(offsets, 1 << 18):
                grams, rows = spelling_grams(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], order)
                yield pa.RecordBatch.from_arrays([pa.array(key[i:j][rows]), pa.array(n[i:j][rows]), pa.array(grams)], names=["key", "n", "gram"])

    grams, p = gram_counts(words, order).select("key").mapInArrow(giving_back(short), "gram long, short double"), F.col("short")
    for depth in range(_TOP + 1, order):
        at = model.where(F.col("depth") == depth)
        grams = grams.withColumn("part", F.col("gram").bitwiseAND((1 << 8 * (depth + 1)) - 1)).withColumn("rest", F.shiftright("part", 8))
        grams = grams.join(at.where("not is_context").select(F.col("key").alias("part"), F.col("value").alias(f"p{depth}")), "part", "left")
        grams = grams.join(at.where("is_context").select(F.col("key").alias("rest"), F.col("value").alias(f"g{depth}")), "rest", "left").drop("part", "rest")
        p = F.coalesce(F.col(f"p{depth}"), F.coalesce(F.col(f"g{depth}"), F.lit(1.0)) * p)
    logs = written(grams.select("gram", F.log(p).alias("log")))
    return words.select("word", "n").mapInArrow(giving_back(parts), "key long, n long, gram long").join(logs, "gram").groupBy("key", "n").agg(F.sum("log").alias("spelled"))


_KEYED = "key long, n long, spelled double"


def _word_keys(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    key = span_hashes(buf, offsets[:-1], offsets[1:]).view(np.int64)
    is_end = np.diff(offsets) == 1
    is_end[is_end] = buf[offsets[:-1][is_end]] == 0x0A
    return np.where(is_end, _END, key)


def _by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_word_keys(*text_bytes(part.column("word")))), part.column("n"), part.column("spelled")], names=["key", "n", "spelled"])


def _keyed(spelled: DataFrame) -> DataFrame:
    """(key, n, spelled): words by their hash."""
    return spelled.select("word", "n", "spelled").mapInArrow(giving_back(_by_key), _KEYED)


def lexicon(spelled: DataFrame, total: int, kinds: int, discount: float, rounds: int = 12, burn_in: int = 4) -> tuple[DataFrame, float]:
    """(key, n, open_value), the log10 probability of every word in the word restaurant over spellings; and that of
    all unknown spellings together, the score of an unknown word over the outcomes that the add-one base has.
    """
    return _seated(written(_keyed(spelled)), total, kinds, discount, rounds, burn_in)


def _seated(named: DataFrame, total: int, kinds: int, discount: float, rounds: int = 12, burn_in: int = 4) -> tuple[DataFrame, float]:
    """``lexicon`` of (key, n, spelled).  A round reseats all customers of every word; the number of tables in the
    whole restaurant is summed over the tasks and goes into the next round.  A word's draws depend on its key, the
    round and those sums alone, so a task plays earlier rounds again in place of storing them.
    """

    def replay(n: np.ndarray, spelled: np.ndarray, key: np.ndarray, sums: list[int]) -> Iterator[np.ndarray]:
        t, parent = np.minimum(n, 1), np.exp(spelled)
        several = np.flatnonzero(n > 1)
        for r, s in enumerate(sums):
            t = t.copy()
            t[several] = reseat(n[several], parent[several], s - t[several], discount, key[several], r)
            yield t

    def count(batches: Iterator[pa.RecordBatch], sums: list[int]) -> Iterator[pa.RecordBatch]:
        for n, spelled, key in _runs(batches, ("n", "spelled", "key")):
            *_, t = replay(n, spelled, key, sums)
            yield pa.RecordBatch.from_arrays([pa.array([int(t.sum())])], names=["t"])

    def seat(batches: Iterator[pa.RecordBatch], sums: list[int]) -> Iterator[pa.RecordBatch]:
        for n, spelled, key in _runs(batches, ("n", "spelled", "key")):
            kept = np.zeros(len(n))
            for r, t in enumerate(replay(n, spelled, key, sums)):
                if r >= burn_in:
                    kept += t
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n), pa.array(kept / (rounds - burn_in)), pa.array(spelled)], names=["key", "n", "tables", "spelled"])

    sums = [kinds]
    for _ in range(rounds - 1):
        more = named.where("n > 1").mapInArrow(lambda batches, sums=tuple(sums): count(batches, sums), "t long").agg(F.coalesce(F.sum("t"), F.lit(0))).first()[0]
        if len(sums) == 1:
            once = named.where("n = 1").count()
        sums.append(int(more) + once)
    seated = written(named.mapInArrow(giving_back(lambda batches: seat(batches, sums)), "key long, n long, tables double, spelled double"))
    got = seated.agg(F.coalesce(F.sum("tables"), F.lit(0.0)), F.coalesce(F.sum(F.when(F.col("n") > 0, F.exp("spelled"))), F.lit(0.0))).first()
    new = (STRENGTH + discount * float(got[0])) / (STRENGTH + total)
    exact = F.log10((F.col("n") - discount * F.col("tables")) / (STRENGTH + total) + new * F.exp("spelled"))
    unknown = float(np.log10(new * max(1.0 - float(got[1]), 1e-12)))
    book = seated.select("key", "n", exact.alias("open_value"))
    book.written_to = seated.written_to
    return book, unknown


def _runs(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...], least: int = 300_000) -> Iterator[list[np.ndarray]]:
    """Columns as arrays of ``least`` rows or more, but for the last."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= least:
            yield [np.concatenate([b.column(c).to_numpy() for b in kept]) for c in columns]
            kept = []
    if kept:
        yield [np.concatenate([b.column(c).to_numpy() for b in kept]) for c in columns]


def _previous(tokens: np.ndarray, rows: np.ndarray, n_rows: int, start: int) -> np.ndarray:
    """The token before each, for words in order with the rows' ends behind all of them (see ``_tokens``)."""
    n = len(tokens) - n_rows
    out = np.full(len(tokens), start, np.int64)
    same = np.flatnonzero(rows[1:n] == rows[: n - 1]) if n > 1 else np.zeros(0, np.int64)
    out[same + 1] = tokens[same]
    last = np.flatnonzero(np.append(rows[1:n] != rows[: n - 1], True)) if n else np.zeros(0, np.int64)
    out[n + rows[last]] = tokens[last]
    return out


def _pair_hash(prev: np.ndarray, key: np.ndarray) -> np.ndarray:
    return (mix(prev.view(U64) * U64(_SEED)) ^ key.view(U64)).view(np.int64)


def _numbered(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    codes, unique = pd.factorize(keys)
    return np.searchsorted(known, unique)[codes]


def _discount(once: int, twice: int) -> float:
    return min(max(once / max(once + 2 * twice, 1), 0.1), 0.95)


def _packed(x: np.ndarray) -> bytes:
    """Integers as compressed bytes, byte by byte of their size: small or like numbers take little room."""
    planes = np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T)
    return len(x).to_bytes(8, "little") + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def _unpacked(blob: bytes) -> np.ndarray:
    size = int.from_bytes(blob[:8], "little")
    if not size:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(blob[8:], decompressed_size=size * 8, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, size).T).view("<i8").ravel()


def _rows_of(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield tuple(batch.column(c)[k].as_py() for c in columns)


_BLOCK = "bucket int, kind int, pairs binary, n binary, more binary"


def _block(bucket: int, kind: int, pairs: np.ndarray, n: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """A bucket's sorted pairs with a number each, and more numbers (as many as the sum of ``n`` for questions)."""
    values = [[bucket], [kind], [_packed(np.diff(pairs, prepend=0))], [_packed(n)], [_packed(more)]]
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["bucket", "kind", "pairs", "n", "more"])


def _buckets_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    return ((mix(pairs.view(U64)) >> U64(33)) % U64(buckets)).astype(np.int32)


_ASKED = "cell int, bucket int, kind int, chunk long, pairs binary, n binary, more binary"
_SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double, open_score double"


def _row(types: str, *values) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    names, forms = zip(*(c.split() for c in types.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array([v], kinds[f]) for v, f in zip(values, forms, strict=True)], names=list(names))


class _Chunk:
    """Texts one after another with the sums that a task has itself, and the pairs that they ask of buckets.

    A row of kind 3 is a chunk's texts.  One of kind 2 is what it asks of a bucket: pairs, how often each comes, and in which of its texts;
    answers (kind 5) name texts by their numbers as well.  A chunk's name is a hash of its texts, so chunks of one name
    have equal sums; their answers add up together and are divided again.
    """

    def __init__(self, home, buckets: int, cell):
        self.home, self.buckets, self.cell = home, buckets, cell
        self.texts, self.asked, self.rows = [], [], 0

    def add(self, ids: pa.Array, names: np.ndarray, sums: tuple[np.ndarray, ...], pair: np.ndarray, row: np.ndarray) -> Iterator[pa.RecordBatch]:
        null = ids.is_null().to_numpy(zero_copy_only=False)
        self.texts.append((names.copy(), ids.fill_null(0).to_numpy().copy(), null, *sums))
        self.asked.append((pair, row + self.rows))
        self.rows += len(names)
        if sum(len(p) for p, _ in self.asked) > _CHUNK_TOKENS or self.rows > _CHUNK_TOKENS // 4:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        names, ids, null, tokens, known, *sums = (np.concatenate(x) for x in zip(*self.texts, strict=True))
        pair, row = (np.concatenate(x) for x in zip(*self.asked, strict=True))
        self.texts, self.asked, self.rows = [], [], 0
        chunk = int(mix(mix(names.view(U64) ^ mix(np.arange(len(names), dtype=U64))).sum(keepdims=True)).view(np.int64)[0])
        home = chunk % self.buckets
        yield _row(_ASKED, self.cell(home), home, 3, chunk, _packed(ids), _packed(np.concatenate([null, tokens, known])), np.concatenate(sums).tobytes())
        by = np.argsort(pair)
        pair, row = pair[by], row[by]
        home = self.home(pair)
        by = np.argsort(home.astype(np.uint16) if self.buckets < 65536 else home, kind="stable")
        pair, row, edges = pair[by], row[by], np.searchsorted(home[by], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            own = pair[edges[b] : edges[b + 1]]
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            yield _row(_ASKED, self.cell(b), b, 2, chunk, _packed(np.diff(own[first], prepend=0)), _packed(np.diff(np.append(first, len(own)))), _packed(row[edges[b] : edges[b + 1]]))


def _answer(cell: int, bucket: int, chunk: int, lifted: np.ndarray, lift: np.ndarray, whole: tuple[np.ndarray, ...] | None = None) -> pa.RecordBatch:
    """What a bucket adds to a chunk's texts: numbers and sums of lifts; and of words that are scored in the bucket
    altogether the numbers of texts, the known ones, and sums for the three scores."""
    rows, known, *sums = whole or (lifted[:0],) * 5
    return _row(_ASKED, cell, bucket, 5, chunk, None, _packed(np.concatenate([[len(lifted)], lifted, rows, known])), np.concatenate([lift, *sums]).astype(float).tobytes())


def _assembled(answers: DataFrame) -> DataFrame:
    """Texts with their scores, from the rows of kinds 3 and 5."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, own in itertools.groupby(_rows_of(batches, ("chunk", "kind", "pairs", "n", "more")), lambda r: r[0]):
            copies, texts, more = 0, None, None
            for _, kind, pairs, n, sums in own:
                if kind == 3:
                    copies, texts = copies + 1, (pairs, n, sums)
                    continue
                if more is None:
                    size = int.from_bytes(texts[0][:8], "little")
                    more = np.zeros((4, size))
                n, x = _unpacked(n), np.frombuffer(sums)
                k = int(n[0])
                for at in (2, 3):
                    more[at][n[1 : k + 1]] += x[:k]
                rest = n[k + 1 :].reshape(2, -1)
                for at, y in zip(range(4), (rest[1], *x[k:].reshape(3, -1)), strict=True):
                    more[at][rest[0]] += y
            ids, (null, tokens, known), scores = _unpacked(texts[0]), _unpacked(texts[1]).reshape(3, -1), np.frombuffer(texts[2]).reshape(3, -1)
            if more is not None:
                more /= copies
                known, scores = known + np.rint(more[0]).astype(np.int64), scores + more[1:]
            for _ in range(copies):
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null.astype(bool)), pa.array(tokens), pa.array(known), *map(pa.array, scores)], names=[c.split()[0] for c in _SCORED.split(", ")])

    return answers.select("chunk", "kind", "pairs", "n", "more").repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(giving_back(add), _SCORED)


class WordPairs:
    """The restaurants of words in the context of the word before them, over places in the sorted lexicon ``known``.

    A pair is ``previous place << 32 | place`` and lives in a bucket by its hash, so that no word and no context, however
    frequent, meets in one task.  A bucket is one row: its pairs and counts; the seats of pairs counted twice or more
    are rows of their own, written anew in each pass.  What a pass needs of other buckets, the words' probabilities
    and the contexts' tables, goes to the tasks in arrays as long as the lexicon.
    """

    def __init__(self, docs: DataFrame, learn: Column, named: DataFrame, total: int):
        known = np.sort(named.select("key").toArrow().column("key").to_numpy())
        self.named, self.known, self.size = named, self._share(docs, known), len(known) + 1
        del known
        self.buckets = max(48, total // _BUCKET_TOKENS)
        self.blocks = self._count(docs.where(F.coalesce(learn, F.lit(False))).select("text"))
        self.tables, self.contexts, self.customers = self._sums(self.blocks, lambda n, more: np.ones(len(n), np.int64), customers=True)
        sizes = self._histogram().agg(F.sum(F.when(F.col("n") == 1, F.col("kinds"))), F.sum(F.when(F.col("n") == 2, F.col("kinds")))).first()
        self.discount, self.seats, self.extra = _discount(*(int(x or 0) for x in sizes)), None, None

    @staticmethod
    def _share(docs: DataFrame, value) -> Broadcast:
        return docs.sparkSession.sparkContext.broadcast(value)

    def _array(self, rows: DataFrame, value: str, kind: str) -> np.ndarray:
        """A column at the places of its rows, in four bytes each if they hold its whole numbers; 0 elsewhere."""
        if kind == "long" and (rows.agg(F.max(value)).first()[0] or 0) < 1 << 31:
            kind = "int"
        got = rows.select("place", F.col(value).cast(kind)).toArrow()
        out = np.zeros(self.size, {"int": np.int32, "long": np.int64, "float": np.float32, "double": np.float64}[kind])
        out[got.column("place").to_numpy()] = got.column(value).to_numpy()
        del got
        pa.default_memory_pool().release_unused()
        return out

    def by_place(self, rows: DataFrame, value: str, kind: str) -> np.ndarray:
        """A column of the lexicon's rows at their places."""
        known = self.known

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(known.value, batch.column("key").to_numpy()).astype(np.int32)), batch.column("value")], names=["place", "value"])

        return self._array(rows.select("key", F.col(value).cast(kind).alias("value")).mapInArrow(add, f"place int, value {kind}"), "value", kind)

    def _count(self, texts: DataFrame) -> DataFrame:
        known, buckets = self.known, self.buckets

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wait: list[np.ndarray] = []

            def flush() -> Iterator[pa.RecordBatch]:
                if wait:
                    pairs, n = np.unique(np.concatenate(wait), return_counts=True)
                    wait.clear()
                    home = _buckets_of(pairs, buckets)
                    by = np.argsort(home, kind="stable")
                    edges = np.searchsorted(home[by], np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(edges)).tolist():
                        own = by[edges[b] : edges[b + 1]]
                        yield _block(b, 0, pairs[own], n[own], n[:0])

            for batch in batches:
                buf, offsets = text_bytes(batch.column("text"))
                for i, j in slices(offsets):
                    keys, rows = _tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    word = _numbered(keys, known.value)
                    wait.append(_previous(word, rows, j - i, len(known.value)) << 32 | word)
                    if sum(map(len, wait)) > _CHUNK_TOKENS:
                        yield from flush()
            yield from flush()

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for bucket, rows in itertools.groupby(_rows_of(batches, ("bucket", "pairs", "n")), lambda r: r[0]):
                parts = [(np.cumsum(_unpacked(p)), _unpacked(n)) for _, p, n in rows]
                pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in parts]), len(pairs)).astype(np.int64)
                yield _block(bucket, 0, pairs, n, n[:0])

        return written(texts.mapInArrow(giving_back(count), _BLOCK).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(giving_back(merge), _BLOCK), "uncompressed")

    def _sums(self, rows: DataFrame, tables, customers: bool = False) -> list[np.ndarray]:
        """Sums over the pairs of each context and of each word of ``tables`` of n and more; and of n for each context.

        A task adds up its buckets in arrays as long as the lexicon, and spans of them are added up in turn: a row for
        each task and span in place of one for each pair.
        """
        size, kinds = self.size, 2 + customers

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for pairs, n, more in _rows_of(batches, ("pairs", "n", "more")):
                pairs, n = np.cumsum(_unpacked(pairs)), _unpacked(n)
                t = tables(n, _unpacked(more))
                sums = np.zeros((kinds, size), np.int64) if sums is None else sums
                for own, place, x in zip(sums, (pairs >> 32, pairs & 0xFFFFFFFF, pairs >> 32), (t, t, n), strict=False):
                    np.add.at(own, place, x)
            if sums is not None:
                for kind, at in itertools.product(range(kinds), range(0, size, _SPAN)):
                    if sums[kind, at : at + _SPAN].any():
                        yield piece(kind, at, sums[kind, at : at + _SPAN])

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (kind, at), own in itertools.groupby(_rows_of(batches, ("kind", "at", "sums")), lambda r: r[:2]):
                yield piece(kind, at, sum(_unpacked(r[2]) for r in own))

        def piece(kind: int, at: int, x: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at], pa.int32()), pa.array([_packed(x)], pa.binary())], names=["kind", "at", "sums"])

        form = "kind int, at int, sums binary"
        got = rows.select("pairs", "n", "more").mapInArrow(giving_back(add), form).repartition("kind", "at").sortWithinPartitions("kind", "at").mapInArrow(giving_back(merge), form)
        out = [np.zeros(size, np.int64) for _ in range(kinds)]
        for kind, at, sums in _rows_of(iter(got.toArrow().to_batches()), ("kind", "at", "sums")):
            out[kind][at : at + _SPAN] = _unpacked(sums)
        return [x.astype(np.int32) if x.max() < 1 << 31 else x for x in out]

    def _histogram(self) -> DataFrame:
        """(n, kinds): how many pairs come n times, for each bucket."""

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (n,) in _rows_of(batches, ("n",)):
                values, kinds = np.unique(_unpacked(n), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(kinds)], names=["n", "kinds"])

        return self.blocks.select("n").mapInArrow(giving_back(add), "n long, kinds long")

    def words(self) -> DataFrame:
        """(key, n, spelled): the customers of the word restaurant, the tables of all contexts."""
        more = self.contexts if self.seats is None else self.contexts + self.extra[1]
        known, shared = self.known, self._share(self.named, more)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key = batch.column("key")
                yield pa.RecordBatch.from_arrays([key, pa.array(shared.value[np.searchsorted(known.value, key.to_numpy())].astype(np.int64)), batch.column("spelled")], names=["key", "n", "spelled"])

        out = written(self.named.select("key", "spelled").mapInArrow(giving_back(add), "key long, n long, spelled double"))
        shared.destroy()
        return out

    def seat(self, book: DataFrame, number: int, draws: int, keep: bool) -> None:
        """A pass: ``draws`` draws of every pair's tables, by the words' probabilities and the contexts' last tables."""
        d, known, first = self.discount, self.known, self.seats is None
        tables = self.tables if first else self.tables + self.extra[0]
        shared = self._share(book, (self.by_place(book.withColumn("p", F.pow(F.lit(10.0), "open_value")), "p", "float"), tables))
        del tables

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parent, room = shared.value
            keys = np.append(known.value, _START)
            for bucket, pairs, n, more in _rows_of(batches, ("bucket", "pairs", "n", "more")):
                pairs, n = np.cumsum(_unpacked(pairs)), _unpacked(n)
                if first:
                    pairs, n = pairs[n > 1], n[n > 1]
                    last, kept = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
                else:
                    more = _unpacked(more)
                    last, kept = more & 0xFFFF_FFFF, more >> 32
                prev, word = pairs >> 32, pairs & 0xFFFFFFFF
                seed, others = _pair_hash(keys[prev], keys[word]), room[prev].astype(np.int64) - last
                for k in range(draws):
                    last = reseat(n, parent[word].astype(float), others, d, seed, number * draws + k)
                    kept = kept + last * keep
                yield _block(bucket, 1, pairs, n, kept << 32 | last)

        before, self.seats = self.seats, written((self.blocks if first else self.seats).mapInArrow(giving_back(run), _BLOCK), "uncompressed")
        shared.destroy()
        if before is not None:
            discard(before)
        # tables beyond a pair's first, of the last draw
        self.extra = self._sums(self.seats, lambda n, more: (more & 0xFFFF_FFFF) - 1)

    def finish(self, draws: int) -> tuple[np.ndarray, np.ndarray]:
        """For each context the average of strength and discounted tables, and its customers."""
        extra = self._sums(self.seats, lambda n, more: (more >> 32) - draws)[0] / draws
        extra += self.tables
        extra *= self.discount
        extra += STRENGTH
        return extra, self.customers

    def score(self, docs: DataFrame, counts: np.ndarray, open_value: np.ndarray, room: np.ndarray, customers: np.ndarray, draws: int, base: float, unknown: float) -> DataFrame:
        """Words and back-off where texts are read.  What pairs add is asked of the buckets, but for the ``_HOT`` most
        frequent ones, which go to all tasks.  Rows of one id and text add up together and are divided again."""
        d, known, buckets = self.discount, self.known, self.buckets
        shared = self._share(docs, (counts, open_value, room, customers))
        del counts, open_value, room, customers

        def lifts(pairs: np.ndarray, n: np.ndarray, t: np.ndarray) -> np.ndarray:
            _, open_, rooms, _ = shared.value
            return np.log10(1 + (n - d * t) / (rooms[pairs >> 32] * 10 ** open_[pairs & 0xFFFFFFFF]))

        least = _least(self._histogram().where("n > 1").groupBy("n").agg(F.sum("kinds").alias("kinds")))

        def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for pairs, n, more in _rows_of(batches, ("pairs", "n", "more")):
                pairs, n, t = np.cumsum(_unpacked(pairs)), _unpacked(n), (_unpacked(more) >> 32) / draws
                use = n >= least
                yield pa.RecordBatch.from_arrays([pa.array(pairs[use]), pa.array(lifts(pairs[use], n[use], t[use]))], names=["pair", "lift"])

        got = self.seats.select("pairs", "n", "more").mapInArrow(giving_back(frequent), "pair long, lift double").toArrow()
        pair, lift = got.column("pair").to_numpy(), got.column("lift").to_numpy()
        by = np.argsort(pair)
        hot = self._share(docs, (pair[by], lift[by]))
        del got, pair, lift, by
        named = docs.withColumn("name", F.xxhash64("doc_id", "text"))

        def parts(batch: pa.RecordBatch) -> Iterator[tuple]:
            known_hot, hot_lift = hot.value
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                keys, rows = _tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                word = _numbered(keys, known.value)  # the lexicon has every word
                prev = _previous(word, rows, j - i, len(known.value))
                pair = prev << 32 | word
                codes, unique = pd.factorize(pair)
                at = np.minimum(np.searchsorted(known_hot, unique), max(len(known_hot) - 1, 0))
                hit = known_hot[at] == unique if len(known_hot) else np.zeros(len(unique), bool)
                yield i, j, rows, word, prev, pair, hit[codes], np.where(hit, hot_lift[at], 0.0)[codes] if len(known_hot) else np.zeros(len(pair))

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, open_, room, customers = shared.value
            chunk = _Chunk(lambda pairs: _buckets_of(pairs, buckets), buckets, lambda bucket: bucket)
            for batch in batches:
                names = batch.column("name").to_numpy()
                for i, j, rows, word, prev, pair, hit, more in parts(batch):
                    total = lambda w: np.bincount(rows, w, j - i)  # noqa: B023, E731
                    some = n[word] > 0
                    want = ~hit & some & (customers[prev] > 0)
                    more = more + np.log10(room[prev] / (STRENGTH + customers[prev]))
                    own = (np.bincount(rows, minlength=j - i), total(some).astype(np.int64), total(np.log10(n[word] + 1.0) - base), total(np.where(some, open_[word], unknown) + more), total(open_[word] + more))
                    yield from chunk.add(batch.column("doc_id").slice(i, j - i), names[i:j], own, pair[want], rows[want])
            yield from chunk.flush()

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pairs = lift = np.zeros(0, np.int64)
            now = None
            for row in _rows_of(batches, ("cell", "bucket", "kind", "chunk", "pairs", "n", "more")):
                _, bucket, kind, chunk, own, n, more = row
                if kind == 3:
                    yield _row(_ASKED, *row)
                    continue
                own, n = np.cumsum(_unpacked(own)), _unpacked(n)
                if bucket != now:
                    now, pairs, lift = bucket, own[:0], np.zeros(0)
                if kind == 0:
                    pairs, lift = own, lifts(own, n, np.ones(len(n)))
                elif kind == 1:
                    lift[np.searchsorted(pairs, own)] = lifts(own, n, (_unpacked(more) >> 32) / draws)
                elif len(pairs):
                    at = np.minimum(np.searchsorted(pairs, own), len(pairs) - 1)
                    adds = np.bincount(_unpacked(more), np.repeat(np.where(pairs[at] == own, lift[at], 0.0), n))
                    use = np.flatnonzero(adds)
                    yield _answer(bucket, bucket, chunk, use, adds[use])

        fitted = self.blocks.unionByName(self.seats).withColumns({"cell": F.col("bucket"), "chunk": F.lit(None).cast("long")})
        rows = fitted.unionByName(named.mapInArrow(giving_back(ask), _ASKED))
        return _assembled(rows.repartition("cell").sortWithinPartitions("cell", "bucket", "kind").mapInArrow(giving_back(answer), _ASKED))


_CELL = "cell int, bucket int, kind int, pairs binary, n binary, more binary"
_RANGED = "range int, what int, values binary"
#: What a range of the lexicon has in a row of its own, of its words and, from _TABLES on, of their contexts.
_KEYS, _COUNTS, _SPELLED, _TOPS, _ALIKE, _ALIKE_AT, _TOTALS, _CHANCE, _OPEN, _CONTEXTS, _MORE_CONTEXTS, _TABLES, _CUSTOMERS, _MORE_TABLES, _KEPT = range(15)
_BEFORE = 16  # added to what a cell has of its words of context


class _Places:
    """Places of keys in the sorted lexicon by their upper halves, in four bytes a word; keys that share theirs stand
    beside in full.  Only words of the lexicon are asked."""

    def __init__(self, parts: list[dict[int, bytes]], edges: np.ndarray):
        self.parts, self.edges = parts, edges

    def find(self, keys: np.ndarray) -> np.ndarray:
        if self.parts is not None:  # on a worker, once
            self.tops = np.empty(int(self.edges[-1]), np.int32)
            for part, i, j in zip(self.parts, self.edges[:-1], self.edges[1:], strict=True):
                if part:
                    self.tops[i:j] = np.cumsum(_unpacked(part[_TOPS]))
            self.alike, self.alike_at = (np.concatenate([np.zeros(0, np.int64), *(_unpacked(p[what]) + e * (what == _ALIKE_AT) for p, e in zip(self.parts, self.edges, strict=False) if p)]) for what in (_ALIKE, _ALIKE_AT))
            self.parts = None
        at = np.searchsorted(self.tops, (keys >> 32).astype(np.int32))
        if len(self.alike):
            k = np.minimum(np.searchsorted(self.alike, keys), len(self.alike) - 1)
            same = self.alike[k] == keys
            at[same] = self.alike_at[k[same]]
        return at


@dataclass
class _Grid:
    """Ranges of the sorted lexicon by ``edges``, the start behind the last word; cells of a range of words before and a
    range of words, and their buckets, by the ``first`` of each cell."""

    edges: np.ndarray
    first: np.ndarray

    @property
    def ranges(self) -> int:
        return len(self.edges) - 1

    @property
    def start(self) -> int:
        return int(self.edges[-1])

    def size(self, at: int) -> int:
        return int(self.edges[at + 1] - self.edges[at]) + (at == self.ranges - 1)

    def home(self, pairs: np.ndarray) -> np.ndarray:
        inner = self.edges[1:-1]
        cell = np.searchsorted(inner, pairs >> 32, "right") * self.ranges + np.searchsorted(inner, pairs & 0xFFFFFFFF, "right")
        return self.first[cell] + ((mix(pairs.view(U64)) >> U64(33)).astype(np.int64) % np.diff(self.first)[cell])

    def cell(self, bucket: int) -> int:
        return int(np.searchsorted(self.first, bucket, "right")) - 1

    def whole(self, at: int, blob: bytes | np.ndarray | None, start=0) -> np.ndarray:
        """A range's values, ``start`` for the start where they have none; zeros where no row has them."""
        x = np.zeros(0, np.int64) if blob is None else _unpacked(blob) if isinstance(blob, bytes) else blob
        out = np.zeros(self.size(at), x.dtype)
        out[-1:] = start
        out[: len(x)] = x
        return out


def _piece(at: int, what: int, values: bytes) -> pa.RecordBatch:
    return _row(_RANGED, at, what, values)


class GridPairs:
    """The same restaurants for a lexicon of any size: no array as long as the lexicon, but for ``_Places``.

    The sorted lexicon falls into ranges, and a pair lives in the cell of the ranges of its two words.  What a pass needs of
    other buckets goes to a cell for its two ranges alone, as rows beside its buckets, and so do the questions of texts.
    A task knows the most frequent words and pairs; all else of a text is scored in the cells.
    """

    def __init__(self, docs: DataFrame, learn: Column, named: DataFrame, rows: int, total: int):
        bits = max(1, (rows // _RANGE_WORDS).bit_length())
        self.named, self.range = named, (F.shiftright("key", 64 - bits) + (1 << bits - 1)).cast("int")

        def cut(key: np.ndarray, n: np.ndarray, spelled: np.ndarray) -> Iterator[tuple[int, bytes]]:
            tops = key >> 32
            same = np.concatenate([[False], tops[1:] == tops[:-1], [False]])
            alike = np.flatnonzero(same[1:] | same[:-1])
            yield from ((_KEYS, _packed(np.diff(key, prepend=0))), (_COUNTS, _packed(n)), (_SPELLED, spelled.tobytes()))
            yield from ((_TOPS, _packed(np.diff(tops, prepend=0))), (_ALIKE, _packed(key[alike])), (_ALIKE_AT, _packed(alike)))
            yield _TOTALS, _packed(np.array([len(key), n.sum(), n[key == _END].sum()]))

        self.lexicon = self._ranged(named.select("key", "n", "spelled"), cut)
        parts: list[dict[int, bytes]] = [{} for _ in range(1 << bits)]
        for at, what, values in _rows_of(iter(self.lexicon.where(F.col("what").between(_TOPS, _TOTALS)).toArrow().to_batches()), ("range", "what", "values")):
            parts[at][what] = values
        sizes, n, ends = np.array([_unpacked(p[_TOTALS]) if p else [0, 0, 0] for p in parts]).T
        before = n.astype(float)
        before[-1] += ends.sum()  # of the start
        buckets = np.maximum(1, np.ceil(np.outer(before, n) / max(total, 1) / _BUCKET_TOKENS)).astype(np.int64)
        self.grid = _Grid(np.append(0, np.cumsum(sizes)), np.append(0, np.cumsum(buckets)))
        self.places = docs.sparkSession.sparkContext.broadcast(_Places(parts, self.grid.edges))
        del parts
        self.blocks = self._count(docs.where(F.coalesce(learn, F.lit(False))).select("text"))
        self.first = self._sums(self.blocks, lambda n, more: np.ones(len(n), np.int64), (_TABLES, _CONTEXTS, _CUSTOMERS))
        sizes = self._histogram().agg(F.sum(F.when(F.col("n") == 1, F.col("kinds"))), F.sum(F.when(F.col("n") == 2, F.col("kinds")))).first()
        self.discount, self.seats, self.extra = _discount(*(int(x or 0) for x in sizes)), None, None

    def _ranged(self, rows: DataFrame, cut) -> DataFrame:
        """(range, what, values): what ``cut`` makes of the columns of each range, in order of its keys."""
        columns = rows.columns

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept, now = [], None
            for batch in batches:
                at = batch.column("range").to_numpy()
                edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
                for i, j in itertools.pairwise(edges):
                    if i == j:
                        continue
                    if kept and at[i] != now:
                        yield from done(now, kept)
                        kept = []
                    now = int(at[i])
                    kept.append([batch.column(c).slice(i, j - i).to_numpy() for c in columns])
            if kept:
                yield from done(now, kept)

        def done(now: int, kept: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for what, values in cut(*(np.concatenate(x) for x in zip(*kept, strict=True))):
                yield _piece(now, what, values)

        return written(rows.withColumn("range", self.range).repartition("range").sortWithinPartitions("range", "key").mapInArrow(giving_back(work), _RANGED), "uncompressed")

    def _count(self, texts: DataFrame) -> DataFrame:
        places, grid = self.places, self.grid

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wait: list[np.ndarray] = []
            buckets = int(grid.first[-1])

            def flush() -> Iterator[pa.RecordBatch]:
                if wait:
                    pairs, n = np.unique(np.concatenate(wait), return_counts=True)
                    wait.clear()
                    home = grid.home(pairs)
                    by = np.argsort(home, kind="stable")
                    edges = np.searchsorted(home[by], np.arange(buckets + 1))
                    for b in np.flatnonzero(np.diff(edges)).tolist():
                        own = by[edges[b] : edges[b + 1]]
                        yield _row(_CELL, grid.cell(b), b, 0, _packed(np.diff(pairs[own], prepend=0)), _packed(n[own]), None)

            for batch in batches:
                buf, offsets = text_bytes(batch.column("text"))
                for i, j in slices(offsets):
                    keys, rows = _tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    codes, unique = pd.factorize(keys)
                    word = places.value.find(unique)[codes]
                    wait.append(_previous(word, rows, j - i, grid.start) << 32 | word)
                    if sum(map(len, wait)) > _CHUNK_TOKENS:
                        yield from flush()
            yield from flush()

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (cell, bucket), rows in itertools.groupby(_rows_of(batches, ("cell", "bucket", "pairs", "n")), lambda r: r[:2]):
                parts = [(np.cumsum(_unpacked(p)), _unpacked(n)) for *_, p, n in rows]
                pairs, at = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([c for _, c in parts]), len(pairs)).astype(np.int64)
                yield _row(_CELL, cell, bucket, 0, _packed(np.diff(pairs, prepend=0)), _packed(n), _packed(n[:0]))

        return written(texts.mapInArrow(giving_back(count), _CELL).repartition("cell").sortWithinPartitions("cell", "bucket").mapInArrow(giving_back(merge), _CELL), "uncompressed")

    def _sums(self, rows: DataFrame, tables, names: tuple[int, ...]) -> DataFrame:
        """Sums of ``tables`` of n and more over the pairs of each context and of each word, and of n for each context."""
        grid = self.grid

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, own in itertools.groupby(_rows_of(batches, ("cell", "pairs", "n", "more")), lambda r: r[0]):
                i, j = divmod(cell, grid.ranges)
                sides = (i, j, i)[: len(names)]
                sums = [np.zeros(grid.size(at), np.int64) for at in sides]
                for _, pairs, n, more in own:
                    pairs, n = np.cumsum(_unpacked(pairs)), _unpacked(n)
                    t = tables(n, _unpacked(more))
                    for x, at, place, v in zip(sums, sides, (pairs >> 32, pairs & 0xFFFFFFFF, pairs >> 32), (t, t, n), strict=False):
                        np.add.at(x, place - grid.edges[at], v)
                for at, what, x in zip(sides, names, sums, strict=True):
                    yield _piece(at, what, _packed(x))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (at, what), own in itertools.groupby(_rows_of(batches, ("range", "what", "values")), lambda r: r[:2]):
                total = 0
                for *_, x in own:
                    total = total + _unpacked(x)
                yield _piece(at, what, _packed(total))

        pieces = rows.select("cell", "pairs", "n", "more").mapInArrow(giving_back(add), _RANGED)
        return written(pieces.repartition("range", "what").sortWithinPartitions("range", "what").mapInArrow(giving_back(merge), _RANGED), "uncompressed")

    def _histogram(self) -> DataFrame:
        return WordPairs._histogram(self)

    def _beside(self, rows: DataFrame, before: tuple[int, ...], own: tuple[int, ...]) -> DataFrame:
        """Rows of ranges as rows that come first in their cells."""
        other = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(self.grid.ranges - 1))).alias("other"))
        form = lambda cell, kind: (cell.cast("int").alias("cell"), F.lit(-1).alias("bucket"), kind.cast("int").alias("kind"), F.lit(None).cast("binary").alias("pairs"), F.lit(None).cast("binary").alias("n"), F.col("values").alias("more"))
        left = other.where(F.col("what").isin(*before)).select(*form(F.col("range") * self.grid.ranges + F.col("other"), F.col("what") + _BEFORE))
        return left.unionByName(other.where(F.col("what").isin(*own)).select(*form(F.col("other") * self.grid.ranges + F.col("range"), F.col("what"))))

    def _state(self, *more: DataFrame) -> DataFrame:
        out = self.lexicon.unionByName(self.first)
        for rows in (self.extra, *more):
            out = out if rows is None else out.unionByName(rows)
        return out

    def words(self) -> DataFrame:
        """(key, n, spelled): the customers of the word restaurant, the tables of all contexts."""
        grid = self.grid

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for at, own in itertools.groupby(_rows_of(batches, ("range", "what", "values")), lambda r: r[0]):
                got = {what: values for _, what, values in own}
                if _KEYS in got:
                    key, spelled = np.cumsum(_unpacked(got[_KEYS])), np.frombuffer(got[_SPELLED])
                    n = (grid.whole(at, got.get(_CONTEXTS)) + grid.whole(at, got.get(_MORE_CONTEXTS)))[: len(key)]
                    for k in range(0, len(key), _SPAN):
                        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + _SPAN]) for x in (key, n, spelled)], names=["key", "n", "spelled"])

        rows = self._state().where(F.col("what").isin(_KEYS, _SPELLED, _CONTEXTS, _MORE_CONTEXTS))
        return written(rows.repartition("range").sortWithinPartitions("range").mapInArrow(giving_back(add), "key long, n long, spelled double"))

    def seat(self, book: DataFrame, number: int, draws: int, keep: bool) -> None:
        d, grid, first = self.discount, self.grid, self.seats is None
        chance = self._ranged(book.select("key", F.pow(F.lit(10.0), "open_value").cast("float").alias("p")), lambda _, p: [(_CHANCE, p.tobytes())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for cell, rows in itertools.groupby(_rows_of(batches, ("cell", "bucket", "pairs", "n", "more", "kind")), lambda r: r[0]):
                (i, j), got, ready = divmod(cell, grid.ranges), {}, None
                for _, bucket, pairs, n, more, kind in rows:
                    if bucket < 0:
                        got[kind] = more
                        continue
                    if ready is None:
                        keys = [grid.whole(at, np.cumsum(_unpacked(got[k])) if k in got else None, start=_START) for at, k in ((i, _KEYS + _BEFORE), (j, _KEYS))]
                        ready = *keys, grid.whole(i, got.get(_TABLES + _BEFORE)) + grid.whole(i, got.get(_MORE_TABLES + _BEFORE)), np.frombuffer(got[_CHANCE], np.float32)
                        got = {}
                    before, own, room, parent = ready
                    pairs, n = np.cumsum(_unpacked(pairs)), _unpacked(n)
                    if first:
                        pairs, n = pairs[n > 1], n[n > 1]
                        last, kept = np.ones(len(n), np.int64), np.zeros(len(n), np.int64)
                    else:
                        more = _unpacked(more)
                        last, kept = more & 0xFFFF_FFFF, more >> 32
                    prev, word = (pairs >> 32) - grid.edges[i], (pairs & 0xFFFFFFFF) - grid.edges[j]
                    seed, others = _pair_hash(before[prev], own[word]), room[prev] - last
                    for k in range(draws):
                        last = reseat(n, parent[word].astype(float), others, d, seed, number * draws + k)
                        kept = kept + last * keep
                    yield _row(_CELL, cell, bucket, 1, _packed(np.diff(pairs, prepend=0)), _packed(n), _packed(kept << 32 | last))

        beside = self._beside(self._state(chance), (_KEYS, _TABLES, _MORE_TABLES), (_KEYS, _CHANCE))
        rows = (self.blocks if first else self.seats).unionByName(beside)
        old = [chance, self.seats, self.extra]
        self.seats = written(rows.repartition("cell").sortWithinPartitions("cell", "bucket").mapInArrow(giving_back(run), _CELL), "uncompressed")
        self.extra = self._sums(self.seats, lambda n, more: (more & 0xFFFF_FFFF) - 1, (_MORE_TABLES, _MORE_CONTEXTS))
        for rows in old:
            if rows is not None:
                discard(rows)

    def score(self, docs: DataFrame, book: DataFrame, draws: int, base: float, unknown: float) -> DataFrame:
        d, grid, places = self.discount, self.grid, self.places
        share = docs.sparkSession.sparkContext.broadcast
        kept = self._sums(self.seats, lambda n, more: (more >> 32) - draws, (_KEPT,))
        state = self._state(kept, self._ranged(book.select("key", "open_value"), lambda _, x: [(_OPEN, x.tobytes())]))

        def contexts(at: int, got: dict[int, bytes], more: int) -> tuple[np.ndarray, np.ndarray]:
            return (grid.whole(at, got.get(_KEPT + more)) / draws + grid.whole(at, got.get(_TABLES + more))) * d + STRENGTH, grid.whole(at, got.get(_CUSTOMERS + more))

        def lifts(n: np.ndarray, t: np.ndarray, room: np.ndarray, open_: np.ndarray) -> np.ndarray:
            return np.log10(1 + (n - d * t) / (room * 10**open_))

        least_word = _least(self.named.where("n > 1").groupBy("n").agg(F.count(F.lit(1)).alias("kinds")))
        least_pair = _least(self._histogram().where("n > 1").groupBy("n").agg(F.sum("kinds").alias("kinds")))

        def frequent_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for at, own in itertools.groupby(_rows_of(batches, ("range", "what", "values")), lambda r: r[0]):
                got = {what: values for _, what, values in own}
                n = grid.whole(at, got.get(_COUNTS), start=least_word)
                use = np.flatnonzero(n >= least_word)
                open_, (room, customers) = grid.whole(at, np.frombuffer(got.get(_OPEN, b""))), contexts(at, got, 0)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (grid.edges[at] + use, n[use], open_[use], room[use], customers[use])], names=["place", "n", "open", "room", "customers"])

        needed = state.where(F.col("what").isin(_COUNTS, _OPEN, _TABLES, _CUSTOMERS, _KEPT))
        got = needed.repartition("range").sortWithinPartitions("range").mapInArrow(giving_back(frequent_words), "place long, n long, open double, room double, customers long").orderBy("place").toArrow()
        words = tuple(c.to_numpy() for c in got.columns)
        if not len(words[0]) or words[0][-1] != grid.start:  # no word in the last range
            words = tuple(np.append(x, v) for x, v in zip(words, (grid.start, least_word, 0.0, STRENGTH, 0), strict=True))
        words = share(words)

        def frequent_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            place, _, open_, room, _ = words.value
            for pairs, n, more in _rows_of(batches, ("pairs", "n", "more")):
                pairs, n, t = np.cumsum(_unpacked(pairs)), _unpacked(n), (_unpacked(more) >> 32) / draws
                before, own = _at(place, pairs >> 32), _at(place, pairs & 0xFFFFFFFF)
                use = (n >= least_pair) & (before >= 0) & (own >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[use]), pa.array(lifts(n[use], t[use], room[before[use]], open_[own[use]]))], names=["pair", "lift"])

        got = self.seats.select("pairs", "n", "more").mapInArrow(giving_back(frequent_pairs), "pair long, lift double").toArrow()
        pair, lift = got.column("pair").to_numpy(), got.column("lift").to_numpy()
        by = np.argsort(pair)
        hot = share((pair[by], lift[by]))
        del got, pair, lift, by

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (place, n, open_, room, customers), (known_hot, hot_lift) = words.value, hot.value
            score_base, gamma = np.log10(n + 1.0) - base, np.log10(room / (STRENGTH + customers))
            chunk = _Chunk(grid.home, int(grid.first[-1]), grid.cell)
            for batch in batches:
                buf, offsets = text_bytes(batch.column("text"))
                names = batch.column("name").to_numpy()
                for i, j in slices(offsets):
                    keys, rows = _tokens(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    codes, unique = pd.factorize(keys)
                    unique = places.value.find(unique)
                    word, own = unique[codes], _at(place, unique)[codes]
                    prev, before = _previous(word, rows, j - i, grid.start), _previous(own, rows, j - i, len(place) - 1)
                    known = (own >= 0) & (before >= 0)
                    pair = prev << 32 | word
                    codes, unique = pd.factorize(pair)
                    at = _at(known_hot, unique)
                    lift = np.where(at >= 0, hot_lift[at], 0.0)[codes] if len(known_hot) else np.zeros(len(pair))
                    want = (at[codes] < 0) | ~known
                    row, own, before = rows[known], own[known], before[known]
                    total = lambda w: np.bincount(row, w, j - i)  # noqa: B023, E731
                    score = total(open_[own] + gamma[before] + lift[known])
                    sums = np.bincount(rows, minlength=j - i), np.bincount(row, minlength=j - i), total(score_base[own]), score, score
                    yield from chunk.add(batch.column("doc_id").slice(i, j - i), names[i:j], sums, pair[want], rows[want])
            yield from chunk.flush()

        def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cell = now = None
            got, ready = {}, None
            pairs = lift = np.zeros(0, np.int64)
            for row in _rows_of(batches, ("cell", "bucket", "kind", "chunk", "pairs", "n", "more")):
                at, bucket, kind, chunk, own, n, more = row
                if at != cell:
                    cell, got, ready = at, {}, None
                    i, j = divmod(cell, grid.ranges)
                if bucket < 0:
                    got[kind] = more
                    continue
                if kind == 3:
                    yield _row(_ASKED, *row)
                    continue
                if ready is None:
                    n_before, n_word = grid.whole(i, got.get(_COUNTS + _BEFORE), start=least_word), grid.whole(j, got.get(_COUNTS))
                    room, customers = contexts(i, got, _BEFORE)
                    ready = n_before >= least_word, n_word, room, np.log10(room / (STRENGTH + customers)), np.frombuffer(got.get(_OPEN, b""))
                    got = {}
                    del n_before, n_word, room, customers
                often, counts, room, gamma, open_ = ready
                own, n = np.cumsum(_unpacked(own)), _unpacked(n)
                prev, word = (own >> 32) - grid.edges[i], (own & 0xFFFFFFFF) - grid.edges[j]
                if bucket != now:
                    now, pairs, lift = bucket, own[:0], np.zeros(0)
                if kind == 0:
                    pairs, lift = own, lifts(n, np.ones(len(n)), room[prev], open_[word])
                elif kind == 1:
                    lift[np.searchsorted(pairs, own)] = lifts(n, (_unpacked(more) >> 32) / draws, room[prev], open_[word])
                else:
                    at = _at(pairs, own)
                    up = np.where(at >= 0, lift[at], 0.0) if len(pairs) else np.zeros(len(own))
                    texts, rare = _unpacked(more), np.repeat(~(often[prev] & (counts[word] >= least_word)), n)
                    adds = np.bincount(texts[~rare], np.repeat(up, n)[~rare])
                    use, whole = np.flatnonzero(adds), None
                    if rare.any():
                        some = counts[word] > 0
                        more = np.log10(counts[word] + 1.0) - base, np.where(some, open_[word], unknown) + gamma[prev] + up, open_[word] + gamma[prev] + up
                        texts, of = np.unique(texts[rare], return_inverse=True)
                        whole = texts, *(np.bincount(of, np.repeat(x, n)[rare]) for x in (some, *more))
                        whole = texts, whole[1].astype(np.int64), *whole[2:]
                    if len(use) or whole:
                        yield _answer(cell, bucket, chunk, use, adds[use], whole)

        beside = self._beside(state, (_COUNTS, _TABLES, _CUSTOMERS, _KEPT), (_COUNTS, _OPEN))
        fitted = self.blocks.unionByName(self.seats).unionByName(beside).withColumn("chunk", F.lit(None).cast("long"))
        rows = fitted.unionByName(docs.withColumn("name", F.xxhash64("doc_id", "text")).mapInArrow(giving_back(ask), _ASKED))
        return _assembled(rows.repartition("cell").sortWithinPartitions("cell", "bucket", "kind").mapInArrow(giving_back(answer), _ASKED))


def _at(known: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where sorted ``known`` has each, -1 where it has not."""
    if not len(known):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
    return np.where(known[at] == wanted, at, -1)


def _least(rows: DataFrame) -> int:
    """The least n from which on no more than ``_HOT`` are as frequent, of (n, kinds)."""
    got = rows.orderBy(F.desc("n")).limit(_HOT).toArrow()
    n, over = got.column("n").to_numpy(), np.flatnonzero(np.cumsum(got.column("kinds").to_numpy()) > _HOT)
    return int(n[over[0]]) + 1 if len(over) else 2


def _scored(own: DataFrame, learn: Column, order: int, broadcast_rows: int, passes: int, draws: int) -> tuple[DataFrame, int]:
    words = written(word_counts(own, learn))
    some = F.col("n") > 0
    seen = words.agg(F.count(F.lit(1)), F.count_if(some), F.coalesce(F.sum("n"), F.lit(0))).first()
    rows, kinds, total = (int(x) for x in seen)
    model, top = fit_spelling(written(gram_counts(words.where(some), order)), order)
    shared = own.sparkSession.sparkContext.broadcast(_in_arrays(model, top)) if model.count() <= broadcast_rows else None
    named = written(_spelled_in_tasks(words, shared, keyed=True) if shared else _spelled_by_join(words, model, top))
    discard(words)
    discard(model)
    if shared:
        shared.destroy()
    fast = rows <= broadcast_rows
    if fast:
        pairs = WordPairs(own, learn, named, total)
    else:
        pairs = GridPairs(own, learn, named, rows, total)

    def book(rounds: int, burn_in: int) -> tuple[DataFrame, float]:
        seats = pairs.words()
        s = seats.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
        out = _seated(seats, int(s[0]), kinds, _discount(int(s[1]), int(s[2])), rounds, burn_in)
        discard(seats)
        return out

    for number in range(passes):
        now, _ = book(2, 1)
        pairs.seat(now, number, draws, number > 0)
        discard(now)
    (last, unknown), kept, base = book(4, 1), draws * (passes - 1), float(np.log10(total + kinds + 1))
    if fast:
        scored = pairs.score(own, pairs.by_place(named, "n", "long"), pairs.by_place(last, "open_value", "double"), *pairs.finish(kept), kept, base, unknown)
    else:
        scored = pairs.score(own, last, kept, base, unknown)
    return scored, total


def score_texts(docs: DataFrame, folds: int = 7, held_out: int = 2, order: int = 6, broadcast_rows: int = 5_000_000, passes: int = 3, draws: int = 3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, open_score for every row.

    ``score`` and ``base_score`` (add-one unigrams) are over the same outcomes, the known words and one for all unknown
    words; ``open_score`` is the probability of the very words, unknown ones by their spelling.  ``score`` and
    ``open_score`` take every word in the context of the one before it.

    Learns from the rows outside the held-out fold, all of them; null ids are scored but neither learned from nor
    held out; null texts count as empty (the end alone); repeated rows count as often as they come.  An empty
    training set makes every word unknown.

    A pass seats the words on the tables of all contexts, then every context's customers, ``draws`` times; draws of
    the first pass are thrown away.  The spelling model and the lexicon go to the tasks while each has
    ``broadcast_rows`` rows at most (24 bytes a row); beyond that spellings are joined and pairs lie in cells, to the same scores.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    learn = fold(F.col("doc_id"), folds) != held_out
    with without_shuffles(own.sparkSession):
        scored, total = _scored(own, learn, order, broadcast_rows, passes, draws)
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "open_score")


def _tokens(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and row of every word, then of every row's end."""
    _, _, _, rows, keys = text_tokens(buf, offsets)
    n = len(offsets) - 1
    return np.append(keys, np.full(n, _END)), np.append(rows, np.arange(n))
