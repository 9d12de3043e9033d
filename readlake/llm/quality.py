"""Document quality by a linear-chain conditional random field over lines.

Each line is good (1) or bad (0).  Its evidence is a sum of table entries: one table for each feature of the line
itself, of the line before and of the line after.  Transitions between neighbours and the first line's start have
weights of their own.  Training lines carry their document's label; a document's score is the mean of its lines'
forward-backward marginals, weighted by line length, so it is the share of the text that reads as good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.labelled import label_sample, sigmoid
from readlake.llm.shared import give_back
from readlake.llm.textkit import binary_column, slices, span_hashes, text_bytes, word_spans

_SHARES = np.array([1e-9, 0.01, 0.03, 0.06, 0.12, 0.25, 0.5, 0.8])
_BINS = 18
FEATURES = ("length", "upper", "digit", "symbol", "repeated word", "word length", "line again", "marked word", "end")
_CLASS = np.zeros((4, 256), bool)
_CLASS[0, 65:91] = True
_CLASS[1, [*range(65, 91), *range(97, 123)]] = True
_CLASS[2, 48:58] = True
_CLASS[3, list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = True


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every line; a row has a line at least, and a newline at its end begins no other."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(buf == 10) + 1
    breaks = breaks[np.searchsorted(offsets[1:], breaks) == np.searchsorted(offsets, breaks, "right") - 1]  # strictly inside a row
    starts = np.sort(np.concatenate([offsets[:-1], breaks]), kind="stable")
    rows = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1]), kind="stable")
    last = np.ones(len(rows), bool)
    last[:-1] = rows[1:] != rows[:-1]
    ends = np.empty(len(rows), np.int64)
    ends[last] = offsets[1:]
    ends[~last] = starts[1:][~last[:-1]] - 1
    closed = np.flatnonzero(last & (ends > starts))
    ends[closed] -= buf[ends[closed] - 1] == 10
    return starts, ends, rows


def line_features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature bins (lines x features, 1 and up), byte length and row of every line."""
    starts, ends, rows = line_spans(buf, offsets)
    n, size = len(starts), ends - starts
    sums = np.zeros((4, len(buf) + 1), np.int32)
    for k in range(4):
        np.cumsum(_CLASS[k][buf], out=sums[k, 1:])
    upper, letters, digits, symbols = (s[ends] - s[starts] for s in sums)
    ws, we, wr = word_spans(buf, offsets)
    hashes = span_hashes(buf, ws, we)
    line = np.searchsorted(starts, ws, "right") - 1
    words = np.bincount(line, minlength=n)
    again = np.zeros(len(ws), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    marked = _CLASS[3][buf[we - 1]] if len(we) else again
    ink = np.bincount(line, we - ws, n)
    own = span_hashes(buf, starts, ends) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    _, first, which = np.unique(own, return_index=True, return_inverse=True)
    earlier = (first[which] != np.arange(n)) & (size > 0)
    final = np.where(size > 0, buf[np.maximum(ends - 1, 0)] if len(buf) else 0, 0)
    share = lambda a, b: 1 + np.searchsorted(_SHARES, a / np.maximum(b, 1), "right")
    bins = np.stack(
        [
            1 + np.minimum(np.log2(size + 1).astype(int), 15),
            share(upper, letters),
            share(digits, size),
            share(symbols, size),
            share(np.bincount(line, again, n), words),
            1 + np.minimum((ink / np.maximum(words, 1)).astype(int), 15),
            1 + earlier.astype(int),
            share(np.bincount(line, marked, n), words),
            1 + np.isin(final, list(b".?:;")) + 2 * _CLASS[3][final],
        ],
        axis=1,
    ).astype(np.uint8)
    return bins, size, rows


def _neighbours(bins: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Indices into the flat weight tables: own, previous and next line's bins; bin 0 stands for no line."""
    wide = np.zeros((len(bins), 3, bins.shape[1]), np.int64)
    wide[:, 0] = bins
    same = rows[1:] == rows[:-1]
    wide[1:, 1] = bins[:-1] * same[:, None]
    wide[:-1, 2] = bins[1:] * same[:, None]
    return wide.reshape(len(bins), 3 * bins.shape[1]) + np.arange(3 * bins.shape[1]) * _BINS


@dataclass
class LineCRF:
    weights: np.ndarray  # evidence for a good line, by table and bin
    moves: np.ndarray  # 2 x 2, from state to state
    start: float

    def marginals(self, emit: np.ndarray, rows: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line by forward-backward over all rows at once, one step a line; and expected moves."""
        if not len(emit):
            return np.zeros(0), np.zeros((2, 2))
        begin = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        size = np.diff(np.append(begin, len(rows)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        live = len(size) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1))  # rows with a line t
        m = self.moves
        # messages as log-odds of good against bad
        step = lambda x, a: np.logaddexp(a[0, 1], x + a[1, 1]) - np.logaddexp(a[0, 0], x + a[1, 0])
        ahead, back = np.zeros(len(emit)), np.zeros(len(emit))
        ahead[begin] = emit[begin] + self.start
        for t in range(1, size[0]):
            at = begin[: live[t]] + t
            ahead[at] = emit[at] + step(ahead[at - 1], m)
        for t in range(size[0] - 2, -1, -1):
            at = begin[: live[t + 1]] + t
            back[at] = step(emit[at + 1] + back[at + 1], m.T)
        good = sigmoid(ahead + back)
        expected = np.zeros((2, 2))
        if pairs:
            left = np.flatnonzero(rows[1:] == rows[:-1])
            a, b = ahead[left], emit[left + 1] + back[left + 1]
            logs = np.stack([np.full(len(left), m[0, 0]), b + m[0, 1], a + m[1, 0], a + b + m[1, 1]])
            logs -= logs.max(axis=0)
            p = np.exp(logs)
            expected = (p / p.sum(axis=0)).sum(axis=1).reshape(2, 2)
        return good, expected

    def score(self, bins: np.ndarray, size: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """Length-weighted mean of P(good); an empty line weighs as one byte."""
        good, _ = self.marginals(self.weights[_neighbours(bins, rows)].sum(axis=1), rows)
        weight = np.maximum(size, 1)
        return np.bincount(rows, good * weight, n_rows) / np.bincount(rows, weight, n_rows)


def train_crf(bins: np.ndarray, rows: np.ndarray, good: np.ndarray, steps: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> LineCRF:
    """Conditional maximum likelihood by Adam; ``good`` is each line's label, ``rows`` tell chains apart."""
    index = _neighbours(bins, rows)
    n_weights = index.shape[1] * _BINS
    first = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    left = np.flatnonzero(~first) - 1
    seen = np.bincount(2 * good[left] + good[left + 1], minlength=4).reshape(2, 2)
    crf = LineCRF(np.zeros(n_weights), np.zeros((2, 2)), 0.0)
    theta, m1, m2 = np.zeros(n_weights + 5), np.zeros(n_weights + 5), np.zeros(n_weights + 5)
    chains = max(first.sum(), 1)
    for t in range(1, steps + 1 if len(rows) else 1):
        p, expected = crf.marginals(crf.weights[index].sum(axis=1), rows, pairs=True)
        off = good - p
        table = np.bincount(index.ravel(), np.repeat(off, index.shape[1]), n_weights)
        gradient = np.concatenate([table, (seen - expected).ravel(), [off[first].sum()]]) / chains - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.99 * m2 + 0.01 * gradient**2
        theta += rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        crf = LineCRF(theta[:n_weights], theta[n_weights : n_weights + 4].reshape(2, 2), float(theta[-1]))
    return crf


def fit_quality(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, good_docs: int = 2000, bad_docs: int = 1000, chain: int = 64) -> LineCRF:
    """Fit on at most ``good_docs`` and ``bad_docs`` labelled documents outside the held-out fold, whole texts.

    The driver gets the sample's feature bins.  For training a document is cut into chains of ``chain`` lines.
    Without labelled rows every line is as likely good as bad.
    """
    sample = label_sample(labels, "quality", folds, held_out, {1: good_docs, 0: bad_docs})

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                bins, _, rows = line_features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), binary_column(bins.ravel(), np.bincount(rows, minlength=j - i) * len(FEATURES))], names=["label", "bins"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    got = own.join(F.broadcast(sample), "doc_id").select("label", "text").mapInArrow(lines, "label int, bins binary").toArrow()
    parts = [np.frombuffer(b, np.uint8).reshape(-1, len(FEATURES)) for b in got.column("bins").to_pylist()]
    labels_ = np.array(got.column("label").to_pylist(), np.int64)
    size = np.array([len(p) for p in parts], np.int64)
    bins = np.concatenate([*parts, np.zeros((0, len(FEATURES)), np.uint8)])
    doc = np.repeat(np.arange(len(parts)), size)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    _, rows = np.unique(doc * (1 << 32) + within // chain, return_inverse=True)
    return train_crf(bins, rows, np.repeat(labels_, size))


def score_quality(docs: DataFrame, model: LineCRF, threshold: float = 0.7) -> DataFrame:
    """doc_id, score, predicted for every row.  A null or empty text is one empty line; repeated rows are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                bins, size, rows = line_features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                got = shared.value.score(bins, size, rows, j - i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, predicted int")


def accepted(docs: DataFrame, model: LineCRF, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches ``threshold``.

    Rows are filtered where they are read: no join, whatever ids repeat or are null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column(text).cast(pa.string()))
            scores = []
            for i, j in slices(offsets):
                bins, size, rows = line_features(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                scores.append(shared.value.score(bins, size, rows, j - i))
            yield batch.filter(pa.array(np.concatenate([*scores, np.zeros(0)]) >= threshold))
        give_back()

    return docs.mapInArrow(keep, docs.schema)
