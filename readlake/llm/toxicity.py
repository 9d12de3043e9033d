"""Toxicity by two Kneser-Ney models, one for each class, over one vocabulary.

Counts are Kneser-Ney's at every level: a word counts once for each word seen before it, a word pair once for each
word seen before the pair, so a phrase that copies repeat counts once.  A class's pair model backs off to its word
model, and that to equal chances for all words of both classes and one for unknown ones.
Discounts are Kneser-Ney's estimates from counts of counts, below 1.  A text's evidence is its length-normalised
log-likelihood ratio, toxic against ordinary, the largest such ratio of its runs of words for each length in
``spans``, both by the word model and by the pair model, and its length: a longest run's maximum grows with the text, and the link takes that off.  The logistic
link is fitted on evidence of models that haven't seen the text.

Words are lower-cased (A-Z) and punctuation at a word's ends doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from readlake.llm.labelled import fold, label_sample, sigmoid
from readlake.llm.textkit import LOWER, U64, binary_column, ragged, slices, span_hashes, text_bytes, word_spans

#: ASCII letters, digits and every byte of a non-ASCII character.
_INK = np.zeros(256, bool)
_INK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_EVIDENCE_WORDS = 100_000  # words whose evidence is made at once on the driver
_PARTS = 4  # parts of the sample; each gets its evidence from the others


def text_words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word without the punctuation at its ends; words of punctuation alone are left out."""
    low = LOWER[buf]
    starts, ends, rows = word_spans(low, offsets)
    if not len(starts):
        return np.zeros(0, U64), rows
    at = np.flatnonzero(_INK[low])
    first = np.searchsorted(at, starts)
    last = np.searchsorted(at, ends) - 1
    ok = first <= last
    return span_hashes(low, at[first[ok]], at[last[ok]] + 1), rows[ok]


def _before(words: np.ndarray, rows: np.ndarray, lag: int = 1) -> np.ndarray:
    """The word ``lag`` places back, 0 before a row's first."""
    out = np.zeros_like(words)
    same = rows[lag:] == rows[:-lag]
    out[lag:][same] = words[:-lag][same]
    return out


def _features(spans: tuple[int, ...]) -> int:
    return 1 + 2 * (1 + len(spans))


def _discount(counts: np.ndarray) -> float:
    """n1 / (n1 + 2 n2), Kneser and Ney's estimate from the numbers of kinds counted once and twice."""
    once, twice = (counts == 1).sum(), (counts == 2).sum()
    return float(np.clip(once / max(once + 2 * twice, 1), 0.1, 0.95))


@dataclass
class _Class:
    """One class over numbered words: their probabilities, the pairs' and every context's back-off weight."""

    prob: np.ndarray
    pairs: np.ndarray
    pair_prob: np.ndarray
    backoff: np.ndarray

    @classmethod
    def fit(cls, codes: np.ndarray, rows: np.ndarray, kinds: int) -> _Class:
        """``codes`` are 1 to ``kinds``; 0 is a text's start, ``kinds`` + 1 any unknown word."""
        base, even = kinds + 2, 1 / (kinds + 1)
        pair = _before(codes, rows).astype(np.int64) * base
        pair += codes
        pairs = np.unique(pair)
        triple = np.searchsorted(pairs, pair)
        del pair
        triple *= base
        triple += _before(codes, rows, 2)
        triple.sort()
        new = np.concatenate([[True], triple[1:] != triple[:-1]])[: len(triple)]
        n = np.bincount(triple[new] // base, minlength=len(pairs))
        del triple, new
        count = np.bincount(pairs % base, minlength=base).astype(float)
        total = max(count.sum(), 1)
        d = _discount(count[count > 0])
        freed = np.minimum(count, d).sum() / total if len(pairs) else 1.0
        prob = np.maximum(count - d, 0) / total + freed * even
        context = pairs // base
        size = np.bincount(context, n, base)
        d = _discount(n)
        left = np.bincount(context, minlength=base) * d
        backoff = np.where(size > 0, left / np.maximum(size, 1), 1.0)
        return cls(prob, pairs, ((n - d) / size[context]).astype(np.float32), backoff)

    def log_probs(self, codes: np.ndarray, prev: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the words alone, and after the words before them."""
        p, own = self.prob[codes], np.zeros(len(codes))
        if len(self.pairs):
            pair = prev.astype(np.int64) * len(self.prob) + codes
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            own = np.where(self.pairs[at] == pair, self.pair_prob[at], 0.0)
        return np.log(p), np.log(own + self.backoff[prev] * p)


@dataclass
class ToxicityModel:
    vocabulary: np.ndarray
    toxic: _Class
    ordinary: _Class
    spans: tuple[int, ...]
    weights: np.ndarray
    intercept: float = 0.0

    @classmethod
    def learn(cls, vocabulary: np.ndarray, codes: np.ndarray, rows: np.ndarray, toxic: np.ndarray, spans: tuple[int, ...]) -> ToxicityModel:
        """Both classes of the sample's words, numbered by ``vocabulary``; ``toxic`` tells it of each word's row."""
        parts = [_Class.fit(codes[own], rows[own], len(vocabulary)) for own in (toxic, ~toxic)]
        return cls(vocabulary, parts[0], parts[1], spans, np.zeros(_features(spans)))

    def codes(self, words: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.ones(len(words), np.int32)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == words, at + 1, len(self.vocabulary) + 1).astype(np.int32)

    def evidence(self, codes: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        """Per row the logarithm of its length and, for words alone and for words in context, the mean log-ratio and
        the largest mean of each span's runs (of all words, where there are fewer); 0 without words."""
        prev = _before(codes, rows)
        size = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows)
        out = [np.log1p(size)]
        for toxic, ordinary in zip(self.toxic.log_probs(codes, prev), self.ordinary.log_probs(codes, prev), strict=True):
            ratio = toxic - ordinary
            sums = np.concatenate([[0.0], np.cumsum(ratio)])
            mean = np.bincount(rows, ratio, n_rows) / np.maximum(size, 1) if len(rows) else np.zeros(n_rows)
            out.append(mean)
            for span in self.spans:
                most, n = np.full(n_rows, -np.inf), len(codes) - span + 1
                if n > 0:
                    first = np.flatnonzero(rows[:n] == rows[span - 1 :])
                    np.maximum.at(most, rows[first], (sums[first + span] - sums[first]) / span)
                out.append(np.where(np.isfinite(most), most, mean))
        return np.stack(out, 1)

    def score(self, words: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
        return sigmoid(self.evidence(self.codes(words), rows, n_rows) @ self.weights + self.intercept)


def _link(x: np.ndarray, y: np.ndarray, prior: float, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and intercept of P(y=1 | x) by damped Newton steps with a weak ridge, moved to the base rate ``prior``."""
    if not len(x) or y.min() == y.max():
        return np.zeros(x.shape[1]), float(np.log(prior / (1 - prior)))
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
    design = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.append(np.full(x.shape[1], 1e-4 * len(x)), 1e-6)
    w = np.zeros(design.shape[1])
    for _ in range(steps):
        p = sigmoid(design @ w)
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(ridge), design.T @ (p - y) + ridge * w)
        w -= np.clip(step, -2, 2)
        if abs(step).max() < 1e-6:
            break
    own = y.mean()
    shift = np.log(prior / (1 - prior)) - np.log(own / (1 - own))
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum() + shift)


def fit_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, toxic_docs: int = 2000, ordinary_docs: int = 6000, spans: tuple[int, ...] = (2, 4, 8)) -> ToxicityModel:
    """Fit on at most ``toxic_docs`` and ``ordinary_docs`` labelled documents outside the held-out fold.

    The driver gets the sample's word hashes, whose size those two bounds set.  Equal texts count once.  Without
    toxic or without ordinary rows every text gets the base rate.
    """
    sample = label_sample(labels, "toxic", folds, held_out, {1: toxic_docs, 0: ordinary_docs})

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                words, rows = text_words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, j - i), binary_column(words.view(np.uint8), np.bincount(rows, minlength=j - i) * 8)], names=["label", "words"])

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    got = own.join(F.broadcast(sample), "doc_id").select("label", "text").mapInArrow(hashes, "label int, words binary").toArrow()
    texts = pd.DataFrame({"words": got.column("words").to_pylist(), "toxic": got.column("label").to_numpy()}).drop_duplicates("words", keep="last")
    del got
    toxic = texts["toxic"].to_numpy().astype(bool)
    size = np.array([len(w) // 8 for w in texts["words"]], np.int64)
    part = np.array([int(np.bitwise_xor.reduce(np.frombuffer(w, U64))) % _PARTS for w in texts["words"]], int)
    words = np.frombuffer(b"".join(texts["words"]), U64)
    del texts
    vocabulary = np.unique(words)
    codes = (np.searchsorted(vocabulary, words) + 1).astype(np.int32)
    del words
    rows = np.repeat(np.arange(len(size), dtype=np.int32), size)
    model = ToxicityModel.learn(vocabulary, codes, rows, toxic[rows], spans)
    rate = labels.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out)).agg(F.avg(F.col("toxic").cast("int"))).first()[0]
    evidence = np.zeros((len(size), _features(spans)))
    begin = np.cumsum(size) - size
    for p in range(_PARTS):
        rest = (part != p)[rows]
        seen = ToxicityModel.learn(vocabulary, codes[rest], rows[rest], toxic[rows[rest]], spans)
        for own in np.array_split(np.flatnonzero(part == p), max(1, int(size[part == p].sum()) // _EVIDENCE_WORDS)):
            evidence[own] = seen.evidence(codes[ragged(begin[own], size[own])], np.repeat(np.arange(len(own)), size[own]), len(own))
        del seen, rest
    model.weights, model.intercept = _link(evidence, toxic.astype(int), min(max(rate or 0.0, 1e-3), 1 - 1e-3))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, score, predicted for every row; null and empty texts carry no evidence, repeated rows are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = text_bytes(batch.column("text"))
            for i, j in slices(offsets):
                words, rows = text_words(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                got = shared.value.score(words, rows, j - i)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(got), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(score, "doc_id long, score double, predicted int")
