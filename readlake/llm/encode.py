"""Whole texts to token ids by the ``tokenizers`` library, at a few megabytes a second and core.

The library takes about 10 µs a word.  Both vocabularies cut a text at white space before any merge, so a piece
between two cuts always gives the same ids.  A batch is cut into pieces, equal pieces are found by a 64-bit hash, and
only pieces that the worker hasn't met go to the library (many at a time, with a separator whose id is known).
What is known is kept in sorted arrays of bounded size and lives as long as the Python worker.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

import numpy as np
import pandas as pd

from readlake.llm.textkit import _SPACE, U64, ragged, slices, span_hashes, word_spans

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[list(b".,!|?;:*%#&$")] = True  # never part of a contraction, so a cut beside a letter is safe
#: White space outside ASCII, as UTF-8.
_WIDE_SPACE = [c.encode() for c in map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]


class Encoder:
    """Ids of texts for one tokenizer file.  ``max_known`` bounds the pieces kept in memory."""

    def __init__(self, path: str, max_known: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        self.keeps_space = spec["normalizer"] is None  # byte-level: white space has ids of its own
        self.separator = "\n" if self.keeps_space else " 0 "
        self.separator_id = self._one(self.separator)[0]
        added = [re.escape(t["content"].encode()) for t in spec["added_tokens"]]
        self.added = re.compile(b"|".join(added)) if added else None
        self.max_known = max_known
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, U64)
        self.at = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _one(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def _fits(self, piece: str) -> bool:
        bare = piece.removeprefix(" ") if self.keeps_space else piece
        return bool(bare) and bare.split() == [bare] and (self.keeps_space or "0" not in bare)

    def _library(self, pieces: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        fit = [k for k, p in enumerate(pieces) if self._fits(p)]
        groups = [fit[k : k + 500] for k in range(0, len(fit), 500)]
        texts = [self.separator.join(["", *(pieces[k] for k in g)]) for g in groups]
        left = set(range(len(pieces))) - set(fit)
        for group, got in zip(groups, self.lib.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.asarray(got.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.separator_id)
            if len(cuts) != len(group):
                left.update(group)
                continue
            for k, a, b in zip(group, cuts + 1, [*cuts[1:], len(ids)], strict=True):
                out[k] = ids[a:b]
        alone = sorted(left)
        for k, got in zip(alone, self.lib.encode_batch_fast([pieces[k] for k in alone], add_special_tokens=False), strict=True):
            out[k] = np.asarray(got.ids, np.uint32)
        return out

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        got = self._library(pieces)
        if len(self.keys) + len(keys) > self.max_known:
            self._forget()
        count = np.fromiter(map(len, got), np.int32, len(got))
        at = len(self.ids) + np.cumsum(count) - count
        order = np.argsort(keys)
        where = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, where, keys[order])
        self.at = np.insert(self.at, where, at[order])
        self.count = np.insert(self.count, where, count[order])
        self.ids = np.concatenate([self.ids, *got]) if got else self.ids

    def _pieces(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row of the pieces, in order."""
        starts, ends, rows = word_spans(buf, offsets)
        inner = np.zeros(len(buf) + 1, bool)
        if len(buf):
            letter, mark = _LETTER[buf], _MARK[buf]
            inner[1:-1] = letter[:-1] & mark[1:] | mark[:-1] & letter[1:]
        if not self.keeps_space:
            cut = np.flatnonzero(inner)
            # a cut beside a row's end is already a word's end
            own = np.searchsorted(starts, cut, "right") - 1
            ok = (own >= 0) & (cut > starts[own]) & (cut < ends[own]) if len(starts) else np.zeros(len(cut), bool)
            all_starts = np.sort(np.concatenate([starts, cut[ok]]))
            all_ends = np.sort(np.concatenate([ends, cut[ok]]))
            return all_starts, all_ends, np.searchsorted(offsets, all_starts, "right") - 1
        edge = inner
        edge[starts] = True
        edge[ends] = True
        edge[offsets] = True
        # the last blank before a word belongs to it; another white-space byte there stands alone
        head = starts[starts > offsets[rows]] if len(starts) else starts
        edge[head - 1] = True
        edge[head[buf[head - 1] == 0x20]] = False
        # white space before a row's end is one piece; ends[] has cut it from the word before
        edge[[0, len(buf)]] = True
        at = np.flatnonzero(edge)
        return at[:-1], at[1:], np.searchsorted(offsets, at[:-1], "right") - 1

    def _odd_rows(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that the library must see whole: an added token's text has an id of its own, and where wide white
        space touches ASCII white space a cut could change the ids."""
        added = [m.start() for m in self.added.finditer(buf)] if self.added else []
        spelled = np.unique(np.searchsorted(offsets, np.array(added, np.int64), "right") - 1)
        return np.union1d(spelled, self._wide_rows(buf, offsets)) if self.keeps_space else spelled

    def _wide_rows(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        lead = np.flatnonzero(np.isin(buf, np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)))
        rows = np.searchsorted(offsets, lead, "right") - 1
        odd = set()
        for p, r in zip(lead.tolist(), rows.tolist(), strict=True) if len(lead) < 1000 else self._near_space(buf, lead, rows):
            w = next((len(s) for s in _WIDE_SPACE if buf[p : p + len(s)].tobytes() == s), 0)
            if w and (p > offsets[r] and _SPACE[buf[p - 1]] or p + w < offsets[r + 1] and _SPACE[buf[p + w]]):
                odd.add(r)
        return np.array(sorted(odd), np.int64)

    @staticmethod
    def _near_space(buf: np.ndarray, lead: np.ndarray, rows: np.ndarray):
        n = len(buf)
        near = _SPACE[buf[np.maximum(lead - 1, 0)]] | _SPACE[buf[np.minimum(lead + 2, n - 1)]] | _SPACE[buf[np.minimum(lead + 3, n - 1)]]
        second = buf[np.minimum(lead + 1, n - 1)]
        first = buf[lead]
        can = (first == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (first == 0xE1) & (second == 0x9A) | (first == 0xE2) & ((second == 0x80) | (second == 0x81)) | (first == 0xE3) & (second == 0x80)
        keep = near & can
        return zip(lead[keep].tolist(), rows[keep].tolist(), strict=True)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids (unsigned 32-bit) of the rows of a slice one after another, and the number of each row."""
        starts, ends, rows = self._pieces(buf, offsets)
        n_rows = len(offsets) - 1
        keys = span_hashes(buf, starts, ends)
        codes, known = pd.factorize(keys)
        if len(known):
            where = np.searchsorted(self.keys, known)
            missing = np.ones(len(known), bool)
            if len(self.keys):
                missing = self.keys[np.minimum(where, len(self.keys) - 1)] != known
            if missing.any():
                first = np.empty(len(known), np.int64)
                first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
                raw = buf.tobytes()
                new = np.flatnonzero(missing)
                if len(self.keys) + len(new) > self.max_known:
                    new = np.arange(len(known))  # what is known is dropped below: learn this slice whole
                self._learn(known[new], [raw[starts[k] : ends[k]].decode() for k in first[new]])
                where = np.searchsorted(self.keys, known)
        else:
            where = np.zeros(0, np.int64)
        count = self.count[where][codes].astype(np.int64)
        ids = self.ids[ragged(self.at[where][codes], count)]
        per_row = np.bincount(rows, count, n_rows).astype(np.int64) if len(rows) else np.zeros(n_rows, np.int64)
        odd = self._odd_rows(buf, offsets)
        if len(odd):
            parts = np.split(ids, np.cumsum(per_row)[:-1])
            for r in odd:
                parts[r] = np.asarray(self._one(buf[offsets[r] : offsets[r + 1]].tobytes().decode()), np.uint32)
                per_row[r] = len(parts[r])
            ids = np.concatenate(parts)
        return ids, per_row

    def encode_with_end(self, buf: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode``, each row closed by ``end_id``; long batches go slice by slice."""
        all_ids, all_counts = [], []
        for i, j in slices(offsets):
            ids, n = self.encode(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            out = np.full(len(ids) + len(n), end_id, np.uint32)
            spot = np.ones(len(out), bool)
            spot[np.cumsum(n + 1) - 1] = False
            out[spot] = ids
            all_ids.append(out)
            all_counts.append(n + 1)
        if not all_ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(all_ids), np.concatenate(all_counts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``; kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
