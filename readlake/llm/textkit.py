"""Array helpers on Arrow text columns: word spans, 64-bit word hashes, shingles.

Everything works on the UTF-8 bytes of a batch.  Word breaks are the six ASCII white-space bytes
(0x09-0x0D, 0x20), which never occur inside a multi-byte character, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_STEP = 0x9E3779B97F4A7C15
_BASE = 0xD1342543DE82EF95
#: Bytes of text that one numpy pass takes; a longer document is a pass of its own.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(_STEP))
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def _base_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, b in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, b, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and where each row starts, with the end last."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, one row at least."""
    size = size or SLICE_BYTES
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every word ``[^\\x20\\x09-\\x0D]+``."""
    n = len(buf)
    if not n:
        e = np.zeros(0, np.int64)
        return e, e, e
    ink = ~_SPACE[buf]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = True, ~ink[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after[-1], after[:-1] = True, ~ink[1:]
    after[offsets[1:] - 1] = True
    starts = np.flatnonzero(ink & before)
    ends = np.flatnonzero(ink & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: a polynomial over the bytes by prefix sums, then mixed."""
    n = len(buf)
    power, inverse = _base_powers(n + 1)
    sums = np.zeros(n + 1, U64)
    np.cumsum(_TABLE[buf] * power[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_hashes(words: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each run of ``k`` words of one row, and the index of its first word."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.zeros(n, U64)
    factor = U64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += words[j : j + n] * factor
            factor = U64((int(factor) * _STEP) & 0xFFFFFFFFFFFFFFFF)
    first = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(total[first]), first


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``starts[i] .. starts[i]+lengths[i]-1`` one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def binary_column(data: np.ndarray, byte_lengths: np.ndarray) -> pa.Array:
    """An Arrow binary column over ``data``'s bytes, cut by ``byte_lengths``."""
    at = np.zeros(len(byte_lengths) + 1, np.int32)
    np.cumsum(byte_lengths, out=at[1:])
    return pa.Array.from_buffers(pa.binary(), len(byte_lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])
