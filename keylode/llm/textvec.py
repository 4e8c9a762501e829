"""Vectorised words and shingles over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D after A-Z became
lower case.  Texts are hashed as they lie in the Arrow buffer, a bounded slice at a
time, so a very long text needs no more memory than the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
_U = np.uint64

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets, np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def parts(batch: pa.RecordBatch, column: str, rows: int, size: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `rows` rows and about `size` bytes of text, one row
    at least."""
    offsets, first = buffers(batch.column(column))[0], 0
    while first < batch.num_rows:
        to = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        to = min(batch.num_rows, first + rows, max(first + 1, to))
        yield batch.slice(first, to - first)
        first = to


def _hash_slice(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of a slice; no word crosses a break."""
    if not raw.size:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, _U)
    space = _SPACE[raw]
    cut = np.zeros(raw.size, dtype=bool)
    cut[breaks[breaks < raw.size]] = True
    cut[0] = True
    cut[1:] |= space[:-1]
    starts = np.flatnonzero(cut & ~space)
    if not starts.size:
        return starts, starts, np.zeros(0, _U)
    last = np.ones(raw.size, dtype=bool)
    last[:-1] = cut[1:] | space[1:]
    ends = np.flatnonzero(last & ~space) + 1
    begin = np.zeros(raw.size, dtype=np.int64)
    begin[starts] = starts
    at = np.arange(raw.size, dtype=np.int64) - np.maximum.accumulate(begin)
    weights = stream(1, int((ends - starts).max()))
    part = _LOWER[raw].astype(_U) + _U(1)
    at[space] = 0
    part *= weights[at]
    part[space] = 0
    return starts, ends, mix(np.add.reduceat(part, starts) + (ends - starts).astype(_U))


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, the first word of each row (rows + 1 numbers), and each
    word's first and end byte within its row's text."""
    offsets, raw = buffers(column)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(end, lo + SLICE)
        if hi < end:  # never inside a word: at a row's start, else after a space, else further on
            row = int(offsets[np.searchsorted(offsets, hi, side="right") - 1])
            if row > lo:
                hi = row
            else:
                back = np.flatnonzero(_SPACE[raw[lo:hi]])
                if back.size:
                    hi = lo + int(back[-1]) + 1
                else:
                    stop = int(offsets[np.searchsorted(offsets, hi, side="left")])
                    while hi < stop and not _SPACE[raw[hi]]:
                        ahead = np.flatnonzero(_SPACE[raw[hi : min(stop, hi + SLICE)]])
                        hi = hi + int(ahead[0]) if ahead.size else min(stop, hi + SLICE)
        a, b = np.searchsorted(offsets, lo, side="left"), np.searchsorted(offsets, hi, side="left")
        s, e, h = _hash_slice(raw[lo:hi], offsets[a:b] - lo)
        found.append((s + lo, e + lo, h))
        lo = hi
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), np.zeros(len(offsets), np.int64), none, none
    starts, ends, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    first = np.searchsorted(starts, offsets, side="left")
    base = np.repeat(offsets[:-1], np.diff(first))
    return hashes, first, starts - base, ends - base


def shingle_body(hashes: np.ndarray, k: int = 5) -> np.ndarray:
    """The hash of each k consecutive words; shingles across rows are among them."""
    keys = stream(2, k + 1)
    body = np.zeros(max(0, hashes.size - k + 1), _U)
    for j in range(k):
        body += hashes[j : j + body.size] * keys[j]
    return mix(body)


def shingles(hashes: np.ndarray, first: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """For each row the hashes of its k-word shingles by position; with fewer words
    the whole sequence as one, without words none."""
    keys, body = stream(2, k + 1), shingle_body(hashes, k)
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            yield body[a : b - k + 1]
        elif b > a:
            yield mix((hashes[a:b] * keys[: b - a]).sum(dtype=_U, keepdims=True) + keys[k : k + 1] * _U(b - a))
        else:
            yield body[:0]
