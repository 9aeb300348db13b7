"""Words of many texts at once, as 64-bit hashes, for the operators on shingles and passages.

A word is a run of bytes other than ASCII white space. Texts come as Arrow arrays; the work is numpy over blocks of
about a quarter of a megabyte, so temporary memory does not depend on the number or the length of the texts in a batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_CODES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit values spread over the whole word (a public finaliser: two xor-shifts and two products)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


Batches = Iterator[pa.RecordBatch]


def returning_memory(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """The task function, which gives freed memory back to the system when it ends: Python workers outlive their tasks, and what an idle
    one keeps is missing from the executor."""

    @functools.wraps(run)
    def wrapped(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def release_memory() -> None:
    pa.default_memory_pool().release_unused()
    # where the C library has no such call it trims by itself
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, grown on demand and kept for ordinary blocks."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def first(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, BLOCK_BYTES + 1)
            up = np.full(size, _BASE, np.uint64)
            down = np.full(size, _BASE_INVERSE, np.uint64)
            up[0] = down[0] = 1
            up, down = np.cumprod(up), np.cumprod(down)
            if n > 4 * BLOCK_BYTES:
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_powers = _Powers()


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; the texts lie end to end, text i at ``offsets[i]:offsets[i + 1]``."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    border = np.zeros(n + 1, bool)
    border[offsets] = True
    border[0] = border[n] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | border[1:n]
    ends = inside
    ends = ends.copy()
    ends[:-1] &= ~inside[1:] | border[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = _powers.first(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up, out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts])


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null is empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) else b"")
    n = len(column)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8)[offsets[0] : offsets[-1]] if values is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def blocks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``BLOCK_BYTES`` together, or of one longer text."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + BLOCK_BYTES, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text cut at white space near every ``BLOCK_BYTES``; a longer word stays whole."""
    low, n = 0, len(data)
    while low < n:
        high = low + BLOCK_BYTES
        while high < n:
            gap = np.flatnonzero(_SPACE[data[high : high + BLOCK_BYTES]])
            if len(gap):
                high += int(gap[0])
                break
            high += BLOCK_BYTES
        yield data[low : min(high, n)]
        low = high


def word_hashes(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block of texts: number of its first text, hashes of all its words, and where the words of each text
    begin among them (one more entry than texts)."""
    data, offsets = texts_of(column)
    for low, high in blocks(offsets):
        part = data[offsets[low] : offsets[high]]
        if lower:
            part = _LOWER[part]
        if high - low == 1 and len(part) > BLOCK_BYTES:
            found = [_hashes(p, *spans(p, np.array([0, len(p)]))) for p in _pieces(part)]
            hashes = np.concatenate(found)
            yield low, hashes, np.array([0, len(hashes)])
        else:
            own = offsets[low : high + 1] - offsets[low]
            starts, ends = spans(part, own)
            yield low, _hashes(part, starts, ends), np.searchsorted(starts, own)


def _runs(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    factors = np.random.default_rng(seed).integers(1, 1 << 63, length, dtype=np.uint64) | np.uint64(1)
    n = len(words) - length + 1
    total = np.zeros(n, np.uint64)
    for j in range(length):
        total += words[j : j + n] * factors[j]
    return mixed(total)


def run_hashes(words: np.ndarray, length: int, seed: int = 5) -> np.ndarray:
    """Hash of every run of ``length`` consecutive words; runs across two texts are the caller's to leave out."""
    return _runs(words, length, seed) if len(words) >= length else np.zeros(0, np.uint64)
