"""Vectorised views of text columns: words, lines and their 64-bit hashes, straight from Arrow buffers.

The helpers work on slices of a record batch (``slices``) of about ``SLICE_BYTES`` of UTF-8, so the
scratch arrays stay small however many rows a batch has; one longer text makes a slice of its own.
A span hash is ``sum(T[byte] * P**i)`` modulo 2**64 with a random table ``T``, read from a running
sum, so any span costs two look-ups; ``mix`` scrambles the bits afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Space and the control characters \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True

_RNG = np.random.Generator(np.random.PCG64(20240607))
_TABLE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, 2 * SLICE_BYTES)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slice:
    """Rows [first, last) of a text column: their bytes, and where each row starts and ends in them."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, first: int) -> None:
        self.data, self.bounds, self.first = data, bounds, first
        self.rows = len(bounds) - 1
        self._sums: np.ndarray | None = None

    def runs(self, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal spans without break bytes: start, end (byte positions in the slice) and row of each."""
        gap = breaks[self.data]
        inside = np.concatenate(([False], ~gap, [False]))
        starts_new = np.zeros(len(self.data) + 1, bool)
        starts_new[self.bounds] = True
        begin = np.flatnonzero(inside[1:] & (~inside[:-1] | starts_new))
        end = np.flatnonzero(inside[:-1] & (~inside[1:] | starts_new))
        return begin, end, np.searchsorted(self.bounds, begin, "right") - 1

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        up, down = _power(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_TABLE[self.data] * up[: len(self.data)], out=self._sums[1:])
        return mix((self._sums[end] - self._sums[begin]) * down[begin] + (end - begin).astype(np.uint64))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash and row of each word (run of characters that are not white space)."""
        begin, end, row = self.runs(SPACE)
        return self.hashes(begin, end), row


def slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Slices of a string column in row order; null counts as the empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    yield from slices_of_bytes(texts, limit)


def slices_of_bytes(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """The same of a column of strings or byte strings without nulls."""
    if pa.types.is_binary(texts.type):
        texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield Slice(data[at[first] : at[last]], at[first : last + 1] - at[first], first)
        first = last


def windows(words: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word's index of each window of ``size`` words inside one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[size - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * np.uint64(_BASE) + words[at + k]
    return mix(out), at


def per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sum of the values of each row."""
    return np.bincount(row, values, rows).astype(np.int64) if len(row) else np.zeros(rows, np.int64)
