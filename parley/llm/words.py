"""Words, hashes and shingles of whole Arrow text columns.

A word is a run of bytes other than space and \\x09-\\x0D.  All words of a batch
are hashed together by numpy over the UTF-8 buffer; no Python object is made
per word.  The hash has 64 bits and is the same on every machine.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers (the splitmix64 finaliser)."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(CHUNK, 1 << (n - 1).bit_length())
    if size not in _powers:
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        table = []
        for base in (BASE, inverse):
            steps = np.full(size + 1, base, dtype=np.uint64)
            steps[0] = 1
            table.append(np.multiply.accumulate(steps))
        _powers[size] = (table[0], table[1])
    return _powers[size]


class Words:
    """The words of a text column.

    hash[i], start[i], stop[i]: word i and its place in ``data``;
    first[d] .. first[d + 1]: the words of text d.
    """

    def __init__(self, column: pa.Array, lower: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        column = column.fill_null("").cast(pa.large_string())
        n = len(column)
        offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)
        offsets = offsets[column.offset : column.offset + n + 1]
        if n == 0:
            offsets = np.zeros(1, dtype=np.int64)
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data = data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets = offsets - offsets[0]
        ink = ~_SPACE[data]
        begins, ends = ink.copy(), ink.copy()
        begins[1:] &= ~ink[:-1]
        ends[:-1] &= ~ink[1:]
        edges = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[edges] |= ink[edges]
        edges = edges[edges > 0] - 1
        ends[edges] |= ink[edges]
        self.start = np.flatnonzero(begins)
        self.stop = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.hash = self._hashes(lower)

    def _hashes(self, lower: bool) -> np.ndarray:
        out = np.empty(len(self.start), dtype=np.uint64)
        i = 0
        while i < len(out):
            at = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.stop, at + CHUNK, side="right")))
            part = self.data[at : self.stop[j - 1]].astype(np.uint64)
            if lower:
                part += ((part >= 65) & (part <= 90)).astype(np.uint64) * np.uint64(32)
            up, down = power_table(len(part))
            part += np.uint64(1)
            part *= up[: len(part)]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)))
            a, b = self.start[i:j] - at, self.stop[i:j] - at
            out[i:j] = mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64))
            i = j
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1 joined by single spaces."""
        return b" ".join(self.data[self.start[i] : self.stop[j - 1]].tobytes().split()) if j > i else b""


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each k consecutive entries (across text borders too)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, factor = np.zeros(n, dtype=np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            total += hashes[j : j + n] * factor
            factor *= BASE
    return mix(total)


def parts(batch: pa.RecordBatch, column: str, size: int = 4 << 20):
    """Cut a batch into slices of about ``size`` bytes of text, at least one row each."""
    texts = batch.column(column)
    lengths = np.asarray(pa.compute.binary_length(texts).fill_null(0)).astype(np.int64)
    total = np.cumsum(lengths)
    i = 0
    while i < batch.num_rows:
        before = total[i - 1] if i else 0
        j = max(i + 1, int(np.searchsorted(total, before + size, side="right")))
        yield batch.slice(i, j - i)
        i = j
