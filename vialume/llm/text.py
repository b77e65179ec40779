"""Vectorised tokenisation of Arrow text columns.

Words are maximal runs of bytes outside ``0x20, 0x09-0x0D``, unchanged. Every routine works on the raw UTF-8 buffer of
a slice of rows, so no Python object per word is made. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer single text makes a slice of its own.
SLICE_BYTES = 2 << 20
#: Rows handled at once.
SLICE_ROWS = 1 << 13

#: A-Z as a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 9, 10, 11, 12, 13]] = False
#: Spans above this many bytes are hashed one by one with BLAKE2b, shorter ones eight bytes at a time.
LONG_SPAN = 256
#: Odd multipliers and start of each of the two independent lanes of a 128-bit hash.
LANES = ((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0x243F6A8885A308D3), (0xC2B2AE3D27D4EB4F, 0xA24BAED4963EE407, 0x13198A2E03707344))


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x7FB5D329728EA185)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x81DADEF4BC2DD44D)
    h ^= h >> np.uint64(33)
    return h


def column(batch: pa.RecordBatch | pa.Table, name: str) -> pa.Array:
    col = batch.column(name)
    return col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, dtype=np.int64, count=len(col) + 1, offset=col.offset * 8) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        hi = min(hi, lo + SLICE_ROWS, n)
        yield lo, hi
        lo = hi


class Bytes:
    """Text bytes that can be read eight at a time from any position."""

    def __init__(self, data: np.ndarray):
        self.size = len(data)
        self._padded = np.concatenate([data, np.zeros(8, np.uint8)])

    def eight(self, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The (at most) eight bytes at each position as a number; only ``left`` of them count."""
        rows = np.lib.stride_tricks.sliding_window_view(self._padded, 8)[at]
        chunk = np.ascontiguousarray(rows).view(np.uint64).ravel()
        drop = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
        return chunk << drop

    def same(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the spans of ``size`` bytes at ``a`` and at ``b`` are equal, byte by byte."""
        out = np.ones(len(a), dtype=bool)
        who = np.flatnonzero((size > 0) & (a != b))
        long = size[who] > LONG_SPAN
        for i in who[long].tolist():
            out[i] = np.array_equal(self._padded[a[i] : a[i] + size[i]], self._padded[b[i] : b[i] + size[i]])
        who, done = who[~long], 0
        while len(who):
            left = size[who] - done
            out[who] &= self.eight(a[who] + done, left) == self.eight(b[who] + done, left)
            done += 8
            who = who[(left > 8) & out[who]]
        return out


def span_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int = 0, read: Bytes | None = None) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes have equal hashes, wherever they stand.

    Each eight bytes pass a non-linear step, so no structure of the text (as of Thue-Morse words) makes hashes equal.
    The two lanes are independent; together they are a 128-bit hash.
    """
    times, by_size, start = (np.uint64(x) for x in LANES[lane])
    size = end - begin
    h = start ^ size.astype(np.uint64) * by_size
    read = read or Bytes(data)
    long = np.flatnonzero(size > LONG_SPAN)
    for i in long.tolist():
        digest = hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=16).digest()
        h[i] ^= np.uint64(int.from_bytes(digest[8 * lane : 8 * lane + 8], "little"))
    who, done = np.flatnonzero((size > 0) & (size <= LONG_SPAN)), 0
    while len(who):
        left = size[who] - done
        h[who] = mix(h[who] ^ read.eight(begin[who] + done, left) * times)
        done += 8
        who = who[left > 8]
    return mix(h)


class Words:
    """The words of a slice of rows: byte spans, 64-bit hashes (with ``wide`` a second, independent lane), and the first word of each row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fold: bool = False, wide: bool = False):
        n = len(data)
        inside = IS_WORD[data]
        first = np.zeros(n + 1, dtype=bool)
        first[offsets] = True
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1] | first[1:n]
            ends[:-1] &= ~inside[1:] | first[1:n]
        self.data = data
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.offsets = np.searchsorted(self.begin, offsets)
        seen = FOLD[data] if fold else data
        read = Bytes(seen)
        self.hash = span_hashes(seen, self.begin, self.end, 0, read)
        self.hash2 = span_hashes(seen, self.begin, self.end, 1, read) if wide else None

    def __len__(self) -> int:
        return len(self.begin)

    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Start (word index) and hash of each run of ``k`` words inside one row."""
        n = len(self.begin) - k + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        h = np.zeros(n, dtype=np.uint64)
        for j in range(k):
            h *= np.uint64(0xC2B2AE3D27D4EB4F)
            h += self.hash[j : j + n]
        row = self.rows()
        at = np.flatnonzero(row[:n] == row[k - 1 :])
        return at, mix(h[at])


def spans(batch: pa.RecordBatch, name: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(first row, row after the last, bytes, offsets)`` for each slice of a batch."""
    data, offsets = utf8(column(batch, name))
    for lo, hi in slices(offsets, most):
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
