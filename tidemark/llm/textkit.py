"""Whole-batch text scanning for Python tasks: words and their hashes straight from Arrow's byte buffers.

A batch of texts is one UTF-8 byte array plus offsets.  Words are found by
comparing a byte mask with itself shifted by one, and every word's 64-bit
hash comes from one running sum of ``(byte + 1) * P**i``: the difference of
two prefix values is the word's polynomial hash times ``P**start``, which the
inverse powers take off.  Nothing steps through bytes or words in Python.

Nulls count as empty texts everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


class _Powers:
    """Powers of _P and of its inverse, made when first asked for; never part of what travels to the tasks."""

    def __init__(self):
        self.tables = (np.zeros(0, np.uint64),) * 2

    def __reduce__(self):
        return _Powers, ()

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tables[0]) < n:
            out = []
            for base in (_P, _P_INV):
                t = np.full(max(n, SLICE_BYTES + 1), base, dtype=np.uint64)
                t[0] = 1
                out.append(np.cumprod(t, dtype=np.uint64))
            self.tables = (out[0], out[1])
        return self.tables


_powers = _Powers()

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: ``[^\x20\x09-\x0D]+`` on bytes: everything but ASCII white space.
SPACED = np.ones(256, dtype=bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: ASCII digits and letters, and all other characters.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), so that near inputs spread over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64, n + 1, texts.offset * 8)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


def sliced(raw: np.ndarray, off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of whole texts of about ``limit`` bytes (one longer text alone)."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, raw[off[i]:off[j]], off[i:j + 1] - off[i]
        i = j


class Words:
    """The words of a slice: start and end byte, and ``bounds``: words bounds[d]..bounds[d+1] belong to text d."""

    __slots__ = ("buf", "start", "end", "bounds")

    def __init__(self, raw: np.ndarray, off: np.ndarray, inside: np.ndarray, lower: bool = True):
        self.buf = LOWER[raw] if lower else raw
        m = inside[self.buf]
        s, e = m.copy(), m.copy()
        if len(m):
            s[1:] &= ~m[:-1]
            e[:-1] &= ~m[1:]
            heads = off[:-1][off[:-1] < len(m)]
            s[heads] = m[heads]
            tails = off[1:][off[1:] > 0] - 1
            e[tails] = m[tails]
        self.start = np.flatnonzero(s)
        self.end = np.flatnonzero(e) + 1
        self.bounds = np.searchsorted(self.start, off)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def hashes(self, first: int | None = None) -> np.ndarray:
        """One uint64 per word, of the whole word or of its ``first`` bytes."""
        up, down = _powers.upto(len(self.buf) + 1)
        c = np.zeros(len(self.buf) + 1, np.uint64)
        np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * up[:len(self.buf)], out=c[1:])
        end = self.end if first is None else np.minimum(self.end, self.start + first)
        return mix64((c[end] - c[self.start]) * down[self.start])

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with one space after each, as (bytes, starts, ends): words i..j fill starts[i]..ends[j]."""
        size = self.end - self.start
        begin = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size + 1, out=begin[1:])
        out = np.full(begin[-1], 32, np.uint8)
        word = np.repeat(np.arange(len(size)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[begin[:-1][word] + at] = self.buf[self.start[word] + at]
        return out, begin[:-1], begin[:-1] + size


def run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` word hashes (len(h) - n + 1 of them), by the same running-sum rule."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = _powers.upto(len(h) + 1)
    c = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:len(h)], out=c[1:])
    return mix64((c[n:] - c[:-n]) * down[:len(h) - n + 1] + np.uint64(n))


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Indexes start[0]..start[0]+size[0]-1, start[1].. and so on, as one array."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
