"""Elias-Fano sequences in numpy, kept in memory-mapped files and queried in batches."""

from __future__ import annotations

import os

import numpy as np

_ONE, _64 = np.uint64(1), np.uint64(64)


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` low bits of every value, one after the other, in 64-bit words."""
    n = len(values)
    out = np.zeros((n * bits >> 6) + 2, np.uint64)
    if bits and n:
        at = np.arange(n, dtype=np.uint64) * np.uint64(bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        np.bitwise_or.at(out, word, values << off)
        over = off + np.uint64(bits) > _64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (_64 - off[over]))
    return out


def _select_in_word(w: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Position of the k-th (from 0) set bit of every word."""
    pos = np.zeros(len(w), np.int64)
    w, k = w.copy(), k.astype(np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        ones = np.bitwise_count(w & np.uint64((1 << half) - 1)).astype(np.int64)
        up = k >= ones
        k = np.where(up, k - ones, k)
        pos += np.where(up, half, 0)
        w = np.where(up, w >> np.uint64(half), w)
    return pos


class EliasFano:
    """A non-decreasing sequence of n numbers below 2**63 in about 2 + log2(universe / n) bits each.

    The low bits lie packed; the high parts are a bit vector in which element i with high part h sets bit h + i.
    """

    def __init__(self, values: np.ndarray, folder: str, name: str):
        v = values.astype(np.uint64)
        self.n = len(v)
        top = int(v[-1]) + 1 if self.n else 1
        self.low_bits = max(0, (top // max(self.n, 1)).bit_length() - 1)
        high = (v >> np.uint64(self.low_bits)).astype(np.int64)
        size = (int(high[-1]) if self.n else 0) + self.n + 1
        upper = np.zeros((size >> 6) + 1, np.uint64)
        at = high + np.arange(self.n)
        np.bitwise_or.at(upper, at >> 6, _ONE << (at & 63).astype(np.uint64))
        low = _pack(v & np.uint64((1 << self.low_bits) - 1), self.low_bits)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)])
        self.paths = []
        for part, a in (("upper", upper), ("low", low), ("ones", ones)):
            path = os.path.join(folder, f"{name}.{part}")
            a.tofile(path)
            self.paths.append(path)
        self.upper = np.memmap(self.paths[0], np.uint64, "r")
        self.low = np.memmap(self.paths[1], np.uint64, "r")
        self.ones = np.memmap(self.paths[2], np.int64, "r")
        self.zeros = np.arange(len(ones)) * 64 - ones

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.low_bits)
        word, off = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        x = self.low[word] >> off
        over = off + np.uint64(self.low_bits) > _64
        x[over] |= self.low[word[over] + 1] << (_64 - off[over])
        return x & np.uint64((1 << self.low_bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """Element i, for every i."""
        if not len(i):
            return np.zeros(0, np.int64)
        word = np.searchsorted(self.ones, i, "right") - 1
        bit = _select_in_word(self.upper[word], i - self.ones[word])
        high = word * 64 + bit - i
        return ((high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)).astype(np.int64)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many elements have a high part below h."""
        out = np.zeros(len(h), np.int64)
        on = h > 0
        k = h[on] - 1  # the k-th zero ends the run of high part k
        last = int(self.zeros[-1])
        k_in = np.minimum(k, last - 1)
        word = np.searchsorted(self.zeros, k_in, "right") - 1
        bit = _select_in_word(~self.upper[word], k_in - self.zeros[word])
        out[on] = np.where(k < last, np.minimum(word * 64 + bit - k_in, self.n), self.n)
        return out

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Position of the first element >= x (n if there is none), for every x."""
        x = x.astype(np.uint64)
        h = (x >> np.uint64(self.low_bits)).astype(np.int64)
        lo, hi = self._before(h), self._before(h + 1)
        want = x & np.uint64((1 << self.low_bits) - 1)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) >> 1
            less = self._low(mid) < want[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
