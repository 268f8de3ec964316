"""Fill-in-the-middle documents, cut with a wavelet matrix over character classes.

A text is a run of units: every run of ASCII letters is one unit, every other character is one of its own.  The
UTF-8 bytes of a slice of texts are mapped to eight classes (``CONTINUED`` byte, ``INNER`` letter of a run,
``HEAD`` letter, digit, white space, other ASCII, first byte of a longer character) and stored as a wavelet matrix:
one bit vector a level with popcounts by word, so that the occurrences of a class before any position come from one
rank a level.  Two ranks combine into what is needed:

- units begun before position i: i - rank(CONTINUED, i) - rank(INNER, i);
- characters before position i: i - rank(CONTINUED, i).

A cut after k units is the position where unit k + 1 begins.  All cuts of a slice are found together, by bisection
on the boundary counts, and the ranks at the cuts give the lengths in characters.  No list of units is ever made.

Forms: ``psm`` writes prefix, suffix, middle; ``spm`` suffix, prefix, middle; ``plain`` leaves the text as it is.
A text that holds one of the markers is always plain, so that every output can be turned back exactly
(``restore``).

Defined results: a null text is empty, and an empty text is plain with no units.  Very long texts are cut whole; a
task holds one slice of ``textkit.SLICE_BYTES`` or one longer text, at about 12 bytes a byte of text.  Draws depend
on seed and id alone: repeated rows and rows that share an id (or have none) get equal draws, and there are no ties
to break.  Empty table: no rows.  Other columns pass through; the result column takes the name that the caller gives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm import textkit as tk

CONTINUED, INNER, HEAD, DIGIT, SPACE, OTHER, WIDE = range(7)
LEVELS = 3
MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM = 90  # h3 % 100 at or over this: plain
SPM_BELOW = 20  # h4 % 100 under this: suffix first

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[128:192] = CONTINUED
_CLASS[192:] = WIDE
_CLASS[48:58] = DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[_LETTER] = HEAD


class WaveletMatrix:
    """A sequence of small numbers; ``rank`` counts a number before any positions, ``select`` finds its k-th place."""

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.n, self.levels = len(symbols), levels
        self.bits, self.ones, self.zeros = [], [], []
        s = symbols
        for level in range(levels - 1, -1, -1):
            b = (s >> np.uint8(level)) & np.uint8(1)
            packed = np.packbits(b, bitorder="little")
            words = np.zeros((self.n >> 6) + 1, "<u8")
            words.view(np.uint8)[:len(packed)] = packed
            ones = np.zeros(len(words) + 1, np.int64)
            np.cumsum(np.bitwise_count(words), out=ones[1:])
            self.bits.append(words)
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            up = b.view(bool)
            s = np.concatenate([s[~up], s[up]])

    def _rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        word, off = i >> 6, (i & 63).astype(np.uint64)
        low = self.bits[level][word] & ((np.uint64(1) << off) - np.uint64(1))
        return self.ones[level][word] + np.bitwise_count(low)

    def rank(self, symbol: int, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` at positions below i, for every i in 0..n."""
        begin, i = np.zeros(1, np.int64), np.asarray(i, np.int64)
        for level in range(self.levels):
            if symbol >> (self.levels - 1 - level) & 1:
                begin, i = (self.zeros[level] + self._rank1(level, x) for x in (begin, i))
            else:
                begin, i = (x - self._rank1(level, x) for x in (begin, i))
        return i - begin

    def select(self, symbol: int, k: np.ndarray) -> np.ndarray:
        """Position of the k-th ``symbol`` (from 0), by bisection on ranks; n where there are not that many."""
        return first_at(lambda i: self.rank(symbol, i), np.asarray(k, np.int64) + 1, np.zeros(len(k), np.int64),
                        np.full(len(k), self.n, np.int64) + 1) - 1


def first_at(count, want: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The first position of [lo, hi] where the rising ``count`` reaches ``want`` (hi if it never does), all at once."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        live = np.flatnonzero(lo < hi)
        if not len(live):
            return lo
        mid = (lo[live] + hi[live]) >> 1
        below = count(mid) < want[live]
        lo[live[below]] = mid[below] + 1
        hi[live[~below]] = mid[~below]


class UnitIndex:
    """The wavelet matrix of a slice of texts, with the two counts that its ranks combine into."""

    def __init__(self, raw: np.ndarray, off: np.ndarray):
        self.off = off
        c = _CLASS[raw]
        letter = _LETTER[raw]
        inner = np.zeros(len(raw), bool)
        inner[1:] = letter[1:] & letter[:-1]
        inner[off[:-1][off[:-1] < len(raw)]] = False  # a text's first letter continues nothing
        c[inner] = INNER
        self.matrix = WaveletMatrix(c)

    def units(self, i: np.ndarray) -> np.ndarray:
        """Units begun before byte i of the slice."""
        return i - self.matrix.rank(CONTINUED, i) - self.matrix.rank(INNER, i)

    def chars(self, i: np.ndarray) -> np.ndarray:
        """Characters begun before byte i of the slice."""
        return i - self.matrix.rank(CONTINUED, i)

    def totals(self) -> np.ndarray:
        """Units of every text."""
        return np.diff(self.units(self.off))

    def cut(self, texts: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The byte after the first k units of each given text: where its next unit begins, or the text's end."""
        lo, hi = self.off[texts], self.off[texts + 1]
        return first_at(lambda i: self.units(i + 1), self.units(lo) + k + 1, lo, hi)


_TYPE = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
                   ("text", pa.string())])
_DDL = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,text:string>"


def transform(texts: pa.Array, draws: np.ndarray, marks: tuple[str, str, str] = MARKS, plain_from: int = PLAIN_FROM,
              spm_below: int = SPM_BELOW) -> pa.Array:
    """One struct (n, form, prefix_chars, middle_chars, text) a text; ``draws``: four numbers a text."""
    p_mark, s_mark, m_mark = (m.encode() for m in marks)
    raw, off = tk.buffers(texts)
    n_units, form, prefix, middle, out = [], [], [], [], []
    for i, j, buf, o in tk.sliced(raw, off):
        index = UnitIndex(buf, o)
        n, h = index.totals(), draws[i:j]
        data = buf.tobytes()
        marked = np.array([any(m in data[a:b] for m in (p_mark, s_mark, m_mark)) for a, b in zip(o[:-1], o[1:], strict=True)])
        plain = (o[1:] == o[:-1]) | marked | (h[:, 2] % 100 >= plain_from)
        at = np.flatnonzero(~plain)
        ends = np.sort(h[:, :2] % (n + 1)[:, None], 1)
        a, b = index.cut(at, ends[at, 0]), index.cut(at, ends[at, 1])
        start = index.chars(o[at])
        ca, cb = index.chars(a), index.chars(b)
        pre, mid = np.zeros((2, j - i), np.int64)
        pre[at], mid[at] = ca - start, cb - ca
        whole = [data[x:y] for x, y in zip(o[:-1], o[1:], strict=True)]
        kind = np.full(j - i, "plain", object)
        for d, x, y in zip(at, a, b, strict=True):
            parts = data[o[d]:x], data[x:y], data[y:o[d + 1]]
            if h[d, 3] % 100 < spm_below:
                kind[d], whole[d] = "spm", b"".join((s_mark, parts[2], p_mark, parts[0], m_mark, parts[1]))
            else:
                kind[d], whole[d] = "psm", b"".join((p_mark, parts[0], s_mark, parts[2], m_mark, parts[1]))
        n_units.append(n)
        form += kind.tolist()
        prefix.append(np.ma.array(pre, mask=plain))
        middle.append(np.ma.array(mid, mask=plain))
        out += whole
    if not out:
        return pa.array([], _TYPE)
    cols = [pa.array(np.concatenate(n_units)), pa.array(form, pa.string()),
            *[pa.array(np.concatenate([x.data for x in c]), mask=np.concatenate([x.mask for x in c])) for c in (prefix, middle)],
            pa.array(out, pa.binary()).cast(pa.string())]
    return pa.StructArray.from_arrays(cols, fields=list(_TYPE))


def with_fim(docs: DataFrame, out: str, text_col: str = "text", id_col: str = "doc_id", seed: int = 1,
             marks: tuple[str, str, str] = MARKS, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``docs`` with a struct column ``out``: n (units), form, prefix_chars, middle_chars (null if plain), text.

    The draws are the first four 8-digit groups of the hex sha256 of ``<seed>:<id>``: two cuts, plain or not, order.
    A null id draws as an empty one.
    """

    @arrow_udf(_DDL)
    def run(texts: pa.Array, digest: pa.Array) -> pa.Array:
        draws = np.frombuffer(bytes.fromhex("".join(d[:32] for d in digest.to_pylist())), ">u4").reshape(-1, 4).astype(np.int64)
        return transform(texts, draws, marks, plain_from, spm_below)

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return docs.withColumn(out, run(F.col(text_col), digest))


def restore(text: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that a ``with_fim`` output was made from, by its markers and form alone."""
    parts = F.split(text, "|".join(rf"\Q{m}\E" for m in marks), -1)
    return (F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
            .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(text))
