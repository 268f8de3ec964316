"""Quality: a regularised quadratic discriminant over transformed document statistics.

Every whole text becomes ``NAMES``, a few statistics on scales where their spread is even (logarithms of sizes, square
roots of shares).  Each class is a normal distribution whose covariance is shrunk twice, towards the covariance that
both classes share (``lam``) and towards a multiple of the identity (``gam``).  Its Cholesky factor is inverted once
and cached in the model; a document's score is the difference of the two log densities, from two Mahalanobis
distances, turned into a probability by a logistic curve.

Fitting reads every labelled row: the tasks sum counts, sums and products by class, and Spark adds the parts up, so the
driver gets a few hundred numbers whatever the number of rows.  A fifth of the labelled rows, picked by the hash of
their id, is kept for the curve and the choice among ``GRID``: the tasks count their density differences in bins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm import textkit as tk
from tidemark.llm.frames import Shared, fresh

NAMES = ("words", "word_size", "upper", "symbols", "symbol_runs", "digits", "wide", "no_letter_words", "repeats",
         "distinct_words", "top_word", "distinct_pairs", "line_words", "repeated_lines", "stops")
GRID = tuple((lam, gam) for lam in (0.0, 0.1, 0.4) for gam in (0.003, 0.03, 0.2))  # (towards the shared, towards the identity)
HOLD = 5  # one part in HOLD of the labelled rows calibrates
BINS = 2000  # of asinh of the density difference, over -_SPAN.._SPAN
_SPAN = 10.0

_UPPER, _LETTER, _SYMBOL, _DIGIT = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_SYMBOL[33:48] = _SYMBOL[58:65] = _SYMBOL[91:97] = _SYMBOL[123:127] = True
_DIGIT[48:58] = True
_LINE = np.ones(256, bool)
_LINE[10] = False


def _sums(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many flags are set in each run bounds[i]..bounds[i + 1]."""
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return np.diff(c[bounds])


def _groups(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, occurrences of the commonest one) in each of n texts."""
    if not len(doc):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.lexsort((h, doc))
    d, v = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (v[1:] != v[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n, np.int64)
    np.maximum.at(top, d[at], np.diff(np.append(at, len(d))))
    return np.bincount(d[at], minlength=n), top


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` a text of a slice; a text without words gives zeros."""
    n = len(off) - 1
    w = tk.Words(raw, off, tk.SPACED)
    h, doc, words = w.hashes(), w.docs(), w.counts()
    chars = np.maximum(_sums((raw < 128) | (raw >= 192), off), 1)
    letters = np.maximum(_sums(_LETTER[raw], off), 1)
    symbol = _SYMBOL[raw]
    runs = symbol.copy()
    runs[1:] &= symbol[:-1]
    runs[off[:-1][off[:-1] < len(raw)]] = False
    some = np.maximum(words, 1)
    c = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(_LETTER[raw], out=c[1:])
    empty = c[w.end] == c[w.start]
    stop = np.isin(raw[w.end - 1], np.frombuffer(b".!?", np.uint8)) & ~empty if len(w) else np.zeros(0, bool)
    follows = np.zeros(len(h), bool)
    follows[1:] = doc[1:] == doc[:-1]
    again = follows.copy()
    again[1:] &= h[1:] == h[:-1]
    distinct, top = _groups(doc, h, n)
    at = np.flatnonzero(follows)
    pairs = np.bincount(doc[at], minlength=n)
    pair_kinds, _ = _groups(doc[at], tk.mix64(h[at - 1]) ^ h[at], n)
    lines = tk.Words(raw, off, _LINE, lower=False)
    n_lines = np.maximum(lines.counts(), 1)
    line_kinds, _ = _groups(lines.docs(), lines.hashes(), n)
    root = np.sqrt
    out = np.stack([
        np.log1p(words), np.log1p(chars / some), root(_sums(_UPPER[raw], off) / letters), root(_sums(symbol, off) / chars),
        root(_sums(runs, off) / chars), root(_sums(_DIGIT[raw], off) / chars), root(_sums(raw >= 192, off) / chars),
        root(_sums(empty, w.bounds) / some), root(_sums(again, w.bounds) / some),
        np.log1p(distinct) / np.log1p(some), root(top / some), np.log1p(pair_kinds) / np.log1p(np.maximum(pairs, 1)),
        np.log1p(words / n_lines), root((n_lines - np.maximum(line_kinds, 1)) / n_lines), root(_sums(stop, w.bounds) / some)], 1)
    out[words == 0] = 0
    return out


def with_statistics(docs: DataFrame, out: str, text_col: str = "text") -> DataFrame:
    """``docs`` with an array column ``out`` of ``NAMES``; a null, empty or blank text gives zeros.

    Very long texts are read whole, one at a time beyond ``textkit.SLICE_BYTES``, at about 100 bytes a byte of
    text.  Rows stay as they are; other columns, whatever their names, pass through.
    """

    @arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        raw, off = tk.buffers(texts)
        parts = [statistics(buf, o) for _, _, buf, o in tk.sliced(raw, off)]
        flat = np.concatenate(parts).ravel() if parts else np.zeros(0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(NAMES), pa.int32()), pa.array(flat))

    return docs.withColumn(out, run(F.col(text_col)))


class Discriminant:
    """Two normal distributions with shrunk covariances, and the curve from density difference to probability."""

    def __init__(self, moments: list[tuple[float, np.ndarray, np.ndarray]], lam: float, gam: float):
        """moments: (rows, sum, sum of products) of class 0 and class 1."""
        n = np.array([m[0] for m in moments])
        mean = [m[1] / m[0] for m in moments]
        cov = [m[2] / m[0] - np.outer(u, u) for m, u in zip(moments, mean, strict=True)]
        shared = sum(k / n.sum() * c for k, c in zip(n, cov, strict=True))
        self.centre = sum(m[1] for m in moments) / n.sum()
        self.scale = np.sqrt(np.maximum(np.diag(shared), 1e-6))
        self.mean, self.half, self.offset = [], [], 0.0
        outer = np.outer(self.scale, self.scale)
        for sign, k, u, c in zip((-1, 1), n, mean, cov, strict=True):
            s = ((1 - lam) * c + lam * shared) / outer
            s = (1 - gam) * s + gam * max(np.trace(s) / len(u), 1e-3) * np.eye(len(u))
            low = np.linalg.cholesky(s)
            self.mean.append((u - self.centre) / self.scale)
            self.half.append(np.linalg.inv(low))
            self.offset += sign * (np.log(k / n.sum()) - np.log(np.diag(low)).sum())
        self.slope, self.shift = 1.0, 0.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """log density of class 1 less that of class 0, with the classes' shares, of every row."""
        z = (x - self.centre) / self.scale
        d = [(((z - u) @ half.T) ** 2).sum(1) for u, half in zip(self.mean, self.half, strict=True)]
        return (d[0] - d[1]) / 2 + self.offset

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _logistic(self.slope * np.arcsinh(self.difference(x)) + self.shift)


class Constant:
    """What is left when there is nothing, or only one class, to learn from."""

    def __init__(self, value: float):
        self.value = value

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _curve(z: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[float, float, float]:
    """(slope, shift, loss a row) of the logistic curve through counted bins at z; a small ridge keeps it finite."""
    a, b, n = 1.0, 0.0, bad + good
    t = good + 1 / max(n.sum(), 1)  # a trace of doubt in every bin
    for _ in range(100):
        p = _logistic(a * z + b)
        s = n * p * (1 - p) + 1e-9
        ga, gb = ((n * p - t) * z).sum() + 0.1 * (a - 1), (n * p - t).sum() + 0.01 * b
        haa, hab, hbb = (s * z * z).sum() + 0.1, (s * z).sum(), s.sum() + 0.01
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        size = max(1.0, abs(da), abs(db))
        a, b = max(0.05, a - da / size), b - db / size
    p = np.clip(_logistic(a * z + b), 1e-12, 1 - 1e-12)
    return a, b, float(-(good * np.log(p) + bad * np.log(1 - p)).sum() / max(n.sum(), 1))


def _summed(rows: DataFrame, stats: str, label: str, hold: str) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(rows, sum, sum of products) by class; tasks send one row for each number, which Spark adds up."""
    p = len(NAMES) + 1

    def run(batches):
        total = np.zeros((2, p, p))
        for b in batches:
            if b.num_rows:
                x = np.ones((b.num_rows, p))
                x[:, 1:] = b.column(0).flatten().to_numpy().reshape(-1, p - 1)
                good = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
                for k in (0, 1):
                    y = x[good == bool(k)]
                    total[k] += y.T @ y
        k, i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (k, i, j, total[k, i, j])], ["k", "i", "j", "v"])

    out = np.zeros((2, p, p))
    used = rows.where(~F.col(hold)).select(stats, label).mapInArrow(run, "k long, i long, j long, v double")
    for r in used.groupBy("k", "i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["k"], r["i"], r["j"]] = r["v"]
    return [(m[0, 0], m[0, 1:], m[1:, 1:]) for m in out]


def _binned(rows: DataFrame, stats: str, label: str, models: list[Discriminant]) -> np.ndarray:
    """Rows by model, class and bin of asinh of the density difference."""
    shared = Shared(rows.sparkSession, models)

    def run(batches):
        out = np.zeros((len(shared.get()), 2, BINS), np.int64)
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1)
                good = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                for m, model in enumerate(shared.get()):
                    at = ((np.arcsinh(model.difference(x)) + _SPAN) * (BINS / (2 * _SPAN))).astype(np.int64).clip(0, BINS - 1)
                    np.add.at(out[m], (good, at), 1)
        m, k, i = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (m, k, i, out[m, k, i])], ["m", "k", "i", "n"])

    out = np.zeros((len(models), 2, BINS))
    counted = rows.select(stats, label).mapInArrow(run, "m long, k long, i long, n long")
    for r in counted.groupBy("m", "k", "i").agg(F.sum("n").alias("n")).collect():
        out[r["m"], r["k"], r["i"]] = r["n"]
    return out


def fit_quality(docs: DataFrame, labels: DataFrame, stats: str, learn: Column | None = None, id_col: str = "doc_id",
                label_col: str = "quality") -> Discriminant | Constant:
    """Fit on every row of ``docs`` (with the statistics column ``stats``) that has a label; ``learn`` restricts them.

    ``learn`` is a condition on the id.  Several labels of an id: good only if all say so; null labels and null ids are
    left out; repeated documents count each.  One class only, or nothing to learn from: a constant (0.95, 0.05 or
    0.5).  Fewer labelled rows than a fifth can calibrate: the curve is fitted on the same rows as the densities.
    """
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        lab = lab.where(learn)
    lab = lab.groupBy(F.col(id_col).alias("id")).agg((F.min(label_col) > 0).alias("good"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(stats).alias("x")).join(lab, "id").select(
        "x", "good", (F.pmod(F.xxhash64("id"), F.lit(HOLD)) == 0).alias("hold"))
    moments = _summed(rows, "x", "good", "hold")
    if min(m[0] for m in moments) < 2:
        rows = rows.withColumn("hold", F.lit(False))
        moments = _summed(rows, "x", "good", "hold")
    n = [m[0] for m in moments]
    if min(n) < 1:
        return Constant(0.5 if max(n) < 1 else 0.95 if n[1] else 0.05)
    models = [Discriminant(moments, lam, gam) for lam, gam in GRID]
    counted = _binned(rows.where("hold"), "x", "good", models)
    if counted[0].sum(1).min() < 5:
        counted = _binned(rows, "x", "good", models)
    z = (np.arange(BINS) + 0.5) * (2 * _SPAN / BINS) - _SPAN
    curves = [_curve(z, c[0], c[1]) for c in counted]
    best = min(range(len(models)), key=lambda m: curves[m][2])
    model = models[best]
    model.slope, model.shift, _ = curves[best]
    return model


def quality_score(model: Discriminant | Constant, stats: Column) -> Column:
    """Probability of class 1 from a statistics column: 0 to 1, higher is likelier good."""
    shared = Shared(SparkSession.active(), model)

    @arrow_udf("double")
    def score(x: pa.Array) -> pa.Array:
        return pa.array(shared.get().probability(x.flatten().to_numpy().reshape(len(x), len(NAMES))))

    return score(stats)


def reject_poor(docs: DataFrame, model: Discriminant | Constant, cutoff: float = 0.5, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score is under ``cutoff``; all columns kept."""
    s, = fresh(docs, "statistics")
    return with_statistics(docs, s, text_col).where(quality_score(model, F.col(s)) >= cutoff).select(*docs.columns)
