"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is read from hash tables: two by the whole word, so a word
that was never trained is neutral unless it collides in both, and one each by
its first 4 and 6 bytes, which carry over to unseen forms of a stem.  Filters
of widths 1, 2 and 3 run over the whole text; each filter's three largest
values (k-max pooling) are features of a logistic output, so one chance
occurrence weighs less than several.  Training: a bounded, hashed sample of labelled
rows, a part of which is held back to calibrate the score (Platt) and the
thresholds by language.

Texts of any length are scored whole, in slices of whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm import textkit as tk
from tidemark.llm.frames import Shared, fresh, hash_sample

WIDTHS = (1, 2, 3)
FILTERS = 8
PART = 4
STEMS = (4, 6)
TABLES = 2 + len(STEMS)
TOP = 3
BITS = 18
TRAIN_ROWS = 1200  # of either class, at most
MIN_DOCS = 4  # a word in fewer training texts is not trained
EPOCHS = 10
CUTOFF = 0.7
_TAIL = max(WIDTHS) - 1  # empty slots that keep a window from the next text
_PAD = TOP + _TAIL


def _buckets(h: np.ndarray) -> list[np.ndarray]:
    """The buckets of words given as rows (hash, hashes of the first bytes), one array per table."""
    low = np.uint64((1 << BITS) - 1)
    return [(h[:, 0] >> np.uint64(64 - BITS)).astype(np.int64), *((h[:, k] & low).astype(np.int64) for k in range(h.shape[1]))]


def _features(words: np.ndarray, bounds: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of every word (words x TABLES) with _PAD empty slots after each text, and the texts' starts."""
    n = len(bounds) - 1
    count = np.diff(bounds)
    start = np.arange(n) * _PAD + bounds[:-1]
    at = np.repeat(np.arange(n) * _PAD, count) + np.arange(len(words))
    total = len(words) + n * _PAD
    out = []
    for b in words.T:
        i = np.full(total, 1 << BITS, np.int64)
        i[at] = b
        out.append(i)
    return out, start


class Net:
    """The parameters; tables are dense in memory and sparse when pickled."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.e = [np.zeros(((1 << BITS) + 1, PART), np.float32) for _ in range(TABLES)]
        self.w = [(r.normal(0, 0.3, (k, TABLES * PART, FILTERS))).astype(np.float32) for k in WIDTHS]
        for w in self.w:
            w[:, ::PART, :] = np.abs(w[:, ::PART, :])
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.v = np.full(TOP * FILTERS * len(WIDTHS), 0.1, np.float32)
        self.c = np.float32(-2.0)
        self.scale, self.shift = 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        self.threshold = CUTOFF

    def __getstate__(self):
        s = dict(self.__dict__)
        s["e"] = [(i := np.flatnonzero(e.any(1)), e[i]) for e in self.e]
        return s

    def __setstate__(self, s):
        e = []
        for i, rows in s["e"]:
            t = np.zeros(((1 << BITS) + 1, PART), np.float32)
            t[i] = rows
            e.append(t)
        self.__dict__.update(s, e=e)

    def embed(self, buckets):
        return np.concatenate([e[i] for e, i in zip(self.e, buckets, strict=True)], 1)

    def pool(self, x, start, where: bool = False):
        """The TOP largest values of every filter in every text (text, width x rank x filter), and their positions."""
        feats, places = [], []
        n = len(x)
        for k, w, b in zip(WIDTHS, self.w, self.b, strict=True):
            z = x @ w[0]
            for j in range(1, k):
                z[:n - j] += x[j:] @ w[j]
            z += b
            ends = np.append(start[1:], n) - _TAIL
            if where:
                at = np.stack([s + np.argpartition(-z[s:t], TOP - 1, 0)[:TOP] for s, t in zip(start, ends, strict=True)])
                at = np.take_along_axis(at, np.argsort(-z[at, np.arange(FILTERS)], 1, kind="stable"), 1)
                places.append(at)
                top = z[at, np.arange(FILTERS)]
            else:
                top = np.stack([-np.sort(np.partition(-z[s:t], TOP - 1, 0)[:TOP], 0) for s, t in zip(start, ends, strict=True)])
            feats.append(top.reshape(len(start), TOP * FILTERS))
        return np.concatenate(feats, 1), places

    def logits(self, words, bounds):
        if len(bounds) < 2:
            return np.zeros(0)
        buckets, start = _features(words, bounds)
        f, _ = self.pool(self.embed(buckets), start)
        return np.maximum(f, 0) @ self.v + self.c

    def scores(self, h, bounds):
        """Scores of texts given as ``hashed_words`` rows."""
        z = np.clip(self.scale * self.logits(np.stack(_buckets(h), 1), bounds).astype(np.float64) + self.shift, -60, 60)
        return 1 / (1 + np.exp(-z))


def _hashed(texts: pa.Array) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """Per text the buckets of its words (words x TABLES), and per hash column its distinct hashes."""
    buckets, distinct = [], []
    raw, off = tk.buffers(texts)
    for _, _, b, o in tk.sliced(raw, off, 256 << 10):
        w = tk.Words(b, o, tk.ALNUM)
        h = hashed_words(w)
        for a, e in zip(w.bounds[:-1], w.bounds[1:], strict=True):
            buckets.append(np.stack(_buckets(h[a:e]), 1).astype(np.int32))
            distinct.append([np.unique(h[a:e, c]) for c in range(h.shape[1])])
    return buckets, distinct


def hashed_words(w: tk.Words) -> np.ndarray:
    """(hash, hashes of the first bytes) of every word."""
    return np.stack([w.hashes(), *(w.hashes(k) for k in STEMS)], 1)


def _seed_tables(net: Net, distinct: list[list[np.ndarray]], y: np.ndarray, r) -> list[np.ndarray]:
    """Start the trainable words at their smoothed log-odds (first component) and small noise; masks of their buckets."""
    masks = []
    p, q = max(y.sum(), 1), max(len(y) - y.sum(), 1)
    for side in range(TABLES):
        uniq = [d[max(0, side - 1)] for d in distinct]
        label = np.repeat(y, [len(u) for u in uniq])
        words, inv = np.unique(np.concatenate(uniq), return_inverse=True)
        pos, tot = np.bincount(inv, label, len(words)), np.bincount(inv, minlength=len(words))
        odds = np.log((pos + 0.5) / (p + 1)) - np.log((tot - pos + 0.5) / (q + 1))
        odds *= tot / (tot + 8.0)
        ok = tot >= min(MIN_DOCS, max(2, int(p) // 4))
        idx = _buckets(words[:, None] if side < 2 else np.stack([words] * side, 1))[side][ok]
        mask = np.zeros((1 << BITS) + 1, bool)
        mask[idx] = True
        net.e[side][mask] = r.normal(0, 0.05, (int(mask.sum()), PART))
        net.e[side][idx, 0] = odds[ok] / TABLES
        masks.append(mask)
    return masks


def train(texts: list | pa.Array, toxic: np.ndarray, langs: list[str | None], seed: int = 7, epochs: int = EPOCHS) -> Net:
    """Fit on four fifths of the rows and calibrate on the rest.  No rows, or one class only: a constant score."""
    net = Net(seed)
    y = np.asarray(toxic, np.float64)
    if len(y) == 0 or y.min() == y.max():
        net.scale, net.shift = 0.0, -3.0 if len(y) == 0 or y.min() == 0 else 3.0
        return net
    r = np.random.default_rng(seed)
    docs, distinct = _hashed(texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string()))
    del texts
    order = r.permutation(len(docs))
    hold = order[:len(docs) // 5]
    fit = order[len(docs) // 5:]
    if len(np.unique(y[fit])) < 2:
        fit = order
    masks = _seed_tables(net, [distinct[i] for i in fit], y[fit], r)
    del distinct
    dense = [*net.w, *net.b, net.v]
    m1, m2 = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
    seen = [np.zeros(((1 << BITS) + 1, 1), np.float32) for _ in range(TABLES)]
    step = 0
    for _ in range(epochs):
        turn = fit[r.permutation(len(fit))]
        for batch in np.array_split(turn, max(1, len(turn) // 32)):
            step += 1
            bounds = np.concatenate([[0], np.cumsum([len(docs[i]) for i in batch])])
            buckets, start = _features(np.concatenate([docs[i] for i in batch]), bounds)
            x = net.embed(buckets)
            f, places = net.pool(x, start, where=True)
            act = np.maximum(f, 0)
            z = act @ net.v + net.c
            g = ((1 / (1 + np.exp(-z)) - y[batch]) / len(batch)).astype(np.float32)
            gv = act.T @ g + 1e-4 * net.v
            gf = (np.outer(g, net.v) * (f > 0)).reshape(len(batch), len(WIDTHS), TOP, FILTERS)
            gw, gb, gx = [], [], [[] for _ in range(TABLES)]
            for n, (k, w) in enumerate(zip(WIDTHS, net.w, strict=True)):
                at, gz = places[n].reshape(-1, FILTERS), gf[:, n].reshape(-1, FILTERS)
                d = np.zeros_like(w)
                for j in range(k):
                    src = np.minimum(at + j, len(x) - 1)
                    live = gz * (at + j < len(x))
                    d[j] = np.einsum("df,dfe->ef", live, x[src])
                    ge = live[:, :, None] * w[j].T[None]
                    for side, idx in enumerate(buckets):
                        gx[side].append((idx[src].ravel(), ge[:, :, side * PART:(side + 1) * PART].reshape(-1, PART)))
                gw.append(d + 1e-4 * w)
                gb.append(gz.sum(0))
            for p, gr, a, b in zip(dense, [*gw, *gb, gv], m1, m2, strict=True):
                a += 0.1 * (gr - a)
                b += 0.01 * (gr * gr - b)
                p -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
            net.c -= np.float32(0.1) * g.sum()
            for side in range(TABLES):
                idx = np.concatenate([i for i, _ in gx[side]])
                gr = np.concatenate([q for _, q in gx[side]])
                keep = masks[side][idx]
                u, inv = np.unique(idx[keep], return_inverse=True)
                s = np.zeros((len(u), PART), np.float32)
                np.add.at(s, inv, gr[keep])
                s += 1e-4 * net.e[side][u]
                seen[side][u] += (s * s).mean(1, keepdims=True)
                net.e[side][u] -= 0.02 * s / (np.sqrt(seen[side][u]) + 1e-6)
    _calibrate(net, [docs[i] for i in hold], y[hold], [langs[i] for i in hold])
    return net


def _calibrate(net: Net, docs: list[np.ndarray], y: np.ndarray, langs: list[str | None]) -> None:
    if len(y) == 0:
        return
    z = np.concatenate([net.logits(d, np.array([0, len(d)])) for d in docs]).astype(np.float64)
    if 0 < y.sum() < len(y):
        a, b = 1.0, 0.0
        t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(200):  # Platt: Newton steps with a small ridge towards the raw logit
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
            s = p * (1 - p) + 1e-9
            ga, gb = ((p - t) * z).sum() + 0.05 * (a - 1), (p - t).sum()
            haa, hab, hbb = (s * z * z).sum() + 0.05, (s * z).sum(), s.sum() + 1e-6
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            size = max(1.0, abs(da) / 0.5, abs(db) / 1.0)
            a, b = max(0.05, a - da / size), b - db / size
        net.scale, net.shift = a, b
    # move the scores so that the cut-off of largest F1 over all languages is CUTOFF
    best = _best(1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -60, 60))), y)
    net.shift += np.log(CUTOFF / (1 - CUTOFF)) - np.log(best / (1 - best))
    score = 1 / (1 + np.exp(-np.clip(net.scale * z + net.shift, -60, 60)))
    net.threshold = CUTOFF
    groups = np.array([x or "" for x in langs])
    for lang in sorted(set(groups) - {""}):
        at = groups == lang
        n = y[at].sum()
        # shrink towards the threshold of all languages by the number of positives
        net.thresholds[str(lang)] = float((n * _best(score[at], y[at]) + 20 * net.threshold) / (n + 20))


def _best(score: np.ndarray, y: np.ndarray) -> float:
    """The cut-off of largest F1, in the middle of those that reach it; CUTOFF without positives."""
    if y.sum() == 0:
        return CUTOFF
    grid = np.linspace(0.3, 0.95, 66)
    f1 = np.array([2 * ((score >= t) & (y == 1)).sum() / ((score >= t).sum() + y.sum()) for t in grid])
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(grid[best[len(best) // 2]])


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, text_col: str = "text",
                 id_col: str = "doc_id", label_col: str = "toxic", lang_col: str | None = "lang",
                 train_rows: int = TRAIN_ROWS) -> Net:
    """Fit on at most ``train_rows`` documents of either class, chosen by the hash of their id.

    ``learn`` restricts the rows that may be learned from.  Several labels of an id: toxic if one says so; null
    labels and null ids are left out.  Rows equal in id and text, and ties of the hash, count as one row.  Null and
    empty texts have no words; very long texts are learned from whole.  No labelled row, or one class only: a constant
    score.  Other columns of either table may have any names.  Only the sampled rows (bounded) reach the driver.
    """
    lab = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        lab = lab.where(learn)
    lab = lab.groupBy(id_col).agg(F.max(label_col).alias("_toxic"))
    picked = [hash_sample(lab.where(F.col("_toxic") > 0), train_rows, id_col),
              hash_sample(lab.where(F.col("_toxic") <= 0), train_rows, id_col)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * train_rows ids
    cols = [F.col(text_col).alias("t"), F.col("_toxic"), (F.col(lang_col) if lang_col else F.lit(None)).alias("l")]
    docs = docs.select(*dict.fromkeys([id_col, text_col, *([lang_col] if lang_col else [])]))
    rows = hash_sample(docs.join(sample, id_col).select(id_col, *cols), 2 * train_rows, id_col, "t").toArrow()
    rows = rows.sort_by([(id_col, "ascending"), ("t", "ascending")])  # as Arrow buffers: no Python object a text
    toxic = rows["_toxic"].to_numpy() > 0 if len(rows) else np.zeros(0, bool)
    net = train(rows["t"].combine_chunks(), toxic, rows["l"].to_pylist())
    del rows
    pa.default_memory_pool().release_unused()
    return net


def toxicity_score(net: Net, text: Column) -> Column:
    """Score of a text column: 0 to 1, higher is likelier toxic; null and empty texts get the score of no words.

    Very long texts are read whole; equal texts score alike, whatever stands beside them.
    """
    shared = Shared(SparkSession.active(), net)

    @arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        raw, off = tk.buffers(texts)
        out = np.zeros(len(texts))
        for i, j, b, o in tk.sliced(raw, off):
            w = tk.Words(b, o, tk.ALNUM)
            out[i:j] = shared.get().scores(hashed_words(w), w.bounds)
        return pa.array(out)

    return score(text)


def threshold_of(net: Net, lang: Column) -> Column:
    """The threshold calibrated for a language; the one of all languages if it is unknown or null."""
    out = F.lit(float(net.threshold))
    for name, t in net.thresholds.items():
        out = F.when(lang == name, F.lit(float(t))).otherwise(out)
    return out


def reject_toxic(docs: DataFrame, net: Net, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows whose score reaches their language's threshold; all columns kept, whatever their names.

    A null or unknown language takes the threshold of all.  Repeated rows are judged alike.  Empty table: no rows.
    """
    s, = fresh(docs, "toxicity")
    scored = docs.withColumn(s, toxicity_score(net, F.col(text_col)))
    return scored.where(F.col(s) < threshold_of(net, F.col(lang_col))).select(*docs.columns)
