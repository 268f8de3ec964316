import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import alnum, docs
from tidemark.llm import maxsketch as ms
from tidemark.llm import textkit as tk


def brute(rows, items, k=20):
    """(item, rank, doc, score) by scoring every pair."""
    texts = [(i, Counter(w)) for i, t in rows if (w := alnum(t))]
    n_docs, n_terms = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for i, c in texts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t in alnum(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def corpus(seed, n, words=400, hot=0):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    rows = [(i, " ".join(r.choices(vocabulary, weights, k=r.choice([1, 5, 30, 200])))) for i in range(n)]
    return rows + [(n + i, rows[3][1]) for i in range(hot)], vocabulary, weights, r


def run(spark, rows, items, **kw):
    it = spark.createDataFrame(items, "item_id long, text string")
    d = docs(spark, rows).withColumn("score", F.lit("mine")).withColumn("K1", F.lit(0))
    got = [tuple(x) for x in ms.rank_documents(d, it, **kw).collect()]
    return sorted(got, key=str)


def test_search_equals_brute_force(spark, monkeypatch):
    rows, vocabulary, weights, r = corpus(1, 400, hot=120)
    items = [(i, " ".join(r.choices(vocabulary, weights, k=12))) for i in range(15)] + [(90, rows[3][1]), (91, "w1 w1 w1")]
    monkeypatch.setattr(ms, "FIRST", 5)
    monkeypatch.setattr(ms, "DEEPER", 30)
    monkeypatch.setattr(ms, "BLOCK_ITEMS", 6)
    assert run(spark, rows, items, k=20) == brute(rows, items)
    assert run(spark, rows, items, k=3) == brute(rows, items, 3)


def test_candidates_by_shuffle_give_the_same(spark, monkeypatch):
    rows, vocabulary, weights, r = corpus(2, 120)
    items = [(i, " ".join(r.choices(vocabulary, weights, k=8))) for i in range(4)]
    monkeypatch.setattr(ms, "BROADCAST_KEYS", 0)
    assert run(spark, rows, items) == brute(rows, items)


def test_odd_rows(spark):
    rows = [(0, None), (1, ""), (2, " .,! "), (3, "Äpfel und BIRNEN"), (3, "Äpfel und BIRNEN"), (None, "und so"), (4, "x " * 300000),
            (5, "äpfel UND"), (6, "z" * 50000), (None, "und so")]
    items = [(0, "Äpfel und"), (1, None), (2, ""), (3, "nothing here"), (4, "x z"), (4, "und"), (5, "z" * 50000), (0, "Äpfel und")]
    assert run(spark, rows, items) == brute(rows, items)
    assert run(spark, [], items) == [] and run(spark, rows, []) == []
    assert run(spark, [(1, None), (2, "--")], items) == []


def test_bounds_hold_and_prune(spark):
    rows, vocabulary, weights, r = corpus(5, 300, words=3000)
    block = ms.Block([" ".join(r.choices(vocabulary, weights, k=20)) for _ in range(12)])
    raw, off = tk.buffers(pa.array([t for _, t in rows]))
    n, bits, sketch = ms.sketches(raw, off)
    block.weights = np.array([1 + x % 4000 for x in range(len(block.hashes))], np.int64)
    bound = block.bounds(n, bits, sketch, len(rows), int(n.sum()))
    doc, item = np.divmod(np.arange(len(rows) * 12), 12)
    exact = block.scores(raw, off, doc, item, len(rows), int(n.sum())).reshape(len(rows), 12).T
    assert (bound >= exact).all()
    for b, e in zip(bound, exact, strict=True):  # documents that must be scored to know the ten best
        assert (b >= np.sort(e)[-10]).sum() < 150


def test_levels_round_up():
    tf = np.array([1, 2, 200, 201, 1000, 10**8, 10**9])
    assert (ms.LEVEL[np.searchsorted(ms.LEVEL, tf)] >= tf).all() and len(ms.LEVEL) == 256


def test_length_norm_beyond_64_bits():
    n = np.array([1, 10**7, 10**8])
    got = ms.length_norm(n, 3 * 10**11, 10**14)
    assert got.tolist() == [75 + 25 * int(x) * 3 * 10**11 // 10**14 for x in n]
