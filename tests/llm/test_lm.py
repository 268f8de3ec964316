import random
from collections import Counter
from math import log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import crc, docs, spaced
from tidemark.llm import lm
from tidemark.llm.eliasfano import EliasFano


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], list(range(300)), [2**60, 2**61, 2**62],
                                    sorted(random.Random(1).sample(range(10**6), 5000)),
                                    sorted(random.Random(2).choices(range(50), k=2000)), [0] * 200 + [10**9]])
def test_elias_fano_round_trip(values, tmp_path):
    v = np.array(values, np.int64)
    e = EliasFano(v, str(tmp_path), "x")
    assert np.array_equal(e.get(np.arange(len(v))), v)
    r = random.Random(3)
    ask = np.array(sorted({0, 1, *values, *(max(0, x - 1) for x in values), *(x + 1 for x in values),
                           *(r.randrange(2**40) for _ in range(200))}), np.int64)
    assert np.array_equal(e.successor(ask), np.searchsorted(v, ask, "left"))


def tokens(t):
    return [*spaced(t), "\0end"]


def brute(rows, learned, mu=lm.MU):
    c, pairs, docs_ = Counter(), Counter(), 0
    for (_, t), on in zip(rows, learned, strict=True):
        if on:
            w = tokens(t)
            c.update(w)
            pairs.update(zip(["\0begin", *w[:-1]], w, strict=True))
            docs_ += 1
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = tokens(t)
        base = sum(log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        s = 0
        for u, x in zip(["\0begin", *w[:-1]], w, strict=True):
            p1 = (c[x] - 0.5) / n if c[x] else 0.5 * v / n
            s += log10((pairs[u, x] + mu * p1) / ((docs_ if u == "\0begin" else c[u]) + mu))
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, base, s))
    return out


def rows_of(seed=4, n=120):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(400)], k=r.randint(0, 120)))) for i in range(n)]
    return [*rows, (500, None), (501, ""), (502, " \t"), (503, "Straße STRASSE straße   é"), (504, "w1 " * 30000), (0, rows[0][1]),
            (None, "w1 w2 w3"), (505, "never\x1cseen before")]


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_brute_force(spark, monkeypatch, small):
    if small:  # many chunks and shards
        monkeypatch.setattr(lm, "SHARD_TOKENS", 900)
        monkeypatch.setattr(lm, "CHUNK", 500)
        monkeypatch.setattr(lm, "CHUNK_DOCS", 16)
        monkeypatch.setattr(lm, "SHARD_TASKS", 7)
    rows = rows_of()
    on = [i is not None and crc(i) % 5 != 1 for i, _ in rows]
    learn = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 != 1, F.lit(False))
    d = docs(spark, rows).withColumn("n_tokens", F.lit(9)).withColumn("learn", F.lit("x"))
    got = sorted((tuple(r) for r in lm.score_corpus(d, learn).collect()), key=lambda r: (r[0] is None, r[0], r[2]))
    want = sorted(brute(rows, on), key=lambda r: (r[0] is None, r[0], r[1]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert (g[0], g[2], g[3], g[4]) == w[:4]
        assert g[5] == pytest.approx(w[4], rel=1e-9)
        assert g[6] == pytest.approx(w[5], abs=0.012 * w[1] + 0.01)  # 8-bit numerators


def learned(d):
    return d.select("text", F.lit(True).alias("learn"), F.col("doc_id").alias("k0"))


def test_pair_of_a_third_of_all_tokens_is_split(spark, monkeypatch):
    """One pair a third of all tokens, spread over the documents: no shard is much above the median, scores stay exact."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 5000)
    monkeypatch.setattr(lm, "CHUNK", 4000)
    monkeypatch.setattr(lm, "CHUNK_DOCS", 400)
    r, many = random.Random(9), [f"w{j}" for j in range(3000)]
    rows = [(i, " ".join(["na na", r.choice(many), "na na", f"u{i}", "na na"])) for i in range(9000)]
    d = docs(spark, rows).repartition(6, "doc_id")
    corpus = lm._survey(learned(d))
    na = lm.tk.Words(np.frombuffer(b"na", np.uint8), np.array([0, 2]), lm.tk.SPACED).hashes()
    hot, at = corpus.heavy_pair(na, na)
    assert hot[0] and corpus.pair_counts[at[0]] == 27000 and corpus.shards >= 16
    sent = lm._send(learned(d), corpus).where("not head").groupBy("shard").agg(
        F.sum(sum(F.octet_length(c) for c in "wpder")).alias("n")).toPandas()["n"]
    assert sent.max() <= 1.5 * sent.median()
    heads = lm._send(learned(d), corpus).where("head").groupBy("shard").count().toPandas()["count"]
    assert heads.sum() >= 24 and len(heads) > corpus.shards / 2
    got = {r[0]: r["score"] for r in lm.score_corpus(d, F.lit(True)).collect()}
    for w in brute(rows, [True] * len(rows)):
        assert got[w[0]] == pytest.approx(w[5], abs=0.012 * w[1] + 0.01)


def test_pair_hot_in_rows_not_learned(spark, monkeypatch):
    """A pair frequent where nothing is learned from is split as well, and its count is that of the learned rows."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 500)
    monkeypatch.setattr(lm, "CHUNK", 300)
    rows = [(i, "so so so" if i % 9 else f"so so x{i}") for i in range(900)]
    on = [i % 9 == 0 for i, _ in rows]
    got = {r["doc_id"]: r for r in lm.score_corpus(docs(spark, rows), F.col("doc_id") % 9 == 0).collect()}
    for w in brute(rows, on):
        assert tuple(got[w[0]])[2:5] == w[1:4]
        assert got[w[0]]["score"] == pytest.approx(w[5], abs=0.012 * w[1] + 0.01)


def test_nothing_learned_and_empty(spark):
    d = docs(spark, [(0, "a b"), (1, None)])
    got = lm.score_corpus(d, F.lit(False)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got} == {(0, 3, 0, 0), (1, 1, 0, 0)}
    assert all(r["score"] == pytest.approx(0, abs=1e-4) for r in got)
    assert lm.score_corpus(docs(spark, []), F.lit(True)).count() == 0


def test_query_beats_the_base_on_held_out_rows(spark):
    from tidemark.llm.queries import op7_lm

    got = op7_lm(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert (got["score"] <= 0).all() and (got["n_known"] <= got["n_tokens"]).all()
    assert got["score"].sum() > got["base_score"].sum() and (got["score"] >= got["base_score"]).mean() > 0.9
