import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs
from tidemark.llm import textkit as tk
from tidemark.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


def corpus(n=600, seed=1):
    r = random.Random(seed)
    vocab = {"en": [f"en{i}" for i in range(300)], "de": [f"de{i}" for i in range(300)]}
    rows, labels = [], []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        w = [r.choice(vocab[lang]) for _ in range(r.randint(5, 80))]
        bad = i % 7 == 0
        if bad:
            for _ in range(2):
                w.insert(r.randrange(len(w)), r.choice(["Nastyword,", "vileword", "GRIMWORD"]))
        rows.append((i, " ".join(w), lang))
        labels.append((i, 1, int(bad)))
    return rows, labels


@pytest.fixture(scope="module")
def net():
    rows, labels = corpus()
    return tx.train([t for _, t, _ in rows], np.array([x[2] for x in labels]), [x for _, _, x in rows])


def score(net, texts):
    raw, off = tk.buffers(pa.array(texts, pa.large_string()))
    w = tk.Words(raw, off, tk.ALNUM)
    return net.scores(tx.hashed_words(w), w.bounds)


def test_learns_words_in_any_place(net):
    long = " ".join(f"en{i % 300}" for i in range(40000))
    s = score(net, ["en1 nastyword en2 grimword", f"{long} vileword {long} Nastyword", "en1 en2 en3", long, "", None, "never seen words only", "de5 de6"])
    assert (s[:2] >= 0.7).all() and (s[2:] < 0.7).all() and ((s >= 0) & (s <= 1)).all()


def naive_logit(net, text):
    """Convolution, pooling and output by loops over the positions of one text."""
    raw, off = tk.buffers(pa.array([text], pa.large_string()))
    h = tx.hashed_words(tk.Words(raw, off, tk.ALNUM))
    x = [np.concatenate([net.e[t][b[i]] for t, b in enumerate(tx._buckets(h))]) for i in range(len(h))]
    none = np.concatenate([e[1 << tx.BITS] for e in net.e])
    out = float(net.c)
    for n, (k, w, b) in enumerate(zip(tx.WIDTHS, net.w, net.b, strict=True)):
        for f in range(tx.FILTERS):
            values = []
            for i in range(len(x) + tx.TOP):
                values.append(float(b[f]) + sum(float(np.dot(x[i + j] if i + j < len(x) else none, w[j][:, f])) for j in range(k)))
            for rank, v in enumerate(sorted(values, reverse=True)[:tx.TOP]):
                out += max(v, 0.0) * float(net.v[(n * tx.TOP + rank) * tx.FILTERS + f])
    return out


def test_scores_equal_loops_whatever_stands_beside(net):
    texts = ["en1 nastyword en2", "", "vileword", "GRIMWORD nastyword vileword", "x", "en1 en2 en3 en4 en5 grimword", None, "vileword vileword"]
    want = [naive_logit(net, t) for t in texts]
    assert np.allclose([*map(float, score(net, texts))], 1 / (1 + np.exp(-(net.scale * np.array(want) + net.shift))), atol=1e-5)
    assert np.allclose(score(net, texts), [score(net, [t])[0] for t in texts], atol=1e-6)


def test_thresholds_by_language(net):
    assert set(net.thresholds) == {"en", "de"} and all(0 < t < 1 for t in net.thresholds.values())


def test_training_is_repeatable():
    rows, labels = corpus(200)
    a, b = (tx.train([t for _, t, _ in rows], np.array([x[2] for x in labels]), [None] * len(rows), epochs=2) for _ in range(2))
    assert np.array_equal(score(a, ["en1 vileword"]), score(b, ["en1 vileword"]))


@pytest.mark.parametrize("y", [[], [0, 0], [1, 1]])
def test_degenerate_training(y):
    net = tx.train(["a b"] * len(y), np.array(y), ["en"] * len(y))
    s = score(net, ["a", None])
    assert s[0] == s[1] and (s[0] > 0.5) == (y == [1, 1])


def test_dataframe_side(spark, net):
    rows, labels = corpus(200)
    d = docs(spark, [*rows, (None, None), (5, rows[5][1], "en"), (900, "Nastyword and vileword", None)]).withColumn("toxicity", F.lit(1))
    lab = spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    model = tx.fit_toxicity(d, lab, F.col("doc_id") % 2 == 0, train_rows=50)
    assert model.scale > 0
    kept = tx.reject_toxic(d, net)
    assert kept.columns == d.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert None in ids and 900 not in ids and ids.count(5) == 2 and not {i for i in range(200) if i % 7 == 0} & set(ids)
    empty = docs(spark, [])
    assert tx.reject_toxic(empty, tx.fit_toxicity(empty, lab.limit(0))).count() == 0


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import op1_toxicity

    got = op1_toxicity(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["predicted"][got["toxic"] == 0] == 0).mean() >= 0.995  # clean documents are left alone
    assert (got["predicted"][got["toxic"] == 1] == 1).mean() >= 0.8
    insult = r"(?i)\b(idiot|moron|scum|clown|stupid|loser|trash|pathetic|worthless|disgusting)\b"
    text = spark.read.parquet(f"{SF}/documents.parquet").where(F.col("text").rlike(insult)).select("doc_id").toPandas()
    assert (got["predicted"][got["doc_id"].isin(set(text["doc_id"]))] == 1).mean() >= 0.98
