import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import crc, docs
from tidemark.llm import quality
from tidemark.llm import textkit as tk

SF = "/root/testdata/sf0.01"


def rows_of(texts):
    raw, off = tk.buffers(pa.array(texts, pa.string()))
    return quality.statistics(raw, off)


def test_statistics_equal_a_plain_count():
    texts = ["", None, "The cat. The cat!", "A!! b*** | | 12 é漢", "go go go\n\ngo go go\nstop?", "\n\n"]
    got = dict(zip(quality.NAMES, rows_of(texts).T, strict=True))
    assert (rows_of(["", None, " \n"]) == 0).all()
    w = [(t or "").lower().split() for t in texts]
    for i in (2, 3, 4):
        t, x = texts[i], w[i]
        n = len(x)
        symbols = [c for c in t if c.isascii() and not c.isalnum() and not c.isspace()]
        assert got["words"][i] == pytest.approx(np.log1p(n))
        assert got["word_size"][i] == pytest.approx(np.log1p(len(t) / n))
        assert got["upper"][i] == pytest.approx(np.sqrt(sum(c.isupper() for c in t) / sum(len(c.encode()) if c.isalpha() else 0 for c in t)))
        assert got["symbols"][i] == pytest.approx(np.sqrt(len(symbols) / len(t)))
        assert got["digits"][i] == pytest.approx(np.sqrt(sum(c.isdigit() for c in t) / len(t)))
        assert got["repeats"][i] == pytest.approx(np.sqrt(sum(a == b for a, b in zip(x, x[1:])) / n))
        assert got["no_letter_words"][i] == pytest.approx(np.sqrt(sum(not any(c.isalpha() for c in y) for y in x) / n))
        assert got["distinct_words"][i] == pytest.approx(np.log1p(len(set(x))) / np.log1p(n))
        assert got["distinct_pairs"][i] == pytest.approx(np.log1p(len(set(zip(x, x[1:])))) / np.log1p(max(n - 1, 1)))
        assert got["top_word"][i] == pytest.approx(np.sqrt(max(map(x.count, x)) / n))
        lines = [y for y in t.split("\n") if y]
        assert got["repeated_lines"][i] == pytest.approx(np.sqrt((len(lines) - len(set(lines))) / len(lines)))
        assert got["line_words"][i] == pytest.approx(np.log1p(n / len(lines)))
        assert got["stops"][i] == pytest.approx(np.sqrt(sum(y[-1] in ".!?" and any(c.isalpha() for c in y) for y in x) / n))


def test_statistics_do_not_depend_on_neighbours():
    texts = ["Aa aa", "aa!!", "!!aa", "", "12 12", "é é", "\nx\nx", "x"]
    assert np.allclose(rows_of(texts), np.concatenate([rows_of([t]) for t in texts]))


def test_moments_and_densities_equal_a_plain_fit(spark):
    r = np.random.default_rng(4)
    p = len(quality.NAMES)
    x = r.normal(size=(300, p)) @ r.normal(size=(p, p)) + 3
    good = r.random(300) < 0.7
    x[good] += 1.5
    rows = spark.createDataFrame([(a.tolist(), bool(g), False) for a, g in zip(x, good, strict=True)],
                                 "x array<double>, good boolean, hold boolean")
    moments = quality._summed(rows, "x", "good", "hold")
    assert [m[0] for m in moments] == [(~good).sum(), good.sum()]
    lam, gam = 0.3, 0.05
    model = quality.Discriminant(moments, lam, gam)
    cov = [np.cov(x[good == k].T, bias=True) for k in (False, True)]
    share = np.array([(~good).mean(), good.mean()])
    pooled = share[0] * cov[0] + share[1] * cov[1]
    scale = np.sqrt(np.diag(pooled))
    z = (x - x.mean(0)) / scale
    want = []
    for k, s in zip((False, True), share, strict=True):
        c = ((1 - lam) * cov[int(k)] + lam * pooled) / np.outer(scale, scale)
        c = (1 - gam) * c + gam * np.trace(c) / p * np.eye(p)
        d = z - z[good == k].mean(0)
        want.append(np.log(s) - 0.5 * np.linalg.slogdet(c)[1] - 0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))
    assert np.allclose(model.difference(x), want[1] - want[0])
    binned = quality._binned(rows, "x", "good", [model])
    assert binned.sum() == 300 and binned[0, 1].sum() == good.sum()


def test_held_out_rows_are_told_apart(spark):
    from tidemark.llm.queries import op13_quality

    got = {r["doc_id"]: r for r in op13_quality(spark, SF).collect()}
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == table.count()
    assert all(r["held_out"] == (crc(i) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)
               for i, r in got.items())
    lab = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(got[i]["score"], q) for i, q in lab.items() if got[i]["held_out"]]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert len(bad) > 8 and np.mean([(a > b) + (a == b) / 2 for a in good for b in bad]) > 0.98
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in held]) > 0.95


def test_odd_rows_and_labels(spark):
    d = docs(spark, [(0, None), (1, ""), (2, "A b c."), (2, "A b c."), (None, "x"), (3, "w " * 200000), (4, "!" * 100000)])
    rows = quality.with_statistics(d.withColumn("Words", F.lit(1)), "stats")
    assert rows.columns == [*d.columns, "Words", "stats"]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit_quality(rows, none, "stats").value == 0.5
    one = spark.createDataFrame([(2, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert quality.fit_quality(rows, one, "stats").value == 0.95
    both = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (2, 0), (3, 1), (4, 0)], "doc_id long, quality int")
    model = quality.fit_quality(rows, both, "stats")
    scored = [r["s"] for r in rows.select(quality.quality_score(model, F.col("stats")).alias("s")).collect()]
    assert len(scored) == 7 and all(0 <= s <= 1 for s in scored)
    assert quality.reject_poor(d, model).columns == d.columns
    empty = quality.with_statistics(docs(spark, []), "stats")
    assert empty.select(quality.quality_score(model, F.col("stats"))).count() == 0
    assert quality.fit_quality(empty, both, "stats").value == 0.5
