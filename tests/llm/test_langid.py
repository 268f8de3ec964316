import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs
from tidemark.llm import langid

EN = ["the cat sat on the mat and the dog", "this is the house that they have built with the others", "what are the things which they want"]
DE = ["der Hund und die Katze sind nicht hier", "ich weiß nicht, was soll es bedeuten", "über die Straße geht der Mann mit dem Hut"]


@pytest.fixture(scope="module")
def model():
    return langid.train(EN + DE, ["en"] * 3 + ["de"] * 3)


def test_kernel_counts_shared_ngrams():
    def grams(t):
        b = bytes(x if 97 <= x <= 122 or x >= 128 else 32 for x in t.lower().encode())
        out = set()
        for n in range(1, 5):
            for i in range(len(b) - n + 1):
                v = int.from_bytes(b[i:i + n], "big")
                out.add(((v * int(langid._MULT[n - 1])) & 0xFFFFFFFF) >> (32 - langid.BITS))
        return out

    rows = langid.presence_rows(EN + DE + ["", None, "É"])
    k = rows @ rows.T
    for i, a in enumerate(EN + DE):
        for j, b in enumerate(EN + DE):
            ga, gb = grams(a), grams(b)
            assert k[i, j] == pytest.approx(len(ga & gb) / np.sqrt(len(ga) * len(gb)), rel=1e-4)
    assert not rows[6].any() and not rows[7].any()


def test_folded_product_is_the_kernel_expansion():
    lm, dual = langid.presence_rows(EN), np.array([[0.5], [-1.0], [2.0]])
    m = langid.LanguageModel(["x"], lm, dual, np.array([0.25]))
    rows = langid.presence_rows(DE)
    assert np.allclose(m.outputs(rows), (rows @ lm.T) @ dual + 0.25, atol=1e-5)


def test_fit_is_kernel_ridge_on_the_landmarks():
    """Outputs equal the regression solved directly for the landmarks' weights, the kernel taken from the texts."""
    texts, langs = [*EN, *DE, "the mat", "der Hut ist hier"], ["en"] * 3 + ["de"] * 3 + ["en", "de"]
    m = langid.train(texts, langs, n_landmarks=4, ridge=0.01)
    rows = langid.presence_rows(texts)
    picks = [3, 0, 4, 1]  # languages in turn
    knm, kmm = (rows @ rows[picks].T).astype(float), (rows[picks] @ rows[picks].T).astype(float)
    for col, lang in enumerate(m.langs):
        t = np.array([1.0 if x == lang else -1.0 for x in langs])  # four rows of either language: equal weights
        left = sum(np.outer(k, k) for k in knm) + 0.01 * len(texts) * kmm
        alpha = np.linalg.solve(left, sum(k * (y - t.mean()) for k, y in zip(knm, t, strict=True)))
        assert np.allclose(m.outputs(rows)[:, col], knm @ alpha + t.mean(), atol=1e-4)


def test_defined_results(spark, model):
    rows = [(0, "the house on the street"), (1, "die Katze und der Hund"), (2, None), (3, ""), (4, "123 !! 45"), (5, "the cat " * 20000),
            (None, "the dog and the cat"), (0, "the house on the street"), (7, "日本")]
    d = docs(spark, rows).withColumn("lang_pred", F.lit(0)).withColumn("language", F.lit(0))
    got = [(r["doc_id"], r["p"]["lang"], r["p"]["score"]) for r in d.select("doc_id", langid.predict_language(
        model, F.col("text")).alias("p")).collect()]
    assert [x[1] for x in got[:7]] == ["en", "de", "und", "und", "und", "en", "en"] and got[0] == got[7] and got[8][1] != "und"
    assert all(0 <= x[2] <= 1 for x in got)
    kept = langid.reject_language(d, model)
    assert kept.columns == d.columns and {0, 1, 5, None} <= {r["doc_id"] for r in kept.collect()} and kept.count() <= 6
    assert langid.reject_language(d, model, languages=["de"]).count() >= 1
    none = langid.fit_language(d.where("false"))
    assert none is None and langid.reject_language(d, none).count() == 0


def test_fit_uses_given_rows_only(spark):
    d = docs(spark, [(i, t, x) for i, (t, x) in enumerate([(t, "en") for t in EN] + [(t, "de") for t in DE])] + [(9, "abc", None), (8, None, "fr")])
    assert langid.fit_language(d).langs == ["de", "en"]
    assert langid.fit_language(d, F.col("doc_id") < 3).langs == ["en"]


def test_held_out_accuracy(spark):
    from tidemark.llm.queries import op2_language

    sf = "/root/testdata/sf0.1"
    got = op2_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["lang_pred"] == got["lang"]).mean() >= 0.98 and len(got) > 1500
