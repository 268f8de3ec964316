import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs, spaced
from tidemark.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, top=2):
    """Share by weight, stop at the cap, share the excess again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    cap = {s: top * sizes[s] for s in names}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap[s]}
        if not over:
            out.update({s: level * w[s] for s in open_})
            break
        for s in over:
            out[s] = cap[s]
            left -= cap[s]
        open_ -= over
    return out


def coin(i, t):
    return int(hashlib.md5(f"mix-1:{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:13], 16) / 16**13


ROWS = [(i, "w " * (i % 7) + "x", "en", f"s{i % 5}") for i in range(200)] + [
    (300, None, "en", "s1"), (301, "", "en", "none"), (302, "a b\tc\x0bd é", "en", None), (None, "q r", "en", "s2"),
    (5, "again a b", "en", "s0"), (303, "big " * 50000, "en", "s3"), (304, "u", "en", "\uffff"), (305, "v", "en", "\U0001F600")]


def check(got, rows):
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(spaced(t))
    target = brute_targets(size)
    want = []
    for i, t, _, s in rows:
        n, rate = len(spaced(t)), target[s] / size[s] if size[s] else 0
        want.append((i, n, size[s], pytest.approx(target[s]), n * (int(rate) + (coin(i, t) < rate - int(rate)))))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_plan_equals_brute_force(spark, monkeypatch):
    d = docs(spark, ROWS).withColumn("size", F.lit("mine"))
    for limit in (mixing.BROADCAST_SOURCES, 0):
        monkeypatch.setattr(mixing, "BROADCAST_SOURCES", limit)
        plan = mixing.mix_plan(d, keep=["doc_id"], names=["n", "s", "t", "k"])
        check(plan.select("doc_id", "n", "s", "t", F.col("n") * F.col("k")).collect(), ROWS)


def test_query_near_targets_sf001(spark):
    from tidemark.llm.queries import op3_mixing

    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"], "", r["source"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op3_mixing(spark, sf).collect()
    check(got, rows)
    assert all(r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), rel=0.05)


@pytest.mark.parametrize("ids", [lambda i: None, lambda i: 7])
def test_ids_missing_or_repeated_stay_near_the_target(spark, ids):
    rows = [(ids(i) if i % 10 else i, f"t{i} " + "w " * (i % 3), "en", "ab"[i % 4 == 0]) for i in range(4000)]
    got = mixing.mix_plan(docs(spark, rows), keep=["source"]).groupBy("source").agg(
        F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 2 and all(r["taken"] == pytest.approx(r["target"], rel=0.05) for r in got)


def test_mix_emits_copies(spark):
    d = docs(spark, ROWS).withColumn("mix_size", F.lit(1))
    plan = {(r["doc_id"], r["text"]): r["copies"] for r in mixing.mix_plan(d, keep=["doc_id", "text"]).collect()}
    out = mixing.mix(d)
    assert out.columns == d.columns
    got = {}
    for r in out.collect():
        got[(r["doc_id"], r["text"])] = got.get((r["doc_id"], r["text"]), 0) + 1
    assert got == {k: v for k, v in plan.items() if v}


def test_empty_table(spark):
    d = docs(spark, [])
    assert mixing.mix_plan(d, keep=["doc_id"]).count() == 0 and mixing.mix(d).count() == 0


def test_plan_is_native(spark):
    plan = mixing.mix(docs(spark, ROWS))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
