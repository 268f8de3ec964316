import hashlib

from pyspark.sql import functions as F

from tests.llm.helpers import alnum, docs
from tidemark.llm import decontaminate as dc

P = " ".join(f"w{i}" for i in range(20))
ITEMS = [(1, P), (2, "Alpha beta, GAMMA"), (3, None), (4, "..."), (5, "solo"), (2, "Alpha beta, GAMMA"), (10, P), (None, "nameless item here"),
         (6, "é Ünder \x85 score")]
DOCS = [(0, "x " * 5 + P.replace(" ", ". ") + " y"), (1, "alpha! BETA gamma alpha beta gamma"), (2, None), (3, ""), (4, "-- .. "),
        (5, "solo solo x"), (6, " ".join(P.split()[3:15])), (7, " ".join(P.split()[3:16]) + " z" * 500),
        (8, "nameless item here"), (9, "É ünder"), (10, "é Ünder \x85 score"), (5, "solo solo x"), (11, "q " * 60000 + P)]


def brute(documents, items, n=13):
    windows = {}
    for i, t in items:
        w = alnum(t)
        k = min(n, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[a:a + k]), set()).add(i)
    out = []
    for d, t in documents:
        w, hit, ids = alnum(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                got = windows.get(tuple(w[a:a + k]))
                if got:
                    hit |= set(range(a, a + k))
                    ids |= {str(x) for x in got if x is not None}
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


def bench(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def test_rows_equal_brute_force(spark):
    for block in (dc.BLOCK_BYTES, 1):
        d = docs(spark, DOCS).withColumns({c: F.lit("mine") for c in ("hits", "a", "b", "i", "text_key")})
        got = sorted(tuple(r) for r in dc.contamination(d, bench(spark, ITEMS), block_bytes=block).collect())
        assert got == brute(DOCS, ITEMS)


def test_query_equals_brute_force_sf0001(spark):
    from tidemark.llm.queries import op4_decontamination

    sf = "/root/testdata/sf0.001"
    d = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    b = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in op4_decontamination(spark, sf).collect())
    assert got == brute(d, b) and any(r[5] for r in got)


def test_drop_and_cut(spark):
    d, b = docs(spark, DOCS).withColumn("score", F.lit(1)), bench(spark, ITEMS)
    bad = {r[0] for r in brute(DOCS, ITEMS) if r[5]}
    kept = dc.drop_contaminated(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, _ in DOCS if i not in bad)
    cut = {r["doc_id"]: r["text"] for r in dc.cut_spans(d, b).collect()}
    assert cut[1] == "" and cut[2] is None and cut[6] == DOCS[6][1] and cut[0] == "x " * 5 + " y" and cut[9] == "É ünder"


def test_empty_tables(spark):
    assert dc.contamination(docs(spark, []), bench(spark, ITEMS)).count() == 0
    got = dc.contamination(docs(spark, DOCS), bench(spark, [])).collect()
    assert len(got) == len(DOCS) and not any(r["contaminated"] or r["n_hit"] for r in got)


def test_window_set_of_colliding_hashes_and_its_size(monkeypatch):
    """Windows of one hash stay apart, repeats count once an item, and the set stays small against its text."""
    import random

    import numpy as np
    import pyarrow as pa

    from tidemark.llm import textkit as tk

    r = random.Random(3)
    texts = [" ".join(r.choice("abcdefgh") + str(r.randint(0, 60)) for _ in range(r.choice([3, 13, 40]))) for _ in range(60)]
    items = [(str(i), t) for i, t in enumerate(texts)] + [("x", texts[0]), ("x", texts[1] + " . " + texts[1]), (None, texts[2])]
    real = tk.run_hashes
    monkeypatch.setattr(tk, "run_hashes", lambda h, n: real(h, n) & np.uint64(0x700000000000000F))
    docs_ = [(i, " ".join(r.choice(texts).split()[:r.randint(1, 40)]) + " " + r.choice(texts)) for i in range(80)]
    got = [dc.judged(*x) for x in dc.scan(pa.array([t for _, t in docs_], pa.string()), dc.WindowSet(items))]
    want = {w[0]: w[1:] for w in brute(docs_, items)}
    assert all((g["n_words"], g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == want[i] for i, g in enumerate(got))
    monkeypatch.undo()
    words = [f"{r.choice('abcdefgh')}{r.randint(0, 10**6)}" for _ in range(200_000)]
    big = dc.WindowSet([(str(i), " ".join(words[i * 100:i * 100 + 100])) for i in range(2000)])
    held = sum(x.nbytes for x in (big.data, *big.sizes[13][:3], *big.sizes[13][3], big.sizes[13][4]))
    assert len(big.sizes[13][0]) > 170_000 and held < 16 * len(big.data) + (1 << 24)


def test_hash_sample_is_bounded_by_ties(spark):
    from tidemark.llm.frames import hash_sample

    rows = spark.range(50_000).select(F.lit(7).alias("i"), F.lit("the same").alias("t"), F.col("id").alias("sample_key")).unionByName(
        spark.range(500).select(F.col("id").cast("int").alias("i"), F.lit("other").alias("t"), F.col("id").alias("sample_key")))
    got = [hash_sample(rows, 100, "i", "t").select("i", "t").collect() for _ in range(2)]
    assert len(got[0]) == 100 and sorted(got[0]) == sorted(got[1]) and len(set(got[0])) == 100
    assert hash_sample(rows, 1000, "i", "t").count() == 501 and hash_sample(rows.limit(0), 5, "i").count() == 0
