import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import docs, spaced, union_find
from tidemark.llm import simhash
from tidemark.llm.components import components


def brute_fp(text, n=3):
    w = spaced(text)
    if not w:
        return 0
    parts = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


TEXTS = [(0, "a b c d e f g h"), (1, "A B C d e f g h"), (2, None), (3, ""), (4, " \t\n"), (5, "one"), (6, "one two"),
         (7, "straße Äß ÄÖ straße\x0bx"), (8, "a b c d e f g h"), (9, "x " * 30000), (10, "z" * 100000)]


def test_fingerprints(spark):
    got = {r["doc_id"]: r["f"] for r in docs(spark, TEXTS).select("doc_id", simhash.fingerprint(F.col("text")).alias("f")).collect()}
    assert got == {i: signed(brute_fp(t)) for i, t in TEXTS}


def test_bound_never_exceeds_bit_distance(spark):
    r = random.Random(3)
    rows = []
    for _ in range(400):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), r.randint(0, 6)):
            b ^= 1 << k
        rows.append((signed(a), signed(b)))
    df = spark.createDataFrame(rows, "a long, b long")
    d = simhash.count_distance(simhash.segment_counts(F.col("a")), simhash.segment_counts(F.col("b")))
    for r_ in df.select("a", "b", d.alias("d"), F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).alias("h")).collect():
        x = [bin((r_["a"] >> (2 * i)) & 3).count("1") - bin((r_["b"] >> (2 * i)) & 3).count("1") for i in range(32)]
        assert r_["d"] == sum(map(abs, x)) <= r_["h"]


def test_near_pairs_equal_brute_force(spark):
    r = random.Random(5)
    prints = set()
    for _ in range(60):
        a = r.getrandbits(64)
        prints.add(a)
        for _ in range(6):
            b = a
            for k in r.sample(range(64), r.randint(1, 5)):
                b ^= 1 << k
            prints.add(b)
    prints = sorted(map(signed, prints))
    got = {(x["a"], x["b"]) for x in simhash.near_pairs(spark.createDataFrame([(p,) for p in prints], "fp long")).collect()}
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1:] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want and len(want) > 100


def test_query_equals_brute_force_sf0001(spark):
    from tidemark.llm.queries import op6_simhash

    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in op6_simhash(spark, sf).collect()}
    rows = [(r["doc_id"], brute_fp(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pairs = [(i, j) for k, (i, a) in enumerate(rows) for j, b in rows[k + 1:] if bin(a ^ b).count("1") <= 3]
    low = union_find([i for i, _ in rows], pairs)
    assert got == {i: (f"{f:016x}", low[i]) for i, f in rows}
    assert len(set(low.values())) < len(rows)


def test_groups_of_odd_rows(spark):
    d = docs(spark, [*TEXTS, (None, "a b c d e f g h"), (8, "a b c d e f g h"), (None, "only without id here")])
    got = {(r["id"], r["fp"]): r["component_id"] for r in simhash.simhash_groups(d).collect()}
    by_id = {k[0]: v for k, v in got.items() if k[0] is not None}
    assert by_id[0] == by_id[1] == by_id[8] == 0 and by_id[2] == by_id[3] == by_id[4] == 2
    assert got[(None, signed(brute_fp("a b c d e f g h")))] == 0
    assert got[(None, signed(brute_fp("only without id here")))] is None
    assert simhash.simhash_groups(d).count() == d.count()


def test_dedup_keeps_one_row_of_each_group(spark):
    rows = [*TEXTS, (None, "a b c d e f g h"), (0, "a b c d e f g h"), (None, "only without id here"), (None, "only without id here")]
    d = docs(spark, rows).withColumn("fp", F.lit("mine")).withColumn("Row_ID", F.lit(1))
    kept = simhash.simhash_dedup(d)
    assert kept.columns == d.columns
    got = sorted((r["doc_id"] if r["doc_id"] is not None else 99, r["text"] or "") for r in kept.collect())
    assert [i for i, _ in got] == [0, 2, 5, 6, 7, 9, 10, 99]


def test_empty_table(spark):
    d = docs(spark, [])
    assert simhash.simhash_groups(d).count() == 0 and simhash.simhash_dedup(d).count() == 0


@pytest.mark.parametrize("pairs", [[], [(1, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 50)],
                                   [(5, 3), (3, 5), (9, 7), (None, 4), (7, 5)]])
def test_components(spark, pairs):
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [(a, b) for a, b in pairs if a is not None and b is not None and a != b]
    want = union_find({x for p in real for x in p}, real)
    assert got == want


def test_dedup_of_text_ids_and_of_rows_that_differ_elsewhere(spark):
    rows = [("b", "a b c d e f g h", "x"), ("a", "a b c d e f g h", "y"), ("a", "a b c d e f g h", "z"), (None, "a b c d e f g h", "x"),
            (None, "quite another text here", "q"), (None, "quite another text here", "r"), ("10", "", "e"), ("9", None, "e")]
    d = spark.createDataFrame(rows, "doc_id string, text string, more string").withColumn("No_Id", F.lit(1))
    got = [sorted(map(tuple, simhash.simhash_dedup(d.repartition(k)).collect()), key=str) for k in (1, 5)]
    assert got[0] == got[1] and [r[0] for r in got[0]] == ["10", "a", None] or sorted(str(r[0]) for r in got[0]) == ["10", "None", "a"]
    assert got[0] == got[1] and simhash.simhash_dedup(d).columns == d.columns
