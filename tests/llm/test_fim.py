import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.helpers import docs
from tidemark.llm import fim

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


def brute(text, h):
    text = text or ""
    u = UNIT.findall(text)
    n = len(u)
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if h[3] % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def draws(text_id, seed=1):
    import hashlib

    d = hashlib.sha256(f"{seed}:{'' if text_id is None else text_id}".encode()).hexdigest()
    return [int(d[i:i + 8], 16) for i in (0, 8, 16, 24)]


@given(st.lists(st.integers(0, 6), max_size=300))
@settings(max_examples=60, deadline=None)
def test_rank_and_select_equal_counting(symbols):
    s = np.array(symbols, np.uint8)
    m = fim.WaveletMatrix(s)
    at = np.arange(len(s) + 1)
    for c in range(7):
        assert (m.rank(c, at) == np.concatenate([[0], np.cumsum(s == c)])).all()
        where = np.flatnonzero(s == c)
        assert m.select(c, np.arange(len(where) + 1)).tolist() == [*where.tolist(), len(s)]


@given(st.lists(st.text(alphabet="abZ 1\n<>PSMé漢\U0001f600\x00", max_size=40), max_size=30), st.integers(0, 2**32))
@settings(max_examples=80, deadline=None)
def test_cuts_equal_a_list_of_units(texts, seed):
    r = random.Random(seed)
    h = np.array([[r.getrandbits(32) for _ in range(4)] for _ in texts], np.int64).reshape(-1, 4)
    got = fim.transform(pa.array(texts, pa.string()), h).to_pylist()
    assert [tuple(g.values()) for g in got] == [brute(t, x) for t, x in zip(texts, h.tolist(), strict=True)]


ROWS = [(0, None), (1, ""), (2, "one"), (3, "a <P> inside"), (4, "<S"), (5, "é\U0001f600 straße 漢字"), (6, "word " * 60000),
        (7, "z" * 3_000_000), (8, "\n\n\t "), (8, "\n\n\t "), (None, "no id here at all"), (9, "a\x00b<M")]


def test_odd_rows_forms_and_exact_round_trip(spark):
    d = docs(spark, ROWS).withColumn("N", F.lit("mine")).withColumn("form", F.lit(1))
    made = fim.with_fim(d, "r")
    assert made.columns == [*d.columns, "r"]
    rows = made.select("doc_id", "text", "N", "r", fim.restore(F.col("r.text"), F.col("r.form")).alias("back")).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert tuple(r["r"]) == brute(r["text"], draws(r["doc_id"])) and r["back"] == (r["text"] or "") and r["N"] == "mine"


def test_every_form_occurs_and_parameters_hold(spark):
    d = docs(spark, [(i, f"some words of text {i}, and a few more.") for i in range(400)])
    forms = {r["f"]: r["n"] for r in fim.with_fim(d, "r").groupBy(F.col("r.form").alias("f")).agg(F.count("*").alias("n")).collect()}
    assert set(forms) == {"plain", "psm", "spm"} and 15 < forms["plain"] < 75 and 40 < forms["spm"] < 110
    own = fim.with_fim(d, "r", seed=5, marks=("[p]", "[s]", "[m]"), plain_from=100, spm_below=100)
    for r in own.select("text", "r", fim.restore(F.col("r.text"), F.col("r.form"), ("[p]", "[s]", "[m]")).alias("back")).collect():
        assert r["r"]["form"] == "spm" and r["r"]["text"].startswith("[s]") and r["back"] == r["text"]


def test_empty_table(spark):
    assert fim.with_fim(docs(spark, []), "r").count() == 0
