"""Day words against sets of days, footer statistics, order proofs, runs since a reset, checkpoints that go."""

import datetime as dt
import glob
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.conftest import SF001
from tidemark.functions.exprs import day_of
from tidemark.operators import calendar as cal
from tidemark.operators import daybits, slices
from tidemark.operators.prefix import rows_since
from tidemark.sources import archive as arc
from tidemark.sources import fixtures as fx


def _days(spark, seed, lo, n_keys=12, span=400):
    r = random.Random(seed)
    rows = {(k, lo + dt.timedelta(days=d)) for k in range(n_keys) for d in range(span) if r.random() < (k + 1) / (n_keys + 1)}
    rows |= {(100, lo + dt.timedelta(days=d)) for d in range(span)}  # no gap at all, over word edges
    return spark.createDataFrame([(k, d) for k, d in sorted(rows)], "k long, day date").withColumn("at", F.col("day").cast("timestamp_ntz"))


@pytest.mark.parametrize("lo", [dt.date(2023, 11, 20), dt.date(1969, 10, 1)])
def test_day_words_equal_the_calendar_operators(spark, scratch, lo):
    df = _days(spark, 3, lo)
    mid = lo + dt.timedelta(days=150)
    for part in (df.where(F.col("day") < mid), df.where(F.col("day") >= mid), df.where(F.col("day") >= mid)):  # one comes twice
        daybits.add_increment(daybits.day_words(part, ["k"], "at"), f"{scratch}/words")
    words = daybits.read_words(spark, f"{scratch}/words", ["k"])
    a, b = lo + dt.timedelta(days=10), lo + dt.timedelta(days=350)
    have = {(r["k"], r["day"]) for r in df.collect()}
    want = {(k, a + dt.timedelta(days=i)) for k in {k for k, _ in have} for i in range((b - a).days + 1)} - have
    assert {tuple(r) for r in daybits.missing_days(words, a, b, ["k"]).collect()} == want
    runs = {tuple(r) for r in daybits.runs(words, ["k"]).collect()}
    assert runs == {tuple(r) for r in cal.contiguous_runs(df.select("k", "day").distinct(), keys=["k"]).select(
        "k", "run_start", "run_end", F.col("n_days").cast("long")).collect()}
    got = {r["k"]: (r["headroom"], r["capped"]) for r in daybits.headroom(words, a, ["k"], 60).collect()}
    for k in {k for k, _ in have}:
        n = next((i for i in range(61) if (k, a + dt.timedelta(days=i)) not in have), 61)
        assert got[k] == (n, n == 61)
    daybits.compact(spark, f"{scratch}/words", ["k"], f"{scratch}/one")
    assert daybits.read_words(spark, f"{scratch}/one", ["k"]).exceptAll(words).count() == 0


def test_day_words_of_null_keys_and_times(spark):
    df = spark.createDataFrame([(None, dt.datetime(2024, 1, 1)), (None, dt.datetime(2024, 1, 3)), (1, None)], "k long, at timestamp_ntz")
    words = daybits.day_words(df, ["k"], "at")
    assert [tuple(r) for r in daybits.missing_days(words, "2024-01-01", "2024-01-03", ["k"]).collect()] == [(None, dt.date(2024, 1, 2))]
    assert [r["headroom"] for r in daybits.headroom(words, "2024-01-01", ["k"]).collect()] == [1]


def test_footer_stats_read_no_row_group(spark, scratch):
    t = fx.ticks(spark, SF001).withColumn("day", day_of("bus_time"))
    t.write.partitionBy("day").parquet(f"{scratch}/t")
    before = {k: spark.conf.get(k, None) for k in slices.FOOTER_CONF}
    try:
        for k, v in slices.FOOTER_CONF.items():
            spark.conf.set(k, v)
        plan = slices.footer_aggregate(spark, f"{scratch}/t", "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert "PushedAggregation: [COUNT(*), MIN(id), MAX(id)]" in plan and "PushedGroupBy: [day]" in plan
    days = [dt.date(2024, 1, 3), dt.date(2024, 1, 5)]
    got = {r["day"]: tuple(r)[1:] for r in slices.footer_stats(spark, f"{scratch}/t", "id", days).collect()}
    want = {r["day"]: tuple(r)[1:] for r in t.where(F.col("day").isin(days)).groupBy("day").agg(
        F.count("*"), F.min("id"), F.max("id") + 1).collect()}
    assert got == want and {k: spark.conf.get(k, None) for k in slices.FOOTER_CONF} == before


SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("n", T.LongType()), T.StructField("at", T.TimestampNTZType())])


def _archive(spark, scratch, fmt, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    arc.write_day_archive(df, scratch, "at", ["a", "n"], n_parts=12, fmt=fmt)
    return arc.read_archive(spark, scratch, SCHEMA, fmt=fmt)


@pytest.mark.parametrize("fmt", ["csv", "csv.zst", "parquet"])
def test_order_over_many_parts(spark, scratch, fmt):
    r = random.Random(1)
    rows = [(r.choice([None, "", "b", "é", "z"]), r.choice([None, 1, 2, 30]), dt.datetime(2024, 1, d, 1)) for d in (1, 2) for _ in range(400)]
    archive = _archive(spark, f"{scratch}/x", fmt, rows)
    got = {r["day"].day: r for r in arc.day_order(archive, ["a", "n"]).collect()}
    assert all(got[d]["n_parts"] >= 3 and got[d]["in_order"] and got[d]["n_rows"] == 400 for d in (1, 2))
    parts = sorted(glob.glob(f"{scratch}/x/day=2024-01-02/part-*"))
    os.rename(parts[0], f"{scratch}/aside")
    os.rename(parts[-1], parts[0])
    os.rename(f"{scratch}/aside", parts[-1])
    for crc in glob.glob(f"{scratch}/x/day=2024-01-02/.*.crc"):
        os.remove(crc)
    got = {r["day"].day: r for r in arc.day_order(arc.read_archive(spark, f"{scratch}/x", SCHEMA, fmt=fmt), ["a", "n"]).collect()}
    assert got[1]["in_order"] and not got[2]["in_order"] and got[2]["breaks"] == 2 and got[2]["inversions"] == 0


def test_order_counts_inversions_within_a_part(spark, scratch):
    at = dt.datetime(2024, 1, 1)
    keys = [("a", 1), ("a", 3), ("a", 2), ("b", None), ("a", 9), ("b", 0), ("b", None)]
    df = spark.createDataFrame([(a, n, at) for a, n in keys], SCHEMA).coalesce(1).withColumn("day", day_of("at"))
    df.write.partitionBy("day").parquet(f"{scratch}/x")
    got = arc.day_order(arc.read_archive(spark, f"{scratch}/x", SCHEMA, fmt="parquet"), ["a", "n"]).first()
    assert (got["inversions"], got["breaks"], got["n_rows"]) == (3, 0, 7)


def test_rows_since_a_reset_over_many_ranges(spark):
    r = random.Random(2)
    rows = [(k, n, r.random() < 0.02) for k in ("x", "y") for n in r.sample(range(100000), 600)] + [("z", n, False) for n in range(50)]
    want = []
    for k in ("x", "y", "z"):
        since = 0
        for _, n, ok in sorted(x for x in rows if x[0] == k):
            since = 0 if ok else since + 1
            want.append((k, n, since))
    got = rows_since(spark.createDataFrame(rows, "k string, n long, ok boolean"), ["k"], "n", "ok", "s", parts=13).select("k", "n", "s")
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_registered_queries_leave_no_scratch_checkpoint(spark):
    """What a query leaves in the checkpoint folder is its own settled result and nothing it was computed from."""
    from tidemark.plans.catalog import QUERIES

    root = spark.sparkContext.getCheckpointDir()
    folder = root.removeprefix("file:")
    for name in ("monotonicity_violations", "failure_streaks", "run_tail", "closed_versions"):
        before = set(glob.glob(f"{folder}/rdd-*"))
        df = QUERIES[name](spark, SF001)
        left = set(glob.glob(f"{folder}/rdd-*")) - before
        assert len(left) == 1 and df._jdf.queryExecution().logical().rdd().getCheckpointFile().get().endswith(
            os.path.basename(left.pop())) and df.count() >= 0
