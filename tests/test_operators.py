"""Edge rules of single operators, and distributed forms against brute force."""

import datetime as dt

import pytest

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import decimal_less_than, valid_day_text
from tidemark.operators import calendar as cal
from tidemark.operators import candles as cdl
from tidemark.operators import late, runlog, verify
from tidemark.operators.prefix import prefix_max_before, prefix_sum, ranged, top_n_per_group
from tidemark.sources import fixtures as fx
from tests.conftest import SF001, SF01


def test_decimal_less_than(spark):
    rows = [("007", "10", True), ("10", "9", False), ("0", "0", False), ("000", "1", True),
            ("123456789012345678901", "123456789012345678902", True), ("99999999999999999999", "100000000000000000000", True)]
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    got = df.select((decimal_less_than("a", "b") == F.col("want")).alias("ok")).collect()
    assert all(r.ok for r in got)


def test_valid_day_text(spark):
    rows = [("2024-02-29", True), ("2024-02-30", False), ("2024-2-3", False), ("2023-02-29", False), ("x", False),
            (None, False)]
    df = spark.createDataFrame(rows, "d string, want boolean")
    assert all(r.ok for r in df.select((valid_day_text("d") == F.col("want")).alias("ok")).collect())


def test_purge_target_refuse_and_missing(spark):
    ts = lambda s: dt.datetime.fromisoformat(s)
    children = spark.createDataFrame([
        ("t", "t_a", "r", False, ts("2024-01-01"), ts("2024-01-02")),
        ("t", "t_b", "r", False, ts("2024-01-01"), ts("2024-01-02")),   # second exact child -> REFUSE
        ("t", "t_c", "p", False, ts("2024-01-02"), ts("2024-01-03")),   # not an ordinary leaf -> REFUSE
        ("t", "t_d", "r", False, ts("2024-01-03"), ts("2024-01-04")),   # PARTITION
        ("t", "t_e", "r", False, ts("2024-01-04"), ts("2024-01-06")),   # two-day bound: not exact
    ], "table_name string, leaf_name string, kind string, is_default boolean, bound_lower timestamp_ntz, "
       "bound_upper timestamp_ntz")
    days = spark.createDataFrame([("t", dt.date(2024, 1, d)) for d in range(1, 6)], "table_name string, day date")
    got = {r.day.day: r.target for r in verify.resolve_purge_target(days, children).collect()}
    assert got == {1: "REFUSE", 2: "REFUSE", 3: "PARTITION", 4: "MISSING", 5: "MISSING"}


def test_cover_anchors_contiguous(spark):
    days = spark.range(1).select(F.lit("t").alias("table_name"), cal.day_sequence("2024-01-01", "2024-02-05").alias("day"))
    got = [str(r.anchor) for r in cal.cover_anchors(days).orderBy("anchor").collect()]
    assert got == ["2024-01-01", "2024-01-15", "2024-01-29"]


def test_headroom_capped_and_zero(spark):
    leaves = spark.range(1).select(F.lit("t").alias("table_name"), cal.day_sequence("2024-01-01", "2025-12-31").alias("day"))
    keys = spark.createDataFrame([("t",), ("u",)], "table_name string")
    got = {r.table_name: (r.headroom, r.capped) for r in cal.forward_headroom(leaves, keys, "2024-01-15").collect()}
    assert got == {"t": (401, True), "u": (0, False)}


def test_prefix_scans_match_one_window(spark):
    e = spark.read.parquet(f"{SF01}/events.parquet").select(F.lit("hot").alias("k"), "event_id", "ts", "value")
    w = Window.partitionBy("k").orderBy("event_id")
    brute = e.select("event_id",
                     F.max("ts").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("m"),
                     F.sum(F.round("value").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    e2 = e.withColumn("v", F.round("value").cast("long"))
    fast = prefix_sum(prefix_max_before(e2, ["k"], "event_id", "ts", "m", parts=7), ["k"], "event_id",
                      "v", "s", parts=13).select("event_id", "m", "s")
    assert brute.exceptAll(fast).count() == 0 and fast.exceptAll(brute).count() == 0


def test_top_n_two_stage(spark):
    e = spark.read.parquet(f"{SF01}/events.parquet").select("event_type", "event_id")
    w = Window.partitionBy("event_type").orderBy(F.col("event_id").desc())
    brute = e.withColumn("r", F.row_number().over(w)).where("r <= 5").select("event_type", "event_id", "r")
    fast = top_n_per_group(e, ["event_type"], "event_id", 5, "r", parts=11).select(
        "event_type", "event_id", "r")
    assert sorted(brute.collect()) == sorted(fast.collect())


def test_monotonicity_does_not_depend_on_parts_or_id_spacing(spark):
    t = fx.trades(spark, SF01).select("id", "executed_at")
    assert [late.monotonicity_violations(t, "id", "executed_at", parts=n).count() for n in (1, 37)] == [249, 249]
    # sparse, clustered ids: two far clusters of widely spaced numbers
    sparse = t.withColumn("id", F.when(F.col("id") < 5000, F.col("id") * 1_000_003)
                          .otherwise(F.col("id") * 4_000_037 + F.lit(1 << 60)).cast("long"))
    out = late.monotonicity_violations(sparse, "id", "executed_at", parts=37)
    assert out.count() == 249
    assert "SinglePartition" not in prefix_sum(sparse.withColumn("k", F.lit(1)).withColumn("v", F.lit(1)), ["k"], "id", "v", "s",
                                               parts=37)._jdf.queryExecution().executedPlan().toString()
    # the ranges are even whatever the ids look like
    sizes = [r["count"] for r in ranged(sparse, ["id"], 37).groupBy("_bk").count().collect()]
    assert len(sizes) == 37 and max(sizes) < 2000


def test_synthesized_equals_direct(spark):
    t = fx.ticks(spark, SF01)
    c1m = cdl.ticks_to_candles(t, "1m", ["instrument"], "bus_time", "price", "id")
    syn = cdl.synthesize_candles(c1m, ["instrument"], ["1h", "4h", "1d"], cut_date="2000-01-01")
    for tf in ["1h", "4h", "1d"]:
        direct = cdl.ticks_to_candles(t, tf, ["instrument"], "bus_time", "price", "id")
        mine = syn.where(F.col("timeframe") == tf)
        assert direct.exceptAll(mine).count() == 0 and mine.exceptAll(direct).count() == 0


def test_synthesize_requires_cut_date(spark):
    t = fx.ticks(spark, SF001)
    c1m = cdl.ticks_to_candles(t, "1m", ["instrument"], "bus_time", "price", "id")
    try:
        cdl.synthesize_candles(c1m, ["instrument"], ["1d"])
    except ValueError as ex:
        assert "cut_date" in str(ex)
    else:
        raise AssertionError("1d without cut_date must fail")


def test_failure_streaks(spark):
    runs = spark.createDataFrame([("j", i, f) for i, f in enumerate([True, True, False, True, True, True, False], 1)],
                                 "file string, run_no long, failed boolean")
    got = [(r.streak, r.alarm) for r in runlog.failure_streaks(runs).orderBy("run_no").collect()]
    assert got == [(1, False), (2, True), (0, False), (1, False), (2, True), (3, True), (0, False)]


def test_banner_ignores_done_line(spark):
    log = spark.createDataFrame([("f", 1, "=== job 2024-01-01T00:00:00Z ==="), ("f", 2, "ABORT: x"),
                                 ("f", 3, "=== job done 2024-01-01T00:01:00Z ==="), ("f", 4, "WARN: y")],
                                "file string, line_no long, line string")
    runs = runlog.segment_runs(log, runlog.banner_pattern("job"))
    p = runlog.problem_count(runs).collect()
    assert [(r.run_no, r.n_problems) for r in p] == [(1, 2)]


def test_lookback_since(spark):
    src = spark.createDataFrame([("a", 1706745600), ("b", None)], "source string, last_epoch long")  # 2024-02-01
    got = {r.source: (r.gap_days, r.lookback_days, str(r.since))
           for r in cdl.lookback_since(src, "2024-02-10 12:00:00").collect()}
    assert got == {"a": (10, 10, "2024-01-31"), "b": (0, 4, "2024-02-06")}


def test_read_run_logs_numbers_lines_across_splits(spark, scratch):
    from tidemark.sources.runlog import read_run_logs

    lines = [f"line {i}" for i in range(1, 20001)]
    lines[0] = "=== job 2024-01-01 ==="
    for name in ("a.log", "b.log"):
        with open(f"{scratch}/{name}", "w") as f:
            f.write("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")  # many splits per file
    try:
        got = read_run_logs(spark, scratch)
        rows = got.where(F.col("file").endswith("/b.log")).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 20000
    assert all(r.line == lines[r.line_no - 1] for r in rows)


def test_close_versions_hot_keys_match_plain_window(spark):
    from tidemark.sources import fixtures as fx2

    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    # a hot key: every version of one l_linenumber across all orders, plus ordinary keys
    v = li.select(F.when(F.col("l_linenumber") == 1, F.lit(0)).otherwise(F.col("l_orderkey")).alias("k"),
                  "l_linenumber", "l_partkey", "l_suppkey", F.col("l_shipdate").alias("known_from"))
    keys, order = ["k", "l_linenumber"], ["known_from", "l_partkey", "l_suppkey"]
    w = Window.partitionBy(*keys).orderBy(*order)
    plain = v.withColumn("known_to", F.coalesce(F.lead("known_from").over(w), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")))
    one, split = cdl.close_versions(v, keys, order, parts=1), cdl.close_versions(v, keys, order, parts=50)
    assert plain.exceptAll(one).count() == 0
    assert v.where("k = 0").count() > 100
    assert plain.exceptAll(split).count() == 0 and split.exceptAll(plain).count() == 0
    del fx2


def test_scd2_upsert_invariants(spark):
    from tidemark.plans import catalog

    merged = catalog.q_candle_upsert(spark, SF01)
    keys = ["instrument", "timeframe", "open_at"]
    sentinel = F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")
    active = merged.where(F.col("known_to") == sentinel)
    assert active.groupBy(*keys).count().where("count <> 1").count() == 0      # one active version per bar
    assert active.count() == merged.select(*keys).distinct().count()
    again = cdl.ticks_to_candles(fx.ticks(spark, SF01), "1h", ["instrument"], "bus_time", "price", "id")
    twice = cdl.scd2_upsert(merged, again, keys, cdl.CANDLE_VALUE_COLUMNS, "2024-02-03 00:00:00")
    assert twice.exceptAll(merged).count() == 0 and merged.exceptAll(twice).count() == 0  # idempotent


def test_partition_coverage_without_gaps_or_default(spark):
    from tidemark.plans import jobs

    leaves = spark.range(1).select(F.lit("t").alias("table_name"), cal.day_sequence("2023-12-01", "2024-03-01").alias("day"))
    config = spark.createDataFrame([("t", 6, True)], "table_name string, back_days int, purged_by_retention boolean")
    empty = spark.createDataFrame([], "table_name string, day date")
    dr = spark.createDataFrame([("t", 0)], "table_name string, default_rows long")
    r = jobs.partition_coverage(leaves, config, "2024-01-15", empty, dr).first()
    assert (r.missing, r.dropped, r.anchors, r.first_anchor, r.blocked, r.failed) == (0, 0, 0, None, False, False)
    assert r.headroom == 47 and r.capped is False


def test_operators_accept_zoned_timestamps(spark):
    """Production tables carry TIMESTAMP (UTC), the fixtures TIMESTAMP_NTZ: results must agree."""
    from tidemark.operators import slices

    ntz = fx.ticks(spark, SF001)
    ltz = ntz.withColumn("bus_time", F.col("bus_time").cast("timestamp"))
    a = slices.day_slice(ntz, "bus_time", "2024-01-03", "2024-01-05").count()
    b = slices.day_slice(ltz, "bus_time", "2024-01-03", "2024-01-05").count()
    assert a == b > 0
    cn = cdl.ticks_to_candles(ntz, "1h", ["instrument"], "bus_time", "price", "id")
    cl = cdl.ticks_to_candles(ltz, "1h", ["instrument"], "bus_time", "price", "id") \
        .withColumn("open_at", F.col("open_at").cast("timestamp_ntz"))
    assert cn.exceptAll(cl).count() == 0 and cl.exceptAll(cn).count() == 0
    c1m = cdl.ticks_to_candles(ltz, "1m", ["instrument"], "bus_time", "price", "id")
    syn = cdl.synthesize_candles(c1m, ["instrument"], ["1h", "1d"], cut_date="2024-01-02")
    assert syn.where("timeframe = '1d'").agg(F.min("open_at")).first()[0].date().isoformat() == "2024-01-02"
    v = ltz.select("instrument", F.col("bus_time").alias("known_from"), "id")
    closed = cdl.close_versions(v, ["instrument"], ["known_from", "id"])
    assert closed.where(F.year("known_to") == 9999).count() == ntz.select("instrument").distinct().count()


def test_sizing_helpers(spark):
    from tidemark.session import partitions_for, scanned_bytes

    t = fx.ticks(spark, SF01)
    cores = spark.sparkContext.defaultParallelism
    assert scanned_bytes(t) > 0 and partitions_for(t) >= cores
    assert partitions_for(t, target_bytes=1024) > partitions_for(t)  # smaller parts -> more of them
    assert partitions_for(t, 256 << 20, input_bytes=100 * 10**12) == -(-100 * 10**12 // (256 << 20))  # no cap at 100 TB


def test_shared_dir_needs_a_setting_off_local(spark):
    from types import SimpleNamespace

    from tidemark.session import shared_dir

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None),
                               sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None,
                                                            setCheckpointDir=lambda p: None))

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(session("local-cluster[2,1,1024]"))
    assert shared_dir(session("local[4]"))


def test_run_logs_of_the_same_name_stay_apart(spark, scratch):
    import os

    from tidemark.sources.runlog import read_run_logs

    for d, lines in (("a", ["1", "2"]), ("b", ["x", "y", "z"])):
        os.makedirs(f"{scratch}/{d}")
        with open(f"{scratch}/{d}/2024-01.log", "w") as f:
            f.write("\n".join(lines) + "\n")
    got = sorted((r.file.rsplit("/", 2)[1], r.line_no, r.line) for r in read_run_logs(spark, scratch).collect())
    assert got == [("a", 1, "1"), ("a", 2, "2"), ("b", 1, "x"), ("b", 2, "y"), ("b", 3, "z")]


def test_default_rows_counts_null_days_in_both_forms(spark):
    t = spark.sql("select * from values (timestamp_ntz '2024-01-01 10:00:00', date '2024-01-01'), "
                  "(null, null), (timestamp_ntz '2024-01-02 10:00:00', date '2024-01-02') v(ts, day)")
    leaf = spark.createDataFrame([("t", dt.date(2024, 1, 1))], "table_name string, day date")
    plain = late.default_rows(t, "ts", leaf, "t").first()["default_rows"]
    assert plain == late.default_rows(t, "ts", leaf, "t", day_col="day").first()["default_rows"] == 2


def test_upsert_keeps_null_known_to_and_one_active_row(spark):
    cur = spark.sql("select * from values ('k1', 1.0D, timestamp_ntz '2024-01-01', timestamp_ntz '9999-12-31'), "
                    "('k2', 2.0D, timestamp_ntz '2024-01-01', cast(null as timestamp_ntz)) v(k, x, known_from, known_to)")
    new = spark.createDataFrame([("k1", 5.0), ("k1", 4.0), ("k3", 1.0), ("k3", 1.0)], "k string, x double")
    out = cdl.scd2_upsert(cur, new, ["k"], ["x"], "2024-02-01 00:00:00")
    assert out.count() == 4 and out.where("known_to is null").count() == 1
    active = {r.k: r.x for r in out.where("year(known_to) = 9999").collect()}
    assert active == {"k1": 5.0, "k3": 1.0}


def test_synthesis_counts_active_versions_only(spark):
    bars = spark.sql("select 'a' instrument, '1m' timeframe, timestamp_ntz '2024-01-01 10:00:00' open_at, 1D open, 1D high, 1D low, "
                     "1D close, 10D volume, 1L trades") \
        .withColumn("known_to", F.lit("2024-01-02").cast("timestamp_ntz"))
    both = bars.unionByName(bars.withColumn("known_to", F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")))
    out = cdl.synthesize_candles(both, ["instrument"], ["1h"]).first()
    assert (out["volume"], out["trades"]) == (10.0, 1)


def test_streaks_of_one_hot_file(spark):
    flags = [i % 7 not in (0, 3) for i in range(300)]
    status = spark.createDataFrame([("f", i + 1, x) for i, x in enumerate(flags)] + [("g", 1, True), ("g", 2, True)],
                                   "file string, run_no long, failed boolean")
    want, run = {}, 0
    for i, x in enumerate(flags):
        run = run + 1 if x else 0
        want[("f", i + 1)] = run
    want |= {("g", 1): 1, ("g", 2): 2}
    got = {(r.file, r.run_no): (r.streak, r.alarm) for r in runlog.failure_streaks(status, parts=9).collect()}
    assert got == {k: (v, v >= 2) for k, v in want.items()}
