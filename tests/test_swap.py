"""Journaled swaps: crash after every step, conflicts, catalog purges, ledger races, in-place sweep, ingest, restore."""

import datetime as dt
import glob
import os
import threading
import uuid

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tidemark.functions.exprs import day_of
from tidemark.plans import jobs
from tidemark.plans.catalog import TICKS_ARCHIVE_SCHEMA, _Crash, _crash_at, _crashing
from tidemark.sources import fixtures as fx
from tidemark.sources.ledger import append_manifest, read_manifest
from tidemark.sources.swap import NO_FILES, Swap, listing_of, publish_new, recover, write_text


def _parts(spark, scratch):
    table = f"{scratch}/t"
    for k in (1, 2, 3):
        spark.range(k * 10).coalesce(1).write.parquet(f"{table}/day=2024-01-0{k}")
    return table


def _rows(spark, table):
    return {str(r["day"]): r["n"] for r in spark.read.schema("id long, day date").parquet(table).groupBy("day").agg(
        F.count("*").alias("n")).collect()}


def _staged(spark, table, step=lambda _: None):
    """A run that replaces day 1, removes day 2, empties day 3 and adds day 4."""
    swap = Swap(spark, table, step=step)
    spark.range(5).coalesce(1).write.parquet(f"{swap.new}/day=2024-01-01")
    spark.range(7).coalesce(1).write.parquet(f"{swap.new}/day=2024-01-04")
    at = {k: listing_of(spark, f"{table}/day=2024-01-0{k}") for k in (1, 2, 3)}
    lines = [("put", "day=2024-01-01", at[1], None), ("remove", "day=2024-01-02", at[2], None),
             ("put", "day=2024-01-03", at[3], None), ("put", "day=2024-01-04", None, None)]
    return swap, lines


STEPS = ["intent", "aside day=2024-01-01", "put day=2024-01-01", "aside day=2024-01-02", "removed day=2024-01-02",
         "aside day=2024-01-03", "put day=2024-01-03", "put day=2024-01-04", "done"]


def test_steps_are_the_ones_crashed_at(spark, scratch):
    seen = []
    swap, lines = _staged(spark, _parts(spark, scratch), seen.append)
    swap.declare(lines)
    swap.apply()
    assert seen == STEPS


@pytest.mark.parametrize("word", STEPS)
def test_crash_after_any_step_is_carried_to_the_end(spark, scratch, word):
    table = _parts(spark, scratch)
    swap, lines = _staged(spark, table, _crash_at(word))
    with pytest.raises(_Crash):
        swap.declare(lines)
        swap.apply()
    recover(spark, table)
    assert _rows(spark, table) == {"2024-01-01": 5, "2024-01-04": 7}
    assert sorted(os.listdir(table)) == ["day=2024-01-01", "day=2024-01-03", "day=2024-01-04"]
    assert recover(spark, table) == []


def test_staging_without_a_journal_is_thrown_away(spark, scratch):
    table = _parts(spark, scratch)
    _staged(spark, table)
    assert recover(spark, table) == []
    assert _rows(spark, table) == {"2024-01-01": 10, "2024-01-02": 20, "2024-01-03": 30}
    assert not glob.glob(f"{table}/_swap-*")


def test_changed_partitions_are_left_alone(spark, scratch):
    table = _parts(spark, scratch)
    undo = f"{scratch}/archived"
    spark.range(1).write.parquet(undo)
    swap, lines = _staged(spark, table)
    lines[0] = (*lines[0][:3], undo)
    swap.declare(lines)
    for k in (1, 2):
        spark.range(1).coalesce(1).write.mode("append").parquet(f"{table}/day=2024-01-0{k}")
    spark.range(9).coalesce(1).write.parquet(f"{table}/day=2024-01-04")  # another writer was first
    assert swap.apply() == ["day=2024-01-03"]
    assert swap.conflicts == ["day=2024-01-01", "day=2024-01-02", "day=2024-01-04"] and not os.path.exists(undo)
    assert _rows(spark, table) == {"2024-01-01": 11, "2024-01-02": 21, "2024-01-04": 9}


def test_folders_of_an_old_purge_go_back(spark, scratch):
    table = _parts(spark, scratch)
    os.makedirs(f"{table}/_purge-x")
    os.rename(f"{table}/day=2024-01-02", f"{table}/_purge-x/day=2024-01-02")
    recover(spark, table)
    assert _rows(spark, table)["2024-01-02"] == 20 and not glob.glob(f"{table}/_purge-*")


def test_publish_new_has_one_winner(spark, scratch):
    won = []

    def go(k):
        write_text(spark, f"{scratch}/private-{k}", str(k))
        if publish_new(spark, f"{scratch}/private-{k}", f"{scratch}/final"):
            won.append(k)

    threads = [threading.Thread(target=go, args=(k,)) for k in range(12)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and open(f"{scratch}/final").read() == str(won[0])


def test_racing_appends_lose_no_line(spark, scratch):
    path = f"{scratch}/MANIFEST"
    lines = fx.ledger(spark, SF001).where("nf = 8").limit(1).collect()
    schema = fx.ledger(spark, SF001).schema
    failed, seqs = [], []

    def go(k):
        for i in range(50):
            try:
                one = spark.createDataFrame([tuple({**lines[0].asDict(), "rows": f"{k * 50 + i}"}.values())], schema)
                seqs.append(append_manifest(one, path))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    threads = [threading.Thread(target=go, args=(k,)) for k in range(2)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert not failed and sorted(seqs) == list(range(1, 101))
    back = read_manifest(spark, path, "ticks").orderBy("line_no").collect()
    assert [r["line_no"] for r in back] == list(range(1, 101))
    rows = [int(r["rows"]) for r in back]
    assert sorted(rows) == list(range(100))
    for k in (0, 1):  # a writer's own lines stand in the order of its appends
        assert [x for x in rows if x // 50 == k] == list(range(k * 50, k * 50 + 50))
    assert not glob.glob(f"{path}/_append-*")


@pytest.mark.parametrize("kind", ["managed", "external"])
@pytest.mark.parametrize("word", ["intent", "aside day=2024-01-02", "removed day=2024-01-02", "done"])
def test_catalog_purge_survives_a_crash(spark, scratch, kind, word):
    t = fx.ticks(spark, SF001).withColumn("day", day_of("bus_time"))
    name = f"tm_{uuid.uuid4().hex}"
    w = t.write.partitionBy("day")
    (w.option("path", f"{scratch}/ext") if kind == "external" else w).saveAsTable(name)
    try:
        days = [dt.date(2024, 1, d) for d in (2, 3)]
        n = {d: t.where(F.col("day") == d).count() for d in days}
        plan = spark.createDataFrame([(d, "PURGE", n[d]) for d in days], "day date, decision string, ledger_rows long")
        with pytest.raises(_Crash):
            jobs.apply_purge(spark, plan, None, "bus_time", catalog_table=name, step=_crash_at(word))
        jobs.apply_purge(spark, plan, None, "bus_time", catalog_table=name)
        parts = {r["partition"] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
        assert "day=2024-01-01" in parts and not {f"day={d}" for d in days} & parts
        assert spark.table(name).count() == t.count() - sum(n.values())
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_catalog_purge_reports_and_checks_before_it_drops(spark):
    """A file that lands between check and rename: rows, partition and folder stay, and nothing is reported dropped."""
    t = fx.ticks(spark, SF001).withColumn("day", day_of("bus_time"))
    name = f"tm_{uuid.uuid4().hex}"
    t.write.partitionBy("day").saveAsTable(name)
    try:
        d = dt.date(2024, 1, 2)
        n = t.where(F.col("day") == d).count()
        plan = spark.createDataFrame([(d, "PURGE", n)], "day date, decision string, ledger_rows long")

        def late(word):
            if word == "intent":
                t.where(F.col("day") == d).limit(3).drop("day").write.mode("append").parquet(
                    f"{jobs.table_location(spark, name)}/day={d}")

        assert jobs.apply_purge(spark, plan, None, "bus_time", catalog_table=name, step=late) == []
        spark.sql(f"REFRESH TABLE {name}")
        assert spark.table(name).where(F.col("day") == d).count() == n + 3
        again = spark.createDataFrame([(d, "PURGE", n + 3)], "day date, decision string, ledger_rows long")
        assert jobs.apply_purge(spark, again, None, "bus_time", catalog_table=name) == [d.isoformat()]
        assert spark.table(name).where(F.col("day") == d).count() == 0
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_ingest_reads_the_table_in_place_and_touches_only_what_changes(spark, scratch):
    from pyspark.sql import types as T

    from tidemark.operators import candles as cdl

    cdl.ticks_to_candles(fx.ticks(spark, SF001), "1h", ["instrument"], "bus_time", "price", "id").write.parquet(f"{scratch}/bars")
    bars = spark.read.parquet(f"{scratch}/bars")
    fields = [f for f in bars.schema.fields if f.name != "timeframe"]
    schema = T.StructType([*fields, T.StructField("known_from", T.TimestampNTZType()), T.StructField("known_to", T.TimestampNTZType()),
                           T.StructField("timeframe", T.StringType()), T.StructField("day", T.DateType())])
    name = f"tm_{uuid.uuid4().hex}"
    jobs.create_candle_table(spark, name, f"{scratch}/candles", schema, ["instrument"], 4)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        jobs.ingest_table(spark, name, bars, "2024-02-01 00:00:00", ["instrument"])
        n, buckets = jobs._bucket_spec(spark, name)
        assert (n, buckets) == (4, ["instrument", "open_at"])
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with jobs.co_partitioned_by_some_keys(spark):
            batch = cdl.one_per_key(bars.repartition(n, *buckets), [*buckets, "timeframe"], cdl.CANDLE_VALUE_COLUMNS)
            plan = jobs.candle_changes(spark.table(name), batch, [*buckets, "timeframe"], cdl.CANDLE_VALUE_COLUMNS)
            text = plan._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        exchanges = [ln for ln in text.splitlines() if "Exchange" in ln]  # the batch is dealt; the table is read where it lies
        assert "SortMergeJoin" in text and "Bucketed: true" in text
        assert len(exchanges) == 1 and "REPARTITION_BY_NUM" in exchanges[0]
        before = {p: open(p, "rb").read() for p in glob.glob(f"{scratch}/candles/timeframe=1h/day=*/*.parquet")}
        d = dt.date(2024, 1, 4)
        changed = bars.withColumn("close", F.when(F.to_date("open_at") == d, F.col("close") + 1).otherwise(F.col("close")))
        out = jobs.ingest_table(spark, name, changed, "2024-02-02 00:00:00", ["instrument"]).collect()
        assert [(r["day"], r["n_new"] == r["n_closed"] > 0) for r in out] == [(d, True)]
        for p, data in before.items():
            assert (f"day={d}" in p) != (os.path.exists(p) and open(p, "rb").read() == data)
        assert all("_0000" in p for p in glob.glob(f"{scratch}/candles/timeframe=1h/day={d}/*.parquet"))
        t = spark.table(name).where(F.col("day") == d)
        assert t.where(F.year("known_to") == 9999).count() * 2 == t.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_sweep_withdraws_the_archive_of_a_partition_that_changed(spark, scratch):
    v = fx.candle_versions(spark, SF001).withColumn("open_at", F.col("open_at").cast("timestamp_ntz"))
    table = f"{scratch}/candles"
    v.withColumn("day", F.to_date("open_at")).write.partitionBy("timeframe", "day").parquet(table)
    whole = spark.read.parquet(table).count()
    part = f"{table}/timeframe=1h/day=2024-01-05"
    more = spark.read.parquet(part).where("known_to < timestamp_ntz '9999-01-01 00:00:00'").limit(2).cache()

    def late(word):
        if word == "intent":
            more.write.mode("append").parquet(part)

    first = {r["day"].day: r for r in jobs.sweep_apply(spark, table, "2024-01-05", "2024-01-06", f"{scratch}/a", ["instrument"],
                                                       step=late).collect()}
    assert not first[5]["swapped"] and first[6]["swapped"]
    assert spark.read.parquet(f"{scratch}/a").select("day").distinct().count() == 1
    second = jobs.sweep_apply(spark, table, "2024-01-05", "2024-01-06", f"{scratch}/a", ["instrument"]).collect()
    assert [(r["day"].day, r["n_swept"]) for r in second] == [(5, first[5]["n_swept"] + 2)]
    assert spark.read.parquet(table).count() + spark.read.parquet(f"{scratch}/a").count() == whole + 2


def test_restore_fills_empty_leaves_and_goes_on_after_a_crash(spark, scratch):
    t = fx.ticks(spark, SF001).select(*TICKS_ARCHIVE_SCHEMA.names)
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    leaf = spark.createDataFrame([("ticks", d) for d in days], "table_name string, day date")
    jobs.export_days(spark, t, "ticks", "bus_time", ["id"], days, leaf, None, scratch, TICKS_ARCHIVE_SCHEMA)
    table = f"{scratch}/table"
    jobs.ensure_leaves(spark, table, days[0], days[1])
    assert listing_of(spark, f"{table}/day=2024-01-01") == NO_FILES
    args = [spark, scratch, "ticks", days, TICKS_ARCHIVE_SCHEMA, table, "bus_time"]
    _crashing(jobs.restore_into_table, *args, step=_crash_at("staged"))
    assert not glob.glob(f"{table}/day=*/*.parquet")  # nothing but staging
    got = {r["day"]: r["restored"] for r in jobs.restore_into_table(*args).collect()}
    assert got == {d: t.where(day_of("bus_time") == d).count() for d in days}
    assert jobs.restore_into_table(*args).count() == 0
    assert spark.read.parquet(table).count() == sum(got.values())
