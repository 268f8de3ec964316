"""Export, inventory, verification and purge as jobs over real files."""

import datetime as dt
import glob
import os

import pytest

from pyspark.sql import functions as F

from tidemark.functions.exprs import day_of
from tidemark.plans import jobs
from tidemark.plans.catalog import TICKS_ARCHIVE_SCHEMA, _ticks_parts
from tidemark.sources import archive as arc
from tidemark.sources import fixtures as fx
from tidemark.sources.ledger import read_manifest
from tests.conftest import SF001


def _export(spark, root, n_parts):
    t = fx.ticks(spark, SF001)
    days = sorted(r.day for r in t.select(day_of("bus_time").alias("day")).distinct().collect())
    leaf = t.select(F.lit("ticks").alias("table_name"), day_of("bus_time").alias("day")).distinct()
    lines = jobs.export_days(spark, t, "ticks", "bus_time", ["id"], days, leaf, None, root, TICKS_ARCHIVE_SCHEMA,
                             ledger_path=f"{root}/MANIFEST", n_parts=n_parts, exported_at="2024-02-01T00:00:00Z")
    return t, lines


def test_partition_count_does_not_change_content(spark, scratch):
    t, _ = _export(spark, f"{scratch}/a", 1)
    _export(spark, f"{scratch}/b", 7)
    da = arc.read_archive(spark, f"{scratch}/a/ticks", TICKS_ARCHIVE_SCHEMA).drop("day")
    db = arc.read_archive(spark, f"{scratch}/b/ticks", TICKS_ARCHIVE_SCHEMA).drop("day")
    ga = arc.day_content_digest(da, "bus_time", _ticks_parts(da))
    gb = arc.day_content_digest(db, "bus_time", _ticks_parts(db))
    want = arc.day_content_digest(t, "bus_time", _ticks_parts(t))
    assert ga.exceptAll(want).count() == 0 and gb.exceptAll(want).count() == 0 and want.count() == ga.count()


def test_archive_is_sorted_within_day(spark, scratch):
    _export(spark, scratch, 5)
    back = arc.read_archive(spark, f"{scratch}/ticks", TICKS_ARCHIVE_SCHEMA) \
        .withColumn("f", F.input_file_name())
    # each part file holds a contiguous, increasing id range; parts of a day do not overlap
    per = back.groupBy("day", "f").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).orderBy("day", "lo").collect()
    last = {}
    for r in per:
        assert r.lo > last.get(r.day, -1)
        last[r.day] = r.hi


def test_export_refuses_second_run_and_ledger_is_valid(spark, scratch):
    t, lines = _export(spark, scratch, 3)
    assert lines.count() == 30
    assert not glob.glob(f"{scratch}/_staging/*/*")  # the run's staging folder is gone after publish
    led = read_manifest(spark, f"{scratch}/MANIFEST", "ticks")
    assert led.where(F.col("nf") != 8).count() == 0
    again = jobs.export_days(spark, t, "ticks", "bus_time", ["id"], [dt.date(2024, 1, 3)],
                             t.select(F.lit("ticks").alias("table_name"), day_of("bus_time").alias("day")).distinct(),
                             led, scratch, TICKS_ARCHIVE_SCHEMA)
    assert again.count() == 0


def _plan(spark, scratch):
    t = fx.ticks(spark, SF001)
    led = read_manifest(spark, f"{scratch}/MANIFEST", "ticks")
    inv = arc.day_inventory(arc.archive_inventory(spark, f"{scratch}/ticks")).select(
        F.concat(F.lit("ticks-"), F.col("day").cast("string"), F.lit(".csv.gz")).alias("file"), "bytes", "sha256")
    children = fx.children(spark, SF001)
    days = led.select(F.lit("ticks").alias("table_name"), F.to_date("day").alias("day"))
    counts = t.groupBy(day_of("bus_time").alias("day")).agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("table_name", F.lit("ticks"))
    return jobs.purge_plan(days, led, inv, children, counts, suffix=".csv.gz")


def test_purge_plan_on_real_archive_and_corruption(spark, scratch):
    _export(spark, scratch, 3)
    plan = {r.day.day: r.reason for r in _plan(spark, scratch).collect()}
    assert plan[3] == "verified" and plan[11] == "no exact partition" and plan[22] == "no exact partition"
    part = sorted(glob.glob(f"{scratch}/ticks/day=2024-01-04/*.csv.gz"))[0]
    with open(part, "r+b") as f:
        f.seek(20)
        b = f.read(1)
        f.seek(20)
        f.write(bytes([b[0] ^ 0xFF]))
    plan = {r.day.day: r.reason for r in _plan(spark, scratch).collect()}
    assert plan[4] == "sha mismatch" and plan[3] == "verified"
    parts = sorted(glob.glob(f"{scratch}/ticks/day=2024-01-05/*.csv.gz"))
    os.remove(parts[0])
    plan = {r.day.day: r.reason for r in _plan(spark, scratch).collect()}
    # a day with parts left no longer hashes the same; a day with none left is missing
    assert plan[5] == ("sha mismatch" if len(parts) > 1 else "archive file missing")


def test_apply_purge_drops_only_verified_days(spark, scratch):
    t = fx.ticks(spark, SF001)
    table = f"{scratch}/table"
    t.withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(table)
    plan = spark.createDataFrame([(dt.date(2024, 1, 2), "PURGE", 0), (dt.date(2024, 1, 3), "REFUSE", 0)],
                                 "day date, decision string, ledger_rows long")
    n2 = t.where(day_of("bus_time") == dt.date(2024, 1, 2)).count()
    plan = plan.withColumn("ledger_rows", F.when(F.col("day") == dt.date(2024, 1, 2), F.lit(n2)).otherwise(0))
    assert jobs.apply_purge(spark, plan, table, "bus_time") == ["2024-01-02"]
    left = spark.read.parquet(table)
    assert left.where(F.col("day") == dt.date(2024, 1, 2)).count() == 0
    assert left.count() == t.count() - n2
    # the plan after applying never says PURGE for the dropped day: its leaf is gone
    again = jobs.apply_purge(spark, plan, table, "bus_time")
    assert again == []


def test_day_slice_prunes_partitions(spark, scratch):
    from tidemark.operators.slices import day_slice
    t = fx.ticks(spark, SF001)
    table = f"{scratch}/table"
    t.withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(table)
    df = day_slice(spark.read.parquet(table), "bus_time", "2024-01-03", "2024-01-04", day_col="day")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "2024-01-03" in plan
    assert df.count() == t.where(day_of("bus_time") == dt.date(2024, 1, 3)).count()


def test_restore_job_with_supplements(spark, scratch):
    """Archive without the recovered rows + a supplement ledger file -> whole days, routed to leaves."""
    from tidemark.sources.ledger import read_supplements

    t = fx.ticks(spark, SF001)
    recovered = fx.supplement_rows(spark, SF001)
    base = t.join(recovered.select("id"), "id", "left_anti")
    days = sorted(r.day for r in t.select(day_of("bus_time").alias("day")).distinct().collect())
    leaf_all = t.select(F.lit("ticks").alias("table_name"), day_of("bus_time").alias("day")).distinct()
    jobs.export_days(spark, base, "ticks", "bus_time", ["id"], days, leaf_all, None, scratch, TICKS_ARCHIVE_SCHEMA)
    sup_ledger = recovered.select(F.lit("ticks-supplement.csv").alias("file"), day_of("bus_time").cast("string").alias("day"),
                                  F.lit("1").alias("rows"), F.lit("1").alias("bytes"), F.repeat(F.lit("e"), 64).alias("sha256"),
                                  F.lit("recovered, absent from the daily file").alias("note"))
    sup_ledger.coalesce(1).write.option("sep", "\t").option("header", True).csv(f"{scratch}/supplements")
    assert read_supplements(spark, f"{scratch}/supplements").count() == recovered.count()
    restored = jobs.restore(spark, f"{scratch}/ticks", TICKS_ARCHIVE_SCHEMA, recovered, fx.leaf(spark, SF001),
                            "ticks", "bus_time")
    got = arc.day_content_digest(restored, "bus_time", _ticks_parts(restored))
    want = arc.day_content_digest(t, "bus_time", _ticks_parts(t))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert restored.where(F.col("target") == "ticks_default").count() == \
        t.where(F.dayofmonth("bus_time").isin(11, 22)).count()


def test_ledger_line_numbers_run_across_appends(spark, scratch):
    import time

    from tidemark.operators.verify import last_line_per_day
    from tidemark.sources.ledger import append_manifest

    path = f"{scratch}/LEDGER"
    for k in range(3):
        lines = spark.range(1).select(
            F.lit("ticks").alias("table_name"), F.lit("ticks-2024-01-03.csv.zst").alias("file"),
            F.lit("2024-01-03").alias("day"), F.lit("703").alias("bound_lower"), F.lit("1036").alias("bound_upper"),
            F.lit(str(333 + k)).alias("rows"), F.lit("6660").alias("bytes"), F.repeat(F.lit("a"), 64).alias("sha256"),
            F.lit("2024-02-01T00:00:00Z").alias("exported_at"))
        append_manifest(lines, path)
        time.sleep(1.1)
    led = read_manifest(spark, path, "ticks")
    assert sorted(r.line_no for r in led.collect()) == [1, 2, 3]
    assert last_line_per_day(led).first().rows == "335"


def test_parquet_zstd_archive_roundtrip(spark, scratch):
    t = fx.ticks(spark, SF001)
    arc.write_day_archive(t, f"{scratch}/pq", "bus_time", ["id"], n_parts=4, fmt="parquet")
    assert glob.glob(f"{scratch}/pq/day=2024-01-03/*.zstd.parquet")
    back = arc.read_archive(spark, f"{scratch}/pq", TICKS_ARCHIVE_SCHEMA, fmt="parquet").drop("day")
    got = arc.day_content_digest(back, "bus_time", _ticks_parts(back))
    want = arc.day_content_digest(t, "bus_time", _ticks_parts(t))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_backfill_job(spark, scratch):
    """Ledger days skip, days before the first leafless day export in one job, later days wait."""
    t = fx.ticks(spark, SF001)
    led = fx.ledger(spark, SF001)
    outcomes, summary = jobs.backfill(spark, t, "ticks", "bus_time", ["id"], dt.date(2024, 1, 1),
                                      dt.date(2024, 1, 30), fx.leaf(spark, SF001), led, scratch, TICKS_ARCHIVE_SCHEMA,
                                      ledger_path=f"{scratch}/MANIFEST", exported_at="2024-02-01T00:00:00Z")
    got = {r.day.day: r.outcome for r in outcomes.collect()}
    assert got[5] == "ok" and got[21] == "ok" and got[22] == "fail" and got[23] == "not_attempted"
    assert got[1] == "skip" and got[11] == "skip"
    s = summary.first()
    assert (s.ok, s.skip, s.fail, s.not_attempted) == (2, 19, 1, 8)
    assert read_manifest(spark, f"{scratch}/MANIFEST", "ticks").count() == 2


def test_candle_sweep_job(spark, scratch):
    """Swept versions are archived, the rest stays; together they are the input."""
    cv = fx.candle_versions(spark, SF001)
    rest = jobs.candle_sweep_job(cv, "2024-01-05", "2024-01-20", f"{scratch}/sweep", ["instrument"])
    back = spark.read.parquet(f"{scratch}/sweep").drop("day")
    assert back.count() > 0
    assert back.where(F.col("known_to") >= F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")).count() == 0
    both = rest.unionByName(back.select(*rest.columns))
    assert both.exceptAll(cv).count() == 0 and cv.exceptAll(both).count() == 0


@pytest.mark.parametrize("fmt", ["csv.gz", "csv.zst"])
def test_run_retention_end_to_end(spark, scratch, fmt):
    """Oldest leaves first, export, verify, drop; the next run continues where this one stopped."""
    t = fx.ticks(spark, SF001)
    table = f"{scratch}/ticks_table"
    t.withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(table)
    kw = dict(table_path=table, table="ticks", time_col="bus_time", order_cols=["id"], schema=TICKS_ARCHIVE_SCHEMA,
              archive_root=f"{scratch}/archive", ledger_path=f"{scratch}/MANIFEST", today="2024-01-15",
              exported_at="2024-02-01T00:00:00Z", fmt=fmt)
    first = jobs.run_retention(spark, **kw).orderBy("day").collect()
    assert [(r.day.day, r.decision, r.dropped) for r in first] == [(1, "PURGE", True), (2, "PURGE", True),
                                                                      (3, "PURGE", True)]
    second = jobs.run_retention(spark, **kw).orderBy("day").collect()
    assert [r.day.day for r in second] == [4, 5, 6] and all(r.dropped for r in second)
    left = spark.read.parquet(table)
    assert left.agg(F.min("day")).first()[0] == dt.date(2024, 1, 7)
    archived = arc.read_archive(spark, f"{scratch}/archive/ticks", TICKS_ARCHIVE_SCHEMA).drop("day")
    assert archived.count() + left.count() == t.count()
    assert read_manifest(spark, f"{scratch}/MANIFEST", "ticks").count() == 6


@pytest.mark.parametrize("fmt", ["csv.gz", "csv.zst"])
def test_empty_day_with_leaf_exports_and_verifies(spark, scratch, fmt):
    """An empty day that has its leaf exports (bounds 0, 1; zero rows) and its purge plan verifies."""
    t = fx.ticks(spark, SF001)
    empty = dt.date(2024, 1, 31)
    leaf = spark.createDataFrame([("ticks", empty)], "table_name string, day date")
    lines = jobs.export_days(spark, t, "ticks", "bus_time", ["id"], [empty], leaf, None, scratch,
                             TICKS_ARCHIVE_SCHEMA, ledger_path=f"{scratch}/MANIFEST",
                             exported_at="2024-02-01T00:00:00Z", fmt=fmt).collect()
    assert [(r.bound_lower, r.bound_upper, r.rows) for r in lines] == [("0", "1", "0")]
    assert arc.read_archive(spark, f"{scratch}/ticks", TICKS_ARCHIVE_SCHEMA).count() == 0
    led = read_manifest(spark, f"{scratch}/MANIFEST", "ticks")
    inv = arc.day_inventory(arc.archive_inventory(spark, f"{scratch}/ticks")).select(
        F.concat(F.lit("ticks-"), F.col("day").cast("string"), F.lit("." + fmt)).alias("file"), "bytes", "sha256")
    from tidemark.sources.tables import children_of
    days = spark.createDataFrame([("ticks", empty)], "table_name string, day date")
    counts = spark.createDataFrame([], "table_name string, day date, n_rows long")
    plan = jobs.purge_plan(days, led, inv, children_of(leaf.withColumn("leaf_name", F.lit("ticks_d20240131"))),
                           counts, suffix="." + fmt).first()
    assert (plan.decision, plan.reason) == ("PURGE", "verified")


def test_apply_purge_refuses_changed_listing(spark, scratch):
    t = fx.ticks(spark, SF001)
    table = f"{scratch}/table"
    t.withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(table)
    d = dt.date(2024, 1, 2)
    n = t.where(day_of("bus_time") == d).count()
    listing = jobs.table_day_listing(spark, table, [d])
    plan = spark.createDataFrame([(d, "PURGE", n)], "day date, decision string, ledger_rows long") \
        .join(listing.select("day", "listing"), "day")
    # a compaction rewrote the day's files (same rows, new files) after the plan was made
    spark.read.parquet(f"{table}/day={d}").coalesce(1).write.mode("overwrite").parquet(f"{scratch}/tmp")
    spark.read.parquet(f"{scratch}/tmp").write.mode("append").parquet(f"{table}/day={d}")
    assert jobs.apply_purge(spark, plan, table, "bus_time") == []


def test_export_adopts_published_day_without_ledger_line(spark, scratch):
    """A crash between publish and ledger append: the re-run refuses, or adopts after a strict re-read."""
    t = fx.ticks(spark, SF001)
    leaf = t.select(F.lit("ticks").alias("table_name"), day_of("bus_time").alias("day")).distinct()
    d = dt.date(2024, 1, 3)
    jobs.export_days(spark, t, "ticks", "bus_time", ["id"], [d], leaf, None, scratch, TICKS_ARCHIVE_SCHEMA)
    # no ledger was written: the day is published but unrecorded
    refused = jobs.export_days(spark, t, "ticks", "bus_time", ["id"], [d], leaf, None, scratch, TICKS_ARCHIVE_SCHEMA)
    assert refused.count() == 0
    adopted = jobs.export_days(spark, t, "ticks", "bus_time", ["id"], [d], leaf, None, scratch, TICKS_ARCHIVE_SCHEMA,
                               ledger_path=f"{scratch}/MANIFEST", adopt=True).collect()
    day_rows = t.where(day_of("bus_time") == d)
    lo, hi, n = day_rows.agg(F.min("id"), F.max("id") + 1, F.count(F.lit(1))).first()
    assert [(r.day, r.bound_lower, r.bound_upper, r.rows) for r in adopted] == [("2024-01-03", str(lo), str(hi), str(n))]
    # a published day whose content no longer matches the table is not adopted
    d2 = dt.date(2024, 1, 4)
    jobs.export_days(spark, t, "ticks", "bus_time", ["id"], [d2], leaf, None, scratch, TICKS_ARCHIVE_SCHEMA)
    fewer = t.where(~((day_of("bus_time") == d2) & (F.col("id") % 2 == 0)))
    again = jobs.export_days(spark, fewer, "ticks", "bus_time", ["id"], [d2], leaf, None, scratch,
                             TICKS_ARCHIVE_SCHEMA, adopt=True)
    assert again.count() == 0


def test_csv_zst_archive_roundtrip(spark, scratch):
    """The reference's own archive format: sorted header CSV in zstd, written by the tasks, read back strictly."""
    t = fx.ticks(spark, SF001)
    arc.write_day_archive(t, f"{scratch}/zst", "bus_time", ["id"], n_parts=4, fmt="csv.zst")
    files = glob.glob(f"{scratch}/zst/day=2024-01-03/*.csv.zst")
    assert files and not glob.glob(f"{scratch}/zst/day=*/_tmp-*")
    import pyarrow as pa
    with pa.CompressedInputStream(pa.OSFile(files[0]), "zstd") as f:
        assert f.read(40).decode().startswith('"id","bus_time","instrument","price"')
    back = arc.read_archive(spark, f"{scratch}/zst", TICKS_ARCHIVE_SCHEMA).drop("day")
    got = arc.day_content_digest(back, "bus_time", _ticks_parts(back))
    want = arc.day_content_digest(t, "bus_time", _ticks_parts(t))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_run_retention_stops_at_first_refusal(spark, scratch):
    from tidemark.sources.ledger import append_manifest

    t = fx.ticks(spark, SF001)
    table = f"{scratch}/ticks_table"
    t.withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(table)
    line = spark.range(2).select(
        F.lit("ticks-2024-01-02.csv.gz").alias("file"), F.lit("2024-01-02").alias("day"), F.lit("1").alias("bound_lower"),
        F.lit("2").alias("bound_upper"), F.lit("1").alias("rows"), F.lit("1").alias("bytes"),
        F.repeat(F.lit("a"), 64).alias("sha256"), F.lit("2024-02-01T00:00:00Z").alias("exported_at"))
    append_manifest(line, f"{scratch}/MANIFEST")  # two lines for one day: a duplicate
    out = jobs.run_retention(spark, table, "ticks", "bus_time", ["id"], TICKS_ARCHIVE_SCHEMA, f"{scratch}/archive",
                             f"{scratch}/MANIFEST", "2024-01-15", exported_at="2024-02-01T00:00:00Z")
    got = [(r.day.day, r.decision, r.reason, r.dropped) for r in out.orderBy("day").collect()]
    assert got[0] == (1, "PURGE", "verified", True)
    assert got[1][:3] == (2, "REFUSE", "duplicate manifest lines") and not got[1][3]
    assert got[2][1] == "HOLD" and not got[2][3]


def test_purge_plan_after_purge_never_purges_again(spark, scratch):
    """Metamorphic: once a day is dropped, a new plan for it refuses (its leaf is gone)."""
    from tidemark.sources.tables import children_of, table_leaves

    t = fx.ticks(spark, SF001)
    table = f"{scratch}/ticks_table"
    t.withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(table)
    kw = dict(table_path=table, table="ticks", time_col="bus_time", order_cols=["id"], schema=TICKS_ARCHIVE_SCHEMA,
              archive_root=f"{scratch}/archive", ledger_path=f"{scratch}/MANIFEST", today="2024-01-15",
              exported_at="2024-02-01T00:00:00Z")
    assert all(r.dropped for r in jobs.run_retention(spark, **kw).collect())
    days = [dt.date(2024, 1, d) for d in (1, 2, 3)]
    led = read_manifest(spark, f"{scratch}/MANIFEST", "ticks")
    inv = arc.day_inventory(arc.archive_inventory(spark, arc.day_folders(f"{scratch}/archive/ticks", days))).select(
        F.concat(F.lit("ticks-"), F.col("day").cast("string"), F.lit(".csv.gz")).alias("file"), "bytes", "sha256")
    counts = spark.read.parquet(table).where(F.col("day").isin(days)).groupBy("day").agg(
        F.count(F.lit(1)).alias("n_rows")).withColumn("table_name", F.lit("ticks"))
    plan = jobs.purge_plan(spark.createDataFrame([("ticks", d) for d in days], "table_name string, day date"), led,
                           inv, children_of(table_leaves(spark, table, "ticks")), counts, suffix=".csv.gz").collect()
    assert {(r.decision, r.target, r.reason) for r in plan} == {("REFUSE", "DEFAULT", "no exact partition")}


def test_coverage_with_empty_ledger_equals_missing_days(spark):
    """Metamorphic: with nothing archived, coverage counts exactly the plain missing days."""
    from tidemark.operators import calendar as cal
    from tidemark.plans.catalog import _config, _scope

    lv = fx.all_leaves(spark, SF001)
    none = spark.createDataFrame([], "table_name string, day date")
    dr = spark.createDataFrame([], "table_name string, default_rows long")
    cov = {r.table_name: (r.missing, r.dropped) for r in
           jobs.partition_coverage(lv, _config(spark), "2024-01-15", none, dr).collect()}
    plain = {r.table_name: r["count"] for r in cal.missing_days(lv, _scope(spark)).groupBy("table_name").count().collect()}
    assert {k: v[0] for k, v in cov.items()} == plain and all(v[1] == 0 for v in cov.values())


def test_fast_digest_detects_a_changed_row(spark):
    t = fx.ticks(spark, SF001)
    changed = t.withColumn("price", F.when(F.col("id") == 17, F.col("price") + 0.01).otherwise(F.col("price")))
    a = arc.day_content_digest(t, "bus_time", _ticks_parts(t), fast=True)
    b = arc.day_content_digest(changed, "bus_time", _ticks_parts(changed), fast=True)
    shuffled = arc.day_content_digest(t.repartition(7), "bus_time", _ticks_parts(t), fast=True)
    assert a.exceptAll(shuffled).count() == 0
    assert a.exceptAll(b).count() == 1


def test_export_prunes_partitioned_source_and_guards_the_plan(spark, scratch):
    t = fx.ticks(spark, SF001)
    table = f"{scratch}/table"
    t.withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(table)
    data = spark.read.parquet(table)
    rows = jobs._rows_of_days(data, "bus_time", [dt.date(2024, 1, 3), dt.date(2024, 1, 5)], "day")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    part_filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert ">= 2024-01-03" in part_filters and "< 2024-01-06" in part_filters
    assert "Join" not in plan and "Exchange" not in plan  # the day list is a filter, not a join
    jobs.plan_guard(rows)  # pruned: accepted
    unpruned = jobs._rows_of_days(data.drop("day"), "bus_time", [dt.date(2024, 1, 3)])
    with pytest.raises(RuntimeError, match="not pruned"):
        jobs.plan_guard(unpruned)


def test_apply_purge_on_a_catalog_table(spark, scratch):
    """Catalog form: leaves from SHOW PARTITIONS, drop by ALTER TABLE ... DROP PARTITION (external table)."""
    from tidemark.sources.tables import catalog_leaves

    t = fx.ticks(spark, SF001)
    path = f"{scratch}/ext"
    t.withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(path)
    name = "tm_ticks_" + os.path.basename(scratch).replace("-", "_")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{path}'")
    spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    try:
        leaves = catalog_leaves(spark, name, "ticks")
        assert leaves.count() == t.select(day_of("bus_time")).distinct().count()
        d = dt.date(2024, 1, 2)
        n = t.where(day_of("bus_time") == d).count()
        plan = spark.createDataFrame([(d, "PURGE", n), (dt.date(2024, 1, 3), "PURGE", 1)],
                                     "day date, decision string, ledger_rows long")
        assert jobs.apply_purge(spark, plan, path, "bus_time", catalog_table=name) == ["2024-01-02"]
        assert catalog_leaves(spark, name, "ticks").where(F.col("day") == d).count() == 0
        assert not os.path.exists(f"{path}/day=2024-01-02")
        assert spark.table(name).count() == t.count() - n  # the 3rd had a wrong ledger count: kept
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_candle_ingest_upsert_is_idempotent(spark, scratch):
    """P7 into a candle table: a second run over the same cache changes nothing."""
    from tidemark.operators import candles as cdl
    from tidemark.sources.candle_csv import write_candle_csv

    t = fx.ticks(spark, SF001)
    c1m = cdl.ticks_to_candles(t, "1m", ["instrument"], "bus_time", "price", "id")
    write_candle_csv(c1m, f"{scratch}/cache")
    src = t.groupBy(F.col("instrument").alias("source")).agg(
        F.unix_seconds(F.max("bus_time").cast("timestamp")).alias("last_epoch"))
    empty = spark.createDataFrame([], "exchange string, instrument string, timeframe string, open_at timestamp_ntz, "
                                      "open double, high double, low double, close double, volume double, "
                                      "trades long, known_from timestamp_ntz, known_to timestamp_ntz")
    keys = ["exchange", "instrument"]
    first = jobs.candle_ingest(spark, f"{scratch}/cache", src, "2024-02-03 12:00:00", keys, current=empty)
    assert first.count() > 0 and first.where(F.year("known_to") != 9999).count() == 0
    first = first.cache()
    again = jobs.candle_ingest(spark, f"{scratch}/cache", src, "2024-02-04 12:00:00", keys, current=first)
    assert again.exceptAll(first).count() == 0 and first.exceptAll(again).count() == 0
    first.unpersist()


def test_restore_into_table_after_retention(spark, scratch):
    """P8 into storage: purged days come back from the archive (plus supplements) and equal the original."""
    t = fx.ticks(spark, SF001)
    table = f"{scratch}/ticks_table"
    recovered = fx.supplement_rows(spark, SF001)
    # the table had lost the recovered rows when it was archived; they live in a supplement file
    t.join(recovered.select("id"), "id", "left_anti").withColumn("day", day_of("bus_time")) \
        .write.partitionBy("day").parquet(table)
    kw = dict(table_path=table, table="ticks", time_col="bus_time", order_cols=["id"], schema=TICKS_ARCHIVE_SCHEMA,
              archive_root=f"{scratch}/archive", ledger_path=f"{scratch}/MANIFEST", exported_at="2024-02-01T00:00:00Z")
    jobs.run_retention(spark, today="2024-01-15", max_days=7, **kw).collect()
    days = [dt.date(2024, 1, d) for d in range(1, 8)]
    assert spark.read.parquet(table).where(F.col("day").isin(days)).count() == 0
    got = {r.day: r.restored for r in jobs.restore_into_table(
        spark, f"{scratch}/archive", "ticks", days + [dt.date(2024, 1, 9)], TICKS_ARCHIVE_SCHEMA, table, "bus_time",
        supplements=recovered).collect()}
    assert sorted(got) == days  # the 9th still had its partition: refused
    back = spark.read.parquet(table).where(F.col("day").isin(days)).drop("day")
    want = t.where(day_of("bus_time").isin(days))
    assert back.exceptAll(want.select(*back.columns)).count() == 0
    assert want.select(*back.columns).exceptAll(back).count() == 0


def test_adopt_refuses_changed_content(spark, scratch):
    """Same day, same number of rows, other prices: not this table's archive."""
    t = fx.ticks(spark, SF001)
    leaf = t.select(F.lit("ticks").alias("table_name"), day_of("bus_time").alias("day")).distinct()
    d = dt.date(2024, 1, 3)
    other = t.withColumn("price", F.col("price") + 1)
    jobs.export_days(spark, other, "ticks", "bus_time", ["id"], [d], leaf, None, scratch, TICKS_ARCHIVE_SCHEMA)
    args = (spark, t, "ticks", "bus_time", ["id"], [d], leaf, None, scratch, TICKS_ARCHIVE_SCHEMA)
    assert jobs.export_days(*args, adopt=True).count() == 0
    assert jobs.export_days(spark, other, *args[2:], adopt=True).count() == 1


@pytest.mark.parametrize("fmt", ["csv.gz", "csv.zst"])
def test_texts_and_numbers_come_back(spark, scratch, fmt):
    from decimal import Decimal

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("at", T.TimestampNTZType()),
                           T.StructField("s", T.StringType()), T.StructField("u", T.StringType()),
                           T.StructField("x", T.DoubleType()), T.StructField("m", T.DecimalType(38, 18))])
    texts = [None, "", " ", "  both  ", 'say "hi"', '"', '""', "a,b", "two\nlines", "two\r\nlines", "cr\rcr", "back\\slash", "\\N", "null",
             "tab\there", "é☃"]
    nums = [None, float("nan"), float("inf"), float("-inf"), 0.1, -0.0, 1e-300]
    money = [None, Decimal("0.000000000000000001"), Decimal("-12345678901234567890.123456789012345678")]
    at = dt.datetime(2024, 1, 3, 1, 2, 3, 456789)
    rows = [(i, at, s, texts[-1 - i], nums[i % len(nums)], money[i % len(money)]) for i, s in enumerate(texts)]
    t = spark.createDataFrame(rows, schema)
    leaf = spark.createDataFrame([("texts", at.date())], "table_name string, day date")
    lines = jobs.export_days(spark, t, "texts", "at", ["id"], [at.date()], leaf, None, scratch, schema, id_col=None, fmt=fmt)
    assert lines.count() == 1
    back = arc.read_archive(spark, f"{scratch}/texts", schema).drop("day")
    assert [repr(tuple(r)) for r in back.orderBy("id").collect()] == [repr(r) for r in rows]


def test_drop_folder_puts_back_what_it_did_not_check(spark, scratch):
    t = fx.ticks(spark, SF001)
    table, d = f"{scratch}/table", dt.date(2024, 1, 2)
    t.withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(table)
    folder = f"{table}/day={d}"
    listing = jobs.table_day_listing(spark, table, [d]).first()["listing"]
    n = spark.read.parquet(folder).count()
    spark.read.parquet(f"{table}/day=2024-01-03").write.mode("append").parquet(folder)  # lands after the check
    assert not jobs._drop_folder(spark, folder, listing)
    assert spark.read.parquet(folder).count() > n and not glob.glob(f"{table}/_purge-*")
    assert jobs._drop_folder(spark, folder, jobs.table_day_listing(spark, table, [d]).first()["listing"])
    assert not os.path.exists(folder)


def test_sweep_rewrites_touched_partitions_only(spark, scratch):
    cv = fx.candle_versions(spark, SF001).withColumn("open_at", F.col("open_at").cast("timestamp_ntz"))
    table = f"{scratch}/candles"
    cv.withColumn("day", F.to_date("open_at")).write.partitionBy("timeframe", "day").parquet(table)
    n = jobs.sweep_partitions(spark, table, "2024-01-05", "2024-01-06", f"{scratch}/swept", f"{scratch}/out", ["instrument"])
    out, whole, swept = (spark.read.parquet(p) for p in (f"{scratch}/out", table, f"{scratch}/swept"))
    days = sorted(r["day"] for r in out.select("day").distinct().collect())
    assert n == 2 and days == [dt.date(2024, 1, 5), dt.date(2024, 1, 6)]
    assert out.count() + swept.count() == whole.where(F.col("day").isin(days)).count()
    rest = jobs.sweep_remainder(whole, "2024-01-05", "2024-01-06", day_col="day")
    assert "Exchange" not in rest._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("fmt", ["csv.gz", "csv.zst"])
def test_observed_export_equals_the_counted_one(spark, scratch, monkeypatch, fmt):
    """Few days are observed on the write, many are counted before it: the same ledger lines, one scan of the table less."""
    t = fx.ticks(spark, SF001)
    path = f"{scratch}/table"
    t.withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(path)
    table = spark.read.parquet(path)
    days = [dt.date(2024, 1, d) for d in (3, 4, 5)] + [dt.date(2024, 3, 1)]  # the last has a leaf and no rows
    leaf = spark.createDataFrame([("ticks", d) for d in days], "table_name string, day date")
    lines = {}
    for kind, most in (("observed", 8), ("counted", 0)):
        monkeypatch.setattr(jobs, "OBSERVED_DAYS", most)
        calls = []
        stats = jobs._day_stats
        monkeypatch.setattr(jobs, "_day_stats", lambda *a, stats=stats, calls=calls: calls.append(1) or stats(*a))
        out = jobs.export_days(spark, table, "ticks", "bus_time", ["id"], days, leaf, None, f"{scratch}/{kind}", TICKS_ARCHIVE_SCHEMA,
                               exported_at="2024-02-01T00:00:00Z", fmt=fmt, day_col="day", n_parts=5)
        monkeypatch.setattr(jobs, "_day_stats", stats)
        lines[kind] = sorted((r["day"], r["bound_lower"], r["bound_upper"], r["rows"]) for r in out.collect())
        assert len(calls) == (0 if kind == "observed" else 1)
        back = arc.read_archive(spark, f"{scratch}/{kind}/ticks", TICKS_ARCHIVE_SCHEMA).drop("day")
        assert back.exceptAll(t.where(day_of("bus_time").isin(days)).select(*back.columns)).count() == 0
    assert lines["observed"] == lines["counted"] and lines["observed"][-1][1:] == ("0", "1", "0")
