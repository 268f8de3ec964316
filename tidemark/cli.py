"""Driver program for the nightly jobs.

``spark-submit --py-files tidemark.zip tidemark/cli.py <command> ...`` on a
cluster, ``python -m tidemark.cli <command> ...`` locally.

One command per job of the reference's scripts (export a day, purge a day,
retention, partition coverage, candle ingest and sweep, backfill, staleness,
log report).  Every command runs the Spark job from ``plans.jobs`` over all
requested days at once and prints its (calendar-sized) result rows as JSON
lines.  Tables are ``day=YYYY-MM-DD``-partitioned Parquet folders; ledgers
are TSV text.  The exit status is 1 if any day was refused or failed, a table
is blocked or short of leaves, a job is stale or its last run had problems.
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas as S
from tidemark.plans import jobs
from tidemark.session import ensure_utc


def _day(s: str) -> dt.date:
    d = dt.date.fromisoformat(s)
    if d.isoformat() != s:
        raise argparse.ArgumentTypeError(f"not a YYYY-MM-DD day: {s}")
    return d


def _archive_schema(data: DataFrame, table: str) -> T.StructType:
    """Trades archives keep the pinned v1 column order; other tables keep their own order."""
    cols = S.TRADE_COLUMNS_V1 if table == "trades" else [c for c in data.columns if c != "day"]
    return T.StructType([data.schema[c] for c in cols])


def _open(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table's rows; where every leaf left is empty and no file tells the columns, those that the jobs need."""
    cfg = S.TABLES[table]
    time_type = {"timestamp": T.TimestampType(), "executed_at": T.TimestampType(), "open_at": T.TimestampType()}
    names = S.TRADE_COLUMNS_V1 if table == "trades" else list(dict.fromkeys(["id", cfg.time_col, *cfg.order_cols]))
    fallback = T.StructType([T.StructField(c, time_type.get(c, T.LongType() if c == "id" else T.StringType())) for c in names])
    return spark.read.schema(jobs.table_schema(spark, path, fallback)).parquet(path)


def _emit(rows) -> None:
    for r in rows:
        print(json.dumps({k: (v.isoformat() if hasattr(v, "isoformat") else v) for k, v in r.asDict().items()}))


def _common(p: argparse.ArgumentParser) -> None:
    p.add_argument("--table", required=True, choices=sorted(S.TABLES))
    p.add_argument("--data", required=True, help="day-partitioned Parquet folder of the table")
    p.add_argument("--archive", required=True, help="archive root (shared storage)")
    p.add_argument("--ledger", required=True, help="ledger (MANIFEST) path")
    p.add_argument("--fmt", default="csv.zst", choices=["csv.zst", "csv.gz"])


def cmd_export(spark: SparkSession, a) -> int:
    from tidemark.sources.ledger import read_manifest
    from tidemark.sources.tables import table_leaves

    from tidemark.operators import calendar as cal

    cfg = S.TABLES[a.table]
    data = spark.read.parquet(a.data)
    leaves = table_leaves(spark, a.data, a.table)
    ledger = read_manifest(spark, a.ledger, a.table)
    lines = jobs.export_days(spark, data, a.table, cfg.time_col, list(cfg.order_cols), a.days, leaves, ledger,
                             a.archive, _archive_schema(data, a.table), ledger_path=a.ledger, fmt=a.fmt,
                             adopt=a.adopt, id_col="id" if cfg.ledger_kind == "ticks" else None,
                             day_col="day").collect()
    _emit(lines)
    # one line per refused day, with the reason (day lists are calendar sized)
    done = {r["day"] for r in lines}
    have_leaf = {r["day"] for r in leaves.select("day").collect()}
    in_ledger = {r["day"] for r in cal.ledger_days(ledger).select("day").collect()}
    for d in a.days:
        if d.isoformat() in done:
            continue
        reason = ("no exact daily partition" if d not in have_leaf else
                  "already in the ledger" if d in in_ledger else "archive already exists")
        print(json.dumps({"day": d.isoformat(), "refused": reason}))
    return int(any(d.isoformat() not in done for d in a.days))


def cmd_backfill(spark: SparkSession, a) -> int:
    from tidemark.sources.ledger import read_manifest
    from tidemark.sources.tables import table_leaves

    cfg = S.TABLES[a.table]
    data = spark.read.parquet(a.data)
    outcomes, summary = jobs.backfill(spark, data, a.table, cfg.time_col, list(cfg.order_cols),
                                      a.start, a.end, table_leaves(spark, a.data, a.table),
                                      read_manifest(spark, a.ledger, a.table), a.archive,
                                      _archive_schema(data, a.table), ledger_path=a.ledger,
                                      id_col="id" if cfg.ledger_kind == "ticks" else None, day_col="day",
                                      fmt=a.fmt)
    rows = outcomes.orderBy("day").collect()  # calendar sized
    _emit(rows)
    _emit(summary.collect())
    return int(any(r["outcome"] in ("fail", "not_attempted") for r in rows))


def cmd_purge(spark: SparkSession, a) -> int:
    from tidemark.sources import archive as arc
    from tidemark.sources.ledger import read_manifest
    from tidemark.sources.tables import children_of, table_leaves

    cfg = S.TABLES[a.table]
    data = _open(spark, a.data, a.table)
    days_df = spark.createDataFrame([(a.table, d) for d in a.days], "table_name string, day date")
    inv = arc.day_inventory(arc.archive_inventory(spark, arc.day_folders(f"{a.archive}/{a.table}", a.days))).select(
        F.concat(F.lit(a.table + "-"), F.col("day").cast("string"), F.lit("." + a.fmt)).alias("file"),
        "bytes", "sha256")
    counts = data.where(F.col("day").isin(a.days)).groupBy("day").agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("table_name", F.lit(a.table))
    plan = jobs.purge_plan(days_df, read_manifest(spark, a.ledger, a.table, cfg.ledger_kind), inv,
                           children_of(table_leaves(spark, a.data, a.table)), counts, armed=a.armed,
                           suffix="." + a.fmt, listing=jobs.table_day_listing(spark, a.data, a.days)).cache()
    dropped = set(jobs.apply_purge(spark, plan, a.data, cfg.time_col)) if a.apply else set()
    rows = plan.withColumn("dropped", F.date_format("day", "yyyy-MM-dd").isin(list(dropped)) if dropped
                           else F.lit(False)).orderBy("day").collect()
    _emit(rows)
    return int(any(r["decision"] != "PURGE" or (a.apply and not r["dropped"]) for r in rows))


def cmd_retention(spark: SparkSession, a) -> int:
    cfg = S.TABLES[a.table]
    data = _open(spark, a.data, a.table)
    out = jobs.run_retention(spark, a.data, a.table, cfg.time_col, list(cfg.order_cols),
                             _archive_schema(data, a.table), a.archive, a.ledger, a.today, a.horizon, a.max_days,
                             fmt=a.fmt, armed=a.armed)
    rows = out.orderBy("day").collect()
    _emit(rows)
    return int(not all(r["dropped"] for r in rows))


def cmd_restore(spark: SparkSession, a) -> int:
    from tidemark.sources.ledger import read_manifest

    cfg = S.TABLES[a.table]
    schema = _archive_schema(_open(spark, a.data, a.table), a.table)
    ledger = read_manifest(spark, a.ledger, a.table) if a.ledger else None
    out = jobs.restore_into_table(spark, a.archive, a.table, a.days, schema, a.data, cfg.time_col, ledger=ledger,
                                  supplement_ledger=a.supplements, supplement_folder=a.supplement_folder)
    rows = out.orderBy("day").collect()
    _emit(rows)
    refused = [d for d in a.days if d not in {r["day"] for r in rows}]
    for d in refused:
        print(json.dumps({"day": d.isoformat(), "refused": "the table has this day, or the archive has no rows of it"}))
    return int(bool(refused))


def cmd_partitions(spark: SparkSession, a) -> int:
    from tidemark.operators import calendar as cal
    from tidemark.sources.ledger import read_manifest
    from tidemark.sources.tables import table_leaves

    leaves, ledgers, defaults, config = None, None, [], []
    for spec in a.data:
        table, path = spec.split("=", 1)
        lv = table_leaves(spark, path, table)
        leaves = lv if leaves is None else leaves.unionByName(lv)
        cfg = S.TABLES[table]
        config.append((table, cfg.back_days, cfg.purged_by_retention))
    for spec in a.ledger or []:
        table, path = spec.split("=", 1)
        led = cal.ledger_days(read_manifest(spark, path, table))
        ledgers = led if ledgers is None else ledgers.unionByName(led)
    for spec in a.default or []:
        table, path = spec.split("=", 1)
        defaults.append(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("default_rows"))
                        .select(F.lit(table).alias("table_name"), "default_rows"))
    if ledgers is None:
        ledgers = spark.createDataFrame([], "table_name string, day date")
    dr = spark.createDataFrame([], "table_name string, default_rows long")
    for d in defaults:
        dr = dr.unionByName(d)
    conf = spark.createDataFrame(config, "table_name string, back_days int, purged_by_retention boolean")
    out = jobs.partition_coverage(leaves, conf, a.today, ledgers, dr, a.forward, a.forward_min)
    report = out.orderBy("table_name").collect()
    _emit(report)
    # the ensure list: one (table, anchor) per 14-day window of leaves to create, never for archived days
    scope = cal.scope(cal.backward_window(conf), a.today, "back", a.forward)
    kept = cal.drop_archived_days(cal.missing_days(leaves, scope), ledgers)
    _emit(cal.cover_anchors(kept).orderBy("table_name", "anchor").collect())
    return int(any(r["blocked"] or r["failed"] for r in report))


def cmd_candles_sweep(spark: SparkSession, a) -> int:
    candles = spark.read.parquet(a.data)
    if not a.out:  # in place: closed versions leave the table's own partitions
        rows = jobs.sweep_apply(spark, a.data, a.start, a.end, a.archive, a.keys, a.timeframes).orderBy("timeframe", "day").collect()
        _emit(rows)
        return int(not all(r["swapped"] for r in rows))
    if {"timeframe", "day"} <= set(candles.columns):  # partitioned by both: only touched partitions are rewritten
        n = jobs.sweep_partitions(spark, a.data, a.start, a.end, a.archive, a.out, a.keys, a.timeframes)
        print(json.dumps({"swept_into": a.archive, "rewritten": a.out, "partitions": n}))
        return 0
    rest = jobs.candle_sweep_job(candles, a.start, a.end, a.archive, a.keys, a.timeframes)
    rest.write.mode("error").partitionBy("timeframe").parquet(a.out)
    print(json.dumps({"swept_into": a.archive, "remaining": a.out}))
    return 0


def cmd_ingest(spark: SparkSession, a) -> int:
    """The cached 1m bars and the timeframes made from them: into --catalog-table in place, or merged with --data to --out."""
    if bool(a.out) == bool(a.catalog_table):
        raise RuntimeError("REFUSE: ingest needs either --catalog-table or --out")
    current = spark.table(a.catalog_table) if a.catalog_table else spark.read.parquet(a.data) if a.data else None
    known = current.where(F.col("timeframe") == "1m") if current is not None else None
    src = (known.groupBy(F.col("instrument").alias("source")).agg(
        F.unix_seconds(F.max("open_at").cast("timestamp")).alias("last_epoch")) if known is not None
        else spark.createDataFrame([], "source string, last_epoch long"))
    if a.catalog_table:
        _emit(jobs.candle_ingest_table(spark, a.catalog_table, a.cache, src, a.now, a.keys).orderBy("timeframe", "day").collect())
        return 0
    out = jobs.candle_ingest(spark, a.cache, src, a.now, a.keys, current=current, table_path=a.data)
    out.withColumn("day", F.to_date("open_at")).write.mode("error").partitionBy("timeframe", "day").parquet(a.out)
    print(json.dumps({"bars": spark.read.parquet(a.out).count(), "written": a.out}))
    return 0


def cmd_staleness(spark: SparkSession, a) -> int:
    """Days since the last ledger line of each table."""
    from tidemark.operators import runlog
    from tidemark.sources.ledger import read_manifest

    stamps = None
    for spec in a.ledger:
        table, path = spec.split("=", 1)
        one = read_manifest(spark, path, table).select(F.try_to_timestamp(
            "exported_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("success_at"))
        one = spark.createDataFrame([(table,)], "job string").join(one.agg(F.max("success_at").alias("success_at")))
        stamps = one if stamps is None else stamps.unionByName(one)
    rows = runlog.staleness(stamps, a.now, a.limit).orderBy("job").collect()  # one row a table
    _emit(rows)
    return int(any(r["stale"] for r in rows))


def cmd_logs(spark: SparkSession, a) -> int:
    """Per log: runs, failed runs and the problems of its current run, then the alert body.  No row per run is collected."""
    from tidemark.operators import runlog
    from tidemark.sources.runlog import read_run_logs

    log = read_run_logs(spark, a.logs)
    pattern = runlog.banner_pattern(a.job) if a.job else None
    problems = jobs.run_log_report(log, pattern)["problems"]
    if a.runs_out:
        problems.write.mode("error").parquet(a.runs_out)
        problems = spark.read.parquet(a.runs_out)
    rows = problems.groupBy("file").agg(
        F.count("*").alias("n_runs"), F.count_if("failed").alias("n_failed"),
        F.max_by("n_problems", "run_no").alias("n_problems"), F.max("run_no").alias("run_no"),
        F.max_by("failed", "run_no").alias("failed")).orderBy("file").collect()  # one row a log file
    _emit(rows)
    _emit(runlog.current_run_tail(log, pattern=pattern, subject_prefix=a.subject_prefix).orderBy("file", "line_no").collect())
    return int(any(r["failed"] for r in rows))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    sub = p.add_subparsers(dest="cmd", required=True)
    e = sub.add_parser("export", help="export whole UTC days to the archive and the ledger")
    _common(e)
    e.add_argument("--adopt", action="store_true", help="adopt published days that lack a ledger line")
    e.add_argument("days", nargs="+", type=_day)
    b = sub.add_parser("backfill", help="export every day of a range not yet in the ledger")
    _common(b)
    b.add_argument("--from", dest="start", required=True, type=_day)
    b.add_argument("--to", dest="end", required=True, type=_day)
    pu = sub.add_parser("purge", help="plan (and with --apply, drop) verified days")
    _common(pu)
    pu.add_argument("--armed", action="store_true", help="allow purging trades")
    pu.add_argument("--apply", action="store_true")
    pu.add_argument("days", nargs="+", type=_day)
    r = sub.add_parser("retention", help="export and purge the oldest days past the horizon")
    _common(r)
    r.add_argument("--today", type=_day, default=dt.datetime.now(dt.timezone.utc).date())
    r.add_argument("--horizon", type=int, default=S.RETENTION_HORIZON_DAYS)
    r.add_argument("--max-days", type=int, default=S.MAX_DAYS_PER_RUN)
    r.add_argument("--armed", action="store_true", help="allow purging trades")
    rs = sub.add_parser("restore", help="put archived days (and their supplement rows) back into the table")
    rs.add_argument("--table", required=True, choices=sorted(S.TABLES))
    rs.add_argument("--data", required=True)
    rs.add_argument("--archive", required=True)
    rs.add_argument("--ledger", help="MANIFEST: the archived row counts must equal its lines")
    rs.add_argument("--supplements", help="supplement ledger (SUPPLEMENTS.tsv): files, days, sizes and hashes")
    rs.add_argument("--supplement-folder", help="where the supplement files are (default: the archive root)")
    rs.add_argument("days", nargs="+", type=_day)
    pa_ = sub.add_parser("partitions", help="leaf coverage report: missing days, anchors, headroom, DEFAULT")
    pa_.add_argument("--data", action="append", required=True, help="TABLE=PATH (day-partitioned)")
    pa_.add_argument("--ledger", action="append", help="TABLE=PATH")
    pa_.add_argument("--default", action="append", help="TABLE=PATH of the DEFAULT rows")
    pa_.add_argument("--today", type=_day, default=dt.datetime.now(dt.timezone.utc).date())
    pa_.add_argument("--forward", type=int, default=S.FORWARD_DAYS)
    pa_.add_argument("--forward-min", type=int, default=S.FORWARD_MIN_DAYS)
    c = sub.add_parser("candles-sweep", help="archive closed candle versions and write the rest")
    c.add_argument("--data", required=True)
    c.add_argument("--archive", required=True)
    c.add_argument("--out", help="write the rest there instead of sweeping the (timeframe, day)-partitioned table in place")
    c.add_argument("--from", dest="start", default="2023-01-01")
    c.add_argument("--to", dest="end", required=True)
    c.add_argument("--keys", nargs="+", default=["exchange", "instrument"])
    c.add_argument("--timeframes", nargs="+", default=S.TIMEFRAMES)
    lg = sub.add_parser("logs", help="problem lines per run and the current run's alert body")
    lg.add_argument("--logs", required=True)
    lg.add_argument("--job")
    lg.add_argument("--subject-prefix", help="how alert subjects start; such lines belong to the alert body")
    lg.add_argument("--runs-out", help="Parquet folder for one row per run")
    ig = sub.add_parser("ingest", help="load cached 1m candles, synthesize timeframes, merge into the candle table")
    ig.add_argument("--cache", required=True, help="folder of daily 1m candle CSV files")
    ig.add_argument("--data", help="the current candle table; its missing days since the lookback get a leaf first")
    ig.add_argument("--out", help="folder for the merged table")
    ig.add_argument("--catalog-table", help="bucketed candle table to upsert in place")
    ig.add_argument("--now", default=dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
    ig.add_argument("--keys", nargs="+", default=["exchange", "instrument"])
    st = sub.add_parser("staleness", help="days since each table's last export")
    st.add_argument("--ledger", action="append", required=True, help="TABLE=PATH")
    st.add_argument("--now", default=dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%d %H:%M:%S"))
    st.add_argument("--limit", type=int, default=S.STALE_SUCCESS_DAYS)
    return p


COMMANDS = {"export": cmd_export, "backfill": cmd_backfill, "purge": cmd_purge, "retention": cmd_retention,
            "restore": cmd_restore, "partitions": cmd_partitions, "candles-sweep": cmd_candles_sweep,
            "ingest": cmd_ingest, "staleness": cmd_staleness, "logs": cmd_logs}


def main(argv=None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if spark is None:  # the master and resources come from spark-submit, never from here
        spark = (SparkSession.builder.appName(f"tidemark-{a.cmd}")
                 .config("spark.ui.enabled", "false")
                 .config("spark.sql.session.timeZone", "UTC")
                 .config("spark.sql.adaptive.enabled", "true")
                 .config("spark.sql.adaptive.skewJoin.enabled", "true")
                 .getOrCreate())
    ensure_utc(spark)
    try:
        return COMMANDS[a.cmd](spark, a)
    except RuntimeError as e:  # a job's own refusal
        print(json.dumps({"refused": str(e)}))
        return 1


if __name__ == "__main__":
    sys.exit(main())
