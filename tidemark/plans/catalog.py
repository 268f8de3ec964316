"""Registered queries: one per operator or job, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the provided tables through the views of
``sources.fixtures`` and runs over them whole.  Column names and types match
the DuckDB oracle in ``plans.oracle``.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas as S
from tidemark.functions.exprs import day_of
from tidemark.operators import calendar as cal
from tidemark.operators import candles as cdl
from tidemark.operators import late, runlog, slices, verify
from tidemark.plans import jobs
from tidemark.plans import params as P
from tidemark.session import ensure_utc, settled, settling, shared_dir
from tidemark.sources import archive as arc
from tidemark.sources import fixtures as fx
from tidemark.sources.candle_csv import write_candle_csv


def _days(spark: SparkSession, lo: str, hi: str, table: str | None = None) -> DataFrame:
    """A calendar of days [lo, hi]: generated, calendar sized.

    The table name is carried as data, not as a literal, so joins on
    ``table_name`` stay equi-joins instead of being folded into filters.
    """
    if not table:
        return spark.range(1).select(cal.day_sequence(lo, hi).alias("day"))
    return spark.createDataFrame([(table,)], "table_name string").select(
        "table_name", cal.day_sequence(lo, hi).alias("day"))


def _config(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(P.CONFIG, "table_name string, back_days int, purged_by_retention boolean")


def _scope(spark: SparkSession) -> DataFrame:
    return cal.scope(cal.backward_window(_config(spark)), P.TODAY, "back", P.FORWARD)


def _ledgers(spark, sf):
    return fx.ledger(spark, sf).unionByName(fx.trades_ledger(spark, sf))


def _ticks_parts(t: DataFrame):
    return [F.col("id"), F.unix_micros(F.col("bus_time").cast("timestamp")),
            F.round(F.col("price") * 100).cast("long")]


# ---------------------------------------------------------------- step 1
def q_day_counts(spark, sf):
    ensure_utc(spark)
    return slices.day_counts(fx.ticks(spark, sf), "bus_time")


def q_day_slice(spark, sf):
    ensure_utc(spark)
    return slices.day_slice(fx.ticks(spark, sf), "bus_time", P.SLICE_FROM, P.SLICE_TO)


def q_id_bounds(spark, sf):
    ensure_utc(spark)
    hi = (dt.date.fromisoformat(P.BOUNDS_TO) + dt.timedelta(days=1)).isoformat()
    return slices.id_bounds(fx.ticks(spark, sf), _days(spark, P.BOUNDS_FROM, P.BOUNDS_TO), "bus_time", "id",
                            lo=P.BOUNDS_FROM, hi=hi)


def q_oldest_day(spark, sf):
    ensure_utc(spark)
    t = slices.oldest_day(fx.ticks(spark, sf), "bus_time", "id").select(F.lit("ticks").alias("table_name"), "*")
    r = slices.oldest_day(fx.trades(spark, sf), "executed_at", "id").select(F.lit("trades").alias("table_name"), "*")
    return t.unionByName(r)


def q_missing_days(spark, sf):
    ensure_utc(spark)
    return cal.missing_days(fx.all_leaves(spark, sf), _scope(spark))


def q_missing_days_unarchived(spark, sf):
    ensure_utc(spark)
    missing = cal.missing_days(fx.all_leaves(spark, sf), _scope(spark))
    return cal.drop_archived_days(missing, cal.ledger_days(_ledgers(spark, sf)))


def q_forward_headroom(spark, sf):
    ensure_utc(spark)
    return cal.forward_headroom(fx.all_leaves(spark, sf), _config(spark), P.TODAY)


def q_contiguous_runs(spark, sf):
    ensure_utc(spark)
    return cal.contiguous_runs(fx.all_leaves(spark, sf))


def q_cover_anchors(spark, sf):
    ensure_utc(spark)
    missing = cal.missing_days(fx.all_leaves(spark, sf), _scope(spark))
    return cal.cover_anchors(cal.drop_archived_days(missing, cal.ledger_days(_ledgers(spark, sf))))


def _session_leaves(spark, sf):
    """Keyed leaves straight from a fact table: one (session, day) per day a session traded."""
    tr = fx.trades(spark, sf)
    return tr.select("session_id", day_of("bus_time").alias("day")).distinct()


def q_session_missing_days(spark, sf):
    """J1 keyed by session: the January days each trading session had no trade, from the whole trades table."""
    ensure_utc(spark)
    lv = _session_leaves(spark, sf)
    sc = cal.scope(lv.select("session_id"), P.TODAY, 14, 15, keys=["session_id"])
    return cal.missing_days(lv, sc, keys=["session_id"])


def q_session_anchors(spark, sf):
    """W1 keyed by session: the greedy 14-day cover of each session's missing days (one bounded fold per key)."""
    ensure_utc(spark)
    return cal.cover_anchors(q_session_missing_days(spark, sf), keys=["session_id"])


def q_session_runs(spark, sf):
    """W3 keyed by session: islands of consecutive trading days per session."""
    ensure_utc(spark)
    return cal.contiguous_runs(_session_leaves(spark, sf), keys=["session_id"])


def q_leaf_catalog(spark, sf):
    ensure_utc(spark)
    lv = fx.all_leaves(spark, sf)
    junk = lv.select("table_name", F.concat("table_name", F.lit("_default")).alias("leaf_name")).distinct() \
        .unionByName(lv.select("table_name", F.concat("table_name", F.lit("_d"), F.date_format("day", "yyyyMM"),
                                                      F.lit("32")).alias("leaf_name")).distinct()) \
        .unionByName(lv.select("table_name", F.concat("table_name", F.lit("_d"), F.date_format("day", "yyyyMMdd"),
                                                      F.lit("_old")).alias("leaf_name")))
    names = lv.select("table_name", "leaf_name").unionByName(junk)
    return cal.leaf_catalog(names)


def q_read_days(spark, sf):
    """Whole UTC days of ticks that have their own leaf (the 11th and 22nd do not)."""
    ensure_utc(spark)
    from tidemark.sources.tables import read_days

    return read_days(fx.ticks(spark, sf), "bus_time", P.BACKFILL_FROM, "2024-01-31", fx.leaf(spark, sf), "ticks")


def q_read_trades(spark, sf):
    """Pinned 12 archive columns of trades executed in [SLICE_FROM, SLICE_TO)."""
    ensure_utc(spark)
    from tidemark.sources.tables import read_trades

    t = fx.trades(spark, sf).withColumnRenamed("bus_time", "timestamp")
    return read_trades(t, P.SLICE_FROM, P.SLICE_TO)


# ---------------------------------------------------------------- step 2
def q_reconcile_counts(spark, sf):
    ensure_utc(spark)
    counts = slices.day_counts(fx.ticks(spark, sf), "bus_time").withColumn("table_name", F.lit("ticks"))
    return verify.reconcile_counts(counts, fx.ledger(spark, sf))


def q_ledger_health(spark, sf):
    ensure_utc(spark)
    return verify.ledger_health(_ledgers(spark, sf))


def q_manifest_valid(spark, sf):
    ensure_utc(spark)
    return verify.manifest_valid(_ledgers(spark, sf))


def q_skip_done_days(spark, sf):
    ensure_utc(spark)
    days = _days(spark, P.BACKFILL_FROM, P.BACKFILL_TO, "ticks")
    return verify.skip_done_days(days, cal.ledger_days(fx.ledger(spark, sf)))


def q_last_ledger_line(spark, sf):
    ensure_utc(spark)
    return verify.last_line_per_day(_ledgers(spark, sf)).select(
        "table_name", "day", "line_no", "nf", "file", "rows", "sha256")


def q_resolve_purge_target(spark, sf):
    ensure_utc(spark)
    days = _days(spark, P.TARGET_FROM, P.TARGET_TO, "ticks").unionByName(
        _days(spark, P.TARGET_FROM, P.TARGET_TO, "trades"))
    return verify.resolve_purge_target(days, fx.children(spark, sf))


def q_verify_archive(spark, sf):
    ensure_utc(spark)
    lines = fx.ledger(spark, sf).select("table_name", "line_no", "day", "file", "bytes", "sha256")
    return verify.verify_archive(lines, fx.inventory(spark, sf)).select(
        "table_name", "line_no", "day", "file", "archive_verdict")


def q_purge_plan(spark, sf):
    ensure_utc(spark)
    days = _days(spark, P.PURGE_FROM, P.PURGE_TO, "ticks")
    t = fx.ticks(spark, sf)
    hi = (dt.date.fromisoformat(P.PURGE_TO) + dt.timedelta(days=1)).isoformat()
    counts = slices.day_counts(slices.day_slice(t, "bus_time", P.PURGE_FROM, hi), "bus_time") \
        .withColumn("table_name", F.lit("ticks"))
    c = fx.pinned(fx.counts(spark, sf))  # ledger, inventory and leaves come from one pass over the table
    return jobs.purge_plan(days, fx.ledger(spark, sf, c), fx.inventory(spark, sf, c), fx.children(spark, sf, c), counts)


def q_purge_plan_trades(spark, sf, armed: bool = True):
    """Trades purge plan: event-time days, timestamp bounds in the ledger, the arming rule."""
    ensure_utc(spark)
    days = _days(spark, P.TRADES_PURGE_FROM, P.TRADES_PURGE_TO, "trades")
    t = fx.trades(spark, sf)
    hi = (dt.date.fromisoformat(P.TRADES_PURGE_TO) + dt.timedelta(days=1)).isoformat()
    counts = slices.day_counts(slices.day_slice(t, "executed_at", P.TRADES_PURGE_FROM, hi), "executed_at") \
        .withColumn("table_name", F.lit("trades"))
    return jobs.purge_plan(days, fx.trades_ledger(spark, sf), fx.trades_inventory(spark, sf),
                           fx.children(spark, sf), counts, armed=armed)


def q_staleness(spark, sf):
    ensure_utc(spark)
    led = _ledgers(spark, sf)
    stamps = led.select(F.col("table_name").alias("job"),
                        F.try_to_timestamp("exported_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
                        .cast("timestamp_ntz").alias("success_at"))
    jobs_df = spark.createDataFrame([(j,) for j in S.TABLES], "job string")  # candles never succeeded here
    return runlog.staleness(jobs_df.join(stamps, "job", "left"), P.STALE_NOW)


def q_ledger_totals(spark, sf):
    ensure_utc(spark)
    return runlog.ledger_totals(_ledgers(spark, sf))


# ---------------------------------------------------------------- step 3
def q_route_rows(spark, sf):
    ensure_utc(spark)
    return late.route_rows(fx.ticks(spark, sf), "bus_time", fx.leaf(spark, sf), "ticks").select("id", "day", "target")


def q_stream_route_default(spark, sf):
    """L1 as a stream: ticks arrive as files, each micro-batch is routed by foreachBatch; returns the DEFAULT sink."""
    ensure_utc(spark)
    from tidemark.streaming.routing import start_routing

    base = f"{shared_dir(spark)}/tidemark-stream-{uuid.uuid4().hex}"
    t = fx.ticks(spark, sf)
    # the ticks arrive in three ten-day drops, so the stream sees several micro-batches
    t.withColumn("_drop", F.floor((F.dayofmonth("bus_time") - 1) / 10)).write.partitionBy("_drop") \
        .parquet(f"{base}/spool")
    stream = (spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2).option("recursiveFileLookup", True)
              .parquet(f"{base}/spool"))
    q = start_routing(stream, "bus_time", fx.leaf(spark, sf), "ticks", f"{base}/table", f"{base}/default",
                      f"{base}/checkpoint")
    q.awaitTermination()  # availableNow ends by itself, whenever all files are routed
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return settled(spark.read.parquet(f"{base}/default").select("id", "day"), base)


def q_default_rows(spark, sf):
    ensure_utc(spark)
    lv = fx.all_leaves(spark, sf)
    return late.default_rows(fx.ticks(spark, sf), "bus_time", lv, "ticks").unionByName(
        late.default_rows(fx.trades(spark, sf), "executed_at", lv, "trades"))


def q_late_arrivals(spark, sf):
    ensure_utc(spark)
    return late.late_arrivals(fx.trades(spark, sf), "executed_at", "bus_time").select(
        "arrival_day", F.col("lag_days").cast("long").alias("lag_days"), "n_rows")


def q_sealed_day_late_rows(spark, sf):
    ensure_utc(spark)
    return late.sealed_day_late_rows(fx.trades(spark, sf), "executed_at", "bus_time", fx.trades_ledger(spark, sf),
                                     "trades").select("id", "day", "bus_time", "executed_at")


@settling
def q_monotonicity_violations(spark, sf):
    ensure_utc(spark)
    t = fx.trades(spark, sf).select("id", "executed_at")
    return late.monotonicity_violations(t, "id", "executed_at")


# ---------------------------------------------------------------- step 4
def q_ticks_to_candles(spark, sf):
    ensure_utc(spark)
    return cdl.ticks_to_candles(fx.ticks(spark, sf), "1h", ["instrument"], "bus_time", "price", "id")


def _c1m(spark, sf):
    return cdl.ticks_to_candles(fx.ticks(spark, sf), "1m", ["instrument"], "bus_time", "price", "id")


def q_synthesize_candles(spark, sf):
    ensure_utc(spark)
    return cdl.synthesize_candles(_c1m(spark, sf), ["instrument"], S.DERIVED_TIMEFRAMES,
                                  P.SYNTH_START, P.SYNTH_END, P.SYNTH_CUT)


def q_close_versions(spark, sf):
    ensure_utc(spark)
    v = fx.lineitem_versions(spark, sf)
    return cdl.close_versions(v, ["l_orderkey", "l_linenumber"], ["known_from", "l_partkey", "l_suppkey"])


@settling
def q_closed_versions(spark, sf):
    ensure_utc(spark)
    v = q_close_versions(spark, sf)
    return cdl.closed_versions(v, "known_from", P.VERSIONS_FROM, P.VERSIONS_TO)


def q_candle_upsert(spark, sf):
    """The live publisher first wrote each 1h bar half-way through its hour; the end-of-day republish
    over all ticks closes the versions that changed and adds the bars first seen after minute 30."""
    ensure_utc(spark)
    t = fx.ticks(spark, sf)
    keys = ["instrument", "timeframe", "open_at"]
    first = cdl.ticks_to_candles(t.where(F.minute("bus_time") < 30), "1h", ["instrument"], "bus_time", "price", "id") \
        .withColumn("known_from", F.lit(P.UPSERT_FIRST).cast("timestamp_ntz")) \
        .withColumn("known_to", F.lit(S.SENTINEL).cast("timestamp_ntz"))
    again = cdl.ticks_to_candles(t, "1h", ["instrument"], "bus_time", "price", "id")
    return cdl.scd2_upsert(first, again, keys, cdl.CANDLE_VALUE_COLUMNS, P.UPSERT_AT)


def q_lookback_since(spark, sf):
    ensure_utc(spark)
    src = fx.ticks(spark, sf).groupBy(F.col("instrument").alias("source")).agg(
        F.unix_seconds(F.max("bus_time").cast("timestamp")).alias("last_epoch"))
    return cdl.lookback_since(src, P.LOOKBACK_NOW)


# ---------------------------------------------------------------- step 5
def q_day_content_digest(spark, sf):
    ensure_utc(spark)
    t = fx.ticks(spark, sf)
    return arc.day_content_digest(t, "bus_time", _ticks_parts(t))


TICKS_ARCHIVE_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("bus_time", T.TimestampNTZType()),
    T.StructField("instrument", T.StringType()), T.StructField("price", T.DoubleType())])


def _export_all_days(spark, sf) -> str:
    """Export every ticks day with rows, as .csv.zst, to a fresh folder under the shared directory."""
    root = f"{shared_dir(spark)}/tidemark-archive-{uuid.uuid4().hex}"
    t = fx.ticks(spark, sf)
    leaf_all = fx.pinned(t.select(F.lit("ticks").alias("table_name"), day_of("bus_time").alias("day")).distinct())
    days = sorted(r["day"] for r in leaf_all.collect())
    jobs.export_days(spark, t, "ticks", "bus_time", ["id"], days, leaf_all, None, root, TICKS_ARCHIVE_SCHEMA,
                     ledger_path=f"{root}/MANIFEST", fmt="csv.zst")
    return root


def q_export_restore_roundtrip(spark, sf):
    """Export all days, re-read the archive strictly, digest per day: equals the table's digest."""
    ensure_utc(spark)
    root = _export_all_days(spark, sf)
    back = arc.read_archive(spark, f"{root}/ticks", TICKS_ARCHIVE_SCHEMA).drop("day")
    return settled(arc.day_content_digest(back, "bus_time", _ticks_parts(back)), root)


@settling
def q_reconcile_export(spark, sf):
    """J5 with all three legs: table rows = ledger rows = rows re-read from the exported archive."""
    ensure_utc(spark)
    from tidemark.sources.ledger import read_manifest

    root = _export_all_days(spark, sf)
    t = fx.ticks(spark, sf)
    table_counts = slices.day_counts(t, "bus_time").withColumn("table_name", F.lit("ticks"))
    archived = arc.read_archive(spark, f"{root}/ticks", TICKS_ARCHIVE_SCHEMA)
    archive_counts = archived.groupBy("day").agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("table_name", F.lit("ticks"))
    return settled(verify.reconcile_counts(table_counts, read_manifest(spark, f"{root}/MANIFEST", "ticks"), archive_counts), root)


@settling
def q_purge_plan_export(spark, sf):
    """P3 over a real export: the ledger it wrote, the sizes and sha256 of its files, the leaf catalog."""
    ensure_utc(spark)
    from tidemark.sources.ledger import read_manifest

    root = _export_all_days(spark, sf)
    t = fx.ticks(spark, sf)
    inv = arc.day_inventory(arc.archive_inventory(spark, f"{root}/ticks")).select(
        F.concat(F.lit("ticks-"), F.col("day").cast("string"), F.lit(".csv.zst")).alias("file"), "bytes", "sha256")
    counts = slices.day_counts(t, "bus_time").withColumn("table_name", F.lit("ticks"))
    days = counts.select("table_name", "day")
    return settled(jobs.purge_plan(days, read_manifest(spark, f"{root}/MANIFEST", "ticks"), inv, fx.children(spark, sf),
                                   counts), root)


def q_archive_inventory(spark, sf):
    ensure_utc(spark)
    root = _export_all_days(spark, sf)
    files = arc.archive_inventory(spark, f"{root}/ticks")
    return settled(arc.day_inventory(files), root)


@settling
def q_export_ledger(spark, sf):
    ensure_utc(spark)
    root = _export_all_days(spark, sf)
    from tidemark.sources.ledger import read_manifest

    return settled(read_manifest(spark, f"{root}/MANIFEST", "ticks").select(
        F.try_to_date("day", "yyyy-MM-dd").alias("day"), F.col("bound_lower").cast("long").alias("id_lower"),
        F.col("bound_upper").cast("long").alias("id_upper"), F.col("rows").cast("long").alias("n_rows"), "nf"), root)


def q_restore_days(spark, sf):
    """Base archive (ticks minus recovered rows) + supplement file, which also repeats
    rows the base already holds: the restore must not duplicate them."""
    ensure_utc(spark)
    t = fx.ticks(spark, sf)
    recovered = fx.supplement_rows(spark, sf)
    base = t.join(recovered.select("id"), "id", "left_anti")
    repeated = base.where((F.hour("bus_time") == 3) & (F.minute("bus_time") < 5))  # already in the base
    return arc.restore_days(base, recovered.unionByName(repeated), "id")


# ---------------------------------------------------------------- step 6
def _runs(spark, sf):
    return runlog.segment_runs(fx.log_lines(spark, sf).drop("ts"), runlog.banner_pattern("job"))


def q_segment_runs(spark, sf):
    ensure_utc(spark)
    return _runs(spark, sf).select("file", "line_no", "run_no")


@settling
def q_problem_count(spark, sf):
    ensure_utc(spark)
    return runlog.problem_count(_runs(spark, sf))


@settling
def q_run_tail(spark, sf):
    ensure_utc(spark)
    return runlog.run_tail(_runs(spark, sf)).withColumn("from_end", F.col("from_end").cast("long"))


@settling
def q_alert_body(spark, sf):
    ensure_utc(spark)
    return runlog.current_run_tail(fx.log_lines(spark, sf).drop("ts"), pattern=runlog.banner_pattern("job"))


@settling
def q_failure_streaks(spark, sf):
    ensure_utc(spark)
    p = runlog.problem_count(_runs(spark, sf))
    return runlog.failure_streaks(p.select("file", "run_no", "failed"))


def q_backfill_summary(spark, sf):
    ensure_utc(spark)
    days = _days(spark, P.BACKFILL_FROM, P.BACKFILL_TO)
    c = fx.counts(spark, sf).select("day", (F.col("n") * 20).cast("long").alias("bytes"))
    out = jobs.backfill_outcomes(days, fx.ledger(spark, sf), fx.leaf(spark, sf), "ticks", c)
    return runlog.backfill_summary(out)


# ---------------------------------------------------------------- step 7
def q_partition_coverage(spark, sf):
    ensure_utc(spark)
    c = fx.pinned(fx.counts(spark, sf))  # leaves and the ticks ledger come from one pass over the table
    lv = fx.all_leaves(spark, sf, c)
    led = fx.pinned(cal.ledger_days(fx.ledger(spark, sf, c).unionByName(fx.trades_ledger(spark, sf))))
    dr = late.default_rows(fx.ticks(spark, sf), "bus_time", lv, "ticks").unionByName(
        late.default_rows(fx.trades(spark, sf), "executed_at", lv, "trades"))
    return jobs.partition_coverage(lv, _config(spark), P.TODAY, led, dr)


def q_retention_plan(spark, sf):
    ensure_utc(spark)
    return jobs.retention_plan(fx.ticks(spark, sf), "bus_time", "id", fx.ledger(spark, sf), "ticks", P.TODAY,
                               S.RETENTION_HORIZON_DAYS, P.RETENTION_MAX_DAYS)


@settling
def q_candle_sweep(spark, sf):
    ensure_utc(spark)
    return jobs.candle_sweep(fx.candle_versions(spark, sf), P.SWEEP_FROM, P.SWEEP_TO).select(
        "instrument", "timeframe", "open_at", "id", "known_from", "known_to", "close")


def q_candle_ingest(spark, sf):
    """Write the 1m bars of the data as a daily CSV cache, then run the ingest job on it."""
    ensure_utc(spark)
    cache = f"{shared_dir(spark)}/tidemark-cache-{uuid.uuid4().hex}"
    write_candle_csv(_c1m(spark, sf), cache)
    src = fx.ticks(spark, sf).groupBy(F.col("instrument").alias("source")).agg(
        F.unix_seconds(F.max("bus_time").cast("timestamp")).alias("last_epoch"))
    out = jobs.candle_ingest(spark, cache, src, P.LOOKBACK_NOW, ["exchange", "instrument"])
    return settled(out.select("instrument", "timeframe", "open_at", "open", "high", "low", "close", "volume"), cache)


# ---------------------------------------------------------------- jobs over awkward data
TEXTS_ARCHIVE_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("at", T.TimestampNTZType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("amount", T.DoubleType())])


def _texts(spark, sf):
    """Documents as a day table, with NULL, empty, padded, quoted and multi-line texts, NaN and infinities mixed in."""
    d = fx.table(spark, sf, "documents")
    k, i = F.col("doc_id") % 10, F.col("doc_id")
    text = (F.when(k == 0, F.lit(None)).when(k == 1, F.lit("")).when(k == 2, F.lit("  lead and trail  "))
            .when(k == 3, F.lit('a "quoted", \\ "" text')).when(k == 4, F.lit("line\nfeed\r\nreturn\r end"))
            .otherwise(F.col("text")))
    amount = (F.when(k == 5, F.lit(float("nan"))).when(k == 6, F.lit(float("inf"))).when(k == 7, F.lit(float("-inf")))
              .when(k == 8, F.lit(None)).otherwise(i / 7))
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 5 as int), 0, 0, doc_id % 60)")
    return d.select("doc_id", at.alias("at"), text.alias("text"), "lang", amount.cast("double").alias("amount"))


def _export_texts(spark, sf, fmt):
    root = f"{shared_dir(spark)}/tidemark-texts-{uuid.uuid4().hex}"
    t = _texts(spark, sf)
    days = sorted(r["day"] for r in t.select(day_of("at").alias("day")).distinct().collect())  # five days
    leaf = t.select(F.lit("texts").alias("table_name"), day_of("at").alias("day")).distinct()
    jobs.export_days(spark, t, "texts", "at", ["doc_id"], days, leaf, None, root, TEXTS_ARCHIVE_SCHEMA, id_col=None, fmt=fmt)
    return arc.read_archive(spark, f"{root}/texts", TEXTS_ARCHIVE_SCHEMA), root


def q_export_strings_roundtrip(spark, sf):
    """Both text formats: per day, the digest of re-read rows in which NULL, "" and every kind of text stay apart."""
    ensure_utc(spark)
    amount = F.when(F.isnan("amount"), "nan").when(F.col("amount") == float("inf"), "inf").when(
        F.col("amount") == float("-inf"), "-inf").otherwise(F.coalesce(F.round(F.col("amount") * 7).cast("long").cast("string"), F.lit("~")))
    out = None
    for fmt in ("csv.gz", "csv.zst"):
        back, root = _export_texts(spark, sf, fmt)
        parts = [F.col("doc_id"), F.unix_micros(F.col("at").cast("timestamp")),
                 F.coalesce(F.concat(F.lit("="), F.col("text")), F.lit("~")),
                 F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("~")), amount]
        one = settled(arc.day_content_digest(back.drop("day"), "at", parts).select(F.lit(fmt).alias("fmt"), "*"), root)
        out = one if out is None else out.unionByName(one)
    return out


def _lineitem_candles(spark, sf):
    """SCD2 versions with zero-length ties, as a candle table: the bar's time is the version's start."""
    v = q_close_versions(spark, sf)
    return v.select(F.col("l_orderkey").alias("instrument"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey",
                    F.lit("1d").alias("timeframe"), F.col("known_from").alias("open_at"), "known_from", "known_to", "price")


@settling
def q_sweep_remainder(spark, sf):
    """P6 on versions with ties: what the sweep archived, what it left, and active versions, per start year."""
    ensure_utc(spark)
    c = _lineitem_candles(spark, sf)
    path = f"{shared_dir(spark)}/tidemark-sweep-{uuid.uuid4().hex}"
    rest = jobs.candle_sweep_job(c, P.VERSIONS_FROM, P.VERSIONS_TO, path, ["instrument", "line"])
    swept = spark.read.parquet(path)
    year = F.year("open_at").cast("long").alias("year")
    active = F.count_if(F.col("known_to") == F.lit(S.SENTINEL).cast("timestamp_ntz"))
    both = rest.select(year, F.lit("remaining").alias("part"), "known_to").unionByName(
        swept.select(year, F.lit("archived").alias("part"), "known_to"))
    return settled(both.groupBy("part", "year").agg(F.count(F.lit(1)).alias("n_rows"), active.alias("n_active")), path)


def _retention_days(spark, sf, table, rows, time_col, order, schema, **kw):
    """Three retention runs over a table with an empty leaf (the 2nd) and a gap (no leaf on the 4th)."""
    root = f"{shared_dir(spark)}/tidemark-retention-{uuid.uuid4().hex}"
    path = f"{root}/{table}"
    day = F.dayofmonth(time_col)
    rows.where(~day.isin(2, 4)).withColumn("day", day_of(time_col)).write.partitionBy("day").parquet(path)
    jobs.ensure_leaves(spark, path, dt.date(2024, 1, 2), dt.date(2024, 1, 2))
    out = None
    for run in (1, 2, 3):
        done = jobs.run_retention(spark, path, table, time_col, order, schema, f"{root}/archive", f"{root}/MANIFEST",
                                  P.TODAY, exported_at="2024-02-01T00:00:00Z", **kw)
        one = done.select(F.lit(table).alias("table_name"), F.lit(run).cast("long").alias("run"), "day", "decision", "dropped")
        out = one if out is None else out.unionByName(one)
    return settled(out, root)


@settling
def q_retention_run(spark, sf):
    """P4 end to end for ticks and trades: empty leaves drop, gaps are passed over, both ledgers verify."""
    ensure_utc(spark)
    ticks = _retention_days(spark, sf, "ticks", fx.ticks(spark, sf), "bus_time", ["id"], TICKS_ARCHIVE_SCHEMA)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("executed_at", T.TimestampNTZType()),
                           T.StructField("price", T.DoubleType())])
    tr = fx.trades(spark, sf).where(F.col("executed_at") >= "2024-01-01").select("id", "executed_at", "price")
    return ticks.unionByName(_retention_days(spark, sf, "trades", tr, "executed_at", ["executed_at", "id"], schema,
                                             armed=True))


def q_archive_bytes(spark, sf):
    """The day's archive in one plain CSV part, hashed as bytes; SQL builds the same bytes from the rows."""
    ensure_utc(spark)
    root = f"{shared_dir(spark)}/tidemark-bytes-{uuid.uuid4().hex}"
    t = fx.ticks(spark, sf).select("id", "instrument", "bus_time", F.round(F.col("price") * 100).cast("long").alias("cents"))
    arc.write_day_archive(t, root, "bus_time", ["id"], compression="none", whole_days=True)
    return settled(arc.archive_inventory(spark, root, glob="*.csv").select("day", "bytes", "sha256"), root)


@settling
def q_ledger_from_text(spark, sf):
    """The ticks ledger written as text in two appends, with short, long, blank and repeated lines, read back."""
    ensure_utc(spark)
    from tidemark.sources.ledger import append_manifest, ledger_text, read_manifest

    path = f"{shared_dir(spark)}/tidemark-ledger-{uuid.uuid4().hex}"
    led = fx.ledger(spark, sf).where("nf = 8").orderBy("line_no")
    append_manifest(led, path)
    text = ledger_text(led.where(F.col("line_no") % 20 == 11))
    bad = text.select(F.concat(F.col("value"), F.lit("\textra")).alias("value")).unionByName(
        text.select(F.regexp_replace("value", "\t[^\t]*$", "").alias("value"))).unionByName(
        text.select(F.lit("").alias("value")).limit(1))
    bad.coalesce(1).write.text(f"{path}/seq=000000000002")
    again = led.where(F.col("line_no") % 20 == 11)
    append_manifest(again.withColumn("rows", (F.col("rows").cast("long") + 1000).cast("string")), path)
    back = read_manifest(spark, path, "ticks")
    return settled(back.groupBy("day", "nf").agg(
        F.count(F.lit(1)).alias("n_lines"), F.max_by("rows", "line_no").alias("last_rows"),
        F.max_by("sha256", "line_no").alias("last_sha256")), path)


@settling
def q_run_logs_text(spark, sf):
    """Logs of one name in two folders, one a day, written as text and read back with their own numbering."""
    ensure_utc(spark)
    from tidemark.sources.runlog import read_run_logs

    base = f"{shared_dir(spark)}/tidemark-logs-{uuid.uuid4().hex}"
    lines = fx.log_lines(spark, sf).select(
        F.when(F.col("line_no") % 2 == 0, "a").otherwise("b").alias("folder"), day_of("ts").alias("day"), "line_no",
        F.concat_ws(" ", F.col("line_no").cast("string"), "line").alias("value"))
    # one file a log, whatever its folder: the logs are dealt over the tasks
    (lines.repartition("folder", "day").sortWithinPartitions("folder", "day", "line_no").drop("line_no")
     .write.partitionBy("folder", "day").text(base))
    return settled(read_run_logs(spark, base).select(
        F.regexp_extract("file", "/folder=([ab])/", 1).alias("folder"),
        F.regexp_extract("file", "/day=([0-9-]+)/", 1).cast("date").alias("day"), "line_no", "line"), base)


@settling
def q_restore_job(spark, sf):
    """Days exported without their recovered rows, purged, restored with a proved supplement file: the table's digest."""
    ensure_utc(spark)
    from tidemark.sources.ledger import read_manifest

    root = f"{shared_dir(spark)}/tidemark-restore-{uuid.uuid4().hex}"
    t, recovered = fx.ticks(spark, sf), fx.supplement_rows(spark, sf)
    base = t.join(recovered.select("id"), "id", "left_anti").select(*TICKS_ARCHIVE_SCHEMA.names)
    days = sorted(r["day"] for r in base.select(day_of("bus_time").alias("day")).distinct().collect())
    leaf = base.select(F.lit("ticks").alias("table_name"), day_of("bus_time").alias("day")).distinct()
    jobs.export_days(spark, base, "ticks", "bus_time", ["id"], days, leaf, None, root, TICKS_ARCHIVE_SCHEMA,
                     ledger_path=f"{root}/MANIFEST", fmt="csv.zst")
    arc.write_day_archive(recovered.select(*TICKS_ARCHIVE_SCHEMA.names), f"{root}/extra", "bus_time", ["id"], n_parts=1,
                          compression="none")
    files = arc.archive_inventory(spark, f"{root}/extra", glob="*.csv")
    counts = recovered.groupBy(day_of("bus_time").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ledger = files.join(counts, "day").select(
        F.concat(F.lit("day="), F.col("day").cast("string"), F.lit("/"), "part").alias("file"), F.col("day").cast("string").alias("day"),
        F.col("n").cast("string").alias("rows"), F.col("bytes").cast("string").alias("bytes"), "sha256", F.lit("recovered").alias("note"))
    ledger.coalesce(1).write.option("sep", "\t").option("header", True).csv(f"{root}/SUPPLEMENTS")
    table = f"{root}/table"
    jobs.restore_into_table(spark, root, "ticks", days, TICKS_ARCHIVE_SCHEMA, table, "bus_time",
                            supplement_ledger=f"{root}/SUPPLEMENTS", supplement_folder=f"{root}/extra",
                            ledger=read_manifest(spark, f"{root}/MANIFEST", "ticks"))
    back = spark.read.parquet(table).drop("day")
    return settled(arc.day_content_digest(back, "bus_time", _ticks_parts(back)), root)


def q_candle_ingest_upsert(spark, sf):
    """P7 into a table: a cache whose days are written twice; one active version per bar after two runs."""
    ensure_utc(spark)
    cache = f"{shared_dir(spark)}/tidemark-cache2-{uuid.uuid4().hex}"
    bars = _c1m(spark, sf)
    write_candle_csv(bars, f"{cache}/first")
    write_candle_csv(bars, f"{cache}/second")
    src = fx.ticks(spark, sf).groupBy(F.col("instrument").alias("source")).agg(
        F.unix_seconds(F.max("bus_time").cast("timestamp")).alias("last_epoch"))
    empty = spark.createDataFrame([], "exchange string, instrument string, timeframe string, open_at timestamp_ntz, open double, "
                                      "high double, low double, close double, volume double, trades long, "
                                      "known_from timestamp_ntz, known_to timestamp_ntz")
    keys = ["exchange", "instrument"]
    out = jobs.candle_ingest(spark, cache, src, P.LOOKBACK_NOW, keys, current=empty)
    folder = f"{cache}-table"
    out.write.parquet(folder)
    again = jobs.candle_ingest(spark, cache, src, "2024-02-04 12:00:00", keys, current=spark.read.parquet(folder))
    active = F.count_if(F.col("known_to") == F.lit(S.SENTINEL).cast("timestamp_ntz"))
    per = again.groupBy("instrument", "timeframe", "open_at").agg(active.alias("a"), F.count(F.lit(1)).alias("n"))
    return settled(per.groupBy("timeframe").agg(
        F.count(F.lit(1)).alias("n_bars"), F.max("a").alias("max_active"), F.min("a").alias("min_active"),
        F.max("n").alias("max_versions")), cache, folder)


def q_stream_candles(spark, sf):
    """The candle stream with late rows kept aside, over three on-time drops; its merged bars."""
    ensure_utc(spark)
    from tidemark.streaming.candles import read_stream_candles, start_candle_stream

    base = f"{shared_dir(spark)}/tidemark-bars-{uuid.uuid4().hex}"
    t = fx.ticks(spark, sf)
    t.withColumn("_drop", F.floor((F.dayofmonth("bus_time") - 1) / 10)).repartition("_drop").write.partitionBy("_drop") \
        .parquet(f"{base}/spool")
    stream = (spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 100).option("recursiveFileLookup", True)
              .parquet(f"{base}/spool"))
    q = start_candle_stream(stream, "1h", ["instrument"], "bus_time", "price", "id", f"{base}/bars", f"{base}/late",
                            f"{base}/checkpoint", delay_seconds=40 * 86400)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return settled(read_stream_candles(spark, f"{base}/bars", ["instrument"]), base)


# ---------------------------------------------------------------- tables changed in place
class _Crash(Exception):
    """What a query raises in the middle of a job, to go on as after a crash."""


def _crash_at(word: str, nth: int = 1):
    """A step hook that raises at the nth step whose name begins with ``word``."""
    seen = []

    def step(name: str, *_) -> None:
        seen.append(name)
        if name.startswith(word) and sum(s.startswith(word) for s in seen) == nth:
            raise _Crash(name)

    return step


def _crashing(run, *args, **kw) -> None:
    try:
        run(*args, **kw)
    except _Crash:
        return
    raise RuntimeError("the job was to crash and did not")


PURGE_DAYS = [dt.date(2024, 1, d) for d in range(1, 7)]


def q_purge_catalog(spark, sf):
    """P3 on a managed and an external catalog table: a wrong count (3rd) and a file that lands after the check (4th) keep
    their days; the run crashes after the first folder is set aside and is finished by the next one."""
    ensure_utc(spark)
    base = f"{shared_dir(spark)}/tidemark-purge-{uuid.uuid4().hex}"
    db = f"tidemark_{uuid.uuid4().hex}"
    t = fx.ticks(spark, sf).withColumn("day", day_of("bus_time"))
    counts = {r["day"]: r["n"] for r in t.where(F.col("day").isin(PURGE_DAYS)).groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark.sql(f"CREATE DATABASE {db} LOCATION '{base}/managed'")
    out = None
    try:
        t.write.partitionBy("day").saveAsTable(f"{db}.ticks_managed")
        t.write.partitionBy("day").option("path", f"{base}/external").saveAsTable(f"{db}.ticks_external")
        for kind in ("managed", "external"):
            name = f"{db}.ticks_{kind}"
            plan = spark.createDataFrame([(d, "PURGE", counts.get(d, 0) + (d.day == 3)) for d in PURGE_DAYS],
                                         "day date, decision string, ledger_rows long")
            crash = _crash_at("aside")

            def step(word, name=name, crash=crash):
                if word == "intent":  # late rows land on the 4th between the check and the rename
                    late = t.where((F.col("day") == dt.date(2024, 1, 4)) & (F.col("id") % 10 == 0)).drop("day")
                    late.write.mode("append").parquet(f"{jobs.table_location(spark, name)}/day=2024-01-04")
                crash(word)

            _crashing(jobs.apply_purge, spark, plan, None, "bus_time", catalog_table=name, step=step)
            jobs.apply_purge(spark, plan, None, "bus_time", catalog_table=name)
            spark.sql(f"REFRESH TABLE {name}")
            parts = {r["partition"][4:] for r in spark.sql(f"SHOW PARTITIONS {name}").collect()}
            left = spark.table(name).where(F.col("day").isin(PURGE_DAYS)).groupBy("day").agg(F.count(F.lit(1)).alias("rows_left"))
            days = spark.createDataFrame([(kind, d, d.isoformat() not in parts) for d in PURGE_DAYS],
                                         "kind string, day date, dropped boolean")
            one = settled(days.join(left, "day", "left").select("kind", "day", "dropped",
                                                                F.coalesce("rows_left", F.lit(0)).alias("rows_left")))
            out = one if out is None else out.unionByName(one)
    finally:
        spark.sql(f"DROP DATABASE IF EXISTS {db} CASCADE")
    return settled(out, base)


@settling
def q_sweep_apply(spark, sf):
    """P6 on the table itself: the sweep crashes between the two renames of its second partition, the next run carries it
    to its end; what the archive holds and what the table keeps, per day."""
    ensure_utc(spark)
    base = f"{shared_dir(spark)}/tidemark-swept-{uuid.uuid4().hex}"
    v = fx.candle_versions(spark, sf).withColumn("open_at", F.col("open_at").cast("timestamp_ntz"))
    v.withColumn("day", F.to_date("open_at")).write.partitionBy("timeframe", "day").parquet(f"{base}/candles")
    sweep = [spark, f"{base}/candles", P.SWEEP_FROM, P.SWEEP_TO, f"{base}/archive", ["instrument"]]
    _crashing(jobs.sweep_apply, *sweep, step=_crash_at("aside", 2))
    if jobs.sweep_apply(*sweep).count():
        raise RuntimeError("a swept table was swept again")
    active = F.count_if(F.col("known_to") == F.lit(S.SENTINEL).cast("timestamp_ntz")).alias("n_active")
    cents = F.sum(F.round(F.col("close") * 100).cast("long")).alias("cents")
    out = None
    for part, path in (("remaining", "candles"), ("archived", "archive")):
        one = spark.read.parquet(f"{base}/{path}").groupBy(F.lit(part).alias("part"), "day").agg(
            F.count(F.lit(1)).alias("n_rows"), active, cents)
        out = one if out is None else out.unionByName(one)
    return settled(out, base)


def q_ingest_table(spark, sf):
    """P7 into a bucketed table: a second batch that changes the bars of every fifth day (and crashes between two renames)
    and one that repeats it; versions per partition, and whether the second batch changed the partition's files."""
    ensure_utc(spark)
    base = f"{shared_dir(spark)}/tidemark-ingest-{uuid.uuid4().hex}"
    name = f"tidemark_candles_{uuid.uuid4().hex}"
    keys, bar = ["instrument"], ["instrument", "timeframe", "open_at"]
    t = fx.ticks(spark, sf)
    bars = settled(cdl.ticks_to_candles(t, "1m", keys, "bus_time", "price", "id").unionByName(
        cdl.ticks_to_candles(t, "1h", keys, "bus_time", "price", "id")))
    fields = [f for f in bars.schema.fields if f.name != "timeframe"]
    schema = T.StructType([*fields, T.StructField("known_from", T.TimestampNTZType()), T.StructField("known_to", T.TimestampNTZType()),
                           T.StructField("timeframe", T.StringType()), T.StructField("day", T.DateType())])
    changed = bars.withColumn("close", F.when(F.dayofmonth("open_at") % 5 == 0, F.col("close") + 1).otherwise(F.col("close")))
    jobs.create_candle_table(spark, name, f"{base}/candles", schema, keys, 4)
    try:
        jobs.ingest_table(spark, name, bars, P.UPSERT_FIRST, keys)
        before = _listings(spark, f"{base}/candles")
        _crashing(jobs.ingest_table, spark, name, changed, P.UPSERT_AT, keys, step=_crash_at("aside", 2))
        jobs.ingest_table(spark, name, changed, P.UPSERT_AT, keys)
        after = _listings(spark, f"{base}/candles")
        if jobs.ingest_table(spark, name, changed, P.UPSERT_AT, keys).count():
            raise RuntimeError("a repeated batch changed the table")
        rewritten = spark.createDataFrame([(p, before.get(p) != x) for p, x in after.items()], "part string, rewritten boolean")
        sent = F.lit(S.SENTINEL).cast("timestamp_ntz")
        per = spark.table(name).groupBy("timeframe", "day").agg(
            F.count(F.lit(1)).alias("n_versions"), F.count_if(F.col("known_to") == sent).alias("n_active"),
            F.countDistinct(*bar).alias("n_bars"),
            F.sum(F.when(F.col("known_to") == sent, F.round(F.col("close") * 100).cast("long"))).alias("cents"))
        part = F.concat(F.lit("timeframe="), "timeframe", F.lit("/day="), F.col("day").cast("string"))
        return settled(per.withColumn("part", part).join(rewritten, "part").drop("part"), base)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def _listings(spark, table) -> dict[str, str]:
    """Listing digest of every (timeframe, day) partition of a table."""
    from tidemark.sources.swap import fs_of, listing_of

    fs, root = fs_of(spark, table)
    parts = [f"{a.getPath().getName()}/{b.getPath().getName()}" for a in fs.listStatus(root)
             if a.getPath().getName().startswith("timeframe=") for b in fs.listStatus(a.getPath())]
    return {p: listing_of(spark, f"{table}/{p}") for p in parts}


def q_restore_resumed(spark, sf):
    """P8 staged: of five days one has rows, one an empty leaf and three none; the restore crashes between two days and the
    next run goes on: the table's digest per day, as if nothing had happened."""
    ensure_utc(spark)
    root = f"{shared_dir(spark)}/tidemark-resumed-{uuid.uuid4().hex}"
    t = fx.ticks(spark, sf).select(*TICKS_ARCHIVE_SCHEMA.names)
    days = [dt.date(2024, 1, d) for d in range(1, 6)]
    leaf = spark.createDataFrame([("ticks", d) for d in days], "table_name string, day date")
    jobs.export_days(spark, t, "ticks", "bus_time", ["id"], days, leaf, None, root, TICKS_ARCHIVE_SCHEMA, fmt="csv.zst")
    table = f"{root}/table"
    t.where(day_of("bus_time") == days[0]).withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(table)
    jobs.ensure_leaves(spark, table, days[1], days[1])
    restore = [spark, root, "ticks", days, TICKS_ARCHIVE_SCHEMA, table, "bus_time"]
    _crashing(jobs.restore_into_table, *restore, step=_crash_at("put", 2))
    if jobs.restore_into_table(*restore).count():  # the journal was carried out first: every day has its rows
        raise RuntimeError("a restored day was restored again")
    back = spark.read.parquet(table).drop("day")
    return settled(arc.day_content_digest(back, "bus_time", _ticks_parts(back)), root)


# ---------------------------------------------------------------- streams with late rows
def _arrivals(spark, sf):
    """Ticks with the drop they arrive in: a third of the month each; every 40th one drop later."""
    t = fx.ticks(spark, sf)
    third = F.least(F.floor((F.dayofmonth("bus_time") - 1) / 10), F.lit(2))
    return t.withColumn("_drop", (third + F.when(F.col("id") % 40 == 0, 1).otherwise(0)).cast("int"))


def _ended(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return query


def q_stream_late_bars(spark, sf):
    """L5 with event-time state: four drops of which three carry rows of the drop before; the bars that the watermark has
    closed, and every late row."""
    ensure_utc(spark)
    from tidemark.streaming import candles as live

    base = f"{shared_dir(spark)}/tidemark-live-{uuid.uuid4().hex}"
    t = _arrivals(spark, sf)
    schema = t.drop("_drop").schema
    for drop in range(4):  # each drop is one micro-batch of either query, whatever its number of files
        t.where(F.col("_drop") == drop).drop("_drop").write.mode("append").parquet(f"{base}/spool")
        raw = spark.readStream.schema(schema).parquet(f"{base}/spool")
        _ended(live.start_on_time_split(raw, "bus_time", f"{base}/ontime", f"{base}/late", f"{base}/split"))
        on_time = spark.readStream.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(
            f"{base}/ontime")
        q = _ended(live.start_closed_bars(on_time, "1h", ["instrument"], "bus_time", "price", "id", f"{base}/bars", f"{base}/state"))
        if live.rows_dropped(q):
            raise RuntimeError("the watermark dropped rows that the split let through")
    bars = spark.read.parquet(f"{base}/bars").select(F.lit("bar").alias("kind"), "instrument", F.col("open_at").alias("at"), "open",
                                                     "high", "low", "close", "trades")
    price = F.col("price")
    late = spark.read.parquet(f"{base}/late").select(
        F.lit("late").alias("kind"), "instrument", F.col("bus_time").alias("at"), price.alias("open"), price.alias("high"),
        price.alias("low"), price.alias("close"), F.lit(1).cast("long").alias("trades"))
    return settled(bars.unionByName(late), base)


SEAL_AFTER = {0: range(1, 4), 1: range(9, 14), 2: range(19, 25)}  # days of month sealed after each drop


@settling
def q_stream_sealed_days(spark, sf):
    """L1 with L4: the ledger seals days between the drops; one batch crashes after its first sink, the ledger grows, and
    its replay decides as before.  Where every tick went."""
    ensure_utc(spark)
    from tidemark.sources.ledger import append_manifest
    from tidemark.streaming.routing import start_sealed_routing

    base = f"{shared_dir(spark)}/tidemark-sealed-{uuid.uuid4().hex}"
    t = _arrivals(spark, sf)
    counts = fx.pinned(fx.counts(spark, sf))
    for r in fx.leaf(spark, sf, counts).collect():  # calendar sized
        jobs.ensure_leaves(spark, f"{base}/table", r["day"], r["day"])
    schema = t.drop("_drop").schema

    def seal(days):
        lines = counts.where(F.dayofmonth("day").isin(list(days))).select(
            F.concat(F.lit("ticks-"), F.col("day").cast("string"), F.lit(".csv.zst")).alias("file"),
            F.col("day").cast("string").alias("day"), F.col("lo").cast("string").alias("bound_lower"),
            F.col("hi").cast("string").alias("bound_upper"), F.col("n").cast("string").alias("rows"), F.lit("1").alias("bytes"),
            F.repeat(F.lit("a"), 64).alias("sha256"), F.lit("2024-02-01T00:00:00Z").alias("exported_at"))
        append_manifest(lines, f"{base}/MANIFEST")

    def route(step=lambda *_: None):
        raw = spark.readStream.schema(schema).parquet(f"{base}/spool")
        return start_sealed_routing(raw, "bus_time", "ticks", f"{base}/table", f"{base}/MANIFEST", f"{base}/out",
                                    f"{base}/checkpoint", step=step)

    for drop in range(4):
        t.where(F.col("_drop") == drop).drop("_drop").write.mode("append").parquet(f"{base}/spool")
        if drop == 1:
            q = route(_crash_at("leaf"))
            try:
                q.awaitTermination()
            except Exception:  # the crash of the batch, as the query reports it
                pass
            if q.exception() is None:
                raise RuntimeError("the batch was to crash and did not")
            seal(SEAL_AFTER[1])  # the day lists of the crashed batch are older than this
        _ended(route())
        if drop != 1 and drop in SEAL_AFTER:
            seal(SEAL_AFTER[drop])
    out = None
    for target in ("leaf", "default", "sealed"):
        one = spark.read.schema("id long, day date, batch_id long").parquet(f"{base}/out/{target}").select(
            "id", "day", F.lit(target).alias("target"), F.col("batch_id").alias("batch"))
        out = one if out is None else out.unionByName(one)
    return settled(out, base)


# ---------------------------------------------------------------- days from words, footers and file order
def q_session_day_words(spark, sf):
    """J1 and W3 from bit words: an index of two increments, each from its own days only; gaps and runs of every session."""
    ensure_utc(spark)
    from tidemark.operators import daybits

    path = f"{shared_dir(spark)}/tidemark-words-{uuid.uuid4().hex}"
    tr = fx.trades(spark, sf)
    for rows in (tr.where(F.col("bus_time") < "2024-01-16"), tr.where(F.col("bus_time") >= "2024-01-16")):
        daybits.add_increment(daybits.day_words(rows, ["session_id"], "bus_time"), path)
    words = daybits.read_words(spark, path, ["session_id"])
    gaps = daybits.missing_days(words, "2024-01-01", "2024-01-30", ["session_id"]).select(
        F.lit("missing").alias("kind"), "session_id", F.col("day").alias("first_day"), F.col("day").alias("last_day"),
        F.lit(1).cast("long").alias("n_days"))
    islands = daybits.runs(words, ["session_id"]).select(F.lit("run").alias("kind"), "session_id", "run_start", "run_end", "n_days")
    return settled(gaps.union(islands), path)


def q_footer_day_stats(spark, sf):
    """A1, A2, A4 from Parquet footers: rows and id bounds of each day of a day-partitioned table, and whether it has a leaf."""
    ensure_utc(spark)
    path = f"{shared_dir(spark)}/tidemark-footers-{uuid.uuid4().hex}"
    fx.ticks(spark, sf).withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(path)
    stats = slices.footer_stats(spark, path, "id")
    leaf = fx.leaf(spark, sf).select("day", F.lit(True).alias("has_leaf"))
    return settled(stats.join(leaf, "day", "left").select("day", "n_rows", "id_lower", "id_upper",
                                                          F.coalesce("has_leaf", F.lit(False)).alias("has_leaf")), path)


def q_trades_order(spark, sf):
    """O2 over many parts: trades in (executed_at, id) order, parts of 50 rows; then with the first two parts of every
    seventh day of a month swapped, which no digest of rows would tell."""
    ensure_utc(spark)
    from tidemark.sources.swap import fs_of

    root = f"{shared_dir(spark)}/tidemark-order-{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("executed_at", T.TimestampNTZType()),
                           T.StructField("price", T.DoubleType())])
    tr = fx.trades(spark, sf).select("id", "executed_at", "price")
    arc.write_day_archive(tr, root, "executed_at", ["executed_at", "id"], whole_days=True, max_rows=50, compression="none")
    out = None
    for kind in ("written", "swapped"):
        if kind == "swapped":
            fs, p = fs_of(spark, root)
            for st in fs.listStatus(p):  # one entry a day
                name = st.getPath().getName()
                if name.startswith("day=") and int(name[-2:]) % 7 == 0:
                    parts = sorted((x.getPath() for x in fs.listStatus(st.getPath()) if x.getPath().getName().startswith("part-")),
                                   key=lambda x: x.getName())
                    if len(parts) > 1:
                        aside = st.getPath().suffix("/_aside")
                        for a, b in ((parts[0], aside), (parts[1], parts[0]), (aside, parts[1])):
                            fs.rename(a, b)
        one = settled(arc.day_order(arc.read_archive(spark, root, schema), ["executed_at", "id"]).select(
            F.lit(kind).alias("kind"), "*"))
        out = one if out is None else out.unionByName(one)
    return settled(out, root)


QUERIES = {
    "day_counts": q_day_counts,
    "day_slice": q_day_slice,
    "id_bounds": q_id_bounds,
    "oldest_day": q_oldest_day,
    "missing_days": q_missing_days,
    "missing_days_unarchived": q_missing_days_unarchived,
    "forward_headroom": q_forward_headroom,
    "contiguous_runs": q_contiguous_runs,
    "cover_anchors": q_cover_anchors,
    "leaf_catalog": q_leaf_catalog,
    "session_missing_days": q_session_missing_days,
    "session_runs": q_session_runs,
    "session_anchors": q_session_anchors,
    "read_days": q_read_days,
    "read_trades": q_read_trades,
    "reconcile_counts": q_reconcile_counts,
    "ledger_health": q_ledger_health,
    "manifest_valid": q_manifest_valid,
    "skip_done_days": q_skip_done_days,
    "last_ledger_line": q_last_ledger_line,
    "resolve_purge_target": q_resolve_purge_target,
    "verify_archive": q_verify_archive,
    "purge_plan": q_purge_plan,
    "purge_plan_trades": q_purge_plan_trades,
    "staleness": q_staleness,
    "ledger_totals": q_ledger_totals,
    "route_rows": q_route_rows,
    "default_rows": q_default_rows,
    "stream_route_default": q_stream_route_default,
    "late_arrivals": q_late_arrivals,
    "sealed_day_late_rows": q_sealed_day_late_rows,
    "monotonicity_violations": q_monotonicity_violations,
    "ticks_to_candles": q_ticks_to_candles,
    "synthesize_candles": q_synthesize_candles,
    "close_versions": q_close_versions,
    "closed_versions": q_closed_versions,
    "candle_upsert": q_candle_upsert,
    "lookback_since": q_lookback_since,
    "day_content_digest": q_day_content_digest,
    "export_restore_roundtrip": q_export_restore_roundtrip,
    "export_ledger": q_export_ledger,
    "reconcile_export": q_reconcile_export,
    "purge_plan_export": q_purge_plan_export,
    "archive_inventory": q_archive_inventory,
    "restore_days": q_restore_days,
    "segment_runs": q_segment_runs,
    "problem_count": q_problem_count,
    "run_tail": q_run_tail,
    "alert_body": q_alert_body,
    "failure_streaks": q_failure_streaks,
    "backfill_summary": q_backfill_summary,
    "partition_coverage": q_partition_coverage,
    "retention_plan": q_retention_plan,
    "candle_sweep": q_candle_sweep,
    "candle_ingest": q_candle_ingest,
    "candle_ingest_upsert": q_candle_ingest_upsert,
    "export_strings_roundtrip": q_export_strings_roundtrip,
    "sweep_remainder": q_sweep_remainder,
    "retention_run": q_retention_run,
    "archive_bytes": q_archive_bytes,
    "ledger_from_text": q_ledger_from_text,
    "run_logs_text": q_run_logs_text,
    "restore_job": q_restore_job,
    "stream_candles": q_stream_candles,
    "purge_catalog": q_purge_catalog,
    "sweep_apply": q_sweep_apply,
    "ingest_table": q_ingest_table,
    "restore_resumed": q_restore_resumed,
    "stream_late_bars": q_stream_late_bars,
    "stream_sealed_days": q_stream_sealed_days,
    "session_day_words": q_session_day_words,
    "footer_day_stats": q_footer_day_stats,
    "trades_order": q_trades_order,
}
