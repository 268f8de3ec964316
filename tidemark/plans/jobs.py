"""Composite jobs P1..P9 and the coverage report A15.

Each job is one Spark plan over all requested days (or tables) at once; the
driver only handles day lists and file-system metadata (publish renames,
partition drops), never rows.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas as S
from tidemark.functions.exprs import day_of, sentinel_for
from tidemark.operators import calendar as cal
from tidemark.operators import candles as cdl
from tidemark.operators import late, runlog, slices
from tidemark.operators.verify import line_checks, resolve_purge_target, verify_archive
from tidemark.sources import archive as arc
from tidemark.session import listed_bytes, partitions_for, settled
from tidemark.sources.candle_csv import load_candle_csv
from tidemark.sources.ledger import append_manifest
from tidemark.sources.swap import NO_FILES, Swap, folder_listing, fs_of, listing_of, partition_spec, recover


# ---------------------------------------------------------------- P3 purge
def purge_plan(days: DataFrame, ledger: DataFrame, inventory: DataFrame, children: DataFrame,
               table_counts: DataFrame, armed: bool = True, armed_required: Sequence[str] = ("trades",),
               suffix: str = ".csv.zst", listing: DataFrame | None = None) -> DataFrame:
    """One decision and reason per requested (table, day).

    Order of checks, first hit wins: no ledger line, malformed line (any
    line of the day with a field count other than eight), duplicate lines,
    invalid field, archive file missing, sha mismatch, size mismatch, purge
    not armed (tables in ``armed_required``), no single exact partition,
    partition rows differ from the ledger.  Otherwise PURGE.  ``listing``
    (day, listing) records the table files each day was verified against;
    ``apply_purge`` drops a day only if that listing is unchanged.
    """
    req = days.select("table_name", "day", F.date_format("day", "yyyy-MM-dd").alias("day_text"))
    if suffix != ".csv.zst":  # archives written here are gzip folders; the name rule is the same
        ledger = ledger.withColumn("file", F.regexp_replace("file", suffix.replace(".", r"\.") + "$", ".csv.zst"))
        inventory = inventory.withColumn("file", F.regexp_replace("file", suffix.replace(".", r"\.") + "$",
                                                                  ".csv.zst"))
    checked = line_checks(ledger, "kind")
    per_day = (
        checked.groupBy("table_name", F.col("day").alias("day_text"))
        .agg(F.count(F.lit(1)).alias("n_lines"),
             F.count_if(F.col("nf") != S.LEDGER_FIELD_COUNT).alias("n_malformed"),
             F.max_by(F.struct("file", "rows", "bytes", "sha256", "fields_ok"), F.col("line_no")).alias("_l"))
        .select("table_name", "day_text", "n_lines", "n_malformed", "_l.*")
    )
    lines = req.join(per_day, ["table_name", "day_text"], "left")
    verified = verify_archive(lines, inventory)
    target = resolve_purge_target(req.select("table_name", "day"), children)
    cnt = table_counts.select("table_name", "day", F.col("n_rows").alias("table_rows"))
    j = verified.join(target, ["table_name", "day"], "left").join(cnt, ["table_name", "day"], "left")
    ledger_rows = F.col("rows").try_cast("long")
    table_rows = F.coalesce(F.col("table_rows"), F.lit(0)).cast("long")
    not_armed = F.col("table_name").isin(*armed_required) & F.lit(not armed)
    reason = (
        F.when(F.coalesce(F.col("n_lines"), F.lit(0)) == 0, F.lit(S.REASON_NO_LINE))
        .when(F.col("n_malformed") > 0, F.lit(S.REASON_MALFORMED))
        .when(F.col("n_lines") > 1, F.lit(S.REASON_DUPLICATE))
        .when(~F.col("fields_ok"), F.lit(S.REASON_FIELD_INVALID))
        .when(F.col("archive_verdict") != "ok", F.col("archive_verdict"))
        .when(not_armed, F.lit(S.REASON_NOT_ARMED))
        .when(F.col("target") == "REFUSE", F.lit(S.REASON_AMBIGUOUS))
        .when(F.col("target") != "PARTITION", F.lit(S.REASON_NO_LEAF))
        .when(~ledger_rows.eqNullSafe(table_rows), F.lit(S.REASON_ROWS))
        .otherwise(F.lit(S.REASON_OK))
    )
    out = j.select(
        "table_name", "day",
        F.when(reason == S.REASON_OK, F.lit("PURGE")).otherwise(F.lit("REFUSE")).alias("decision"),
        reason.alias("reason"), "target", "leaf_name", ledger_rows.alias("ledger_rows"),
        table_rows.alias("table_rows"))
    if listing is not None:
        out = out.join(listing.select("day", "listing"), "day", "left")
    return out


def _write_header_only(fs, folder, schema: T.StructType, fmt: str = "csv.gz") -> None:
    """A compressed CSV holding just the header: an empty day's archive (bounds (0, 1), zero rows)."""
    import gzip

    import pyarrow as pa

    fs.mkdirs(folder)
    header = (",".join(f.name for f in schema.fields) + "\n").encode()
    data = pa.compress(header, "zstd", asbytes=True) if fmt == "csv.zst" else gzip.compress(header, mtime=0)
    out = fs.create(folder.suffix(f"/part-00000-empty.{fmt}"), False)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def table_day_listing(spark: SparkSession, table_path: str, days: Sequence) -> DataFrame:
    """Per existing day folder of a table: file count and a digest of (name, size) of its files -- listing only.

    A folder without files has a listing too: that of no files.
    """
    rows = []
    for d in days:  # one metadata listing a day; a run handles a few days
        fs, p = fs_of(spark, arc.day_folders(table_path, [d])[0])
        if fs.exists(p):
            rows.append((d, *folder_listing(fs, p)))
    return spark.createDataFrame(rows, "day date, n_files long, listing string")


def apply_purge(spark: SparkSession, plan: DataFrame, table_path: str | None, time_col: str,
                catalog_table: str | None = None, step=lambda _: None) -> list[str]:
    """Drop the ``day=`` folder of every PURGE day whose live row count still equals the plan (P3 apply).

    The files are listed, then the rows counted in one pruned aggregate (a
    day without files has none); a day that changed since the plan is left
    alone (late rows are L4's business).  The days that pass are removed by
    one journaled run (``sources.swap``): a folder is renamed aside, out of
    writers' and readers' sight, and listed again; only if it holds exactly
    the files that were counted does its partition leave the catalog
    (``catalog_table``) and then the disk, else it is put back and nothing of
    the catalog has changed.  What a crashed run has begun is finished first.
    ``table_path`` is taken from the catalog if it is not given; a partition
    that lies elsewhere than in its table's folder is left alone.
    Returns the dropped days.  Only metadata (the day list) reaches the driver.
    """
    purge = plan.where(F.col("decision") == "PURGE")
    seen = F.col("listing") if "listing" in plan.columns else F.lit(None).cast("string")
    planned = {r["day"]: (r["ledger_rows"], r["listing"]) for r in purge.select(
        "day", "ledger_rows", seen.alias("listing")).distinct().collect()}  # calendar sized
    table_path = table_path or table_location(spark, catalog_table)
    recover(spark, table_path)
    if not planned:
        return []
    days = sorted(planned)
    now = {r["day"]: r["listing"] for r in table_day_listing(spark, table_path, days).collect()}
    # only the purge days' partitions are listed and counted (partition pruning)
    source = _day_table(spark, table_path, days)
    live = {} if source is None else {r["day"]: r["n"] for r in source.where(F.col("day").isin(days)).groupBy("day").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    go = []
    for d in days:
        rows, listing = planned[d]
        if live.get(d, 0) != rows or d not in now or (listing is not None and listing != now[d]):
            continue
        if not catalog_table or _partition_in_place(spark, catalog_table, d, table_path):
            go.append(d)
    if not go:
        return []
    swap = Swap(spark, table_path, catalog=catalog_table, step=step)
    swap.declare([("remove", f"day={d.isoformat()}", now[d], None) for d in go])
    dropped = swap.apply()
    if catalog_table:
        spark.sql(f"REFRESH TABLE {catalog_table}")
    return [p[len("day="):] for p in dropped]


def table_location(spark: SparkSession, catalog_table: str) -> str:
    """Where a catalog table's files are."""
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {catalog_table}").where("col_name = 'Location'").collect()
    return rows[0]["data_type"].rstrip("/")


def _partition_in_place(spark: SparkSession, catalog_table: str, day: dt.date, table_path: str) -> bool:
    """Does the catalog have the day's partition in the table's own folder?"""
    try:
        rows = spark.sql(f"DESCRIBE TABLE EXTENDED {catalog_table} PARTITION (day = '{day.isoformat()}')").collect()
    except AnalysisException:  # no such partition
        return False
    said = next((r["data_type"] for r in rows if r["col_name"] == "Location"), "").rstrip("/")
    return not said or arc.qualified(spark, said) == arc.qualified(spark, f"{table_path.rstrip('/')}/day={day.isoformat()}")


def _day_table(spark: SparkSession, table_path: str, days: Sequence[dt.date]) -> DataFrame | None:
    """The given days of a ``day=`` partitioned Parquet table; None if none of them has a file."""
    folders = []
    for f in arc.day_folders(table_path, days):
        fs, p = fs_of(spark, f)
        if fs.exists(p) and folder_listing(fs, p)[0]:
            folders.append(f)
    return spark.read.option("basePath", table_path).parquet(*folders) if folders else None


def _drop_folder(spark: SparkSession, folder: str, listing: str) -> bool:
    """Delete a partition folder if, renamed aside, it still holds exactly the listed files; else put it back."""
    table, _, part = folder.rstrip("/").rpartition("/")
    if listing_of(spark, folder) is None:
        return False
    swap = Swap(spark, table)
    swap.declare([("remove", part, listing, None)])
    return swap.apply() == [part]


# ---------------------------------------------------------------- P1 export
LEDGER_LINE_DDL = ("table_name string, file string, day string, bound_lower string, bound_upper string, rows string, "
                   "bytes string, sha256 string, exported_at string, nf int, line_no long, kind string")


def _rows_of_days(df: DataFrame, time_col: str, days: Sequence[dt.date], day_col: str | None = None) -> DataFrame:
    """Rows of exactly these UTC days.

    The covering time range reaches the scan; with a ``day`` partition
    column the day list itself becomes a partition filter, so only those
    days' files are listed and read.  The day list is calendar sized, so
    gaps in the range are trimmed by an IN filter, not by a join.
    """
    lo, hi = min(days), max(days) + dt.timedelta(days=1)
    rows = slices.day_slice(df, time_col, lo, hi, day_col)
    if day_col:
        rows = rows.where(F.col(day_col).isin(list(days)))
    return rows.where(day_of(time_col).isin(list(days)))


def plan_guard(df: DataFrame) -> None:
    """Refuse to run a day export whose scan is not pruned to the requested days.

    The re-aimed form of refusing a bad plan: a full scan of a production
    table to export one day is an outage, not a slow job.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [ln for ln in plan.splitlines() if "FileScan" in ln or "BatchScan" in ln]
    # every scan must name its partition filters; a source that prints none (some v2 sources) is refused as well
    if not scans or not all("PartitionFilters: [" in ln and "PartitionFilters: []" not in ln for ln in scans):
        raise RuntimeError("REFUSE: the export scan is not pruned by day (no PartitionFilters)")


def export_days(spark: SparkSession, df: DataFrame, table: str, time_col: str, order_cols: Sequence[str],
                days: Sequence[dt.date], leaf: DataFrame, ledger: DataFrame | None, root: str,
                schema: T.StructType, ledger_path: str | None = None, n_parts: int | None = None,
                exported_at: str | None = None, id_col: str | None = "id", adopt: bool = False,
                fmt: str = "csv.gz", day_col: str | None = None) -> DataFrame:
    """Export whole UTC days to sorted CSV folders and return their ledger lines.

    ``fmt`` is ``csv.gz`` (Spark's writer) or ``csv.zst`` (the reference's
    archive format, streamed by pyarrow inside the tasks); ledger file names
    are ``<table>-<day>.<fmt>``.  For a ``day``-partitioned source pass
    ``day_col``: the scan is then pruned to the requested days, and the job
    refuses to run if the physical plan shows it is not.

    Refuses days without a leaf and days already in the ledger.  All other
    days are written by ONE range-partitioned job into a staging folder,
    re-read strictly, and every day's row count and content digest must equal
    those of the rows that went to the writer (``OBSERVED_DAYS``) or of the
    table before it is published by rename and appended to the ledger.
    A crash before publish leaves only staging.  A crash after publish but
    before the ledger append leaves a published day without a line: it is
    refused on re-run, or with ``adopt=True`` re-read strictly and adopted
    (its line written) when its count and digest equal the table's.
    """
    root = root.rstrip("/")
    req = spark.createDataFrame([(d,) for d in days], "day date")
    has_leaf = leaf.where(F.col("table_name") == table).select("day").distinct()
    todo = req.join(has_leaf, "day", "left_semi")
    if ledger is not None:
        todo = todo.join(cal.ledger_days(ledger.where(F.col("table_name") == table)), "day", "left_anti")
    todo_days = sorted(r["day"] for r in todo.collect())  # calendar sized
    fresh, published = [], []
    for d in todo_days:
        fs, p = fs_of(spark, f"{root}/{table}/day={d.isoformat()}")
        (published if fs.exists(p) else fresh).append(d)
    candidates = sorted(fresh + (published if adopt else []))
    if not candidates:
        return spark.createDataFrame([], LEDGER_LINE_DDL)
    # few days: counts, bounds and digests are observed on the write itself; many, or an adoption: one pruned aggregate
    watched = len(fresh) <= OBSERVED_DAYS and {time_col, id_col or time_col} <= set(schema.names)
    asked = (published if adopt else []) if watched else candidates
    stats = _day_stats(df, time_col, asked, day_col, id_col, schema) if asked else {}
    adopted = _adoptable(spark, schema, root, table, published, time_col, stats) if adopt and published else []
    if fresh:
        fresh_rows = _rows_of_days(df, time_col, fresh, day_col)
        if day_col:
            plan_guard(fresh_rows)
        stats |= _write_and_publish(spark, fresh_rows, table, time_col, order_cols, fresh, root, schema, n_parts, fmt,
                                    None if watched else {d: stats[d] for d in fresh if d in stats}, id_col)
    done = sorted(fresh + adopted)
    if not done:
        return spark.createDataFrame([], LEDGER_LINE_DDL)
    # hash only the folders written (or adopted) now, never the whole archive
    inv = arc.day_inventory(arc.archive_inventory(spark, arc.day_folders(f"{root}/{table}", done)))
    stamp = exported_at or dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    per_day = []
    for d in done:
        n, lo, hi = stats[d][:3] if d in stats else (0, None, None)
        if id_col:  # empty day -> (0, 1)
            bl, bu = str(lo if lo is not None else 0), str((hi if hi is not None else 0) + 1)
        else:
            bl, bu = f"{d.isoformat()}T00:00:00Z", f"{(d + dt.timedelta(days=1)).isoformat()}T00:00:00Z"
        per_day.append((d, bl, bu, int(n)))
    b = spark.createDataFrame(per_day, "day date, bound_lower string, bound_upper string, n_rows long")
    lines = (
        b.join(inv, "day", "left")
        .select(F.lit(table).alias("table_name"),
                F.concat(F.lit(table + "-"), F.col("day").cast("string"), F.lit("." + fmt)).alias("file"),
                F.col("day").cast("string").alias("day"), "bound_lower", "bound_upper",
                F.col("n_rows").cast("string").alias("rows"),
                F.coalesce(F.col("bytes"), F.lit(0)).cast("string").alias("bytes"),
                F.coalesce(F.col("sha256"), F.sha2(F.lit(""), 256)).alias("sha256"),
                F.lit(stamp).alias("exported_at"), F.lit(8).alias("nf"),
                F.lit(None).cast("long").alias("line_no"), F.lit(table).alias("kind"))
    )
    # one line per day: materialize once, so the ledger gets exactly the lines returned (files hashed once)
    lines = spark.createDataFrame(lines.collect(), LEDGER_LINE_DDL)
    if ledger_path:
        append_manifest(lines, ledger_path)
    return lines


OBSERVED_DAYS = 8  # up to so many days' metrics hang on one write; the results are the same either way


def _day_metrics(days: Sequence[dt.date], time_col: str, id_col: str | None, schema: T.StructType) -> list:
    """Aggregates over all rows of a write, one set a day: rows, exact sum of row hashes, id bounds."""
    day = day_of(time_col)
    out = []
    for i, d in enumerate(days):
        here = day == F.lit(d)
        out += [F.count_if(here).alias(f"n{i}"),
                F.sum(F.when(here, arc.row_hash(schema).cast("decimal(38,0)"))).cast("string").alias(f"digest{i}")]
        if id_col:
            out += [F.min(F.when(here, F.col(id_col))).alias(f"lo{i}"), F.max(F.when(here, F.col(id_col))).alias(f"hi{i}")]
    return out


def _day_stats(df: DataFrame, time_col: str, days: Sequence[dt.date], day_col: str | None,
               id_col: str | None, schema: T.StructType) -> dict:
    """{day: (rows, min id, max id, content digest)} for the given days: one pruned, partially aggregated pass."""
    aggs = [F.count(F.lit(1)).alias("n"), arc.content_digest(schema).alias("digest")]
    if id_col:
        aggs += [F.min(id_col).alias("lo"), F.max(id_col).alias("hi")]
    rows = _typed(_rows_of_days(df, time_col, days, day_col), schema, id_col, time_col)
    return {r["day"]: (r["n"], r["lo"] if id_col else None, r["hi"] if id_col else None, r["digest"])
            for r in rows.groupBy(day_of(time_col).alias("day")).agg(*aggs).collect()}


def _typed(rows: DataFrame, schema: T.StructType, *more: str | None) -> DataFrame:
    """The archive's columns in the archive's types (and ``more`` columns that it may lack)."""
    extra = [F.col(c) for c in dict.fromkeys(more) if c and c not in schema.names]
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields], *extra)


def _archived_content(archive: DataFrame, time_col: str, schema: T.StructType) -> dict:
    """{day folder: (rows, content digest)} of re-read archive rows; a row of another day voids its folder's digest."""
    rows = archive.groupBy("day").agg(F.count(F.lit(1)).alias("n"), arc.content_digest(schema).alias("digest"),
                                      F.count_if(~F.col("day").eqNullSafe(day_of(time_col))).alias("strays"))
    return {r["day"]: (r["n"], r["digest"] if not r["strays"] else None) for r in rows.collect()}


def _write_and_publish(spark, rows, table, time_col, order_cols, days, root, schema, n_parts, fmt="csv.gz",
                       stats: dict | None = None, id_col: str | None = None) -> dict:
    """Write the days to a fresh staging folder, prove the content, then publish each day by rename; their statistics.

    Without ``stats`` the rows, bounds and digests are observed on the sorted rows that go to the writer, so the table
    is read for the ranges and for the write, and the archive once for the proof: no pass for statistics alone.
    """
    staging = f"{root}/_staging/{uuid.uuid4().hex}/{table}"
    kind = {"fmt": "csv.zst"} if fmt == "csv.zst" else {}
    if stats is None:
        watch = Observation()
        metrics = _day_metrics(days, time_col, id_col, schema)
        arc.write_day_archive(_typed(rows, schema), staging, time_col, order_cols, n_parts, input_bytes=listed_bytes(rows),
                              observe=lambda ordered: ordered.observe(watch, *metrics), **kind)
        m = watch.get
        stats = {d: (m[f"n{i}"], m.get(f"lo{i}"), m.get(f"hi{i}"), m[f"digest{i}"]) for i, d in enumerate(days) if m[f"n{i}"]}
    else:
        size = sum(x[0] for x in stats.values()) * 16 * len(schema.fields)  # the days' own rows, 16 bytes a field
        arc.write_day_archive(_typed(rows, schema), staging, time_col, order_cols, n_parts, input_bytes=size, **kind)
    fs_st, st_path = fs_of(spark, staging)
    got = {}  # stays empty if every requested day was: nothing was written
    if fs_st.exists(st_path) and any(st.getPath().getName().startswith("day=") for st in fs_st.listStatus(st_path)):
        got = _archived_content(arc.read_archive(spark, staging, schema), time_col, schema)
    want = {d: (x[0], x[3]) for d, x in stats.items()}
    if bad := [d for d in set(got) | set(want) if got.get(d) != want.get(d)]:
        rows_differ = any(got.get(d, (0,))[0] != want.get(d, (0,))[0] for d in bad)
        raise RuntimeError(f"FILE {'ROWCOUNT' if rows_differ else 'CONTENT'} MISMATCH on {len(bad)} day(s); nothing published")
    for d in days:
        fs, src = fs_of(spark, f"{staging}/day={d.isoformat()}")
        _, dst = fs_of(spark, f"{root}/{table}/day={d.isoformat()}")
        if fs.exists(src):  # temp files of failed task attempts are never published
            for st in fs.listStatus(src):
                if st.getPath().getName().startswith("_tmp-"):
                    fs.delete(st.getPath(), False)
        fs.mkdirs(dst.getParent())
        if fs.exists(dst):  # published meanwhile by another run; some stores would nest a rename into it
            raise RuntimeError(f"REFUSE {d}: archive already exists at {dst} (concurrent export?)")
        if fs.exists(src):
            if not fs.rename(src, dst):
                raise RuntimeError(f"publish failed for {d}")
        else:
            _write_header_only(fs, dst, schema, fmt)  # an empty day with a leaf exports as a header-only file
    fs_run, run_dir = fs_of(spark, staging.rsplit("/", 1)[0])
    if fs_run.exists(run_dir):
        fs_run.delete(run_dir, True)  # everything was published; only this run's leftovers remain
    return stats


def _adoptable(spark, schema, root, table, days, time_col, stats: dict) -> list[dt.date]:
    """Published days without a ledger line whose strict re-read has the table's rows: same count, same digest."""
    folders = arc.day_folders(f"{root}/{table}", days)
    back = _archived_content(arc.read_archive(spark, folders, schema, base=f"{root}/{table}"), time_col, schema)
    return sorted(d for d in days if back.get(d) == ((stats[d][0], stats[d][3]) if d in stats else None))


# ---------------------------------------------------------------- P2 backfill
def backfill_outcomes(days: DataFrame, ledger: DataFrame, leaf: DataFrame, table: str,
                      day_bytes: DataFrame | None = None) -> DataFrame:
    """Outcome per calendar day of a backfill, oldest first, stopping at the first failure.

    done days are ``skip``; a todo day without a leaf fails (export refuses
    it); days after the first failure are ``not_attempted``.
    """
    led = cal.ledger_days(ledger.where(F.col("table_name") == table)).withColumn("_done", F.lit(True))
    lv = leaf.where(F.col("table_name") == table).select("day", F.lit(True).alias("_leaf")).distinct()
    j = days.select("day").join(led.select("day", "_done"), "day", "left").join(lv, "day", "left")
    fail_now = F.col("_done").isNull() & F.col("_leaf").isNull()
    # first failing day per table: the day list is calendar sized, one row per day
    j = j.withColumn("_first_fail", F.min(F.when(fail_now, F.col("day"))).over(Window.partitionBy(F.lit(table))))
    outcome = (
        F.when(F.col("_first_fail").isNotNull() & (F.col("day") > F.col("_first_fail")), F.lit("not_attempted"))
        .when(F.col("_done").isNotNull(), F.lit("skip"))
        .when(fail_now, F.lit("fail"))
        .otherwise(F.lit("ok"))
    )
    out = j.select(F.lit(table).alias("table_name"), "day", outcome.alias("outcome"))
    if day_bytes is not None:
        out = out.join(day_bytes.select("day", "bytes"), "day", "left")
    else:
        out = out.withColumn("bytes", F.lit(0).cast("long"))
    return out


def backfill(spark: SparkSession, df: DataFrame, table: str, time_col: str, order_cols: Sequence[str],
             lo: dt.date, hi: dt.date, leaf: DataFrame, ledger: DataFrame, root: str, schema: T.StructType,
             ledger_path: str | None = None, id_col: str | None = "id",
             exported_at: str | None = None, day_col: str | None = None,
             fmt: str = "csv.gz") -> tuple[DataFrame, DataFrame]:
    """Export every day of [lo, hi] not yet in the ledger, in ONE export job.

    Outcomes follow the day-by-day driver: ledger days are ``skip``, the
    first day without a leaf ``fail``s and later days are
    ``not_attempted``; the days before it are exported together.  A planned
    day that the export refused (already published) also reports ``fail``.
    Returns (outcomes with bytes, summary).
    """
    days = spark.range(1).select(cal.day_sequence(lo, hi).alias("day"))
    planned = backfill_outcomes(days, ledger, leaf, table).drop("bytes")
    todo = sorted(r["day"] for r in planned.where(F.col("outcome") == "ok").collect())  # calendar sized
    lines = export_days(spark, df, table, time_col, order_cols, todo, leaf, ledger, root, schema,
                        ledger_path=ledger_path, exported_at=exported_at, id_col=id_col, day_col=day_col, fmt=fmt)
    written = lines.select(F.to_date("day").alias("day"), F.col("bytes").cast("long").alias("bytes"),
                           F.lit(True).alias("_written"))
    outcomes = planned.join(written, "day", "left").select(
        "table_name", "day",
        F.when((F.col("outcome") == "ok") & F.col("_written").isNull(), F.lit("fail"))
        .otherwise(F.col("outcome")).alias("outcome"),
        "bytes")
    return outcomes, runlog.backfill_summary(outcomes)


# ---------------------------------------------------------------- P4 retention
def retention_plan(df: DataFrame, time_col: str, id_col: str, ledger: DataFrame, table: str, today,
                   horizon: int = S.RETENTION_HORIZON_DAYS, max_days: int = S.MAX_DAYS_PER_RUN,
                   oldest: DataFrame | None = None, leaves: DataFrame | None = None) -> DataFrame:
    """Days to process this run, oldest first, with their action.

    From the day of the lowest-id row up to ``today - horizon`` (inclusive),
    at most ``max_days`` days; a day already in the ledger is purge-only,
    any other day is exported first.  Purge-only days count toward the cap.
    With ``leaves`` days without a leaf are passed over: there is nothing to
    drop, and they must not use up the run's days again and again.
    """
    if oldest is None:
        oldest = slices.oldest_day(df, time_col, id_col).select(F.lit(table).alias("table_name"), "oldest_day")
    cutoff = F.date_sub(cal._date(today), horizon)
    days = oldest.select("table_name", F.explode(F.sequence("oldest_day", F.greatest("oldest_day", cutoff),
                                                            F.expr("interval 1 day"))).alias("day"))
    days = cal.eligible_days(days, today, horizon)
    if leaves is not None:
        days = days.join(leaves.select("table_name", "day").distinct(), ["table_name", "day"], "left_semi")
    picked = cal.oldest_first(days, max_days)
    done = cal.ledger_days(ledger.where(F.col("table_name") == table)).withColumn("_done", F.lit(True))
    return picked.join(done, ["table_name", "day"], "left").select(
        "table_name", "day", F.col("seq").cast("int").alias("seq"),
        F.when(F.col("_done"), F.lit("purge")).otherwise(F.lit("export+purge")).alias("action"))


def run_retention(spark: SparkSession, table_path: str, table: str, time_col: str, order_cols: Sequence[str],
                  schema: T.StructType, archive_root: str, ledger_path: str, today,
                  horizon: int = S.RETENTION_HORIZON_DAYS, max_days: int = S.MAX_DAYS_PER_RUN,
                  exported_at: str | None = None, fmt: str = "csv.gz", armed: bool = False) -> DataFrame:
    """One retention run over a ``day=``-partitioned Parquet table (P4 end to end).

    Oldest leaf first, up to ``today - horizon`` and ``max_days`` days: days
    not in the ledger are exported in one job, then every planned day gets a
    purge plan against the ledger, the archive and the table's own leaves,
    and only verified days are dropped -- and, as in the day-by-day job,
    none after the first refused day (those report ``HOLD``).  Returns the
    purge plan rows (calendar sized) with a ``dropped`` flag.  Tables that
    need arming (trades) are only purged with ``armed=True``.  The ledger's
    bounds follow the table's ledger kind: ids for ticks, the day's two
    midnights for trades.  A leaf without files is exported as an empty day
    and dropped like any other.
    """
    from tidemark.sources.ledger import read_manifest
    from tidemark.sources.tables import children_of, table_leaves

    recover(spark, table_path)  # a run that crashed is finished before its leaves are listed
    root = archive_root.rstrip("/")
    kind = S.TABLES[table].ledger_kind if table in S.TABLES else "ticks"
    id_col = "id" if kind == "ticks" else None
    leaves = table_leaves(spark, table_path, table)
    data = spark.read.schema(table_schema(spark, table_path, schema)).option("basePath", table_path).parquet(table_path)
    ledger = read_manifest(spark, ledger_path, table)
    oldest = leaves.groupBy("table_name").agg(F.min("day").alias("oldest_day"))
    plan = retention_plan(data, time_col, id_col or time_col, ledger, table, today, horizon, max_days, oldest, leaves)
    planned = plan.collect()  # at most max_days rows
    if not planned:
        return spark.createDataFrame([], "table_name string, day date, decision string, reason string, "
                                         "dropped boolean")
    days = [r["day"] for r in planned]
    to_export = [r["day"] for r in planned if r["action"] == "export+purge"]
    if to_export:
        export_days(spark, data, table, time_col, order_cols, to_export, leaves, ledger, root,
                    schema, ledger_path=ledger_path, exported_at=exported_at, id_col=id_col, fmt=fmt, day_col="day")
    ledger = read_manifest(spark, ledger_path, table)
    inv = arc.day_inventory(arc.archive_inventory(spark, arc.day_folders(f"{root}/{table}", days))).select(
        F.concat(F.lit(table + "-"), F.col("day").cast("string"), F.lit("." + fmt)).alias("file"), "bytes", "sha256")
    days_df = spark.createDataFrame([(table, d) for d in days], "table_name string, day date")
    counts = data.where(F.col("day").isin(days)).groupBy("day").agg(F.count(F.lit(1)).alias("n_rows")) \
        .withColumn("table_name", F.lit(table))
    listing = table_day_listing(spark, table_path, days)
    pp = purge_plan(days_df, ledger, inv, children_of(leaves), counts, armed=armed, suffix="." + fmt,
                    listing=listing)
    # like the day-by-day job, stop at the first refused day: only verified days before it are dropped
    first_refusal = pp.where(F.col("decision") != "PURGE").agg(F.min("day")).first()[0]
    if first_refusal is not None:
        pp = pp.withColumn("decision", F.when(F.col("day") > F.lit(first_refusal), F.lit("HOLD"))
                           .otherwise(F.col("decision")))
    pp = pp.cache()
    try:
        dropped = set(apply_purge(spark, pp, table_path, time_col))
        rows = [(r["table_name"], r["day"], r["decision"], r["reason"], r["day"].isoformat() in dropped)
                for r in pp.collect()]
    finally:
        pp.unpersist()
    return spark.createDataFrame(rows, "table_name string, day date, decision string, reason string, dropped boolean")


def table_schema(spark: SparkSession, table_path: str, schema: T.StructType) -> T.StructType:
    """The table's own schema with its day column; the archive's where all leaves are empty and nothing can be inferred."""
    try:
        return spark.read.parquet(table_path).schema
    except AnalysisException as e:
        if e.getCondition() != "UNABLE_TO_INFER_SCHEMA":
            raise
        return T.StructType([*schema.fields, T.StructField("day", T.DateType())])


# ---------------------------------------------------------------- P5 / A15
def partition_coverage(leaf: DataFrame, config: DataFrame, today, archived: DataFrame,
                       default_rows: DataFrame, fwd: int = S.FORWARD_DAYS,
                       forward_min: int = S.FORWARD_MIN_DAYS) -> DataFrame:
    """Per table: missing leaves, dropped (already archived), anchors, headroom, DEFAULT rows, status.

    ``config`` has (table_name, back_days, purged_by_retention); backward
    buffers of retention-purged tables are clamped below the horizon (L3).
    ``blocked`` (DEFAULT not empty) and ``failed`` (headroom under the floor)
    are separate flags: both can hold.
    """
    cfg = cal.backward_window(config)
    sc = cal.scope(cfg, today, "back", fwd)
    # one pass over each table's calendar: leaf? archived? -> counts and the kept-day list for the anchors
    have = leaf.select("table_name", "day").distinct().withColumn("_leaf", F.lit(True))
    arch = archived.select("table_name", "day").distinct().withColumn("_arch", F.lit(True))
    gaps = cal.calendar(sc).join(have, ["table_name", "day"], "left").where(F.col("_leaf").isNull()) \
        .join(arch, ["table_name", "day"], "left")
    per = gaps.groupBy("table_name").agg(
        F.count_if(F.col("_arch").isNull()).alias("missing"),
        F.count_if(F.col("_arch").isNotNull()).alias("dropped"),
        F.sort_array(F.collect_list(F.when(F.col("_arch").isNull(), F.col("day")))).alias("_kept"),
    ).withColumn("_anchors", cal.anchor_fold(F.col("_kept")))
    head = cal.forward_headroom(leaf, cfg, today)
    out = (
        cfg.select("table_name", "back").join(per, "table_name", "left").join(head, "table_name", "left")
        .join(default_rows, "table_name", "left")
    )
    return out.select(
        "table_name", F.col("back").cast("int").alias("back_days"),
        F.coalesce("missing", F.lit(0)).cast("long").alias("missing"),
        F.coalesce("dropped", F.lit(0)).cast("long").alias("dropped"),
        F.when(F.col("_anchors").isNull(), F.lit(0)).otherwise(F.size("_anchors")).cast("long").alias("anchors"),
        F.element_at("_anchors", 1).alias("first_anchor"), "headroom", "capped",
        F.coalesce("default_rows", F.lit(0)).cast("long").alias("default_rows"),
        (F.coalesce("default_rows", F.lit(0)) > 0).alias("blocked"),
        (F.col("headroom") < forward_min).alias("failed"))


# ---------------------------------------------------------------- P6 sweep
def _swept(candles: DataFrame, lo_day, hi_day, timeframes: Sequence[str], day_col: str | None):
    """The sweep's rule as one condition, never null: closed, in the range by open_at, of one of the timeframes."""
    rule = cdl.closed_in_range(candles, "open_at", lo_day, hi_day, day_col=day_col) & F.col("timeframe").isin(*timeframes)
    return F.coalesce(rule, F.lit(False))


def candle_sweep(candles: DataFrame, lo_day, hi_day, timeframes: Sequence[str] = S.TIMEFRAMES,
                 day_col: str | None = None) -> DataFrame:
    """Closed versions of every timeframe in [lo_day, hi_day] by open_at, in one pass.

    ``day_col``: the table's partition column holding open_at's UTC day; only its days in range are read.
    """
    return candles.where(_swept(candles, lo_day, hi_day, timeframes, day_col))


def sweep_remainder(candles: DataFrame, lo_day, hi_day, timeframes: Sequence[str] = S.TIMEFRAMES,
                    day_col: str | None = None) -> DataFrame:
    """All rows that ``candle_sweep`` leaves: its exact complement, by a filter without any join or shuffle.

    A closed version of no length shares known_from with its successor, so versions are told apart by the rule
    itself and never by their keys.
    """
    return candles.where(~_swept(candles, lo_day, hi_day, timeframes, day_col))


def candle_sweep_job(candles: DataFrame, lo_day, hi_day, archive_path: str, keys: Sequence[str],
                     timeframes: Sequence[str] = S.TIMEFRAMES, day_col: str | None = None) -> DataFrame:
    """Sweep closed versions: archive them by their bar's day, then return the table without them.

    The archive is written (zstd Parquet, sorted by key and version) before
    the remaining table is returned, so a crash never loses a version; the
    caller writes the returned frame, or with ``sweep_partitions`` only the
    partitions that lost rows.
    """
    swept = candle_sweep(candles, lo_day, hi_day, timeframes, day_col)
    arc.write_day_archive(swept.drop(day_col) if day_col == "day" else swept, archive_path, "open_at",
                          [*keys, "timeframe", "open_at", "known_from"], fmt="parquet")
    return sweep_remainder(candles, lo_day, hi_day, timeframes, day_col)


def sweep_partitions(spark: SparkSession, table_path: str, lo_day, hi_day, archive_path: str, out_path: str,
                     keys: Sequence[str], timeframes: Sequence[str] = S.TIMEFRAMES) -> int:
    """Sweep a (timeframe, day)-partitioned table; writes the rest of the touched partitions only (P6 on storage).

    ``out_path`` receives, under the table's own partition folders, the remaining rows of each partition in range
    that lost some.  Partitions elsewhere are neither read nor written; put the written ones in place of the old.
    Returns the number of (timeframe, day) partitions that lost rows (calendar sized).
    """
    candles = spark.read.parquet(table_path)
    arc.write_day_archive(candle_sweep(candles, lo_day, hi_day, timeframes, "day").drop("day"), archive_path, "open_at",
                          [*keys, "timeframe", "open_at", "known_from"], fmt="parquet")
    touched = candle_sweep(candles, lo_day, hi_day, timeframes, "day").select("timeframe", "day").distinct().collect()
    if touched:
        hit = F.struct("timeframe", "day").isin([F.struct(F.lit(r["timeframe"]), F.lit(r["day"])) for r in touched])
        rest = sweep_remainder(candles.where(F.col("day").isin(sorted({r["day"] for r in touched})) & hit), lo_day, hi_day,
                               timeframes, "day")
        rest.write.mode("error").partitionBy("timeframe", "day").parquet(out_path)
    return len(touched)


def sweep_apply(spark: SparkSession, table_path: str, lo_day, hi_day, archive_path: str, keys: Sequence[str],
                timeframes: Sequence[str] = S.TIMEFRAMES, step=lambda _: None) -> DataFrame:
    """Sweep closed versions out of a (timeframe, day)-partitioned table in place (P6 on the table itself).

    One aggregate finds the partitions in range that hold closed versions.  Their files are listed, then read once
    for the archive (``<archive>/run=<id>/timeframe=/day=``, sorted by key and version) and once for the rows that
    stay; both are written before anything is moved, and their counts must add up to the partition's.  Then the
    partitions are swapped by one journaled run (``sources.swap``): a crash anywhere leaves a table that ``recover``
    completes.  A partition whose files changed meanwhile keeps them, and its part of the archive is withdrawn; the
    next run sweeps it.  A partition that loses all rows stays as an empty leaf.

    Returns (timeframe, day, n_swept, n_left, swapped) of each touched partition: calendar sized.
    """
    recover(spark, table_path)
    ddl = "timeframe string, day date, n_swept long, n_left long, swapped boolean"
    candles = spark.read.parquet(table_path)
    part_days = F.col("day").between(cal._date(lo_day), cal._date(hi_day)) & F.col("timeframe").isin(*timeframes)
    swept = F.count_if(_swept(candles, lo_day, hi_day, timeframes, "day")).alias("n_swept")
    touched = [(r["timeframe"], r["day"]) for r in candles.where(part_days).groupBy("timeframe", "day").agg(swept).where(
        "n_swept > 0").collect()]  # calendar sized
    if not touched:
        return spark.createDataFrame([], ddl)
    table = table_path.rstrip("/")
    parts = {f"timeframe={t}/day={d.isoformat()}": (t, d) for t, d in sorted(touched)}
    listings = {p: listing_of(spark, f"{table}/{p}") for p in parts}
    # what is read from here on is listed after the journal's listing: a file that lands in between is a conflict later
    rows = spark.read.option("basePath", table).schema(candles.schema).parquet(*[f"{table}/{p}" for p in parts])
    swap = Swap(spark, table, step=step)
    archive = f"{archive_path.rstrip('/')}/run={swap.run}"
    order = [*keys, "open_at", "known_from"]
    n = partitions_for(rows)
    gone = candle_sweep(rows, lo_day, hi_day, timeframes, "day")
    (gone.repartitionByRange(n, "timeframe", "day", *order).sortWithinPartitions("timeframe", "day", *order)
     .write.mode("error").option("compression", "zstd").partitionBy("timeframe", "day").parquet(archive))
    rest = sweep_remainder(rows, lo_day, hi_day, timeframes, "day")
    rest.write.mode("error").partitionBy("timeframe", "day").parquet(swap.new)
    swap.step("staged")
    counts = {key: [0, 0, 0] for key in parts.values()}
    staged = spark.read.schema(candles.schema)
    for i, df in enumerate((rows, staged.parquet(archive), staged.parquet(swap.new))):
        for r in df.groupBy("timeframe", "day").agg(F.count(F.lit(1)).alias("n")).collect():
            counts[(r["timeframe"], r["day"])][i] = r["n"]
    if bad := [p for p, key in parts.items() if counts[key][0] != counts[key][1] + counts[key][2]]:
        fs, new = fs_of(spark, swap.root)
        fs.delete(new, True)
        fs, old = fs_of(spark, archive)
        fs.delete(old, True)
        raise RuntimeError(f"SWEEP ROWCOUNT MISMATCH on {len(bad)} partition(s); nothing moved")
    swap.declare([("put", p, listings[p], f"{archive}/{p}") for p in parts])
    done = set(swap.apply())
    return spark.createDataFrame([(t, d, counts[(t, d)][1], counts[(t, d)][2], p in done) for p, (t, d) in parts.items()], ddl)


# ---------------------------------------------------------------- P7 ingest
def candle_ingest(spark: SparkSession, cache_path: str, sources: DataFrame, now, keys: Sequence[str],
                  timeframes: Sequence[str] = S.DERIVED_TIMEFRAMES, floor: int = S.MIN_LOOKBACK_DAYS,
                  current: DataFrame | None = None, table_path: str | None = None) -> DataFrame:
    """Lookback -> leaves for ``since..today`` -> load the cache -> synthesize with ``cut_date = since``.

    With ``table_path`` (a ``day=`` partitioned candle table) every day from
    ``since`` to today gets its leaf before anything is loaded, so no bar can
    fall into DEFAULT.  No source known: the floor's lookback applies.

    ``since`` is the earliest over sources (one small aggregate read by the
    driver as a scalar, like the job's own date arithmetic).  Without
    ``current`` the synthesized bars are returned.  With the current SCD2
    candle table, the loaded 1m rows and the synthesized bars are upserted
    into it (a changed bar closes its old version, an unchanged one is kept),
    so re-running over the same cache changes nothing.
    """
    since, today = ingest_window(spark, sources, now, floor)
    if table_path:
        ensure_leaves(spark, table_path, since, today)
    base, synthesized = _cached_bars(spark, cache_path, since, today, keys, timeframes)
    if current is None:
        return synthesized
    incoming = base.unionByName(synthesized)
    at = F.to_timestamp(F.lit(now)) if isinstance(now, str) else now
    # only the batch's days take part in the merge join; older bars pass through untouched
    t = current.schema["open_at"].dataType
    touched = F.coalesce(F.col("open_at") >= F.lit(since).cast("date").cast(t), F.lit(False))
    if "day" in current.columns:  # a partition filter on either side of the merge
        touched = touched & F.coalesce(F.col("day") >= F.lit(since).cast("date"), F.lit(False))
    merged = cdl.scd2_upsert(current.where(touched), incoming, [*keys, "timeframe", "open_at"],
                             cdl.CANDLE_VALUE_COLUMNS, at)
    if "day" in current.columns:
        merged = merged.withColumn("day", F.to_date("open_at"))
    return current.where(~touched).unionByName(merged.select(*current.columns))


def ingest_window(spark: SparkSession, sources: DataFrame, now, floor: int = S.MIN_LOOKBACK_DAYS) -> tuple[dt.date, dt.date]:
    """(since, today): the earliest lookback over the sources, or the floor's where none is known."""
    since = cdl.lookback_since(sources, now, floor).agg(F.min("since")).first()[0]
    today, fallback = spark.range(1).select(*[F.date_sub(F.to_date(F.to_timestamp(F.lit(now))), k) for k in (0, floor)]).first()
    return since or fallback, today


def _cached_bars(spark, cache_path, since, today, keys, timeframes) -> tuple[DataFrame, DataFrame]:
    """The cache's 1m bars since a day, and the higher timeframes made from them."""
    base = load_candle_csv(spark, cache_path, since)
    made = cdl.synthesize_candles(base, keys, timeframes, start=since, end=today, cut_date=since)
    return base.select(*keys, "timeframe", "open_at", *cdl.CANDLE_VALUE_COLUMNS), made


def candle_ingest_table(spark: SparkSession, name: str, cache_path: str, sources: DataFrame, now, keys: Sequence[str],
                        timeframes: Sequence[str] = S.DERIVED_TIMEFRAMES, floor: int = S.MIN_LOOKBACK_DAYS) -> DataFrame:
    """The nightly ingest into a catalog table in place (P7): cache -> bars -> ``ingest_table``; its report is returned."""
    since, today = ingest_window(spark, sources, now, floor)
    base, made = _cached_bars(spark, cache_path, since, today, keys, timeframes)
    at = F.to_timestamp(F.lit(now)) if isinstance(now, str) else now
    return ingest_table(spark, name, base.unionByName(made), at, keys)


CANDLE_TABLE_PARTITIONS = ("timeframe", "day")


def create_candle_table(spark: SparkSession, name: str, path: str, schema: T.StructType, keys: Sequence[str],
                        buckets: int) -> None:
    """An empty SCD2 candle table: partitioned by (timeframe, day), bucketed by bar, so that ingests join it in place."""
    columns = [f for f in schema.fields if f.name not in CANDLE_TABLE_PARTITIONS]
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    bars = ", ".join(f"`{c}`" for c in (*keys, "open_at"))
    spark.sql(f"CREATE TABLE {name} ({ddl}, timeframe STRING, day DATE) USING parquet LOCATION '{path}' "
              f"PARTITIONED BY (timeframe, day) CLUSTERED BY ({bars}) SORTED BY ({bars}) INTO {int(buckets)} BUCKETS")


def _bucket_spec(spark: SparkSession, name: str) -> tuple[int, list[str]]:
    said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()}
    columns = [c.strip(" `") for c in said.get("Bucket Columns", "[]").strip("[]").split(",") if c.strip()]
    return int(said.get("Num Buckets", 0)), columns


def candle_changes(current: DataFrame, incoming: DataFrame, keys: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """Bars of ``incoming`` that are new to the active rows of ``current`` or differ from them: their keys and new values.

    ``_closes`` holds the active version's known_from if there is one to close.  The batch meets the active rows in
    one left join on ``keys``.
    """
    active = current.where(F.col("known_to") == sentinel_for(current, "known_to"))
    a = active.select(*keys, *[F.col(c).alias(f"_a_{c}") for c in value_cols], F.col("known_from").alias("_closes"),
                      F.lit(True).alias("_a"))
    same = F.col("_a").isNotNull()
    for c in value_cols:
        same = same & F.col(f"_a_{c}").eqNullSafe(F.col(c))
    return incoming.join(a, list(keys), "left").where(~same).select(*incoming.columns, "_closes")


def ingest_table(spark: SparkSession, name: str, incoming: DataFrame, at, keys: Sequence[str],
                 value_cols: Sequence[str] = cdl.CANDLE_VALUE_COLUMNS, step=lambda _: None) -> DataFrame:
    """Upsert bars into a bucketed SCD2 candle table, rewriting only the (timeframe, day) partitions that change.

    ``incoming``: keys, timeframe, open_at and the values; several rows of a bar count as one.  The batch is dealt
    by the table's own bucketing and joined to the active rows of its days, which are read in place: no exchange on
    the table's side.  Bars that are new or differ are settled first; only the partitions that have any are read again,
    written beside the table in the same buckets (changed versions closed at ``at``, new ones open from it) and
    swapped by one journaled run.  Files of all other partitions stay as they are, and a repeated batch changes
    nothing.  Returns (timeframe, day, n_new, n_closed) of each partition rewritten: calendar sized.
    """
    ddl = "timeframe string, day date, n_new long, n_closed long"
    path = table_location(spark, name)
    if recover(spark, path):
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    current = spark.table(name)
    buckets, bucket_cols = _bucket_spec(spark, name)
    bar = [*bucket_cols, "timeframe"]
    t = current.schema["open_at"].dataType
    batch = cdl.one_per_key(incoming.withColumn("open_at", F.col("open_at").cast(t)).repartition(buckets, *bucket_cols), bar,
                            value_cols)  # grouped where it was dealt, by the table's own buckets
    days = [r["day"] for r in batch.select(F.to_date("open_at").alias("day")).distinct().collect()]  # calendar sized
    if not days:
        return spark.createDataFrame([], ddl)
    with co_partitioned_by_some_keys(spark):
        changes = settled(candle_changes(current.where(F.col("day").isin(days)), batch, bar, value_cols).withColumn(
            "day", F.to_date("open_at")))
    per = changes.groupBy("timeframe", "day").agg(F.count(F.lit(1)).alias("n_new"), F.count("_closes").alias("n_closed")).collect()
    if not per:
        return spark.createDataFrame([], ddl)
    parts = {f"timeframe={r['timeframe']}/day={r['day'].isoformat()}": r for r in per}
    listings = {p: listing_of(spark, f"{path}/{p}") for p in parts}
    at_c = (F.lit(at) if isinstance(at, str) else at).cast(current.schema["known_from"].dataType)
    sentinel = sentinel_for(current, "known_to")
    hit = F.struct("timeframe", "day").isin([F.struct(F.lit(r["timeframe"]), F.lit(r["day"])) for r in per])
    spark.sql(f"REFRESH TABLE {name}")
    old = spark.table(name).where(F.col("day").isin(sorted({r["day"] for r in per})) & hit)
    closing = changes.where("_closes is not null").select(*bar, F.lit(True).alias("_close"))
    with co_partitioned_by_some_keys(spark):
        kept = old.join(closing, bar, "left").withColumn(
            "known_to", F.when(F.col("_close") & (F.col("known_to") == sentinel), at_c).otherwise(F.col("known_to")))
        opened = changes.withColumn("known_from", at_c).withColumn("known_to", sentinel)
        rows = kept.select(*current.columns).unionByName(opened.select(*current.columns))
        swap = Swap(spark, path, step=step)
        staged = f"swap_{swap.run}"
        create_candle_table(spark, staged, swap.new, current.schema, [c for c in bucket_cols if c != "open_at"], buckets)
        try:
            (rows.repartition(buckets, *bucket_cols).sortWithinPartitions("timeframe", "day", *bucket_cols)
             .write.mode("append").insertInto(staged))
        finally:
            spark.sql(f"DROP TABLE {staged}")  # external: the files stay
    swap.step("staged")
    swap.declare([("put", p, listings[p], None) for p in parts])
    done = swap.apply()
    for p in done:
        spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION ({partition_spec(p)})")
    spark.sql(f"REFRESH TABLE {name}")
    if swap.conflicts:
        raise RuntimeError(f"{len(swap.conflicts)} partition(s) changed while the batch was merged; run it again")
    return spark.createDataFrame([(r["timeframe"], r["day"], r["n_new"], r["n_closed"]) for r in per], ddl)


@contextlib.contextmanager
def co_partitioned_by_some_keys(spark: SparkSession):
    """Let a join keep a side where it is if that side is dealt by some of the join's keys (a bucketed table's)."""
    conf = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.sources.v2.bucketing.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def ensure_leaves(spark: SparkSession, table_path: str, lo: dt.date, hi: dt.date) -> list[dt.date]:
    """Make the ``day=`` folder of every day of [lo, hi] that the table lacks; returns those days."""
    made = []
    for k in range((hi - lo).days + 1):  # calendar sized, metadata only
        d = lo + dt.timedelta(days=k)
        fs, p = fs_of(spark, f"{table_path.rstrip('/')}/day={d.isoformat()}")
        if not fs.exists(p):
            fs.mkdirs(p)
            made.append(d)
    return made


# ---------------------------------------------------------------- P8 restore
def supplement_files(spark: SparkSession, ledger_path: str, folder: str, days: Sequence[dt.date]) -> list[str]:
    """The supplement files of the given days, proved: each exists with the size and sha256 of its ledger line.

    Raises on a missing or differing file and on a line that cannot be read; several lines of a file must agree.
    """
    from tidemark.sources.ledger import read_supplements

    lines = read_supplements(spark, ledger_path).where(F.col("day").isin(list(days)) | F.col("day").isNull()).distinct().collect()
    paths = {}
    for r in lines:  # one line per supplement file of the restored days
        if r["day"] is None or not (r["rows"] or "").isdigit():
            raise RuntimeError(f"REFUSE: unreadable supplement line for {r['file']}")
        paths.setdefault(arc.qualified(spark, f"{folder.rstrip('/')}/{r['file']}"), []).append((int(r["bytes"]), r["sha256"]))
    if not paths:
        return []
    found = {r["path"]: (r["bytes"], r["sha256"]) for r in arc.archive_inventory(spark, sorted(paths)).collect()}
    for p, said in paths.items():
        if any(found.get(p) != s for s in said):
            raise RuntimeError(f"REFUSE: supplement {p} is missing or differs from its ledger line")
    return sorted(paths)


def restore(spark: SparkSession, archive_path: str, schema: T.StructType, supplements: DataFrame | None,
            leaf: DataFrame, table: str, time_col: str, key: str = "id") -> DataFrame:
    """Re-read archived days, add supplement rows, and route each row to its leaf or DEFAULT."""
    base = arc.read_archive(spark, archive_path, schema).drop("day")
    rows = arc.restore_days(base, supplements, key) if supplements is not None else base
    return late.route_rows(rows, time_col, leaf, table)


def restore_into_table(spark: SparkSession, archive_root: str, table: str, days: Sequence[dt.date],
                       schema: T.StructType, table_path: str, time_col: str,
                       supplements: DataFrame | None = None, key: str = "id", supplement_ledger: str | None = None,
                       supplement_folder: str | None = None, ledger: DataFrame | None = None,
                       step=lambda _: None) -> DataFrame:
    """Put archived days back into a ``day=``-partitioned table (P8 into storage).

    ``supplement_ledger`` and ``supplement_folder`` (default: the archive
    root) name the supplement files; only files of the restored days are
    read, and only if size and sha256 equal their ledger lines.  With
    ``ledger`` (the manifest) a day's archived row count must equal its line.
    A row in another day's folder refuses the restore.

    Days that have rows in the table are refused, so a restore never
    duplicates them; a day without a leaf or with an empty one is free.  The
    archives are re-read strictly (only the days' folders), completed with
    the supplement rows they lack, written beside the table in one job and
    put in place by one journaled run, day by day (``sources.swap``): a crash
    leaves whole days only, and the next run (or ``recover``) goes on from
    there.  A day that another writer fills meanwhile keeps that writer's
    files and is not reported.  Returns (day, restored rows) per restored day.
    """
    recover(spark, table_path)
    listings = {d: listing_of(spark, f"{table_path.rstrip('/')}/day={d.isoformat()}") for d in days}
    todo = [d for d, listing in listings.items() if listing in (None, NO_FILES)]
    if not todo:
        return spark.createDataFrame([], "day date, restored long")
    base = arc.read_archive(spark, arc.day_folders(f"{archive_root.rstrip('/')}/{table}", todo), schema,
                            base=f"{archive_root.rstrip('/')}/{table}")
    got = {r["day"]: (r["n"], r["strays"]) for r in base.groupBy("day").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("day").eqNullSafe(day_of(time_col))).alias("strays")).collect()}
    if bad := sorted(d for d, (_, strays) in got.items() if strays):
        raise RuntimeError(f"REFUSE: archive rows of other days in the folders of {[d.isoformat() for d in bad]}")
    if ledger is not None:
        said = {r["day"]: r["rows"] for r in ledger.where(F.col("table_name") == table).select(
            F.try_to_date("day", "yyyy-MM-dd").alias("day"), F.col("rows").try_cast("long").alias("rows")).where(
            F.col("day").isin(todo)).collect()}
        if bad := sorted(d for d in todo if said.get(d) != got.get(d, (0, 0))[0]):
            raise RuntimeError(f"REFUSE: archived rows differ from the ledger on {[d.isoformat() for d in bad]}")
    base = base.drop("day")
    if supplement_ledger:
        files = supplement_files(spark, supplement_ledger, supplement_folder or archive_root, todo)
        if files:
            supplements = arc.read_archive(spark, files, schema)
    rows = base
    if supplements is not None:
        supp = supplements.select(*schema.names).where(day_of(time_col).isin(todo))
        rows = arc.restore_days(base, supp, key)
    swap = Swap(spark, table_path, step=step)
    rows.withColumn("day", day_of(time_col)).write.mode("error").partitionBy("day").parquet(swap.new)
    swap.step("staged")
    staged = spark.read.schema(T.StructType([*schema.fields, T.StructField("day", T.DateType())])).parquet(swap.new)
    counts = {r["day"]: r["n"] for r in staged.groupBy("day").agg(F.count(F.lit(1)).alias("n")).collect()}
    if bad := sorted(d for d in todo if counts.get(d, 0) < got.get(d, (0, 0))[0]):
        raise RuntimeError(f"RESTORE ROWCOUNT MISMATCH on {[d.isoformat() for d in bad]}; nothing was put in place")
    swap.declare([("put", f"day={d.isoformat()}", listings[d], None) for d in todo])
    done = set(swap.apply())
    return spark.createDataFrame([(d, counts.get(d, 0)) for d in todo if f"day={d.isoformat()}" in done], "day date, restored long")


# ---------------------------------------------------------------- P9 logs
def run_log_report(log: DataFrame, pattern: str | None = None) -> dict[str, DataFrame]:
    """Runs, problem counts, tails and failure streaks of run logs."""
    runs = runlog.segment_runs(log, pattern)
    problems = runlog.problem_count(runs)
    return {
        "runs": runs,
        "problems": problems,
        "tail": runlog.run_tail(runs),
        "streaks": runlog.failure_streaks(problems.select("file", "run_no", "failed")),
    }
