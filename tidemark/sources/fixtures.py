"""Market-data shaped views over the provided Parquet tables.

The provided data is ``events`` and ``lineitem``; these views give them the
shapes the archive jobs work on (ticks, trades, leaf catalog, ledgers, file
inventory, SCD2 versions, run logs).  Each one is a pure DataFrame
derivation, so every query's work grows with the input tables.  Faults are
planted on fixed days so each refusal reason of the purge plan occurs; the
DuckDB oracle builds the same views from the same text rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import day_of



def _sentinel():
    return F.lit("9999-12-31 00:00:00").cast("timestamp_ntz")

# ---- fixed values of the fixture (shared with the oracle SQL) ---------------
NO_LEAF_DAYS = (11, 22)          # days of month without a ticks leaf
LEDGER_LAST_DAY = 20             # ticks ledger lines exist for days 1..20 ...
LEDGER_NO_LINE_DAY = 5           # ... except this one
LEDGER_BAD_BOUNDS_DAY = 8
LEDGER_ROWS_OFF_DAYS = (7, 14)
LEDGER_BAD_SHA_TEXT_DAY = 9
LEDGER_SHORT_LINE_DAY = 10
LEDGER_DUPLICATE_DAY = 13
INVENTORY_SIZE_OFF_DAY = 12
INVENTORY_MISSING_DAY = 15
INVENTORY_SHA_OFF_DAY = 16
TRADES_LEDGER_BEFORE = "2024-01-10"  # trades days before this were exported the next morning
EXPORT_TIME = "T03:17:00Z"
# ---------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("bus_time"),
                    F.col("event_type").alias("instrument"), F.col("value").alias("price"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 40th trade executed 45 days before it arrived; every 10th version closed."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        F.concat(F.lit("t"), eid.cast("string")).alias("public_id"),
        F.col("ts").alias("bus_time"),
        F.when(eid % 10 == 0, F.col("ts") + F.expr("interval 1 day")).otherwise(_sentinel()).alias("known_to"),
        F.col("user_id").cast("string").alias("session_id"),
        eid.alias("sequence_id"),
        F.col("event_type").alias("instrument_public_id"),
        F.concat(F.lit("x"), eid.cast("string")).alias("trade_id"),
        F.when(eid % 40 == 0, F.col("ts") - F.expr("interval 45 days")).otherwise(F.col("ts")).alias("executed_at"),
        F.col("value").alias("price"),
        (eid % 100 + 1).cast("long").alias("size"),
        F.when(eid % 2 == 0, F.lit("buy")).otherwise(F.lit("sell")).alias("side"),
        eid.alias("id"),
    )


def _leaf_from_days(days: DataFrame, table_name: str) -> DataFrame:
    return days.select(
        F.lit(table_name).alias("table_name"), "day",
        F.concat(F.lit(table_name + "_d"), F.date_format("day", "yyyyMMdd")).alias("leaf_name"))


def pinned(df: DataFrame) -> DataFrame:
    """A calendar-sized aggregate (one row a day), computed once: what is built from it scans no table again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def leaf(spark: SparkSession, sf_dir: str, c: DataFrame | None = None) -> DataFrame:
    """Ticks leaves: every day with ticks except the 11th and 22nd.  ``c``: the day counts, if already taken."""
    days = (ticks(spark, sf_dir).select(day_of("bus_time").alias("day")).distinct() if c is None else c.select("day")) \
        .where(~F.dayofmonth("day").isin(*NO_LEAF_DAYS))
    return _leaf_from_days(days, "ticks")


def trades_leaf(spark: SparkSession, sf_dir: str, c: DataFrame | None = None) -> DataFrame:
    """Trades leaves: every arrival day (late executions fall before them), which is every day with ticks."""
    days = trades(spark, sf_dir).select(day_of("bus_time").alias("day")).distinct() if c is None else c.select("day")
    return _leaf_from_days(days, "trades")


def all_leaves(spark: SparkSession, sf_dir: str, c: DataFrame | None = None) -> DataFrame:
    return leaf(spark, sf_dir, c).unionByName(trades_leaf(spark, sf_dir, c))


def children(spark: SparkSession, sf_dir: str, c: DataFrame | None = None) -> DataFrame:
    """Partition catalog rows: one ordinary child per leaf with its day bounds, plus a DEFAULT per table."""
    lv = all_leaves(spark, sf_dir, c)
    ordinary = lv.select("table_name", "leaf_name", F.lit("r").alias("kind"), F.lit(False).alias("is_default"),
                         F.col("day").cast("timestamp_ntz").alias("bound_lower"),
                         F.date_add("day", 1).cast("timestamp_ntz").alias("bound_upper"))
    default = lv.select("table_name").distinct().select(
        "table_name", F.concat("table_name", F.lit("_default")).alias("leaf_name"), F.lit("r").alias("kind"),
        F.lit(True).alias("is_default"), F.lit(None).cast("timestamp_ntz").alias("bound_lower"),
        F.lit(None).cast("timestamp_ntz").alias("bound_upper"))
    return ordinary.unionByName(default)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ticks(spark, sf_dir)
    return t.groupBy(day_of("bus_time").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("lo"), (F.max("id") + 1).alias("hi"))


def ledger(spark: SparkSession, sf_dir: str, c: DataFrame | None = None) -> DataFrame:
    """Parsed ticks ledger (MANIFEST.tsv shape, text fields), one fault per chosen day."""
    c = counts(spark, sf_dir) if c is None else c
    dom = F.dayofmonth("day")
    c = c.where((dom <= LEDGER_LAST_DAY) & (dom != LEDGER_NO_LINE_DAY))
    lines = c.withColumn("copy", F.lit(1)).unionByName(
        c.where(dom == LEDGER_DUPLICATE_DAY).withColumn("copy", F.lit(2)))
    return lines.select(
        F.lit("ticks").alias("table_name"), F.lit("ticks").alias("kind"),
        (dom * 10 + F.col("copy")).cast("long").alias("line_no"),
        F.when(dom == LEDGER_SHORT_LINE_DAY, 7).otherwise(8).alias("nf"),
        F.concat(F.lit("ticks-"), F.col("day").cast("string"), F.lit(".csv.zst")).alias("file"),
        F.col("day").cast("string").alias("day"),
        F.col("lo").cast("string").alias("bound_lower"),
        F.when(dom == LEDGER_BAD_BOUNDS_DAY, F.col("lo")).otherwise(F.col("hi")).cast("string").alias("bound_upper"),
        F.when(dom.isin(*LEDGER_ROWS_OFF_DAYS), F.col("n") + 1).otherwise(F.col("n")).cast("string").alias("rows"),
        (F.col("n") * 20).cast("string").alias("bytes"),
        F.when(dom == LEDGER_BAD_SHA_TEXT_DAY, F.lit("bad")).otherwise(F.repeat(F.lit("a"), 64)).alias("sha256"),
        F.concat(F.date_format(F.date_add("day", 1), "yyyy-MM-dd"), F.lit(EXPORT_TIME)).alias("exported_at"),
    )


def trades_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed trades ledger: every execution day before TRADES_LEDGER_BEFORE, exported the next morning."""
    t = trades(spark, sf_dir)
    per = t.groupBy(day_of("executed_at").alias("d")).agg(F.count(F.lit(1)).alias("n")) \
        .where(F.col("d") < F.to_date(F.lit(TRADES_LEDGER_BEFORE)))
    ds = F.col("d").cast("string")
    nxt = F.date_format(F.date_add("d", 1), "yyyy-MM-dd")
    return per.select(
        F.lit("trades").alias("table_name"), F.lit("trades").alias("kind"),
        (F.datediff("d", F.to_date(F.lit("2023-01-01"))) + 1).cast("long").alias("line_no"),
        F.lit(8).alias("nf"),
        F.concat(F.lit("trades-"), ds, F.lit(".csv.zst")).alias("file"),
        ds.alias("day"),
        F.concat(ds, F.lit("T00:00:00Z")).alias("bound_lower"),
        F.concat(nxt, F.lit("T00:00:00Z")).alias("bound_upper"),
        F.col("n").cast("string").alias("rows"),
        (F.col("n") * 100).cast("string").alias("bytes"),
        F.repeat(F.lit("c"), 64).alias("sha256"),
        F.concat(nxt, F.lit(EXPORT_TIME)).alias("exported_at"),
    )


def inventory(spark: SparkSession, sf_dir: str, c: DataFrame | None = None) -> DataFrame:
    """Archive files on disk: one per ticks day except the 15th; the 12th short, the 16th altered."""
    c = counts(spark, sf_dir) if c is None else c
    dom = F.dayofmonth("day")
    return c.where(dom != INVENTORY_MISSING_DAY).select(
        F.concat(F.lit("ticks-"), F.col("day").cast("string"), F.lit(".csv.zst")).alias("file"),
        F.when(dom == INVENTORY_SIZE_OFF_DAY, F.col("n") * 20 - 1).otherwise(F.col("n") * 20).cast("long").alias("bytes"),
        F.when(dom == INVENTORY_SHA_OFF_DAY, F.repeat(F.lit("b"), 64)).otherwise(F.repeat(F.lit("a"), 64)).alias("sha256"),
    )


def trades_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades archive files exactly as their ledger lines describe them."""
    return trades_ledger(spark, sf_dir).select("file", F.col("bytes").cast("long").alias("bytes"), "sha256")


def supplement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows recovered after the fact: absent from the daily archive, kept in supplement files."""
    t = ticks(spark, sf_dir)
    return t.where((F.hour("bus_time") == 3) & (F.col("id") % 50 == 0))


def lineitem_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclosed SCD2 versions: one per lineitem row, keyed by (l_orderkey, l_linenumber)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     F.col("l_shipdate").alias("known_from"), F.col("l_extendedprice").alias("price"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run logs: five files; a banner line starts a run."""
    e = table(spark, sf_dir, "events")
    line = (
        F.when(F.col("event_id") % 50 < 5, F.lit("=== job 2024"))
        .when(F.col("value") > 60, F.lit("WARN: slow"))
        .when(F.col("value") < 1, F.lit("FAILED"))
        .otherwise(F.lit("OK"))
    )
    return e.select(F.col("event_type").alias("file"), F.col("event_id").cast("long").alias("line_no"),
                    line.alias("line"), F.col("ts"))


def candle_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live-published 1h bars: each tick republishes its bar, closing the previous version."""
    from tidemark.operators.candles import close_versions

    t = ticks(spark, sf_dir)
    bar = F.window("bus_time", "3600 seconds").start
    v = t.select("instrument", F.lit("1h").alias("timeframe"), bar.alias("open_at"),
                 F.col("bus_time").alias("known_from"), "id", F.col("price").alias("close"))
    return close_versions(v, ["instrument", "timeframe", "open_at"], ["known_from", "id"])
