"""Late data: routing, DEFAULT occupancy, late arrivals, sealed days, monotonicity
(L1 L2 L4 A4 W7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import day_of
from tidemark.operators.joins import day_side
from tidemark.operators.prefix import prefix_max_before


def route_rows(df: DataFrame, time_col: str, leaf: DataFrame, table: str) -> DataFrame:
    """Each row goes to its day's leaf, else to ``<table>_default`` (L1).

    ``leaf`` is (table_name, day[, leaf_name]) -- one row per leaf day, a
    calendar-bounded side that is broadcast, so the rows are never
    shuffled.  Also usable per micro-batch in ``foreachBatch``.
    """
    lv = leaf.where(F.col("table_name") == table).select(
        "day", (F.col("leaf_name") if "leaf_name" in leaf.columns
                else F.concat(F.lit(table + "_d"), F.date_format("day", "yyyyMMdd"))).alias("_leaf")).distinct()
    return (
        df.withColumn("day", day_of(time_col))
        .join(day_side(lv), "day", "left")
        .withColumn("target", F.coalesce(F.col("_leaf"), F.lit(table + "_default")))
        .drop("_leaf")
    )


def default_rows(df: DataFrame, time_col: str, leaf: DataFrame, table: str, day_col: str | None = None) -> DataFrame:
    """Rows whose day has no leaf, counted per table (A4).

    With a ``day`` partition column the leaf days (a calendar-sized list)
    become a ``NOT IN`` partition filter, so every leaf partition is pruned
    and only the partitions without a leaf are read.
    """
    days = leaf.where(F.col("table_name") == table).select("day").distinct()
    if day_col is not None:
        leaf_days = [r["day"] for r in days.collect()]  # calendar sized
        def out(c):  # a null day has no leaf either
            return ~F.col(c).isin(leaf_days) | F.col(c).isNull() if leaf_days else F.lit(True)

        rows = df.where(out(day_col)).select(day_of(time_col).alias("day")).where(out("day"))
    else:
        rows = df.select(day_of(time_col).alias("day")).join(day_side(days), "day", "left_anti")
    return rows.agg(F.count(F.lit(1)).alias("default_rows")).select(F.lit(table).alias("table_name"),
                                                                     "default_rows")


def late_arrivals(df: DataFrame, event_col: str, arrival_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows whose event day is earlier than their arrival day, counted by arrival day and lag (L2)."""
    lag = F.datediff(day_of(arrival_col), day_of(event_col))
    return (
        df.select(*keys, day_of(arrival_col).alias("arrival_day"), lag.alias("lag_days"))
        .where(F.col("lag_days") > 0)
        .groupBy(*keys, "arrival_day", "lag_days")
        .agg(F.count(F.lit(1)).alias("n_rows"))
    )


def sealed_day_late_rows(df: DataFrame, event_col: str, arrival_col: str, ledger: DataFrame, table: str) -> DataFrame:
    """Rows that landed on an already-exported day after its export (L4).

    They are in no archive and would make the next purge of that day refuse.
    ``ledger`` is parsed (text fields); ``exported_at`` is ISO-8601 Z text.
    """
    sealed = (
        ledger.where(F.col("table_name") == table)
        .select(F.try_to_date("day", "yyyy-MM-dd").alias("day"),
                F.try_to_timestamp("exported_at", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("exported_at"))
        .where(F.col("day").isNotNull())
        .groupBy("day").agg(F.min("exported_at").alias("exported_at"))
    )
    at = df.schema[arrival_col].dataType
    return (
        df.withColumn("day", day_of(event_col))
        .join(day_side(sealed), "day", "inner")
        .where(F.col(arrival_col) > F.col("exported_at").cast(at))
    )


def monotonicity_violations(df: DataFrame, id_col: str, ts_col: str, parts: int | None = None) -> DataFrame:
    """Rows whose timestamp is below the running max of all lower ids.

    Not one global window: ids are cut into even ranges by their quantiles,
    each range is scanned by its own task, and the running max of earlier
    ranges is carried in from a table of one row a range (``operators.prefix``).
    """
    scanned = prefix_max_before(df, [], id_col, ts_col, "_prev_max", parts)
    return scanned.where(F.col(ts_col) < F.col("_prev_max")).withColumnRenamed("_prev_max", "running_max")
