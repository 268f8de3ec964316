"""Day slicing and per-day aggregates (F1 F2 A1 A2 A5 O3)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import day_of
from tidemark.operators.calendar import _date


def pinned_projection(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Select exactly ``columns`` in this order; a missing column is an error (F1)."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"pinned columns missing from input: {missing}")
    out = df.select(*columns)
    assert out.columns == list(columns)
    return out


def day_slice(df: DataFrame, time_col: str, lo_day, hi_day, day_col: str | None = None) -> DataFrame:
    """Rows of the half-open UTC range [lo_day 00:00, hi_day 00:00) (F2).

    When the table is stored partitioned by a day column, pass ``day_col``:
    Spark does not derive a partition filter from a timestamp range, so the
    day predicate is added explicitly and shows up as ``PartitionFilters``.
    """
    t = df.schema[time_col].dataType
    lo, hi = _date(lo_day), _date(hi_day)
    out = df.where((F.col(time_col) >= lo.cast(t)) & (F.col(time_col) < hi.cast(t)))
    if day_col is not None:
        out = out.where((F.col(day_col) >= lo) & (F.col(day_col) < hi))
    return out


def day_counts(df: DataFrame, time_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rows per UTC day (A1).  Partial aggregation keeps the shuffle to one row per day per task."""
    return df.groupBy(*keys, day_of(time_col).alias("day")).agg(F.count(F.lit(1)).alias("n_rows"))


def id_bounds(df: DataFrame, days: DataFrame, time_col: str, id_col: str = "id", lo=None, hi=None) -> DataFrame:
    """Per requested day: ``coalesce(min(id),0)``, ``coalesce(max(id),0)+1`` and row count (A2).

    Empty days still appear with bounds (0, 1).  The per-day aggregate is
    computed once over the slice, then joined to the (small) day list.  Pass
    ``lo``/``hi`` (first day, day after the last) so the range reaches the scan.
    """
    if lo is not None and hi is not None:
        df = day_slice(df, time_col, lo, hi)
    # aggregate first (map-side partial aggregates), then join the per-day result to the day list
    per_day = (
        df.select(day_of(time_col).alias("day"), F.col(id_col).alias("_id"))
        .groupBy("day")
        .agg(F.min("_id").alias("_lo"), F.max("_id").alias("_hi"), F.count(F.lit(1)).alias("n_rows"))
    )
    return days.select("day").join(per_day, "day", "left").select(
        "day",
        F.coalesce(F.col("_lo"), F.lit(0)).cast("long").alias("id_lower"),
        (F.coalesce(F.col("_hi"), F.lit(0)) + 1).cast("long").alias("id_upper"),
        F.coalesce(F.col("n_rows"), F.lit(0)).cast("long").alias("n_rows"),
    )


def oldest_day(df: DataFrame, time_col: str, id_col: str = "id", keys: Sequence[str] = ()) -> DataFrame:
    """UTC day of the lowest-id row (A5, O3): one partial+final aggregate, no sort."""
    return df.groupBy(*keys).agg(F.min_by(day_of(time_col), F.col(id_col)).alias("oldest_day"))


FOOTER_CONF = {"spark.sql.sources.useV1SourceList": "avro,csv,json,kafka,orc,text", "spark.sql.parquet.aggregatePushdown": "true"}


def footer_aggregate(spark: SparkSession, table_path: str, id_col: str, day_col: str = "day") -> DataFrame:
    """Plan of (day, n_rows, lo, hi) of a ``day=`` partitioned Parquet table; needs ``FOOTER_CONF`` (see footer_stats)."""
    return spark.read.parquet(table_path).groupBy(day_col).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(id_col).alias("lo"), F.max(id_col).alias("hi"))


def footer_stats(spark: SparkSession, table_path: str, id_col: str, days: Sequence | None = None) -> DataFrame:
    """(day, n_rows, id_lower, id_upper exclusive) of each day, from Parquet footers alone (A1, A2 without a scan).

    The aggregate is pushed into the source and grouped by its partition column, so a task reads the footers of its
    files and no row group; days are pruned by partition.  The settings that allow it hold while the plan runs only;
    the result has a row a day.
    """
    before = {k: spark.conf.get(k, None) for k in FOOTER_CONF}
    try:
        for k, v in FOOTER_CONF.items():
            spark.conf.set(k, v)
        found = footer_aggregate(spark, table_path, id_col)
        rows = (found if days is None else found.where(F.col("day").isin(list(days)))).collect()  # calendar sized
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.createDataFrame([(r["day"], r["n_rows"], r["lo"], r["hi"] + 1 if r["hi"] is not None else None) for r in rows],
                                 "day date, n_rows long, id_lower long, id_upper long")
