"""Reading whole UTC days of a day-partitioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.exprs import day_of
from tidemark.operators.slices import day_slice, pinned_projection


def read_days(df: DataFrame, time_col: str, lo_day, hi_day, leaf: DataFrame, table: str,
              day_col: str | None = None) -> DataFrame:
    """Rows of whole UTC days in [lo_day, hi_day) that have a leaf.

    The timestamp range (and the ``day`` partition column when present) is
    pushed to the scan; the leaf semi join keeps days without their own leaf
    out, so a dropped day can never look like an empty one.
    """
    from tidemark.operators.joins import day_side

    rows = day_slice(df, time_col, lo_day, hi_day, day_col)
    days = day_side(leaf.where(F.col("table_name") == table).select("day"))
    return rows.join(days, day_of(time_col) == days["day"], "left_semi")


def read_trades(df: DataFrame, lo_day, hi_day, time_col: str = "executed_at") -> DataFrame:
    """Pinned 12 columns of trades, sliced by event time."""
    return pinned_projection(day_slice(df, time_col, lo_day, hi_day), S.TRADE_COLUMNS_V1)


def table_leaves(spark, table_path: str, table: str) -> DataFrame:
    """Leaf catalog of a day-partitioned table from its ``day=YYYY-MM-DD`` folders (S9 for files).

    A metadata listing on the driver: one entry per day folder, i.e.
    calendar sized.  For a catalog table use ``SHOW PARTITIONS`` and
    ``operators.calendar.leaf_catalog`` instead.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(table_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    if fs.exists(root):
        for st in fs.listStatus(root):
            n = st.getPath().getName()
            if st.isDirectory() and n.startswith("day="):
                names.append((n[4:],))
    days = spark.createDataFrame(names, "d string")
    return days.select(F.lit(table).alias("table_name"), F.try_to_date("d", "yyyy-MM-dd").alias("day")) \
        .where(F.col("day").isNotNull()).select(
            "table_name", F.concat(F.lit(table + "_d"), F.date_format("day", "yyyyMMdd")).alias("leaf_name"), "day")


def catalog_leaves(spark, table_name: str, table: str) -> DataFrame:
    """Leaf catalog of a catalog table partitioned by ``day``: ``SHOW PARTITIONS`` parsed."""
    parts = spark.sql(f"SHOW PARTITIONS {table_name}")
    day = F.try_to_date(F.regexp_extract(F.col("partition"), r"(?:^|/)day=([0-9]{4}-[0-9]{2}-[0-9]{2})(?:/|$)", 1),
                        "yyyy-MM-dd")
    return parts.select(F.lit(table).alias("table_name"), day.alias("day")).where(F.col("day").isNotNull()) \
        .select("table_name", F.concat(F.lit(table + "_d"), F.date_format("day", "yyyyMMdd")).alias("leaf_name"),
                "day")


def children_of(leaves: DataFrame, with_default: bool = True) -> DataFrame:
    """Partition-catalog rows (bounds per leaf, plus a DEFAULT) for ``resolve_purge_target``."""
    ordinary = leaves.select("table_name", "leaf_name", F.lit("r").alias("kind"), F.lit(False).alias("is_default"),
                             F.col("day").cast("timestamp_ntz").alias("bound_lower"),
                             F.date_add("day", 1).cast("timestamp_ntz").alias("bound_upper"))
    if not with_default:
        return ordinary
    default = leaves.select("table_name").distinct().select(
        "table_name", F.concat("table_name", F.lit("_default")).alias("leaf_name"), F.lit("r").alias("kind"),
        F.lit(True).alias("is_default"), F.lit(None).cast("timestamp_ntz").alias("bound_lower"),
        F.lit(None).cast("timestamp_ntz").alias("bound_upper"))
    return ordinary.unionByName(default)
