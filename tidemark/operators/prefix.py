"""Prefix scans that stay parallel when one key holds most of the rows.

A plain ``Window.partitionBy(key).orderBy(o)`` puts a whole key on one task.
Here the rows are range partitioned on (key, order): Spark draws the ranges
from the data's own quantiles, so they are even whether the ordering values
are dense, sparse or clustered, and a hot key spreads over many ranges.  A
reliable checkpoint pins each row's range number.  Every (key, range) is
scanned by its own window task, and what precedes a range is carried in from
a table with one row per (key, range): a key has at most as many of those as
there are ranges, whatever its number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import SORT_PART_BYTES, partitions_for, pinned_rows


def ranged(df: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """``df`` range partitioned on ``keys``, with the range number ``_bk`` pinned by a reliable checkpoint.

    The number of ranges follows the bytes that the plan's scans list (about ``SORT_PART_BYTES`` each).  The checkpoint
    is a full copy: settle what is wanted of it within ``session.scratch_checkpoints``, which deletes it.
    """
    n = parts or partitions_for(df, SORT_PART_BYTES)
    return pinned_rows(df.repartitionByRange(n, *keys).withColumn("_bk", F.spark_partition_id()))


def _before(*part: str):
    return Window.partitionBy(*part).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)


def prefix_max_before(df: DataFrame, part: Sequence[str], order_col: str, value_col: str, out: str,
                      parts: int | None = None) -> DataFrame:
    """``out`` = max(value_col) over rows of the same ``part`` with a smaller ``order_col``."""
    b = ranged(df, [*part, order_col], parts)
    per = b.groupBy(*part, "_bk").agg(F.max(value_col).alias("_bv"))
    carry = per.select(*part, "_bk", F.max("_bv").over(_before(*part)).alias("_carry"))
    wi = Window.partitionBy(*part, "_bk").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    return (
        b.join(carry, [*part, "_bk"], "left")
        .withColumn(out, F.greatest(F.col("_carry"), F.max(value_col).over(wi)))
        .drop("_bk", "_carry")
    )


def prefix_sum(df: DataFrame, part: Sequence[str], order_col: str, value_col: str, out: str,
               parts: int | None = None, inclusive: bool = True, major: Sequence[str] = ()) -> DataFrame:
    """``out`` = running sum of ``value_col`` in (``major``..., ``order_col``) order within ``part``."""
    b = ranged(df, [*part, *major, order_col], parts)
    per = b.groupBy(*part, "_bk").agg(F.sum(value_col).alias("_bv"))
    carry = per.select(*part, "_bk", F.coalesce(F.sum("_bv").over(_before(*part)), F.lit(0)).alias("_carry"))
    wi = Window.partitionBy(*part, "_bk").orderBy(*major, order_col).rowsBetween(Window.unboundedPreceding,
                                                                                 0 if inclusive else -1)
    return (
        b.join(carry, [*part, "_bk"], "left")
        .withColumn(out, F.col("_carry") + F.coalesce(F.sum(value_col).over(wi), F.lit(0)))
        .drop("_bk", "_carry")
    )


def rows_since(df: DataFrame, part: Sequence[str], order_col: str, reset_col: str, out: str,
               parts: int | None = None) -> DataFrame:
    """``out`` = rows of the same ``part`` after the last one with ``reset_col`` true, the row itself included (0 for it).

    One ranged scan: places and resets are counted within each range, and the length of the run that is open where a
    range begins comes from one row a range.
    """
    b = ranged(df, [*part, order_col], parts)
    w = Window.partitionBy(*part, "_bk").orderBy(order_col)
    nth = b.withColumn("_nth", F.row_number().over(w).cast("long"))
    local = nth.withColumn("_at", F.max(F.when(F.col(reset_col), F.col("_nth"))).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    per = nth.groupBy(*part, "_bk").agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col(reset_col), F.col("_nth"))).alias("_at"))
    before = per.withColumn("_base", F.coalesce(F.sum("_n").over(_before(*part)), F.lit(0)))
    carry = before.select(*part, "_bk", (F.col("_base") - F.coalesce(
        F.max(F.col("_base") + F.col("_at")).over(_before(*part)), F.lit(0))).alias("_open"))
    return local.join(carry, [*part, "_bk"], "left").withColumn(
        out, F.coalesce(F.col("_nth") - F.col("_at"), F.col("_nth") + F.col("_open"))).drop("_bk", "_nth", "_at", "_open")


def top_n_per_group(df: DataFrame, part: Sequence[str], order_col: str, n: int, out: str = "rank_desc",
                    parts: int | None = None) -> DataFrame:
    """Last ``n`` rows by ``order_col`` within each ``part``: the last n of every range, then of the few that are left."""
    b = ranged(df, [*part, order_col], parts)
    w1 = Window.partitionBy(*part, "_bk").orderBy(F.col(order_col).desc())
    few = b.withColumn("_r", F.row_number().over(w1)).where(F.col("_r") <= n).drop("_r", "_bk")
    w2 = Window.partitionBy(*part).orderBy(F.col(order_col).desc())
    return few.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= n)
