"""Run logs as (file, line_no, line)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.prefix import prefix_sum


def _text_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("_mtime"),
        F.col("_metadata.file_block_start").alias("_blk"), F.monotonically_increasing_id().alias("_rid"),
        F.col("value").alias("line"), F.lit(1).cast("long").alias("_one"))


def read_appended_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a folder written by repeated appends, numbered across all its parts in append order.

    An append's parts lie in a folder named by its number (``seq=...``), which
    a copy of the ledger keeps.  Parts outside such folders come first, by
    modification time and name.
    """
    raw = _text_rows(spark, path)
    seq = F.regexp_extract("file", r"/seq=([0-9]+)/", 1)
    raw = raw.withColumn("_all", F.lit(0)).withColumn("_seq", seq).withColumn(
        "_when", F.when(seq == "", F.unix_micros("_mtime")).otherwise(F.lit(0)))
    numbered = prefix_sum(raw, ["_all"], "_rid", "_one", "line_no", major=["_seq", "_when", "file", "_blk"])
    return numbered.select("file", "line_no", "line")


def read_run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Every log line with its 1-based line number within its file; ``file`` is the whole path.

    Lines are read as ordinary text rows, so a large log is split across
    many tasks.  Line order is (split start offset, row id); the number is a
    running count in that order, computed with the ranged prefix scan
    (no whole-file window, no whole-file row).
    """
    raw = _text_rows(spark, path)
    numbered = prefix_sum(raw, ["file"], "_rid", "_one", "line_no", major=["_blk"])
    return numbered.select("file", "line_no", "line")
