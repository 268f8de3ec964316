"""Vendor minute-candle CSV cache: one ``YYYY-MM-DD.csv`` per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators.calendar import _date
from tidemark.operators.candles import CANDLE_VALUE_COLUMNS, one_per_key


def load_candle_csv(spark: SparkSession, path: str, since, venue: str = "vendor") -> DataFrame:
    """Base 1m rows of every cached day from ``since`` on.

    The day comes from the file name (``YYYY-MM-DD.csv``) or its ``day=``
    folder, via ``_metadata.file_path``; the ``since`` filter on it prunes
    whole files before any row is parsed.  A bar that several files hold is
    one row (``one_per_key``).
    """
    df = (
        spark.read.schema(S.CANDLE_CSV_SCHEMA).option("header", True).option("mode", "FAILFAST")
        .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").option("recursiveFileLookup", True).csv(path)
        .withColumn("_file_day", F.try_to_date(
            F.regexp_extract(F.col("_metadata.file_path"), r"(?:/|day=)([0-9]{4}-[0-9]{2}-[0-9]{2})(?:\.csv$|/)", 1),
            "yyyy-MM-dd"))
    )
    bars = df.where(F.col("_file_day") >= _date(since)).select(
        F.lit(venue).alias("exchange"), F.col("symbol").alias("instrument"), F.lit("1m").alias("timeframe"),
        F.col("open_at").cast("timestamp_ntz").alias("open_at"), "open", "high", "low", "close", "volume",
        F.lit(None).cast("long").alias("trades"))
    return one_per_key(bars, ["exchange", "instrument", "timeframe", "open_at"], CANDLE_VALUE_COLUMNS)


def write_candle_csv(bars: DataFrame, path: str) -> None:
    """Write 1m bars as the cache layout: one CSV per UTC day (used to build caches from data)."""
    out = bars.select(F.col("instrument").alias("symbol"),
                      F.date_format("open_at", "yyyy-MM-dd HH:mm:ss").alias("open_at"),
                      "open", "high", "low", "close", "volume",
                      F.to_date("open_at").alias("day"))
    out.repartition("day").write.mode("error").partitionBy("day").option("header", True).csv(path)
