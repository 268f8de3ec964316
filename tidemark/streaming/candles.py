"""Tumbling candles from a tick stream, late rows kept out by a watermark.

The batch operator (``operators.candles.ticks_to_candles``) is the contract;
this is the live form.  ``withWatermark`` needs TIMESTAMP (not NTZ), so the
time column is cast first.  In append mode a window is emitted once the
watermark passes its end, so the newest windows stay open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S


def stream_candles(ticks: DataFrame, tf: str, keys: Sequence[str], time_col: str, price_col: str,
                   delay: str = "1 day", id_col: str | None = None) -> DataFrame:
    """Tumbling bars; open and close in (time, id) order, as in the batch operator, if ``id_col`` is given."""
    from tidemark.operators.candles import time_id_key

    ts = ticks.withColumn("_ts", F.col(time_col).cast("timestamp")).withWatermark("_ts", delay)
    order = time_id_key("_ts", id_col) if id_col else F.col("_ts")
    return (
        ts.groupBy(*keys, F.window("_ts", f"{S.TIMEFRAME_SECONDS[tf]} seconds").alias("w"))
        .agg(F.min_by(price_col, order).alias("open"), F.max(price_col).alias("high"),
             F.min(price_col).alias("low"), F.max_by(price_col, order).alias("close"),
             F.count(F.lit(1)).cast("double").alias("volume"), F.count(F.lit(1)).alias("trades"))
        .select(*keys, F.lit(tf).alias("timeframe"), F.col("w.start").cast("timestamp_ntz").alias("open_at"),
                "open", "high", "low", "close", "volume", "trades")
    )


def _partial_bars(rows: DataFrame, tf: str, keys: Sequence[str], time_col: str, price_col: str,
                  id_col: str) -> DataFrame:
    """Bars of one micro-batch, carrying what a later merge needs: open/close order keys and last time."""
    from tidemark.operators.candles import time_id_key

    k = time_id_key(time_col, id_col)
    return (
        rows.groupBy(*keys, F.window(F.col(time_col), f"{S.TIMEFRAME_SECONDS[tf]} seconds").start.alias("open_at"))
        .agg(F.min_by(price_col, k).alias("open"), F.max(price_col).alias("high"), F.min(price_col).alias("low"),
             F.max_by(price_col, k).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
             F.count(F.lit(1)).alias("trades"), F.min(k).alias("open_key"), F.max(k).alias("close_key"),
             F.max(time_col).alias("last_time"))
        .withColumn("timeframe", F.lit(tf))
    )


def start_candle_stream(stream: DataFrame, tf: str, keys: Sequence[str], time_col: str, price_col: str,
                        id_col: str, bars_path: str, late_path: str, checkpoint: str, delay_seconds: int = 86400,
                        trigger: dict | None = None):
    """L5 with late rows kept aside, exactly once under ``foreachBatch`` replay.

    Each micro-batch writes the partial bars of its on-time rows into its own
    ``batch_id`` partition (overwrite), and its late rows -- older than the
    high-water mark of all earlier batches minus ``delay_seconds`` -- into the
    late sink the same way.  The mark is kept beside the bars, one row per
    batch holding the mark after it, so a batch reads only its predecessor's
    row and its cost does not grow with the stream.  A replayed batch sees the
    same predecessor, so it rewrites exactly the same output.  ``read_stream_candles`` merges
    the partials on read (OHLC merges are associative given the order keys).
    """
    marks = f"{bars_path.rstrip('/')}-marks"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev = None
        if batch_id > 0:  # batch ids are consecutive from 0; a missing or damaged mark is an error
            prev = spark.read.parquet(f"{marks}/batch_id={batch_id - 1}").first()["mark"]
        t = batch.schema[time_col].dataType
        late = (F.col(time_col) < (F.lit(prev).cast(t) - F.expr(f"interval {int(delay_seconds)} seconds"))
                if prev is not None else F.lit(False))
        flagged = batch.withColumn("_late", late).cache()
        try:
            (flagged.where("_late").drop("_late").withColumn("batch_id", F.lit(batch_id).cast("long"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
             .parquet(late_path))
            (_partial_bars(flagged.where(~F.col("_late")), tf, keys, time_col, price_col, id_col)
             .withColumn("batch_id", F.lit(batch_id).cast("long"))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
             .parquet(bars_path))
            top = flagged.where(~F.col("_late")).agg(F.max(time_col).alias("mark")).select(
                F.greatest(F.col("mark"), F.lit(prev).cast(t)).alias("mark"))
            top.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")
        finally:
            flagged.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def read_stream_candles(spark, bars_path: str, keys: Sequence[str]) -> DataFrame:
    """Bars as of now: merge every batch's partial bars (one aggregate, map-side combined)."""
    p = spark.read.parquet(bars_path)
    return (
        p.groupBy(*keys, "timeframe", "open_at")
        .agg(F.min_by("open", "open_key").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
             F.max_by("close", "close_key").alias("close"), F.sum("volume").alias("volume"),
             F.sum("trades").alias("trades"))
    )


def start_on_time_split(stream: DataFrame, time_col: str, on_time_path: str, late_path: str, checkpoint: str,
                        delay_seconds: int = 86400, trigger: dict | None = None):
    """Part a stream by the mark of its earlier micro-batches, before any state is kept (L5, first half).

    A row older than the highest time of all earlier batches less ``delay_seconds`` goes to the late sink, every other
    row to the on-time table; both are ``batch_id`` partitioned and rewritten alike when a batch is replayed, for its
    mark comes from its predecessor alone (one row a batch, beside the on-time table).  A null time is late.
    """
    marks = f"{on_time_path.rstrip('/')}-marks"

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        t = batch.schema[time_col].dataType
        prev = spark.read.parquet(f"{marks}/batch_id={batch_id - 1}").first()["mark"] if batch_id > 0 else None
        old = F.col(time_col).isNull()
        if prev is not None:
            old = old | (F.col(time_col) < F.lit(prev).cast(t) - F.expr(f"interval {int(delay_seconds)} seconds"))
        flagged = batch.withColumn("_late", old).withColumn("batch_id", F.lit(batch_id).cast("long")).persist()
        try:
            for path, rows in ((late_path, flagged.where("_late")), (on_time_path, flagged.where("not _late"))):
                (rows.drop("_late").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                 .partitionBy("batch_id").parquet(path))
            mark = flagged.agg(F.greatest(F.max(time_col), F.lit(prev).cast(t)).alias("mark"))
            mark.coalesce(1).write.mode("overwrite").parquet(f"{marks}/batch_id={batch_id}")  # one row
        finally:
            flagged.unpersist()

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())


def start_closed_bars(on_time: DataFrame, tf: str, keys: Sequence[str], time_col: str, price_col: str, id_col: str,
                      bars_path: str, checkpoint: str, delay_seconds: int = 86400, trigger: dict | None = None):
    """Bars of an on-time stream, each written once when the watermark passes its end (L5, second half).

    Open bars live in the state store, one row a (key, bar), partially aggregated before the shuffle; append mode
    and the file sink give every closed bar exactly once.  ``on_time`` comes from ``start_on_time_split`` with the
    same delay: this stream has seen no more batches than the split had when it let a row through, so its watermark
    is never ahead of the split's mark and no row is dropped here (``rows_dropped``).
    """
    bars = stream_candles(on_time, tf, keys, time_col, price_col, f"{int(delay_seconds)} seconds", id_col)
    return (bars.writeStream.outputMode("append").format("parquet").option("path", bars_path)
            .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())


def rows_dropped(query) -> int:
    """Rows that the finished query's state operators dropped behind their watermark, over its recent batches."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])
