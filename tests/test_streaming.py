"""Streaming forms: L1 routing in foreachBatch, L5 watermarked candles."""

from pyspark.sql import functions as F

from tidemark.operators import candles as cdl
from tidemark.sources import fixtures as fx
from tidemark.streaming.candles import stream_candles
from tidemark.streaming.routing import start_routing
from tests.conftest import SF01


def _spool(spark, scratch, parts=3):
    """Write the ticks as files appended one after another, so the stream sees them in arrival order."""
    import time

    src = f"{scratch}/in"
    t = fx.ticks(spark, SF01)
    n = t.count()
    for k in range(parts):
        t.where((F.col("id") >= k * n // parts) & (F.col("id") < (k + 1) * n // parts)).coalesce(1) \
            .write.mode("append").parquet(src)
        time.sleep(1.1)  # file source orders by modification time
    return src, spark.read.parquet(src).schema


def test_routing_stream_equals_batch(spark, scratch):
    src, schema = _spool(spark, scratch)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_routing(stream, "bus_time", fx.leaf(spark, SF01), "ticks", f"{scratch}/table", f"{scratch}/default",
                      f"{scratch}/ckpt")
    q.awaitTermination(300)
    assert spark.read.parquet(f"{scratch}/default").count() == 679
    assert spark.read.parquet(f"{scratch}/table").count() == 10000 - 679


def test_stream_candles_closed_windows_match_batch(spark, scratch):
    src, schema = _spool(spark, scratch)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    bars = stream_candles(stream, "1h", ["instrument"], "bus_time", "price")
    q = (bars.writeStream.outputMode("append").format("memory").queryName("live_bars")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    live = spark.table("live_bars")
    batch = cdl.ticks_to_candles(fx.ticks(spark, SF01), "1h", ["instrument"], "bus_time", "price", "id")
    n = live.count()
    assert 0 < n <= batch.count()
    assert live.exceptAll(batch).count() == 0  # every emitted (closed) window equals its batch bar


def test_candle_stream_keeps_late_rows_aside(spark, scratch):
    """Three on-time drops, then old ticks arriving last: bars equal the batch bars of the on-time ticks,
    and every late tick is in the late sink instead of being dropped."""
    import time

    from tidemark.streaming.candles import read_stream_candles, start_candle_stream

    t = fx.ticks(spark, SF01)
    src = f"{scratch}/in"
    for lo, hi in ((1, 10), (11, 20), (21, 30)):
        t.where(F.dayofmonth("bus_time").between(lo, hi)).coalesce(1).write.mode("append").parquet(src)
        time.sleep(1.1)
    late_ticks = t.where(F.dayofmonth("bus_time") <= 3).withColumn("id", F.col("id") + 10_000_000)
    late_ticks.coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = start_candle_stream(stream, "1h", ["instrument"], "bus_time", "price", "id", f"{scratch}/bars",
                            f"{scratch}/late", f"{scratch}/ckpt")
    q.awaitTermination(300)
    bars = read_stream_candles(spark, f"{scratch}/bars", ["instrument"])
    want = cdl.ticks_to_candles(t, "1h", ["instrument"], "bus_time", "price", "id")
    got = bars.select(*want.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    assert spark.read.parquet(f"{scratch}/late").count() == late_ticks.count()
