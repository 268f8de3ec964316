"""Candles: ticks to bars, higher-timeframe synthesis, SCD2 versions, lookback
(A9 A10 F3 F4 F5 W5)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.exprs import sentinel_for
from tidemark.operators.calendar import _date

CANDLE_VALUE_COLUMNS = ["open", "high", "low", "close", "volume", "trades"]


def _interval(tf: str) -> str:
    return f"{S.TIMEFRAME_SECONDS[tf]} seconds"


def _bucket_start(time_col: str, tf: str) -> Column:
    """Start of the tumbling bucket (aligned to the epoch, hence to UTC midnight for <= 1d)."""
    return F.window(F.col(time_col), _interval(tf)).start


def time_id_key(time_col: str, id_col: str) -> Column:
    """Exact (time, id) order as one decimal(38,0): micros * 10**20 + (id + 2**63).

    A struct ordering key forces a sort-based aggregate; a decimal key keeps
    ``min_by``/``max_by`` in the hash aggregate with a map-side combine.
    Fits 38 digits for any timestamp before year 5000 and any signed long id.
    """
    micros = F.unix_micros(F.col(time_col).cast("timestamp")).cast("decimal(38,0)")
    ident = F.col(id_col).cast("decimal(38,0)") + F.lit(str(2 ** 63)).cast("decimal(38,0)")
    return (micros * F.lit("1" + "0" * 20).cast("decimal(38,0)") + ident).cast("decimal(38,0)")


def ticks_to_candles(ticks: DataFrame, tf: str, keys: Sequence[str], time_col: str, price_col: str,
                     id_col: str | None = None, size_col: str | None = None) -> DataFrame:
    """OHLCV bars from ticks (A10).

    open/close are the prices of the first/last tick in (time, id) order;
    ``volume`` is the summed size, or the tick count when ticks carry no size.
    ``min_by``/``max_by`` aggregate partially on the map side, so a hot
    instrument is reduced before the shuffle.
    """
    order = time_id_key(time_col, id_col) if id_col else F.col(time_col)
    vol = F.sum(size_col).cast("double") if size_col else F.count(F.lit(1)).cast("double")
    return (
        ticks.groupBy(*keys, _bucket_start(time_col, tf).alias("open_at"))
        .agg(F.min_by(price_col, order).alias("open"), F.max(price_col).alias("high"),
             F.min(price_col).alias("low"), F.max_by(price_col, order).alias("close"),
             vol.alias("volume"), F.count(F.lit(1)).alias("trades"))
        .withColumn("timeframe", F.lit(tf))
        .select(*keys, "timeframe", "open_at", *CANDLE_VALUE_COLUMNS)
    )


def _bucket_of(col: Column, seconds: Column, like) -> Column:
    """Start of the ``seconds``-wide bucket holding ``col``, aligned to the epoch (UTC midnight for <= 1d)."""
    secs = F.unix_seconds(col.cast("timestamp"))
    return F.timestamp_seconds(F.floor(secs / seconds) * seconds).cast(like)


def synthesize_candles(c1m: DataFrame, keys: Sequence[str], timeframes: Sequence[str] = S.DERIVED_TIMEFRAMES,
                       start=None, end=None, cut_date=None) -> DataFrame:
    """Derive higher timeframes from 1m bars only.

    * 1m rows are read inside [start, end] (whole UTC days, end inclusive);
      of an SCD2 table (a ``known_to`` column) only active versions.
    * Every timeframe here nests inside one UTC day, so the 1m bars are hash
      partitioned once on (keys, day) -- a (key, day) holds at most 1440
      bars however hot the instrument -- and each bar is exploded into the
      timeframes it feeds.  Grouping by (keys, day, timeframe, bucket) is
      satisfied by that partitioning: all timeframes come out of ONE
      exchange and one aggregation stage.
    * open/close are taken by bar time (min_by/max_by), so the result equals
      aggregating the ticks directly at each timeframe (checked in tests).
    * 1d bars opening before ``cut_date`` are not emitted, so a synthesized
      bar never overwrites a native one; asking for 1d without it is an error.
    """
    if "1d" in timeframes and cut_date is None:
        raise ValueError("cut_date is required when 1d is requested")
    for tf in timeframes:
        if S.TIMEFRAME_SECONDS[tf] > 86400 or 86400 % S.TIMEFRAME_SECONDS[tf]:
            raise ValueError(f"timeframe {tf} does not nest inside a UTC day")
    like = c1m.schema["open_at"].dataType
    src = c1m.where(F.col("timeframe") == "1m") if "timeframe" in c1m.columns else c1m
    if "known_to" in c1m.columns:
        src = src.where(F.col("known_to") == sentinel_for(c1m, "known_to"))
    if start is not None:
        src = src.where(F.col("open_at") >= _date(start).cast(like))
    if end is not None:
        src = src.where(F.col("open_at") < F.date_add(_date(end), 1).cast(like))
    base = src.select(*keys, "open_at", *CANDLE_VALUE_COLUMNS, F.to_date("open_at").alias("_day")) \
        .repartition(*keys, "_day")
    tfs = F.array(*[F.struct(F.lit(tf).alias("tf"), F.lit(S.TIMEFRAME_SECONDS[tf]).alias("secs"))
                    for tf in timeframes])
    x = base.select("*", F.explode(tfs).alias("_t"))
    out = (
        x.groupBy(*keys, "_day", F.col("_t.tf").alias("timeframe"),
                  _bucket_of(F.col("open_at"), F.col("_t.secs"), like).alias("_bucket"))
        .agg(F.min_by("open", "open_at").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
             F.max_by("close", "open_at").alias("close"), F.sum("volume").alias("volume"),
             F.sum("trades").alias("trades"))
        .withColumnRenamed("_bucket", "open_at")
    )
    if "1d" in timeframes:
        out = owned_from(out, cut_date)
    return out.select(*keys, "timeframe", "open_at", *CANDLE_VALUE_COLUMNS)


def close_versions(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], from_col: str = "known_from",
                   to_col: str = "known_to", parts: int | None = None) -> DataFrame:
    """SCD2: each version is known until the next version of its key starts.

    ``order_cols`` must be a total order within a key (ties in ``from_col``
    are broken by the remaining columns), so exactly one version per key
    stays active with the sentinel.  A zero-length version is still closed.

    One path for every key, however many versions it has: rows are range
    partitioned on (keys, order) and cut by a reliable checkpoint so that
    partition ids are stable; ``lead`` runs within (key, partition), and the
    last version of a key in a partition takes the first version of the
    key's next partition.  Only keys that span partitions need that: at most
    one per boundary, so the table of firsts is bounded by the partitions.
    """
    from tidemark.session import SORT_PART_BYTES, partitions_for, pinned_rows

    n = parts or partitions_for(df, SORT_PART_BYTES)
    ranged = pinned_rows(df.repartitionByRange(n, *keys, *order_cols).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *keys).orderBy(*order_cols)
    led = ranged.withColumn("_lead", F.lead(from_col).over(w))
    # the first row of every partition, and where its key goes on from the partition before
    first = ranged.groupBy("_pid").agg(F.min_by(F.struct(*keys, F.col(from_col).alias("_next")),
                                                F.struct(*keys, *order_cols)).alias("_f")).select("_pid", "_f.*")
    onward = first.withColumn("_owner", F.lag("_pid").over(Window.orderBy("_pid")))
    carry = onward.select(*keys, F.col("_owner").alias("_pid"), "_next").where("_pid is not null")
    same = [led[k].eqNullSafe(carry[k]) for k in keys]
    joined = led.join(F.broadcast(carry), (led["_pid"] == carry["_pid"]), "left")
    hit = same[0]
    for c in same[1:]:
        hit = hit & c
    to = F.coalesce(led["_lead"], F.when(hit, carry["_next"]), sentinel_for(df, from_col))
    return joined.select(*[led[c] for c in df.columns if c != to_col], to.alias(to_col))


def scd2_upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], value_cols: Sequence[str], at,
                from_col: str = "known_from", to_col: str = "known_to") -> DataFrame:
    """Merge a batch of current values into an SCD2 table (the upsert that closes versions).

    For each key of ``incoming``: no active version -> insert it from ``at``;
    an active version with different values (null-safe) -> close it at
    ``at`` and insert the new one; same values -> keep the active version.
    Closed versions, rows with a NULL ``to_col`` and keys absent from
    ``incoming`` are kept as they are (a batch is partial; it never deletes).
    Several incoming rows of a key count as one (``one_per_key``), so a key
    never gets two active versions.  One full outer join of the
    active rows with the batch on the keys; callers that write day
    partitions restrict ``current`` to the batch's days first, so untouched
    days are neither read nor rewritten.
    """
    sentinel = sentinel_for(current, to_col)
    at_c = (F.lit(at) if isinstance(at, str) else at).cast(current.schema[from_col].dataType)
    active = current.where(F.col(to_col) == sentinel)
    closed = current.where(~F.col(to_col).eqNullSafe(sentinel))
    incoming = one_per_key(incoming, keys, value_cols)
    a = active.select(*keys, *[F.col(c).alias("_a_" + c) for c in value_cols], F.col(from_col).alias("_a_from"),
                      F.lit(True).alias("_a"))
    n = incoming.select(*keys, *[F.col(c).alias("_n_" + c) for c in value_cols], F.lit(True).alias("_n"))
    j = a.join(n, list(keys), "full_outer")
    same = F.lit(True)
    for c in value_cols:
        same = same & F.col("_a_" + c).eqNullSafe(F.col("_n_" + c))
    has_a, has_n = F.col("_a").isNotNull(), F.col("_n").isNotNull()
    keep = j.where(has_a & (~has_n | same)).select(
        *keys, *[F.col("_a_" + c).alias(c) for c in value_cols], F.col("_a_from").alias(from_col),
        sentinel.alias(to_col))
    close = j.where(has_a & has_n & ~same).select(
        *keys, *[F.col("_a_" + c).alias(c) for c in value_cols], F.col("_a_from").alias(from_col),
        at_c.alias(to_col))
    insert = j.where(has_n & (~has_a | ~same)).select(
        *keys, *[F.col("_n_" + c).alias(c) for c in value_cols], at_c.alias(from_col), sentinel.alias(to_col))
    cols = [*keys, *value_cols, from_col, to_col]
    return closed.select(*cols).unionByName(keep).unionByName(close).unionByName(insert)


def one_per_key(batch: DataFrame, keys: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    """One row per key: of several, the one with the largest values, compared column by column, nulls lowest."""
    best = F.max(F.struct(*[F.col(c) for c in value_cols])).alias("_v")
    return batch.groupBy(*keys).agg(best).select(*keys, "_v.*")


def closed_in_range(df: DataFrame, time_col: str, lo_day, hi_day, to_col: str = "known_to",
                    day_col: str | None = None) -> Column:
    """Condition of F4: moved off the sentinel, and ``time_col`` in [lo_day, hi_day]; ``day_col`` adds a partition filter."""
    t = df.schema[time_col].dataType
    rule = ((F.col(to_col) < sentinel_for(df, to_col)) & (F.col(time_col) >= _date(lo_day).cast(t))
            & (F.col(time_col) < F.date_add(_date(hi_day), 1).cast(t)))
    return rule & F.col(day_col).between(_date(lo_day), _date(hi_day)) if day_col else rule


def closed_versions(df: DataFrame, time_col: str, lo_day, hi_day, timeframe: str | None = None,
                    to_col: str = "known_to", day_col: str | None = None) -> DataFrame:
    """Versions already moved off the sentinel, ranged on the bar's own time.

    The range is on ``time_col`` (open_at), not on when the version closed: a
    bar re-closed yesterday for an old day lives in the old day's slice.
    ``day_col`` prunes a table partitioned by that time's UTC day.
    """
    out = df.where(closed_in_range(df, time_col, lo_day, hi_day, to_col, day_col))
    return out if timeframe is None else out.where(F.col("timeframe") == timeframe)


def owned_from(bars: DataFrame, cut_date) -> DataFrame:
    """Drop derived 1d bars opening before ``cut_date``."""
    t = bars.schema["open_at"].dataType
    return bars.where((F.col("timeframe") != "1d") | (F.col("open_at") >= _date(cut_date).cast(t)))


def lookback_since(sources: DataFrame, now, floor: int = S.MIN_LOOKBACK_DAYS) -> DataFrame:
    """Per source: whole days since its last snapshot plus one, at least ``floor``.

    ``sources`` has (source, last_epoch) with last_epoch in seconds or null
    (unknown -> gap 0, so the floor applies).  ``since = day(now) - lookback``.
    """
    now_ts = F.to_timestamp(F.lit(now)) if isinstance(now, str) else now
    now_epoch = F.unix_seconds(now_ts)
    gap = F.coalesce(F.floor((now_epoch - F.col("last_epoch")) / 86400).cast("long") + 1, F.lit(0).cast("long"))
    lookback = F.greatest(gap, F.lit(floor).cast("long"))
    return sources.select(
        "source", "last_epoch", gap.alias("gap_days"), lookback.alias("lookback_days"),
        F.date_sub(F.to_date(now_ts), lookback.cast("int")).alias("since"),
    )
