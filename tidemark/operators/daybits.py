"""Days per key as bit words, kept by increments (J1, W3, A3 from a fact table at size).

A key's days are bits of 64-bit words, one word a block of 64 days from ``EPOCH``.  Words of new rows are one partially
aggregated ``bit_or`` over those rows alone; an index is the words of all increments, merged by ``bit_or`` again, so a
repeated increment changes nothing and old days are never read a second time.  Gaps, runs and headroom come from bit
arithmetic on one row per (key, block), without a calendar join: a key of a year of days is six words.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import day_of

EPOCH = dt.date(1970, 1, 1)
BITS = 64


def _number(day) -> int:
    return ((day if isinstance(day, dt.date) else dt.date.fromisoformat(day)) - EPOCH).days


def _day(number: Column) -> Column:
    return F.date_add(F.lit(EPOCH), number.cast("int"))


def day_words(df: DataFrame, keys: Sequence[str], time_col: str) -> DataFrame:
    """(keys..., block, word) of the days that ``df`` has rows on; rows without a time set no bit."""
    n = F.datediff(day_of(time_col), F.lit(EPOCH))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(n, F.lit(BITS)).cast("int"))
    return (df.select(*keys, F.floor(n / BITS).cast("int").alias("block"), bit.alias("_bit")).where("block is not null")
            .groupBy(*keys, "block").agg(F.bit_or("_bit").alias("word")))


def add_increment(words: DataFrame, path: str) -> None:
    """Add the words of new rows to an index folder, as a part of its own."""
    words.write.mode("error").parquet(f"{path.rstrip('/')}/inc={uuid.uuid4().hex}")


def read_words(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """One word per (key, block): the increments of an index merged."""
    return spark.read.option("recursiveFileLookup", True).parquet(path).groupBy(*keys, "block").agg(F.bit_or("word").alias("word"))


def compact(spark: SparkSession, path: str, keys: Sequence[str], out: str) -> None:
    """Write an index's increments as one, to a new folder."""
    add_increment(read_words(spark, path, keys), out)


def _set_bits(word: Column) -> Column:
    """The places of a word's set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)),
                    lambda i: F.call_function("shiftrightunsigned", word, i).bitwiseAND(F.lit(1).cast("long")) == 1)


def _mask(lo: Column, hi: Column) -> Column:
    """A word with the places lo..hi set; none if lo > hi."""
    full = F.lit(-1).cast("long")
    up = F.call_function("shiftleft", full, F.greatest(lo, F.lit(0)).cast("int"))
    down = F.call_function("shiftrightunsigned", full, (F.lit(BITS - 1) - F.least(hi, F.lit(BITS - 1))).cast("int"))
    return F.when((lo > hi) | (lo > BITS - 1) | (hi < 0), F.lit(0).cast("long")).otherwise(up.bitwiseAND(down))


def missing_days(words: DataFrame, lo_day, hi_day, keys: Sequence[str]) -> DataFrame:
    """(keys..., day): the days of [lo_day, hi_day] that a key of the index lacks."""
    lo, hi = _number(lo_day), _number(hi_day)
    by_block = F.map_from_entries(F.collect_list(F.struct("block", "word")))  # a word per 64 calendar days
    per = words.groupBy(*keys).agg(by_block.alias("_words"))
    x = per.select(*keys, "_words", F.explode(F.sequence(F.lit(lo // BITS), F.lit(hi // BITS))).alias("_b"))
    gone = F.bitwise_not(F.coalesce(F.try_element_at("_words", F.col("_b")), F.lit(0).cast("long")))
    base = F.col("_b") * BITS
    kept = gone.bitwiseAND(_mask(F.lit(lo) - base, F.lit(hi) - base))
    return x.withColumn("_gone", kept).where(F.col("_gone") != 0).select(
        *keys, "_b", F.explode(_set_bits(F.col("_gone"))).alias("_i")).select(
            *keys, _day(F.col("_i") + F.col("_b") * BITS).alias("day"))


def runs(words: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., run_start, run_end, n_days): the islands of consecutive days of each key.

    A run starts at a set bit whose predecessor is not set and ends at one whose successor is not; the bit across a
    block's edge comes from the neighbouring word.  The k-th start and the k-th end of a key belong together.
    """
    w = Window.partitionBy(*keys).orderBy("block")
    one = F.lit(1).cast("long")
    before = F.when(F.lag("block").over(w) == F.col("block") - 1, F.lag("word").over(w)).otherwise(0)
    after = F.when(F.lead("block").over(w) == F.col("block") + 1, F.lead("word").over(w)).otherwise(0)
    x = words.withColumn("_before", before).withColumn("_after", after)
    word = F.col("word")
    left = F.shiftleft(word, 1).bitwiseOR(F.shiftrightunsigned("_before", BITS - 1).bitwiseAND(one))
    right = F.shiftrightunsigned(word, 1).bitwiseOR(F.shiftleft(F.col("_after").bitwiseAND(one), BITS - 1))
    edge = x.select(*keys, F.col("block").alias("_b"), word.bitwiseAND(F.bitwise_not(left)).alias("_starts"),
                    word.bitwiseAND(F.bitwise_not(right)).alias("_ends"))
    at = [F.transform(_set_bits(F.col(c)), lambda i: i + F.col("_b") * BITS).alias(c) for c in ("_starts", "_ends")]
    per = edge.select(*keys, *at).groupBy(*keys).agg(*[
        F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in ("_starts", "_ends")])  # at most one entry per calendar day
    pair = per.select(*keys, F.explode(F.arrays_zip("_starts", "_ends")).alias("_p"))
    return pair.select(*keys, _day(F.col("_p._starts")).alias("run_start"), _day(F.col("_p._ends")).alias("run_end"),
                       (F.col("_p._ends") - F.col("_p._starts") + 1).cast("long").alias("n_days"))


def headroom(words: DataFrame, today, keys: Sequence[str], lookahead: int = 400) -> DataFrame:
    """(keys..., headroom, capped): consecutive days from ``today`` that a key has; lookahead + 1 if none is missing (A3)."""
    start = today if isinstance(today, dt.date) else dt.date.fromisoformat(today)
    gap = missing_days(words, start, start + dt.timedelta(days=lookahead), keys).groupBy(*keys).agg(F.min("day").alias("_gap"))
    every = words.select(*keys).distinct()
    joined = every.join(gap.select(*[F.col(k).alias(f"_g_{k}") for k in keys], "_gap"),
                        [every[k].eqNullSafe(F.col(f"_g_{k}")) for k in keys], "left")
    return joined.select(*keys, F.coalesce(F.datediff("_gap", F.lit(start)), F.lit(lookahead + 1)).cast("long").alias("headroom"),
                         F.col("_gap").isNull().alias("capped"))
