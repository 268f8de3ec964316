"""Calendar and leaf-coverage operators.

A *leaf* is one (keys..., day) pair that has its own daily partition.  Every
operator is keyed, so one job answers for all tables (or, from a fact table,
for every (exchange, instrument, timeframe)) at once.  Calendars are generated
per key with ``sequence``; their size is keys x window days, never data sized.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.exprs import as_col


def _date(v) -> Column:
    if isinstance(v, Column):
        return v
    if isinstance(v, (dt.date, dt.datetime)):
        v = v.isoformat()[:10]
    return F.to_date(F.lit(v))


def day_sequence(lo, hi) -> Column:
    """All days in [lo, hi] inclusive (U4)."""
    return F.explode(F.sequence(_date(lo), _date(hi), F.expr("interval 1 day")))


def scope(keys_df: DataFrame, today, back, fwd, keys: Sequence[str] = ("table_name",)) -> DataFrame:
    """One row per key with its calendar window [today-back, today+fwd].

    ``back``/``fwd`` are ints or column names present in ``keys_df`` (per-key
    buffers, e.g. from a table config).  Both ends are inclusive.
    """
    t = _date(today)
    back_c = F.col(back) if isinstance(back, str) else F.lit(int(back))
    fwd_c = F.col(fwd) if isinstance(fwd, str) else F.lit(int(fwd))
    return (
        keys_df.select(*keys, back_c.alias("_back"), fwd_c.alias("_fwd")).distinct()
        .select(*keys, F.date_sub(t, F.col("_back")).alias("lo"), F.date_add(t, F.col("_fwd")).alias("hi"))
    )


def calendar(scope_df: DataFrame, keys: Sequence[str] = ("table_name",)) -> DataFrame:
    """Expand a scope (keys, lo, hi) into (keys, day) rows."""
    return scope_df.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("day"))


def leaf_catalog(names: DataFrame, name_col: str = "leaf_name", table_col: str = "table_name") -> DataFrame:
    """Parse leaf names ``<table>_dYYYYMMDD`` into (table_name, leaf_name, day).

    Names that do not follow the pattern, or carry an impossible date, are dropped.
    """
    pattern = F.concat(F.lit("^"), F.col(table_col), F.lit("_d[0-9]{8}$"))
    day = F.try_to_date(F.right(F.col(name_col), F.lit(8)), "yyyyMMdd")
    return (
        names.where(F.coalesce(F.regexp(F.col(name_col), pattern), F.lit(False)))
        .select(F.col(table_col).alias("table_name"), F.col(name_col).alias("leaf_name"), day.alias("day"))
        .where(F.col("day").isNotNull())
    )


def missing_days(leaf: DataFrame, scope_df: DataFrame, keys: Sequence[str] = ("table_name",)) -> DataFrame:
    """Days of each key's window that have no leaf, oldest first."""
    have = leaf.select(*keys, "day").distinct()
    return (
        calendar(scope_df, keys)
        .join(have, [*keys, "day"], "left_anti")
        .orderBy(*keys, "day")
    )


def ledger_days(ledger: DataFrame, keys: Sequence[str] = ("table_name",)) -> DataFrame:
    """Distinct valid days named by a ledger (U2); unparseable day text is ignored."""
    return (
        ledger.select(*keys, F.try_to_date(F.col("day").cast("string"), "yyyy-MM-dd").alias("day"))
        .where(F.col("day").isNotNull())
        .distinct()
    )


def drop_archived_days(missing: DataFrame, archived: DataFrame, keys: Sequence[str] = ("table_name",)) -> DataFrame:
    """Missing days minus days already in the archive ledger: never resurrect."""
    return missing.join(archived.select(*keys, "day"), [*keys, "day"], "left_anti")


def anchor_fold(sorted_days: Column, step: int = S.ANCHOR_STEP_DAYS) -> Column:
    """Greedy cover of a sorted day array: the first uncovered day opens an anchor for ``day..day+step-1``."""
    acc0 = F.struct(
        F.array().cast("array<date>").alias("anchors"),
        F.lit(None).cast("date").alias("until"),
    )

    def step_fn(acc, d):
        opens = acc["until"].isNull() | (d > acc["until"])
        return F.when(
            opens,
            F.struct(F.concat(acc["anchors"], F.array(d)).alias("anchors"), F.date_add(d, step - 1).alias("until")),
        ).otherwise(acc)

    return F.aggregate(sorted_days, acc0, step_fn, lambda a: a["anchors"])


def cover_anchors(missing: DataFrame, keys: Sequence[str] = ("table_name",), step: int = S.ANCHOR_STEP_DAYS) -> DataFrame:
    """Greedy minimal interval cover of the missing days.

    Walking days in order, the first uncovered day opens an anchor covering
    ``day .. day+step-1``.  The fold runs per key over that key's missing days,
    which lie inside the key's calendar window, so the per-key list is
    bounded by the window no matter how large the tables are.
    """
    return (
        missing.groupBy(*keys)
        .agg(F.sort_array(F.collect_set("day")).alias("_days"))
        .select(*keys, F.explode(anchor_fold(F.col("_days"), step)).alias("anchor"))
        .select(*keys, "anchor", F.date_add("anchor", step - 1).alias("covers_until"))
    )


def contiguous_runs(leaf: DataFrame, keys: Sequence[str] = ("table_name",)) -> DataFrame:
    """Islands of consecutive leaf days per key.

    ``day - row_number()`` is constant along an island.  The window partition
    is one key's distinct days (calendar sized, not data sized).
    """
    d = leaf.select(*keys, "day").distinct()
    w = Window.partitionBy(*keys).orderBy("day")
    return (
        d.withColumn("_island", F.date_sub("day", F.row_number().over(w).cast("int")))
        .groupBy(*keys, "_island")
        .agg(F.min("day").alias("run_start"), F.max("day").alias("run_end"), F.count(F.lit(1)).alias("n_days"))
        .drop("_island")
    )


def forward_headroom(leaf: DataFrame, keys_df: DataFrame, today, keys: Sequence[str] = ("table_name",),
                     lookahead: int = S.HEADROOM_LOOKAHEAD_DAYS) -> DataFrame:
    """Contiguous leaf days from today up to the first missing day.

    A gap is never counted as depth.  When no day in [today, today+lookahead]
    is missing, the depth is reported as lookahead+1 with ``capped = true``.
    Keys of ``keys_df`` with no leaf at today get 0.
    """
    t = _date(today)
    runs = contiguous_runs(leaf, keys).where((F.col("run_start") <= t) & (F.col("run_end") >= t))
    depth = F.datediff(F.col("run_end"), t) + 1
    capped = F.coalesce(depth > lookahead, F.lit(False))
    return (
        keys_df.select(*keys).distinct()
        .join(runs, list(keys), "left")
        .select(
            *keys,
            F.when(capped, F.lit(lookahead + 1)).otherwise(F.coalesce(depth, F.lit(0))).cast("long").alias("headroom"),
            capped.alias("capped"),
        )
    )


def eligible_days(days: DataFrame, today, horizon: int = S.RETENTION_HORIZON_DAYS) -> DataFrame:
    """Days at or before ``today - horizon``; the cutoff day itself is eligible (F8)."""
    return days.where(F.col("day") <= F.date_sub(_date(today), horizon))


def oldest_first(days: DataFrame, n: int, keys: Sequence[str] = ("table_name",)) -> DataFrame:
    """At most ``n`` days per key, oldest first."""
    w = Window.partitionBy(*keys).orderBy("day")
    return days.withColumn("seq", F.row_number().over(w)).where(F.col("seq") <= n)


def exact_day_bound(children: DataFrame, lower: str = "bound_lower", upper: str = "bound_upper") -> Column:
    """A child whose bound is exactly one UTC day (F10): lower is a midnight and upper = lower + 1 day."""
    lo, up = as_col(lower), as_col(upper)
    return (lo == F.to_date(lo).cast(children.schema[lower].dataType)) & (
        up == F.date_add(F.to_date(lo), 1).cast(children.schema[upper].dataType)
    )


def backward_window(config: DataFrame, horizon: int = S.RETENTION_HORIZON_DAYS) -> DataFrame:
    """Per-table backward buffer; retention-purged tables are clamped to horizon-1 (L3).

    ``config`` has (table_name, back_days, purged_by_retention).
    """
    clamp = F.col("purged_by_retention") & (F.col("back_days") >= horizon)
    return config.withColumn("back", F.when(clamp, F.lit(horizon - 1)).otherwise(F.col("back_days"))).withColumn(
        "clamped", clamp
    )
