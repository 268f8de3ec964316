"""Plan shape: the scale properties the operators promise, read off the physical plan."""

import re

import __spark_entry__ as E
from tests.conftest import SF001
from tidemark.operators import late
from tidemark.sources import fixtures as fx


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _windows_over_rows(plan: str):
    """Partition specs of Window operators (empty spec = whole input in one task)."""
    return re.findall(r"windowspecdefinition\(([^)]*?)(?:ASC|DESC)", plan)


def test_monotonicity_has_no_global_window_over_rows(spark):
    trades = fx.trades(spark, SF001).select("id", "executed_at")  # the registered query settles this frame
    plan = _plan(late.monotonicity_violations(trades, "id", "executed_at"))
    specs = _windows_over_rows(plan)
    # one window per bucket over the rows; the only unpartitioned window runs over the per-bucket table
    assert any("_bk" in s and "id" in s for s in specs)
    assert plan.count("SinglePartition") <= 1


def test_segment_runs_windows_are_bucketed(spark):
    plan = _plan(E.queries()["segment_runs"](spark, SF001))
    assert "SinglePartition" not in plan
    assert "_bk" in plan


def test_candle_synthesis_single_exchange_after_1m(spark):
    plan = _plan(E.queries()["synthesize_candles"](spark, SF001))
    # one exchange for the 1m aggregation, one for (instrument, day); every timeframe reuses the latter
    assert plan.count("Exchange hashpartitioning") == 2
    assert "SortAggregate" not in plan


def test_day_counts_push_range_to_scan(spark):
    plan = _plan(E.queries()["purge_plan"](spark, SF001))
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts,2024-01-01T00:00)" in plan


def test_routing_broadcasts_the_leaf_days(spark):
    plan = _plan(E.queries()["route_rows"](spark, SF001))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # the rows are never shuffled: the only hash exchange builds the (small) leaf-day side
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Exchange hashpartitioning" in plan[plan.index("BroadcastExchange"):]


def test_id_bounds_aggregates_before_joining(spark):
    plan = _plan(E.queries()["id_bounds"](spark, SF001))
    # the only join is the small day list against per-day aggregates; rows reach it already aggregated
    join_at = plan.find("Join")
    assert join_at >= 0 and plan.count("Join") == 1
    assert "HashAggregate" in plan[join_at:]


def test_default_rows_prunes_leaf_partitions(spark, tmp_path):
    from pyspark.sql import functions as F

    from tidemark.functions.exprs import day_of
    from tidemark.operators.late import default_rows
    from tidemark.sources import fixtures as fx

    t = fx.ticks(spark, SF001)
    path = str(tmp_path / "t")
    t.withColumn("day", day_of("bus_time")).write.partitionBy("day").parquet(path)
    data = spark.read.parquet(path)
    leaf = fx.leaf(spark, SF001)
    pruned = default_rows(data, "bus_time", leaf, "ticks", day_col="day")
    plan = _plan(pruned)
    part_filters = plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert part_filters.lstrip("(").startswith("NOT day") and "INSET 2024-01-01" in part_filters  # leaf days pruned
    want = default_rows(t, "bus_time", leaf, "ticks").first()[1]
    assert pruned.first()[1] == want == t.where(F.dayofmonth("bus_time").isin(11, 22)).count()
