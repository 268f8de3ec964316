"""The driver program: each command end to end on a day-partitioned table."""

import json

from pyspark.sql import functions as F

from tidemark import cli
from tidemark.functions.exprs import day_of
from tidemark.sources import fixtures as fx
from tests.conftest import SF001


def _rows(out: str):
    return [json.loads(x) for x in out.strip().splitlines() if x.startswith("{")]


def _table(spark, scratch):
    t = fx.ticks(spark, SF001).withColumnRenamed("bus_time", "timestamp")
    path = f"{scratch}/ticks"
    t.withColumn("day", day_of("timestamp")).write.partitionBy("day").parquet(path)
    return path


def test_cli_export_then_purge(spark, scratch, capsys):
    data = _table(spark, scratch)
    common = ["--table", "ticks", "--data", data, "--archive", f"{scratch}/archive", "--ledger", f"{scratch}/MANIFEST"]
    assert cli.main(["export", *common, "2024-01-03", "2024-01-04"], spark) == 0
    lines = _rows(capsys.readouterr().out)
    assert [r["day"] for r in lines] == ["2024-01-03", "2024-01-04"]
    assert cli.main(["export", *common, "2024-01-03", "2024-02-10"], spark) == 1
    refused = {r["day"]: r["refused"] for r in _rows(capsys.readouterr().out)}
    assert refused == {"2024-01-03": "already in the ledger", "2024-02-10": "no exact daily partition"}
    assert all(r["file"].endswith(".csv.zst") for r in lines)
    assert cli.main(["purge", *common, "--apply", "2024-01-03", "2024-01-05"], spark) == 1
    plan = {r["day"]: r for r in _rows(capsys.readouterr().out)}
    assert plan["2024-01-03"]["decision"] == "PURGE" and plan["2024-01-03"]["dropped"]
    assert plan["2024-01-05"]["reason"] == "no manifest line" and not plan["2024-01-05"]["dropped"]
    assert spark.read.parquet(data).where(F.col("day") == "2024-01-03").count() == 0
    back_args = ["restore", "--table", "ticks", "--data", data, "--archive", f"{scratch}/archive", "--ledger", f"{scratch}/MANIFEST"]
    assert cli.main([*back_args, "2024-01-03"], spark) == 0
    back = _rows(capsys.readouterr().out)
    assert back == [{"day": "2024-01-03", "restored": plan["2024-01-03"]["ledger_rows"]}]
    assert cli.main([*back_args, "2024-01-03"], spark) == 1  # the table has that day again
    capsys.readouterr()
    assert cli.main(["staleness", "--ledger", f"ticks={scratch}/MANIFEST", "--now", "2099-01-01 00:00:00"], spark) == 1
    assert _rows(capsys.readouterr().out)[0]["stale"]


def test_cli_retention_partitions_logs(spark, scratch, capsys):
    data = _table(spark, scratch)
    common = ["--table", "ticks", "--data", data, "--archive", f"{scratch}/archive", "--ledger", f"{scratch}/MANIFEST"]
    assert cli.main(["retention", *common, "--today", "2024-01-15"], spark) == 0
    out = _rows(capsys.readouterr().out)
    assert [(r["day"], r["dropped"]) for r in out] == [("2024-01-01", True), ("2024-01-02", True), ("2024-01-03", True)]
    cli.main(["partitions", "--data", f"ticks={data}", "--ledger", f"ticks={scratch}/MANIFEST",
              "--today", "2024-01-15"], spark)
    out = _rows(capsys.readouterr().out)
    cov = out[0]
    assert cov["table_name"] == "ticks" and cov["headroom"] == 16 and cov["missing"] == 15
    anchors = [r["anchor"] for r in out[1:]]
    assert len(anchors) == cov["anchors"] and anchors[0] == cov["first_anchor"]
    logs = f"{scratch}/logs"
    import os
    os.makedirs(logs)
    with open(f"{logs}/partitions-2024-01.log", "w") as f:
        f.write("=== coverage 2024-01-01T12:17:00Z ===\nOK all tables\n"
                "=== coverage 2024-01-02T12:17:00Z ===\n-- ticks headroom 3d is below the 7d floor\n"
                "WARN: no successful run recorded for 3 day(s)\n=== coverage done 2024-01-02T12:18:00Z ===\n")
    assert cli.main(["logs", "--logs", logs, "--job", "coverage", "--runs-out", f"{scratch}/runs"], spark) == 1
    out = _rows(capsys.readouterr().out)
    problems = [r for r in out if "n_problems" in r]
    assert [(r["n_runs"], r["n_failed"], r["run_no"], r["n_problems"], r["failed"]) for r in problems] == [(2, 1, 2, 1, True)]
    assert spark.read.parquet(f"{scratch}/runs").count() == 2
    body = [r["line"] for r in out if "from_end" in r]
    assert body[0].startswith("=== coverage 2024-01-02") and body[-1].startswith("=== coverage done")


def test_cli_trades_pinned_archive_and_arming(spark, scratch, capsys):
    import glob

    import pyarrow as pa

    from tidemark import schemas as S

    tr = fx.trades(spark, SF001).withColumnRenamed("bus_time", "timestamp")
    data = f"{scratch}/trades"
    tr.withColumn("day", day_of("executed_at")).write.partitionBy("day").parquet(data)
    common = ["--table", "trades", "--data", data, "--archive", f"{scratch}/archive", "--ledger", f"{scratch}/LEDGER"]
    cli.main(["export", *common, "2024-01-03"], spark)
    line = _rows(capsys.readouterr().out)[0]
    assert (line["bound_lower"], line["bound_upper"]) == ("2024-01-03T00:00:00Z", "2024-01-04T00:00:00Z")
    part = sorted(glob.glob(f"{scratch}/archive/trades/day=2024-01-03/*.csv.zst"))[0]
    with pa.CompressedInputStream(pa.OSFile(part), "zstd") as f:
        header = f.read(400).decode().splitlines()[0]
    assert header.replace('"', "").split(",") == S.TRADE_COLUMNS_V1
    cli.main(["purge", *common, "--apply", "2024-01-03"], spark)
    refused = _rows(capsys.readouterr().out)[0]
    assert (refused["decision"], refused["reason"], refused["dropped"]) == ("REFUSE", "purge not armed", False)
    cli.main(["purge", *common, "--armed", "--apply", "2024-01-03"], spark)
    done = _rows(capsys.readouterr().out)[0]
    assert (done["decision"], done["dropped"]) == ("PURGE", True)


def test_cli_ingest(spark, scratch, capsys):
    from tidemark.operators import candles as cdl
    from tidemark.sources.candle_csv import write_candle_csv

    bars = cdl.ticks_to_candles(fx.ticks(spark, SF001), "1m", ["instrument"], "bus_time", "price", "id")
    write_candle_csv(bars, f"{scratch}/cache")
    now = ["--now", "2024-02-03 12:00:00"]
    assert cli.main(["ingest", "--cache", f"{scratch}/cache", "--out", f"{scratch}/out", *now], spark) == 0
    assert _rows(capsys.readouterr().out)[0]["bars"] == spark.read.parquet(f"{scratch}/out").count()
