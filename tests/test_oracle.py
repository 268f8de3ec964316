"""Every registered query against its DuckDB oracle on sf0.001 (names, types, values)."""

import duckdb
import pytest

import __spark_entry__ as E
from scripts.compare import SPARK_TO_DUCK, TABLES, digest
from tests.conftest import SF001
from tidemark.plans.catalog import QUERIES

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    return c


def test_every_query_has_an_oracle_or_is_rows_only():
    missing = set(QUERIES) - set(ORACLE) - E.ROWS_ONLY
    assert not missing


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["table_name", "day", "table_rows", "ledger_rows", "archive_rows", "ledger_lines", "status"]


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    res = con.sql(ORACLE[name])
    drows = res.fetchall()
    assert sorted(df.columns) == sorted(res.columns)
    stypes = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString()) for f in df.schema.fields}
    assert stypes == {c: str(t) for c, t in zip(res.columns, res.types)}
    assert len(rows) == len(drows)
    assert digest(df.columns, rows)[0] == digest(res.columns, drows)[0]


@pytest.mark.parametrize("name", sorted(E.ROWS_ONLY))
def test_rows_only_queries_run(spark, name):
    assert E.queries()[name](spark, SF001).count() > 0


def test_queries_run_from_another_working_directory(tmp_path):
    """Task-side Python (file hashing, the zstd writer) must not need the package on the executors' path."""
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', E.queries()['archive_inventory'](s, %r).count())\n" % (repo, SF001)
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True,
                         timeout=600)
    assert "ROWS 30" in out.stdout, out.stderr[-2000:]
