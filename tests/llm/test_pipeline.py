import os
import subprocess
import sys

import corpus_pipeline as cp
from pyspark.sql import functions as F

from tests.llm.helpers import docs

SF = "/root/testdata/sf0.01"
REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
INSULTS = r"(?i)\b(idiot|moron|scum|clown|stupid|loser|trash|pathetic|worthless|disgusting)\b"


def test_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language", "simhash", "decontamination", "mixing"]


def test_stages_work_on_what_was_kept(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("x")).withColumn("copies", F.lit(1))
    sizes = [d.count()]
    for name, stage in cp.STAGES:
        out = stage(spark, d, SF)
        assert out.columns == d.columns, name
        out = spark.createDataFrame(out.toPandas(), d.schema)
        before = {r["doc_id"] for r in d.select("doc_id").collect()}
        assert {r["doc_id"] for r in out.select("doc_id").collect()} <= before
        if name == "toxicity":
            assert out.where(F.col("text").rlike(INSULTS)).count() <= 1
            clean = d.join(spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0"), "doc_id", "left_semi")
            assert out.join(clean, "doc_id", "left_semi").count() >= 0.99 * clean.count()
        if name == "language":
            assert out.count() >= 0.99 * d.count()
        if name == "simhash":
            assert out.count() == out.select("doc_id").distinct().count()
        sizes.append(out.count())
        d = out
    assert sizes[3] < sizes[2] and sizes[4] < sizes[3] and sizes[5] > sizes[4]


def test_stages_on_odd_rows(spark):
    rows = [(None, None, None, None), (1, None, "en", None), (1, "", None, "a"), (2, "42 !!", "en", "a"), (2, "42 !!", "en", "a"),
            (3, "the of and to in " * 20000, "en", "b")]
    for _, stage in cp.STAGES:
        d = docs(spark, rows)
        for c in ("text_hash", "hits", "_toxic", "mix_id", "mix_key", "a", "b", "i", "fp", "h", "score", "row_id"):
            d = d.withColumn(c, F.lit(1))
        out = stage(spark, d, SF)
        assert out.columns == d.columns and out.count() <= 2 * len(rows)
        assert stage(spark, d.limit(0), SF).count() == 0


def test_run(spark):
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.count() > 100


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    shutil.copytree(f"{REPO}/tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) >= 55 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_queries_run_from_another_working_directory(tmp_path):
    """Task-side Python must not need the package on the executors' path."""
    code = (
        f"import sys; sys.path.insert(0, {REPO!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '4').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "q = E.queries()\n"
        "for n in ('op1_toxicity', 'op2_language', 'op4_decontamination', 'op6_simhash', 'op7_lm', 'op8_html', 'op9_embeddings'):\n"
        "    print(n, q[n](s, '/root/testdata/sf0.001').count())\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert out.stdout.split() == ["op1_toxicity", "200", "op2_language", "200", "op4_decontamination", "200", "op6_simhash", "200",
                                  "op7_lm", "200", "op8_html", "50", "op9_embeddings", "500"], out.stderr[-3000:]
