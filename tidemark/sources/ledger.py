"""Ledger files: read as text (so malformed lines survive), append, supplements."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators.verify import parse_ledger_lines
from tidemark.sources.runlog import read_appended_lines
from tidemark.sources.swap import folder_listing, fs_of, publish_new, write_text


def read_ledger_lines(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(table_name, line_no, line) from a TSV ledger (S5): text rows numbered in append order.

    A ledger is one file or a folder of appended parts; either way the line
    number runs across the whole ledger.
    """
    lines = read_appended_lines(spark, path)
    return lines.where(F.col("line") != "").select(F.lit(table).alias("table_name"), "line_no", "line")


def read_manifest(spark: SparkSession, path: str, table: str, kind: str | None = None) -> DataFrame:
    """Parsed ledger with the real field count ``nf`` per line (S5); a ledger not written yet is empty."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        lines = spark.createDataFrame([], "table_name string, line_no long, line string")
    else:
        lines = read_ledger_lines(spark, path, table)
    return parse_ledger_lines(lines).withColumn("kind", F.lit(kind or table))


def ledger_text(lines: DataFrame) -> DataFrame:
    """Ledger rows -> one tab-separated text line each, in the ledger's field order."""
    fields = ["file", "day", "bound_lower", "bound_upper", "rows", "bytes", "sha256", "exported_at"]
    return lines.select(F.concat_ws("\t", *[F.col(f).cast("string") for f in fields]).alias("value"))


def append_manifest(lines: DataFrame, path: str) -> int:
    """Append ledger lines (S6): one numbered commit file per call; returns its number.

    The lines (one a day) are written to a private file first, which then takes the next free number in one atomic
    step that never replaces a file (``publish_new``); a writer that loses a number to another takes the next one.
    So a part is seen whole or not at all, numbers have no gaps, and an append that raised has left nothing.
    Readers take the whole ledger folder in the order of the numbers.
    """
    spark = lines.sparkSession
    root = path.rstrip("/")
    text = "".join(r["value"] + "\n" for r in ledger_text(lines).collect())  # one line a day of one run
    fs, p = fs_of(spark, root)
    fs.mkdirs(p)
    private = f"{root}/_append-{uuid.uuid4().hex}"
    write_text(spark, private, text)
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    seq = max((int(n[4:]) for n in names if n.startswith("seq=") and n[4:].isdigit()), default=0) + 1
    while True:
        _, folder = fs_of(spark, f"{root}/seq={seq:012d}")
        # a folder that holds lines is taken, whatever its files are called (copies, appends of earlier versions)
        taken = fs.exists(folder) and folder_listing(fs, folder)[0]
        if not taken:
            fs.mkdirs(folder)
            if publish_new(spark, private, f"{root}/seq={seq:012d}/lines.txt"):
                return seq
        seq += 1


def read_supplements(spark: SparkSession, path: str) -> DataFrame:
    """Supplement ledger: six tab-separated fields with a header row."""
    return (
        spark.read.schema(S.SUPPLEMENT_SCHEMA).option("sep", "\t").option("header", True)
        .option("mode", "FAILFAST").csv(path)
        .withColumn("day", F.try_to_date("day", "yyyy-MM-dd"))
    )
