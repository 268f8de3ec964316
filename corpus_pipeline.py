"""The corpus pipeline: toxicity, language, near-duplicates, benchmark passages, mixing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's ``docs``.  All but the
last return the columns of documents.

Defined results, by the operators that the stages call: a null or empty text is
judged as one without words by the first stage and goes in the second; very long
texts are read whole; repeated rows are judged alike, and one of them stays after
the third stage; null ids and sources are kept; extra columns pass through,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, langid, mixing, simhash, toxicity
from tidemark.llm.frames import held_out, table
from tidemark.session import remove_path, shared_dir


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold of their language."""
    net = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out("doc_id", 3, 1))
    return toxicity.reject_toxic(docs, net)


def language_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages."""
    return langid.reject_language(docs, langid.fit_language(docs, ~held_out("doc_id", 5, 0)))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near fingerprints."""
    return simhash.simhash_dedup(docs, shingle=3, max_bits=3)


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no more benchmark passages than the contamination rule allows."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxic_out), ("language", language_known), ("simhash", near_copies_out),
          ("decontamination", benchmark_out), ("mixing", mixed)]

# The classifiers are trained models: no SQL.  Tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is a Parquet table in the shared folder.

    A stage's table is deleted when the next one's is written; the last one stays, for the result reads it.
    """
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            remove_path(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
