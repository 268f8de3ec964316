"""Small DataFrame helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not use yet (case ignored)."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n = f"_{n}"
        used.add(n.lower())
        out.append(n)
    return out


def id_crc(col: str) -> Column:
    """crc32 of an id written as text; null for a null id."""
    return F.crc32(F.col(col).cast("string"))


def held_out(col: str, parts: int, part: int) -> Column:
    """True if crc32(id as text) mod ``parts`` is ``part``; false for a null id."""
    return F.coalesce((id_crc(col) % parts) == part, F.lit(False))


class Shared:
    """An object broadcast to the tasks as bytes; ``get`` gives it, unpickled once per Python worker or task."""

    _held: dict = {}

    def __init__(self, spark: SparkSession, value):
        from pyspark import cloudpickle

        blob = cloudpickle.dumps(value)
        self.tag = hashlib.sha256(blob).hexdigest()
        self.blob = spark.sparkContext.broadcast(blob)

    def get(self, build=lambda x: x):
        if self.tag not in Shared._held:
            Shared._held.clear()  # the latest one only
            Shared._held[self.tag] = build(pickle.loads(self.blob.value))
        return Shared._held[self.tag]


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hash_sample(df: DataFrame, n: int, *cols: str) -> DataFrame:
    """At most ``n`` rows, those with the smallest hash of ``cols``: the same rows in every run.

    Rows that are equal in ``cols`` count as one and one of them is taken, so repeats neither widen the sample nor crowd
    it.  Only the n smallest hashes of a partition are moved to find the threshold; the rows are then read by a filter.
    """
    key, = fresh(df, "sample_key")
    h = F.xxhash64(F.lit(20240101), *[F.col(c) for c in cols])

    def smallest(batches):
        held = np.zeros(0, np.int64)
        for b in batches:
            held = np.unique(np.concatenate([held, b.column(0).to_numpy()]))[:n]
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64())], ["h"])

    low = df.select(h.alias("h")).mapInArrow(smallest, "h long").distinct().orderBy("h").limit(n)
    top = low.agg(F.max("h").alias("h")).collect()[0]["h"]
    if top is None:
        return df.where(F.lit(False))
    return df.withColumn(key, h).where(F.col(key) <= F.lit(top)).dropDuplicates([key]).drop(key)
