"""L1 and L4 as streams: each micro-batch is routed to its day's leaf, to DEFAULT, or kept off a sealed day."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.exprs import day_of
from tidemark.operators.calendar import ledger_days
from tidemark.operators.late import route_rows
from tidemark.sources.ledger import read_manifest
from tidemark.sources.swap import fs_of, publish_new, read_text, write_text
from tidemark.sources.tables import table_leaves


def start_routing(stream: DataFrame, time_col: str, leaf: DataFrame, table: str, table_path: str,
                  default_path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append routed rows to the day-partitioned table and to ``<table>_default``.

    ``foreachBatch`` with the batch id makes the two sinks idempotent on
    replay: each batch overwrites only its own ``batch_id=`` slice of the
    default table, and the leaf table is written with dynamic partition
    overwrite keyed by (day, batch_id).
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        routed = route_rows(batch, time_col, leaf, table).cache()
        try:
            to_leaf = routed.where(routed["target"] != table + "_default").drop("target")
            to_default = routed.where(routed["target"] == table + "_default").drop("target")
            (to_leaf.withColumn("batch_id", _lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(table_path))
            (to_default.withColumn("batch_id", _lit(batch_id)).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(default_path))
        finally:
            routed.unpersist()

    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def _lit(v):
    return F.lit(v).cast("long")


LEAF, DEFAULT, SEALED = "leaf", "default", "sealed"


def start_sealed_routing(stream: DataFrame, time_col: str, table: str, leaves_of: str, ledger_path: str, out_path: str,
                         checkpoint: str, trigger: dict | None = None,
                         step: Callable[[str, int], None] = lambda *_: None) -> StreamingQuery:
    """Route a stream by leaves and by a ledger that both change while it runs (L1 with L4).

    Each micro-batch reads the ledger and the leaf folders of ``leaves_of`` as they are when it begins.  Rows of a day
    that is in the ledger go to ``<out>/sealed``: its archive is written, and such rows would be in no archive and
    stop the day's purge.  Other rows go to ``<out>/leaf`` (partitioned by day and batch) if their day has a leaf, else
    to ``<out>/default``; so do rows without a time.

    Exactly once: what a batch decided by, the sealed days and the leaves, is published beside the checkpoint before
    its first row is written, in one step that never replaces a file.  A batch that is replayed after a crash decides
    by that file and not by a ledger that has grown meanwhile, and rewrites its own ``batch_id`` slices, so no
    row changes sides or appears twice.  The day lists are calendar sized; rows are routed by a broadcast of them and
    never shuffled.
    """
    decisions = f"{checkpoint.rstrip('/')}-days"
    root = out_path.rstrip("/")

    def decided(spark, batch_id: int) -> tuple[set[dt.date], set[dt.date]]:
        path = f"{decisions}/{batch_id:012d}"
        fs, p = fs_of(spark, path)
        if not fs.exists(p):
            ledger = ledger_days(read_manifest(spark, ledger_path, table)).collect()
            leaves = table_leaves(spark, leaves_of, table).collect()
            lines = [f"{SEALED}\t{r['day']}" for r in ledger] + [f"{LEAF}\t{r['day']}" for r in leaves]
            private = f"{decisions}/_{batch_id:012d}-{uuid.uuid4().hex}"
            write_text(spark, private, "\n".join(sorted(set(lines))))
            publish_new(spark, private, path)  # a slower twin of this driver lost: the file there decides
        pairs = [x.split("\t") for x in read_text(spark, path).splitlines()]
        days = {kind: {dt.date.fromisoformat(d) for k, d in pairs if k == kind} for kind in (SEALED, LEAF)}
        return days[SEALED], days[LEAF]

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        sealed, leaves = decided(spark, batch_id)
        step("decided", batch_id)
        targets = spark.createDataFrame([(d, SEALED if d in sealed else LEAF) for d in sorted(sealed | leaves)],
                                        "day date, target string")
        routed = (batch.withColumn("day", day_of(time_col)).join(F.broadcast(targets), "day", "left")
                  .withColumn("target", F.coalesce("target", F.lit(DEFAULT))).withColumn("batch_id", _lit(batch_id)).persist())
        try:
            for target in (LEAF, DEFAULT, SEALED):
                (routed.where(F.col("target") == target).drop("target").write.mode("overwrite")
                 .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch_id").parquet(f"{root}/{target}"))
                step(target, batch_id)
        finally:
            routed.unpersist()

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
