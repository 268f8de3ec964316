"""Session helpers: UTC everywhere, a shared folder for lineage cuts and archives."""

from __future__ import annotations

import contextlib
import contextvars
import functools
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "tidemark") -> SparkSession:
    """A session configured the way every job here expects (tests and bench use it)."""
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")  # a checkpoint goes with its frame
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Days are UTC days; a local session time zone would shift rows across days."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by the operator and is visible to every executor.
    Only on a local master, where it is unset in tests, is one created and
    registered; on any other master a missing setting is an error, because a
    driver's own folder is not visible to the executors.
    """
    path = spark.conf.get(CHECKPOINT_CONF, None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share (master {master})")
        path = tempfile.mkdtemp(prefix="tidemark-ckpt-")
        spark.conf.set(CHECKPOINT_CONF, path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session made, wherever the session's file systems keep it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_made: contextvars.ContextVar[list | None] = contextvars.ContextVar("checkpoints", default=None)


def pinned_rows(df):
    """``df`` in a reliable checkpoint; a surrounding ``scratch_checkpoints`` deletes it when its block ends."""
    shared_dir(df.sparkSession)
    out = df.checkpoint()
    made = _made.get()
    if made is not None:
        file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            made.append(file.get())
    return out


@contextlib.contextmanager
def scratch_checkpoints(spark: SparkSession):
    """Within the block, operators' checkpoints are scratch: what is wanted of them must be settled before it ends."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            remove_path(spark, path)


def settling(query):
    """A query whose result is settled, so that the full copies its range scans made can go at once."""

    @functools.wraps(query)
    def run(spark, *args):
        with scratch_checkpoints(spark):
            return settled(query(spark, *args))

    return run


def settled(df, *scratch: str):
    """``df`` computed into a reliable checkpoint, after which the scratch folders it was read from are deleted.

    Spark deletes the checkpoint itself once the frame is gone, if spark.cleaner.referenceTracking.cleanCheckpoints
    is set.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    for path in scratch:
        remove_path(df.sparkSession, path)
    return out


TARGET_PART_BYTES = 256 << 20
SORT_PART_BYTES = 128 << 20  # of input a task that sorts or scans its part in order
UNKNOWN_BYTES = 1 << 60


def scanned_bytes(df) -> int:
    """Bytes of the files that the plan's scans list after partition pruning (metadata only)."""
    total = 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        total += int(str(leaves.apply(i).stats().sizeInBytes()))
    return min(total, UNKNOWN_BYTES)


def listed_bytes(df) -> int | None:
    """Bytes of the files that the plan's scans will open, after partition pruning; None if a scan does not say."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    total = 0
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() != "FileSourceScanExec":
            return None
        total += int(leaf.selectedPartitions().totalFileSize())
    return total


def partitions_for(df, target_bytes: int = TARGET_PART_BYTES, input_bytes: int | None = None) -> int:
    """Enough partitions for ``target_bytes`` each, and at least one per core.

    ``input_bytes`` is the listed size of what will be read (e.g. the folders
    of the requested days); without it the size of the plan's scans is taken,
    which does not know about partition pruning of a path-based table.
    """
    size = scanned_bytes(df) if input_bytes is None else input_bytes
    if size >= UNKNOWN_BYTES:  # an input without statistics says nothing about its size
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(-(-size // target_bytes), df.sparkSession.sparkContext.defaultParallelism, 1))
