"""Run logs and run-level summaries.

A log is (file, line_no, line).  A banner line starts a run; lines before
the first banner of a file belong to run 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.operators.prefix import prefix_sum, rows_since, top_n_per_group


def banner_pattern(job: str | None = None) -> str:
    """``^=== <job> [0-9]``: matches the start banner, not the ``done`` banner."""
    return r"^=== " + (job if job else r"\S+") + r" [0-9]"


def segment_runs(log: DataFrame, pattern: str | None = None, parts: int | None = None) -> DataFrame:
    """Label every line with the number of banners up to and including it.

    A running count per file, computed with the ranged prefix scan so one
    huge log file is still many tasks.
    """
    pat = pattern or banner_pattern()
    flagged = log.withColumn("_banner", F.coalesce(F.col("line").rlike(pat), F.lit(False)).cast("long"))
    return prefix_sum(flagged, ["file"], "line_no", "_banner", "run_no", parts).drop("_banner")


def problem_lines(col="line"):
    """the narrow problem markers a run counts against itself."""
    return F.coalesce(F.col(col).rlike(S.PROBLEM_LINE_PATTERN), F.lit(False))


def operational_lines(col="line", subject_prefix: str | None = None):
    """the lines worth mailing (plus alert subjects starting with ``subject_prefix``)."""
    return F.coalesce(F.col(col).rlike(S.operational_pattern(subject_prefix)), F.lit(False))


def problem_count(runs: DataFrame) -> DataFrame:
    """Problem lines per labelled run; any problem fails the run."""
    return (
        runs.where(F.col("run_no") > 0)
        .groupBy("file", "run_no")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(problem_lines()).alias("n_problems"))
        .withColumn("failed", F.col("n_problems") > 0)
    )


def run_tail(runs: DataFrame, n: int = S.RUN_TAIL_LINES, parts: int | None = None,
             subject_prefix: str | None = None) -> DataFrame:
    """Last ``n`` operational lines of every labelled run, in line order."""
    ops = runs.where((F.col("run_no") > 0) & operational_lines(subject_prefix=subject_prefix))
    return top_n_per_group(ops, ["file", "run_no"], "line_no", n, "from_end", parts).select(
        "file", "run_no", "line_no", "line", "from_end")


def current_run(log: DataFrame, pattern: str | None = None) -> DataFrame:
    """The lines of each file's current run: from its last banner to its end (the whole file without a banner).

    No line is numbered: the place of the last banner is one partially aggregated maximum per file.
    """
    pat = pattern or banner_pattern()
    last = log.where(F.col("line").rlike(pat)).groupBy("file").agg(F.max("line_no").alias("_from"),
                                                                   F.count(F.lit(1)).alias("run_no"))
    cur = log.join(last, "file", "left").where(F.col("line_no") >= F.coalesce("_from", F.col("line_no")))
    return cur.select("file", F.coalesce("run_no", F.lit(0)).cast("long").alias("run_no"), "line_no", "line")


def current_run_tail(log: DataFrame, n: int = S.RUN_TAIL_LINES, parts: int | None = None, pattern: str | None = None,
                     subject_prefix: str | None = None) -> DataFrame:
    """The alert body: last ``n`` operational lines of each file's current run (O4 for the mail).

    ``subject_prefix``: how this deployment's alert subjects start; those lines count as well.
    """
    cur = current_run(log, pattern).where(operational_lines(subject_prefix=subject_prefix))
    return top_n_per_group(cur, ["file"], "line_no", n, "from_end", parts).select(
        "file", "run_no", "line_no", "line", F.col("from_end").cast("long").alias("from_end"))


def failure_streaks(run_status: DataFrame, alarm_at: int = S.FAILURE_STREAK_ALARM, parts: int | None = None) -> DataFrame:
    """Consecutive failed runs per job, reset by a success; alarm at ``alarm_at``.

    ``run_status`` has (file, run_no, failed): one row per run.  A failed run's
    streak is its number of runs since the last success of its file.
    """
    flagged = run_status.withColumn("_ok", F.coalesce(~F.col("failed"), F.lit(False)))
    counted = rows_since(flagged, ["file"], "run_no", "_ok", "streak", parts)  # one ranged scan: no window holds a whole job
    return counted.select("file", "run_no", "failed", "streak", (F.col("streak") >= alarm_at).alias("alarm"))


def staleness(stamps: DataFrame, now, limit: int = S.STALE_SUCCESS_DAYS) -> DataFrame:
    """Whole days since the last success per job; 9999 if never; stale when over ``limit``.

    ``stamps`` has (job, success_at) with null for a job that never succeeded.
    """
    now_ts = F.to_timestamp(F.lit(now)) if isinstance(now, str) else now
    last = stamps.groupBy("job").agg(F.max("success_at").alias("last_success"))
    days = F.coalesce(F.floor((F.unix_seconds(now_ts) - F.unix_seconds(F.col("last_success").cast("timestamp")))
                              / 86400).cast("long"), F.lit(S.NEVER_DAYS).cast("long"))
    return last.select("job", "last_success", days.alias("days_since"), (days > limit).alias("stale"))


def ledger_totals(ledger: DataFrame) -> DataFrame:
    """Rows and bytes per ledger day and in total (``day`` null) -- a rollup."""
    return (
        ledger.select("table_name", "day", F.col("rows").try_cast("long").alias("rows"),
                      F.col("bytes").try_cast("long").alias("bytes"))
        .rollup("table_name", "day")
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
        .where(F.col("table_name").isNotNull())
    )


def megabytes(bytes_col) -> F.Column:
    """Whole MiB, rounded up."""
    return F.floor((F.col(bytes_col) + F.lit(1048575)) / F.lit(1048576)).cast("long")


def backfill_summary(outcomes: DataFrame) -> DataFrame:
    """ok / skip / fail counts and MiB written for a backfill run.

    ``outcomes`` has (table_name, day, outcome, bytes) with outcome in
    ok / skip / fail / not_attempted.
    """
    return outcomes.groupBy("table_name").agg(
        F.count_if(F.col("outcome") == "ok").alias("ok"),
        F.count_if(F.col("outcome") == "skip").alias("skip"),
        F.count_if(F.col("outcome") == "fail").alias("fail"),
        F.count_if(F.col("outcome") == "not_attempted").alias("not_attempted"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "ok", megabytes("bytes"))), F.lit(0)).cast("long").alias("mb"),
    )
