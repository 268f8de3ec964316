"""Ledger health, line validation, archive verification, purge targets and
count reconciliation (S5-shape A6 F7 J3 J4 J5 J7 W4 U1 O5 O8).

A parsed ledger has one row per physical line:
``table_name, line_no, nf, file, day, bound_lower, bound_upper, rows, bytes,
sha256, exported_at`` -- all fields kept as text so malformed and duplicate
lines survive to be reported.  Ledgers hold one line per exported day, so
every frame here is calendar sized; the joins against data-sized counts are
on (table_name, day).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions.exprs import decimal_less_than, digits, is_iso_z, is_sha256, valid_day_text
from tidemark.operators.calendar import exact_day_bound

LEDGER_COLUMNS = ["table_name", "line_no", "nf", "file", "day", "bound_lower", "bound_upper",
                  "rows", "bytes", "sha256", "exported_at"]


def parse_ledger_lines(lines: DataFrame) -> DataFrame:
    """(table_name, line_no, line) -> parsed ledger; ``nf`` is the real field count."""
    parts = F.split(F.col("line"), "\t", -1)
    names = ["file", "day", "bound_lower", "bound_upper", "rows", "bytes", "sha256", "exported_at"]
    return lines.select(
        "table_name", "line_no", F.size(parts).alias("nf"),
        *[F.get(parts, i).alias(n) for i, n in enumerate(names)],
    )


def expected_file(table: Column, day_text: Column) -> Column:
    return F.concat(table, F.lit("-"), day_text, F.lit(".csv.zst"))


def ledger_health(ledger: DataFrame) -> DataFrame:
    """Per (table, day text): lines, malformed lines, and status.

    Malformed outranks duplicate: any line for the day with a field count
    other than eight makes the day malformed, whatever the line count.
    """
    g = ledger.groupBy("table_name", "day").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.col("nf") != S.LEDGER_FIELD_COUNT).alias("n_malformed"),
    )
    status = (
        F.when(F.col("n_malformed") > 0, F.lit("malformed"))
        .when(F.col("n_lines") > 1, F.lit("duplicate"))
        .otherwise(F.lit("single"))
    )
    return g.withColumn("status", status)


def line_checks(ledger: DataFrame, kind_col: str = "kind") -> DataFrame:
    """Adds ``fields_ok``: every field of an eight-field line is well formed.

    ticks lines carry id bounds (digits, lower < upper); trades lines carry the
    exact ``<day>T00:00:00Z`` / ``<day+1>T00:00:00Z`` pair.
    """
    day_ok = valid_day_text("day")
    next_day = F.date_format(F.date_add(F.try_to_date("day", "yyyy-MM-dd"), 1), "yyyy-MM-dd")
    id_bounds_ok = digits("bound_lower") & digits("bound_upper") & F.coalesce(
        decimal_less_than("bound_lower", "bound_upper"), F.lit(False))
    ts_bounds_ok = F.coalesce(
        (F.col("bound_lower") == F.concat(F.col("day"), F.lit("T00:00:00Z")))
        & (F.col("bound_upper") == F.concat(next_day, F.lit("T00:00:00Z"))),
        F.lit(False),
    )
    bounds_ok = F.when(F.col(kind_col) == "trades", ts_bounds_ok).otherwise(id_bounds_ok)
    ok = (
        (F.col("nf") == S.LEDGER_FIELD_COUNT)
        & F.coalesce(F.col("file") == expected_file(F.col("table_name"), F.col("day")), F.lit(False))
        & day_ok & bounds_ok & digits("rows") & digits("bytes") & is_sha256("sha256") & is_iso_z("exported_at")
    )
    return ledger.withColumn("fields_ok", F.coalesce(ok, F.lit(False)))


def manifest_valid(ledger: DataFrame, kind_col: str = "kind") -> DataFrame:
    """One verdict per ledger line: ``malformed``, ``invalid`` or ``valid``."""
    checked = line_checks(ledger, kind_col)
    verdict = (
        F.when(F.col("nf") != S.LEDGER_FIELD_COUNT, F.lit("malformed"))
        .when(~F.col("fields_ok"), F.lit("invalid"))
        .otherwise(F.lit("valid"))
    )
    return checked.select("table_name", "line_no", "day", "file", "fields_ok", verdict.alias("verdict"))


def last_line_per_day(ledger: DataFrame) -> DataFrame:
    """The last ledger line written for each day (``tail -1``), by line number."""
    cols = [c for c in ledger.columns if c not in ("table_name", "day")]
    return ledger.groupBy("table_name", "day").agg(
        F.max_by(F.struct(*cols), F.col("line_no")).alias("_last")
    ).select("table_name", "day", "_last.*")


def skip_done_days(days: DataFrame, done_days: DataFrame, keys: Sequence[str] = ("table_name",)) -> DataFrame:
    """Split requested days into ``todo`` and ``done`` with one left join."""
    flagged = done_days.select(*keys, "day").distinct().withColumn("_done", F.lit(True))
    return days.join(flagged, [*keys, "day"], "left").select(
        *days.columns, F.when(F.col("_done"), F.lit("done")).otherwise(F.lit("todo")).alias("status")
    )


def verify_archive(lines: DataFrame, inventory: DataFrame) -> DataFrame:
    """Ledger line vs the archive file: missing, then sha, then size.

    ``inventory`` has (file, actual_bytes, actual_sha256).  The order matters:
    a file with the wrong size and the wrong hash reports the hash.
    """
    inv = inventory.select("file", F.col("bytes").alias("actual_bytes"), F.col("sha256").alias("actual_sha256"),
                           F.lit(True).alias("_present"))
    j = lines.join(inv, "file", "left")
    verdict = (
        F.when(F.col("_present").isNull(), F.lit(S.REASON_ARCHIVE_MISSING))
        .when(F.col("actual_sha256") != F.col("sha256"), F.lit(S.REASON_SHA))
        .when(F.col("actual_bytes").cast("string") != F.col("bytes"), F.lit(S.REASON_SIZE))
        .otherwise(F.lit("ok"))
    )
    return j.withColumn("archive_verdict", verdict).drop("_present")


def resolve_purge_target(days: DataFrame, children: DataFrame) -> DataFrame:
    """Which storage holds each requested (table, day).

    ``children``: (table_name, leaf_name, kind, is_default, bound_lower,
    bound_upper).  An exact child has bounds of exactly that UTC day.
    Candidates: REFUSE(1) if several exact children or one that is not an
    ordinary leaf; PARTITION(2) for the one ordinary exact child; DEFAULT(3)
    when no exact child exists but a default does; MISSING(4) otherwise.
    """
    exact = (
        children.where(~F.col("is_default") & exact_day_bound(children))
        .withColumn("day", F.to_date("bound_lower"))
        .groupBy("table_name", "day")
        .agg(F.count(F.lit(1)).alias("n_exact"), F.count_if(F.col("kind") != "r").alias("n_other"),
             F.min("leaf_name").alias("exact_leaf"))
    )
    default = children.where(F.col("is_default")).groupBy("table_name").agg(F.min("leaf_name").alias("default_leaf"))
    j = days.select("table_name", "day").join(exact, ["table_name", "day"], "left").join(default, "table_name", "left")
    target = (
        F.when((F.col("n_exact") > 1) | (F.col("n_other") > 0), F.lit("REFUSE"))
        .when(F.col("n_exact") == 1, F.lit("PARTITION"))
        .when(F.col("default_leaf").isNotNull(), F.lit("DEFAULT"))
        .otherwise(F.lit("MISSING"))
    )
    leaf = (
        F.when(target == "PARTITION", F.col("exact_leaf"))
        .when(target == "DEFAULT", F.col("default_leaf"))
        .otherwise(F.lit(""))
    )
    prio = F.element_at(F.create_map(*[x for k, v in S.TARGET_PRIORITY.items() for x in (F.lit(k), F.lit(v))]), target)
    return j.select("table_name", "day", target.alias("target"), leaf.alias("leaf_name"),
                    prio.cast("int").alias("priority"))


def reconcile_counts(table_counts: DataFrame, ledger: DataFrame, archive_counts: DataFrame | None = None) -> DataFrame:
    """Rows in the table = rows in the ledger (= rows re-read from the archive).

    Full outer join on (table_name, day); a side that lacks the day is a
    finding of its own.  Ledger days with several lines are ``ambiguous``.
    """
    led = (
        ledger.withColumn("_d", F.try_to_date("day", "yyyy-MM-dd"))
        .where(F.col("_d").isNotNull())
        .groupBy("table_name", F.col("_d").alias("day"))
        .agg(F.count(F.lit(1)).alias("ledger_lines"),
             F.max(F.col("rows").try_cast("long")).alias("ledger_rows"))
    )
    j = table_counts.select("table_name", "day", F.col("n_rows").alias("table_rows")).join(
        led, ["table_name", "day"], "full_outer")
    if archive_counts is not None:
        j = j.join(archive_counts.select("table_name", "day", F.col("n_rows").alias("archive_rows")),
                   ["table_name", "day"], "full_outer")
        arch_bad = ~F.col("archive_rows").eqNullSafe(F.col("ledger_rows"))
    else:
        j = j.withColumn("archive_rows", F.lit(None).cast("long"))
        arch_bad = F.lit(False)
    status = (
        F.when(F.col("table_rows").isNull(), F.lit("not in table"))
        .when(F.col("ledger_lines").isNull(), F.lit("not in ledger"))
        .when(F.col("ledger_lines") > 1, F.lit("ambiguous ledger"))
        .when(F.col("table_rows") != F.col("ledger_rows"), F.lit("row mismatch"))
        .when(arch_bad, F.lit("archive mismatch"))
        .otherwise(F.lit("ok"))
    )
    return j.select("table_name", "day", "table_rows", "ledger_rows", "archive_rows",
                    F.coalesce(F.col("ledger_lines"), F.lit(0)).cast("long").alias("ledger_lines"),
                    status.alias("status"))
