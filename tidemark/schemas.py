"""Pinned column orders, ledger layouts and table configuration.

Fixed values that must equal the behaviour being reproduced are gathered here.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---- fixed values -----------------------------------------------------------
# Archive format v1 for trades: the restorer reads the first three fields
# positionally, so this order never changes.
TRADE_COLUMNS_V1 = [
    "public_id", "timestamp", "known_to", "session_id", "sequence_id",
    "instrument_public_id", "trade_id", "executed_at", "price", "size",
    "side", "id",
]
# Ledger (manifest) fields, tab separated, exactly eight per line.
TICKS_LEDGER_FIELDS = ["file", "day", "id_lower", "id_upper", "rows", "bytes", "sha256", "exported_at"]
TRADES_LEDGER_FIELDS = ["file", "day", "lower", "upper", "rows", "bytes", "sha256", "exported_at"]
LEDGER_FIELD_COUNT = 8
# Supplement ledger, with a header row.
SUPPLEMENT_FIELDS = ["file", "day", "rows", "bytes", "sha256", "note"]
# Candle timeframes; the base is 1m, all others are derived from it.
TIMEFRAMES = ["1m", "5m", "15m", "30m", "1h", "4h", "1d"]
DERIVED_TIMEFRAMES = ["5m", "15m", "30m", "1h", "4h", "1d"]
TIMEFRAME_SECONDS = {"1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400}
# SCD2: an active version carries this known_to (our choice; not stated upstream).
SENTINEL = "9999-12-31 00:00:00"
# Greedy partition renewal: one anchor covers anchor .. anchor+13 (14 days in total).
ANCHOR_STEP_DAYS = 14
# Forward headroom looks this many days past today for the first missing leaf.
HEADROOM_LOOKAHEAD_DAYS = 400
# Defaults of the partition and retention jobs.
FORWARD_DAYS = 30
FORWARD_MIN_DAYS = 7
RETENTION_HORIZON_DAYS = 7
MAX_DAYS_PER_RUN = 3
STALE_SUCCESS_DAYS = 2
MIN_LOOKBACK_DAYS = 4
NEVER_DAYS = 9999
RUN_TAIL_LINES = 40
FAILURE_STREAK_ALARM = 2
# Log line patterns.
PROBLEM_LINE_PATTERN = r"^(ABORT|WARN:|[a-z]+: FAILED|gitlink: !!)"
OPERATIONAL_LINE_MARKERS = ["===", "==", "--", "OK", "WARN", "ABORT", "REFUSE", "SKIP", "refused:",
                            "FILE ROWCOUNT", "purge mismatch"]
DAY_TEXT_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
DIGITS_PATTERN = r"^[0-9]+$"
SHA256_PATTERN = r"^[0-9a-f]{64}$"
ISO_Z_PATTERN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$"
# Purge refusal reasons, in the order they are checked (first hit wins).
REASON_NO_LINE = "no manifest line"
REASON_MALFORMED = "malformed manifest line"
REASON_DUPLICATE = "duplicate manifest lines"
REASON_FIELD_INVALID = "invalid manifest line"
REASON_ARCHIVE_MISSING = "archive file missing"
REASON_SHA = "sha mismatch"
REASON_SIZE = "size mismatch"
REASON_NOT_ARMED = "purge not armed"
REASON_NO_LEAF = "no exact partition"
REASON_AMBIGUOUS = "no safe purge mapping"
REASON_ROWS = "row mismatch"
REASON_OK = "verified"
# Purge target priorities.
TARGET_PRIORITY = {"REFUSE": 1, "PARTITION": 2, "DEFAULT": 3, "MISSING": 4}
# ---- end of fixed values ----------------------------------------------------


def operational_pattern(subject_prefix: str | None = None) -> str:
    """Operational-line pattern; alert subject lines start with a deployment's own product name."""
    markers = OPERATIONAL_LINE_MARKERS + ([subject_prefix] if subject_prefix else [])
    return "^(" + "|".join(markers) + ")"


@dataclass(frozen=True)
class TableConfig:
    """How one day-partitioned table is sliced, ordered and kept."""

    name: str
    time_col: str            # the column whose UTC day is the partition key
    order_cols: tuple        # archive order inside a day
    back_days: int           # backward leaf buffer
    ledger_kind: str | None  # "ticks", "trades" or None (candles have no day ledger)
    purged_by_retention: bool = False


TABLES = {
    "ticks": TableConfig("ticks", "timestamp", ("id",), 6, "ticks", purged_by_retention=True),
    "trades": TableConfig("trades", "executed_at", ("executed_at", "id"), 30, "trades"),
    "candles": TableConfig("candles", "open_at", ("open_at",), 30, None),
}


SUPPLEMENT_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in SUPPLEMENT_FIELDS])

CANDLE_CSV_SCHEMA = T.StructType([
    T.StructField("symbol", T.StringType()),
    T.StructField("open_at", T.TimestampType()),
    T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()),
    T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()),
    T.StructField("volume", T.DoubleType()),
])
