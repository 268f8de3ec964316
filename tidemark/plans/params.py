"""Parameters of the registered queries (shared by the Spark side and the SQL oracle)."""

# ---- fixed values -----------------------------------------------------------
TODAY = "2024-01-15"
FORWARD = 30
CONFIG = [("ticks", 6, True), ("trades", 30, False)]  # table, backward days, purged by retention
PURGE_FROM, PURGE_TO = "2024-01-01", "2024-01-21"
TRADES_PURGE_FROM, TRADES_PURGE_TO = "2023-12-10", "2024-01-12"
BOUNDS_FROM, BOUNDS_TO = "2023-12-30", "2024-02-02"
SLICE_FROM, SLICE_TO = "2024-01-03", "2024-01-06"     # half open
TARGET_FROM, TARGET_TO = "2023-12-30", "2024-02-02"
BACKFILL_FROM, BACKFILL_TO = "2024-01-01", "2024-01-30"
STALE_NOW = "2024-01-25 12:00:00"
LOOKBACK_NOW = "2024-02-03 12:00:00"
SYNTH_START, SYNTH_END, SYNTH_CUT = "2024-01-03", "2024-01-27", "2024-01-05"
VERSIONS_FROM, VERSIONS_TO = "1996-01-01", "1996-12-31"
SWEEP_FROM, SWEEP_TO = "2024-01-05", "2024-01-20"
RETENTION_MAX_DAYS = 3
UPSERT_FIRST, UPSERT_AT = "2024-02-01 00:00:00", "2024-02-02 00:00:00"
# ---------------------------------------------------------------------------
