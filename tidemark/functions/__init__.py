"""Column expressions shared by the operators; all built from pyspark.sql.functions."""

from tidemark.functions.exprs import (  # noqa: F401
    as_col, content_digest_agg, day_of, decimal_less_than, digits, is_iso_z, is_sha256,
    row_digest_value, sentinel_for, valid_day_text,
)
