"""Scalar building blocks.  Everything stays a JVM expression (codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import schemas as S


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day_of(c) -> Column:
    """UTC day of a timestamp (session time zone is pinned to UTC)."""
    return F.to_date(as_col(c))


def sentinel_for(df: DataFrame, col: str) -> Column:
    """The SCD2 sentinel typed like ``df[col]`` (TIMESTAMP or TIMESTAMP_NTZ)."""
    return F.lit(S.SENTINEL).cast(df.schema[col].dataType)


def valid_day_text(c) -> Column:
    """``YYYY-MM-DD`` that also survives a calendar round trip (rejects 2024-02-30)."""
    c = as_col(c)
    parsed = F.try_to_date(c, "yyyy-MM-dd")
    return F.coalesce(
        c.rlike(S.DAY_TEXT_PATTERN) & parsed.isNotNull() & (F.date_format(parsed, "yyyy-MM-dd") == c),
        F.lit(False),
    )


def digits(c) -> Column:
    return F.coalesce(as_col(c).rlike(S.DIGITS_PATTERN), F.lit(False))


def is_sha256(c) -> Column:
    return F.coalesce(as_col(c).rlike(S.SHA256_PATTERN), F.lit(False))


def is_iso_z(c) -> Column:
    return F.coalesce(as_col(c).rlike(S.ISO_Z_PATTERN), F.lit(False))


def _strip_zeros(c: Column) -> Column:
    stripped = F.regexp_replace(c, r"^0+", "")
    return F.when(stripped == "", F.lit("0")).otherwise(stripped)


def decimal_less_than(left, right) -> Column:
    """``left < right`` for digit strings of any length (leading zeros ignored).

    Shorter (after stripping zeros) is smaller; equal lengths compare as text.
    """
    a, b = _strip_zeros(as_col(left)), _strip_zeros(as_col(right))
    return (F.length(a) < F.length(b)) | ((F.length(a) == F.length(b)) & (a < b))


def row_digest_value(*parts) -> Column:
    """First 15 hex digits (60 bits) of sha256 over ``parts`` joined by '|', as a long."""
    text = F.concat_ws("|", *[as_col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def content_digest_agg(digest_col) -> Column:
    """Order-free content digest: exact sum of 60-bit row digests.

    decimal(38,0) holds 2**60 * 10**17 rows, so no cluster-scale day can overflow it.
    """
    return F.sum(as_col(digest_col).cast(T.DecimalType(38, 0)))
