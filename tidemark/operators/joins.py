"""Join-side helper: broadcast only what has a proven size bound."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def day_side(df: DataFrame) -> DataFrame:
    """Broadcast a frame keyed by ``day``, reduced to one row a day.

    The bound does not depend on the data: Spark's dates run from year 1 to
    9999, so one row a day is at most 3.7 million rows (decades of trading
    days are a few thousand), a few tens of bytes each.
    """
    return F.broadcast(df.dropDuplicates(["day"]))
