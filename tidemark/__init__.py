"""tidemark: day-partitioned market-data archiving, verification and retention on Spark.

Every operator takes and returns DataFrames; the heavy work (slicing, counting,
hashing, joining, windowing) runs as Spark jobs.  See README.md for the map of
operators and jobs.
"""

__all__ = ["session", "schemas"]
