"""Connected components of a graph given as pairs, by alternating large-star and small-star rounds.

Every round is one grouped minimum and one join per star, so a hub's edges are
pre-aggregated before the shuffle and its join is split by AQE; no group is
gathered in a task.  The number of rounds grows with the logarithm of the
longest shortest path.  Each round is cut by a reliable checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import cut


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    rest = e.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of its component.

    Self-pairs, repeated and reversed pairs and pairs with a null end change nothing.  No pairs: no rows.
    """
    e = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    e, before = cut(e), None
    mark = [F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")]
    while True:
        now = tuple(e.agg(*mark).collect()[0])
        if now == before or now[0] == 0:
            break
        before = now
        e = cut(_small_star(_large_star(e)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
