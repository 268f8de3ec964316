"""Mixing sources to target weights: repetition rates from token totals, whole copies plus a seeded Bernoulli one.

Native throughout.  The only wide step is one partially aggregated sum per
source; rates come back to the documents by a join on the source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.frames import cut, fresh

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_REPEAT = 2
SEED = "mix-1"
BROADCAST_SOURCES = 10_000
BROADCAST_BYTES = 4 << 20


def text_size(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, source_col: str, size_col: str, weights: Sequence[int] = WEIGHTS,
                   share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target): one row a source.

    Sources take the weights in turn in code-point order, null last.  Together they get ``share`` of all sizes by
    weight; a target stops at ``max_repeat`` times its source's size and the excess is shared again by weight
    until none is above.  That fixed point is found directly: sort by cap / weight; the sources before the first
    one that its level lambda = (budget - caps before) / (weights from there on) does not reach are capped, all
    others get lambda * weight.
    """
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum(size_col).alias("source_size"))
    per = cut(per)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    ranked = per.select("source", "source_size", w.cast("long").alias("w")).withColumn(
        "cap", F.col("source_size") * max_repeat)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) * F.lit(float(share))
             - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(onward)
    leveled = ranked.withColumn("level", level)
    fits = F.col("level") * F.col("w") <= F.col("cap")
    leveled = leveled.withColumn("lam", F.min(F.when(fits, F.struct(
        (F.col("cap") / F.col("w")).alias("r"), F.col("level").alias("l")))).over(everything)["l"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("lam") * F.col("w"), F.col("cap").cast("double")))
    return leveled.select("source", "source_size", target.alias("target"))


def coin(ids: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) that depends on id and text alone: the first 13 hex digits of md5(seed:id:text)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(named), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def mix_plan(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id",
             weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT, seed: str = SEED,
             keep: Sequence[str] = (), names: Sequence[str] = ("size", "source_size", "target", "copies")) -> DataFrame:
    """Every document with its size, its source's size and target, and how often the mix takes it.

    copies = floor(rate) + (coin < fraction), rate = target / source_size.  Null text: size 0.  A null source is
    a source of its own.  Rows equal in id and text share one coin; rows that only share an id, or have none, do not.
    A source without words is taken 0 times.  Very long texts are counted and hashed whole.  ``keep``: columns of
    ``docs`` to carry, whatever their names.  Empty table: no rows.
    """
    size, ssize, target, copies = names
    src, draw, key_col = fresh(docs, "mix_source", "mix_coin", "mix_key")
    sized = docs.select(*[docs[c] for c in keep], F.col(source_col).alias(src),
                        coin(F.col(id_col), F.col(text_col), seed).alias(draw), text_size(F.col(text_col)).alias(size))
    targets = cut(source_targets(sized, src, size, weights, share, max_repeat)).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias(key_col),
        F.col("source_size").alias(ssize), F.col("target").alias(target))
    n, width = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(key_col) + 40), F.lit(0))).collect()[0]
    if n <= BROADCAST_SOURCES and width <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    key = F.coalesce(F.concat(F.lit("="), F.col(src)), F.lit(""))
    rate = F.when(F.col(ssize) > 0, F.col(target) / F.col(ssize)).otherwise(F.lit(0.0))
    joined = sized.withColumn(key_col, key).join(targets, key_col)
    n_copies = F.floor(rate) + (F.col(draw) < rate - F.floor(rate)).cast("long")
    return joined.select(*keep, size, ssize, target, n_copies.cast("long").alias(copies))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id", **options) -> DataFrame:
    """The mixed corpus: every document as often as ``mix_plan`` says, with the columns of ``docs``."""
    names = fresh(docs, "mix_size", "mix_source_size", "mix_target", "mix_copies")
    planned = mix_plan(docs, text_col, source_col, id_col, keep=docs.columns, names=names, **options)
    one, = fresh(planned, "mix_copy")
    return planned.where(F.col(names[3]) > 0).withColumn(
        one, F.explode(F.sequence(F.lit(1).cast("long"), F.col(names[3])))).select(*docs.columns)
