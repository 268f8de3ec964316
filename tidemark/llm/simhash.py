"""SimHash near-duplicates found through a segment-popcount embedding.

Fingerprint: lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, shingles of
``shingle`` words (repeats included; a shorter text is one shingle; no words:
fingerprint zero); a bit is 1 if it is set in over half of the shingles'
XXH64 values (seed 42).

Search: the 64 bits are cut into 32 segments of two bits, and a fingerprint is
embedded as its 32 segment bit counts.  Two fingerprints that differ in d bits
lie at most d apart in that embedding under Manhattan distance, so the
distance of the counts is a lower bound of the Hamming distance.  The grids:
the segments are dealt into ``max_bits + 3`` groups, and if the counts are at
most ``max_bits`` apart, at least 3 groups agree wholly.  Each choice of 3
groups is one grid whose cell is the counts of those groups; a range join
within ``max_bits`` becomes an equi-join on (grid, cell), whose candidates
must pass the Manhattan bound and then the exact bit distance.

Equal fingerprints are one class before the join, so copies are never
expanded.  Components run over fingerprints; a class takes the smallest
doc_id.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm.components import components
from tidemark.llm.frames import cut, fresh

SHINGLE = 3
MAX_BITS = 3
_AGREE = 3
_LOW = 0x5555555555555555

# _BITS[byte] = its eight bits, lowest first
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash64(text: str | None, shingle: int = SHINGLE) -> int:
    """The fingerprint of one text as an unsigned number."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) >= shingle:
        parts = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)))
    else:
        parts = [b" ".join(words)]
    digest = xxhash.xxh64_intdigest
    n = len(parts)
    h = np.fromiter((digest(p, 42) for p in parts), np.uint64, n).astype("<u8")
    set_bits = np.concatenate([np.bincount(h.view(np.uint8)[i::8], minlength=256) @ _BITS for i in range(8)])
    return int((2 * set_bits > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """SimHash of a text column as a signed long (the 64 bits of the unsigned fingerprint)."""

    @arrow_udf("long")
    def fp(texts: pa.Array) -> pa.Array:
        out = np.fromiter((simhash64(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
        return pa.array(out.view(np.int64))

    return fp(text)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_masks(max_bits: int = MAX_BITS) -> list[int]:
    """One mask a grid: the 2-bit segments of 3 of the ``max_bits + 3`` groups (signed 64-bit numbers)."""
    groups = np.array_split(np.arange(32), max_bits + _AGREE)
    return [_signed(sum(3 << (2 * int(s)) for g in pick for s in groups[g]))
            for pick in combinations(range(max_bits + _AGREE), _AGREE)]


def segment_counts(fp: Column) -> Column:
    """The embedding, packed: every 2-bit field holds the bit count (0 to 2) of that segment."""
    lo, hi = fp.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(_LOW))
    return lo.bitwiseXOR(hi).bitwiseOR(F.shiftleft(lo.bitwiseAND(hi), 1))


def count_distance(a: Column, b: Column) -> Column:
    """Manhattan distance of two packed embeddings: fields 0, 1, 2 differ by 1 if both xor bits are set."""
    x = a.bitwiseXOR(b)
    lo, hi = x.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(x, 1).bitwiseAND(F.lit(_LOW))
    return F.bit_count(lo) + 2 * F.bit_count(hi) - 2 * F.bit_count(lo.bitwiseAND(hi))


def near_pairs(prints: DataFrame, col: str = "fp", max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b), a < b: all pairs of distinct fingerprints that differ in at most ``max_bits`` bits."""
    grids = F.array(*[F.struct(F.lit(i).alias("g"), F.lit(m).alias("m")) for i, m in enumerate(grid_masks(max_bits))])
    base = prints.select(F.col(col).alias("fp"), segment_counts(F.col(col)).alias("e"), F.explode(grids).alias("x"))
    cells = base.select("fp", "e", "x.g", F.col("e").bitwiseAND(F.col("x.m")).alias("cell"))
    left = cells.select(F.col("fp").alias("a"), F.col("e").alias("ea"), "g", "cell")
    right = cells.select(F.col("fp").alias("b"), F.col("e").alias("eb"), "g", "cell")
    near = (F.col("a") < F.col("b")) & (left["g"] == right["g"]) & (left["cell"] == right["cell"]) & (
        count_distance(F.col("ea"), F.col("eb")) <= max_bits) & (
        F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return left.join(right, near).select("a", "b").distinct()


def _rooted(rows: DataFrame, max_bits: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``rows``; root is one fingerprint of its component."""
    classes = cut(rows.select("fp").distinct())
    linked = components(near_pairs(classes, "fp", max_bits)).select(F.col("node").alias("fp"), "root")
    return classes.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE,
                   max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fp, component_id) of every row: component_id is the smallest id reachable by links of near fingerprints.

    Defined results: a null or blank text has fingerprint zero and links like any other.  Rows with a null id
    are in their text's component but never name it; a component without any id gets null.  Repeated rows stay.
    Very long texts are read whole.  Other columns of ``docs`` are not read, whatever their names.  Empty table: no rows.
    """
    rows = cut(docs.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col), shingle).alias("fp")))
    low = rows.groupBy("fp").agg(F.min("id").alias("low"))
    rooted = cut(_rooted(rows, max_bits).join(low, "fp"))
    named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    member = rooted.join(named, "root").select("fp", "component_id")
    return rows.join(member, "fp").select("id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE,
                  max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each component, all columns kept: that of the smallest id, of whatever type ids are.

    Null ids come last; several texts under that id: the one with the smallest hash; rows equal in both: the one with
    the smallest hash of all columns.  Null and blank texts are one component.  Very long texts are read whole, one at a
    time, at about 25 bytes a byte of text.  Empty table: no rows.  Columns of any name pass through.
    """
    no_id, kid, sid, th = fresh(docs, "no_id", "row_id", "id_text", "text_hash")
    as_text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = [F.col(id_col).isNull().alias(no_id), F.col(id_col).alias(kid), as_text.alias(sid), F.xxhash64(text_col).alias(th)]
    rows = cut(docs.select(*key, fingerprint(F.col(text_col), shingle).alias("fp")))
    per_print = rows.groupBy("fp").agg(F.min(F.struct(no_id, kid, sid, th)).alias("k"))  # copies meet the join as one row
    first = per_print.join(_rooted(rows, max_bits), "fp").groupBy("root").agg(F.min("k").alias("k"))
    same = [no_id, sid, th]  # plain equality of three columns: the join's shuffle serves the grouping as well
    found = docs.select("*", *[c for n, c in zip((no_id, kid, sid, th), key, strict=True) if n != kid]).join(
        first.select(*[f"k.{c}" for c in same]), same)
    one = found.groupBy(*same).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("r"))
    return one.select("r.*")
