"""Ranked lexical search over hashed max-sketches.

Terms are ASCII letters (lower-cased), digits and all characters beyond ASCII, in maximal runs.  A term's impact in
a document rises with its occurrences tf and falls with the document's length; an item's score is the sum over its
terms of weight times impact, in 64-bit integers (``impact``, ``weight``).

Index: one row a document with its number of terms and a sketch of ``ROWS`` rows of 2**bits bytes, at least twice as
many as it has distinct terms.  Every term is hashed to one place of each row, and a place holds the largest
occurrence count that falls on it, rounded up to a byte.  The impact rises with the count, so this is the maximum
of the impacts at that place whatever the corpus statistics turn out to be: they enter at look-up, and an index
outlives changes of N and L.

Search, for a block of items at a time: (1) exact document frequencies of the block's terms; (2) a batched look-up
of all terms in all sketches, the smallest of a term's places bounding its impact, gives an upper bound of every score; (3) the
``FIRST`` documents of largest bound of each item are scored exactly, whose k-th score is the item's threshold; the next
ones in descending order of bounds (``DEEPER``) lift it; (4) every document whose bound reaches the threshold is
scored exactly.  What is left out has a bound, hence a score, below k scores that are known: the result is exact.

Documents are told apart by a 128-bit hash of their text; copies score alike and are scored as one key.  Matches of
hashes are compared byte for byte, so a collision of term hashes changes no result.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textkit as tk
from tidemark.llm.frames import Shared, cut
from tidemark.session import remove_path, shared_dir

ROWS = 2
MIN_BITS = 5
FIRST = 40
DEEPER = 400
BLOCK_ITEMS = 256
BLOCK_BYTES = 1 << 20
BROADCAST_KEYS = 500_000  # candidate keys at 16 bytes and a short list each; more are joined by a shuffle
SALTS = 32
# fixed values: the length rule and the weights' scale
LENGTH_BASE, LENGTH_SHARE, TF_SCALE, LENGTH_SCALE, IMPACT_SCALE, WEIGHT_SCALE = 75, 25, 1000, 12, 10**9, 1000

#: what a byte of a sketch stands for: counts up to 200 themselves, larger ones rounded up in steps of a third
LEVEL = np.concatenate([np.arange(201), np.ceil(200 * 1.34 ** np.arange(1, 56))]).astype(np.int64)
_SALT = [np.uint64(0), np.uint64(0x5851F42D4C957F2D)]


def weight(n_docs: int, df: int) -> int:
    """Weight of a term that ``df`` of ``n_docs`` documents hold."""
    return math.floor(WEIGHT_SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms, in whole numbers; beyond 64 bits in Python's own."""
    if LENGTH_SHARE * n_docs * int(n.max(initial=0)) < 1 << 63:
        return LENGTH_BASE + (LENGTH_SHARE * n.astype(np.int64) * n_docs) // n_terms
    return np.array([LENGTH_BASE + LENGTH_SHARE * int(x) * n_docs // n_terms for x in n], np.int64)


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (IMPACT_SCALE * tf) // (TF_SCALE * tf + LENGTH_SCALE * m)


def _places(h: np.ndarray, row: int, bits: np.ndarray | int) -> np.ndarray:
    """The place of every term hash in a row of 2**bits."""
    return (tk.mix64(h ^ _SALT[row]) >> (np.uint64(64) - np.asarray(bits).astype(np.uint64))).astype(np.int64)


def _grouped(doc: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, term, occurrences) of every distinct pair, in order; ``doc`` rises already."""
    order = np.lexsort((term, doc))
    d, t = doc[order], term[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return d[at], t[at], np.diff(np.append(at, len(d)))


def sketches(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(number of terms, bits, sketch) of every text of a slice."""
    w = tk.Words(raw, off, tk.ALNUM)
    n = w.counts()
    doc, h, tf = _grouped(w.docs(), w.hashes())
    distinct = np.bincount(doc, minlength=len(n))
    bits = np.maximum(MIN_BITS, np.ceil(np.log2(2 * np.maximum(distinct, 1))).astype(np.int64))
    size = ROWS << bits
    base = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), np.uint8)
    code = np.searchsorted(LEVEL, tf).astype(np.uint8)
    for r in range(ROWS):
        np.maximum.at(flat, base[doc] + (r << bits[doc]) + _places(h, r, bits[doc]), code)
    data = flat.tobytes()
    return n, bits, [data[a:a + s] for a, s in zip(base, size, strict=True)]


def _keys(text_col: str):
    """A text's 128-bit key; null is the empty text."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(F.lit(17), t).alias("k1"), F.xxhash64(F.lit(18), t).alias("k2")


def sketch_index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(k1, k2, n, bits, sketch): one row a document that has a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = tk.buffers(b.column(2))
            for i, j, buf, o in tk.sliced(raw, off):
                n, bits, sketch = sketches(buf, o)
                rows = pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), pa.array(n, pa.int64()),
                     pa.array(bits, pa.int32()), pa.array(sketch, pa.binary())], ["k1", "k2", "n", "bits", "sketch"])
                yield rows.filter(pa.array(n > 0))

    return docs.select(*_keys(text_col), F.col(text_col).alias("t")).mapInArrow(
        run, "k1 long, k2 long, n long, bits int, sketch binary")


class Block:
    """Some items: their terms (bytes and hashes), and the terms of every item with their repeats, item by item."""

    def __init__(self, texts: list[str | None]):
        raw, off = tk.buffers(pa.array(texts, pa.large_string()))
        w = tk.Words(raw, off, tk.ALNUM)
        joined, js, je = w.joined()
        words = [joined[a:b].tobytes() for a, b in zip(js, je, strict=True)]
        hash_of = dict(zip(words, w.hashes().tolist(), strict=True))
        order = sorted(hash_of, key=lambda x: (hash_of[x], x))
        place = {x: i for i, x in enumerate(order)}
        self.hashes = np.array([hash_of[x] for x in order], np.uint64)
        self.data = np.frombuffer(b"".join(order), np.uint8)
        size = np.array([len(x) for x in order], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        per = [sorted(Counter(place[x] for x in words[a:b]).items()) for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
        self.items = len(per)
        self.first = np.concatenate([[0], np.cumsum([len(p) for p in per])]).astype(np.int64)
        self.term = np.array([t for p in per for t, _ in p], np.int64)
        self.repeats = np.array([c for p in per for _, c in p], np.int64)
        bits = max(10, min(22, (len(order) * 64).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(self.hashes >> self.shift).astype(np.int64)] = True
        self.weights = np.zeros(len(order), np.int64)

    def find(self, w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
        """(word, term) of every word of a slice that is a term of the block; compared byte for byte."""
        h = w.hashes()
        word = np.flatnonzero(self.table[(h >> self.shift).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[word])
        words, terms = [], []
        while len(word):  # terms of one hash are neighbours: each of them is tried
            ok = at < len(self.hashes)
            word, at = word[ok], at[ok]
            ok = self.hashes[at] == h[word]
            word, at = word[ok], at[ok]
            size = w.end[word] - w.start[word]
            ok = size == self.end[at] - self.start[at]
            a, t, s = word[ok], at[ok], size[ok]
            if len(a):
                same = np.logical_and.reduceat(w.buf[tk.ragged(w.start[a], s)] == self.data[tk.ragged(self.start[t], s)],
                                               np.cumsum(s) - s)
                words.append(a[same])
                terms.append(t[same])
            at = at + 1
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        words, terms = np.concatenate(words), np.concatenate(terms)
        order = np.argsort(words, kind="stable")
        return words[order], terms[order]

    def counted(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of terms of every text; text, term and occurrences of every term of the block that a text holds)."""
        w = tk.Words(raw, off, tk.ALNUM)
        word, term = self.find(w)
        return (w.counts(), *_grouped(np.searchsorted(w.bounds, word, "right") - 1, term))

    def bounds(self, n: np.ndarray, bits: np.ndarray, sketch: list[bytes], n_docs: int, n_terms: int) -> np.ndarray:
        """Upper bound of every item's score (rows) in every document (columns)."""
        out = np.zeros((self.items, len(n)), np.float32)
        if not len(self.term):
            return out
        some = np.flatnonzero(np.diff(self.first))
        pull = (self.repeats * self.weights[self.term]).astype(np.float32)[:, None]
        scale = (LENGTH_SCALE * length_norm(n, n_docs, n_terms) / TF_SCALE).astype(np.float32)
        level = LEVEL.astype(np.float32)
        for b in np.unique(bits):
            at = np.flatnonzero(bits == b)
            step = max(16, 4_000_000 // max(len(self.term), len(self.hashes)))
            for k in range(0, len(at), step):
                d = at[k:k + step]
                flat = np.frombuffer(b"".join([sketch[x] for x in d]), np.uint8).reshape(len(d), ROWS << int(b)).T
                code = flat[_places(self.hashes, 0, int(b))]
                for r in range(1, ROWS):
                    code = np.minimum(code, flat[(r << int(b)) + _places(self.hashes, r, int(b))])
                tf = level[code]
                top = tf / (tf + scale[d])
                part = np.add.reduceat(top[self.term] * pull, self.first[some], axis=0)
                out[np.ix_(some, d)] = part
        # the impact's scale is a millionth of the sum's; the margin is beyond what 32-bit sums can lose
        return np.where(out > 0, out * np.float32(IMPACT_SCALE / TF_SCALE * 1.002) + 1, 0)

    def scores(self, raw: np.ndarray, off: np.ndarray, pair_doc: np.ndarray, pair_item: np.ndarray, n_docs: int,
               n_terms: int) -> np.ndarray:
        """Exact scores of (text of the slice, item) pairs, ``pair_doc`` rising."""
        n, doc, term, tf = self.counted(raw, off)
        gain = self.weights[term] * impact(tf, length_norm(n, n_docs, n_terms)[doc])
        out = np.zeros(len(pair_doc), np.int64)
        step = max(1, 4_000_000 // max(1, len(self.hashes)))
        for lo in range(0, len(off) - 1, step):
            dense = np.zeros((min(step, len(off) - 1 - lo), len(self.hashes)), np.int64)
            a, b = np.searchsorted(doc, [lo, lo + step])
            dense[doc[a:b] - lo, term[a:b]] = gain[a:b]
            a, b = np.searchsorted(pair_doc, [lo, lo + step])
            for p in range(a, b, 100_000):
                d, q = pair_doc[p:min(b, p + 100_000)] - lo, pair_item[p:min(b, p + 100_000)]
                size = self.first[q + 1] - self.first[q]
                at = tk.ragged(self.first[q], size)
                value = dense[np.repeat(d, size), self.term[at]] * self.repeats[at]
                total = np.concatenate([[0], np.cumsum(value)])
                ends = np.cumsum(size)
                out[p:p + len(d)] = total[ends] - total[ends - size]
        return out


def _frequencies(docs: DataFrame, block: Shared, terms: int, text_col: str) -> np.ndarray:
    """How many documents hold each term of the block; one number a term comes to the driver."""

    def run(batches):
        total = np.zeros(terms, np.int64)
        for b in batches:
            for _, _, buf, o in tk.sliced(*tk.buffers(b.column(0))):
                _, _, term, _ = block.get().counted(buf, o)
                total += np.bincount(term, minlength=terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    out = np.zeros(terms, np.int64)
    for r in docs.select(text_col).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


def _bounded(index: DataFrame, block: Shared, n_docs: int, n_terms: int, lows: np.ndarray | None, keep: int) -> DataFrame:
    """(item, bound, k1, k2): with ``lows`` all bounds above 0 that reach the item's; else each task's ``keep`` largest."""

    def frame(item, bound, k1, k2):
        return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(bound, pa.float64()), pa.array(k1, pa.int64()),
                                           pa.array(k2, pa.int64())], ["item", "bound", "k1", "k2"])

    def run(batches):
        held = None
        for b in batches:
            n, bits = b.column("n").to_numpy(), b.column("bits").to_numpy()
            k1, k2 = b.column("k1").to_numpy(), b.column("k2").to_numpy()
            sketch = b.column("sketch").to_pylist()
            for i in range(0, len(n), 2048):
                j = i + 2048
                bound = block.get().bounds(n[i:j], bits[i:j], sketch[i:j], n_docs, n_terms)
                if lows is not None:
                    item, d = np.nonzero((bound >= lows[:, None]) & (bound > 0))
                    yield frame(item, bound[item, d], k1[i:j][d], k2[i:j][d])
                    continue
                keys = [np.broadcast_to(x[i:j], bound.shape) for x in (k1, k2)]
                held = [bound, *keys] if held is None else [np.concatenate(x, 1) for x in zip(held, (bound, *keys), strict=True)]
                if held[0].shape[1] > keep:
                    best = np.argpartition(-held[0], keep - 1, 1)[:, :keep]
                    held = [np.take_along_axis(x, best, 1) for x in held]
        if held is not None:
            item, d = np.nonzero(held[0])
            yield frame(item, *(x[item, d] for x in held))

    return index.mapInArrow(run, "item int, bound double, k1 long, k2 long")


def _largest(rows: DataFrame, part: str, order: list, k: int) -> DataFrame:
    """The first k rows of every part: in salted groups first, so no task meets all tasks' rows of a part."""
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)))
    few = salted.withColumn("_r", F.row_number().over(Window.partitionBy(part, "_s").orderBy(*order))).where(F.col("_r") <= k)
    return few.drop("_s").withColumn("_r", F.row_number().over(Window.partitionBy(part).orderBy(*order))).where(F.col("_r") <= k)


def _scored(docs: DataFrame, wanted: DataFrame, block: Shared, n_docs: int, n_terms: int, lows: np.ndarray, text_col: str,
            id_col: str) -> DataFrame:
    """(item, id, score): exact scores above 0 that reach the item's low, of every document whose key is wanted."""
    keys = cut(wanted.groupBy("k1", "k2").agg(F.collect_set("item").alias("items")))
    some = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *_keys(text_col)).join(some, ["k1", "k2"]).select(
        "id", "t", "items")

    def run(batches):
        for b in batches:
            raw, off = tk.buffers(b.column(1))
            sets = b.column(2)
            for i, j, buf, o in tk.sliced(raw, off):
                mine = sets.slice(i, j - i)
                doc = np.repeat(np.arange(j - i), mine.value_lengths().to_numpy())
                item = mine.flatten().to_numpy().astype(np.int64)
                score = block.get().scores(buf, o, doc, item, n_docs, n_terms)
                ok = np.flatnonzero((score > 0) & (score >= lows[item]))
                yield pa.RecordBatch.from_arrays([pa.array(item[ok], pa.int32()), b.column(0).take(pa.array(i + doc[ok])),
                                                  pa.array(score[ok])], ["item", "id", "score"])

    return rows.mapInArrow(run, f"item int, id {id_type}, score long")


def _blocks(items: DataFrame, text_col: str, id_col: str) -> Iterator[list]:
    """(id, text) rows of the items, at most ``BLOCK_ITEMS`` and about ``BLOCK_BYTES`` at a time."""
    held, size = [], 0
    for r in items.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).distinct().orderBy("id", "t").toLocalIterator():
        held.append((r["id"], r["t"]))
        size += len(r["t"] or "")
        if len(held) >= BLOCK_ITEMS or size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def search(docs: DataFrame, index: DataFrame, items: DataFrame, k: int = 20, text_col: str = "text", id_col: str = "doc_id",
           item_text_col: str = "text", item_id_col: str = "item_id") -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents of largest score above 0 for every item, from ``index`` of ``docs``.

    Equal scores: ascending id, null ids last; rows of equal id and score are alike in the result.  Null and empty
    texts have no terms, neither found nor finding.  Repeated documents rank each; repeated items (equal id and
    text) count once, items of one id and several texts are ranked each.  Very long texts are read whole, one at a
    time beyond ``textkit.SLICE_BYTES``, at about 80 bytes a word.  Empty tables: no rows.  Other columns are not
    read.  The driver holds one block of items at a time.
    """
    spark = docs.sparkSession
    total = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).collect()[0]
    n_docs, n_terms = int(total["n"]), int(total["l"] or 0)
    id_type, item_type = docs.schema[id_col].dataType.simpleString(), items.schema[item_id_col].dataType.simpleString()
    out = None
    best = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    for rows in _blocks(items, item_text_col, item_id_col) if n_docs else ():
        block = Block([t for _, t in rows])
        if not len(block.term):
            continue
        df = _frequencies(docs, Shared(spark, block), len(block.hashes), text_col)
        block.weights = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        shared = Shared(spark, block)
        lows = np.zeros(block.items, np.int64)
        order = [F.col("bound").desc(), "k1", "k2"]
        top = cut(_largest(_bounded(index, shared, n_docs, n_terms, None, max(DEEPER, k)), "item", order, max(DEEPER, k)))
        for depth in (max(FIRST, k), max(DEEPER, k)):
            near = top.where((F.col("_r") <= depth) & (F.col("bound") >= _at(lows)))
            found = _largest(_scored(docs, near, shared, n_docs, n_terms, lows, text_col, id_col), "item", best, k)
            for r in found.groupBy("item").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).collect():
                lows[r["item"]] = r["low"] if r["n"] == k else 0
        rest = _bounded(index, shared, n_docs, n_terms, lows, 0)
        found = _largest(_scored(docs, rest, shared, n_docs, n_terms, lows, text_col, id_col), "item", best, k)
        names = F.broadcast(spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], f"item int, item_id {item_type}"))
        one = cut(found.join(names, "item").select("item_id", F.col("_r").alias("rank"), F.col("id").alias("doc_id"), "score"))
        out = one if out is None else out.unionByName(one)
    return out if out is not None else spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")


def _at(lows: np.ndarray):
    """The low of a row's item (a literal array of one number an item of the block)."""
    return F.element_at(F.lit([int(x) for x in lows]), F.col("item") + 1)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 20, **columns: str) -> DataFrame:
    """``search`` over an index that is written to the shared folder first and deleted with the result settled."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/sketches-{uuid.uuid4().hex}"
    sketch_index(docs, columns.get("text_col", "text")).write.option("compression", "zstd").parquet(path)
    try:
        return search(docs, spark.read.parquet(path), items, k, **columns)
    finally:
        remove_path(spark, path)
