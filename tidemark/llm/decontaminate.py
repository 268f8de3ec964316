"""Benchmark decontamination: a broadcast hash set of test n-grams, token windows scanned, hits verified.

Text is lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is 13
consecutive words of an item; a shorter item (but not an empty one) is one window.  Documents are scanned in
Arrow batches: window hashes by running sums, a bit table and a sorted hash set for candidates, then every hit is
compared byte for byte with the window's words.

The set that a task holds is bounded: ``block_bytes`` of item text, whose windows take about seven times that.  A
larger benchmark is scanned block by block, and the hits, keyed by the digest of the text (a document's hits depend on its text alone), are put
together by a grouping; the result does not depend on the number of blocks.

Defined results: a null text has no words; an item with null id hits words but is not listed; repeated items
count once an id; repeated documents are judged alike.  Very long texts are scanned whole.  Other columns of either
table may have any names.  Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tidemark.llm import textkit as tk
from tidemark.llm.frames import Shared, fresh

WINDOW = 13
SHARE = 20  # contaminated: at least one word in 20 is hit
BLOCK_BYTES = 16 << 20

_RESULT = ("struct<n_words:long,n_hit:long,n_items:long,items_sha256:string,contaminated:boolean,"
           "starts:array<int>,stops:array<int>,items:array<string>>")


class WindowSet:
    """Windows by their length in words: hashes, places in one buffer of the items' words, and the items that hold them.

    A window is two numbers into that buffer, never bytes of its own: about 40 bytes a word of benchmark text, and
    three times that while it is built.
    """

    def __init__(self, items: list[tuple[str | None, str]], n: int = WINDOW):
        raw, off = tk.buffers(pa.array([t for _, t in items], pa.large_string()))
        self.ids = [i for i, _ in items]
        found: dict[int, list] = defaultdict(list)
        buffers, base = [], 0
        for first, _, buf, o in tk.sliced(raw, off):
            w = tk.Words(buf, o, tk.ALNUM)
            h = w.hashes()
            joined, js, je = w.joined()
            count = w.counts()
            size = np.minimum(count, n)
            for k in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == k)
                many = count[at] - k + 1
                start = tk.ragged(w.bounds[at], many)
                found[k].append((tk.run_hashes(h, k)[start], (base + js[start]).astype(np.int32),
                                 (je[start + k - 1] - js[start]).astype(np.int32), np.repeat(first + at, many).astype(np.int32)))
            buffers.append(joined)
            base += len(joined)
        self.data = np.concatenate(buffers) if buffers else np.zeros(0, np.uint8)
        self.sizes = {k: self._merged(*(np.concatenate(x) for x in zip(*found[k], strict=True))) for k in sorted(found)}

    def _merged(self, h, start, size, owner):
        """Equal windows as one, in order of their hashes, with the items of each (as ranges of an array)."""
        order = np.argsort(h, kind="stable")
        h, start, size, owner = h[order], start[order], size[order], owner[order]
        head = np.ones(len(h), bool)
        head[1:] = h[1:] != h[:-1]
        group = np.cumsum(head) - 1
        odd = ~self._same(start, size, *(x[np.flatnonzero(head)][group] for x in (start, size)))
        if odd.any():  # windows of one hash that differ: those beside the first kind stand as windows of their own
            rank = np.zeros(len(h), np.int64)
            for i in np.flatnonzero(odd):
                kinds: dict[bytes, int] = {}
                for j in np.flatnonzero(group == group[i]):
                    rank[j] = kinds.setdefault(self.data[start[j]:start[j] + size[j]].tobytes(), len(kinds))
            order = np.lexsort((rank, group))
            h, start, size, owner, rank, group = (x[order] for x in (h, start, size, owner, rank, group))
            head[1:] = (group[1:] != group[:-1]) | (rank[1:] != rank[:-1])
            group = np.cumsum(head) - 1
        pair = np.ones(len(h), bool)  # an item that holds a window twice counts once
        order = np.lexsort((owner, group))
        group, owner = group[order], owner[order]
        pair[1:] = (group[1:] != group[:-1]) | (owner[1:] != owner[:-1])
        owners, ptr = owner[pair], np.searchsorted(group[pair], np.arange(int(head.sum()) + 1))
        h, start, size = h[head], start[head], size[head]
        bits = max(10, min(24, int(len(h) * 64).bit_length()))
        table = np.zeros(1 << bits, bool)
        table[(h >> np.uint64(64 - bits)).astype(np.int64)] = True
        return h, start, start + size, (owners, ptr), table, np.uint64(64 - bits)

    def _same(self, a, size_a, b, size_b) -> np.ndarray:
        """Are the bytes of two windows equal, pair by pair?  A few megabytes at a time."""
        out = size_a == size_b
        at = np.flatnonzero(out & (a != b))
        total = np.cumsum(size_a[at], dtype=np.int64)
        for part in np.split(at, np.searchsorted(total, np.arange(4_000_000, int(total[-1]) if len(at) else 0, 4_000_000))):
            if len(part):
                n = size_a[part].astype(np.int64)
                same = self.data[tk.ragged(a[part].astype(np.int64), n)] == self.data[tk.ragged(b[part].astype(np.int64), n)]
                out[part] = np.logical_and.reduceat(same, np.cumsum(n) - n)
        return out

    def hits(self, w: tk.Words):
        """Yields (size, first word of the hit, index of the window) arrays, verified; windows never cross texts."""
        if not len(w):
            return
        h = w.hashes()
        joined, js, je = w.joined()
        doc = w.docs()
        data = self.data
        for size, (hashes, ws, we, _, table, shift) in self.sizes.items():
            rh = tk.run_hashes(h, size)
            at = np.flatnonzero(table[(rh >> shift).astype(np.int64)])
            at = at[doc[at] == doc[at + size - 1]]
            lo = np.searchsorted(hashes, rh[at])
            # windows of one hash are neighbours: try each of them
            while len(at):
                ok = lo < len(hashes)
                at, lo = at[ok], lo[ok]
                ok = hashes[lo] == rh[at]
                at, lo = at[ok], lo[ok]
                length = je[at + size - 1] - js[at]
                same = length == we[lo] - ws[lo]
                a, b, ln = js[at[same]], ws[lo[same]], length[same]
                if len(a):
                    equal = joined[tk.ragged(a, ln)] == data[tk.ragged(b, ln)]
                    ok = np.logical_and.reduceat(equal, np.cumsum(ln) - ln)
                    yield size, at[same][ok], lo[same][ok]
                lo = lo + 1

    def items(self, size: int, i: int) -> list[str]:
        """The ids of the items that hold a window; items without an id are not listed."""
        owners, ptr = self.sizes[size][3]
        return [self.ids[o] for o in owners[ptr[i]:ptr[i + 1]] if self.ids[o] is not None]


def scan(texts: pa.Array, windows: WindowSet) -> list[tuple[int, list, list, list]]:
    """For every text: number of words, hit runs as word starts and stops, and the sorted ids of items that occur."""
    raw, off = tk.buffers(texts)
    out = []
    for _, _, buf, o in tk.sliced(raw, off):
        w = tk.Words(buf, o, tk.ALNUM)
        n = len(o) - 1
        step = np.zeros(len(w) + 1, np.int32)
        seen: dict[int, set] = defaultdict(set)
        for size, at, win in windows.hits(w):
            np.add.at(step, at, 1)
            np.add.at(step, at + size, -1)
            d = np.searchsorted(w.bounds, at, "right") - 1
            for doc, i in np.unique(np.stack([d, win], 1), axis=0):
                seen[int(doc)].update(windows.items(size, int(i)))
        hit = np.cumsum(step[:-1]) > 0
        counts = w.counts()
        if not hit.any():
            out += [(int(c), [], [], []) for c in counts]
            continue
        for d in range(n):
            a, b = w.bounds[d], w.bounds[d + 1]
            edge = np.diff(np.concatenate([[0], hit[a:b].view(np.int8), [0]]))
            out.append((int(counts[d]), np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(),
                        sorted(seen.get(d, ()))))
    return out


def judged(n_words: int, starts: list, stops: list, items: list[str]) -> dict:
    hit = sum(stops) - sum(starts)
    return {"n_words": n_words, "n_hit": hit, "n_items": len(items),
            "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(),
            "contaminated": hit > 0 and SHARE * hit >= n_words, "starts": starts, "stops": stops, "items": items}


_TYPE = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
                   ("contaminated", pa.bool_()), ("starts", pa.list_(pa.int32())), ("stops", pa.list_(pa.int32())),
                   ("items", pa.list_(pa.string()))])


def _blocks(benchmark: DataFrame, text_col: str, id_col: str, block_bytes: int) -> list:
    """Broadcast window sets, each of at most ``block_bytes`` of item text (one longer item alone)."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).where("t is not null")
    out, block, size = [], [], 0
    for r in items.distinct().orderBy("t", "id").toLocalIterator():
        if block and size + len(r["t"]) > block_bytes:
            out.append(Shared(spark, block))
            block, size = [], 0
        block.append((r["id"], r["t"]))
        size += len(r["t"])
    return [*out, Shared(spark, block)]


def with_hits(docs: DataFrame, benchmark: DataFrame, out: str, text_col: str = "text", item_text_col: str = "text",
              item_id_col: str = "item_id", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, n_items, items_sha256, contaminated, hit word runs
    (starts, stops) and items."""
    blocks = _blocks(benchmark, item_text_col, item_id_col, block_bytes)

    def scanner(shared):
        @arrow_udf(_RESULT)
        def run(texts: pa.Array) -> pa.Array:
            return pa.array([judged(*x) for x in scan(texts, shared.get(WindowSet))], _TYPE)

        return run

    if len(blocks) == 1:
        return docs.withColumn(out, scanner(blocks[0])(F.col(text_col)))
    key, a, b, i = fresh(docs.withColumn(out, F.lit(1)), "text_key", "hit_starts", "hit_stops", "hit_items")
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    part = None
    for block in blocks:
        one = docs.select(digest.alias(key), scanner(block)(F.col(text_col)).alias("r")).where("r.n_hit > 0").distinct()
        part = one if part is None else part.unionByName(one)

    @arrow_udf(_RESULT)
    def merged(n: pa.Array, starts: pa.Array, stops: pa.Array, items: pa.Array) -> pa.Array:
        rows = []
        for k, ss, es, ids in zip(n.to_pylist(), starts.to_pylist(), stops.to_pylist(), items.to_pylist(), strict=True):
            runs: list[list[int]] = []
            for s, e in sorted((s, e) for x, y in zip(ss or [], es or [], strict=True) for s, e in zip(x, y, strict=True)):
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            rows.append(judged(k, [r[0] for r in runs], [r[1] for r in runs], sorted({x for y in ids or [] for x in y})))
        return pa.array(rows, _TYPE)

    hits = part.groupBy(key).agg(F.collect_list("r.starts").alias(a), F.collect_list("r.stops").alias(b),
                                 F.collect_list("r.items").alias(i))
    counts = F.coalesce(F.regexp_count(F.translate(F.col(text_col), _UPPER, _UPPER.lower()),
                                       F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]++")), F.lit(0)).cast("long")
    joined = docs.withColumn(key, digest).join(hits, key, "left")
    return joined.withColumn(out, merged(counts, F.col(a), F.col(b), F.col(i))).select(*docs.columns, out)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit, = fresh(docs, "hits")
    return with_hits(docs, benchmark, hit, **options).select(
        id_col, *[f"{hit}.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents."""
    hit, = fresh(docs, "hits")
    return with_hits(docs, benchmark, hit, **options).where(f"not {hit}.contaminated").select(*docs.columns)


def cut_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with the hit words cut out of the text: each hit run goes, from its first to its last word's bytes."""
    hit, = fresh(docs, "hits")

    @arrow_udf("string")
    def without(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
        out = []
        for t, a, b in zip(texts, starts.to_pylist(), stops.to_pylist(), strict=True):
            if not a:
                out.append(t.as_py())
                continue
            raw, off = tk.buffers(pa.array([t.as_py()], pa.large_string()))
            w = tk.Words(raw, off, tk.ALNUM)
            stay = np.ones(len(raw), bool)
            for s, e in zip(a, b, strict=True):
                stay[w.start[s]:w.end[e - 1]] = False
            out.append(raw[stay].tobytes().decode())
        return pa.array(out, pa.string())

    marked = with_hits(docs, benchmark, hit, text_col=text_col, **options)
    cleaned = without(F.col(text_col), F.col(f"{hit}.starts"), F.col(f"{hit}.stops"))
    return marked.select(*[cleaned.alias(c) if c == text_col else F.col(c) for c in docs.columns])
