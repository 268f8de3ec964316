"""Embedding near-duplicates by product quantisation.

Index: coarse k-means centroids make inverted lists; a vector's residual to
its centroid is cut into subspaces and each part replaced by the nearest of
256 codewords.  Both codebooks are fitted on a bounded, hashed sample; every
vector is indexed.

Search: every vector is a query.  It probes each list that a neighbour at the
threshold may lie in: a neighbour of list c lies beyond the plane half-way
between the query's own centroid and c, so the list is probed if that plane is
no further away than ``reach`` standard deviations of such a neighbour's
offset across that plane, and never beyond the threshold's own distance, which
no neighbour passes.  The deviation comes from the sample's residuals, so it
follows the directions that vectors do fill, not the number of columns; and
``reach`` grows until it holds ``HELD`` of the sample's own pairs near the
threshold.  In a list, a table of squared distances from the
query's residual to the codewords is built once, and a member's distance is a
sum of table look-ups; a member goes on to the exact cosine (double precision)
if the look-up distance less the member's own reconstruction error is within
the threshold, so the codes lose no pair.

Where the lists, whose number the sample bounds, would hold more than about
``CELL`` members, a second quantiser of the residuals cuts each into cells, and
a query probes the cells of a list by the same rule, from its own residual to
that list; so the cells go on growing with the number of vectors.

Cells are cut into blocks of members and of queries, so no task holds a whole
hot cell.  A pair is met in the cell of either end; each end's probes tell
whether it is met twice, so links are counted without emitting pairs.  For
components a block emits one edge a vector (a spanning forest of its links).
Equal vectors are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import components
from tidemark.llm.frames import Shared, cut, hash_sample

THRESHOLD = 0.9
SAMPLE = 32_768
SUBSPACES = 8
REACH = 3.0
HELD = 0.99
PAIRED = 4096  # vectors of the sample compared with one another to set the reach
CELL = 2048  # members of a cell that are aimed at
CELLS = 256  # cells of a list, at most
BROADCAST_CELLS = 65_536
MEMBERS = 2048
QUERIES = 8192


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centres in float32; an empty centre keeps its place."""
    r = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[r.choice(len(x), k, replace=False)].astype(np.float32)
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        s = np.zeros_like(c, dtype=np.float64)
        np.add.at(s, near, x)
        c[n > 0] = (s[n > 0] / n[n > 0, None]).astype(np.float32)
    return c


def sq_dist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def nearest(x: np.ndarray, c: np.ndarray, step: int = 2048) -> np.ndarray:
    return np.concatenate([sq_dist(x[i:i + step], c).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


class Index:
    """Coarse centroids and residual codebooks for unit vectors of one length."""

    def __init__(self, sample: np.ndarray, n: int, threshold: float, reach: float = REACH):
        self.dim = sample.shape[1]
        self.max_d = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        lists = int(max(1, min(2 * np.sqrt(n), len(sample) / 16)))
        self.coarse = kmeans(sample, lists)
        self.gap = np.sqrt(sq_dist(self.coarse, self.coarse))
        own = nearest(sample, self.coarse)
        res = sample - self.coarse[own]
        self.margin = self._deviation(res, self.coarse, self.gap)
        held = self._held_reach(sample[:PAIRED], own[:PAIRED], threshold)
        self.margin = np.minimum(self.margin * max(reach, held), self.max_d).astype(np.float32)
        cells = int(max(1, min(np.ceil(n / (len(self.coarse) * CELL)), CELLS, len(sample) / 16)))
        self.fine = kmeans(res[:16_384], cells, seed=6) if cells > 1 else np.zeros((1, self.dim), np.float32)
        self.fine_gap = np.sqrt(sq_dist(self.fine, self.fine))
        across = self._deviation(res, self.fine, self.fine_gap)
        self.fine_margin = np.minimum(across * max(reach, held), self.max_d).astype(np.float32)
        self.cuts = [g for g in np.array_split(np.arange(self.dim), min(SUBSPACES, self.dim)) if len(g)]
        self.books = [kmeans(res[:16_384, g], 256, 6) for g in self.cuts]

    def _deviation(self, res: np.ndarray, centres: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """For every two centres, the deviation across their half-way plane of an offset as long as ``max_d``.

        An offset is taken to spread over the directions as the residuals do; without residuals it may be all across.
        """
        spread = (res.T @ res).astype(np.float64)
        total = np.trace(spread)
        if not total > 1e-9 * len(res):
            return np.full(gap.shape, self.max_d)
        c = centres.astype(np.float64)
        g = c @ spread @ c.T
        across = np.maximum(np.diag(g)[:, None] + np.diag(g)[None] - 2 * g, 0) / np.maximum(gap.astype(np.float64) ** 2, 1e-18)
        return self.max_d * np.sqrt(np.minimum(across / total, 1))

    @staticmethod
    def _planes(d2: np.ndarray, own: np.ndarray, gap: np.ndarray) -> np.ndarray:
        return (d2 - d2[np.arange(len(own)), own][:, None]) / np.maximum(2 * gap[own], 1e-9)

    def _held_reach(self, x: np.ndarray, own: np.ndarray, threshold: float) -> float:
        """Deviations that hold HELD of the pairs of ``x`` near the threshold, by the probes of either end."""
        planes = self._planes(sq_dist(x, self.coarse), own, self.gap)
        got = []
        for i in range(0, len(x), 512):
            cos = x[i:i + 512] @ x.T
            a, b = np.nonzero((cos >= threshold) & (cos <= threshold + 0.4 * (1 - threshold)))
            a, b = a[a + i < b] + i, b[a + i < b]
            near = np.minimum(planes[a, own[b]], planes[b, own[a]]) / np.maximum(self.margin[own[a], own[b]], 1e-9)
            got.append(np.where(own[a] == own[b], 0, near).astype(np.float32))
        got = np.concatenate(got or [np.zeros(0, np.float32)])
        return float(np.quantile(got, HELD)) if len(got) else 0.0

    def place(self, x: np.ndarray):
        """(cell, codes, reconstruction error, probed cells) of every vector; a cell is list * cells of a list + its own."""
        d2 = sq_dist(x, self.coarse)
        own = d2.argmin(1)
        res = x - self.coarse[own]
        codes = np.stack([nearest(res[:, g], b) for g, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        back = np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], 1)
        err = np.linalg.norm(res[:, np.concatenate(self.cuts)] - back, axis=1)
        near = self._planes(d2, own, self.gap) <= self.margin[own] + 1e-6
        near[np.arange(len(x)), own] = True
        cells = len(self.fine)
        if cells == 1:
            return own, codes, err, [np.flatnonzero(p) for p in near]
        row, to = np.nonzero(near)
        asker, probed = [], []
        for i in range(0, len(row), 4096):
            r, c = row[i:i + 4096], to[i:i + 4096]
            d2 = sq_dist(x[r] - self.coarse[c], self.fine)
            mine = d2.argmin(1)
            hit = self._planes(d2, mine, self.fine_gap) <= self.fine_margin[mine] + 1e-6
            hit[np.arange(len(r)), mine] = True
            a, s = np.nonzero(hit)
            asker.append(r[a])
            probed.append(c[a] * cells + s)
        ends = np.searchsorted(np.concatenate(asker), np.arange(1, len(x)))
        return own * cells + sq_dist(res, self.fine).argmin(1), codes, err, np.split(np.concatenate(probed), ends)

    def lookup(self, q: np.ndarray, cells: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Distances of queries to coded members of one cell by table look-up."""
        r = q - self.coarse[cells // len(self.fine)]
        out = np.zeros((len(q), len(codes)), np.float32)
        for j, (g, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += sq_dist(r[:, g], b).astype(np.float32)[:, codes[:, j]]
        return np.sqrt(out)


def _unit(v: pd.Series) -> np.ndarray:
    x = np.stack(v.to_numpy()).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # so that very long or short vectors neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position of its component for each of n positions, given linked positions."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        new = low.copy()
        np.minimum.at(new, a, m)
        np.minimum.at(new, b, m)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _links(classes: DataFrame, index: Index, threshold: float) -> DataFrame:
    """(node, links, to): weighted link counts and forest edges, one or more rows for a linked class."""
    spark = classes.sparkSession
    shared = Shared(spark, index)
    placed_type = T.StructType([*classes.schema.fields, T.StructField("list", T.IntegerType()),
                                T.StructField("codes", T.BinaryType()), T.StructField("err", T.DoubleType()),
                                T.StructField("probes", T.ArrayType(T.IntegerType()))])

    def place(batches):
        for df in batches:
            for i in range(0, len(df), 1024):
                part = df.iloc[i:i + 1024]
                own, codes, err, probes = shared.get().place(_unit(part["v"]).astype(np.float32))
                yield part.assign(list=own.astype(np.int32), codes=[c.tobytes() for c in codes], err=err.astype(float),
                                  probes=[p.astype(np.int32) for p in probes])

    placed = cut(classes.mapInPandas(place, placed_type))
    visits = placed.select("node", "v", "m", F.col("list").alias("own"), F.explode("probes").alias("list"))
    blocks = placed.groupBy("list").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("mk")).join(
        visits.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("qk")), "list")
    blocks = cut(blocks)  # one row a cell
    if len(index.coarse) * len(index.fine) <= BROADCAST_CELLS:
        blocks = F.broadcast(blocks)
    none = F.lit(None)
    deal = lambda k: F.pmod(F.xxhash64("node"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    members = placed.join(blocks, "list").select(
        "list", deal("mk").alias("mb"), every("qk").alias("qb"), F.lit(True).alias("member"), "node", "v", "m",
        F.col("list").alias("own"), "codes", "err", "probes")
    asking = visits.join(blocks, "list").select(
        "list", every("mk").alias("mb"), deal("qk").alias("qb"), F.lit(False).alias("member"), "node", "v", "m", "own",
        none.cast("binary").alias("codes"), none.cast("double").alias("err"), none.cast("array<int>").alias("probes"))

    def search(df: pd.DataFrame) -> pd.DataFrame:
        ix, here = shared.get(), int(df["list"].iloc[0])
        mem, ask = df[df["member"]], df[~df["member"]]
        empty = pd.DataFrame({"node": [], "links": [], "to": []}).astype("int64")
        if mem.empty or ask.empty:
            return empty
        xm, xq = _unit(mem["v"]), _unit(ask["v"])
        codes = np.stack([np.frombuffer(c, np.uint8) for c in mem["codes"]])
        err = mem["err"].to_numpy()
        nm, nq = mem["node"].to_numpy(), ask["node"].to_numpy()
        pa_, pb = [], []
        for i in range(0, len(ask), 512):
            q = xq[i:i + 512]
            d = ix.lookup(q.astype(np.float32), np.full(len(q), here), codes)
            a, b = np.nonzero(d - err[None].astype(np.float32) <= ix.max_d + 1e-3)
            for k in range(0, len(a), 200_000):
                s, t = a[k:k + 200_000], b[k:k + 200_000]
                ok = (np.einsum("ij,ij->i", q[s], xm[t]) >= threshold) & (nq[i + s] != nm[t])
                pa_.append(s[ok] + i)
                pb.append(t[ok])
        a, b = np.concatenate(pa_ or [np.zeros(0, int)]), np.concatenate(pb or [np.zeros(0, int)])
        if not len(a):
            return empty
        mq, mm = ask["m"].to_numpy(), mem["m"].to_numpy()
        own = ask["own"].to_numpy()
        # does the member visit the query's own cell too?  Then the other meeting counts the member's link.
        cells = np.int64(len(ix.coarse) * len(ix.fine))
        size = [len(p) for p in mem["probes"]]
        known = np.repeat(np.arange(len(mem)), size) * cells + np.concatenate(list(mem["probes"]))
        once = ~np.isin(b * cells + own[a], known)
        got_q = np.bincount(a, mm[b], len(ask)).astype(np.int64)
        got_m = np.bincount(b[once], mq[a[once]], len(mem)).astype(np.int64)
        nodes = np.concatenate([nq, nm])
        uniq, at = np.unique(nodes, return_inverse=True)
        low = _forest(at[a], at[len(nq) + b], len(uniq))
        links = np.bincount(at, np.concatenate([got_q, got_m]), len(uniq)).astype(np.int64)
        keep = (links > 0) | (low != np.arange(len(uniq)))
        return pd.DataFrame({"node": uniq[keep], "links": links[keep], "to": uniq[low][keep]})

    return members.unionByName(asking).groupBy("list", "mb", "qb").applyInPandas(search, "node long, links long, to long")


def embedding_groups(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD,
                     sample: int = SAMPLE, reach: float = REACH) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing: n_links 0, and
    they are their own component.  Vectors of different lengths do not link.  Equal vectors link with one another.
    A null id never names a component and is never kept.  Repeated rows are vectors of their own.  Other columns
    are not read, whatever their names.  Empty table: no rows.
    """
    v = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    good = F.coalesce((F.size("v") > 0) & fine, F.lit(False))
    node = F.when(good, F.xxhash64("v"))
    classes = cut(rows.where(good).select("id", "v", node.alias("node")).groupBy("node").agg(
        F.first("v").alias("v"), F.count("*").alias("m"), F.min("id").alias("low")))
    found = None
    for dim, n in classes.groupBy(F.size("v").alias("d")).count().orderBy("d").collect():
        part = classes.where(F.size("v") == dim)
        got = hash_sample(part.select("node", "v"), sample, "node").toPandas().sort_values("node")
        index = Index(_unit(got["v"]).astype(np.float32), n, threshold, reach)
        one = _links(part.select("node", "v", "m"), index, threshold)
        found = one if found is None else found.unionByName(one)
    out = rows.select("id", node.alias("node"))
    if found is None:
        out = out.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("id")})
    else:
        found = cut(found)
        counts = found.groupBy("node").agg(F.sum("links").alias("l"))
        groups = components(found.where("node <> to").select(F.col("node").alias("a"), F.col("to").alias("b")))
        rooted = classes.select("node", "m", "low").join(groups, "node", "left").join(counts, "node", "left").select(
            "node", "low", (F.coalesce("l", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"),
            F.coalesce("root", "node").alias("root"))
        rooted = cut(rooted)
        named = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
        out = out.join(rooted.join(named, "root").select("node", "n_links", "component_id"), "node", "left").select(
            "id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
