import numpy as np

from pyspark.sql import functions as F

from tests.llm.helpers import union_find
from tidemark.llm import pqdedup as pq

NAN, INF = float("nan"), float("inf")


def brute(rows, t=0.9):
    unit = lambda v: (w := v / np.abs(v).max()) / np.linalg.norm(w)
    ok = [(k, i, unit(np.array(v, float))) for k, (i, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, pairs = {k: 0 for k in range(len(rows))}, []
    for n, (k, _, a) in enumerate(ok):
        for m, _, b in ok[n + 1:]:
            if len(a) == len(b) and a @ b >= t - 1e-15:
                pairs.append((k, m))
                links[k] += 1
                links[m] += 1
    root = union_find(range(len(rows)), pairs)
    low = {}
    for k, r in root.items():
        if rows[k][0] is not None:
            low[r] = min(low.get(r, rows[k][0]), rows[k][0])
    good = {k for k, _, _ in ok}
    return [(i, links[k], (low.get(root[k]) if k in good else i)) for k, (i, _) in enumerate(rows)]


def near(r, v, cos):
    v = v / np.linalg.norm(v)
    w = r.normal(size=len(v))
    w -= (w @ v) * v
    return cos * v + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w)


def planted(n=900, dim=64, seed=1):
    r = np.random.default_rng(seed)
    rows = [r.normal(size=dim) for _ in range(n)]
    for k in range(300):
        rows.append(near(r, rows[k], r.uniform(0.9, 1.0)))
    hub = r.normal(size=dim)
    rows += [near(r, hub, 0.97) for _ in range(150)] + [hub * 3] * 40
    return [(i * 3 % 5000, [float(x) for x in v]) for i, v in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def key(r):
    return (r[0] is None, r[0] or 0, r[1])


def test_recall_on_planted_pairs(spark, monkeypatch):
    rows = planted()
    want = sorted(brute(rows), key=key)
    results = []
    for members in (pq.MEMBERS, 40):
        monkeypatch.setattr(pq, "MEMBERS", members)
        monkeypatch.setattr(pq, "QUERIES", 2 * members)
        got = sorted((tuple(r)[:3] for r in pq.embedding_groups(frame(spark, rows)).collect()), key=key)
        results.append(got)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert results[0] == results[1]


def test_cells_of_lists_lose_no_link(spark, monkeypatch):
    """Lists cut into cells by the second quantiser, as they are for very many vectors."""
    monkeypatch.setattr(pq, "CELL", 2)
    monkeypatch.setattr(pq, "BROADCAST_CELLS", 0)
    rows = planted()
    want = sorted(brute(rows), key=key)
    got = sorted((tuple(r)[:3] for r in pq.embedding_groups(frame(spark, rows).withColumn("list", F.lit(1))).collect()), key=key)
    assert sum(g[1] for g in got) >= 0.97 * sum(w[1] for w in want)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))


def low_rank(n, dim, rank, seed=7):
    """n unit vectors of ``rank`` directions in ``dim`` columns, every tenth with a partner at a cosine of 0.90 to 0.93."""
    r = np.random.default_rng(seed)
    y = r.normal(size=(n, rank))
    pairs = [(k, k + 1) for k in range(0, n - 1, 10)]
    for a, b in pairs:
        y[b] = near(r, y[a], r.uniform(0.9, 0.93))
    x = y @ np.linalg.qr(r.normal(size=(dim, rank)))[0].T
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), pairs


def probed(x, pairs, n=None):
    ix = pq.Index(x, n or len(x), 0.9)
    own, _, _, probes = ix.place(x)
    return np.mean([own[b] in probes[a] or own[a] in probes[b] for a, b in pairs]), np.mean([len(p) for p in probes]), len(ix.coarse)


def test_recall_does_not_hang_on_the_number_of_columns():
    for dim, rank in ((768, 16), (1024, 12), (768, 32), (64, 64)):
        x, pairs = low_rank(4000, dim, rank)
        assert probed(x, pairs)[0] >= 0.97, (dim, rank)
        found, cells, _ = probed(x, pairs, n=126 * pq.CELL * 32)  # as of so many vectors: 250 lists of 17 cells
        assert found >= 0.95, (dim, rank, found, cells)
        print(dim, rank, found, cells)


def test_defined_results(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [NAN, 1.0]), (8, [INF, 1.0]),
            (9, [1e-200, 1e-201]), (10, [1e200, 1e199]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.01]), (None, [-5.0, 1.0]), (1, [1.0, 0.0]),
            (12, [-0.0, 1.0]), (13, [0.0, 1.0])]
    got = sorted((tuple(r) for r in pq.embedding_groups(frame(spark, rows)).collect()), key=key)
    assert [g[:3] for g in got] == sorted(brute(rows), key=key)
    assert all(g[3] == (g[0] is not None and g[0] == g[2]) for g in got)


def test_query_equals_brute_force_sf001(spark):
    from tidemark.llm.queries import op9_embeddings

    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted(tuple(r)[:3] for r in op9_embeddings(spark, sf).collect()) == sorted(brute(rows))


def test_empty_table(spark):
    assert pq.embedding_groups(frame(spark, [])).count() == 0
    assert pq.embedding_groups(frame(spark, [(1, None)])).collect()[0][1:] == (0, 1, True)


def test_lookup_distance_bounds_the_true_one():
    r = np.random.default_rng(3)
    x = r.normal(size=(400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ix = pq.Index(x.astype(np.float32), 400, 0.9)
    own, codes, err, probes = ix.place(x.astype(np.float32))
    d = np.stack([ix.lookup(np.repeat(x[i:i + 1], len(x), 0).astype(np.float32)[:1].repeat(1, 0), own[j:j + 1], codes[j:j + 1])[0]
                  for i in range(5) for j in range(len(x))]).reshape(5, -1)
    true = np.linalg.norm(x[:5, None] - x[None], axis=2)
    assert (np.abs(d - true) <= err[None] + 1e-3).all() and all(o in p for o, p in zip(own, probes, strict=True))
