from collections import Counter

import numpy as np
import pytest

from tidemark.llm import product_quantiser as pq


def brute(rows, least):
    """All pairs: (vec_id, links, component)."""
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(v is not None and np.isfinite(v) for v in r[1]) and any(r[1])]
    n = {id(r): 0 for r in rows}
    up = {r[0]: r[0] for r in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(good):
        for b in good[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], np.float64), np.array(b[1], np.float64)
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= least:
                    n[id(a)] += 1
                    n[id(b)] += 1
                    p, q = top(a[0]), top(b[0])
                    up[max(p, q)] = min(p, q)
    return sorted(((r[0], n[id(r)], None if r[0] is None else top(r[0])) for r in rows), key=str)


@pytest.mark.parametrize("block", [1024, 16])
def test_clusters_and_odd_vectors(spark, block, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (25, 24))
    rows = []
    for k in range(400):
        v = centres[k % 25 if k % 3 else 0] + rng.normal(0, 0.12 if k % 2 else 0.02, 24)
        rows.append((1000 - k, [float(np.float32(x)) for x in v * (1 + k % 4)], k % 2))
    rows += [(k, rows[5][1], 0) for k in range(2000, 2040)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 24, [nan] * 24, [1.0, None] * 12, [inf] * 24, [1.0, 2.0], [2.0, 4.0], [1e-30] * 24, [1e-30] * 24]
    rows += [(3000 + k, v, 0) for k, v in enumerate(odd)] + [(4000, rows[0][1], None), (None, rows[0][1], 0)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "'z' as node", "1 as weight", "label as unit")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in pq.near_vectors(docs).collect()), key=str)
    want = brute([(r.vec_id, r.embedding, r.label) for r in docs.collect()], 0.98)
    assert got == want


def test_table_recall(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = pq.op6_product_quantisation(spark, sf).collect()
    want = brute(rows, 0.98)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_empty(spark):
    assert pq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_probes_find_every_neighbour():
    rng = np.random.default_rng(3)
    x = pq.units(np.repeat(rng.normal(0, 1, (300, 16)), 4, 0) + rng.normal(0, 0.05, (1200, 16)))
    q = pq.Quantiser(x, len(x))
    own = pq.nearest(x, q.coarse)
    near = (x @ x.T) >= 0.98
    for i, lists in enumerate(q.probes(x, own, 0.2)):
        assert set(own[near[i]].tolist()) <= set(lists.tolist())


def test_one_id_on_two_vectors(spark):
    """Rows that share an id are told apart by their vectors."""
    v, w = [1.0] * 8, [1.0, -1.0] * 4
    near = lambda x: [x[0] * 1.01, *x[1:]]
    rows = [(1, v, 0), (1, w, 1), (2, near(v), 0), (3, near(w), 1), (4, w, 0), (1, w, 0)]
    got = Counter((r.vec_id, r.n_links, r.component_id) for r in pq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == Counter([(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (1, 1, 1)])


@pytest.mark.parametrize("size,rank,n", [(64, 64, 3000), (64, 4, 2000), (256, 2, 1500), (256, 3, 1500), (768, 4, 1200), (768, 6, 1200)])
def test_recall_of_long_vectors(spark, size, rank, n):
    """Long vectors that fill all directions or few: every link is found and none besides."""
    rng = np.random.default_rng(8)
    base = rng.normal(0, 1, (n // 6, rank))
    x = np.concatenate([base, *[base + rng.normal(0, s, base.shape) for s in (0.02, 0.1, 0.15, 0.18, 0.2)]])
    x = (x @ np.linalg.qr(rng.normal(0, 1, (size, rank)))[0].T if rank < size else x).astype(np.float32)
    labels = np.arange(len(x)) % 3
    unit = x.astype(np.float64) / np.sqrt((x.astype(np.float64) ** 2).sum(1, keepdims=True))
    near = (unit @ unit.T >= 0.98) & (labels[:, None] == labels)
    docs = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.n_links for r in pq.near_vectors(docs).collect()}
    want = dict(enumerate((near.sum(1) - 1).tolist()))
    assert sum(want.values()) > 500 and got == want
