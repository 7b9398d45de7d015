import numpy as np
import pytest

from attesta.llm import cover_search as C


def brute(ids, x, k):
    q, out = np.floor(64 * x), []
    for i, v in zip(ids, q):
        if i % 20 == 0:
            s = q @ v
            order = sorted((-int(b), j) for j, b in zip(ids, s) if j != i)[:k]
            out += [(i, r + 1, j, -b) for r, (b, j) in enumerate(order)]
    return sorted(out)


def search(spark, rows, k=20):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    return sorted(tuple(r) for r in C.top_k(v, v.where("vec_id % 20 = 0"), k).select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("blocks", [None, 100])
def test_against_brute_force(spark, monkeypatch, blocks):
    if blocks:
        monkeypatch.setattr(C, "DATA_BLOCK", blocks)
        monkeypatch.setattr(C, "QUERY_BLOCK", 10)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 16))
    x = (centres[rng.integers(0, 6, 400)] + 0.2 * rng.normal(size=(400, 16))).astype(np.float32) / 4
    x[50:90] = x[50]  # ties
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    assert search(spark, rows) == brute(list(range(400)), x.astype(float), 20)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.5, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1.0]), (20, [1e30, 1.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (7, [])]
    got = search(spark, rows)
    assert [g[:3] for g in got if g[0] == 0] == [(0, 1, 20), (0, 2, 1)]
    assert search(spark, []) == []


def test_tree_covers():
    x = np.random.default_rng(2).normal(size=(500, 8))
    t = C.CoverTree(x, 16)
    assert sorted(t.order.tolist()) == list(range(500))
    for lo, hi, c, r in zip(t.lo, t.hi, t.centre, t.radius):
        assert np.sqrt(((x[t.order[lo:hi]] - x[c]) ** 2).sum(axis=1)).max() <= r + 1e-9
