import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from attesta.llm import block_norms


def plain(rows, k, rounds, dim):
    """k-means in whole numbers of any size, row by row."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    centroids = [v for _, v in sorted(((h(f"1:{i}"), v) for i, v in kept if i is not None), key=lambda x: x[0])[:k]]
    if not centroids:
        return []
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        at = [(place(v)[1], v) for _, v in kept]
        for j in range(len(centroids)):
            own = [v for c, v in at if c == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    found = [(i, *place(v)[::-1]) for i, v in kept]
    total = {j: sum(d for _, c, d in found if c == j) for j in range(len(centroids))}
    cap = lambda x: min(x, block_norms.MOST)
    return [(i, c, d, cap(total[c]), cap(sum(total.values())), h(",".join(map(str, centroids[c])))) for i, c, d in found]


def vectors(spark, rows):
    own = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return own.withColumns({c: F.lit("x") for c in ("v", "mean", "rest", "cluster", "n", "distance", "label")})


def same(got, want):
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_clusters_against_a_plain_loop(spark):
    r = random.Random(1)
    middles = [[r.uniform(-3, 3) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + r.gauss(0, 0.4) for x in r.choice(middles)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [rows[3], rows[3]]  # one vector very often, and a row three times
    got = block_norms.clusters(vectors(spark, rows)).collect()
    same(got, plain(rows, 16, 3, 64))


def test_odd_vectors(spark):
    r = random.Random(2)
    v = lambda s: [r.uniform(-s, s) for _ in range(10)]
    rows = [(i, v(1)) for i in range(20)] + [(30, None), (31, []), (32, [1.0] * 9), (33, [None] + [1.0] * 9), (34, [float("nan")] * 10), (35, [float("inf")] + [0.0] * 9), (None, v(1)), (None, v(1)), (5, v(1))]
    same(block_norms.clusters(vectors(spark, rows), k=4, dim=10).collect(), plain(rows, 4, 3, 10))
    same(block_norms.clusters(vectors(spark, rows[:3]), k=16, dim=10).collect(), plain(rows[:3], 16, 3, 10))
    none = block_norms.clusters(vectors(spark, []), dim=10)
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert block_norms.clusters(vectors(spark, rows[-3:-1]), dim=10).count() == 0  # no id to start from


def test_large_components(spark):
    """Distances near and beyond 64 bits are exact, or end there."""
    r = random.Random(3)
    rows = [(i, [r.choice((-1, 1)) * r.uniform(1e6, 2.5e6) for _ in range(64)]) for i in range(40)]
    same(block_norms.clusters(vectors(spark, rows), k=5).collect(), plain(rows, 5, 3, 64))
    huge = [(i, [(-1) ** i * 1e300] * 64) for i in range(4)]
    got = {x["vec_id"]: x["distance"] for x in block_norms.clusters(vectors(spark, huge), k=1, rounds=0).collect()}
    assert set(got.values()) == {0, block_norms.MOST}


def test_screening(spark):
    """Bounds never exceed distances, ties go to the smaller number, and on clusters few distances are worked out."""
    r = np.random.default_rng(4)
    middles = r.integers(-200, 200, (16, 64))
    x = middles[r.integers(0, 16, 2000)] + r.integers(-15, 16, (2000, 64))
    d = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2)
    assert (block_norms._lower(*block_norms._parts(x), *block_norms._parts(middles)) <= d).all()
    at, best, asked = block_norms.nearest(x, *block_norms._parts(x), middles)
    assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert asked < 1.2 * len(x)
    twice = np.concatenate([middles[3:4], middles])
    assert (block_norms.nearest(middles[3:4], *block_norms._parts(middles[3:4]), twice)[0] == 0).all()
    for scale in (1, 1 << 20, 1 << 40, 1 << 61):  # bounds hold at any size
        a, b = r.integers(-scale, scale + 1, (200, 64)), r.integers(-scale, scale + 1, (8, 64))
        exact = np.array([[float(sum((int(p) - int(q)) ** 2 for p, q in zip(u, w))) for w in b] for u in a])
        assert (block_norms._lower(*block_norms._parts(a), *block_norms._parts(b)) <= exact).all()
