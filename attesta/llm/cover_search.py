"""Exact top-k inner-product search by dual cover trees.

Queries and data are dealt into blocks of bounded size. For each pair of blocks both sides are indexed in a cover
tree; pairs of nodes are visited best first, and a pair is pruned when its covering radii show that no product in it
can reach the worst k-th score of the queries below its query node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from attesta.llm.common import durable

#: Vectors of a block of data and of queries; points of a leaf; children of a node at most; shrinking of radii.
DATA_BLOCK, QUERY_BLOCK, LEAF, FAN, SHRINK = 16_384, 8_192, 128, 12, 0.7


class CoverTree:
    """Points in an order in which each node is a range lo:hi, with a centre that is one of its points and a radius
    that covers them. Children are a farthest-first net of their parent's points."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.order = points, np.arange(len(points))
        self.lo, self.hi, self.centre, self.radius, self.children = [], [], [], [], []
        if len(points):
            self._build(0, len(points), 0, leaf)
        self.centre, self.radius = np.asarray(self.centre, dtype=np.int64), np.asarray(self.radius)
        self.norm = np.sqrt((points[self.centre] ** 2).sum(axis=1)) if len(points) else np.empty(0)

    def _build(self, lo: int, hi: int, centre: int, leaf: int) -> int:
        """The node over order[lo:hi]; an explicit stack, as depth may grow with the data."""
        todo, root = [(lo, hi, centre, -1)], None
        while todo:
            lo, hi, centre, parent = todo.pop()
            own = self.order[lo:hi]
            x = self.points[own]
            far = np.sqrt(np.maximum(((x - self.points[centre]) ** 2).sum(axis=1), 0))
            radius, me = float(far.max()), len(self.lo)
            self.lo.append(lo)
            self.hi.append(hi)
            self.centre.append(centre)
            self.radius.append(radius)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(me)
            else:
                root = me
            if hi - lo <= leaf or radius == 0:
                continue
            centres, nearest, near = [centre], np.zeros(hi - lo, dtype=np.int64), far
            while len(centres) < FAN and near.max() > SHRINK * radius:
                c = int(own[near.argmax()])
                d = np.sqrt(np.maximum(((x - self.points[c]) ** 2).sum(axis=1), 0))
                closer = d < near
                nearest[closer], near = len(centres), np.minimum(near, d)
                centres.append(c)
            by = np.argsort(nearest, kind="stable")
            self.order[lo:hi] = own[by]
            ends = np.cumsum(np.bincount(nearest, minlength=len(centres)))
            for i, c in enumerate(centres):
                begin = lo + (int(ends[i - 1]) if i else 0)
                if begin < lo + ends[i]:
                    todo.append((begin, lo + int(ends[i]), c, me))
        return root


def search(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int, floor: np.ndarray | None = None):
    """(rows of queries, ids, scores): for each query the k best of data by (score, smaller id), its own id left out.
    floor: scores that a result must reach."""
    if not len(queries) or not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
    qt, dt = CoverTree(queries, 64), CoverTree(data)
    q, qi = queries[qt.order], query_ids[qt.order]
    d, di = data[dt.order], data_ids[dt.order]
    kth = np.full(len(q), -np.inf) if floor is None else floor[qt.order].astype(float)
    best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, dtype=np.int64))] * len(q)
    slack = 1e-6  # radii are rounded; products are whole numbers

    def bounds(a: int, nodes: list[int]) -> np.ndarray:
        c = data[dt.centre[nodes]]
        r, n = dt.radius[nodes], dt.norm[nodes]
        return c @ queries[qt.centre[a]] + qt.radius[a] * n + r * qt.norm[a] + qt.radius[a] * r + slack

    def leaf(a: int, b: int) -> None:
        lo, hi = qt.lo[a], qt.hi[a]
        ids = di[dt.lo[b] : dt.hi[b]]
        scores = q[lo:hi] @ d[dt.lo[b] : dt.hi[b]].T
        good = (scores >= kth[lo:hi, None]) & (ids[None, :] != qi[lo:hi, None])
        for row in np.flatnonzero(good.any(axis=1)):
            at = np.flatnonzero(good[row])
            s, i = np.concatenate((best[lo + row][0], scores[row, at])), np.concatenate((best[lo + row][1], ids[at]))
            top = np.lexsort((i, -s))[:k]
            best[lo + row] = s[top], i[top]
            if top.size == k:
                kth[lo + row] = max(kth[lo + row], s[top[-1]])

    todo = [(0, 0, np.inf)]
    while todo:
        a, b, most = todo.pop()
        if most < kth[qt.lo[a] : qt.hi[a]].min():
            continue
        qs, ds = qt.children[a], dt.children[b]
        if not qs and not ds:
            leaf(a, b)
        elif qs and (not ds or qt.radius[a] >= dt.radius[b]):
            todo += [(c, b, float(bounds(c, [b])[0])) for c in qs]
        else:
            most = bounds(a, ds)
            todo += [(a, ds[i], float(most[i])) for i in np.argsort(most)]
    rows = np.repeat(qt.order, [len(s) for s, _ in best])
    return rows, np.concatenate([i for _, i in best]), np.concatenate([s for s, _ in best])


def _exact(queries: np.ndarray, query_ids: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int):
    """The same for components so large that double precision doesn't hold their products: whole numbers of any size."""
    whole = [[int(x) for x in v] for v in data]
    rows, ids, scores = [], [], []
    for r, v in enumerate(queries):
        v = [int(x) for x in v]
        own = sorted((-sum(a * b for a, b in zip(v, w)), int(i)) for w, i in zip(whole, data_ids) if i != query_ids[r])[:k]
        rows += [r] * len(own)
        ids += [i for _, i in own]
        scores += [min(max(-s, -(1 << 63)), (1 << 63) - 1) for s, _ in own]
    return np.asarray(rows, dtype=np.int64), np.asarray(ids, dtype=np.int64), np.asarray(scores, dtype=np.int64)


def quantise(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v: floor(scale * x) as doubles, little-endian; without null ids, and vectors that are null or hold null
    or non-finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or v is None or None in v:
                    continue
                x = np.floor(np.asarray(v, dtype=np.float64) * scale)
                if np.isfinite(x).all():
                    ids.append(i)
                    out.append(x.astype("<f8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(out, type=pa.binary())], names=["vec_id", "v"])

    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "vec_id long, v binary")


def _matches(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Block against block; vectors of different lengths have no product."""
    out = ([], [], [])
    lv, rv = left["v"].to_pylist(), right["v"].to_pylist()
    li, ri = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
    floors = left["floor"].to_numpy() if "floor" in left.column_names else None
    for size in {len(v) for v in lv}:
        a, b = [i for i, v in enumerate(lv) if len(v) == size], [i for i, v in enumerate(rv) if len(v) == size]
        if not b:
            continue
        q = np.frombuffer(b"".join(lv[i] for i in a), dtype="<f8").reshape(len(a), -1)
        d = np.frombuffer(b"".join(rv[i] for i in b), dtype="<f8").reshape(len(b), -1)
        if q.size and float(np.abs(q).max()) * float(np.abs(d).max()) * q.shape[1] >= 2.0**52:
            rows, ids, scores = _exact(q, li[a], d, ri[b], k)
        else:
            rows, ids, scores = search(q, li[a], d, ri[b], k, None if floors is None else floors[a])
        out[0].append(li[a][rows])
        out[1].append(ids)
        out[2].append(scores.astype(np.int64))
    merged = [np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in out]
    return pa.table([pa.array(x, type=pa.int64()) for x in merged], names=["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, *, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors with the highest inner products with each query, ties to
    the smaller id; a query's own id is no candidate. Components count as floor(scale * x).

    Vectors that are null or hold null or non-finite components, and null ids, take no part; vectors of another length
    than the query's are no candidates; rows that repeat id and vector count once; fewer candidates than k are all
    returned; empty tables give no rows; other columns are not read.
    """
    data = durable(quantise(vectors, scale, id_col, vector_col).dropDuplicates(["vec_id", "v"]), "vectors")
    asked = durable(quantise(queries, scale, id_col, vector_col).dropDuplicates(["vec_id", "v"]), "queries")
    n_data, n_asked = max(1, -(-data.count() // DATA_BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    block = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    data, asked = data.withColumn("d", block(n_data)), asked.withColumn("q", block(n_asked))
    schema = "query_id long, vec_id long, score long"

    def against(left: DataFrame, right: DataFrame, n: int) -> DataFrame:
        # each block of queries meets each block of data in a task of its own
        left = left.withColumn("d", F.explode(F.array(*[F.lit(i) for i in range(n)]) if n < 64 else F.sequence(F.lit(0), F.lit(n - 1))))
        right = right.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
        return left.groupBy("q", "d").cogroup(right.groupBy("q", "d")).applyInArrow(lambda a, b: _matches(a, b, k), schema)

    if n_data > 1:
        # the first block gives each query a score that its k-th best reaches at least
        first = against(asked, data.where("d = 0"), 1)
        low = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).where(F.col("n") >= k)
        low = low.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
        asked = asked.join(low, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    found = against(asked, data, n_data)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.dropDuplicates().withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
