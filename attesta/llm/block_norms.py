"""Centroid clustering with block-norm screening: whole-number k-means whose results don't depend on the order of rows.

Each vector is stored with a compressed form of its segments: their means, and the norms of what the means leave over.
From these and the centroids' own follows a lower bound of each distance, by Cauchy-Schwarz within a segment; exact
distances are worked out only for centroids whose bound doesn't exceed the least exact distance so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from attesta.llm.common import durable, release

#: Components of a segment.
SEGMENT = 8
#: Beyond SAFE a distance may leave 64 bits, and is worked out in whole numbers of any size; components end at LARGEST.
SAFE, LARGEST = 1 << 27, 1 << 62
MOST = (1 << 63) - 1
#: Part of a coordinate that rounding to 32 bits may add to a bound, many times over.
SLACK = 1e-6


def _parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of components: each segment's mean times the root of its length, and the norm of what the mean leaves."""
    n, d = x.shape
    whole = np.zeros((n, -(-d // SEGMENT) * SEGMENT))
    whole[:, :d] = x
    s = whole.reshape(n, -1, SEGMENT)
    mean = s.mean(axis=2)
    rest = np.sqrt(((s - mean[:, :, None]) ** 2).sum(axis=2))
    return (mean * np.sqrt(SEGMENT)).astype("<f4"), rest.astype("<f4")


def _lower(mean: np.ndarray, rest: np.ndarray, means: np.ndarray, rests: np.ndarray) -> np.ndarray:
    """Lower bounds of all squared distances."""
    low = np.zeros((len(mean), len(means)))
    mean, rest, means, rests = (m.astype(np.float64) for m in (mean, rest, means, rests))
    for s in range(mean.shape[1]):
        doubt = SLACK * ((np.abs(mean[:, s]) + rest[:, s])[:, None] + np.abs(means[:, s]) + rests[:, s])
        for a, b in ((mean, means), (rest, rests)):
            low += np.maximum(np.abs(a[:, s, None] - b[:, s]) - doubt, 0) ** 2
    return low


def nearest(x: np.ndarray, mean: np.ndarray, rest: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(centroid, squared distance) of each row, ties to the smaller number; and how many exact distances it took."""
    low = _lower(mean, rest, *_parts(centroids))
    large = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0))) > SAFE
    exact = _whole if large else (lambda a, c: ((a - c) ** 2).sum(axis=1))
    first = low.argmin(axis=1)
    best, at, asked = np.zeros(len(x), dtype=np.int64), first.astype(np.int64), len(x)
    for j in range(len(centroids)):
        own = np.flatnonzero(first == j)
        best[own] = exact(x[own], centroids[j])
    for j in range(len(centroids)):
        rows = np.flatnonzero((low[:, j] <= best) & (first != j))
        d = exact(x[rows], centroids[j])
        asked += rows.size
        better = (d < best[rows]) | (d == best[rows]) & (j < at[rows])
        best[rows[better]], at[rows[better]] = d[better], j
    return at, best, asked


def _whole(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances that may be beyond 64 bits; those end at the largest number of 64."""
    c = [int(v) for v in c]
    return np.array([min(sum((int(v) - w) ** 2 for v, w in zip(row, c)), MOST) for row in a], dtype=np.int64)


def _binary(m: np.ndarray) -> pa.Array:
    """A value of bytes per row."""
    size = m.shape[1] * m.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int64) * size), pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())


def compressed(vectors: DataFrame, dim: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (components as 64-bit whole numbers), mean, rest (see _parts) of vectors with `dim` finite components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(batch.column(1)), dim), False))
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            fine = np.isfinite(v).all(axis=1)  # nulls are no numbers here
            x = np.floor(np.clip(v[fine] * scale, -LARGEST, LARGEST)).astype("<i8")
            ids = batch.column(0).filter(pa.array(fine))
            yield pa.RecordBatch.from_arrays([ids, *map(_binary, (x, *_parts(x)))], names=["vec_id", "v", "mean", "rest"])

    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return read.mapInArrow(run, "vec_id long, v binary, mean binary, rest binary")


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=kind).reshape(batch.num_rows, -1) for c, kind in ((1, "<i8"), (2, "<f4"), (3, "<f4"))]


def _sums(data: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """{cluster: (vectors, sum of each component)}: a row per cluster and task, added up by Spark. Sums are carried as
    halves of 32 bits, as whole ones may leave 64."""
    k, dim = centroids.shape
    names = [f"{half}{i}" for i in range(dim) for half in ("high", "low")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, dim, 2), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                x, mean, rest = _unpacked(batch)
                at = nearest(x, mean, rest, centroids)[0]
                for j in np.unique(at):
                    own = x[at == j]
                    n[j] += len(own)
                    total[j] += np.stack([(own >> 32).sum(axis=0), (own & 0xFFFFFFFF).sum(axis=0)], axis=1)
        used = np.flatnonzero(n)
        flat = total[used].reshape(len(used), -1)
        yield pa.RecordBatch.from_arrays([pa.array(used, type=pa.int32()), pa.array(n[used]), *[pa.array(c) for c in flat.T]], names=["cluster", "n", *names])

    part = data.mapInArrow(run, "cluster int, n long, " + ", ".join(f"{c} long" for c in names))
    found = part.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(19,0)")).alias(c) for c in names])
    return {r["cluster"]: (r["n"], [(int(r[f"high{i}"]) << 32) + int(r[f"low{i}"]) for i in range(dim)]) for r in found.collect()}  # k rows


def clusters(vectors: DataFrame, k: int = 16, rounds: int = 3, *, seed: str = "1", dim: int = 64, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Components count as floor(scale * x). Centroids start as the k vectors with the least sha256 of `seed:vec_id`; each
    round every centroid that has vectors becomes the floor of their mean; after the rounds vectors are assigned again.

    Vectors that are null, of another length than dim, or hold null or non-finite components take no part; those with
    null ids do, but never start a centroid; rows that repeat count each; fewer vectors than k make as many centroids;
    an empty table gives no rows, and so does one without an id. Components end at 2^62, distances and inertias at
    2^63 - 1. Other columns are not read.
    """
    data = durable(compressed(vectors, dim, scale, id_col, vector_col), "vectors")
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = data.where("vec_id is not null").select(key.alias("key"), "v").orderBy("key", F.hex("v")).limit(k).collect()
    added: dict[int, int] = {}
    if start:
        centroids = np.array([np.frombuffer(r["v"], dtype="<i8") for r in start])
        for _ in range(rounds):
            for j, (n, total) in _sums(data, centroids).items():
                centroids[j] = [s // n for s in total]
    else:
        data, centroids = data.limit(0), np.zeros((1, dim), dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, d, _ = nearest(*_unpacked(batch), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, type=pa.int32()), pa.array(d)], names=["vec_id", "cluster", "distance"])

    out = durable(data.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    if start:
        release(data)
        added = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows
    own = F.array(*[F.lit(min(added.get(j, 0), MOST)).cast("long") for j in range(len(centroids))])
    digest = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for c in centroids])
    inertia = F.lit(min(sum(added.values()), MOST)).cast("long")
    return out.select("vec_id", "cluster", "distance", F.get(own, "cluster").alias("cluster_inertia"), inertia.alias("inertia"), F.get(digest, "cluster").alias("centroid_sha256"))
