"""Ranked lexical search with block-max pruning over a forward index.

Documents are kept in blocks, as they come: for each document its length and the counts of the terms that are asked
for, for each block the largest contribution of each term to a document. What a block's maxima promise a query bounds
all of its documents' scores. The most promising blocks give each query a threshold; then every task sorts its blocks by
their bounds and scores them until they fall below it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from attesta.llm.common import arrow_rows, durable, release

#: Documents of a block, and blocks of a query that give it its first threshold.
BLOCK, FIRST = 128, 4
#: Queries times terms that are searched at once; more are searched in several passes, a query with more by itself.
ROOM = 1 << 24
#: ASCII letters and digits and all of what isn't ASCII make terms, A-Z lowered; the rest is space between them.
TERMS = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: k1 and b of the ranking, as whole numbers: m = 100 - B + B * length / mean length; contributions are in UNIT / 1000.
UNIT, K12, B = 1_000_000_000, 12, 25
LAST = (1 << 63) - 1
FORWARD = "doc_id array<long>, nameless array<boolean>, length array<long>, starts array<int>, term array<int>, tf array<int>"


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TERMS).split()


def forward(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """Blocks of documents with terms: doc_id, nameless (the id is null), length, starts, term, tf: document i's terms
    that the vocabulary has are those from starts[i] to starts[i + 1], ascending."""
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
    names = ["doc_id", "nameless", "length", "starts", "term", "tf"]

    def block(rows: list) -> pa.RecordBatch:
        starts, term, tf = [0], [], []
        for _, _, counts in rows:
            for t, n in sorted(counts.items()):
                term.append(t)
                tf.append(n)
            starts.append(len(term))
        own = ([LAST if i is None else i for i, _, _ in rows], [i is None for i, _, _ in rows], [n for _, n, _ in rows], starts, term, tf)
        return pa.RecordBatch.from_arrays([pa.array([v], type=pa.list_(t)) for v, t in zip(own, kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = terms(text.as_py())
                if words:
                    counts = Counter(map(vocabulary.get, words))
                    counts.pop(None, None)
                    held.append((i, len(words), counts))
                if len(held) == BLOCK:
                    yield block(held)
                    held = []
        if held:
            yield block(held)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, FORWARD)


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, where each row's begin)."""
    c = batch.column(batch.schema.get_field_index(name))
    offsets = c.offsets.to_numpy()
    return c.values.to_numpy(zero_copy_only=False), offsets


def _shares(length: np.ndarray, starts: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each count of a block contributes for a term of weight 1."""
    m = 100 - B + (B * length * n_docs) // n_terms
    return (UNIT * tf.astype(np.int64)) // (1000 * tf.astype(np.int64) + K12 * np.repeat(m, np.diff(starts)))


def with_maxima(blocks: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """blocks with `block`, `terms` (those that it holds, ascending), `holders` (how many of its documents hold them) and
    `maxima` (their largest contributions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, starts, term, tf = (_lists(batch, c) for c in ("length", "starts", "term", "tf"))
            own, holders, most = [], [], []
            for r in range(batch.num_rows):
                part = [v[o[r] : o[r + 1]] for v, o in (length, starts, term, tf)]
                shares = _shares(part[0], part[1], part[3], n_docs, n_terms)
                order = np.argsort(part[2], kind="stable")
                found, at, n = np.unique(part[2][order], return_index=True, return_counts=True)
                own.append(found)
                holders.append(n)
                most.append(np.maximum.reduceat(shares[order], at) if len(at) else shares)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, type=pa.list_(pa.int32())), *[pa.array(v, type=pa.list_(pa.int64())) for v in (holders, most)]], names=[*batch.schema.names, "terms", "holders", "maxima"])

    named = blocks.withColumn("block", F.monotonically_increasing_id())  # kept with the table, so that it stays as it is
    return named.mapInArrow(run, f"{FORWARD}, block long, terms array<int>, holders array<long>, maxima array<long>")


class _Queries:
    """Queries as lists of term ids with weights, repeats summed."""

    def __init__(self, queries: list[dict[int, int]]):
        self.terms = [np.array(sorted(q), dtype=np.int64) for q in queries]
        self.weights = [np.array([q[t] for t in sorted(q)], dtype=np.int64) for q in queries]
        self.n_terms = max((int(t[-1]) + 1 for t in self.terms if len(t)), default=0)

    def bounds(self, own: np.ndarray, most: np.ndarray) -> np.ndarray:
        """What each query can reach with a block's maxima."""
        dense = np.zeros(self.n_terms, dtype=np.int64)
        dense[own] = most
        return np.array([int(dense[t] @ w) for t, w in zip(self.terms, self.weights)], dtype=np.int64)

    def scores(self, q: int, term_order: np.ndarray, sorted_terms: np.ndarray, rows: np.ndarray, shares: np.ndarray, n: int) -> np.ndarray:
        """Scores of a block's n documents, whose counts are sorted by term."""
        out = np.zeros(n, dtype=np.int64)
        lo, hi = np.searchsorted(sorted_terms, self.terms[q]), np.searchsorted(sorted_terms, self.terms[q], side="right")
        for a, b, w in zip(lo, hi, self.weights[q]):
            if a < b:
                at = term_order[a:b]
                out[rows[at]] += w * shares[at]  # a term stands once in a document
        return out


class _Best:
    """The k best documents of each query so far, and the score that more must reach."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floor, self.held = k, floors.copy(), [np.empty((0, 3), dtype=np.int64) for _ in floors]

    def add(self, q: int, ids: np.ndarray, nameless: np.ndarray, scores: np.ndarray) -> None:
        at = np.flatnonzero(scores >= max(1, self.floor[q]))
        if not at.size:
            return
        own = np.concatenate([self.held[q], np.stack([scores[at], nameless[at], ids[at]], axis=1)])
        own = own[np.lexsort((own[:, 2], own[:, 1], -own[:, 0]))[: self.k]]
        self.held[q] = own
        if len(own) == self.k:
            self.floor[q] = max(self.floor[q], own[-1, 0])


def _score(index: DataFrame, queries: _Queries, k: int, n_docs: int, n_terms: int, floors: np.ndarray, only: dict[int, list[int]] | None = None) -> DataFrame:
    """query, doc_id, score: each task's best. only: queries of blocks; other blocks and queries are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(floors, k)
        scored = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            number = batch.column(batch.schema.get_field_index("block")).to_numpy()
            columns = {c: _lists(batch, c) for c in ("doc_id", "nameless", "length", "starts", "term", "tf", "terms", "maxima")}

            def part(r: int, name: str) -> np.ndarray:
                v, o = columns[name]
                return v[o[r] : o[r + 1]]

            bounds = np.stack([queries.bounds(part(r, "terms"), part(r, "maxima")) for r in range(batch.num_rows)])
            opened: dict[int, tuple] = {}
            for q in range(len(queries.terms)):
                for r in np.argsort(-bounds[:, q], kind="stable"):
                    if bounds[r, q] < max(1, best.floor[q]):
                        break
                    if only is not None and q not in only.get(int(number[r]), ()):
                        continue
                    if r not in opened:
                        starts, term = part(r, "starts"), part(r, "term")
                        order = np.argsort(term, kind="stable")
                        opened[r] = (order, term[order], np.repeat(np.arange(len(starts) - 1), np.diff(starts)), _shares(part(r, "length"), starts, part(r, "tf"), n_docs, n_terms))
                    scored += 1
                    best.add(q, part(r, "doc_id"), part(r, "nameless"), queries.scores(q, *opened[r], len(part(r, "doc_id"))))
        rows = np.repeat(np.arange(len(best.held)), [len(h) for h in best.held])
        own = np.concatenate(best.held) if best.held else np.empty((0, 3), dtype=np.int64)
        ids = pa.array(own[:, 2], mask=own[:, 1] == 1)
        yield pa.RecordBatch.from_arrays([pa.array(rows, type=pa.int32()), ids, pa.array(own[:, 0]), pa.array(np.full(len(rows), scored), type=pa.int64())], names=["query", "doc_id", "score", "scored"])

    return index.mapInArrow(run, "query int, doc_id long, score long, scored long")


def _promising(index: DataFrame, queries: _Queries, first: int) -> dict[int, list[int]]:
    """{block: queries} of the `first` blocks with the highest bounds for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, most = np.zeros((len(queries.terms), 0), dtype=np.int64), np.zeros((len(queries.terms), 0), dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                number, (own, o), (top, _) = batch.column(0).to_numpy(), _lists(batch, "terms"), _lists(batch, "maxima")
                bounds = np.stack([queries.bounds(own[o[r] : o[r + 1]], top[o[r] : o[r + 1]]) for r in range(batch.num_rows)], axis=1)
                most, at = np.concatenate([most, bounds], axis=1), np.concatenate([at, np.broadcast_to(number, bounds.shape)], axis=1)
                keep = np.argsort(-most, axis=1, kind="stable")[:, :first]
                most, at = np.take_along_axis(most, keep, axis=1), np.take_along_axis(at, keep, axis=1)
        q, c = np.nonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(q, type=pa.int32()), pa.array(at[q, c]), pa.array(most[q, c])], names=["query", "block", "bound"])

    found = index.select("block", "terms", "maxima").mapInArrow(run, "query int, block long, bound long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bound"), "block"))
    out: dict[int, list[int]] = {}
    for r in found.withColumn("rank", rank).where(F.col("rank") <= first).collect():  # `first` rows a query
        out.setdefault(r["block"], []).append(r["query"])
    return out


def _passes(items: DataFrame) -> Iterator[list[tuple]]:
    """(item_id, terms) of as many queries as are searched at once."""
    held, known = [], set()
    for r in items.toLocalIterator():
        words = terms(r["text"])
        if words:
            if held and (len(held) + 1) * len(known | set(words)) > ROOM:
                yield held
                held, known = [], set()
            held.append((r["item_id"], words))
            known |= set(words)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = 20, *, first: int = FIRST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 of each item, equal scores by
    ascending id. Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lowered. N counts documents
    with terms, L their terms, n one document's, df those with a term, tf its occurrences there. A term weighs
    floor(1000 ln((2N + 2) / (2df + 1))) and adds weight * (10^9 tf div (1000 tf + 12 m)), m = 75 + 25 n N div L, once
    for each time that the item says it.

    docs: doc_id, text; items: item_id, text. Null and blank texts are no documents and find nothing; a null doc_id
    comes last among equal scores; rows of docs that repeat are documents each; rows of items that repeat count once,
    other texts under one item_id are ranked each for itself; empty tables give no rows; other columns are not read.
    """
    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    out = None
    for queries in _passes(asked.orderBy("item_id", "text")):
        found = _search(docs, queries, k, first, id_col, text_col)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")


def _search(docs: DataFrame, queries: list[tuple], k: int, first: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in queries for w in words))}
    with arrow_rows(spark, 256):
        raw = durable(forward(docs, vocabulary, id_col, text_col), "forward")
    n_docs, n_terms = (int(x or 0) for x in raw.select(F.sum(F.size("length")), F.sum(F.aggregate("length", F.lit(0).cast("long"), lambda a, x: a + x))).first())
    with arrow_rows(spark, 64):
        index = durable(with_maxima(raw, n_docs, max(1, n_terms)), "index")
        release(raw)
        df = index.select(F.inline(F.arrays_zip("terms", "holders"))).groupBy("terms").agg(F.sum("holders"))
        held = {r[0]: r[1] for r in df.collect()}  # a row per asked term
        weight = {i: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1))) for i in vocabulary.values()}
        own = _Queries([{t: n * weight[t] for t, n in Counter(vocabulary[w] for w in words).items()} for _, words in queries])
        floors = np.zeros(len(queries), dtype=np.int64)
        blocks = _promising(index, own, first)
        if blocks:
            chosen = index.where(F.col("block").isin(*blocks)) if len(blocks) <= 1000 else index.join(F.broadcast(spark.createDataFrame([(b,) for b in blocks], "block long")), "block", "left_semi")
            some = _score(chosen, own, k, n_docs, n_terms, floors, blocks)
            rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
            for q, score in some.withColumn("rank", rank).where(F.col("rank") == k).select("query", "score").collect():  # a row per query
                floors[q] = score
        found = durable(_score(index, own, k, n_docs, n_terms, floors), "found")
    release(index)
    names = spark.createDataFrame([(q, i) for q, (i, _) in enumerate(queries)], "query int, item_id long")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.join(names, "query").select("item_id", "rank", "doc_id", "score")
