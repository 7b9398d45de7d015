"""Ranked retrieval: postings, BM25, exact dense search, rank fusion, rerank, recall."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from attesta.functions.text import tokens
from attesta.operators.best import Best

K1, B, RRF = 1.5, 0.75, 60
#: Queries that one group holds: some 32 MB of vectors at 1,024 dimensions.
BLOCK = 4096
#: Scores that a task holds at once, of 8 bytes each.
CELLS = 1 << 21


def analysed(units: DataFrame) -> DataFrame:
    """id, ord, tokens, dl of units (id, ord, text)."""
    own = units.select("id", "ord", tokens(F.col("text")).alias("tokens"))
    return own.withColumn("dl", F.size("tokens").cast("long"))


def query_terms(items: DataFrame) -> DataFrame:
    """item_id, token, m: repeated query tokens count as often as they come."""
    own = items.select("item_id", F.explode(tokens(F.col("text"))).alias("token"))
    return own.groupBy("item_id", "token").agg(F.count(F.lit(1)).alias("m"))


def postings(units: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """id, ord, dl, token, tf; only of the given terms, if any, which are joined before anything is counted."""
    own = analysed(units).select("id", "ord", "dl", F.explode("tokens").alias("token"))
    if terms is not None:
        own = own.join(terms.select("token").distinct(), "token", "left_semi")
    return own.groupBy("id", "ord", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def collection(units: DataFrame) -> DataFrame:
    """One row: n (empty documents included), avgdl (1 where it would be 0)."""
    own = analysed(units).agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    return own.select("n", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0).alias("avgdl"))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def top(scored: DataFrame, k: int, order: list, by: str = "item_id") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def _dealt(n: int, size: int) -> int:
    """How many blocks of about `size` hold n rows."""
    return max(1, -(-n // size))


def _block(key: str, blocks: int):
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _to_all(d: DataFrame, name: str, blocks: int) -> DataFrame:
    """Each row once for every block."""
    return d.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def _posted_once(units: DataFrame, terms: DataFrame, blocks: int) -> DataFrame:
    """Postings of the terms by block of units, and of each unit one more with an empty token, which tells how many units
    there are and how long they are: every text is cut once, and what is counted lies where its block is scored."""
    own = analysed(units).select(_block("id", blocks).alias("block"), "id", "ord", "dl", F.explode(F.array_append("tokens", F.lit(""))).alias("token"))
    asked = terms.select("token").union(terms.sparkSession.sql("select '' as token")).distinct()
    own = own.join(asked, "token", "left_semi").where("token is not null").select("block", "id", "ord", "dl", "token")
    return own.repartition("block").groupBy("block", "id", "ord", "dl", "token").agg(F.count(F.lit(1)).alias("tf"))


def _starts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Where runs of equal pairs begin, and the end."""
    return np.concatenate(([0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [a.size]))


def _lexical(schema: pa.Schema, k: int):
    """Units of a block (id, ord, dl, token, tf) against terms of a block of items (item_id, token, m, idf, avgdl)."""

    def run(posted: pa.Table, terms: pa.Table) -> pa.Table:
        if not posted.num_rows or not terms.num_rows:
            return schema.empty_table()
        names, asked = (pc.dictionary_encode(terms.column(c).combine_chunks(), null_encoding="encode") for c in ("item_id", "token"))
        term = asked.indices.to_numpy()
        by_term = np.argsort(term, kind="stable")
        item = names.indices.to_numpy()[by_term]
        weight = (terms.column("idf").to_numpy() * terms.column("m").to_numpy())[by_term]
        begin = np.searchsorted(term[by_term], np.arange(len(asked.dictionary) + 1))
        avgdl = terms.column("avgdl")[0].as_py()

        found = pc.index_in(posted.column("token").combine_chunks(), value_set=asked.dictionary)
        posted = posted.append_column("term", found).filter(pc.is_valid(found)).sort_by([("ord", "ascending"), ("id", "ascending")])
        if not posted.num_rows:
            return schema.empty_table()
        row_of = _starts(*(pc.dictionary_encode(posted.column(c).combine_chunks(), null_encoding="encode").indices.to_numpy() for c in ("ord", "id")))
        unit = np.repeat(np.arange(row_of.size - 1), np.diff(row_of))
        tf, dl = (posted.column(c).to_numpy().astype(np.float64) for c in ("tf", "dl"))
        share = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
        at = posted.column("term").to_numpy()
        uses = np.diff(begin)[at]
        best, n_items = Best(len(names.dictionary), k), len(names.dictionary)
        ends = uses.cumsum()
        start, step = 0, max(1, CELLS // n_items)
        while start < row_of.size - 1:
            first = row_of[start]
            # units whose scores, and the products behind them, fit the room
            stop = min(start + step, int(np.searchsorted(ends[row_of[1:] - 1], (ends[first - 1] if first else 0) + CELLS, side="right")))
            stop = max(stop, start + 1)
            last = row_of[stop]
            n = uses[first:last]
            of = np.repeat(np.arange(first, last), n)
            entry = np.arange(of.size) - np.repeat(n.cumsum() - n, n) + begin[at[of]]
            cell = item[entry].astype(np.int64) * (stop - start) + unit[of] - start
            scores = np.bincount(cell, weights=weight[entry] * share[of], minlength=n_items * (stop - start)).reshape(n_items, -1)
            scores = np.where(scores > 0, scores, -np.inf)  # every part is above 0
            q, x = best.may_enter(scores)
            hit = scores[q, x] > 0
            best.add(q[hit], x[hit] + start, scores[q[hit], x[hit]])
            start = stop
        own = posted.select(["id", "ord"]).take(row_of[best.place])
        return pa.Table.from_arrays([names.dictionary.take(best.query), own.column("id"), own.column("ord"), pa.array(best.score)], schema=schema)

    return run


def bm25(units: DataFrame, items: DataFrame, k: int = 5, *, padded: bool = False, size: int = 4096, block: int = BLOCK) -> DataFrame:
    """item_id, id, ord, score, rank: score descending, then corpus order. padded: items with fewer than k hits get
    the first units without a hit, with score 0. Units are dealt into blocks of about `size`, items into blocks of about
    `block`; each block of units is scored against each of items and passes on k units of an item."""
    many, few = _dealt(units.count(), size), _dealt(items.count(), block)
    terms = query_terms(items)
    posted = _posted_once(units, terms, many)
    # written so that all uses of the postings read one shuffle, and those of df one count: no filter or column is pushed
    # into one of them
    df = posted.groupBy("token").agg(F.sum(F.when(F.col("tf") > 0, 1)).alias("df"), F.sum("dl").alias("dls"))
    whole = lambda c: F.max(F.when(F.col("token") == "", F.col(c)))
    stats = df.agg(whole("df").alias("n"), (whole("dls") / whole("df")).alias("avgdl"))
    stats = F.broadcast(stats.select("n", F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0).alias("avgdl")))  # one row
    asked = terms.join(df.where("dls >= 0"), "token").join(stats).select("item_id", "token", "m", idf(F.col("n"), F.col("df")).alias("idf"), "avgdl")
    schema = items.select("item_id").schema.add("id", units.schema["id"].dataType).add("ord", units.schema["ord"].dataType).add("score", "double")
    run = _lexical(to_arrow_schema(schema), k)
    if few > 1:
        posted, asked, key = _to_all(posted, "of", few), asked.withColumn("of", _block("item_id", few)), ["block", "of"]
    else:
        key = ["block"]
    scored = posted.groupBy(*key).cogroup(_to_all(asked, "block", many).groupBy(*key)).applyInArrow(run, schema)
    scored = scored.withColumn("score", F.round("score", 6))
    if padded:
        # k units without a hit are among the first k plus as many as there are hits; one that is a hit keeps its score
        first = units.select("id", "ord").orderBy("ord").limit(2 * k)
        fill = items.select("item_id").join(F.broadcast(first)).withColumn("score", F.lit(0.0))
        scored = top(scored, k, [F.desc("score"), "ord"]).drop("rank").unionByName(fill)
        scored = scored.groupBy("item_id", "id", "ord").agg(F.max("score").alias("score"))
    best = top(scored, k, [F.desc("score"), "ord"])
    return best.select("item_id", "id", "ord", "score", F.col("rank").cast("int").alias("rank"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _in_order(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products along the last axis, added up from the first component to the last."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        out = out + a[..., i] * b[..., i]
    return out


def _matrices(vectors: pa.ChunkedArray):
    """(places, matrix of doubles) of the vectors of each length without null components; other places are in none."""
    own = pa.concat_arrays([c.cast(pa.large_list(pa.float64())) for c in vectors.chunks]) if vectors.num_chunks else pa.array([], pa.large_list(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(own), -1).to_numpy(zero_copy_only=False)
    holed = np.zeros(len(own), dtype=bool)
    if own.flatten().null_count:
        holed[pc.list_parent_indices(own).filter(pc.is_null(own.flatten())).to_numpy()] = True
    for size in np.unique(sizes[(sizes >= 0) & ~holed]):
        at = np.flatnonzero((sizes == size) & ~holed)
        yield int(size), at, own.take(pa.array(at)).flatten().to_numpy().reshape(at.size, int(size))


def _inner(schema: pa.Schema, k: int):
    """Vectors of a block (id, embedding) against a block of queries (item_id, q)."""

    def run(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        vectors = vectors.sort_by("id")
        n = asked.num_rows
        found, told = [], np.zeros(n, dtype=np.int64)
        rows = {size: (at, m) for size, at, m in _matrices(vectors.column("embedding"))}
        for size, places, queries in _matrices(asked.column("q")):
            if size not in rows:
                continue
            at, m = rows[size]
            with np.errstate(all="ignore"):
                long = np.sqrt((m * m).sum(axis=1))
                odd = np.flatnonzero(~(long < 1e100))
                longest = long[long < 1e100].max(initial=0.0)
            step = max(1, CELLS // at.size)
            for begin in range(0, places.size, step):
                q = queries[begin : begin + step]
                with np.errstate(all="ignore"):
                    scores = q @ m.T
                    own = np.sqrt((q * q).sum(axis=1))
                    strange = np.flatnonzero(~(own < 1e100))
                    scores[:, odd] = _in_order(q[:, None, :], m[None, odd, :])
                    scores[strange] = _in_order(q[strange, None, :], m[None, :, :])
                    slack = np.where(own < 1e100, 2.0**-50 * (size + 1) * own * longest, 0.0)
                    best = Best(q.shape[0], k)
                    a, b = best.may_enter(scores, slack)
                    best.add(a, b, _in_order(q[a], m[b]))
                found.append((places[begin + best.query], at[best.place], best.score, np.ones(best.query.size, dtype=bool)))
                told[places[begin : begin + q.shape[0]]] = np.bincount(best.query, minlength=q.shape[0])
        # vectors that a query can't be compared with have no score, and come after those that have one
        for i in np.flatnonzero(told < min(k, vectors.num_rows)):
            known = np.concatenate([y[x == i] for x, y, _, _ in found] or [np.empty(0, dtype=np.int64)])
            rest = np.setdiff1d(np.arange(min(vectors.num_rows, 2 * k)), known)[: k - told[i]]
            found.append((np.full(rest.size, i), rest, np.zeros(rest.size), np.zeros(rest.size, dtype=bool)))
        if not found:
            return schema.empty_table()
        query, place, score, scored = (np.concatenate(x) for x in zip(*found))
        return pa.Table.from_arrays([asked.column("item_id").take(query), vectors.column("id").take(place), pa.array(score, mask=~scored)], schema=schema)

    return run


def dense(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, size: int = 8192) -> DataFrame:
    """item_id, id, score, rank over vectors (id, embedding) for queries (item_id, embedding): exact inner products of
    a stated query set against all rows. Vectors are dealt into blocks of about `size`, queries into blocks of about
    `block`; each block of vectors meets each of queries and passes on k vectors of a query. What matrix products
    leave as candidates is added up in order, as one would by hand."""
    asked = queries.where(F.col("item_id").isNotNull()).select("item_id", F.col("embedding").alias("q"))
    many, few = _dealt(vectors.count(), size), _dealt(asked.count(), block)
    schema = asked.select("item_id").schema.add("id", vectors.schema["id"].dataType).add("score", "double")
    left = _to_all(vectors.select("id", "embedding", _block("id", many).alias("block")), "of", few)
    right = _to_all(asked.withColumn("of", _block("item_id", few)), "block", many)
    best = left.groupBy("block", "of").cogroup(right.groupBy("block", "of")).applyInArrow(_inner(to_arrow_schema(schema), k), schema)
    best = top(best.withColumn("score", F.round("score", 6)), k, [F.desc("score"), "id"])
    return best.select("item_id", "id", "score", F.col("rank").cast("int").alias("rank"))


def fuse(first: DataFrame, second: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two lists (item_id, id, rank): ties go to the first list, then by its rank, then the
    second's."""
    own = first.select("item_id", "id", F.col("rank").alias("a"), F.lit(None).cast("int").alias("b"))
    own = own.unionByName(second.select("item_id", "id", F.lit(None).cast("int").alias("a"), F.col("rank").alias("b")))
    own = own.groupBy("item_id", "id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    score = F.coalesce(1.0 / (RRF + F.col("a")), F.lit(0.0)) + F.coalesce(1.0 / (RRF + F.col("b")), F.lit(0.0))
    own = own.withColumn("score", F.round(score, 9))
    return top(own, k, [F.desc("score"), F.asc_nulls_last("a"), F.asc_nulls_last("b")]).select("item_id", "id", "score", F.col("rank").cast("int").alias("rank"))


def rerank(candidates: DataFrame, items: DataFrame, units: DataFrame, score, k: int, limit: int | None = None) -> DataFrame:
    """score(query text, unit text) as a Column, over candidates (item_id, id, rank) only; ties keep their order. limit:
    characters of a text that the scorer reads, 4,000 for the usual models. Candidates without a text count as empty."""
    cut = lambda c: F.substring(c, 1, limit) if limit else F.col(c)
    own = candidates.join(items.select("item_id", cut("text").alias("query")), "item_id").join(units.select("id", cut("text").alias("passage")), "id", "left")
    own = own.select("item_id", "id", F.col("rank").alias("before"), F.round(score(F.col("query"), F.coalesce("passage", F.lit(""))), 6).alias("score"))
    return top(own, k, [F.desc("score"), "before"]).select("item_id", "id", "score", F.col("rank").cast("int").alias("rank"))


def overlap_score(query: Column, passage: Column) -> Column:
    """Share of a query's distinct tokens that the passage has: an offline stand-in for a cross-encoder."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(passage))) / F.size(q)).otherwise(0.0)


def first_hit(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """item_id, hit_rank: of items with gold (item_id, id); null without a hit."""
    hits = ranked.join(gold, ["item_id", "id"], "left_semi").groupBy("item_id").agg(F.min("rank").alias("hit_rank"))
    return gold.select("item_id").distinct().join(hits, "item_id", "left")


def recall_at(hits: DataFrame, ks=(5, 10, 20, 50)) -> DataFrame:
    cols = [F.round(F.avg(F.coalesce((F.col("hit_rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"recall_{k}") for k in ks]
    return hits.agg(F.count(F.lit(1)).alias("n"), *cols)


def upper_median(hits: DataFrame) -> DataFrame:
    """The middle rank found, the upper of two; counts of ranks are merged, never a list of all."""
    middle = F.expr("percentile_disc(0.5) within group (order by hit_rank desc)")
    return hits.agg(F.count("hit_rank").alias("n_found"), middle.cast("int").alias("median_rank"))


def ndcg_at(ranked: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """item_id, ndcg (an extension): gains of 1 for gold, of items with gold."""
    gain = ranked.where(F.col("rank") <= k).join(gold, ["item_id", "id"], "left_semi").groupBy("item_id").agg(F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    n = gold.groupBy("item_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return n.join(gain, "item_id", "left").select("item_id", F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg"))
