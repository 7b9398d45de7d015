"""The best rows of each query, kept in tasks: BM25 without a row per item and unit, inner products by blocks."""

import math
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from attesta.operators import retrieval as R
from attesta.operators.best import Best, rounded


def test_rounded_as_spark(spark):
    own = [0.0, -0.0, 1e-7, -1e-7, 0.1234565, 1.0000005, -2.5000015, 123456789.1234565, 3e15, 1e300, 2.0**52 + 0.5, math.inf, -math.inf]
    own += [random.Random(1).randrange(10**9) / 1e6 + 5e-7 for _ in range(200)]
    want = spark.sql("select inline(array(" + ",".join(f"struct({i} as i, round(double('{x!r}'), 6) as x)" for i, x in enumerate(own)) + "))").orderBy("i").collect()
    assert rounded(np.array(own)).tolist() == [r["x"] for r in want]


def test_best_over_blocks():
    rng = random.Random(2)
    scores = np.array([[rng.choice([0.5, 0.5000001, 1.0, 2.0, math.nan, -math.inf]) for _ in range(60)] for _ in range(4)])
    best = Best(4, 7)
    for begin in range(0, 60, 9):
        q, x = best.may_enter(scores[:, begin : begin + 9])
        best.add(q, x + begin, scores[q, x + begin])
    for q in range(4):
        key = lambda i: (not math.isnan(scores[q, i]), -rounded(scores[q])[i] if not math.isnan(scores[q, i]) else 0, i)  # noqa: E731, B023
        assert best.place[best.query == q].tolist() == sorted(range(60), key=key)[:7]


@pytest.mark.parametrize("size,block,padded", [(7, 3, False), (500, 2, True), (1, 100, False)])
def test_bm25_in_blocks(spark, size, block, padded):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(12)}" for _ in range(rng.randrange(0, 9))) or None for _ in range(40)]
    texts[20:26] = [texts[0]] * 6
    units = spark.createDataFrame([(str(i), i, t) for i, t in enumerate(texts)], "id string, ord long, text string")
    asked = {i: " ".join(f"w{rng.randrange(14)}" for _ in range(3)) for i in range(8)} | {8: "none", 9: None}
    items = spark.createDataFrame(list(asked.items()), "item_id long, text string")
    own = R.bm25(units, items, 5, padded=padded, size=size, block=block)
    got = {(r["item_id"], r["rank"]): (r["ord"], r["score"]) for r in own.collect()}
    toks = [(t or "").split() for t in texts]
    avg = sum(map(len, toks)) / len(toks)
    want = {}
    for item, text in asked.items():
        rows = []
        for i, t in enumerate(toks):
            hits = [(w, t.count(w), sum(w in x for x in toks)) for w in (text or "").split() if w in t]
            s = sum(math.log(1 + (40 - df + 0.5) / (df + 0.5)) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * len(t) / avg)) for _, f, df in hits)
            rows += [(i, round(s, 6))] if hits or padded else []
        want |= {(item, n + 1): x for n, x in enumerate(sorted(rows, key=lambda x: (-x[1], x[0]))[:5])}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(v[1] == pytest.approx(want[k][1], abs=2e-6) for k, v in got.items())


def test_bm25_passes_on_k_units_of_an_item(spark):
    """Every unit holds every item's word: the last shuffle takes k rows of an item and block, not all pairs."""
    units = spark.range(400).selectExpr("cast(id as string) as id", "id as ord", "concat('w x', id) as text")
    items = spark.range(20).selectExpr("id as item_id", "'w' as text")
    own = R.bm25(units, items, 2, size=200)
    assert own.count() == 40
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[item_id#\w+, id#", plan)


@pytest.mark.parametrize("size,block", [(3, 2), (1000, 1000)])
def test_dense_as_the_plain_product(spark, size, block):
    """Nulls, holes, other lengths, values beyond numbers, ties within the sixth digit: as the expression over all pairs."""
    rng = random.Random(4)
    rows = [(i, [rng.choice([0.1, -0.7, 1e-4, 3.0]) for _ in range(5)]) for i in range(30)]
    rows += [(i, rows[3][1]) for i in range(30, 40)] + [(40, None), (41, [1.0, None, 0.0, 0.0, 2.0]), (42, [1.0]), (43, []), (44, [math.nan, 0, 0, 0, 0.0]), (45, [math.inf, 0, 0, 0, 1.0]), (46, [1e160] * 5)]
    rows = [(i, v if v is None else [x if x is None else float(x) for x in v]) for i, v in rows]
    vectors = spark.createDataFrame(rows, "id long, embedding array<double>")
    queries = vectors.where("id % 4 = 0 or id > 38").selectExpr("id as item_id", "embedding")
    got = R.dense(vectors, queries, 6, block, size)
    pairs = vectors.crossJoin(queries.withColumnRenamed("embedding", "q")).select("item_id", "id", F.round(R.dot(F.col("embedding"), F.col("q")), 6).alias("score"))
    want = R.top(pairs, 6, [F.desc("score"), "id"]).select("item_id", "id", "score", "rank")
    rows_of = lambda d: sorted(str(tuple(r)) for r in d.collect())
    assert rows_of(got) == rows_of(want)
    assert "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_located_spans_are_made_once(spark):
    from attesta.operators import spans

    rows = [(1, "c", "1", "3"), (1, "c", "5", None), (2, "c", "9", "2")]
    lines = spark.createDataFrame(rows, "item_id long, corpus string, id_start string, id_end string")
    units = spark.range(12).selectExpr("'c' as corpus", "cast(id as string) as id", "id as ord")
    own = spans.score(lines, lines, units)
    assert {r["item_id"]: (r["n_cited"], r["n_invalid"], r["f1"], r["unit_p"]) for r in own.collect()} == {1: (2, 0, 1.0, 1.0), 2: (1, 2, 0.0, None)}
    assert "InMemoryRelation" in own._jdf.queryExecution().executedPlan().toString()
