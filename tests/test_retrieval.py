import math

import pytest

from attesta.operators import readers, retrieval as R

DOCS = [("a", 0, "red fox jumps"), ("b", 1, "red red dog"), ("c", 2, ""), ("d", 3, None), ("e", 4, "cat")]


def units(spark, rows=DOCS):
    return spark.createDataFrame(rows, "id string, ord long, text string")


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(query, docs, k1=1.5, b=0.75):
    toks = [(i, (t or "").lower().split()) for i, _, t in docs]
    n, avg = len(toks), sum(len(t) for _, t in toks) / len(toks)
    out = []
    for i, t in toks:
        s = 0.0
        for w in query.split():
            f, df = t.count(w), sum(w in x for _, x in toks)
            if f:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(t) / avg))
        out.append((i, round(s, 6)))
    return sorted(out, key=lambda x: -x[1])


@pytest.mark.parametrize("query", ["red", "red red dog", "fox unknown"])
def test_bm25(spark, query):
    got = [(r["id"], r["score"]) for r in R.bm25(units(spark), items(spark, [(1, query)]), 5).orderBy("rank").collect()]
    assert got == [x for x in brute(query, DOCS) if x[1] > 0]


def test_padding(spark):
    got = {}
    for r in R.bm25(units(spark), items(spark, [(1, "unknown"), (2, "cat")]), 3, padded=True).orderBy("item_id", "rank").collect():
        got.setdefault(r["item_id"], []).append(r["id"])
    assert got == {1: ["a", "b", "c"], 2: ["e", "a", "b"]}


def test_fusion_and_ties(spark):
    ranked = lambda ids: spark.createDataFrame([(1, x, i + 1) for i, x in enumerate(ids)], "item_id long, id string, rank int")
    got = [(r["id"], r["score"]) for r in R.fuse(ranked("ab"), ranked("bc"), 3).orderBy("rank").collect()]
    assert [x for x, _ in got] == ["b", "a", "c"] and got[0][1] == pytest.approx(1 / 62 + 1 / 61)
    assert [r["id"] for r in R.fuse(ranked("x"), ranked("y"), 2).orderBy("rank").collect()] == ["x", "y"]


def test_median_recall_and_empty(spark):
    hits = spark.createDataFrame([(i, r) for i, r in enumerate([1, 3, 5, 9, None])], "item_id long, hit_rank int")
    assert R.upper_median(hits).first()["median_rank"] == 5
    assert R.recall_at(hits).first()["recall_5"] == pytest.approx(3 / 5)
    none = spark.createDataFrame([], "item_id long, id string, rank int")
    assert R.rerank(none, items(spark, [(1, "x")]), units(spark), R.overlap_score, 3).count() == 0


def test_readers(spark):
    judged = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, True), (2, "a", 1, True), (2, "b", 2, False), (3, "a", 1, False)], "item_id long, id string, rank int, grounded boolean")
    own = items(spark, [(1, ""), (2, ""), (3, ""), (4, "")])
    got = {r["item_id"]: (r["cited"], r["abstained"], r["repaired"]) for r in readers.verify_repair(own, judged, 1).collect()}
    assert got == {1: ("b", False, True), 2: ("a", False, False), 3: ("", True, False), 4: ("", True, False)}
    picks = spark.createDataFrame([(1, "b"), (2, "zz"), (3, None)], "item_id long, best_id string")
    got = {r["item_id"]: (r["cited"], r["repaired"]) for r in readers.joint_select(own, judged, picks).collect()}
    assert got == {1: ("b", True), 2: ("", False), 3: ("", False), 4: ("", False)}
    answers = spark.createDataFrame([(1, True, "x", ["a"]), (2, False, "x", ["a"]), (3, True, " ", []), (4, True, "text", []), (5, None, None, None)], "item_id long, answerable boolean, answer string, citations array<string>")
    got = {r["item_id"]: (r["cited"], r["abstained"]) for r in readers.decide(answers).collect()}
    assert got == {1: (["a"], False), 2: ([], True), 3: ([], True), 4: ([], False), 5: ([], True)}


@pytest.mark.parametrize("block", [1, 3, 100])
def test_dense_in_blocks(spark, block):
    own = {i: [float(i % 3), float(i % 5)] for i in range(20)}
    vectors = spark.createDataFrame(list(own.items()), "id long, embedding array<double>")
    queries = spark.createDataFrame([*[(i, own[i]) for i in range(0, 20, 4)], (None, [1.0, 1.0])], "item_id long, embedding array<double>")
    got = {(r["item_id"], r["rank"]): (r["id"], r["score"]) for r in R.dense(vectors, queries, 3, block).collect()}
    want = {}
    for q in range(0, 20, 4):
        each = sorted(((sum(a * b for a, b in zip(own[q], v)), i) for i, v in own.items()), key=lambda x: (-x[0], x[1]))
        want |= {(q, n + 1): (i, s) for n, (s, i) in enumerate(each[:3])}
    assert got == want


@pytest.mark.parametrize("ranks,want", [([1, 2, 3, 4], 3), ([5, 1, 1], 1), ([None, 7], 7), ([None], None)])
def test_upper_median(spark, ranks, want):
    row = R.upper_median(spark.createDataFrame([(r,) for r in ranks], "hit_rank int")).first()
    assert (row["n_found"], row["median_rank"]) == (sum(r is not None for r in ranks), want)
