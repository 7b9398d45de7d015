import hashlib
import math
import random

import numpy as np

from attesta.operators import agreement, significance, spans


def test_overlaps_against_all_pairs(spark):
    """Ranges of every length, one over all the others, very far places, and below 0."""
    r = random.Random(1)

    def ranges(n, seed):
        out = []
        for i in range(n):
            lo = r.randrange(-2000, 2000) if i % 9 else r.randrange(-(1 << 60), 1 << 60)
            out.append((r.choice("ab"), i, lo, lo + int(2 ** r.uniform(0, 10)) - 1))
        return out + [("a", n, -(1 << 61), 1 << 61)]

    a, b = ranges(150, 1), ranges(150, 2)
    frame = lambda rows, name: spark.createDataFrame(rows, f"g string, {name} long, lo long, hi long")
    out = spans.overlaps(frame(a, "l"), frame(b, "r"), ["g"])
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(x) for x in out.collect())
    assert got == sorted((g, i, j) for g, i, lo, hi in a for h, j, lo2, hi2 in b if g == h and lo <= hi2 and lo2 <= hi)


def test_span_scores(spark):
    units = spark.createDataFrame([("gita", f"2.{i}", i) for i in range(1, 60)] + [("yoga", f"2.{i}", i) for i in range(1, 5)], "corpus string, id string, ord int")
    frame = lambda rows: spark.createDataFrame(rows, "item_id string, corpus string, id_start string, id_end string")
    gold = frame([("hit", "gita", "2.47", "2.48"), ("near", "gita", "2.10", "2.12"), ("far", "gita", "2.1", "2.2"), ("far", "gita", "2.20", "2.29"), ("none", "gita", "2.5", None), ("other", "yoga", "2.1", "2.2")])
    cited = frame([("hit", "gita", "2.47", None), ("hit", "gita", "2.47", None), ("near", "gita", "2.13", "2.13"), ("far", "gita", "2.25", "2.40"), ("far", "gita", "2.26", "2.27"), ("far", "gita", "2.99", None), ("far", "gita", "2.9", "2.8"), ("extra", "gita", "2.1", "2.3"), ("other", "gita", "2.1", "2.2")])
    rows = {x["item_id"]: x for x in spans.score(cited, gold, units).collect()}
    of = lambda i: tuple(rows[i])[1:]
    assert of("hit") == (1, 1, 0, 1.0, 1.0, 1.0, 1.0, 0.5)
    assert of("near") == (1, 1, 0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert of("far") == (4, 2, 2, 0.5, 0.5, 0.5, 5 / 16, 5 / 12)
    assert of("none") == (0, 1, 0, 0.0, 0.0, 0.0, None, 0.0) and of("extra") == (1, 0, 0, 0.0, 0.0, 0.0, 0.0, None)
    assert of("other") == (1, 1, 0, 0.0, 0.0, 0.0, 0.0, 0.0)  # other corpora have ids of the same name
    near = {x["item_id"]: x for x in spans.score(cited, gold, units, tol=1).collect()}
    assert near["near"]["f1"] == 1.0 and near["near"]["unit_p"] == 0.0
    assert spans.score(cited.limit(0), gold.limit(0), units).count() == 0


def weight(item, replicate, seed=""):
    u = int(hashlib.md5(f"{seed}:{item}:{replicate}".encode()).hexdigest()[:8], 16) / 2**32
    return sum(u >= p for p in significance.DRAWS)


def test_intervals_against_a_loop(spark):
    r = random.Random(2)
    rows = [(f"i{i}", r.choice("ab"), r.random() if r.random() > 0.2 else None, float(r.random() < 0.3)) for i in range(120)] + [("x", "c", None, 1.0)]
    scores = spark.createDataFrame(rows, "item_id string, cell string, f1 double, mar double")
    got = {(x["cell"], x["metric"]): x for x in significance.intervals(scores, ["f1", "mar"], ["cell"], n=60, seed="s").collect()}
    assert len(got) == 6
    for (cell, metric), x in got.items():
        own = [(i, row[2 + ("f1", "mar").index(metric)]) for row in rows for i in [row[0]] if row[1] == cell]
        own = [(i, v) for i, v in own if v is not None]
        means = [sum(w * v for w, (_, v) in zip(ws, own)) / sum(ws) for b in range(1, 61) if sum(ws := [weight(i, b, "s") for i, _ in own])]
        if not own:
            assert (x["estimate"], x["lo"], x["hi"]) == (None, None, None)
            continue
        np.testing.assert_allclose([x["estimate"], x["lo"], x["hi"]], [np.mean([v for _, v in own]), *np.percentile(means, [2.5, 97.5])])
    assert significance.intervals(scores.limit(0), ["f1"], ["cell"]).count() == 0


def test_weights_are_poisson():
    from collections import Counter

    seen = Counter(weight(i, b) for i in range(200) for b in range(50))
    assert all(abs(seen[k] / 10_000 - math.exp(-1) / math.factorial(k)) < 0.02 for k in range(5))


def test_paired_and_mcnemar(spark):
    r = random.Random(3)
    items = [(f"i{i}", r.random() < 0.7, r.random() < 0.5) for i in range(90)]
    rows = [(i, s, float(v)) for i, a, b in items for s, v in (("A", a), ("B", b))] + [("only", "A", 1.0), ("null", "A", 1.0), ("null", "B", None)]
    scores = spark.createDataFrame(rows, "item_id string, system string, f1 double")
    x = significance.paired(scores, ["f1"], "system", "A", "B", n=50).first()
    diffs = [(i, float(a) - float(b)) for i, a, b in items]
    means = [sum(w * d for w, (_, d) in zip(ws, diffs)) / sum(ws) for b in range(1, 51) if sum(ws := [weight(i, b) for i, _ in diffs])]
    np.testing.assert_allclose([x["estimate"], x["lo"], x["hi"]], [np.mean([d for _, d in diffs]), *np.percentile(means, [2.5, 97.5])])
    assert x["p"] == min(1.0, 2 * min(np.mean(np.array(means) <= 0), np.mean(np.array(means) >= 0)))

    m = significance.mcnemar(scores.selectExpr("item_id", "system", "f1 = 1 AS ok"), "system", "ok", "A", "B").first()
    counts = [sum(a == p and b == q for _, a, b in items) for p, q in ((True, True), (True, False), (False, True), (False, False))]
    assert [m["both"], m["only_a"], m["only_b"], m["neither"]] == counts
    n, k = counts[1] + counts[2], min(counts[1:3])
    np.testing.assert_allclose([m["statistic"], m["p"]], [(abs(counts[1] - counts[2]) - 1) ** 2 / n, min(1, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)])
    same = significance.mcnemar(scores.where("system = 'A'").selectExpr("item_id", "explode(array('A', 'B')) AS system", "f1 = 1 AS ok"), "system", "ok", "A", "B").first()
    assert same["p"] is None and same["statistic"] is None and same["only_a"] == 0


def test_mcnemar_of_many(spark):
    from pyspark.sql import functions as F

    own = spark.range(4000).select(F.col("id").alias("item_id"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("system"))
    own = own.withColumn("ok", (F.col("system") == "A") == (F.col("item_id") % 100 < 52))
    m = significance.mcnemar(own, "system", "ok", "A", "B").first()
    np.testing.assert_allclose(m["p"], math.erfc(math.sqrt(m["statistic"] / 2)), rtol=1e-6)


def test_weighted_kappa(spark):
    scale = ("none", "partial", "full")
    r = random.Random(4)
    pairs = [(g, u, r.choice(scale), r.choice(scale)) for g in "ab" for u in range(40)] + [("same", u, "full", "full") for u in range(5)]
    rows = [(g, u, i, v) for g, u, a, b in pairs for i, v in ((1, a), (2, b))] + [("a", 90, 1, "full"), ("a", 91, 1, "odd"), ("a", 91, 2, "full"), ("one", 1, 1, "full")]
    ratings = spark.createDataFrame(rows, "group string, unit int, rater int, value string")
    for power in (1, 2):
        got = {x["group"]: x for x in agreement.weighted_kappa(ratings, scale, power=power).collect()}
        for g in "ab":
            own = [(scale.index(a), scale.index(b)) for h, _, a, b in pairs if h == g]
            seen = np.mean([abs(a - b) ** power for a, b in own])
            chance = np.mean([abs(a - b) ** power for a, _ in own for _, b in own])
            assert got[g]["n"] == 40 and math.isclose(got[g]["kappa"], 1 - seen / chance)
        assert got["same"]["kappa"] is None and "one" not in got
