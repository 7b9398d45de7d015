import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from attesta.functions.sets import masi_distance
from attesta.operators import agreement as A


def ratings(spark, units, kind="string"):
    rows = [("all", str(u), r, v) for u, values in enumerate(units) for r, v in enumerate(values)]
    return spark.createDataFrame(rows, f"group string, unit string, rater int, value {kind}")


def nominal(a, b):
    return F.when(a == b, 0.0).otherwise(1.0)


@pytest.mark.parametrize("units,want", [(["AA", "BB"], 1), (["AB", "AB"], -0.5), (["AA"], None)])
def test_alpha_nominal(spark, units, want):
    got = A.alpha(ratings(spark, [list(u) for u in units]), nominal).first()["alpha"]
    assert got == want if want is None else got == pytest.approx(want)


def test_alpha_single_ratings(spark):
    assert A.alpha(ratings(spark, [["A"]]), nominal).count() == 0


@pytest.mark.parametrize("units,want", [([[["1", "2"], ["1"]]], 0), ([[["1", "2"], ["1"]], [["3"], ["3", "4"]]], 0.25)])
def test_alpha_masi(spark, units, want):
    assert A.alpha(ratings(spark, units, "array<string>"), masi_distance).first()["alpha"] == pytest.approx(want)


@pytest.mark.parametrize("seed", range(3))
def test_alphas_without_pairs_of_all_values(spark, seed):
    own = random.Random(seed)
    sets = [[sorted(own.sample("pqrst", own.randrange(4))) for _ in range(own.randrange(1, 5))] for _ in range(12)]
    rated = ratings(spark, sets, "array<string>")
    assert A.masi_alpha(rated).first()["alpha"] == pytest.approx(A.alpha(rated, masi_distance).first()["alpha"])
    words = ratings(spark, [["".join(x) for x in unit] for unit in sets])
    assert A.nominal_alpha(words).first()["alpha"] == pytest.approx(A.alpha(words, nominal).first()["alpha"])


def test_alphas_undefined_or_of_shuffled_sets(spark):
    assert A.masi_alpha(ratings(spark, [[["a", "b"], ["b", "a", "a"]], [["b", "a"], ["a", "b"]]], "array<string>")).first()["alpha"] is None
    assert A.masi_alpha(ratings(spark, [[[], []], [["a"], ["a"]]], "array<string>")).first()["alpha"] == pytest.approx(1)
    assert A.nominal_alpha(ratings(spark, [["A", "A"]])).first()["alpha"] is None
    assert A.nominal_alpha(ratings(spark, [["A"]])).count() == 0


@pytest.mark.parametrize("units,want", [(["yy", "yy", "yy", "yn", "ny", "nn"], 0.25), (["aa", "bb", "aa", "bb"], 1)])
def test_cohen(spark, units, want):
    assert A.cohen(ratings(spark, [list(u) for u in units])).first()["kappa"] == pytest.approx(want)


def test_fleiss_and_dispatch(spark):
    assert A.fleiss(ratings(spark, [list(u) for u in ("aaa", "aab", "bbb")])).first()["kappa"] == pytest.approx(0.55)
    assert A.categorical(ratings(spark, [list(u) for u in ("aa", "ab")])).first()["method"] == "cohen"
    assert A.categorical(ratings(spark, [list(u) for u in ("aa", "abb")])).first()["method"] == "fleiss"
    assert A.categorical(ratings(spark, [["a"]])).count() == 0


def adjudicated(spark, verdicts):
    """verdicts: (reviewer, status, gold, type)."""
    t = dt.datetime(2024, 1, 1)
    rows = [(r, "c", "i", s, t, i, g, q, None) for i, (r, s, g, q) in enumerate(verdicts)]
    v = spark.createDataFrame(rows, "reviewer string, corpus string, item_id string, status string, ts timestamp, row_idx long, edit_gold array<string>, edit_type string, edit_ambiguity string")
    items = spark.createDataFrame([("i", ["2.47"], "factual", "low")], "item_id string, gold array<string>, question_type string, ambiguity string")
    return A.adjudicate(A.effective(A.latest(v), items), items).first()


@pytest.mark.parametrize("verdicts,resolution,reason,conflicts,edited", [
    ([("a", "approve", None, None), ("b", "approve", None, None)], "verified", None, None, False),
    ([("a", "edit", ["2.48"], None), ("b", "edit", ["2.48"], None)], "verified", None, None, True),
    ([("a", "edit", ["2.48"], None), ("b", "edit", ["3.19"], None)], "needs_adjudication", "edit_conflict", "gold_citations", None),
    ([("a", "approve", None, None), ("b", "reject", None, None)], "needs_adjudication", "reject_approve_split", None, None),
    ([("a", "reject", None, None), ("b", "reject", None, None)], "needs_adjudication", "all_reject", None, None),
    ([("a", "approve", None, None)], "insufficient_reviews", None, None, None),
])
def test_adjudication(spark, verdicts, resolution, reason, conflicts, edited):
    r = adjudicated(spark, verdicts)
    assert (r["resolution"], r["reason"], r["conflicts"], r["edited"]) == (resolution, reason, conflicts, edited)


def test_edited_to_unanswerable_and_latest(spark):
    r = adjudicated(spark, [("a", "edit", [], "unanswerable"), ("b", "edit", [], "unanswerable")])
    assert r["must_abstain"] and r["gold"] == ""
    r = adjudicated(spark, [("a", "reject", None, None), ("b", "approve", None, None), ("a", "approve", None, None)])
    assert r["resolution"] == "verified"  # of equal times the later row counts
