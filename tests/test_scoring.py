import pytest
from pyspark.sql import functions as F

from attesta.functions import ids, sets
from attesta.operators import scoring

#: Ids of two chapters; 9.9 is no id.
U = [f"1.{i}" for i in range(1, 9)] + [f"7.{i}" for i in range(1, 5)]
# id, gold, near misses, must abstain, answerable, cited, retrieved, abstained
ROWS = [
    # cites one of three gold ids and a near miss: p 1/2, r 1/3, f1 2/5; both are retrieved; two ids wrong: no, one, and near
    ("half", ["1.1", "1.3", "7.2"], ["7.1"], False, True, ["7.2", "7.1"], ["7.1", "7.2", "1.8"], False),
    # an id that doesn't exist beside a right one: p 1/2, r 1, f1 2/3; cer 1/2; one of two retrieved
    ("ghost", ["7.4"], [], False, True, ["7.4", "9.9"], ["7.4"], False),
    # nothing to cite and nothing cited: all measures 1
    ("quiet", [], ["1.5"], True, False, [], ["1.5"], True),
    # gives up where there is an answer: f1 0
    ("shy", ["1.2"], [], False, True, [], ["1.2"], True),
    # cites where it should not: f1 0, cer 1, wrong by one id that is no near miss
    ("loud", [], ["1.7"], True, False, ["1.4"], ["1.6"], False),
]
SCHEMA = "item_id string, gold array<string>, near_miss array<string>, must_abstain boolean, answerable boolean, cited array<string>, retrieved array<string>, abstained boolean"


def near(c, g):
    return ids.adjacent(c, g, "dotted")


def scored(spark, rows=ROWS):
    units = spark.createDataFrame([(u,) for u in U], "id string")
    return scoring.score_items(scoring.existing(spark.createDataFrame(rows, SCHEMA), units), near)


def test_aggregates_by_hand(spark):
    m = scored(spark).agg(*scoring.metrics()).first().asDict()
    want = {
        "n": 5, "n_citing": 3, "n_unanswerable": 2,
        "cer": (1 + 1 / 2 + 1) / 3, "cg": (1 + 1 / 2 + 0) / 3,  # of the three that cite
        "f1_exact": (2 / 5 + 2 / 3 + 1 + 0 + 0) / 5,
        "mar": 1.0, "mar_exist": 1 / 3, "mar_support": 2 / 3,  # half cites 7.1, loud 1.4, ghost 9.9
        "nmr": 1 / 3,  # of 7.1, 9.9 and 1.4 the first is a near miss
        "abstention_accuracy": 1 / 2, "over_citation_rate": 1 / 2, "wrong_abstention_rate": 1 / 3,
    }
    for k, v in want.items():
        assert m[k] == pytest.approx(v, abs=1e-6), k


def test_scores_of_items_by_hand(spark):
    got = {r["item_id"]: r for r in scored(spark).collect()}
    assert (got["half"]["p"], got["half"]["r"]) == (0.5, pytest.approx(1 / 3))
    assert got["half"]["span_f1"] == pytest.approx(2 * 1 * (1 / 3) / (1 + 1 / 3))  # 7.1 is beside 7.2, 1.1 and 1.3 stay alone
    assert got["ghost"]["exist_error"] and not got["ghost"]["support_error"] and got["ghost"]["cer"] == 0.5
    assert got["quiet"]["f1"] == 1.0 and got["quiet"]["cer"] is None and not got["quiet"]["misattributed"]


def test_labels_of_a_judge_overrule_gold(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).withColumn("support", F.expr("case item_id when 'half' then map('7.1', 'partial') when 'ghost' then map('7.4', 'none') end"))
    units = spark.createDataFrame([(u,) for u in U], "id string")
    got = {r["item_id"]: r for r in scoring.score_items(scoring.existing(rows, units), near).collect()}
    assert not got["half"]["misattributed"] and got["ghost"]["support_error"] and got["loud"]["support_error"]


def test_no_rows(spark):
    m = scored(spark, []).agg(*scoring.metrics()).first()
    assert m["n"] == 0 and m["mar"] is None and m["nmr"] is None


def test_masi(spark):
    cases = [(["1", "2"], ["1", "2"], 0), (["1", "2"], ["1"], 2 / 3), (["1", "2"], ["2", "3"], 8 / 9), (["1"], ["2"], 1), ([], [], 0), ([], ["1"], 1)]
    rows = spark.createDataFrame(cases and [(a, b, float(w)) for a, b, w in cases], "a array<string>, b array<string>, want double")
    for r in rows.withColumn("got", sets.masi_distance(F.col("a"), F.col("b"))).collect():
        assert r["got"] == pytest.approx(r["want"])
