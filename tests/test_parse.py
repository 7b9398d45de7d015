import math

import pytest
from pyspark.sql import functions as F

from attesta.functions import parse
from attesta.operators import retrieval as R


def test_parsers(spark):
    rows = [("```json\n{\"a\": {\"b\": 1}} rest }",), ("58, 59. text",), ("none",), (None,), ("{open",)]
    got = spark.createDataFrame(rows, "t string").select(parse.balanced_json(F.col("t")).alias("j"), parse.numbers_prefix(F.col("t")).alias("n")).collect()
    assert [r["j"] for r in got] == ['{"a": {"b": 1}}', None, None, None, None]
    assert got[1]["n"] == [58, 59] and got[2]["n"] == []
    row = spark.sql("select '239 A A' a, 'Repealed by Act 1' r, 'repeats' s, 'āṃ' m, map('hi', named_struct('question', ' ')) t").select(
        parse.article_key(F.col("a")).alias("a"), parse.repealed(F.col("r")).alias("r"), parse.repealed(F.col("s")).alias("s"), parse.strip_marks(F.col("m")).alias("m"),
        parse.in_language(F.col("t"), "hi", "question", F.lit("en")).alias("q")).first()
    assert tuple(row["a"]) == (239, "AA") and row["r"] and not row["s"] and row["m"] == "am" and row["q"] == "en"


def test_ndcg(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "item_id long, id string, rank int")
    gold = spark.createDataFrame([(1, "b"), (1, "c"), (2, "z")], "item_id long, id string")
    got = {r["item_id"]: r["ndcg"] for r in R.ndcg_at(ranked, gold).collect()}
    want = (1 / math.log2(3) + 1 / math.log2(4)) / (1 + 1 / math.log2(3))
    assert got[1] == pytest.approx(want, abs=1e-6) and got[2] == 0
