import os
import random

import pytest
from pyspark.sql import functions as F

from attesta.llm import toxicity as T
from tests.llm.conftest import prose

BAD = ["grobnik", "slimeface", "dunderhead"]


def text(i, toxic, how=lambda w: w):
    words = prose(40, i).split()
    if toxic:
        words[5 + i % 20] = how(BAD[i % 3])
        words[30] = how(BAD[(i + 1) % 3])
    return " ".join(words)


def hide(w, i=0):
    return [w.replace("i", "1").replace("e", "3"), " ".join(w), w[:2] + w[2] * 4 + w[3:], w.replace("a", "@") + "!!"][i]


@pytest.fixture(scope="module")
def rows():
    return [(i, text(i, i % 5 == 0)) for i in range(400)]


def test_scores(spark, docs, rows):
    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    hidden = [(1000 + i, text(i, True, lambda w, i=i: hide(w, i % 4))) for i in range(40)]
    got = {r["doc_id"]: r for r in T.score(docs(rows + hidden + [(2000, None), (2001, "")]), known).collect()}
    unseen = [i for i in range(300, 400)]
    assert all(got[i]["predicted"] == int(i % 5 == 0) for i in unseen)
    assert sum(got[1000 + i]["predicted"] for i in range(40)) >= 36
    assert got[2000]["predicted"] == got[2001]["predicted"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    kept = T.keep(docs(rows), known)
    assert {r["doc_id"] for r in kept.collect()} == {i for i in range(400) if i % 5} and kept.columns == docs(rows).columns


def test_odd_rows(spark, docs, odd, rows):
    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = T.score(docs([*odd, *rows]), known)
    assert out.count() == len(odd) + len(rows)
    none = T.score(docs(odd), known.where("doc_id < 0")).collect()
    assert all(r["score"] == 0.0 for r in none)
    assert T.score(docs([]), known).count() == 0


def test_held_out_rows_are_not_learned_from(spark):
    known = spark.createDataFrame([(i, 1) for i in range(60)], "doc_id long, toxic int")
    import zlib

    assert {r["doc_id"] for r in T.train_rows(known).collect()} == {i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_viterbi_against_all_readings():
    import itertools
    from collections import Counter

    counts = Counter(g for w in ["idiot", "idea", "dot", "riot", "lid"] for g in T.grams(w))
    language = T.Language(counts)
    for token in ("1d10t", "d0t", "l1d", "ri0t"):
        options = [[(c, 0.0)] if c.isalpha() else [(x, T.SWAP) for x in T.LOOK_ALIKE[c]] + [("", T.DROP)] for c in token]
        best = min((sum(p for _, p in combo) + sum(language.cost(g) for g in T.grams("".join(x for x, _ in combo))), "".join(x for x, _ in combo)) for combo in itertools.product(*options))
        assert T.restore(token, language)[0] == best[1]


def test_long_tokens():
    """Very long tokens and spelled-out texts take seconds, and the parts of a reading are those of a short token."""
    import time
    from collections import Counter

    language = T.Language(Counter(g for w in ["idiot", "idea", "dot", "riot", "lid"] for g in T.grams(w)))
    judge = T.Judge({"idiot$": 9.0}, language)
    began = time.perf_counter()
    token = "1d10t" * 40_000
    assert len(T.restore(token, language)[0]) == len(token)
    assert judge.evidence(" ".join("idiot" * 20_000))[0] >= 0
    assert time.perf_counter() - began < 60
    assert judge.evidence("an 1d10t")[0] == 9.0 and judge.evidence("i d i o t")[0] == 9.0 and judge.evidence("idea")[0] == 0.0


def test_evidence_against_plain_counts(spark, docs, rows):
    """Weights by plain loops over the labelled texts."""
    import math

    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    weights, language, _ = T.train(docs(rows).select("doc_id", "text"), known)
    of = {i: {f for w in t.split() if len(w) > 2 for f in T.features(w)} for i, t in rows[:300]}
    tox, n = [i for i in of if i % 5 == 0], len(of)
    want = {}
    for f in set().union(*(of[i] for i in tox)):
        a, b = sum(f in of[i] for i in tox), sum(f in of[i] for i in of if i % 5)
        w = math.log((a + 0.5) / (len(tox) + 1)) - math.log((b + 0.5) / (n - len(tox) + 1))
        if a >= 3 and w > 1:
            want[f] = w
    assert weights.keys() == want.keys() and all(abs(weights[f] - want[f]) < 1e-9 for f in want)
    counts: dict = {}
    for _, t in rows:
        for w in t.split():
            for g in T.grams(w):
                counts[g] = counts.get(g, 0) + 1
    plain = T.Language(counts)
    assert plain.log.keys() == language.log.keys() and all(abs(plain.log[g] - language.log[g]) < 1e-9 for g in plain.log)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test data here")
def test_held_out_recall(spark):
    """Some held-out toxic documents hold no word with weight and can't be found."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    held = labels.where("crc32(cast(doc_id as string)) % 3 = 1").select("doc_id", "toxic")
    got = T.score(docs, T.train_rows(labels)).join(held, "doc_id").groupBy("toxic").agg(F.avg("predicted").alias("share")).collect()
    share = {r["toxic"]: r["share"] for r in got}
    assert share[1] >= 0.9 and share[0] < 0.005


def test_what_a_worker_holds(spark, docs, rows, monkeypatch):
    """Counted features are passed on before they are many, and texts come in few at a time where whole tables are read."""
    import pyarrow as pa

    held = []

    class Frame:
        def mapInArrow(self, run, schema):
            words = [" ".join(f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j // 26)}{chr(97 + j % 26)}zzzzz" for j in range(200)) for i in range(100)]
            held.extend(b.num_rows for b in run(iter([pa.RecordBatch.from_pydict({"cell": [0] * 100, "text": words})])))
            return self

        def groupBy(self, *_):
            return self

        agg = groupBy

    T._count(Frame())
    assert len(held) > 1 and max(held) < 60_000
    seen, durable = {}, T.durable

    def spied(df, name):
        seen[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return durable(df, name)

    monkeypatch.setattr(T, "durable", spied)
    known = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int")
    assert T.score(docs(rows), known).count() == 400 and T.keep(docs(rows), known).count() == 320
    assert seen["scores"] == seen["kept"] == T.ROWS
