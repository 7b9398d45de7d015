import bisect
import random

from pyspark.sql import functions as F

from attesta.operators import extract


def test_asof_of_two_large_tables(spark):
    """10^5 starts and a key that a third of the rows share: the same rows as bisection, and no nested loop."""
    r = random.Random(1)
    at = sorted(r.sample(range(10**7), 100_000))
    keys = [r.randrange(-10, 10**7 + 10) for _ in range(20_000)] + [5_000_000] * 10_000
    starts = spark.createDataFrame([(a, f"n{a}") for a in at], "start long, name string")
    rows = spark.createDataFrame(list(enumerate(keys)), "i long, k long")
    out = extract.asof(rows, starts, "k", "start")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {x["i"]: x["start"] for x in out.collect()}
    assert len(got) == len(keys)
    assert all(got[i] == (at[j - 1] if (j := bisect.bisect_right(at, k)) else None) for i, k in enumerate(keys))


def test_asof_by_group(spark):
    r = random.Random(2)
    starts = sorted({(r.choice("abc"), r.randrange(300)) for _ in range(120)})
    rows = [(i, r.choice("abcd"), r.randrange(320)) for i in range(400)] + [(400, None, 5), (401, "a", None)]
    out = extract.asof(spark.createDataFrame(rows, "i long, g string, k int"), spark.createDataFrame(starts, "g string, s int"), "k", "s", ["g"]).collect()
    assert len(out) == len(rows)
    for x in out:
        own = [s for g, s in starts if g == x["g"] and x["k"] is not None and s <= x["k"]]
        assert x["s"] == max(own, default=None)


def test_asof_of_few_and_none(spark):
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, float("-inf"))], "i int, k double")
    none = spark.createDataFrame([], "s double, n string")
    assert [x["n"] for x in extract.asof(rows, none, "k", "s").collect()] == [None] * 3
    assert extract.asof(rows.limit(0), none, "k", "s").count() == 0
    one = spark.createDataFrame([(1.5, "x"), (None, "y")], "s double, n string")
    assert {x["i"]: x["n"] for x in extract.asof(rows, one, "k", "s").collect()} == {1: "x", 2: None, 3: None}
    days = spark.sql("SELECT DATE'2020-01-02' AS d UNION ALL SELECT DATE'2021-01-02'")
    got = extract.asof(days, spark.sql("SELECT DATE'2020-06-01' AS s, 'june' AS n"), "d", "s").orderBy("d").collect()
    assert [x["n"] for x in got] == [None, "june"]


def sequential(a, b, least=0.86):
    """One edition after the other, line by line."""
    from difflib import SequenceMatcher

    import pandas as pd

    sa, sb = (extract.skeleton(pd.Series(x, dtype="object")).tolist() for x in (a, b))
    sure, last = [], -1
    for i, s in enumerate(sa):
        if s and sa.count(s) == 1 and sb.count(s) == 1 and sb.index(s) > last:
            last = sb.index(s)
            sure.append((i, last))
    out = {(i, j, 1.0) for i, j in sure}
    ends = [(-1, -1), *sure, (len(sa), len(sb))]
    for (i0, j0), (i1, j1) in zip(ends, ends[1:]):
        at = j0 + 1
        for i in range(i0 + 1, i1):
            best, where = 0.0, None
            for j in range(at, j1):
                ratio = SequenceMatcher(None, sa[i], sb[j]).ratio() if sa[i] and sb[j] else 0.0
                if ratio > best:
                    best, where = ratio, j
                if best >= 0.999:
                    break
            if where is not None and best >= least:
                out.add((i, where, round(best, 6)))
                at = where + 1
    return out


def test_align_in_stretches_equals_one_pass(spark):
    r = random.Random(3)
    words = ["dharma", "kuru", "kṣetra", "pāṇḍava", "rāma", "sītā", "vana", "gaccha", "uvāca", "muni", "nara", "deva"]
    editions, left, right = {}, [], []
    for g in range(4):
        a = [" ".join(r.choices(words, k=r.randrange(3, 7))) for _ in range(70)] + ["", "1 2 3", "राम"]
        b = []
        for line in a:
            if r.random() < 0.08:
                b.append(" ".join(r.choices(words, k=4)))
            if r.random() > 0.08:
                k = r.randrange(max(1, len(line)))
                b.append(line if r.random() < 0.4 else line[:k] + r.choice("aeiou") + line[k + 1 :])
            if r.random() < 0.05:
                b.append(line)
        editions[f"g{g}"] = (a, b)
        left += [(f"g{g}", i, t) for i, t in enumerate(a)]
        right += [(f"g{g}", i, t) for i, t in enumerate(b)]
    lines = lambda rows: spark.createDataFrame(rows, "group string, ord long, text string")
    got = {}
    for x in extract.align(lines(left), lines(right)).collect():
        got.setdefault(x["group"], set()).add((x["l"], x["r"], x["ratio"]))
        assert x["confidence"] == ("high" if x["ratio"] >= 0.97 else "medium")
    assert got == {g: sequential(a, b) for g, (a, b) in editions.items()}
    assert any(ratio < 1 for x in got.values() for _, _, ratio in x)


def test_align_an_edition_with_a_change_of_itself(spark):
    """Both sides from one table."""
    own = spark.createDataFrame([("g", i, t) for i, t in enumerate(["rama gaccha", "vana muni", "vana muni", "deva", "sita uvaca nara"])], "group string, ord long, text string")
    other = own.withColumn("text", F.when(F.col("ord") == 4, "sita uvaca nari").otherwise(F.col("text")))
    assert [(x["l"], x["r"]) for x in extract.align(own, other).orderBy("l").collect()] == [(i, i) for i in range(5)]
