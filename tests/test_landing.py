import random
import re

import pytest
from pyspark.sql import functions as F

from attesta.operators import numbering, profile as P
from attesta.sources import calls as C, vectors


def test_label_keys(spark):
    rows = [("flat", " 7 ", "", 7), ("two", "3.2", "3", 2), ("six_sections_in_two", "4.7", "2.4", 7), ("six_sections_in_two", "3.1", "1.3", 1), ("three_or_first", "1,3.14", "1.3", 14), ("three_or_first", "2.5", "2.1", 5), ("two", "3.2.1", None, None), ("flat", "9" * 30, None, None), ("none", "1", None, None), (None, "1", None, None), ("flat", None, None, None)]
    own = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(rows)], "i int, scheme string, label string")
    key = numbering.label_key(F.col("label"), F.col("scheme"))
    got = own.select(key.alias("k"), numbering.label_of(key).alias("l"), "i").orderBy("i").collect()
    assert [(None, None) if x["k"] is None else (".".join(map(str, x["k"]["section"])), x["k"]["number"]) for x in got] == [r[2:] for r in rows]
    assert got[2]["l"] == "2.4.7" and got[0]["l"] == "7"


def by_loop(paragraphs, jump):
    last, out = 0, {}
    for t in paragraphs:
        t = (t or "").strip(" ")
        if not t:
            continue
        m = re.match(r"(?s)^(\d+)\s*\.\s*(.*)$", t)
        if m:
            n = int(m[1])
            if (last == 0 and n == 1) or (last > 0 and last < n <= last + jump):
                last, out[n] = n, m[2].strip(" ")
        elif last:
            out[last] = f"{out[last]} {t}".strip(" ")
    return out


def test_accepted_units_against_a_loop(spark):
    r = random.Random(3)
    pages = {p: [r.choice([None, "", " ", "said", "and  so", "9" * 25 + ". far", f"{r.randrange(0, 4) + i // 2} . n{i}", f"{i // 2 + 1}."]) for i in range(r.randrange(0, 60))] for p in range(40)}
    pages[40] = ["1. a", "b", "9. no", "c", "5. d", "", "2. again", "e"]
    own = spark.createDataFrame([(p, i, t) for p, ts in pages.items() for i, t in enumerate(ts)], "page int, at int, text string").repartition(7)
    out = numbering.accepted_units(own, ["page"], "at")
    got = {(x["page"], x["n"]): x["text"] for x in out.collect()}
    assert got == {(p, n): t for p, ts in pages.items() for n, t in by_loop(ts, 4).items()}
    assert got[40, 1] == "a b c" and got[40, 5] == "d e"
    assert numbering.accepted_units(own.limit(0), ["page"], "at").count() == 0
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2


def test_lines_before_markers(spark):
    lines = ["Title", "|| iti first part ||", "agnim ile | purohitam", "yajnasya || Rv_1.1 || devam /", "hotaram // Rv_1.2 //", "heading", "", None, "Rv", "ratna | x || Rv_1.2 || none", "open |"]
    own = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)] + [("g", 0, "|| Rv_3 ||")], "file string, at int, text string")
    got = {(x["file"], x["label"]): x["text"] for x in numbering.before_markers(own, ["file"], "at").collect()}
    assert got == {("f", "1.1"): "agnim ile | purohitam yajnasya", ("f", "1.2"): "ratna | x", ("g", "3"): ""}
    assert numbering.before_markers(own.limit(0), ["file"], "at").count() == 0


SOURCE = r"""
# T.row(0, 'no')
s = "T.row(1)"
T.row(1, u'''it\'s, "so" (big
'quoted' end\''''
, "a\"b", 'c' "d", -2.5, f(x, (1, 2)), None, )
T . row( 2 ,, T.row(3, '''''') )
XT.row(4); T.rows(5); T.row(6, '''never ends
"""


def test_calls(spark):
    own = spark.createDataFrame([(0, SOURCE), (1, None), (2, "")], "i int, s string")
    got = {x["i"]: x["c"] for x in own.select("i", C.calls(F.col("s"), "T.row").alias("c")).collect()}
    assert got[1] == [] and got[2] == []
    first, second, third = got[0]
    assert first == ["1", "it\\'s, \"so\" (big\n'quoted' end\\'", 'a\\"b', "cd", "-2.5", "f(x, (1, 2))", "None"]
    assert second == ["2", None, "T.row(3, '''''')"] and third == ["3", ""]
    text = spark.createDataFrame([("a\\'b &quot;c&#9;d&#10;\\\"",)], "t string").select(C.source_unescape(F.col("t"))).first()[0]
    assert text == "a'b 'c d\n\""


def test_calls_of_long_literals(spark):
    """A literal of many escapes and apostrophes, and many calls."""
    long_ = "\\'it''s \\\\" * 30_000
    own = spark.createDataFrame([("".join(f"K(%d, '''{long_ if i == 5 else i}''')\n" % i for i in range(2000)),)], "s string")
    got = own.select(F.explode(C.calls(F.col("s"), "K")).alias("a")).collect()
    assert len(got) == 2000 and got[5]["a"] == ["5", long_] and got[7]["a"] == ["7", "7"]


def test_cache_of_vectors(spark, tmp_path):
    path, asked = f"file://{tmp_path}/cache", []

    def embed(texts):
        asked.append(sorted(x["text"] for x in texts.collect()))
        return texts.select("hash", F.array(F.length("text").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))

    texts = lambda *t: spark.createDataFrame([(i, x) for i, x in enumerate(t)], "id int, text string")
    first = texts("a", "bb", "a", None, "ccc")
    assert vectors.upsert(first, path, embed, "m", buckets=8) and asked[-1] == ["", "a", "bb", "ccc"]
    assert vectors.upsert(first, path, embed, "m", buckets=8) == [] and asked[-1] == []
    before = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    touched = vectors.upsert(texts("a", "bb", "new"), path, embed, "m", buckets=8)
    assert asked[-1] == ["new"] and len(touched) == 1
    kept = [p for p in before if f"bucket={touched[0]}/" not in str(p)]
    assert kept and all(p.stat().st_mtime_ns == before[p] for p in kept)
    own = vectors.vectors(first, vectors.read(spark, path), "m").orderBy("id").collect()
    assert [x["embedding"][0] for x in own] == [1.0, 2.0, 1.0, 0.0, 3.0] and vectors.read(spark, path).count() == 5
    # another model has its own vectors; a generation that was not yet deleted counts once
    assert vectors.upsert(texts("a"), path, embed, "other", buckets=8) and asked[-1] == ["a"]
    n = vectors.read(spark, path).count()
    bucket = next(p for p in (tmp_path / "cache").iterdir() if p.name.startswith("bucket="))
    gen = next(p for p in bucket.iterdir())
    (bucket / "gen=older").mkdir()
    for f in gen.glob("*.parquet"):
        (bucket / "gen=older" / f.name).write_bytes(f.read_bytes())
    assert n == 6 and vectors.read(spark, path).count() == n
    assert not list((tmp_path / "cache").glob("_staged*"))


def test_a_failed_upsert_leaves_the_cache(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    own = spark.createDataFrame([("a",)], "text string")
    vectors.upsert(own, path, lambda t: t.select("hash", F.array(F.lit(1.0)).alias("embedding")), "m")
    with pytest.raises(Exception, match="gone"):
        vectors.upsert(own.union(spark.createDataFrame([("b",)], "text string")), path, lambda t: t.select("hash", F.raise_error(F.lit("gone")).cast("array<float>").alias("embedding")), "m")
    assert vectors.read(spark, path).count() == 1 and not list((tmp_path / "cache").glob("_staged*"))


def test_normalised(spark):
    own = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,)], "v array<float>")
    assert [x[0] for x in own.select(vectors.normalised(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None]


def test_profile_against_loops(spark):
    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice(["x", " ", None, "long value of it"]), r.choice([None, 0, -3] + list(range(1, 30)) * 2)) for _ in range(60)] + [("c", "y", 4), ("c", "y", 1 << 40), ("d", None, 1), ("d", None, 2)]
    own = spark.createDataFrame(rows, "s string, t string, n long").repartition(5)
    out = P.profile(own, "s", filled=["t"], number="n", values=["t"], expected={"a": 20, "zz": 5}, width=8)
    assert out._jdf.queryExecution().executedPlan().toString().count("ExistingRDD[s#") == 1  # the table is read once
    got = {(x["section"], x["check"], x["item"]): (x["n"], x["share"]) for x in out.collect()}
    want = {("zz", "rows", None): (0, None)}
    for s in ("a", "b", "c", "d", None):
        here = [x for x in rows if x[0] == s]
        total, numbers = len(here), [x[2] for x in here if x[2] is not None and x[2] >= 1]
        share = lambda k: (k, round(k / total, 6))
        want[s, "rows", None] = (total, round(20 / total, 6) if s == "a" else None)
        want[s, "filled", "t"] = share(sum(bool((x[1] or "").strip()) for x in here))
        want[s, "unnumbered", None] = share(total - len(numbers))
        for v in {x[1] for x in here}:
            want[s, "value:t", v if v is None or len(v) <= 8 else v[:5] + "..."] = share(sum(x[1] == v for x in here))
        last = 0
        for k in sorted(set(numbers)):
            if k > last + 1:
                want[s, "missing", str(last + 1)] = (k - last - 1, None)
            if numbers.count(k) > 1:
                want[s, "repeated", str(k)] = (numbers.count(k), None)
            last = k
    assert got == want
    assert {(x["section"], x["check"]) for x in P.failed(out).where("section in ('d', 'zz')").collect()} == {("d", "filled"), ("zz", "rows")}
    assert P.profile(own.limit(0), "s", filled=["t"], number="n", values=["t"]).count() == 0
