import json

import pytest
from pyspark.sql import functions as F

from attesta.functions import text as T
from attesta.operators import extract, validate
from attesta.sources import corpus, sinks
from attesta.streaming import verdicts as stream


@pytest.mark.parametrize("numbers,want", [([1, 2, 6, 7], [1, 2, 6, 7]), ([1, 2, 7], [1, 2]), ([3, 1, 2], [1, 2]), ([1, 2, 6, 7, 3, 12], [1, 2, 6, 7]), ([], [])])
def test_accept(spark, numbers, want):
    row = spark.createDataFrame([(numbers,)], "n array<long>").select(extract.accept(F.col("n")).alias("x")).first()
    assert row["x"] == want


@pytest.mark.parametrize("text,want", [("(1) a\n(2) b", [(1, "a"), (2, "b")]), ("(1) a", None), ("(1) a\n(3) b", None), ("see clause (4) of", None), (None, None)])
def test_clauses(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(extract.clauses(F.col("t")).alias("x")).first()
    assert (row["x"] and [tuple(x) for x in row["x"]]) == want


def test_html(spark):
    html = "<script>var a='</p>';</script><p>One &amp; <b>two</b></p><p> </p><p class='x'>Three&nbsp;four</p>"
    pages = spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")
    assert [r["text"] for r in extract.html_blocks(pages, "p").orderBy("pos").collect()] == ["One & two", "Three four"]


def test_tokens_of_scripts(spark):
    row = spark.createDataFrame([("Don't धर्म ab_1",)], "t string").select(T.tokens(F.col("t")).alias("x")).first()
    assert row["x"] == ["don", "t", "धर", "म", "ab_1"]


def test_align(spark):
    lines = lambda texts: spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "group string, ord long, text string")
    got = extract.align(lines(["dharmakshetre", "kurukshetre samaveta", "pandavas caiva"]), lines(["dharmakṣetre", "kurukshetre samavetaa", "xxxx", "pāṇḍavāś caiva"])).orderBy("l").collect()
    assert [(r["l"], r["r"]) for r in got] == [(0, 0), (1, 1), (2, 3)] and got[0]["ratio"] >= 0.86


def test_align_over_a_long_gap(spark):
    lines = lambda texts: spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "group string, ord long, text string")
    extra = ["zq" * (i % 5 + 1) + "wxyv" * (i % 7 + 1) for i in range(45)]
    got = extract.align(lines(["dharmakshetre", "kurukshetre samaveta", "pandavas caiva"]), lines(["dharmakshetre", *extra, "kurukshetre samavetaa", "pandavas caiva"])).orderBy("l").collect()
    assert [(r["l"], r["r"]) for r in got] == [(0, 0), (1, 46), (2, 47)]


def test_rules(spark):
    schema = "item_id string, question string, question_type string, ambiguity string, gold array<string>, near_miss array<string>, must_abstain boolean, answerable boolean, abstain_reason string"
    rows = [
        ("ok", "q", "factual", "low", ["2.47"], ["5.18", "3.19"], False, True, None), ("space", "q", "factual", "low", ["2.99"], ["5.18", "3.19"], False, True, None),
        ("overlap", "q", "factual", "low", ["2.47"], ["2.47", "5.18"], False, True, None), ("bad", "q", "unanswerable", "low", ["2.47"], [], True, True, "x"),
        ("fine", "q", "unanswerable", "low", [], [], True, False, "x"), ("type", "q", "lookup", "low", ["2.47"], [], False, True, None), ("few", "q", "factual", "low", ["2.47"], ["5.18"], False, True, None),
    ]
    items = spark.createDataFrame(rows, schema)
    units = spark.createDataFrame([(u,) for u in ("2.47", "2.48", "5.18", "3.19", "18.66")], "id string")
    got = {}
    for r in validate.issues(items, units).collect():
        got.setdefault(r["item_id"], set()).add((r["level"], r["rule"]))
    assert got == {
        "space": {("error", "gold_not_in_space")}, "overlap": {("error", "overlap")}, "bad": {("error", "abstain_with_gold"), ("error", "abstain_answerable")},
        "type": {("error", "question_type")}, "few": {("warn", "few_distractors")},
    }
    twice = items.union(items.where("item_id = 'ok'"))
    s = validate.summary(twice, validate.issues(twice, units)).first()
    assert s["n_duplicates"] == 1 and not s["ok"]


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "items.jsonl"
    p.write_text(json.dumps({"id": "x", "question": "q", "odd": 1}) + "\n\n")
    row = corpus.items(spark, str(p)).first()
    assert row["id"] == "x" and row["answerable"] is True and row["gold_citations"] == [] and json.loads(row["extra"]) == {"odd": "1"}
    b = tmp_path / "book.json"
    b.write_text(json.dumps({"name": "B", "chapters": [{"chapter": 1, "verses": [{"verse": 1, "text": "t"}]}]}))
    assert [tuple(r) for r in corpus.book_json(spark, str(b)).collect()] == [("B", 1, 1, "t")]
    m = tmp_path / "marked.txt"
    m.write_text("one\ntwo || ys_1.1 || three || ys_1.2 ||")
    assert [tuple(r) for r in corpus.marked_text(spark, str(m), r"ys_[\d.]+").collect()] == [("ys_1.1", "one two"), ("ys_1.2", "three")]
    t = tmp_path / "lines.txt"
    t.write_text("01,001.001a\tfoo<BR>\n01,001.001c\tbar<BR>\n01,001.001b*\tno<BR>\nrest\n")
    assert corpus.merge_lines(corpus.labelled_lines(spark, str(t))).first()["text"] == "foo bar"
    v = tmp_path / "v.jsonl"
    v.write_text('{"reviewer":"a","item_id":"i","ts":1700000000}\n{"reviewer":"b","item_id":"i","ts":"2024-01-01T00:00:00Z"}\n')
    assert corpus.verdicts(spark, str(v)).where("ts is null").count() == 0
    assert sinks.files(spark, str(m)).first()["bytes"] == m.stat().st_size


def test_paged_source(spark):
    from attesta.sources.paged import paged

    rows = [(i, "ab"[i % 2]) for i in range(25)]

    def fetch(equals, offset, limit):
        own = [r for r in rows if "corpus" not in equals or r[1] == equals["corpus"]]
        return own[offset : offset + limit]

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(paged("rest_rows", "n int, corpus string", lambda e: len(fetch(e, 0, 10**9)), fetch, ("corpus",)))
    assert spark.read.format("rest_rows").option("page_size", 10).load().count() == 25
    assert spark.read.format("rest_rows").option("page_size", 10).load().where("corpus = 'a'").count() == 13


def test_stream(spark, tmp_path):
    schema = "reviewer string, corpus string, item_id string, status string, ts timestamp, row_idx long"
    rows = spark.sql("select 'a' reviewer, 'c' corpus, 'i' item_id, s status, timestamp'2024-01-01 00:00:00' ts, n row_idx from values ('reject', 1L), ('approve', 2L) v(s, n)")
    rows.write.parquet(str(tmp_path / "in"))
    q = stream.upsert(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert [r["status"] for r in stream.current(spark, str(tmp_path / "out")).collect()] == ["approve"]


def test_page_queries_resolve_what_their_sql_resolves(spark, tmp_path):
    import duckdb

    from attesta.plans import extraction

    rows = [(1, "<title>a &amp;&amp;&amp</title><p>b &amp</p><li>c &eacute; &amp;lt; &ltx</li>"), (2, "<p>&copy 1 &copy; &#39;&#x27;</p>"), (3, None), (4, "<li>&nbsp;</li>")]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("html_text_clean", "html_paragraphs", "html_list_items"):
        want = con.execute(extraction.SQL[name]).fetchall()
        assert sorted(map(tuple, extraction.QUERIES[name](spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_skeletons_stay_out_of_python(spark):
    """Long lines don't pass through Python workers, and letters lose their marks as in NFD."""
    import re
    import unicodedata

    chars = "".join(chr(i) for i in range(32, 0x3000)) + "\u212a\u212b\U0001d15e"
    texts = ["Kṛṣṇa uvāca", "aammnn hh Ħh", *["x".join(chars[i : i + 40]) for i in range(0, len(chars), 40)], None]
    lines = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "ord long, text string").selectExpr("'g' as group", "ord", "text")
    got = {r["ord"]: r["sig"] for r in extract.signed(lines).collect()}
    for i, t in enumerate(texts):
        plain = re.sub("[^a-z]|h", "", unicodedata.normalize("NFD", (t or "").lower())).replace("m", "n")
        assert got[i] == re.sub(r"(.)\1+", r"\1", plain), t
    assert "Python" not in extract.signed(lines)._jdf.queryExecution().executedPlan().toString()
