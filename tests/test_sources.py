import json

from pyspark.sql import functions as F

from attesta.functions import ids, parse, text
from attesta.operators import agreement
from attesta.sources import corpus, sinks


def test_text_functions(spark):
    own = spark.createDataFrame([(0, "धर्मक्षेत्रे\nकुरु ।।1.1।। ",), (1, "क ॥ १२ ॥ ख-ग‍घ। "), (2, None), (3, "अ ।18.78।")], "i int, t string").orderBy("i")
    got = own.select(text.verse(F.col("t")), text.compare_key(F.col("t"))).collect()
    assert [x[0] for x in got] == ["धर्मक्षेत्रे कुरु ॥", "क ॥ १२ ॥ ख-ग‍घ।", None, "अ ॥"]
    assert got[1][1] == "कखगघ" and got[2][1] is None
    rows = spark.createDataFrame([(0, "1.2.3", 1, 2, 3), (1, "1.2", 1, 2, 3), (2, "1.x.3", 1, 2, 3), (3, None, 1, 2, 3), (4, "1.2.4", 1, 2, 3), (5, "1.2.3", 1, None, 3)], "i int, id string, a int, b int, c int")
    assert [x[0] for x in rows.orderBy("i").select(ids.consistent(F.col("id"), F.col("a"), F.col("b"), F.col("c"))).collect()] == [True] + [False] * 5
    said = ['"a b"', '["x", {"k": "y", "n": [1, null, true]}, "z"]', "not json", None, "{}", "[" * 100_000]
    got = spark.createDataFrame(list(enumerate(said)), "i int, t string").orderBy("i").select(parse.answer_text(F.col("t"))).collect()
    assert [x[0] for x in got] == ["a b", "x y 1  True z", "not json", "", "", "[" * 100_000]
    assert [x[0] for x in spark.createDataFrame([("१०८",)], "t string").select(text.ascii_digits(F.col("t"))).collect()] == ["108"]


def test_rows_of_corpora(spark, tmp_path):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "w"), ("b", 3, "y")], "id string, ord int, text string")
    assert [x["ord"] for x in corpus.first_items(rows, 2).collect()] == [1, 2] and corpus.first_items(rows, None).count() == corpus.first_items(rows, 0).count() == 3
    assert {(x["id"], x["text"]) for x in corpus.keyed(rows, "id", "ord").collect()} == {("a", "x"), ("b", "y")}
    units = spark.createDataFrame([("u", 1, " en ", "", "en"), ("v", 2, None, "tr", "head")], "id string, ord int, text_en string, transliteration string, heading string")
    assert [x["text"] for x in corpus.retrieval_units(units).orderBy("ord").collect()] == ["en", "tr  head"]
    (tmp_path / "s.json").write_text(json.dumps({"sn1:0.1": "title", "sn1:1.2": " b ", "sn1:1.1": "a", "sn1:10.1": "z", "sn2:1.1": "c"}))
    assert {(x["number"], x["text"]) for x in corpus.segment_json(spark, str(tmp_path / "s.json")).collect()} == {(1, "a b z"), (2, "c")}
    (tmp_path / "p.json").write_text(json.dumps({"page": [{"line": {"pageno": 7, "gurmukhi": {"unicode": "g"}, "translation": {"english": {"default": "e"}}}}, {"line": {"pageno": 7, "lineno": 2}}]}))
    got = corpus.line_pages(spark, str(tmp_path / "p.json")).orderBy("at").collect()
    assert [(x["page"], x["at"], x["original"], x["transliteration"], x["text_en"]) for x in got] == [(7, 0, "g", None, "e"), (7, 1, None, None, None)]


def test_reviews_prefer_the_merged_file(spark, tmp_path):
    line = lambda who, item: json.dumps({"reviewer": who, "corpus": "c", "item_id": item, "status": "approve", "ts": 1.0}) + "\n"
    for folder, name, who in (("a", "verdicts", "merged"), ("a", "ann", "ann"), ("b", "ann", "ann"), ("b", "bob", "bob")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / f"{name}.jsonl").write_text(line(who, folder))
    (tmp_path / "empty").mkdir()
    got = {(x["item_id"], x["reviewer"]) for x in corpus.reviews(spark, f"file://{tmp_path}").collect()}
    assert got == {("a", "merged"), ("b", "ann"), ("b", "bob")}
    assert corpus.reviews(spark, f"file://{tmp_path}/empty").count() == 0


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("2.10", "é"), ("2.9", None), ("1.1", "a")], "id string, b string").withColumn("a", F.lit(1))
    assert [x[0] for x in sinks.canonical_json(rows, ["id"]).collect()][0] == '{"a":1,"b":"a","id":"1.1"}'
    path = F.transform(F.split("id", r"\."), lambda x: x.cast("int"))
    sinks.json_lines(rows, f"file://{tmp_path}/lines", path)
    lines = [json.loads(x) for p in sorted((tmp_path / "lines").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x["id"] for x in lines] == ["1.1", "2.9", "2.10"] and lines[2]["b"] == "é" and list(lines[0]) == ["a", "b", "id"]
    v = spark.createDataFrame([("c", "2", "r"), ("c", "1", "r"), ("d", "1", "s")], "corpus string, item_id string, reviewer string").withColumn("ts", F.lit(1))
    sinks.by_corpus(v, f"file://{tmp_path}/v")
    assert sorted(p.name for p in (tmp_path / "v").glob("corpus=*")) == ["corpus=c", "corpus=d"]
    assert [json.loads(x)["item_id"] for p in (tmp_path / "v" / "corpus=c").glob("*.json") for x in p.read_text().splitlines()] == ["1", "2"]
    for _ in range(2):
        sinks.append_cells(v, f"file://{tmp_path}/cells")
    assert spark.read.json(f"file://{tmp_path}/cells").count() == 6
    items = spark.createDataFrame([(1, ["b", "zz", "a"]), (2, [])], "item_id int, gold array<string>")
    units = spark.createDataFrame([("a", "A"), ("b", "B")], "id string, text string")
    got = {x["item_id"]: [tuple(s) for s in x["sources"]] for x in sinks.web_export(items, units).collect()}
    assert got == {1: [("b", "B"), ("zz", None), ("a", "A")], 2: []}
    assert [tuple(x) for x in sinks.rendered(spark.sql("select 1.23456D x, cast(null as double) y, 'n' z")).collect()] == [("1.235", "—", "n")]


def test_gold_items(spark):
    items = spark.createDataFrame([(i, "c", ["b", "a"], "factual", "low", True) for i in ("same", "edit", "none", "split", "one", "conflict")], "item_id string, corpus string, gold array<string>, question_type string, ambiguity string, answerable boolean")
    said = [("same", "approve", None, None), ("same", "approve", None, None), ("edit", "edit", ["c"], "unanswerable"), ("edit", "edit", ["c"], "unanswerable"), ("split", "reject", None, None), ("split", "approve", None, None), ("one", "approve", None, None), ("conflict", "edit", ["x"], None), ("conflict", "approve", None, None), ("orphan", "approve", None, None)]
    verdicts = spark.createDataFrame([("c", i, f"r{n}", s, n, g, t, None) for n, (i, s, g, t) in enumerate(said)], "corpus string, item_id string, reviewer string, status string, first_row long, edit_gold array<string>, edit_type string, edit_ambiguity string")
    got = {x["item_id"]: x for x in agreement.gold_items(agreement.effective(verdicts, items), items).collect()}
    assert set(got) == {"same", "edit", "split", "one", "conflict"}
    assert got["same"]["verified"] and got["same"]["gold"] == ["a", "b"] and got["same"]["answerable"] and got["same"]["disagreement"] is None
    assert got["edit"]["gold"] == ["c"] and got["edit"]["must_abstain"] and got["edit"]["answerable"] is False
    assert not got["one"]["verified"] and not got["one"]["needs_adjudication"] and got["one"]["gold"] == ["b", "a"]
    assert got["split"]["disagreement"]["reason"] == "reject_approve_split" and [x["status"] for x in got["split"]["disagreement"]["reviewer_labels"]] == ["reject", "approve"]
    assert got["conflict"]["disagreement"]["conflicting_fields"] == ["gold_citations"] and got["conflict"]["gold"] == ["b", "a"]
