import corpus_pipeline
from attesta.llm import pii
from pyspark.sql import functions as F
from tests.llm.conftest import edited, prose
from tests.llm.test_set_join import brute


def test_stages(spark, tmp_path):
    bad = ["grobnik", "slimeface"]
    item = prose(30, 999)
    rows = [(i, prose(60, i) + (f" {bad[i % 2]} {bad[0]}" if i % 6 == 0 else "")) for i in range(240)]
    rows += [(300, rows[1][1]), (301, edited(rows[2][1], 50, 1)), (302, prose(20, 5000) + " " + item + " " + prose(20, 5001)), (303, "mail me at joe@example.org " + prose(30, 5002)), (304, None), (305, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if n < 4:
            assert now.columns == docs.columns, name
        now.write.parquet(f"{tmp_path}/{n}")
        now = spark.read.parquet(f"{tmp_path}/{n}")
        kept.append({r["doc_id"]: r for r in now.collect()})
    clean = {d for d, _ in rows if not (d < 240 and d % 6 == 0)}
    assert set(kept[0]) == clean
    groups = brute([(d, t) for d, t in rows if d in clean], 5, 80)
    assert set(kept[1]) == {d for d in clean if groups[d][1] == d} and not {300, 301} & set(kept[1])
    assert set(kept[2]) == set(kept[1]) - {302}
    assert set(kept[3]) == set(kept[2]) and "[EMAIL]" in kept[3][303]["text"] and kept[3][303]["n_chars"] == len(kept[3][303]["text"])
    assert kept[3][304]["text"] is None and kept[3][7]["text"] == rows[7][1]
    assert set(kept[4]) == set(kept[3]) and {"sequence_id", "ids"} <= set(now.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == now.count()
    assert pii.KINDS[0] == "email"


def test_rows_not_ids_go(spark):
    a, b, c = prose(40, 1), prose(40, 2), prose(40, 3)
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, a), (None, prose(40, 4)), (None, prose(40, 4)), (8, None), (8, None), (9, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit("x") for n in ("spans", "row", "key", "mark", "none", "node", "group", "a.b")})
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    left = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert left == sorted([(1, a), (5, b), (7, c), (None, prose(40, 4)), (8, None), (8, None), (9, " ")], key=str)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_sanitise_keeps_other_columns(spark):
    said = "mail joe@example.org now"
    docs = spark.createDataFrame([(1, said, "kept"), (1, said, "kept"), (None, None, "kept"), (2, "", "kept")] + [(3, "mail now", "kept")] * 9, "doc_id long, text string, spans string")
    out = corpus_pipeline.sanitise(spark, docs.withColumn("a.b", F.lit(1)), "")
    assert out.columns == [*docs.columns, "a.b"]
    assert sorted((str(r["doc_id"]), str(r["text"]), r["spans"]) for r in out.collect()) == [("1", "mail [EMAIL] now", "kept")] * 2 + [("2", "", "kept")] + [("3", "mail now", "kept")] * 9 + [("None", "None", "kept")]
