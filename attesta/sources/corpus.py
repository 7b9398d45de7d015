"""Landed files as tables: units, items, verdicts, raw sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from attesta.functions.text import retrieval_text
from attesta.sources.bundle import _at

UNIT = (
    "corpus string, id string, ord long, unit string, container string, id_path array<string>, text_en string, original string, transliteration string, "
    "translation_source string, original_source string, heading string, attrs map<string,string>, source_urls map<string,string>, retrieved string, tokens int"
)
ITEM = (
    "id string, corpus string, question string, question_type string, answerable boolean, ambiguity string, gold_citations array<string>, near_miss_distractors array<string>, "
    "gold_answer string, must_abstain boolean, abstain_reason string, answer_support array<struct<citation:string,support:string,rationale:string>>, provenance map<string,string>, "
    "adjudicated boolean, license string, version string, translations map<string,struct<question:string,gold_answer:string>>"
)
VERDICT = "reviewer string, corpus string, item_id string, status string, edits struct<gold_citations:array<string>,question_type:string,ambiguity:string>, notes string, ts timestamp, row_idx long"
#: Fields that retrieval indexes, in order; `original` is a variant.
TEXT_FIELDS = ("text_en", "transliteration", "heading")


def units(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line; blank lines are skipped."""
    return spark.read.schema(UNIT).json(path).where("id is not null")


def items(spark: SparkSession, path: str) -> DataFrame:
    """Typed items; keys that aren't known go to `extra` as JSON; missing fields get their defaults."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    known = [f.split()[0] for f in ITEM.split(", ") if " " in f]
    every = F.from_json("value", "map<string,string>")
    own = raw.select(F.from_json("value", ITEM).alias("i"), F.map_filter(every, lambda k, v: ~k.isin(*known)).alias("x"))
    own = own.select("i.*", F.when(F.size("x") > 0, F.to_json("x")).alias("extra"))
    none = F.array().cast("array<string>")
    defaults = {"answerable": F.lit(True), "must_abstain": F.lit(False), "ambiguity": F.lit("low"), "gold_citations": none, "near_miss_distractors": none, "adjudicated": F.lit(False)}
    return own.withColumns({c: F.coalesce(F.col(c), d) for c, d in defaults.items()})


def first_items(rows: DataFrame, n: int | None) -> DataFrame:
    """The first n by ord; None or 0 for all."""
    return rows.orderBy("ord").limit(n) if n else rows


def keyed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def retrieval_units(rows: DataFrame, fields=TEXT_FIELDS) -> DataFrame:
    """id, ord, text to index."""
    return rows.select("id", "ord", retrieval_text(*[F.col(f) for f in fields]).alias("text"))


def verdicts(spark: SparkSession, *paths: str) -> DataFrame:
    """Verdicts of all files; times are timestamps, whether written as epoch seconds or as text."""
    raw = spark.read.schema(VERDICT.replace("ts timestamp", "ts string").replace(", row_idx long", "")).json(list(paths))
    ts = F.coalesce(F.timestamp_seconds(F.col("ts").try_cast("double")), F.col("ts").try_cast("timestamp"))
    return raw.withColumn("ts", ts).withColumn("row_idx", F.monotonically_increasing_id())


def reviews(spark: SparkSession, root: str) -> DataFrame:
    """Verdicts of all corpora below root (root/<corpus>/*.jsonl): a corpus's verdicts.jsonl where there is one, else the
    files of its reviewers. Only names of folders and files come to the driver."""
    fs, top = _at(spark, root)
    paths = []
    for folder in sorted(str(x.getPath()) for x in fs.listStatus(top) if x.isDirectory()):
        files = sorted(str(x.getPath()) for x in fs.listStatus(_at(spark, folder)[1]) if x.getPath().getName().endswith(".jsonl"))
        paths += [f for f in files if f.endswith("/verdicts.jsonl")] or files
    return verdicts(spark, *paths) if paths else spark.createDataFrame([], VERDICT)


def book_json(spark: SparkSession, path: str) -> DataFrame:
    """{name, chapters: [{chapter, verses: [{verse, text}]}]} -> name, chapter, verse, text."""
    schema = "name string, chapters array<struct<chapter:int,verses:array<struct<verse:int,text:string>>>>"
    own = spark.read.schema(schema).json(path, multiLine=True).select("name", F.explode("chapters").alias("c"))
    return own.select("name", F.col("c.chapter").alias("chapter"), F.inline("c.verses"))


def segment_json(spark: SparkSession, path: str) -> DataFrame:
    """{"key1:2": line, ...} -> number, segment, text; header segments (below 1) are dropped, lines of a number come in
    the order of their segments."""
    own = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "text"))
    own = own.select(F.regexp_extract("key", r"(\d+):", 1).try_cast("int").alias("number"), F.regexp_extract("key", r":([\d.]+)$", 1).try_cast("double").alias("segment"), F.trim("text").alias("text"))
    own = own.where("segment >= 1").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("segment", "text"))).alias("s"))
    return own.select("number", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))


def line_pages(spark: SparkSession, path: str) -> DataFrame:
    """{page: [{line: {...}}]} -> one row per line, in reading order within its page; absent parts are null."""
    line = "id:string,pageno:int,lineno:int,gurmukhi:struct<unicode:string>,transliteration:struct<english:struct<text:string>>,translation:struct<english:struct<default:string>>"
    own = spark.read.schema(f"page array<struct<line:struct<{line}>>>").json(path, multiLine=True).select(F.posexplode("page").alias("at", "p"))
    return own.select(F.col("p.line.pageno").alias("page"), F.col("at"), F.col("p.line.gurmukhi.unicode").alias("original"), F.col("p.line.transliteration.english.text").alias("transliteration"), F.col("p.line.translation.english.default").alias("text_en"))


def labelled_lines(spark: SparkSession, path: str, pattern: str = r"^(\d+),(\d+)\.(\d+)([a-z]?)(\*?)\S*\s+(.*)$") -> DataFrame:
    """Lines `PP,SSS.NNNx text`: book, chapter, number, part, starred, text; other lines are dropped. Starred lines are
    apparatus."""
    own = spark.read.text(path).where(F.rlike("value", F.lit(pattern)))
    g = lambda i: F.regexp_extract("value", pattern, i)
    return own.select(g(1).cast("int").alias("book"), g(2).cast("int").alias("chapter"), g(3).cast("int").alias("number"), g(4).alias("part"), (g(5) == "*").alias("starred"), F.trim(F.regexp_replace(g(6), r"(?i)<br\s*/?>", "")).alias("text"))


def merge_lines(lines: DataFrame) -> DataFrame:
    """Parts of a unit joined in order, apparatus left out."""
    own = lines.where("NOT starred").groupBy("book", "chapter", "number").agg(F.array_sort(F.collect_list(F.struct("part", "text"))).alias("p"))
    return own.select("book", "chapter", "number", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("text"))


def marked_text(spark: SparkSession, path: str, marker: str) -> DataFrame:
    """key, text: what stands before each `|| KEY ||`; marker is the pattern of KEY."""
    whole = rf"(?s)(.*?)\|\|\s*({marker})\s*\|\|"
    own = spark.read.text(path, wholetext=True)
    both = F.arrays_zip(F.regexp_extract_all("value", F.lit(whole), F.lit(2)).alias("key"), F.regexp_extract_all("value", F.lit(whole), F.lit(1)).alias("text"))
    return own.select(F.inline(both)).select("key", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
