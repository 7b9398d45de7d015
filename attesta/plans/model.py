"""How the tables map onto units, items, outputs and verdicts; the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def units(spark, sf):
    """Documents as units: id is the document's, corpus its language."""
    return load(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("doc_id").alias("ord"), "text", F.col("lang").alias("corpus"), "source")


def items(spark, sf):
    return load(spark, sf, "benchmark").select("item_id", "text")


def gold(spark, sf):
    """item_id, id: units that hold an item's text. Hashes of three inner words of the item and of the unit are joined,
    then the whole text is compared; items of fewer words are compared with every unit."""
    own = items(spark, sf).withColumn("w", F.split("text", r"\s+"))
    long_, short = own.where(F.size("w") >= 5), own.where(F.size("w") < 5)
    anchored = long_.select("item_id", F.col("text").alias("asked"), F.xxhash64(*[F.get("w", F.lit(i)) for i in (1, 2, 3)]).alias("anchor"))
    docs = units(spark, sf).select("id", "text", F.split("text", r"\s+").alias("w"))
    grams = docs.where(F.size("w") >= 3).select("id", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))).alias("anchor"))
    near = grams.join(anchored, "anchor").select("item_id", "id", "asked").distinct()
    found = near.join(units(spark, sf).select("id", "text"), "id").where(F.contains("text", F.col("asked"))).select("item_id", "id")
    rest = units(spark, sf).select("id", "text").join(short.select("item_id", F.col("text").alias("asked")), F.contains("text", F.col("asked"))).select("item_id", "id")
    return found.union(rest)


def benchmark_items(spark, sf):
    """Items with gold and near misses: gold as above, near misses its neighbours by at most 2 in the id space."""
    g = gold(spark, sf)
    near = g.select("item_id", F.explode(F.array(*[(F.col("id").cast("long") + d).cast("string") for d in (-2, -1, 1, 2)])).alias("id"))
    near = near.distinct().join(g, ["item_id", "id"], "left_anti").join(units(spark, sf).select("id"), "id", "left_semi")
    lists = lambda d, n: d.groupBy("item_id").agg(F.array_sort(F.collect_set("id")).alias(n))
    own = items(spark, sf).join(lists(g, "gold"), "item_id", "left").join(lists(near, "near_miss"), "item_id", "left")
    none = F.array().cast("array<string>")
    own = own.withColumn("gold", F.coalesce("gold", none)).withColumn("near_miss", F.coalesce("near_miss", none))
    return own.withColumn("answerable", F.size("gold") > 0).withColumn("must_abstain", F.size("gold") == 0)


def review_items(spark, sf):
    """Items under review: one gold id each, type and ambiguity by id."""
    i = F.col("item_id")
    types = F.array(*map(F.lit, ("factual", "retrieval", "conceptual", "interpretive")))
    return load(spark, sf, "benchmark").select(
        i.cast("string").alias("item_id"), F.concat(F.lit("c"), (i % 4).cast("string")).alias("corpus"), F.array(i.cast("string")).alias("gold"),
        F.get(types, (i % 4).cast("int")).alias("question_type"), F.lit("low").alias("ambiguity"),
    )


def verdicts(spark, sf, reviewers: int = 3):
    """Events as verdicts on items: the reviewer by user, the item by the props' k, the status by type."""
    k = F.get_json_object("props", "$.k").cast("int")
    status = F.when(F.col("event_type") == "error", "reject").when(F.col("event_type") == "signup", "edit").otherwise("approve")
    edit = F.col("event_type") == "signup"
    return load(spark, sf, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") % reviewers).cast("string")).alias("reviewer"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("corpus"), k.cast("string").alias("item_id"),
        status.alias("status"), "ts", F.col("event_id").alias("row_idx"),
        F.when(edit & (F.col("event_id") % 2 == 0), F.array(((k + 1) % 40).cast("string"))).alias("edit_gold"),
        F.when(edit & (F.col("event_id") % 3 == 0), F.lit("unanswerable")).alias("edit_type"),
        F.when(edit & (F.col("event_id") % 5 == 0), F.lit("high")).alias("edit_ambiguity"),
    )


# The same relations for the oracle.
SQL_UNITS = "units AS (SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS ord, text, lang AS corpus, source FROM documents)"
SQL_GOLD = SQL_UNITS + ", gold AS (SELECT item_id, CAST(doc_id AS VARCHAR) AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
SQL_ITEMS = SQL_GOLD + """,
near AS (SELECT DISTINCT n.item_id, n.id FROM (SELECT item_id, CAST(CAST(id AS BIGINT) + d AS VARCHAR) AS id FROM gold, (VALUES (-2), (-1), (1), (2)) v(d)) n
  JOIN units u ON u.id = n.id WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.item_id = n.item_id AND g.id = n.id)),
n_gold AS (SELECT b.item_id, count(g.id) AS ng FROM benchmark b LEFT JOIN gold g USING (item_id) GROUP BY 1)"""
TOKENS = "regexp_extract_all(lower(coalesce({0}, '')), '[\\p{{L}}\\p{{N}}_]+')"
SQL_BM25 = f"""tok AS (SELECT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents),
dl AS (SELECT doc_id, len({TOKENS.format('text')}) AS dl FROM documents),
st AS (SELECT count(*) AS n, CASE WHEN avg(dl) > 0 THEN avg(dl) ELSE 1 END AS avgdl FROM dl),
q AS (SELECT item_id, token, count(*) AS m FROM (SELECT item_id, unnest({TOKENS.format('text')}) AS token FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, token, count(*) AS tf FROM tok WHERE token IN (SELECT token FROM q) GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1),
bm AS (SELECT item_id, doc_id, round(sum(m * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM q JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id), st GROUP BY 1, 2),
ranked AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bm)"""
SQL_LATEST = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
verdicts AS (SELECT 'r' || (user_id % 3) AS reviewer, 'c' || (k % 4) AS corpus, CAST(k AS VARCHAR) AS item_id,
  CASE event_type WHEN 'error' THEN 'reject' WHEN 'signup' THEN 'edit' ELSE 'approve' END AS status, ts, event_id AS row_idx,
  CASE WHEN event_type = 'signup' AND event_id % 2 = 0 THEN CAST((k + 1) % 40 AS VARCHAR) END AS edit_gold,
  CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'unanswerable' END AS edit_type,
  CASE WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'high' END AS edit_ambiguity FROM ev),
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, min(row_idx) OVER (PARTITION BY corpus, item_id, reviewer) AS first_row,
  row_number() OVER (PARTITION BY corpus, item_id, reviewer ORDER BY ts DESC, row_idx DESC) AS rn FROM verdicts) WHERE rn = 1),
items AS (SELECT CAST(item_id AS VARCHAR) AS item_id, 'c' || (item_id % 4) AS corpus, CAST(item_id AS VARCHAR) AS gold,
  CASE item_id % 4 WHEN 0 THEN 'factual' WHEN 1 THEN 'retrieval' WHEN 2 THEN 'conceptual' ELSE 'interpretive' END AS question_type, 'low' AS ambiguity FROM benchmark),
eff AS (SELECT l.corpus, l.item_id, reviewer, status, first_row, i.item_id IS NOT NULL AS known, i.question_type AS i_type,
  CASE WHEN status = 'reject' THEN '' WHEN edit_gold IS NOT NULL THEN edit_gold ELSE coalesce(i.gold, '') END AS gold,
  coalesce(edit_type, i.question_type) AS question_type, coalesce(edit_ambiguity, i.ambiguity) AS ambiguity
  FROM latest l LEFT JOIN items i ON i.item_id = l.item_id)"""
