"""Retrieval, readers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions.text import token_count, tokens
from attesta.operators import readers, retrieval as R, scoring
from attesta.plans.model import SQL_BM25, SQL_GOLD, SQL_ITEMS, TOKENS, benchmark_items, gold, items, load, units

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {TOKENS.format('text')} AS t FROM documents)")
def tokenize_stats(spark, sf):
    t = load(spark, sf, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"SELECT lang, count(*) AS n, CAST(sum(dl) AS BIGINT) AS total, round(avg(dl), 6) AS avgdl, CAST(count(*) FILTER (dl = 0) AS BIGINT) AS n_empty FROM (SELECT lang, len({TOKENS.format('text')}) AS dl FROM documents) GROUP BY 1")
def doc_lengths(spark, sf):
    own = R.analysed(units(spark, sf)).join(units(spark, sf).select("id", "corpus"), "id")
    return own.groupBy(F.col("corpus").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"), F.round(F.avg("dl"), 6).alias("avgdl"), F.count_if(F.col("dl") == 0).alias("n_empty"))


@query(f"WITH t AS (SELECT DISTINCT doc_id, unnest({TOKENS.format('text')}) AS token FROM documents) SELECT token, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM t GROUP BY 1")
def term_df_idf(spark, sf):
    own = R.analysed(units(spark, sf)).select(F.explode(F.array_distinct("tokens")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = F.broadcast(units(spark, sf).agg(F.count(F.lit(1)).alias("n")))  # one row
    return own.join(n).select("token", "df", F.round(R.idf(F.col("n"), F.col("df")), 6).alias("idf"))


def _bm25(spark, sf, k=5, padded=False):
    return R.bm25(units(spark, sf), items(spark, sf), k, padded=padded)


@query(f"WITH {SQL_BM25} SELECT item_id, CAST(doc_id AS VARCHAR) AS id, score, rank FROM ranked WHERE rank <= 5")
def bm25_top5(spark, sf):
    return _bm25(spark, sf).select("item_id", "id", "score", "rank")


@query(f"WITH {SQL_BM25}, al AS (SELECT b.item_id, d.doc_id, coalesce(bm.score, 0) AS score FROM benchmark b CROSS JOIN documents d LEFT JOIN bm USING (item_id, doc_id)) SELECT item_id, CAST(doc_id AS VARCHAR) AS id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM al QUALIFY rank <= 5")
def bm25_top5_padded(spark, sf):
    return _bm25(spark, sf, padded=True).select("item_id", "id", "score", "rank")


def _vectors(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


SQL_DENSE = """dn AS (SELECT q.vec_id AS item_id, d.vec_id AS id, d.label, q.label AS q_label,
  round(list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(d.embedding[i] AS DOUBLE))), 6) AS score FROM embeddings q, embeddings d WHERE {0}),
dr AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM dn)"""


@query(f"WITH {SQL_DENSE.format('q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id')} SELECT item_id, id, score, rank FROM dr WHERE rank <= 5")
def dense_top5(spark, sf):
    v = _vectors(spark, sf).drop("label")
    own = R.dense(v, v.where("id % 50 = 0").select(F.col("id").alias("item_id"), "embedding"), 6).where("item_id <> id")
    return R.top(own.drop("rank"), 5, [F.desc("score"), "id"]).select("item_id", "id", "score", F.col("rank").cast("int").alias("rank"))


@query(f"WITH {SQL_DENSE.format('q.vec_id % 50 = 0')}, h AS (SELECT item_id, count(*) FILTER (label = q_label AND rank <= 5) / 5.0 AS p5, count(*) FILTER (label = q_label AND rank <= 20) / 20.0 AS p20 FROM dr WHERE rank <= 20 GROUP BY 1) SELECT count(*) AS n, round(avg(p5), 6) AS precision_5, round(avg(p20), 6) AS precision_20 FROM h")
def dense_label_recall(spark, sf):
    v = _vectors(spark, sf)
    own = R.dense(v.drop("label"), v.where("id % 50 = 0").select(F.col("id").alias("item_id"), "embedding"), 20)
    own = own.join(v.select("id", "label"), "id").join(v.select(F.col("id").alias("item_id"), F.col("label").alias("q_label")), "item_id")
    same = F.col("label") == F.col("q_label")
    per = own.groupBy("item_id").agg((F.count_if(same & (F.col("rank") <= 5)) / 5.0).alias("p5"), (F.count_if(same) / 20.0).alias("p20"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p5"), 6).alias("precision_5"), F.round(F.avg("p20"), 6).alias("precision_20"))


def _fused(spark, sf, k, depth=50):
    """Lexical list of items over documents, dense list of the item's vector over vectors of the same ids."""
    v = _vectors(spark, sf).select(F.col("id").cast("string").alias("id"), "embedding")
    asked = items(spark, sf).select("item_id").join(_vectors(spark, sf).select(F.col("id").alias("item_id"), "embedding"), "item_id")
    return R.fuse(_bm25(spark, sf, depth), R.dense(v, asked, depth), k)


SQL_FUSED = f"""{SQL_BM25},
{SQL_DENSE.format('q.vec_id IN (SELECT item_id FROM benchmark)').replace('ORDER BY score DESC, id)', 'ORDER BY score DESC, CAST(id AS VARCHAR))')},
fu AS (SELECT item_id, id, max(a) AS a, max(b) AS b FROM (SELECT item_id, CAST(doc_id AS VARCHAR) AS id, rank AS a, NULL AS b FROM ranked WHERE rank <= 50
  UNION ALL SELECT item_id, CAST(id AS VARCHAR), NULL, rank FROM dr WHERE rank <= 50) GROUP BY 1, 2),
fs AS (SELECT *, round(coalesce(CAST(1.0 AS DOUBLE) / (60 + a), 0) + coalesce(CAST(1.0 AS DOUBLE) / (60 + b), 0), 9) AS score FROM fu),
fr AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, a NULLS LAST, b NULLS LAST) AS INTEGER) AS rank FROM fs)"""


@query(f"WITH {SQL_FUSED} SELECT item_id, id, score, rank FROM fr WHERE rank <= 5")
def rrf_fused_top5(spark, sf):
    return _fused(spark, sf, 5)


SQL_HITS = SQL_GOLD + ", hits AS (SELECT g.item_id, min(r.rank) AS hit_rank FROM gold g LEFT JOIN (SELECT item_id, id, rank FROM fr WHERE rank <= 50) r ON r.item_id = g.item_id AND r.id = g.id GROUP BY 1)"


@query(f"WITH {SQL_FUSED}, {SQL_HITS} SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN hit_rank <= {k} THEN 1.0 ELSE 0.0 END), 6) AS recall_{k}" for k in (5, 10, 20, 50)) + " FROM hits")
def rrf_recall_at_k(spark, sf):
    return R.recall_at(R.first_hit(_fused(spark, sf, 50), gold(spark, sf)))


@query(f"WITH {SQL_BM25}, fr AS (SELECT item_id, CAST(doc_id AS VARCHAR) AS id, rank FROM ranked), {SQL_HITS} SELECT count(hit_rank) AS n_found, list_sort(list(hit_rank) FILTER (hit_rank IS NOT NULL))[CAST(count(hit_rank) // 2 AS BIGINT) + 1] AS median_rank FROM hits")
def gold_first_rank_median(spark, sf):
    return R.upper_median(R.first_hit(_bm25(spark, sf, 50), gold(spark, sf)))


@query(f"""WITH {SQL_BM25}, ov AS (SELECT r.item_id, r.doc_id, r.rank AS before, round(len(list_intersect(list_distinct({TOKENS.format('b.text')}), {TOKENS.format('d.text')})) / CAST(len(list_distinct({TOKENS.format('b.text')})) AS DOUBLE), 6) AS score
FROM ranked r JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id) WHERE r.rank <= 50)
SELECT item_id, CAST(doc_id AS VARCHAR) AS id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, before) AS INTEGER) AS rank FROM ov QUALIFY rank <= 5""")
def rerank_overlap_top5(spark, sf):
    return R.rerank(_bm25(spark, sf, 50), items(spark, sf), units(spark, sf), R.overlap_score, 5)


def _near(c, g):
    return (c == g) | F.coalesce(F.abs(c.try_cast("long") - g.try_cast("long")) <= 1, F.lit(False))


def _scored(spark, sf, cite: int = 1, depth: int = 5, least: float = 12.0):
    """Scores of a reader that cites the first results and abstains where the best scores under `least`."""
    ranked = _bm25(spark, sf, depth)
    rows = benchmark_items(spark, sf).join(readers.first_cites(ranked, cite, least), "item_id", "left")
    none = F.array().cast("array<string>")
    rows = rows.withColumns({c: F.coalesce(c, none) for c in ("cited", "retrieved")}).withColumn("abstained", F.size("cited") == 0)
    return scoring.score_items(scoring.existing(rows, units(spark, sf)), _near)


def _sql_scored(cite: int) -> str:
    return f"""{SQL_BM25}, {SQL_ITEMS},
best AS (SELECT item_id FROM ranked WHERE rank = 1 AND score >= 12.0),
cites AS (SELECT item_id, CAST(doc_id AS VARCHAR) AS id FROM ranked JOIN best USING (item_id) WHERE rank <= {cite}),
cc AS (SELECT b.item_id, count(c.id) AS n_cited, count(g.id) AS hit, count(n.id) AS near_missed FROM benchmark b LEFT JOIN cites c USING (item_id) LEFT JOIN gold g ON g.item_id = c.item_id AND g.id = c.id LEFT JOIN near n ON n.item_id = c.item_id AND n.id = c.id GROUP BY 1),
sc AS (SELECT cc.item_id, count(DISTINCT c.id) FILTER (abs(CAST(c.id AS BIGINT) - CAST(g.id AS BIGINT)) <= 1) AS sc, count(DISTINCT g.id) FILTER (abs(CAST(c.id AS BIGINT) - CAST(g.id AS BIGINT)) <= 1) AS sg FROM cc LEFT JOIN cites c USING (item_id) LEFT JOIN gold g ON g.item_id = c.item_id GROUP BY 1),
s AS (SELECT cc.item_id, n_cited, ng, hit, near_missed, n_cited - hit AS wrong, ng = 0 AS must_abstain, ng > 0 AS answerable, n_cited = 0 AS abstained,
  CASE WHEN n_cited > 0 THEN hit / CAST(n_cited AS DOUBLE) WHEN ng = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN ng > 0 THEN hit / CAST(ng AS DOUBLE) WHEN n_cited = 0 THEN 1.0 ELSE 0.0 END AS r,
  CASE WHEN n_cited > 0 THEN sc / CAST(n_cited AS DOUBLE) WHEN ng = 0 THEN 1.0 ELSE 0.0 END AS sp, CASE WHEN ng > 0 THEN sg / CAST(ng AS DOUBLE) WHEN n_cited = 0 THEN 1.0 ELSE 0.0 END AS sr
  FROM cc JOIN n_gold USING (item_id) JOIN sc USING (item_id)),
z AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1, CASE WHEN sp + sr > 0 THEN 2 * sp * sr / (sp + sr) ELSE 0.0 END AS span_f1, wrong > 0 AS misattributed FROM s)"""


SQL_METRICS = """count(*) AS n, count(*) FILTER (n_cited > 0) AS n_citing, count(*) FILTER (must_abstain) AS n_unanswerable,
round(avg(CASE WHEN n_cited > 0 THEN 1.0 END), 6) AS cer, round(avg(CASE WHEN n_cited > 0 THEN 1.0 END), 6) AS cg, round(avg(f1), 6) AS f1_exact, round(avg(span_f1), 6) AS f1_span,
round(avg(CASE WHEN n_cited > 0 THEN CAST(misattributed AS DOUBLE) END), 6) AS mar, round(avg(CASE WHEN n_cited > 0 THEN 0.0 END), 6) AS mar_exist, round(avg(CASE WHEN n_cited > 0 THEN CAST(misattributed AS DOUBLE) END), 6) AS mar_support,
round(sum(near_missed) / nullif(CAST(sum(wrong) AS DOUBLE), 0), 6) AS nmr, round(avg(CASE WHEN must_abstain THEN CAST(abstained AS DOUBLE) END), 6) AS abstention_accuracy,
round(avg(CASE WHEN must_abstain THEN CAST(n_cited > 0 AS DOUBLE) END), 6) AS over_citation_rate, round(avg(CASE WHEN NOT must_abstain THEN CAST(abstained AS DOUBLE) END), 6) AS wrong_abstention_rate"""
SQL_ITEM = "SELECT item_id, n_cited, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1, round(span_f1, 6) AS span_f1, misattributed, near_missed, wrong FROM z"


def _item_columns(scored):
    r6 = [F.round(c, 6).alias(c) for c in ("p", "r", "f1", "span_f1")]
    return scored.select("item_id", "n_cited", *r6, "misattributed", "near_missed", "wrong")


@query(f"WITH {_sql_scored(1)} {SQL_ITEM}")
def reader_top1_scores(spark, sf):
    return _item_columns(_scored(spark, sf))


@query(f"WITH {_sql_scored(3)} {SQL_ITEM}")
def reader_topk_scores(spark, sf):
    return _item_columns(_scored(spark, sf, 3))


@query(f"WITH {_sql_scored(1)} SELECT {SQL_METRICS} FROM z")
def eval_aggregate(spark, sf):
    return _scored(spark, sf).agg(*scoring.metrics())


@query(f"WITH {_sql_scored(3)} SELECT item_id % 4 AS part, {SQL_METRICS} FROM z GROUP BY 1")
def eval_by_part(spark, sf):
    return _scored(spark, sf, 3).groupBy((F.col("item_id") % 4).alias("part")).agg(*scoring.metrics())


@query(f"WITH {_sql_scored(5)} SELECT CAST(sum(near_missed) AS BIGINT) AS near_missed, CAST(sum(wrong) AS BIGINT) AS wrong, round(sum(near_missed) / nullif(CAST(sum(wrong) AS DOUBLE), 0), 6) AS nmr FROM z")
def near_miss_rate(spark, sf):
    return _scored(spark, sf, 5).agg(F.sum("near_missed").alias("near_missed"), F.sum("wrong").alias("wrong"), F.round(F.try_divide(F.sum("near_missed"), F.sum("wrong")), 6).alias("nmr"))


@query(f"WITH {_sql_scored(1)} SELECT count(*) FILTER (must_abstain) AS n_unanswerable, round(avg(CASE WHEN must_abstain THEN CAST(abstained AS DOUBLE) END), 6) AS abstention_accuracy, round(avg(CASE WHEN must_abstain THEN CAST(n_cited > 0 AS DOUBLE) END), 6) AS over_citation_rate, round(avg(CASE WHEN NOT must_abstain THEN CAST(abstained AS DOUBLE) END), 6) AS wrong_abstention_rate FROM z")
def abstention_metrics(spark, sf):
    return _scored(spark, sf).agg(*scoring.metrics()).select("n_unanswerable", "abstention_accuracy", "over_citation_rate", "wrong_abstention_rate")


@query(f"WITH {SQL_BM25}, {SQL_ITEMS} SELECT u.source, count(*) AS n_cites, count(*) FILTER (g.id IS NULL) AS n_wrong, round(avg(CASE WHEN g.id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS wrong_rate FROM ranked r JOIN units u ON u.ord = r.doc_id LEFT JOIN gold g ON g.item_id = r.item_id AND g.id = u.id WHERE r.rank <= 5 GROUP BY 1")
def misattribution_by_source(spark, sf):
    cites = _bm25(spark, sf).select("item_id", "id").join(units(spark, sf).select("id", "source"), "id")
    own = cites.join(gold(spark, sf).withColumn("hit", F.lit(True)), ["item_id", "id"], "left")
    return own.groupBy("source").agg(F.count(F.lit(1)).alias("n_cites"), F.count_if(F.col("hit").isNull()).alias("n_wrong"), F.round(F.avg(F.col("hit").isNull().cast("double")), 6).alias("wrong_rate"))


SQL_JUDGE = f"""{SQL_BM25}, {SQL_GOLD}, judged AS (SELECT r.item_id, CAST(r.doc_id AS VARCHAR) AS id, r.rank, g.id IS NOT NULL AS grounded FROM ranked r LEFT JOIN gold g ON g.item_id = r.item_id AND g.id = CAST(r.doc_id AS VARCHAR) WHERE r.rank <= 10)"""


def _judged(spark, sf):
    """A judge's table over candidates: here the gold stands in for a model."""
    own = _bm25(spark, sf, 10).select("item_id", "id", "rank")
    return own.join(gold(spark, sf).withColumn("grounded", F.lit(True)), ["item_id", "id"], "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


@query(f"WITH {SQL_JUDGE}, v AS (SELECT item_id, string_agg(id, ',' ORDER BY rank) FILTER (grounded AND rank <= 3) AS kept, arg_min(id, rank) FILTER (grounded) AS best FROM judged GROUP BY 1) SELECT b.item_id, coalesce(kept, best, '') AS cited, kept IS NULL AND best IS NULL AS abstained, kept IS NULL AND best IS NOT NULL AS repaired FROM benchmark b LEFT JOIN v USING (item_id)")
def verify_repair(spark, sf):
    return readers.verify_repair(items(spark, sf), _judged(spark, sf), 3)


@query(f"WITH {SQL_JUDGE}, v AS (SELECT item_id, arg_min(id, rank) FILTER (grounded) AS pick, arg_min(id, rank) AS base FROM judged GROUP BY 1) SELECT b.item_id, coalesce(pick, '') AS cited, pick IS NULL AS abstained, pick IS NOT NULL AND pick <> base AS repaired FROM benchmark b LEFT JOIN v USING (item_id)")
def joint_select(spark, sf):
    picks = _judged(spark, sf).where("grounded").groupBy("item_id").agg(F.min_by("id", "rank").alias("best_id"))
    return readers.joint_select(items(spark, sf), _judged(spark, sf), picks)


@query(f"WITH {SQL_JUDGE}, v AS (SELECT item_id, count(*) FILTER (rank <= 8) AS kept, arg_min(id, rank) FILTER (grounded AND rank <= 8) AS pick FROM judged GROUP BY 1) SELECT b.item_id, coalesce(pick, '') AS cited, pick IS NULL AS abstained, coalesce(kept, 0) AS n_kept FROM benchmark b LEFT JOIN v USING (item_id)")
def self_reflect(spark, sf):
    own = _judged(spark, sf)
    judged = own.select("item_id", "id", "rank", F.when(F.col("rank") <= 8, "correct").otherwise("incorrect").alias("relevance"), F.when(F.col("grounded"), "fully").otherwise("no").alias("support"))
    return readers.self_reflect(items(spark, sf), judged)


@query(f"WITH {SQL_JUDGE}, d AS (SELECT g.item_id, bool_or(j.id IS NOT NULL) AS retrieved, bool_or(j.rank = 1) AS base_hit FROM gold g LEFT JOIN judged j ON j.item_id = g.item_id AND j.id = g.id GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (NOT retrieved) AS not_retrieved, count(*) FILTER (retrieved AND NOT coalesce(base_hit, false)) AS lost_gold, count(*) FILTER (coalesce(base_hit, false)) AS base_cited_gold FROM d")
def diagnose_counters(spark, sf):
    j = _judged(spark, sf).select("item_id", "id", "rank")
    own = gold(spark, sf).join(j, ["item_id", "id"], "left").groupBy("item_id").agg(F.bool_or(F.col("rank").isNotNull()).alias("retrieved"), F.coalesce(F.bool_or(F.col("rank") == 1), F.lit(False)).alias("base"))
    return own.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("retrieved")).alias("not_retrieved"), F.count_if(F.col("retrieved") & ~F.col("base")).alias("lost_gold"), F.count_if("base").alias("base_cited_gold"))


@query("SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS BIGINT) AS tokens FROM documents")
def unit_tokens(spark, sf):
    return load(spark, sf, "documents").select("doc_id", token_count(F.col("text")).cast("long").alias("tokens"))


@query(f"""WITH {SQL_FUSED}, c AS (SELECT f.item_id, f.id, f.rank AS before, {TOKENS.format('b.text[:4000]')} AS q, {TOKENS.format('d.text[:4000]')} AS t FROM fr f JOIN benchmark b ON b.item_id = f.item_id LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = f.id WHERE f.rank <= 50),
s AS (SELECT item_id, id, before, CASE WHEN len(q) > 0 THEN round(len(list_intersect(list_distinct(q), t)) / CAST(len(list_distinct(q)) AS DOUBLE), 6) ELSE 0.0 END AS score FROM c)
SELECT item_id, id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, before) AS INTEGER) AS rank FROM s QUALIFY rank <= 5""")
def recall_then_rerank(spark, sf):
    """Both lists at depth 50, fused, then reranked over texts cut at 4,000 characters."""
    return R.rerank(_fused(spark, sf, 50), items(spark, sf), units(spark, sf), R.overlap_score, 5, limit=4000)
