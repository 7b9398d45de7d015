"""Verdicts, agreement, adjudication, item rules, release checks and the grid."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from attesta.functions import ids, sets
from attesta.functions.text import filename
from attesta.operators import agreement as A, release, scoring, sweep, validate
from attesta.plans.model import SQL_ITEMS, SQL_LATEST, benchmark_items, load, review_items, units, verdicts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SQL_LATEST} SELECT corpus, item_id, reviewer, status, row_idx FROM latest")
def verdicts_latest(spark, sf):
    return A.latest(verdicts(spark, sf)).select("corpus", "item_id", "reviewer", "status", "row_idx")


def _labels(spark, sf, reviewers=3):
    return A.effective(A.latest(verdicts(spark, sf, reviewers)), review_items(spark, sf))


@query(f"WITH {SQL_LATEST} SELECT corpus, item_id, reviewer, status, known, gold, question_type, ambiguity FROM eff")
def effective_labels(spark, sf):
    return _labels(spark, sf).select("corpus", "item_id", "reviewer", "status", "known", F.array_join("gold", ",").alias("gold"), "question_type", "ambiguity")


def _ratings(labels, value, group=None):
    return labels.select((group if group is not None else F.lit("all")).alias("group"), F.concat_ws("/", "corpus", "item_id").alias("unit"), F.col("first_row").alias("rater"), F.col(value).alias("value"))


SQL_TWO = SQL_LATEST.replace("user_id % 3", "user_id % 2")
SQL_COHEN = """pr AS (SELECT grp, unit, max(value) FILTER (nth = 1) AS a, max(value) FILTER (nth = 2) AS b FROM (SELECT *, row_number() OVER (PARTITION BY grp, unit ORDER BY rater) AS nth, count(*) OVER (PARTITION BY grp, unit) AS m FROM rt WHERE value IS NOT NULL) WHERE m = 2 GROUP BY 1, 2),
po AS (SELECT grp, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END) AS po FROM pr GROUP BY 1),
pe AS (SELECT x.grp, sum(ca * cb) AS s FROM (SELECT grp, a AS v, count(*) AS ca FROM pr GROUP BY 1, 2) x JOIN (SELECT grp, b AS v, count(*) AS cb FROM pr GROUP BY 1, 2) y ON x.grp = y.grp AND x.v = y.v GROUP BY 1),
kp AS (SELECT po.grp, po.n, CASE WHEN po.n >= 2 AND coalesce(s, 0) / CAST(po.n * po.n AS DOUBLE) < 1 THEN (po - coalesce(s, 0) / CAST(po.n * po.n AS DOUBLE)) / (1 - coalesce(s, 0) / CAST(po.n * po.n AS DOUBLE)) END AS kappa FROM po LEFT JOIN pe ON pe.grp = po.grp)"""
SQL_FLEISS = """ra AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY grp, unit) AS m FROM rt WHERE value IS NOT NULL) WHERE m >= 2),
vc AS (SELECT grp, unit, m, value, count(*) AS c FROM ra GROUP BY ALL), pu AS (SELECT grp, unit, m, sum(c * c) AS ss FROM vc GROUP BY ALL),
pb AS (SELECT grp, count(*) AS n, sum(m) AS total, avg((ss - m) / CAST(m * (m - 1) AS DOUBLE)) AS pbar FROM pu GROUP BY 1),
pj AS (SELECT grp, sum(CAST(c * c AS DOUBLE)) AS cc, count(*) AS cats FROM (SELECT grp, value, sum(c) AS c FROM vc GROUP BY 1, 2) GROUP BY 1),
kp AS (SELECT pb.grp, CAST(n AS BIGINT) AS n, CASE WHEN cats >= 2 AND cc / CAST(total * total AS DOUBLE) < 1 THEN (pbar - cc / CAST(total * total AS DOUBLE)) / (1 - cc / CAST(total * total AS DOUBLE)) END AS kappa FROM pb JOIN pj ON pj.grp = pb.grp)"""


@query(f"WITH {SQL_TWO}, rt AS (SELECT 'all' AS grp, corpus || '/' || item_id AS unit, first_row AS rater, status AS value FROM eff), {SQL_COHEN} SELECT n, round(kappa, 6) AS kappa FROM kp")
def agreement_status_cohen(spark, sf):
    return A.cohen(_ratings(_labels(spark, sf, 2), "status")).select("n", F.round("kappa", 6).alias("kappa"))


@query(f"WITH {SQL_LATEST}, rt AS (SELECT corpus AS grp, corpus || '/' || item_id AS unit, first_row AS rater, status AS value FROM eff), {SQL_FLEISS} SELECT grp AS corpus, n, round(kappa, 6) AS kappa FROM kp")
def agreement_fleiss(spark, sf):
    return A.fleiss(_ratings(_labels(spark, sf), "status", F.col("corpus"))).select(F.col("group").alias("corpus"), "n", F.round("kappa", 6).alias("kappa"))


SQL_MASI = "CASE WHEN {0} = {1} THEN 0.0 ELSE 1.0 END"


@query(f"WITH {SQL_LATEST} SELECT a.corpus, a.item_id, a.reviewer AS reviewer_a, b.reviewer AS reviewer_b, CASE WHEN a.gold = b.gold THEN 0.0 ELSE 1.0 END::DOUBLE AS distance FROM eff a JOIN eff b ON a.corpus = b.corpus AND a.item_id = b.item_id AND a.reviewer < b.reviewer")
def masi_pairs(spark, sf):
    own = _labels(spark, sf).select("corpus", "item_id", "reviewer", "gold")
    a, b = own.withColumnsRenamed({"reviewer": "reviewer_a", "gold": "a"}), own.withColumnsRenamed({"reviewer": "reviewer_b", "gold": "b"})
    pairs = a.join(b, ["corpus", "item_id"]).where("reviewer_a < reviewer_b")
    return pairs.select("corpus", "item_id", "reviewer_a", "reviewer_b", F.round(sets.masi_distance(F.col("a"), F.col("b")), 6).alias("distance"))


SQL_ALPHA = """ra AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY grp, unit) AS m FROM rt) WHERE m >= 2),
vc AS (SELECT grp, unit, m, value, count(*) AS c FROM ra GROUP BY ALL),
ob AS (SELECT a.grp, sum(a.c * b.c * (CASE WHEN a.value = b.value THEN 0.0 ELSE 1.0 END) / CAST(a.m - 1 AS DOUBLE)) AS d FROM vc a JOIN vc b ON a.grp = b.grp AND a.unit = b.unit GROUP BY 1),
po AS (SELECT grp, value, count(*) AS c FROM ra GROUP BY 1, 2),
ex AS (SELECT a.grp, sum(a.c * b.c * (CASE WHEN a.value = b.value THEN 0.0 ELSE 1.0 END)) AS d FROM po a JOIN po b ON a.grp = b.grp GROUP BY 1),
nn AS (SELECT grp, count(*) AS n FROM ra GROUP BY 1),
al AS (SELECT nn.grp, n, CASE WHEN n >= 2 AND ex.d > 0 THEN 1 - (ob.d / CAST(n AS DOUBLE)) / (CAST(ex.d AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) END AS alpha FROM nn JOIN ob ON ob.grp = nn.grp JOIN ex ON ex.grp = nn.grp)"""


@query(f"WITH {SQL_LATEST}, rt AS (SELECT corpus AS grp, corpus || '/' || item_id AS unit, gold AS value FROM eff), {SQL_ALPHA} SELECT grp AS corpus, n, round(alpha, 6) AS alpha FROM al")
def krippendorff_alpha(spark, sf):
    own = A.masi_alpha(_ratings(_labels(spark, sf), "gold", F.col("corpus")))
    return own.select(F.col("group").alias("corpus"), "n", F.round("alpha", 6).alias("alpha"))


SQL_SETS = """rt AS (SELECT event_type AS grp, json_extract_string(props, '$.k') AS unit,
  list_sort(list_distinct(list_filter([user_id % 3, 1 + event_id % 2, 2 + (user_id + event_id) % 3], lambda x: event_id % 11 <> 0))) AS value FROM events),
ra AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY grp, unit) AS m FROM rt) WHERE m >= 2),
vc AS (SELECT grp, unit, m, value, count(*) AS c FROM ra GROUP BY ALL),
po AS (SELECT grp, value, count(*) AS c FROM ra GROUP BY ALL),
both_ AS (SELECT a.value AS x, b.value AS y, CAST(len(list_intersect(a.value, b.value)) AS DOUBLE) AS i, len(list_distinct(list_concat(a.value, b.value))) AS u
  FROM (SELECT DISTINCT value FROM po) a, (SELECT DISTINCT value FROM po) b),
di AS (SELECT x, y, CASE WHEN x = y THEN 0.0 WHEN i = least(len(x), len(y)) THEN 1 - i / u * 2 / 3 ELSE 1 - i / u / 3 END AS d FROM both_),
ob AS (SELECT a.grp, sum(a.c * b.c * di.d / (a.m - 1)) AS d FROM vc a JOIN vc b ON a.grp = b.grp AND a.unit = b.unit JOIN di ON x = a.value AND y = b.value GROUP BY 1),
ex AS (SELECT a.grp, sum(a.c * b.c * di.d) AS d FROM po a JOIN po b ON a.grp = b.grp JOIN di ON x = a.value AND y = b.value GROUP BY 1),
nn AS (SELECT grp, count(*) AS n FROM ra GROUP BY 1)"""


@query(f"WITH {SQL_SETS} SELECT nn.grp AS event_type, n, round(CASE WHEN ex.d > 0 THEN 1 - (ob.d / n) / (ex.d / (CAST(n AS DOUBLE) * (n - 1))) END, 6) AS alpha FROM nn JOIN ob ON ob.grp = nn.grp JOIN ex ON ex.grp = nn.grp")
def masi_alpha_sets(spark, sf):
    """Alpha over sets of none to three elements: each event is a rating of the item that its props name."""
    u, e = F.col("user_id"), F.col("event_id")
    value = F.filter(F.array(u % 3, 1 + e % 2, 2 + (u + e) % 3), lambda x: e % 11 != 0)
    own = load(spark, sf, "events").select(F.col("event_type").alias("group"), F.get_json_object("props", "$.k").alias("unit"), e.alias("rater"), value.alias("value"))
    return A.masi_alpha(own).select(F.col("group").alias("event_type"), "n", F.round("alpha", 6).alias("alpha"))


@query(f"WITH {SQL_LATEST}, k AS (SELECT corpus, item_id, coalesce(max(i_type), 'unknown') AS question_type, count(*) AS n FROM eff GROUP BY 1, 2) SELECT corpus, question_type, count(*) AS n_items, count(*) FILTER (n >= 2) AS n_double, CAST(max(n) AS BIGINT) AS max_raters FROM k GROUP BY GROUPING SETS ((), (corpus), (question_type))")
def agreement_grouping_sets(spark, sf):
    k = _labels(spark, sf).groupBy("corpus", "item_id").agg(F.coalesce(F.max("i_type"), F.lit("unknown")).alias("question_type"), F.count(F.lit(1)).alias("n"))
    own = k.groupingSets([[], [F.col("corpus")], [F.col("question_type")]], F.col("corpus"), F.col("question_type"))
    return own.agg(F.count(F.lit(1)).alias("n_items"), F.count_if(F.col("n") >= 2).alias("n_double"), F.max("n").alias("max_raters"))


@query("WITH q AS (SELECT doc_id AS unit, 1 AS rater, quality AS value FROM labels UNION ALL SELECT doc_id, 2, toxic FROM labels), rt AS (SELECT 'all' AS grp, unit, rater, value FROM q), " + SQL_COHEN + " SELECT n, round(kappa, 6) AS kappa FROM kp")
def two_rater_kappa(spark, sf):
    own = load(spark, sf, "labels")
    one = lambda c, i: own.select(F.lit("all").alias("group"), F.col("doc_id").alias("unit"), F.lit(i).alias("rater"), F.col(c).alias("value"))
    return A.cohen(one("quality", 1).union(one("toxic", 2))).select("n", F.round("kappa", 6).alias("kappa"))


SQL_ADJ = SQL_LATEST + """, ag AS (SELECT item_id, count(*) AS n_reviewers, count(*) FILTER (status = 'reject') AS r, count(DISTINCT gold) AS g, count(DISTINCT coalesce(question_type, '∅')) AS t, count(DISTINCT coalesce(ambiguity, '∅')) AS a,
max(gold) AS ag_gold, max(question_type) AS ag_type, max(ambiguity) AS ag_amb FROM eff WHERE known GROUP BY 1),
rs AS (SELECT ag.*, i.gold AS i_gold, i.question_type AS i_type, i.ambiguity AS i_amb, CASE WHEN n_reviewers < 2 THEN NULL WHEN r > 0 AND r < n_reviewers THEN 'reject_approve_split' WHEN r = n_reviewers THEN 'all_reject' WHEN g > 1 OR t > 1 OR a > 1 THEN 'edit_conflict' END AS reason FROM ag JOIN items i USING (item_id)),
ad AS (SELECT *, CASE WHEN n_reviewers < 2 THEN 'insufficient_reviews' WHEN reason IS NOT NULL THEN 'needs_adjudication' ELSE 'verified' END AS resolution FROM rs)"""


@query(f"WITH {SQL_ADJ} SELECT item_id, n_reviewers, resolution, reason, CASE WHEN reason = 'edit_conflict' THEN concat_ws(',', CASE WHEN g > 1 THEN 'gold_citations' END, CASE WHEN t > 1 THEN 'question_type' END, CASE WHEN a > 1 THEN 'ambiguity' END) END AS conflicts, CASE WHEN resolution = 'verified' THEN ag_gold <> i_gold OR ag_type <> i_type OR ag_amb <> i_amb END AS edited, CASE WHEN resolution = 'verified' THEN ag_gold END AS gold, resolution = 'verified' AND ag_type = 'unanswerable' AS must_abstain FROM ad")
def adjudicate_items(spark, sf):
    return A.adjudicate(_labels(spark, sf), review_items(spark, sf))


@query(f"""WITH {SQL_ADJ}, said AS (SELECT item_id, string_agg(status || ':' || gold || ':' || question_type || ':' || ambiguity, ' ' ORDER BY first_row, reviewer) AS labels FROM eff WHERE known GROUP BY 1)
SELECT item_id, CASE WHEN resolution = 'verified' THEN ag_gold ELSE i_gold END AS gold, CASE WHEN resolution = 'verified' THEN ag_type ELSE i_type END AS question_type, CASE WHEN resolution = 'verified' THEN ag_amb ELSE i_amb END AS ambiguity,
resolution = 'verified' AS verified, resolution = 'needs_adjudication' AS needs_adjudication, CASE WHEN resolution = 'verified' AND ag_type = 'unanswerable' THEN true END AS must_abstain, reason, CASE WHEN reason IS NOT NULL THEN labels END AS labels FROM ad JOIN said USING (item_id)""")
def gold_items(spark, sf):
    own = A.gold_items(_labels(spark, sf), review_items(spark, sf))
    labels = F.array_join(F.transform("disagreement.reviewer_labels", lambda x: F.concat_ws(":", x["status"], F.array_join(x["gold"], ","), x["question_type"], x["ambiguity"])), " ")
    return own.select("item_id", F.array_join("gold", ",").alias("gold"), "question_type", "ambiguity", "verified", "needs_adjudication", "must_abstain", F.col("disagreement.reason").alias("reason"), labels.alias("labels"))


@query(f"WITH {SQL_ADJ} SELECT resolution, reason, count(*) AS n FROM ad GROUP BY 1, 2")
def resolution_counts(spark, sf):
    return adjudicate_items(spark, sf).groupBy("resolution", "reason").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SQL_LATEST} SELECT item_id, count(*) AS n FROM eff WHERE NOT known GROUP BY 1")
def orphan_verdicts(spark, sf):
    return _labels(spark, sf).where("NOT known").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def _rule_items(spark, sf):
    """Benchmark items with a type and an ambiguity by id, some of which break rules."""
    i = F.col("item_id")
    own = benchmark_items(spark, sf).withColumn("question", F.col("text"))
    own = own.withColumn("question_type", F.when(i % 7 == 0, "lookup").when(F.col("must_abstain"), "unanswerable").otherwise("factual"))
    own = own.withColumn("ambiguity", F.when(i % 11 == 0, F.lit(None).cast("string")).otherwise("low"))
    own = own.withColumn("abstain_reason", F.when(i % 2 == 0, "not covered"))
    said = F.struct(F.when(i % 3 == 0, "-2").alias("citation"), F.when(i % 4 == 0, "strong").otherwise("full").alias("support"))
    own = own.withColumn("answer_support", F.when(i % 2 == 0, F.array(said)).otherwise(F.array().cast("array<struct<citation:string,support:string>>")))
    asked = F.struct(F.when(i % 8 == 0, " ").otherwise("asked").alias("question"), F.lit("a").alias("gold_answer"))
    own = own.withColumn("translations", F.when(i % 4 == 0, F.create_map(F.lit("hi"), asked)).when(i % 4 == 1, F.create_map(F.lit("xx"), asked)))
    own = own.withColumn("translations_json", F.when(i % 9 == 0, "[1]").when(i % 9 == 1, '{"hi": {}}'))
    return own.withColumn("gold", F.when(i % 5 == 0, F.concat("gold", F.array(F.lit("-1")))).otherwise(F.col("gold")))


SQL_RULES = SQL_ITEMS + """, nm AS (SELECT item_id, count(*) AS n_near FROM near GROUP BY 1),
it AS (SELECT b.item_id, b.text, ng, CASE WHEN b.item_id % 5 = 0 THEN ng + 1 ELSE ng END AS g, coalesce(n_near, 0) AS nn, ng = 0 AS must_abstain, CASE WHEN b.item_id % 7 = 0 THEN 'lookup' WHEN ng = 0 THEN 'unanswerable' ELSE 'factual' END AS qt FROM benchmark b JOIN n_gold USING (item_id) LEFT JOIN nm USING (item_id)),
iss AS (SELECT item_id, 'error' AS level, 'question_type' AS rule FROM it WHERE qt = 'lookup' UNION ALL SELECT item_id, 'error', 'ambiguity' FROM it WHERE item_id % 11 = 0
UNION ALL SELECT item_id, 'error', 'empty_question' FROM it WHERE trim(text) = '' UNION ALL SELECT item_id, 'error', 'gold_not_in_space' FROM it WHERE item_id % 5 = 0
UNION ALL SELECT item_id, 'error', 'abstain_mismatch' FROM it WHERE (qt = 'unanswerable') <> must_abstain UNION ALL SELECT item_id, 'error', 'abstain_with_gold' FROM it WHERE must_abstain AND g > 0
UNION ALL SELECT item_id, 'warn', 'no_abstain_reason' FROM it WHERE must_abstain AND item_id % 2 = 1 UNION ALL SELECT item_id, 'error', 'no_gold' FROM it WHERE NOT must_abstain AND g = 0
UNION ALL SELECT item_id, 'warn', 'few_distractors' FROM it WHERE qt = 'factual' AND nn < 2
UNION ALL SELECT DISTINCT item_id, 'error', 'gold_grammar' FROM gold WHERE CAST(id AS BIGINT) % 10 = 7
UNION ALL SELECT item_id, 'warn', 'support_not_in_gold' FROM it WHERE item_id % 6 = 0 UNION ALL SELECT item_id, 'error', 'support_label' FROM it WHERE item_id % 4 = 0
UNION ALL SELECT item_id, 'error', 'translations_kind' FROM it WHERE item_id % 9 = 0 UNION ALL SELECT item_id, 'error', 'translation_lang' FROM it WHERE item_id % 4 = 1
UNION ALL SELECT item_id, 'error', 'translation_question' FROM it WHERE item_id % 8 = 0)"""


def _parses(c):
    """A grammar that ids ending in 7 don't keep to."""
    return F.coalesce(c.try_cast("long") % 10 != 7, F.lit(False))


@query(f"WITH {SQL_RULES} SELECT * FROM iss")
def item_validation_issues(spark, sf):
    return validate.issues(_rule_items(spark, sf), units(spark, sf), _parses)


@query(f"WITH {SQL_RULES} SELECT (SELECT count(*) FROM benchmark) AS n_items, count(*) FILTER (level = 'error') AS n_errors, count(*) FILTER (level = 'warn') AS n_warnings, count(DISTINCT item_id) FILTER (level = 'error') AS n_bad_items, CAST(0 AS BIGINT) AS n_duplicates, count(*) FILTER (level = 'error') = 0 AS ok FROM iss")
def item_validation_summary(spark, sf):
    own = _rule_items(spark, sf)
    return validate.summary(own, validate.issues(own, units(spark, sf), _parses))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return validate.duplicates(load(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n_refs, count(*) FILTER (d.doc_id IS NULL) AS n_missing FROM labels l LEFT JOIN documents d USING (doc_id)")
def id_space_check(spark, sf):
    there = load(spark, sf, "documents").select("doc_id", F.lit(True).alias("there"))
    own = load(spark, sf, "labels").join(there, "doc_id", "left")
    return own.agg(F.count(F.lit(1)).alias("n_refs"), F.count_if(F.col("there").isNull()).alias("n_missing"))


SQL_TURNS = "t AS (SELECT conv_id || '.' || turn AS id, conv_id, turn FROM conversations)"


def _turns(spark, sf):
    return load(spark, sf, "conversations").select(F.concat_ws(".", "conv_id", "turn").alias("id"), "conv_id", "turn")


@query(f"WITH {SQL_TURNS} SELECT id, regexp_replace(id, '[.: ]?[0-9]+$', '') AS container FROM t")
def id_container(spark, sf):
    return _turns(spark, sf).select("id", ids.container(F.col("id")).alias("container"))


@query(f"WITH {SQL_TURNS} SELECT id, CAST(conv_id AS VARCHAR) AS prefix, turn AS n FROM t")
def id_parse(spark, sf):
    return _turns(spark, sf).select("id", ids.parse(F.col("id"), "dotted").alias("p")).select("id", "p.prefix", "p.n")


@query(f"WITH {SQL_TURNS} SELECT a.id AS a, b.id AS b FROM t a JOIN t b ON a.conv_id = b.conv_id AND abs(a.turn - b.turn) <= 1 AND a.id <> b.id")
def adjacency_pairs(spark, sf):
    own = _turns(spark, sf).select("id", ids.parse(F.col("id"), "dotted").alias("p"))
    a, b = own.select(F.col("id").alias("a"), F.col("p.prefix").alias("prefix"), F.col("p.n").alias("n")), own.select(F.col("id").alias("b"), F.col("p.prefix").alias("prefix"), F.col("p.n").alias("m"))
    return a.join(b, "prefix").where("abs(n - m) <= 1 AND a <> b").select("a", "b")


@query(f"WITH {SQL_TURNS}, c AS (SELECT conv_id, list(turn) FILTER (turn % 2 = 0) AS g, list(turn) FILTER (turn % 3 = 0) AS c FROM t GROUP BY 1), s AS (SELECT conv_id, len(g) AS ng, len(c) AS nc, len(list_filter(c, lambda x: len(list_filter(g, lambda y: abs(x - y) <= 1)) > 0)) AS mc, len(list_filter(g, lambda y: len(list_filter(c, lambda x: abs(x - y) <= 1)) > 0)) AS mg FROM c), p AS (SELECT conv_id, mc / CAST(nc AS DOUBLE) AS p, mg / CAST(ng AS DOUBLE) AS r FROM s) SELECT conv_id, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM p")
def span_f1_dotted(spark, sf):
    own = _turns(spark, sf).groupBy("conv_id").agg(F.collect_set(F.when(F.col("turn") % 2 == 0, F.col("id"))).alias("gold"), F.collect_set(F.when(F.col("turn") % 3 == 0, F.col("id"))).alias("cited"))
    own = own.select("conv_id", sets.span_prf(F.col("cited"), F.col("gold"), lambda c, g: ids.adjacent(c, g, "dotted")).alias("s"))
    return own.select("conv_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("p", "r", "f1")])


@query("SELECT doc_id, source FROM documents WHERE source IS NOT NULL AND source NOT IN ('src0', 'src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7')")
def release_allowlist_violations(spark, sf):
    return release.not_allowed(load(spark, sf, "documents"), "source", [f"src{i}" for i in range(8)]).select("doc_id", "source")


@query("SELECT doc_id, concat_ws(',', CASE WHEN contains(text, 'AKIA') THEN 'AKIA' END, CASE WHEN contains(text, 'password=') THEN 'password=' END, CASE WHEN contains(text, 'token = ') THEN 'token = ' END) AS found FROM documents WHERE contains(text, 'AKIA') OR contains(text, 'password=') OR contains(text, 'token = ')")
def forbidden_token_scan(spark, sf):
    return release.forbidden(load(spark, sf, "documents"), ["text"], ["AKIA", "password=", "token = "]).select("doc_id", "found")


@query("SELECT lang, count(*) AS units, CAST(sum(n_chars) AS BIGINT) AS chars, count(DISTINCT source) AS sources, GROUPING(lang) AS total FROM documents GROUP BY ROLLUP (lang)")
def manifest_stats(spark, sf):
    return release.manifest(load(spark, sf, "documents"))


@query("SELECT lang, sha256(string_agg(sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS version FROM documents GROUP BY 1")
def content_version(spark, sf):
    return release.version(load(spark, sf, "documents"), "lang", "doc_id", "text")


@query("""WITH p AS (SELECT lang, doc_id - doc_id % 64 AS o, sha256(string_agg(sha256(coalesce(text, '')), chr(10) ORDER BY doc_id)) AS h FROM documents GROUP BY 1, 2)
SELECT lang, count(*) AS ranges, sha256(string_agg(h, chr(10) ORDER BY o)) AS version FROM p GROUP BY 1""")
def content_version_ranges(spark, sf):
    return release.ranged_version(load(spark, sf, "documents"), "lang", "doc_id", "text", 64)


@query("SELECT lang, count(*) AS n FROM documents WHERE lang IN ('fr', 'de') AND coalesce(trim(text), '') <> '' GROUP BY 1 HAVING count(*) > 0")
def no_text_rule(spark, sf):
    return release.must_be_blank(load(spark, sf, "documents"), "lang", ["fr", "de"], "text")


@query("WITH cells AS (SELECT DISTINCT source, lang FROM documents), done AS (SELECT DISTINCT source, lang FROM documents WHERE doc_id % 3 = 0) SELECT source, lang FROM cells EXCEPT SELECT source, lang FROM done")
def sweep_remaining_cells(spark, sf):
    docs = load(spark, sf, "documents")
    return sweep.remaining(docs.select("source", "lang"), docs.where("doc_id % 3 = 0").select("source", "lang"), ["source", "lang"])


@query("WITH g AS (SELECT source AS corpus, lang AS qlang, avg(n_chars) AS v FROM documents GROUP BY 1, 2) SELECT round(avg(v) FILTER (qlang = 'en'), 6) AS en, round(avg(v) FILTER (qlang <> 'en'), 6) AS xl, round(avg(v) FILTER (qlang = 'en') - avg(v) FILTER (qlang <> 'en'), 6) AS gap, round((avg(v) FILTER (qlang = 'en') - avg(v) FILTER (qlang <> 'en')) / avg(v) FILTER (qlang = 'en'), 6) AS relative FROM g")
def sweep_summary(spark, sf):
    grid = load(spark, sf, "documents").groupBy(F.col("source").alias("corpus"), F.col("lang").alias("qlang")).agg(F.avg("n_chars").alias("value"))
    return sweep.summary(grid)


@query("SELECT DISTINCT c_name, coalesce(nullif(regexp_replace(c_name, '[^\\p{L}\\p{N}_-]', '', 'g'), ''), 'anon') AS file FROM customer")
def file_names(spark, sf):
    return load(spark, sf, "customer").select("c_name", filename(F.col("c_name")).alias("file")).distinct()


SQL_REPORT = """lb AS (SELECT 'overall' AS g, 'all' AS v, * FROM eff UNION ALL SELECT 'corpus', corpus, * FROM eff UNION ALL SELECT 'question_type', coalesce(i_type, 'unknown'), * FROM eff)"""


def _alone(sql: str, tag: str) -> str:
    """The relations of sql under names of their own."""
    return re.sub(r"\b(ra|vc|ob|po|ex|nn|al|pu|pb|pj|kp|rt)\b", lambda m: f"{tag}_{m[1]}", sql)


@query(f"""WITH {SQL_LATEST}, {SQL_REPORT}, a_rt AS (SELECT g || '|' || v AS grp, corpus || '/' || item_id AS unit, gold AS value FROM lb), {_alone(SQL_ALPHA, 'a')},
k_rt AS (SELECT g || '|' || v AS grp, corpus || '/' || item_id AS unit, first_row AS rater, status AS value FROM lb), {_alone(SQL_FLEISS, 'k')},
b AS (SELECT coalesce(x.grp, y.grp) AS grp, x.n, round(x.alpha, 6) AS alpha, round(y.kappa, 6) AS kappa FROM a_al x FULL JOIN k_kp y ON x.grp = y.grp)
SELECT string_split(grp, '|')[1] AS "grouping", string_split(grp, '|')[2] AS "group", n, alpha, CASE WHEN alpha IS NULL THEN ' ' WHEN alpha >= 0.67 THEN 'PASS' ELSE 'FAIL' END AS alpha_gate,
  kappa, CASE WHEN kappa IS NULL THEN ' ' WHEN kappa >= 0.6 THEN 'PASS' ELSE 'FAIL' END AS kappa_gate FROM b""")
def agreement_report(spark, sf):
    return A.report(_labels(spark, sf))


@query("""WITH x AS (SELECT l_orderkey AS o, l_partkey AS p, min(l_linenumber) AS ln, min(l_returnflag) AS rf, min(l_suppkey) % 5 AS sm FROM lineitem GROUP BY 1, 2),
s AS (SELECT o, p % 17 <> 0 AS there, coalesce(CASE sm WHEN 0 THEN 'none' WHEN 1 THEN 'partial' END, CASE WHEN rf <> 'N' THEN 'full' ELSE 'none' END) = 'none' AS bad FROM x WHERE ln <= 3)
SELECT o AS item_id, bool_or(NOT there) AS exist_error, bool_or(there AND bad) AS support_error, bool_or(NOT there OR bad) AS misattributed FROM s GROUP BY 1""")
def misattribution_by_support(spark, sf):
    """Orders as answers that cite parts; suppliers stand for a judge's labels, which overrule gold both ways."""
    own = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("ln"), F.min("l_returnflag").alias("rf"), (F.min("l_suppkey") % 5).alias("sm"))
    part = F.col("l_partkey").cast("string")
    label = F.when(F.col("sm") == 0, "none").when(F.col("sm") == 1, "partial")
    some = lambda c: F.collect_set(F.when(c, part))
    rows = own.groupBy(F.col("l_orderkey").alias("item_id")).agg(
        some(F.col("rf") != "N").alias("gold"), some(F.col("ln") <= 3).alias("cited"), some((F.col("ln") <= 3) & (F.col("l_partkey") % 17 != 0)).alias("existing"),
        F.map_from_entries(F.filter(F.collect_list(F.struct(part.alias("k"), label.alias("v"))), lambda x: x["v"].isNotNull())).alias("support"),
    )
    none = F.array().cast("array<string>")
    rows = rows.where(F.size("cited") > 0).withColumns({"near_miss": none, "retrieved": none, "must_abstain": F.lit(False), "abstained": F.lit(False)})
    return scoring.score_items(rows).select("item_id", "exist_error", "support_error", "misattributed")


@query("SELECT page_id, url FROM pages WHERE contains(string_split(url, '/')[-1], '82') OR len(list_intersect(string_split(url, '/')[:-2], ['fr', 'de'])) > 0")
def release_forbidden_paths(spark, sf):
    return release.forbidden_paths(load(spark, sf, "pages"), "url", ["82"], ["fr", "de"]).select("page_id", "url")


@query("WITH i AS (SELECT DISTINCT doc_id FROM labels), j AS (SELECT count(*) AS n, count(d.doc_id) AS n_known FROM i LEFT JOIN (SELECT DISTINCT doc_id FROM documents) d USING (doc_id)) SELECT n, n_known, round(n_known / CAST(n AS DOUBLE), 6) AS share, n_known / CAST(n AS DOUBLE) >= 0.95 AS ok FROM j")
def gold_quality_gate(spark, sf):
    return release.share_known(load(spark, sf, "labels"), load(spark, sf, "documents"), "doc_id")
