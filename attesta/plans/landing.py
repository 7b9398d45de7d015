"""Numbered paragraphs, labels, sources of programs, cached vectors, and what a validation report says."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import numbering, profile as P
from attesta.plans.model import load
from attesta.sources import calls as C, vectors

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""WITH RECURSIVE l AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn // 2 + CASE WHEN (conv_id + turn) % 5 = 4 THEN 20 ELSE 1 END END AS n,
  trim(CASE WHEN role = 'user' THEN text ELSE '- ' || text END) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations WHERE text IS NOT NULL),
f AS (SELECT conv_id, i, n, t, CASE WHEN n = 1 THEN 1 ELSE 0 END AS last, coalesce(n = 1, false) AS ok FROM l WHERE i = 1
  UNION ALL SELECT l.conv_id, l.i, l.n, l.t, CASE WHEN (last = 0 AND l.n = 1) OR (last > 0 AND l.n > last AND l.n <= last + 4) THEN l.n ELSE last END,
    coalesce((last = 0 AND l.n = 1) OR (last > 0 AND l.n > last AND l.n <= last + 4), false) FROM f JOIN l ON l.conv_id = f.conv_id AND l.i = f.i + 1)
SELECT conv_id, CAST(last AS BIGINT) AS n, string_agg(t, ' ' ORDER BY i) AS text FROM f WHERE last > 0 AND (ok OR n IS NULL) GROUP BY 1, 2""")
def accepted_units(spark, sf):
    """Users' turns as numbered paragraphs, some of them out of sequence, others as unnumbered ones."""
    n = F.floor(F.col("turn") / 2) + F.when((F.col("conv_id") + F.col("turn")) % 5 == 4, 20).otherwise(1)
    said = F.when(F.col("role") == "user", F.concat(n.cast("string"), F.lit(". "), "text")).otherwise(F.concat(F.lit("- "), "text"))
    return numbering.accepted_units(load(spark, sf, "conversations").select("conv_id", "turn", said.alias("text")), ["conv_id"], "turn")


_LABELS = {
    "flat": "CAST(o_orderkey AS STRING)", "two": "concat(CAST(o_custkey AS STRING), '.', CAST(o_orderkey % 50 AS STRING))",
    "six_sections_in_two": "concat(CAST(o_orderkey % 6 + 1 AS STRING), '.', CAST(o_custkey AS STRING))",
    "three_or_first": "CASE WHEN o_custkey % 2 = 0 THEN concat(CAST(o_custkey AS STRING), ',', CAST(o_orderkey % 9 AS STRING), '.', CAST(o_orderkey AS STRING)) ELSE concat(CAST(o_custkey AS STRING), '.', CAST(o_orderkey AS STRING)) END",
    "unknown": "CAST(o_orderkey AS STRING)",
}


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN (CASE WHEN o_orderkey % 6 + 1 <= 3 THEN '1.' ELSE '2.' END) || (o_orderkey % 6 + 1)
  WHEN 3 THEN CASE WHEN o_custkey % 2 = 0 THEN o_custkey || '.' || (o_orderkey % 9) ELSE o_custkey || '.1' END END AS section,
CASE o_orderkey % 5 WHEN 0 THEN o_orderkey WHEN 1 THEN o_orderkey % 50 WHEN 2 THEN o_custkey WHEN 3 THEN o_orderkey END AS number FROM orders""")
def label_keys(spark, sf):
    """Labels of four schemes, made of orders' keys, and of one that no rule knows."""
    scheme = F.get(F.array(*map(F.lit, _LABELS)), (F.col("o_orderkey") % 5).cast("int"))
    label = F.expr("CASE o_orderkey % 5 " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_LABELS.values())) + " END")
    own = load(spark, sf, "orders").select("o_orderkey", numbering.label_key(label, scheme).alias("key"))
    return own.select("o_orderkey", F.array_join("key.section", ".").alias("section"), F.col("key.number").alias("number"))


_FLAT = "regexp_replace(text, '[/|\\s]+', ' ', 'g')"


@query(f"""WITH l AS (SELECT conv_id, turn, role, trim({_FLAT}) AS t, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS u FROM conversations WHERE text IS NOT NULL),
p AS (SELECT conv_id, turn, u, 1 AS p, CASE WHEN role = 'assistant' THEN t WHEN turn % 4 = 0 THEN t || ' |' END AS t, CASE WHEN role = 'assistant' THEN '1,' || turn || '.2' END AS label FROM l
  UNION ALL SELECT conv_id, turn, u + 1, 0, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN 'rest /' END, NULL FROM l),
u AS (SELECT conv_id, u, max(label) AS label, coalesce(string_agg(t, ' ' ORDER BY turn, p) FILTER (t <> ''), '') AS t FROM p GROUP BY 1, 2)
SELECT conv_id, label, trim(regexp_replace(regexp_replace(trim(t), '^[|/]+|[|/]+$', '', 'g'), '\\s+', ' ', 'g')) AS text FROM u WHERE label IS NOT NULL""")
def marked_lines(spark, sf):
    """Assistants' turns end in a marker; users' turns are lines of verse or, without a bar, headings."""
    bare = F.trim(F.regexp_replace("text", r"[/|\s]+", " "))
    marked = F.concat(bare, F.lit(" || Ab_1,"), F.col("turn").cast("string"), F.lit(".2 || "), F.when(F.col("conv_id") % 2 == 0, "rest /").otherwise(""))
    said = F.when(F.col("role") == "assistant", marked).when(F.col("turn") % 4 == 0, F.concat(bare, F.lit(" |"))).otherwise(bare)
    return numbering.before_markers(load(spark, sf, "conversations").select("conv_id", "turn", said.alias("text")), ["conv_id"], "turn")


@query("""SELECT p_partkey, p_name || '''s "own", (new' AS name, p_type || '''' AS type, p_size > 25 AS big FROM part""")
def source_calls(spark, sf):
    """Parts written as calls in sources of fifty each, read back."""
    quote = "'''"
    line = F.concat(F.lit("# Part.make(0)\nPart.make("), F.col("p_partkey").cast("string"), F.lit(f", u{quote}"), "p_name", F.lit(f"\\'s &#9;\"own\", (new{quote},\n  '"), "p_type", F.lit("\\'', big(" + "'),', "), F.col("p_size").cast("string"), F.lit("))\n"))
    own = load(spark, sf, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("file")).agg(F.array_join(F.array_sort(F.collect_list(line)), "").alias("source"))
    own = own.select(F.explode(C.calls(F.col("source"), "Part.make")).alias("a"))
    text = lambda i: F.regexp_replace(C.source_unescape(F.get("a", F.lit(i))), r"\s+", " ")
    return own.select(F.get("a", F.lit(0)).cast("long").alias("p_partkey"), text(1).alias("name"), text(2).alias("type"), (F.regexp_extract(F.get("a", F.lit(3)), r"(\d+)\)$", 1).cast("int") > 25).alias("big"))


_HASH = "sha256('m' || chr(10) || coalesce({0}, ''))"


@query(f"""WITH u AS (SELECT CASE WHEN doc_id % 7 = 0 THEN coalesce(text || '.', '') ELSE coalesce(text, '') END AS t FROM documents), c AS (SELECT {_HASH.format('text')} AS h FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))
SELECT {_HASH.format('t')} AS hash, min(length(t)) AS n_chars FROM u WHERE {_HASH.format('t')} NOT IN (SELECT h FROM c) GROUP BY 1""")
def cache_misses(spark, sf):
    """Texts to embed: the cache has those of documents with a vector, and every seventh text has changed since."""
    docs = load(spark, sf, "documents")
    cache = docs.join(load(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id").select(vectors.content_hash("m", F.col("text")).alias("hash"), "embedding")
    changed = docs.withColumn("text", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    return vectors.missing(changed, cache, "m").select("hash", F.length("text").cast("long").alias("n_chars"))


EXPECTED = {"en": 400, "fr": 300, "xx": 3}
_PROFILE = """WITH d AS (SELECT lang AS section, doc_id, n_chars, text, source FROM documents), t AS (SELECT section, count(*) AS total FROM d GROUP BY 1),
e(section, want) AS (VALUES """ + ", ".join(f"('{k}', {v})" for k, v in EXPECTED.items()) + """),
k AS (SELECT section, CAST(n_chars AS BIGINT) AS k, count(*) AS c FROM d WHERE n_chars >= 1 GROUP BY 1, 2), g AS (SELECT *, coalesce(lag(k) OVER (PARTITION BY section ORDER BY k), 0) AS b FROM k),
x AS (SELECT section, 'filled' AS "check", 'text' AS item, count(*) FILTER (trim(text) <> '') AS n FROM d GROUP BY 1
UNION ALL SELECT section, 'filled', 'source', count(*) FILTER (trim(source) <> '') FROM d GROUP BY 1
UNION ALL SELECT section, 'value:source', CASE WHEN length(source) > 10 THEN source[:7] || '...' ELSE source END, count(*) FROM d GROUP BY 1, 3
UNION ALL SELECT section, 'unnumbered', NULL, count(*) FILTER (NOT coalesce(n_chars >= 1, false)) FROM d GROUP BY 1)
SELECT section, "check", item, n, round(n / CAST(total AS DOUBLE), 6) AS share FROM x JOIN t USING (section)
UNION ALL SELECT section, 'rows', NULL, coalesce(total, 0), round(CAST(want AS DOUBLE) / total, 6) FROM t FULL JOIN e USING (section)
UNION ALL SELECT section, 'missing', CAST(b + 1 AS VARCHAR), k - b - 1, NULL FROM g WHERE k > b + 1
UNION ALL SELECT section, 'repeated', CAST(k AS VARCHAR), c, NULL FROM k WHERE c > 1"""


@query(_PROFILE)
def validation_profile(spark, sf):
    """All checks of documents by language, lengths in the part of numbers."""
    return P.profile(load(spark, sf, "documents"), "lang", filled=["text", "source"], number="n_chars", values=["source"], expected=EXPECTED, width=10)
