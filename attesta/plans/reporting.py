"""Scripts, as-of lookups, ranges, alignment anchors, and what reports say about certainty."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import script
from attesta.operators import agreement, extract, significance, spans
from attesta.operators.significance import DRAWS
from attesta.plans.model import SQL_LATEST, load, review_items, verdicts

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _sql_map(pairs) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in pairs.items()) + "}"


_V, _S = dict((a, b) for a, b, _ in script.VOWELS), dict((a, c) for a, _, c in script.VOWELS)
_LETTERS = "|".join(x.replace("|", "\\|").replace("'", "''") for x in sorted([*_V, *dict(script.CONSONANTS), *dict(script.SIGNS)], key=len, reverse=True))
SQL_DEVANAGARI = f"""m AS (SELECT {_sql_map(dict(script.CONSONANTS))} AS c, {_sql_map(_V)} AS v, {_sql_map(_S)} AS j, {_sql_map(dict(script.SIGNS))} AS s),
t AS (SELECT doc_id, regexp_extract_all(replace(replace(lower(text), 'ï', 'I'), 'ü', 'U'), '(?s){_LETTERS}|.') AS a FROM documents),
d AS (SELECT doc_id, array_to_string(list_transform(a, lambda x, i: CASE
    WHEN x IN ('I', 'U') THEN CASE WHEN i > 1 AND c[a[i - 1]] IS NOT NULL THEN CASE x WHEN 'I' THEN 'ि' ELSE 'ु' END ELSE CASE x WHEN 'I' THEN 'इ' ELSE 'उ' END END
    WHEN v[x] IS NOT NULL THEN CASE WHEN i > 1 AND c[a[i - 1]] IS NOT NULL THEN j[x] ELSE v[x] END
    ELSE CASE WHEN i > 1 AND c[a[i - 1]] IS NOT NULL THEN '्' ELSE '' END || coalesce(c[x], s[x], x) || CASE WHEN c[x] IS NOT NULL AND i = len(a) THEN '्' ELSE '' END END), '') AS devanagari FROM t, m)"""


@query(f"WITH {SQL_DEVANAGARI} SELECT doc_id, devanagari FROM d")
def iast_devanagari(spark, sf):
    """Texts as if they were transliterated Sanskrit; letters that the scheme lacks stay."""
    return load(spark, sf, "documents").select("doc_id", script.to_devanagari(F.col("text")).alias("devanagari"))


@query("WITH s AS (SELECT o_orderdate AS d, max(o_orderkey) AS last_order FROM orders GROUP BY 1), k AS (SELECT l_shipdate, l_orderkey, l_linenumber FROM lineitem) SELECT l_orderkey, l_linenumber, s.d AS since, last_order FROM k ASOF LEFT JOIN s ON l_shipdate >= s.d")
def asof_last_order(spark, sf):
    """The last order that came in by the day on which a line was shipped."""
    starts = load(spark, sf, "orders").groupBy(F.col("o_orderdate").alias("since")).agg(F.max("o_orderkey").alias("last_order"))
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return extract.asof(lines, starts, "l_shipdate", "since").drop("l_shipdate")


@query("WITH s AS (SELECT user_id, ts, max(event_id) AS signup FROM events WHERE event_type = 'signup' GROUP BY 1, 2) SELECT e.event_id, signup FROM events e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.ts >= s.ts")
def asof_last_signup(spark, sf):
    """Each event's last signup of the same user."""
    own = load(spark, sf, "events")
    starts = own.where("event_type = 'signup'").groupBy("user_id", F.col("ts").alias("since")).agg(F.max("event_id").alias("signup"))
    return extract.asof(own.select("event_id", "user_id", "ts"), starts, "ts", "since", ["user_id"]).select("event_id", "signup")


SQL_SPANS = """units AS (SELECT 'c' || (o_orderkey % 2) AS corpus, CAST(o_orderkey AS VARCHAR) AS id, o_orderkey AS ord FROM orders),
sp AS (SELECT DISTINCT l_suppkey AS item_id, 'c' || (l_orderkey % 2) AS corpus, CAST(l_orderkey AS VARCHAR) AS id_start, CAST(l_orderkey + 2 * CAST(l_quantity AS BIGINT) AS VARCHAR) AS id_end, l_returnflag AS f FROM lineitem WHERE l_returnflag IN ('A', 'R')),
lo AS (SELECT sp.*, a.ord AS lo, b.ord AS hi, coalesce(a.ord <= b.ord, false) AS valid FROM sp LEFT JOIN units a ON a.corpus = sp.corpus AND a.id = id_start LEFT JOIN units b ON b.corpus = sp.corpus AND b.id = id_end),
c AS (SELECT *, row_number() OVER () AS n FROM lo WHERE f = 'A'), g AS (SELECT *, row_number() OVER () AS n FROM lo WHERE f = 'R'),
h AS (SELECT c.item_id, c.n AS cn, g.n AS gn FROM c JOIN g ON c.item_id = g.item_id AND c.corpus = g.corpus AND c.valid AND g.valid AND c.lo - 1 <= g.hi AND g.lo <= c.hi + 1),
ht AS (SELECT item_id, count(DISTINCT cn) AS hc, count(DISTINCT gn) AS hg FROM h GROUP BY 1),
ul AS (SELECT DISTINCT item_id, corpus, f, unnest(range(lo, hi + 1)) AS u FROM lo WHERE valid),
us AS (SELECT item_id, sum(nc) AS lc, sum(ng) AS lg, sum(nc * ng) AS s FROM (SELECT item_id, corpus, u, max(CASE f WHEN 'A' THEN 1 ELSE 0 END) AS nc, max(CASE f WHEN 'R' THEN 1 ELSE 0 END) AS ng FROM ul GROUP BY 1, 2, 3) GROUP BY 1),
k AS (SELECT item_id, count(*) FILTER (f = 'A') AS n_cited, count(*) FILTER (f = 'R') AS n_gold, count(*) FILTER (NOT valid) AS n_invalid FROM lo GROUP BY 1),
pr AS (SELECT k.*, CASE WHEN n_cited > 0 THEN coalesce(hc, 0) / CAST(n_cited AS DOUBLE) WHEN n_gold = 0 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN n_gold > 0 THEN coalesce(hg, 0) / CAST(n_gold AS DOUBLE) WHEN n_cited = 0 THEN 1.0 ELSE 0.0 END AS r,
  CASE WHEN lc > 0 THEN s / CAST(lc AS DOUBLE) END AS unit_p, CASE WHEN lg > 0 THEN s / CAST(lg AS DOUBLE) END AS unit_r FROM k LEFT JOIN ht USING (item_id) LEFT JOIN us USING (item_id))"""


@query(f"WITH {SQL_SPANS} SELECT item_id, n_cited, n_gold, n_invalid, round(p, 6) AS p, round(r, 6) AS r, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round(unit_p, 6) AS unit_p, round(unit_r, 6) AS unit_r FROM pr")
def gold_span_scores(spark, sf):
    """Suppliers as items; accepted lines cite ranges of orders, returned ones are gold. Some ends are no orders."""
    order = F.col("o_orderkey")
    corpus = lambda k: F.concat(F.lit("c"), (k % 2).cast("string"))
    units = load(spark, sf, "orders").select(corpus(order).alias("corpus"), order.cast("string").alias("id"), order.alias("ord"))
    start = F.col("l_orderkey")
    lines = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("item_id"), corpus(start).alias("corpus"), start.cast("string").alias("id_start"), (start + 2 * F.col("l_quantity").cast("long")).cast("string").alias("id_end"), "l_returnflag")
    own = spans.score(lines.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'R'"), units, tol=1)
    return own.withColumns({c: F.round(c, 6) for c in ("p", "r", "f1", "unit_p", "unit_r")})



_SQUEEZED = "s"
for _letter in "abcdefgijklnopqrstuvwxyz":
    _SQUEEZED = f"regexp_replace({_SQUEEZED}, '{_letter}+', '{_letter}', 'g')"


@query("""WITH a AS (SELECT doc_id // 100 AS grp, doc_id AS ord, regexp_replace(strip_accents(lower(coalesce(text, ''))), '[^a-z]|h', '', 'g') AS s FROM documents),
q AS (SELECT grp, ord, replace(s, 'm', 'n') AS s FROM a),
z AS (SELECT grp, ord, """ + _SQUEEZED + """ AS sig FROM q),
l AS (SELECT grp, sig, min(ord) AS l FROM z WHERE sig <> '' GROUP BY 1, 2 HAVING count(*) = 1),
r AS (SELECT grp, sig, min(CASE WHEN ord % 7 = 0 THEN ord - 15 ELSE ord END) AS r FROM z WHERE sig <> '' GROUP BY 1, 2 HAVING count(*) = 1),
p AS (SELECT grp, l, r, max(r) OVER (PARTITION BY grp ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM l JOIN r USING (grp, sig))
SELECT CAST(grp AS VARCHAR) AS "group", l, r FROM p WHERE m IS NULL OR r > m""")
def alignment_anchors(spark, sf):
    """Documents in groups of a hundred against themselves, every seventh moved up."""
    own = load(spark, sf, "documents").select(F.floor(F.col("doc_id") / 100).cast("string").alias("group"), F.col("doc_id").alias("ord"), "text")
    left = extract.signed(own)
    right = left.withColumn("ord", F.when(F.col("ord") % 7 == 0, F.col("ord") - 15).otherwise(F.col("ord")))
    return extract.anchors(left, right)


_DRAW = " + ".join(f"CASE WHEN u >= {p!r} THEN 1 ELSE 0 END" for p in DRAWS)
SQL_DRAWN = f"""it AS (SELECT doc_id AS item_id, 'c' || (doc_id % 3) AS cell, CAST(quality AS DOUBLE) AS quality, CAST(toxic AS DOUBLE) AS toxic FROM labels),
rp AS (SELECT it.*, b, CASE WHEN b = 0 THEN 1 ELSE (SELECT {_DRAW} FROM (SELECT CAST('0x' || substr(md5(':' || item_id || ':' || b), 1, 8) AS BIGINT) / 4294967296.0 AS u)) END AS w FROM it, range(0, 201) t(b))"""


def _labels(spark, sf):
    own = load(spark, sf, "labels")
    return own.select(F.col("doc_id").alias("item_id"), F.concat(F.lit("c"), (F.col("doc_id") % 3).cast("string")).alias("cell"), F.col("quality").cast("double").alias("quality"), F.col("toxic").cast("double").alias("toxic"))


@query(f"""WITH {SQL_DRAWN}, v AS (SELECT cell, b, sum(w * quality) / nullif(sum(w) FILTER (quality IS NOT NULL), 0) AS quality, sum(w * toxic) / nullif(sum(w) FILTER (toxic IS NOT NULL), 0) AS toxic FROM rp WHERE w > 0 GROUP BY 1, 2),
l AS (SELECT cell, b, 'quality' AS metric, quality AS v FROM v UNION ALL SELECT cell, b, 'toxic', toxic FROM v)
SELECT cell, metric, round(max(v) FILTER (b = 0), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (b > 0), 6) AS lo, round(quantile_cont(v, 0.975) FILTER (b > 0), 6) AS hi FROM l GROUP BY 1, 2""")
def bootstrap_intervals(spark, sf):
    own = significance.intervals(_labels(spark, sf), ["quality", "toxic"], ["cell"])
    return own.withColumns({c: F.round(c, 6) for c in ("estimate", "lo", "hi")})


def _systems(spark, sf):
    """Two systems on the same items: their scores are the two labels."""
    own = _labels(spark, sf)
    return own.select("item_id", "cell", F.inline(F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).alias("score")) for s in ("quality", "toxic")])))


@query(f"""WITH {SQL_DRAWN}, v AS (SELECT cell, b, sum(w * (quality - toxic)) / nullif(sum(w), 0) AS v FROM rp WHERE w > 0 AND quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2)
SELECT cell, 'score' AS metric, round(max(v) FILTER (b = 0), 6) AS estimate, round(quantile_cont(v, 0.025) FILTER (b > 0), 6) AS lo, round(quantile_cont(v, 0.975) FILTER (b > 0), 6) AS hi,
  round(least(1.0, 2 * least(avg(CASE WHEN v <= 0 THEN 1.0 ELSE 0.0 END) FILTER (b > 0), avg(CASE WHEN v >= 0 THEN 1.0 ELSE 0.0 END) FILTER (b > 0))), 6) AS p FROM v GROUP BY 1""")
def bootstrap_paired(spark, sf):
    own = significance.paired(_systems(spark, sf), ["score"], "system", "quality", "toxic", ["cell"])
    return own.withColumns({c: F.round(c, 6) for c in ("estimate", "lo", "hi", "p")})


@query("""WITH k AS (SELECT 'c' || (doc_id % 30) AS cell, count(*) FILTER (quality = 1 AND toxic = 1) AS "both", count(*) FILTER (quality = 1 AND toxic <> 1) AS only_a, count(*) FILTER (quality <> 1 AND toxic = 1) AS only_b, count(*) FILTER (quality <> 1 AND toxic <> 1) AS neither
  FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1)
SELECT cell, "both", only_a, only_b, neither, CASE WHEN only_a + only_b > 0 THEN round(greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b), 6) END AS statistic,
  CASE WHEN only_a + only_b > 0 THEN round(least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) + (only_a + only_b) * ln(0.5))))), 6) END AS p FROM k""")
def mcnemar_labels(spark, sf):
    own = _systems(spark, sf).withColumn("cell", F.concat(F.lit("c"), (F.col("item_id") % 30).cast("string")))
    own = significance.mcnemar(own.withColumn("right", F.col("score") == 1), "system", "right", "quality", "toxic", ["cell"])
    return own.withColumns({c: F.round(c, 6) for c in ("statistic", "p")})


@query(f"""WITH {SQL_LATEST.replace("user_id % 3", "user_id % 2")}, s AS (SELECT corpus AS grp, corpus || '/' || item_id AS unit, first_row, CASE status WHEN 'reject' THEN 0 WHEN 'edit' THEN 1 ELSE 2 END AS v FROM eff),
o AS (SELECT *, row_number() OVER (PARTITION BY grp, unit ORDER BY first_row) AS i, count(*) OVER (PARTITION BY grp, unit) AS m FROM s),
p AS (SELECT grp, unit, max(v) FILTER (i = 1) AS a, max(v) FILTER (i = 2) AS b FROM o WHERE m = 2 GROUP BY 1, 2),
e AS (SELECT x.grp, sum((x.a - y.b) ** 2) / CAST(count(*) AS DOUBLE) AS e FROM p x JOIN p y ON x.grp = y.grp GROUP BY 1),
d AS (SELECT grp, count(*) AS n, avg((a - b) ** 2) AS d FROM p GROUP BY 1)
SELECT d.grp AS corpus, n, CASE WHEN e > 0 THEN round(1 - d / e, 6) END AS kappa FROM d JOIN e ON e.grp = d.grp""")
def weighted_kappa_support(spark, sf):
    """Two reviewers' verdicts as support labels: rejected none, edited partial, approved full."""
    own = agreement.effective(agreement.latest(verdicts(spark, sf, 2)), review_items(spark, sf))
    label = F.when(F.col("status") == "reject", F.lit("none")).when(F.col("status") == "edit", F.lit("partial")).otherwise(F.lit("full"))
    ratings = own.select(F.col("corpus").alias("group"), F.concat_ws("/", "corpus", "item_id").alias("unit"), F.col("first_row").alias("rater"), label.alias("value"))
    found = agreement.weighted_kappa(ratings, ("none", "partial", "full"), power=2)
    return found.select(F.col("group").alias("corpus"), "n", F.round("kappa", 6).alias("kappa"))
