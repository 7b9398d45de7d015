"""URL filters by redirect equivalence: rules decide urls, connected components carry blocks on to their aliases.

Urls of one address (another scheme, fragment, tracking parameter, ...) are one node; pages tie their node to the one
that their canonical link or refresh names, and redirects tie source to target. A url that a rule blocks blocks all
of its component, except for urls that a rule allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from attesta.functions.text import unescape
from attesta.llm.common import connected_components, durable, release

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: More rules than these must come as a table, which is joined instead of written into the plan.
FEW_RULES = 1000

# Query parameters that name where a reader came from, not what the page shows.
TRACKING = r"(?i)^(?:utm_[a-z]+|ref|gclid|fbclid|msclkid|mc_cid|mc_eid)(?:=|$)"

ADDRESS = r"(?s)^.*?://([^/?#]*+)([^?#]*+)(?:\?([^#]*+))?"
QUOTED = r"""\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))"""
ASIDE = r"(?is)<!--.*?-->|<(script|style|noscript)\b.*?</\1\s*>"


def host(url: Column) -> Column:
    """After the first :// up to /, ?, # or end, A-Z lowered; empty without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, ADDRESS, 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ?, # or end."""
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def _no_dots(p: Column) -> Column:
    """A path without . and .. segments."""

    def step(kept: Column, x: Column) -> Column:
        return F.when(x == ".", kept).when(x == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(x)))

    bare = F.concat_ws("/", F.aggregate(F.split(p, "/"), F.array().cast("array<string>"), step))
    end = F.when(F.rlike(p, F.lit(r"/\.\.?$")), F.lit("/")).otherwise(F.lit(""))
    return F.when(F.rlike(p, F.lit(r"(?:^|/)\.\.?(?:/|$)")), F.concat(bare, end)).otherwise(p)


def node(url: Column) -> Column:
    """What urls of one address share: host without www. and default port, path without dots, trailing slash and
    index page, other than tracking parameters in order. Null without a host."""
    of = F.regexp_replace(host(url), r"^www\.|:(?:80|443)?$", "")
    p = F.regexp_replace(_no_dots(path(url)), r"/(?:index\.html?)?$", "")
    asked = F.array_sort(F.filter(F.split(F.regexp_extract(url, ADDRESS, 3), "&"), lambda x: (x != "") & ~F.rlike(x, F.lit(TRACKING))))
    return F.when(of != "", F.concat(of, p, F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise(F.lit(""))))


def resolve(base: Column, link: Column) -> Column:
    """A link of a page as an absolute url; null for links of other kinds, such as mailto:."""
    link = F.trim(link)
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    top = F.concat(scheme, F.lit("://"), F.regexp_extract(base, ADDRESS, 1))
    folder = F.coalesce(F.nullif(F.regexp_replace(path(base), r"[^/]*$", ""), F.lit("")), F.lit("/"))
    return (
        F.when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*+://")), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(top, link))
        .when(F.rlike(link, F.lit(r"^[?#]|^$")), F.concat(top, path(base), link))
        .when(F.rlike(link, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*+:")), F.lit(None).cast("string"))
        .otherwise(F.concat(top, folder, link))
    )


def named(html: Column) -> Column:
    """array<string>: where a page says that it is found: its canonical links and refreshes, outside of comments and
    scripts, as written."""
    tags = F.regexp_extract_all(F.regexp_replace(html, ASIDE, " "), F.lit(r"(?is)<(?:link|meta)\b[^>]*+>"), F.lit(0))

    def attribute(tag: Column, name: str) -> Column:
        parts = [F.nullif(F.regexp_extract(tag, rf"(?is)(?<=[\s\"']){name}{QUOTED}", i), F.lit("")) for i in (1, 2, 3)]
        return unescape(F.coalesce(*parts))

    def target(tag: Column) -> Column:
        canonical = F.rlike(tag, F.lit(r"(?i)^<link")) & F.rlike(F.coalesce(attribute(tag, "rel"), F.lit("")), F.lit(r"(?i)(?:^|\s)canonical(?:\s|$)"))
        refresh = F.rlike(tag, F.lit(r"(?i)^<meta")) & (F.lower(F.trim(attribute(tag, "http-equiv"))) == "refresh")
        then = F.nullif(F.regexp_extract(attribute(tag, "content"), r"(?is)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*['\"]?([^'\"]*)", 1), F.lit(""))
        return F.when(canonical, attribute(tag, "href")).when(refresh, then)

    return F.filter(F.transform(tags, target), lambda x: x.isNotNull())


def ruled(rows: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """rows (host, path, ...) with `decided` struct<rule, verdict>, null where no rule fits: of the rules (verdict, host,
    path) whose host is the url's or above it and whose path begins the url's, the longest. As a table, rules are joined
    by whole host and path, for each length of path that occurs among them."""
    h, p = F.col("host"), F.col("path")
    if not isinstance(rules, DataFrame):
        if len(rules) > FEW_RULES:
            raise ValueError(f"over {FEW_RULES} rules: pass them as a table")
        decided = F.lit(None).cast("struct<rule: string, verdict: string>")
        for verdict, of, begin in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]), r)):
            fits = ((h == of) | F.endswith(h, F.lit(f".{of}"))) & F.startswith(p, F.lit(begin))
            decided = F.when(fits, F.struct(F.lit(of + begin).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(decided)
        return rows.withColumn("decided", decided)
    rules = rules.select("verdict", F.col("host").alias("_of"), F.col("path").alias("_begin")).distinct()
    lengths = sorted(r[0] for r in rules.select(F.length("_begin")).distinct().collect() if r[0] is not None)  # as many as a url has characters
    labels = F.split(h, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    begins = F.filter(F.array(*[F.when(F.length(p) >= n, F.substring(p, 1, n)) for n in lengths]).cast("array<string>"), lambda x: x.isNotNull())
    asked = rows.select("host", "path").distinct().withColumn("_of", F.explode(above)).withColumn("_begin", F.explode(begins))
    found = asked.join(rules, ["_of", "_begin"]).withColumn("_order", F.struct(F.length(F.concat("_of", "_begin")), F.length("_of"), "verdict"))
    best = F.max_by(F.struct(F.concat("_of", "_begin").alias("rule"), "verdict"), "_order")
    return rows.join(found.groupBy("host", "path").agg(best.alias("decided")), ["host", "path"], "left")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, redirects: DataFrame | None = None, *, id_col: str = "page_id") -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, host, path, rule (null without), verdict: the rule's, or
    block if the url's component holds a url that a rule blocks, in pages or not, else allow. An allow rule counts for
    its own urls and frees no aliases.

    rules: (verdict, host, path), "allow" or "block"; of equal ones both ways, block. redirects: source, target, as
    absolute urls. Null urls and those without :// have empty hosts and paths and are allowed; null html names nothing;
    null ids and repeated rows are kept; empty tables give no rows; other columns are not read.
    """
    own = pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    maybe = F.rlike("html", F.lit(r"(?i)<(?:link|meta)\b[^>]*?(?:canonical|refresh)"))
    said = own.where(maybe & F.contains("url", F.lit("://"))).select(F.col("url").alias("source"), F.explode(F.transform(named(F.col("html")), lambda x: resolve(F.col("url"), x))).alias("target"))
    if redirects is not None:
        said = said.union(redirects.select(F.col("source").cast("string"), F.col("target").cast("string")))
    said = durable(said.where("source is not null and target is not null").distinct(), "links")
    edges = said.select(node(F.col("source")).alias("a"), node(F.col("target")).alias("b")).where("a is not null and b is not null")
    parts = connected_components(edges, "aliases")

    def placed(urls: DataFrame) -> DataFrame:
        return ruled(urls.withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url"))), rules)

    # urls in links count where no page has them
    known = own.select("url").union(said.select("source")).union(said.select("target"))
    bad = placed(known).where("decided.verdict = 'block'").select(node(F.col("url")).alias("node")).where("node is not null").distinct()
    bad = durable(bad, "blocked")
    reached = bad.join(parts, "node").select("component").distinct().join(parts, "component").select("node")
    blocked = durable(bad.union(reached).distinct().select(F.col("node").alias("_blocked")), "blocked")
    release(said, parts, bad)

    # only urls that no rule decides look their node up; Spark may split a node that most pages share
    looked = placed(own.select("page_id", "url")).withColumn("node", F.when(F.col("decided").isNull(), node(F.col("url"))))
    verdict = F.coalesce(F.col("decided.verdict"), F.when(F.col("_blocked").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    out = looked.join(blocked, F.col("node") == F.col("_blocked"), "left")
    return out.select("page_id", "host", "path", F.col("decided.rule").alias("rule"), verdict.alias("verdict"))
