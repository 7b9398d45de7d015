import random
import re

from pyspark.sql import functions as F

from attesta.llm import url_rules
from attesta.llm.queries import RULES


def pages(spark, rows):
    own = spark.createDataFrame(rows, "page_id long, url string, html string")
    return own.withColumns({c: F.lit("x") for c in ("host", "path", "node", "decided", "_blocked", "rule")})


def plain(url, rules=RULES):
    """(host, path, rule, verdict or None) by the contract's words."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host, tail = re.match(r"([^/?#]*)(.*)", rest, re.S).groups()
    host, path = re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", tail, re.S)[0]
    fits = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best and best[2]


URLS = [
    "http://a.example.org/es/1", "http://example.org/es/", "http://example.org/es", "http://notexample.org/es/2", "https://EXAMPLE.org/en/12?x=/es/#y", "http://example.org/en/2", "http://b.com/fr/1", "http://b.com/de/1", "http://com/de/",
    "http://b.com/DE/1", "http://b.com", "http://b.com?/de/", "http://b.com#/de/", "mailto:x@b.com", "b.com/de/1", "", None, "x://y://z.com/de/", "http://ÄB.com/de/é\nf", "http://x.net/de/1", "http:///de/", "://b.com/de/",
]


def test_rules(spark):
    rows = [(i, u, None) for i, u in enumerate(URLS)]
    few = {r["page_id"]: r for r in url_rules.judge(pages(spark, rows), RULES).collect()}
    table = spark.createDataFrame(RULES, "verdict string, host string, path string")
    many = {r["page_id"]: r for r in url_rules.judge(pages(spark, rows), table).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = plain(u)
        assert tuple(few[i]) == (i, host, path, rule, verdict or "allow") == tuple(many[i]), u


def test_rules_as_table_and_as_list(spark):
    r = random.Random(1)
    name = lambda: r.choice("abc")
    rules = sorted({(r.choice(("allow", "block")), ".".join(name() for _ in range(r.randrange(1, 4))), "/" + "".join(name() for _ in range(r.randrange(0, 3)))) for _ in range(60)})
    rows = [(i, f"http://{'.'.join(name() for _ in range(r.randrange(1, 5)))}/{''.join(name() for _ in range(4))}", None) for i in range(300)]
    own = url_rules.ruled(pages(spark, rows).select("page_id", url_rules.host(F.col("url")).alias("host"), url_rules.path(F.col("url")).alias("path")), rules)
    few = {x["page_id"]: x["decided"] for x in own.collect()}
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    many = {x["page_id"]: x["decided"] for x in url_rules.ruled(own.drop("decided"), table).collect()}
    assert few == many
    assert all((few[i] and (few[i]["rule"], few[i]["verdict"])) == (plain(u, rules)[2] and plain(u, rules)[2:]) for i, u, _ in rows)


def link(to):
    return f'<html><head><link rel="canonical" href="{to}"></head><body>x</body></html>'


def test_blocks_reach_aliases(spark):
    rows = [
        (1, "http://a.net/1", link("http://b.net/2")), (2, "http://b.net/2", "<meta http-equiv=Refresh content='0; URL=/3'>"), (3, "https://www.b.net/3/", None), (4, "http://b.net/3?utm_source=x#top", ""),
        (5, "http://c.net/5", link("http://d.com/de/5")),  # the blocked url is no page
        (6, "http://e.com/fr/6", link("http://c.net/5")),  # allowed itself, in a blocked component
        (7, "http://f.net/7", link("//e.com/fr/6?q=1&amp;a=2")), (8, "http://e.com/fr/6?a=2&ref=z&q=1", "<!-- " + link("http://d.com/de/5") + " -->"),
        (9, "http://g.net/x/9", link("../y/./8")), (10, "http://g.net/y/8", '<script>"' + link("http://h.net/") + '"</script>'), (11, "http://h.net/", None), (12, "http://i.net/1", link("mailto:x@d.com/de/")),
        (13, "http://s.net/13", None), (14, "http://t.net/14", None), (None, "http://t.net/14", None), (14, "http://t.net/14", None),
        (15, "http://loop.net/1", link("http://loop.net/2")), (16, "http://loop.net/2", link("http://loop.net/1")),
    ]
    redirects = spark.createDataFrame([("http://b.net/3", "http://x.com/de/9"), ("http://s.net/13", "http://t.net/14"), ("http://t.net/14", "http://u.net/"), ("http://v.com/de/", "http://u.net/index.html"), (None, "http://h.net/"), ("x", "http://h.net/")], "source string, target string")
    rows += [(100 + i, f"http://chain.net/{i}", link(f"/{i + 1}")) for i in range(40)] + [(140, "http://chain.net/40", link("http://com/de/x"))]
    got = {}
    for r in url_rules.judge(pages(spark, rows), RULES, redirects).collect():
        got.setdefault(r["page_id"], []).append(r["verdict"])
    blocked = {1, 2, 3, 4, 5, 13, 14, None, *range(100, 141)}
    assert {k for k, v in got.items() if set(v) == {"block"}} == blocked and got[14] == ["block"] * 2
    assert {k for k, v in got.items() if set(v) == {"allow"}} == {6, 7, 8, 9, 10, 11, 12, 15, 16}


def test_components_against_a_plain_search(spark):
    r = random.Random(7)
    urls = [f"http://s{i % 17}.{r.choice(('net', 'net', 'net', 'com'))}/{r.choice(('de', 'fr', 'en'))}/{i}" for i in range(150)]
    pairs = [(r.choice(urls), r.choice(urls)) for _ in range(70)]
    rows = [(i, u, link(dict(pairs)[u]) if u in dict(pairs) else None) for i, u in enumerate(urls)]
    edges = {u: set() for u in urls}
    for a, b in dict(pairs).items():
        edges[a].add(b)
        edges[b].add(a)
    reached = {u for u in urls if plain(u)[3] == "block"}
    while more := {v for u in reached for v in edges[u]} - reached:
        reached |= more
    got = {x["page_id"]: x["verdict"] for x in url_rules.judge(pages(spark, rows), RULES).collect()}
    assert got == {i: plain(u)[3] or ("block" if u in reached else "allow") for i, u in enumerate(urls)}
    assert any(got[i] == "block" for i, u in enumerate(urls) if plain(u)[3] is None)


def test_empty(spark):
    assert url_rules.judge(pages(spark, []), RULES).count() == 0
    assert url_rules.judge(pages(spark, [(1, None, None)]), []).collect()[0]["verdict"] == "allow"
