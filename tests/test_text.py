import html
import random

from pyspark.sql import functions as F

from attesta.functions import text


def of(spark, f, texts):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(f(F.col("t"))).collect()]


def test_unescape_equals_the_standard_library(spark):
    names = [f"&{n}" for n in html.entities.html5]
    numbers = [f"&#{n};" for n in [*range(0, 300), 8364, 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFE, 0xFFFF, 0x10000, 0x1F600, 0x10FFFF, 0x110000, 10**12]] + ["&#x41;", "&#X1f600;", "&#x0", "&#00065;", "&#65", "&#xZ;", "&#;"]
    r = random.Random(1)
    mixed = ["".join(r.choices(["&", "amp;", "&lt", "&notit;", "&amp;lt;", " x", "&nosuch;", "é", "&#8364;", ";", "\n", "&ampere", "&Amp;"], k=9)) for _ in range(300)]
    texts = [*names, *numbers, *mixed, "", "plain", "a &amp b", "&" * 50]
    got = of(spark, text.unescape, texts)
    assert [(t, g) for t, g in zip(texts, got) if g != html.unescape(t)] == []
    assert of(spark, text.unescape, [None]) == [None]


def test_wikitext(spark):
    cases = {
        "a {{b|{{c {d} }} {{e}}}} f": "a f", "[[x|y]] [[z]] [[File:a.png|thumb|see [[b|c]] d]]": "y z see c d", "'''bold''' it's ''so'' '''''x'''''": "bold it's so x",
        'p<ref name="n">q {{cite}}\n</ref> r<ref name="n" /> s<REF>t</REF>': "p r s", "<!-- {{ -->u &amp; v<br/>w &frac12;": "u & v w ½", "open {{ x": "open {{ x", "}} {{y}} z": "}} z", "": None,
    }
    assert dict(zip(cases, of(spark, text.wikitext, list(cases)))) == cases
    deep = "{{" * 200 + "x" + "}}" * 200
    many = "{{t|1}} w " * 20_000
    assert of(spark, text.wikitext, [deep + "y", many]) == ["y", " ".join(["w"] * 20_000)]
