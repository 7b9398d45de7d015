import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from attesta.llm import block_max
from tests.llm.conftest import WORDS, prose

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, items, k):
    own = [(i, w) for i, t in rows if (w := TERM.findall((t or "").translate(LOW)))]
    n_docs, total = len(own), sum(len(w) for _, w in own)
    df = Counter(t for _, w in own for t in set(w))
    out = []
    for item, text in dict.fromkeys(items):
        asked, found = Counter(TERM.findall((text or "").translate(LOW))), []
        for i, w in own:
            tf, m = Counter(w), 75 + (25 * len(w) * n_docs) // total
            score = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m)) for t, c in asked.items() if tf[t])
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("x")).withColumn("query", F.lit(1))


def check(spark, docs, rows, items, k=20, **more):
    key = lambda r: tuple((x is None, x) for x in r)
    got = [tuple(r) for r in block_max.search(docs(rows), benchmark(spark, items), k, **more).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, items, k), key=key)
    return got


def test_search_against_all_scores(spark, docs, monkeypatch):
    monkeypatch.setattr(block_max, "BLOCK", 8)
    r = random.Random(1)
    rows = [(i, " ".join(r.choices(WORDS, k=int(r.paretovariate(0.8)) * 3 % 400 + 1))) for i in range(400)]
    rows += [(1000 + i, rows[5][1]) for i in range(150)]  # one text very often: ties by id
    items = [(i, " ".join(r.choices(WORDS, k=r.randrange(1, 12)))) for i in range(12)] + [(90, "babla babla kone, KONE Babla!")]
    assert len(check(spark, docs, rows, items)) == 13 * 20
    check(spark, docs, rows, items, k=3, first=1)


def test_odd_rows(spark, docs, odd):
    items = [(1, "same text, WORD"), (2, None), (3, "..."), (4, "nobody said"), (None, "word"), (1, "same text, WORD"), (1, "here"), (5, "größe Größe GRÖSSE d'été 東京 x_y")]
    rows = [*odd, (7, "größe d été"), (8, "GRÖSSE 東京, 東京\u2028x"), (9, "x-y \x7f\x00 y"), (None, "word word"), (10, "Word " * 3000)]
    got = check(spark, docs, rows, items)
    assert {r[0] for r in got} == {1, 5, None}
    assert block_max.search(docs([]), benchmark(spark, items)).count() == 0
    none = block_max.search(docs(rows), benchmark(spark, []))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]
    assert block_max.search(docs([(1, None), (2, "")]), benchmark(spark, items)).count() == 0


def test_passes(spark, docs, monkeypatch):
    """More queries than fit at once are searched in several passes, with the same result."""
    monkeypatch.setattr(block_max, "ROOM", 40)
    rows = [(i, prose(40, i)) for i in range(60)]
    check(spark, docs, rows, [(i, prose(6, i)) for i in range(9)] + [(20, prose(60, 2))])


def test_blocks_below_the_threshold_are_left_out(spark, docs, monkeypatch):
    """A few documents about a rare term: after the first blocks no others are scored."""
    monkeypatch.setattr(block_max, "BLOCK", 4)
    r = random.Random(5)
    rows = [(i, " ".join(r.choices(WORDS[:20], k=30)) + (" zebra zebra zebra" if i in range(48, 56) else "")) for i in range(400)]
    rows = [(i, t + (" zebra" if i % 40 == 0 else "")) for i, t in rows]
    own = block_max._Queries([{0: 100}])
    blocks = block_max.with_maxima(block_max.forward(docs(rows).coalesce(1), {b"zebra": 0}, "doc_id", "text"), 400, 12_000)
    import numpy as np

    least = min(x["score"] for x in block_max._score(blocks, own, 8, 400, 12_000, np.zeros(1, dtype=np.int64)).collect())
    again = block_max._score(blocks, own, 8, 400, 12_000, np.array([least])).collect()
    assert {x["doc_id"] for x in again} == set(range(48, 56)) and again[0]["scored"] <= 4
