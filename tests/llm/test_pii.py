import hashlib
import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from attesta.llm import pii
from tests.llm.conftest import prose

PLAIN = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(x) <= 255 for x in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 9 <= len(digits(v)) <= 15),
]


def digits(v):
    return re.sub("[^0-9]", "", v)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out, n = [], []
    for kind, pattern, ok in PLAIN:
        found = [m for m in re.finditer(pattern, text or "") if ok(m[0])]
        n.append(len(found))
        out += [f"{kind}:{m.start()}:{m.end()}" for m in found]
    return (*n, hashlib.sha256(",".join(out).encode()).hexdigest())


TEXTS = [
    None, "", "no data", "a@b.com_c@d.org, x@y x@y.z. 😀 é@q.de é q@r.s", "1.2.3.4.5 999.1.1.1 00255.0.0.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111",
    "+1 (555) 010-9999 +44 20 7946 0958. +12 +1234567 ++1 555 0100 99", "@" * 50 + "a" * 500 + "@", "😀" * 9 + "mail me: jo.e+x@ex-ample.co.uk 10.0.0.1", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9 0 1",
    " ".join(f"u{i}@h{i}.com" for i in range(300)), "1.2.3.4" * 40,
]


def test_base_against_plain_patterns(docs):
    out = pii.digest(pii.analyse(docs(list(enumerate(TEXTS))).select("doc_id", "text"))).collect()
    for r in out:
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == base(TEXTS[r["doc_id"]]), TEXTS[r["doc_id"]]


def test_terms_and_sanitised_text(docs):
    rows = [(i, f"Zanthorp {prose(30, i)} contact zanthorp or li at z@corp.org please {prose(30, 900 + i)}") for i in range(4)]
    rows += [(10 + i, f"{prose(60, 50 + i)} please contact") for i in range(40)]
    out = pii.analyse(docs(rows)).withColumn("clean", pii.sanitise(F.col("text"), F.col("spans")))
    got = {r["doc_id"]: r for r in out.collect()}
    words = {rows[0][1][s["start"] : s["end"]] for s in got[0]["spans"] if s["kind"] == 4}
    assert {"Zanthorp", "zanthorp", "li"} <= words and "please" not in words  # far from the address as well
    assert "[EMAIL]" in got[0]["clean"] and "zanthorp" not in got[0]["clean"].lower() and "z@corp" not in got[0]["clean"]
    assert got[12]["clean"] == rows[6][1] and got[0]["lang"] == "en"


def test_overlaps(spark):
    spans = "array(named_struct('kind', 1, 'start', 2, 'end', 6, 'value', '', 'removed', false), named_struct('kind', 2, 'start', 4, 'end', 8, 'value', '', 'removed', false), named_struct('kind', 4, 'start', 9, 'end', 10, 'value', '', 'removed', true))"
    assert spark.sql(f"select '0123456789ab' t, {spans} s").select(pii.sanitise(F.col("t"), F.col("s")).alias("x")).first()["x"] == "01[IP]8ab"


def test_odd_rows(docs, odd):
    out = pii.analyse(docs(odd))
    assert out.count() == len(odd) and "node" in out.columns
    assert pii.analyse(docs([])).count() == 0


def told_by_loops(rows):
    """{(entity, word): share} by plain loops over all different texts."""
    word, address = re.compile(r"[^\W\d_]{2,}"), re.compile(PLAIN[0][1])
    texts = sorted({t for _, t in rows})
    holds = [{m[0] for m in address.finditer(t)} for t in texts]
    n_entity, n_word, beside, within = Counter(e for es in holds for e in es), Counter(), Counter(), Counter()
    around = {}
    for t, es in zip(texts, holds):
        own = word.findall(t)
        n_word.update(set(own))
        near = {(m[0], w[0]) for m in address.finditer(t) for w in word.finditer(t) if m.start() - pii.CONTEXT <= w.start() <= w.end() <= m.start() or m.end() <= w.start() <= w.end() <= m.end() + pii.CONTEXT}
        beside.update(near)
        within.update((e, w) for e in es for w in set(own))
        if es:
            pieces = re.split(r"[\W\d_]+", t)  # one-letter words are surroundings as well
            for w in set(own):
                around.setdefault(w, []).append({(pieces[i - 1] if i else None, pieces[i + 1] if i + 1 < len(pieces) else None) for i, x in enumerate(pieces) if x == w})
    told = {}
    for pairs, varied in ((beside, False), (within, True)):
        for (e, w), n in pairs.items():
            if n < pii.SUPPORT or n < pii.KNOWN * n_word[w] or n_entity[e] == len(texts):
                continue
            # each text brings one of its surroundings; in these tests a word stands in a text once or far from undecided
            if varied and len({min(a, key=str) for a in around[w]}) < max(pii.SUPPORT, pii.VARIED * len(around[w])):
                continue
            share = math.log(n * len(texts) / (n_entity[e] * n_word[w])) / math.log(len(texts) / n_entity[e])
            if share >= pii.GENERALISE:
                told[e, w] = max(share, told.get((e, w), 0))
    return told


def check_terms(docs, rows):
    told = told_by_loops(rows)
    word, address = re.compile(r"[^\W\d_]{2,}"), re.compile(PLAIN[0][1])
    for x in pii.analyse(docs(rows)).collect():
        want, inside = set(), [m.span() for m in address.finditer(x["text"])]
        for w in word.finditer(x["text"]):
            shares = [told[m[0], w[0]] for m in address.finditer(x["text"]) if (m[0], w[0]) in told]
            if shares and not any(a < w.end() and w.start() < b for a, b in inside):
                want.add((w.start(), w.end(), max(shares) >= pii.REMOVE))
        assert {(s["start"], s["end"], s["removed"]) for s in x["spans"] if s["kind"] == 4} == want
    return told


def test_terms_against_brute_force(docs):
    """Words beside addresses and far from them, in copies too."""
    r = random.Random(5)
    common, rare = ["alpha", "beta", "gamma", "delta"], ["qo", "wex", "rud"]
    rows = []
    for i in range(60):
        words = r.choices(common, k=60)
        if i % 3 == 0:
            words[20] = f"m{i % 4}@host.org"
            words[18], words[2] = rare[i % 2], rare[i % 2]
            words[50] = f"far{'abcd'[i % 4]}"
            words[51] = f"x{'abcdefghij'[i % 10]}{'abc'[i % 3]}"
        elif i % 10 == 1:
            words[5] = rare[2] if i % 4 else rare[0]
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[i % 7][1]) for i in range(20)]
    told = check_terms(docs, rows)
    assert {w for _, w in told} >= {"qo", "wex", "fara", "farc"} and not {w for _, w in told} & {*common, "rud"}


def test_far_words_and_copies(docs):
    """A name far from its address goes; what copies and edited copies of one text share stays."""
    rows = [(i, f"Zebulon {prose(60, i)} write to zeb@example.org") for i in range(5)]
    one = f"{prose(20, 77)} quorble flindex mastovar {prose(60, 78)} mail ann@example.org now {prose(40, 79)}"
    rows += [(10 + i, one) for i in range(6)] + [(20, one.replace(" now ", " soon ")), (21, one + " end")]
    rows += [(30 + i, f"{prose(80, 200 + i)} zebra") for i in range(60)]
    got = {x["doc_id"]: {x["text"][s["start"] : s["end"]].lower() for s in x["spans"] if s["kind"] == 4} for x in pii.analyse(docs(rows)).collect()}
    assert all("zebulon" in got[i] for i in range(5))
    assert all(not got[i] & {"quorble", "flindex", "mastovar"} for i in (*range(10, 16), 20, 21))
    assert all(not got[30 + i] for i in range(60))
