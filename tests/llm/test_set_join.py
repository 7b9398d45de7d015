import collections

import numpy as np
import pytest

from attesta.llm import set_join as S
from tests.llm.conftest import edited, prose


def brute(rows, width, percent):
    sets = {}
    for d, t in rows:
        f = (t or "").encode().lower().split()
        sets[d] = set() if not f else {tuple(f)} if len(f) < width else {tuple(f[i : i + width]) for i in range(len(f) - width + 1)}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x = len(sets[a] & sets[b])
            if x and 100 * x >= percent * (len(sets[a]) + len(sets[b]) - x):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: (len(sets[d]), find(d)) for d in sets}


def got(docs, rows, **k):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in S.jaccard_groups(docs(rows), **k).collect()}


@pytest.mark.parametrize("width,percent,few", [(4, 85, 4), (5, 80, 0)])
def test_against_brute_force(docs, monkeypatch, width, percent, few):
    monkeypatch.setattr(S, "FEW", few)
    rows, n = [], 0
    for base in range(12):
        text = prose(30 + 37 * base, base)
        for copy in range(9):
            rows.append((n, text if copy % 4 == 0 else edited(text, 17 + 9 * copy, n)))
            n += 1
    # chains: each differs a little from the one before, the ends a lot from each other
    words = prose(200, 77).split()
    for step in range(8):
        words[step * 20 : step * 20 + 4] = ["changed", str(step), "here", "now"]
        rows.append((n, " ".join(words)))
        n += 1
    assert got(docs, rows, width=width, percent=percent) == brute(rows, width, percent)


@pytest.mark.parametrize("few", [4, 1000])
def test_common_passage_and_many_near_copies(docs, monkeypatch, few):
    monkeypatch.setattr(S, "FEW", few)
    passage = prose(60, 1)
    rows = [(i, passage + " " + prose(40 + i % 50, 100 + i)) for i in range(60)]
    base = prose(120, 2)
    rows += [(100 + i, edited(base, 25 + i % 40, i)) for i in range(60)]
    assert got(docs, rows, width=4, percent=85) == brute(rows, 4, 85)


def test_odd_rows(docs, odd, spark):
    out = S.jaccard_groups(docs(odd)).collect()
    assert len(out) == len(odd)
    by = collections.defaultdict(set)
    for r in out:
        by[r["doc_id"]].add((r["n_shingles"], r["component_id"]))
    assert by[1] == {(0, 1)} and by[3] == {(0, 3)} and by[4] == {(1, 4)} and by[None] == {(1, None)} and by[5] == {(1, 5)}
    assert S.jaccard_groups(docs([])).count() == 0


def test_pigeonhole_with_allocation():
    """Any two sets within the band's bound share a key, empty segments or not."""
    rng, bands = np.random.default_rng(3), S.Bands(85)
    with np.errstate(over="ignore"):
        for n in (7, 9, 13, 20, 45, 100, 333):
            for _ in range(30):
                x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
                cut = rng.permutation(x)[: max(1, int(np.ceil(0.93 * n)))]
                y = np.unique(np.concatenate((cut, rng.integers(0, 1 << 63, n - cut.size, dtype=np.uint64))))
                common = np.intersect1d(x, y).size
                if 100 * common < 85 * (x.size + y.size - common):
                    continue
                k = max(bands.of(x.size), bands.of(y.size))
                m, c, s = bands.layout(k)
                h = m - c - s
                for s in {s, 0}:  # with fewer spare segments, neighbourhoods make up for the empty ones
                    deep = max(S.needed(x, k, h + c + s, c, s), S.needed(y, k, h + c + s, c, s))
                    assert np.intersect1d(S.keys(x, k, h + c + s, c, s, deep), S.keys(y, k, h + c + s, c, s, deep)).size >= c


def test_sizes_come_to_keys(docs, monkeypatch):
    """Pairs of near copies, of which each set has as many as keys, are told apart by size as they are made; no join has
    all of them on one side to look their sizes up."""
    plans, plain = {}, S.durable

    def durable(df, name, *rest):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, name, *rest)

    monkeypatch.setattr(S, "durable", durable)
    base = prose(120, 2)
    rows = [(i, edited(base, 25 + i % 40, i)) for i in range(40)] + [(100 + i, base + " " + prose(60 + i, i)) for i in range(5)]
    assert got(docs, rows, width=5, percent=80) == brute(rows, 5, 80)
    assert "near" not in plans and "Join" not in plans["pairs"]
