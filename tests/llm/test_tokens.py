import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from attesta.llm import binary_order, packing
from attesta.llm.queries import tokenizer_path
from attesta.llm.tokens import Tokens
from tests.llm.conftest import prose

ODD_TEXTS = ["", " ", "  a b", "a  b ", "\n\na\n b\tc 　d", "x <|endoftext|> y", "don't I'll\n\n\n  go", "a b c", "1234 5 6a", prose(300, 1), "word " * 500, "tab\t end\n", "é́ 日本語 text"]


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(tokenizer_path())
    return lambda x: t.encode(x, add_special_tokens=False).ids


def test_ids(plain):
    t = Tokens(tokenizer_path())
    for _ in range(2):
        for x in ODD_TEXTS:
            assert np.frombuffer(t.encode(x), dtype="<u4").tolist() == plain(x), x


def test_plan():
    rng = np.random.default_rng(0)
    for _ in range(20):
        lengths = rng.integers(1, 3000, rng.integers(0, 60)).tolist()
        got, seqs = {}, packing.plan(lengths, 1024)
        for s in seqs:
            n = sum(p[2] for p in s)
            assert n == 1024 or n & (n - 1) == 0
            for d, a, k in s:
                got.setdefault(d, []).append((a, k))
        for d, n in enumerate(lengths):
            at = 0
            for a, k in sorted(got[d]):
                assert a == at
                at += k
            assert at == n


def test_first_fit():
    sizes = [5, 7, 3, 9, 1, 1, 4, 10]
    bins = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = next((b for b in bins if sum(sizes[j] for j in b) + sizes[i] <= 10), None)
        if b is None:
            bins.append([i])
        else:
            b.append(i)
    assert packing.first_fit_decreasing(sizes, 10) == bins


def test_pack(docs, plain, odd):
    rows = [*odd, *[(100 + i, x) for i, x in enumerate(ODD_TEXTS)]]
    out = packing.pack(docs(rows), tokenizer_path()).collect()
    ids = {}
    for r in out:
        ids.setdefault(r["doc_id"], []).append(r)
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    for d, x in rows:
        if d != 5:
            whole = b"".join(r["ids"] for r in sorted(ids[d], key=lambda r: r["start"]))
            assert np.frombuffer(whole, dtype="<u4").tolist() == [*plain(x or ""), 0]
    assert sum(r["length"] for r in ids[5]) == 2 * ids[5][0]["doc_tokens"]
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for o, n in sorted(pieces):
            assert o == at
            at += n
        assert at <= 1024
    assert packing.pack(docs([]), tokenizer_path()).count() == 0


@pytest.mark.parametrize("total", [1, 2, 3, 10, 1000, 4097])
def test_feistel_is_a_permutation(total):
    got = binary_order.slots(np.arange(total), total, "k")
    assert sorted(got.tolist()) == list(range(total))
    assert total < 10 or (got != binary_order.slots(np.arange(total), total, "other")).any()


def test_binary_round_trip(spark, docs, plain, odd, tmp_path):
    path = f"file://{tmp_path}/shards"
    rows = sorted(binary_order.materialise(docs(odd), tokenizer_path(), path, length=64, shard_sequences=100).collect(), key=lambda r: r["slot"])
    again = binary_order.materialise(docs(odd[::-1]).repartition(5), tokenizer_path(), path, length=64, shard_sequences=100).collect()
    assert sorted(again, key=lambda r: r["slot"]) == rows  # whatever the order and the partitions of the input
    assert [r["slot"] for r in rows] == list(range(len(rows)))
    seqs = list(binary_order.read(spark, path))
    assert len(seqs) == len(rows) and all(s.size == 64 for s in seqs)
    assert [zlib.crc32(s[: r["n_tokens"]].astype("<u4").tobytes()) for s, r in zip(seqs, rows)] == [r["ids_crc32"] for r in rows]
    resumed = list(binary_order.read(spark, path, start=37))
    assert all((a == b).all() for a, b in zip(resumed, seqs[37:])) and len(resumed) == len(seqs) - 37
    assert sum(r["n_tokens"] for r in rows) == sum(len(plain(x or "")) + 1 for _, x in odd)
    assert binary_order.materialise(docs([]), tokenizer_path(), f"file://{tmp_path}/none").count() == 0


def test_slots_are_computed_once(docs, monkeypatch, tmp_path):
    """Filters on slots read the column, and don't call the permutation a second time."""
    plans, plain = [], binary_order.durable

    def durable(df, name, *rest):
        if name == "order":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, name, *rest)

    monkeypatch.setattr(binary_order, "durable", durable)
    rows = [(i, prose(300, i)) for i in range(20)]
    binary_order.materialise(docs(rows), tokenizer_path(), f"file://{tmp_path}/s", length=64, shard_sequences=4)
    assert plans and all(p.count("ArrowEvalPython") == 1 for p in plans)


def test_ids_of_long_texts_keep_nothing(plain):
    """A worker holds the tokenizer, and no pieces of the texts that have passed."""
    t = Tokens(tokenizer_path())
    held = {k: len(v) for k, v in vars(t).items() if hasattr(v, "__len__")}
    for x in [prose(20_000, 5), " ".join(f"w{i}" for i in range(20_000)), "x" * 20_000, " " * 20_000 + "a"]:
        assert np.frombuffer(t.encode(x), dtype="<u4").tolist() == plain(x)
    assert held == {k: len(v) for k, v in vars(t).items() if hasattr(v, "__len__")}
