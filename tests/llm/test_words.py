import random

from attesta.llm import words


def test_words_against_split():
    rng = random.Random(4)
    signs = ["a", "B", "z", "Z", "é", "ß", "\x00", "\x1c", "\xa0", " ", "\t", "\n", "\x0b", "\r", "@", "[", "語", "Ab1"]
    texts = ["", " ", "\n\x0b", "x", "X" * 200_000 + " x", "y" * 64 + " " + "y" * 65, "\x00 \x00\x00"]
    texts += ["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(3000)]
    raw = [x.encode() for x in texts]
    known, back = {}, {}
    for text, ids in zip(raw, words.batch_ids(raw), strict=True):
        found = text.lower().split()
        assert len(found) == ids.size
        for word, i in zip(found, ids.tolist()):
            assert known.setdefault(word, i) == i and back.setdefault(i, word) == word
    assert [x.tolist() for x in words.batch_ids(raw[:20])] == [words.word_ids(x).tolist() for x in raw[:20]]
    assert list(words.batch_ids([])) == []


def test_chunks_do_not_matter(monkeypatch):
    texts = [f"word{i % 7} and {i}".encode() for i in range(100)]
    whole = [x.tolist() for x in words.batch_ids(texts)]
    monkeypatch.setattr(words, "CHUNK", 30)
    assert [x.tolist() for x in words.batch_ids(texts)] == whole
