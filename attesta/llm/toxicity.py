"""Toxicity scores behind a noisy channel.

Writers hide words by swapping letters for look-alikes, by spacing letters out and by repeating them. Each such token
is a lattice of the letters it may stand for; Viterbi decoding under a character language model of the corpus gives
the likeliest readings, and the restored words are scored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from attesta.llm.common import arrow_rows, durable

#: At most so many labelled documents are learned from.
SAMPLE = 20_000
#: Evidence to learn the last step from is weighed by what the other folds' documents say.
FOLDS = 5
#: What a Python worker holds at once: rows of texts, words or features that are counted, tokens whose evidence is known.
#: What goes beyond is passed on or found again.
ROWS, COUNTED, KNOWN = 500, 40_000, 60_000
#: Word beginnings that count as features besides the whole word.
PREFIXES = range(3, 9)
#: Letters a character may stand for, besides itself.
LOOK_ALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
#: Log costs of the channel: a letter written otherwise, a character that stands for nothing, a letter repeated.
SWAP, DROP, REPEAT = 1.0, 2.5, 0.5
READINGS = 3
_SPACED = re.compile(r"(?<!\S)(?:[^\W_][ ._*-]){2,}[^\W_](?![^\W_])")
_M61 = (1 << 61) - 1
_EDGES = ".,;:!?\"'()[]{}<>-_*#&%$~`|/\\=+@^"
_TRIPLE = re.compile(r"(.)\1\1")
_PARTS = re.compile(r"[^\W\d_]{3,}")


@lru_cache(maxsize=4096)
def fold(c: str) -> str:
    """The language model's alphabet: a letter's base from a to z, and one sign for all others; under 20,000 trigrams."""
    base = unicodedata.normalize("NFKD", c)[:1]
    return base if "a" <= base <= "z" else "ɐ"


def grams(word: str) -> list[str]:
    w = "^^" + "".join(map(fold, word)) + "$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


class Language:
    """Character trigrams with add-one smoothing over the trigram's first two characters."""

    def __init__(self, counts: dict[str, int]):
        before = Counter()
        for g, n in counts.items():
            before[g[:2]] += n
        letters = len({g[2] for g in counts}) + 1
        self.log = {g: math.log((n + 0.1) / (before[g[:2]] + 0.1 * letters)) for g, n in counts.items()}
        self.unseen = {p: math.log(0.1 / (n + 0.1 * letters)) for p, n in before.items()}
        self.blank = -math.log(letters)

    def cost(self, gram: str) -> float:
        got = self.log.get(gram)
        return -(got if got is not None else self.unseen.get(gram[:2], self.blank))


def restore(token: str, language: Language, best: int = READINGS) -> list[str]:
    """The likeliest readings of a token, best first: list Viterbi over its lattice, one state per last two letters.

    A path is its cost, a hash of its text, and its last letter with a pointer to the path before, so that a step costs
    the same however long the token is.
    """
    states: dict[str, list] = {"^^": [(0.0, 0, None)]}
    for at, c in enumerate(token):
        after: dict[str, list] = {}
        alike = LOOK_ALIKE.get(c, "")
        arcs = [(c, 0.0)] if c.isalpha() else [(x, SWAP + (1.0 if len(alike) > 2 else 0.0)) for x in alike]
        again = at > 0 and token[at - 1] == c
        for last, paths in states.items():
            for path in paths:
                cost, text, _ = path
                for letter, price in arcs:
                    f = fold(letter)
                    after.setdefault(last[1] + f, []).append((cost + price + language.cost(last + f), (text * 1_000_003 + ord(letter)) & _M61, (letter, path)))
                if not c.isalpha() or again:
                    after.setdefault(last, []).append((cost + (REPEAT if again else DROP), text, path[2]))
        states = {k: _least(v, best) for k, v in after.items()}
        if not states:
            return []
    ends = [(cost + language.cost(last + "$"), text, back) for last, paths in states.items() for cost, text, back in paths if back]
    out = []
    for _, _, back in _least(ends, best):
        letters = []
        while back:
            letters.append(back[0])
            back = back[1][2]
        out.append("".join(letters[::-1]))
    return out


def _least(paths: list, n: int) -> list:
    """The n cheapest paths with different texts."""
    out, seen = [], set()
    for p in sorted(paths, key=lambda p: p[:2]):
        if p[1] not in seen:
            seen.add(p[1])
            out.append(p)
            if len(out) == n:
                break
    return out


def noisy(word: str) -> bool:
    """Whether a token isn't a plain word: it holds something else than letters, or a letter three times in a row."""
    return not word.isalpha() or _TRIPLE.search(word) is not None


def core(token: str) -> str:
    """A token without punctuation around it; a single $ or @ at an end may stand for a letter and stays."""
    word = token.strip(_EDGES)
    if len(word) < len(token) and ("$" in token or "@" in token):
        at = token.find(word)
        before, after = token[:at], token[at + len(word) :]
        word = (before[-1] if before in ("$", "@") else "") + word + (after[0] if after in ("$", "@") else "")
    return word


def features(word: str) -> list[str]:
    return [word + "$"] + [word[:n] for n in PREFIXES if len(word) > n]


def plain_words(text: str) -> set[str]:
    return {w for w in (x.strip(_EDGES) for x in set(text.lower().split())) if len(w) > 2 and w.isalpha()}


class Judge:
    """Evidence of whole texts under learned weights."""

    def __init__(self, weights: dict[str, float], language: Language, known: int = KNOWN):
        self.weights, self.language, self.memo, self.known = weights, language, {}, known
        self.starts = {f[:3] for f in weights}

    def _word(self, word: str) -> float:
        if len(word) < 3 or word[:3] not in self.starts:
            return 0.0
        return max(self.weights.get(f, 0.0) for f in features(word))

    def token(self, token: str) -> float:
        got = self.memo.get(token)
        if got is None:
            word = token if token.isalpha() else core(token)
            got = self._word(word)
            if len(word) > 2 and noisy(word):
                got = max([got, *map(self._word, _PARTS.findall(word) + restore(word, self.language))])
            if len(self.memo) >= self.known:
                self.memo.clear()
            if len(token) <= 64:
                self.memo[token] = got
        return got

    def evidence(self, text: str) -> list[float]:
        """Largest weight, mean of the next three, words with weights above 2, 3, 4 and 6 (as logarithms of counts), share
        of the text's words that all weights make up, and words of the text (as a logarithm)."""
        low = text.lower()
        found = low.split()
        each = [e for e in map(self.token, set(found)) if e > 0]
        for m in _SPACED.finditer(low):
            word = re.sub(r"[ ._*-]", "", m[0])
            each += [e for e in (max([self._word(word), *map(self._word, restore(word, self.language))]),) if e > 0]
        high = sorted(each, reverse=True)
        return [
            high[0] if high else 0.0,
            sum(high[1:4]) / 3,
            *[math.log1p(sum(e > least for e in high)) for least in (2, 3, 4, 6)],
            math.log1p(sum(high)) - math.log1p(len(found)),
            math.log1p(len(found)),
        ]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights, the constant last, by Newton steps."""
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    penalty = ridge * len(x) / 1000 * np.diag([1.0] * x.shape[1] + [0.0]) + 1e-9 * np.eye(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty + 1e-6 * np.eye(a.shape[1]), a.T @ (p - y) + penalty @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _log_odds(tox: int, clean: int, n_tox: int, n_clean: int) -> float:
    return math.log((tox + 0.5) / (n_tox + 1)) - math.log((clean + 0.5) / (n_clean + 1))


def _weights(rows: list, sizes: list[int], folds: tuple[int, ...]) -> dict[str, float]:
    """Log odds of features over the given folds; at least three toxic documents must have a feature."""
    n = [sum(sizes[2 * f + t] for f in folds) for t in (0, 1)]
    out = {}
    for feature, *counts in rows:
        clean, tox = (sum(counts[2 * f + t] for f in folds) for t in (0, 1))
        if tox >= 3 and (w := _log_odds(tox, clean, n[1], n[0])) > 1:
            out[feature] = w
    return out


def train(docs: DataFrame, labels: DataFrame):
    """(weights, language, regression weights) from all texts of docs and labels (doc_id, toxic); at most SAMPLE
    labelled documents, those of least hash, are learned from. None without labels of both kinds."""
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # SAMPLE bounds the side that is sent to every executor
    cell = (2 * F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(FOLDS)) + F.when(F.col("toxic") > 0, 1).otherwise(0)).cast("int")
    sample = durable(own.join(F.broadcast(known), "doc_id").select(cell.alias("cell"), F.coalesce("text", F.lit("")).alias("text")), "labelled")
    n = {r["cell"]: r["n"] for r in sample.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = [n.get(c, 0) for c in range(2 * FOLDS)]
    if not sum(sizes[::2]) or not sum(sizes[1::2]):
        return None
    every = tuple(range(FOLDS))
    used = [every, *[tuple(f for f in every if f != out) for out in every]]
    with arrow_rows(docs.sparkSession, ROWS):
        rows = _count(sample).where(reduce(Column.__or__, [_telling(sizes, folds) for folds in used])).collect()
        language = Language({r["gram"]: r["n"] for r in _grams(own).collect()})
    others = [_weights(rows, sizes, folds) for folds in used[1:]]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judges = [Judge(w, language, KNOWN // FOLDS) for w in others]
        for batch in batches:
            got = [[float(c & 1), *judges[c >> 1].evidence(x)] for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(got, type=pa.list_(pa.float64()))], names=["x"])

    with arrow_rows(docs.sparkSession, ROWS):
        seen = np.asarray([r["x"] for r in sample.mapInArrow(weigh, "x array<double>").collect()])
    return _weights(rows, sizes, every), language, logistic(seen[:, 1:], seen[:, 0])


def _telling(sizes: list[int], folds: tuple[int, ...]) -> Column:
    """Whether `_weights` may keep a feature over these folds: the same rule, with room for rounding."""
    clean, tox = (reduce(Column.__add__, [F.col(f"c{2 * f + t}") for f in folds]) for t in (0, 1))
    n = [sum(sizes[2 * f + t] for f in folds) for t in (0, 1)]
    return (tox >= 3) & ((tox + 0.5) / (n[1] + 1) > 2.7 * (clean + 0.5) / (n[0] + 1))


def _count(sample: DataFrame) -> DataFrame:
    """feature, c0, c1, ...: labelled documents of each cell (2 * fold + label) that have a feature."""
    cells = [f"c{c}" for c in range(2 * FOLDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}

        def out():
            columns = [pa.array(found, type=pa.string()), *[pa.array([c[i] for c in found.values()], type=pa.int64()) for i in range(2 * FOLDS)]]
            return pa.RecordBatch.from_arrays(columns, names=["feature", *cells])

        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for f in {f for w in plain_words(x) for f in features(w)}:
                    if f not in found:
                        found[f] = [0] * (2 * FOLDS)
                    found[f][c] += 1
                if len(found) > COUNTED:
                    yield out()
                    found.clear()
        yield out()

    counted = sample.mapInArrow(run, ", ".join(["feature string", *[f"{c} long" for c in cells]]))
    return counted.groupBy("feature").agg(*[F.sum(c).alias(c) for c in cells])


def _grams(docs: DataFrame) -> DataFrame:
    """gram, n: the letter trigrams of all words of all texts. The folded alphabet bounds their number, at any size of the
    corpus, and counts keep growing with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()

        def out():
            n: Counter = Counter()
            for w, k in words.items():
                w = w.strip(_EDGES)
                if w.isalpha():
                    for g in grams(w):
                        n[g] += k
            words.clear()
            return pa.RecordBatch.from_arrays([pa.array(n, type=pa.string()), pa.array(n.values(), type=pa.int64())], names=["gram", "n"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                words.update((x or "").lower().split())
                if len(words) > COUNTED:
                    yield out()
        yield out()

    return docs.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted of every row. labels: doc_id, toxic (0 or 1), the rows to learn from.

    Null and empty texts have no evidence and get the constant's score; rows that repeat get equal scores; null ids
    are scored and never learned from; without labels of both kinds all scores are 0; an empty table gives no rows;
    other columns are not read. Score is a probability of label 1; predicted is 1 from `threshold` on.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = train(own, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*model[:2]) if model else None
        for batch in batches:
            if judge:
                x = np.asarray([judge.evidence(x or "") for x in batch.column(1).to_pylist()]).reshape(-1, len(model[2]) - 1)
                p = 1 / (1 + np.exp(-np.clip(x @ model[2][:-1] + model[2][-1], -30, 30)))
            else:
                p = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    with arrow_rows(docs.sparkSession, ROWS):
        return durable(own.mapInArrow(run, "doc_id long, score double, predicted int"), "scores")


def keep(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that `score` predicts toxic; the same cases as there."""
    model = train(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), labels)
    if not model:
        return docs
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(*model[:2])
        for batch in batches:
            x = np.asarray([judge.evidence(x or "") for x in batch.column(at).to_pylist()]).reshape(-1, len(model[2]) - 1)
            p = 1 / (1 + np.exp(-np.clip(x @ model[2][:-1] + model[2][-1], -30, 30)))
            yield batch.filter(pa.array(p < threshold))

    with arrow_rows(docs.sparkSession, ROWS):
        return durable(docs.mapInArrow(run, docs.schema), "kept")


def train_rows(labels: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out third (crc32 of the id as text, modulo 3, is 1)."""
    return labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
