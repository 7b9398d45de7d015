"""The best rows of each query, kept while blocks of scores go by: helpers for tasks."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np

#: Half a unit of the sixth digit, and a little more: rows that rounding may bring together.
NEAR = 1.1e-6


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, half up on the shortest decimal form, as Spark rounds doubles."""
    with np.errstate(all="ignore"):
        scaled = np.abs(x) * 1e6
        out = np.where(scaled < 2**50, np.copysign(np.floor(scaled + 0.5), x) / 1e6 + 0.0, x)
        # too near to a half for doubles, or too large for them to hold six digits exactly
        doubtful = np.flatnonzero(((np.abs(scaled - np.floor(scaled) - 0.5) < 1e-7 + scaled * 1e-15) | (scaled >= 2**40)) & np.isfinite(x))
    for i in doubtful:
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("1e-6"), ROUND_HALF_UP)) + 0.0 if abs(x[i]) < 2**53 else x[i]
    return out


class Best:
    """k rows of each of n queries: the highest rounded scores, ties to the smaller place; NaN is above all numbers."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.query, self.place, self.score = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0)
        self.least = np.full(n, -np.inf)  # the k-th rounded score, once there are k

    def add(self, query: np.ndarray, place: np.ndarray, score: np.ndarray) -> None:
        """Rows with their exact scores."""
        keep = ~(rounded(score) < self.least[query])
        query, place, score = (np.concatenate(x) for x in ((self.query, query[keep]), (self.place, place[keep]), (self.score, score[keep])))
        value = rounded(score)
        nan = np.isnan(value)
        order = np.lexsort((place, -np.where(nan, 0.0, value), ~nan, query))
        query, place, score, value = query[order], place[order], score[order], value[order]
        new = np.concatenate(([True], query[1:] != query[:-1])) if query.size else np.empty(0, dtype=bool)
        rank = np.arange(query.size) - np.maximum.accumulate(np.where(new, np.arange(query.size), 0))
        last = np.flatnonzero((rank == self.k - 1) & ~np.isnan(value))
        self.least[query[last]] = value[last]
        own = rank < self.k
        self.query, self.place, self.score = query[own], place[own], score[own]

    def may_enter(self, scores: np.ndarray, slack: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """(query, column) of a block of scores (queries by rows, true to `slack`) that may be among the k best."""
        least = self.least - NEAR - slack
        if scores.shape[1] > self.k:
            own = np.where(np.isnan(scores), np.inf, scores)
            kth = np.partition(own, own.shape[1] - self.k, axis=1)[:, own.shape[1] - self.k]
            least = np.maximum(least, kth - NEAR - 2 * slack)
        return np.nonzero(~(scores < least[:, None]))
