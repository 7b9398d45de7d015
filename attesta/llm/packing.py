"""Packing of documents into fixed-length token sequences.

First-fit decreasing over a tournament tree of bin capacities, run on its own in each randomised group of documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from attesta.llm.tokens import tokens

#: A group's text, in bytes and documents: what one task holds at a time.
GROUP_BYTES, GROUP_DOCS = 4 << 20, 8192


class Tournament:
    """Winner tree over bins: each inner node holds the larger capacity below it, so the leftmost bin with room is
    found in one walk from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def first(self, size: int) -> int:
        at = 1
        while at < self.leaves:
            at *= 2
            if self.room[at] < size:
                at += 1
        return at - self.leaves

    def take(self, bin_: int, size: int) -> None:
        at = bin_ + self.leaves
        self.room[at] -= size
        at //= 2
        while at:
            self.room[at] = max(self.room[2 * at], self.room[2 * at + 1])
            at //= 2


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes; sizes are at most capacity; equal sizes keep their order."""
    tree, bins = Tournament(len(sizes), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = tree.first(sizes[i])
        tree.take(b, sizes[i])
        if b == len(bins):
            bins.append([])
        bins[b].append(i)
    return bins


def plan(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token once.

    Whole-capacity pieces stand alone; the remainders go through first-fit decreasing; then the emptiest bins are
    cut up to fill the gaps of the others, and the one bin left over is cut into runs of powers of two, which need
    no padding.
    """
    out, rest = [], []
    for d, n in enumerate(lengths):
        full = n // capacity * capacity
        out += [[(d, s, capacity)] for s in range(0, full, capacity)]
        if n > full:
            rest.append((d, full, n - full))
    bins = [[rest[i] for i in b] for b in first_fit_decreasing([r[2] for r in rest], capacity)]
    fill = lambda b: sum(p[2] for p in b)
    done = [b for b in bins if fill(b) == capacity]
    open_ = sorted((b for b in bins if fill(b) < capacity), key=lambda b: -fill(b))
    i, j = 0, len(open_) - 1
    while i < j:
        gap = capacity - fill(open_[i])
        while gap and i < j:
            d, s, n = open_[j].pop()
            if n > gap:
                open_[j].append((d, s, n - gap))
                s, n = s + n - gap, gap
            open_[i].append((d, s, n))
            gap -= n
            if not open_[j]:
                j -= 1
        if not gap:
            done.append(open_[i])
            i += 1
    if i == j:
        left, n = list(open_[i]), fill(open_[i])
        size = 1 << max(0, n.bit_length() - 1)
        while left:
            run, need = [], size
            while need:
                d, s, k = left.pop(0)
                if k > need:
                    left.insert(0, (d, s + need, k - need))
                    k = need
                run.append((d, s, k))
                need -= k
            done.append(run)
            n -= size
            size = 1 << max(0, n.bit_length() - 1)
    return out + done


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    capacity: int = 1024,
    end_id: int = 0,
    seed: int = 20,
    with_ids: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids
    (little-endian unsigned 32-bit).

    Null and empty texts are documents of the end id alone; null ids stay null; repeated rows are packed as often as
    they come; an empty table gives no rows; other columns are not read. Sequences hold `capacity` ids or, for the
    last few of a group, a smaller power of two.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n, size = own.agg(F.count(F.lit(1)), F.sum(F.octet_length("text").cast("long"))).first()
    groups = max(1, -(-(size or 0) // GROUP_BYTES), -(-n // GROUP_DOCS))
    dealt = own.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(groups)))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = ", ".join(f"{k} {'binary' if k == 'ids' else 'long'}" for k, _ in fields)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(table: pa.Table) -> pa.Table:
        t = tokens(tokenizer_path)
        rows = sorted(zip(table["doc_id"].to_pylist(), table["text"].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        group = table["grp"][0].as_py()
        ids = [t.encode(x) + end for _, x in rows]
        out: list[list] = [[] for _ in fields]
        for k, sequence in enumerate(plan([len(x) // 4 for x in ids], capacity)):
            at = 0
            for d, s, m in sequence:
                raw = ids[d][4 * s : 4 * (s + m)]
                row = (rows[d][0], s, m, zlib.crc32(raw), len(ids[d]) // 4, group << 32 | k, at, raw)
                for column, value in zip(out, row):
                    column.append(value)
                at += m
        pa.default_memory_pool().release_unused()  # of groups before: a worker is kept when its task ends
        return pa.table([pa.array(c, type=kind) for c, (_, kind) in zip(out, fields)], names=[k for k, _ in fields])

    return dealt.groupBy("grp").applyInArrow(run, schema)
