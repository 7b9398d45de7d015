"""Exact Jaccard join of documents' word-shingle sets, and the groups that its links make.

Sets fall into size bands. In a band, a hash deals the universe of shingles into m = h + c + s segments, h being the
largest symmetric difference that two linked sets of that band can have, so that two linked sets agree wholly on at
least c + s segments (pigeonhole). A set indexes the hash of its part of each segment that isn't empty: empty parts
agree with far too many sets. If one of two linked sets has at most s empty segments, they share c such keys. Sets with
more of them also index one-deletion neighbourhoods in leading segments, enough to make up for the empty ones.

The allocation is by cost. s is chosen by the keys that a band's sets can be expected to have; how many leading
segments need neighbourhoods is counted over all sets; and as linked sets share c keys, each set leaves out the c - 1
of its keys that most sets have, such as those within a passage that many documents quote: what two linked sets share
besides still brings them together. Sets that meet under a key are compared exactly.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from attesta.llm.common import arrow_rows, connected_components, durable, release
from attesta.llm.words import C, batch_ids, mix

#: Sets that share a least set and are paired with each other; more of them go by prefixes.
FEW = 4
#: Sets, or texts, that a Python function holds at a time.
ROWS = 500
#: Share of a set's size that its spare keys make up: c - 1 of them.
SPARE = 1 / 16


def batch_shingles(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct 64-bit ids of word shingles: A-Z lowered, words cut at ASCII white space; a shorter
    text is one shingle, a text without words none."""
    for x, w in zip(texts, batch_ids(texts)):
        if w.size < width:
            own = [xxhash.xxh3_64_intdigest(b" ".join(x.lower().split()), seed=w.size)] if w.size else []
            yield np.asarray(own, dtype=np.uint64)
            continue
        n = w.size - width + 1
        h = w[:n]
        for j in range(1, width):
            h = mix(h * C + w[j : n + j])
        h = np.sort(h)
        yield h[np.concatenate(([True], h[1:] != h[:-1]))]


def shingles(text: bytes, width: int) -> np.ndarray:
    return next(batch_shingles([text], width))


class Bands:
    """Sizes from low to high belong to band k; linked sets lie in one band or in neighbours."""

    def __init__(self, percent: int, ratio: float = 1.6):
        self.percent, self.starts = percent, [1]
        ratio = max(ratio, 100 / percent)
        while self.starts[-1] < 1 << 40:
            self.starts.append(int(self.starts[-1] * ratio) + 1)
        self._layout: dict[int, tuple[int, int, int]] = {}

    def of(self, n: int) -> int:
        return bisect_right(self.starts, n) - 1

    def layout(self, band: int) -> tuple[int, int, int]:
        """(segments m, keys c that linked sets share, empty segments s that a set may have without deletion
        neighbourhoods) of a band's index."""
        if band not in self._layout:
            low, high = -(-self.percent * self.starts[band] // 100), self.starts[band + 1] - 1
            h = (100 - self.percent) * 2 * high // (100 + self.percent)
            c = 1 + int(low * SPARE)
            sizes = [max(1, round(low * (high / low) ** (i / 4))) for i in range(5)]
            costs: list[float] = []
            while len(costs) < 3 or min(costs) > costs[-1] - 0.02 * min(costs) and len(costs) < h + 4:
                costs.append(sum(_expected(n, h + c + len(costs), len(costs)) for n in sizes))
            s = min(range(len(costs)), key=costs.__getitem__)
            self._layout[band] = h + c + s, c, s
        return self._layout[band]

    def roles(self, n: int) -> list[int]:
        """Bands whose index a set of n takes part in: its own, and the next if a set there can be linked with it."""
        k = self.of(n)
        return [k, k + 1] if 100 * n >= self.percent * self.starts[k + 1] else [k]


def _expected(n: int, m: int, s: int) -> float:
    """Keys to expect of a set of n in m segments: its parts, and neighbourhoods if over s of them are empty."""
    if m == 1:
        return 1.0
    none = m * math.exp(n * math.log1p(-1 / m))
    two = m * (m - 1) * (math.exp(n * math.log1p(-2 / m)) if m > 2 else 0.0)
    spread = math.sqrt(max(none + two - none * none, 1e-9))
    over = 0.5 * math.erfc((s + 0.5 - none) / spread / math.sqrt(2))
    return m - none + over * n


def _seed(band: int) -> np.uint64:
    return np.uint64((band + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF)


def _parts(ids: np.ndarray, band: int, m: int):
    """Value and segment of each shingle; number of shingles in each segment."""
    value = mix(ids ^ _seed(band))
    segment = ((value >> np.uint64(40)) % np.uint64(m)).astype(np.int64)
    return value, segment, np.bincount(segment, minlength=m)


def needed(ids: np.ndarray, band: int, m: int, c: int, s: int) -> int:
    """Leading segments that must have deletion neighbourhoods for this set's allocation to hold; m + 1 if there
    aren't enough segments to make up for its empty ones."""
    if m == 1:
        return 0
    count = _parts(ids, band, m)[2]
    empty = int((count == 0).sum())
    if empty <= s:
        return 0
    missing = empty - s + c - 1  # of c - 1 segments that agree, each may take the place of one that differs by two
    wide = np.flatnonzero(count >= 2)
    return int(wide[missing - 1]) + 1 if wide.size >= missing else m + 1


def keys(ids: np.ndarray, band: int, m: int, c: int, s: int, deep: int) -> np.ndarray:
    """Index keys of a set in a band: its parts, and for a set with over s empty segments also the one-deletion
    neighbours of the first `deep` segments. deep = m + 1: its empty parts are keys as well."""
    value, segment, count = _parts(ids, band, m)
    low = np.bincount(segment, weights=(value & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=m).astype(np.uint64)
    high = np.bincount(segment, weights=(value >> np.uint64(32)).astype(np.float64), minlength=m).astype(np.uint64)
    total = (high << np.uint64(32)) + low
    own = np.uint64((band + 1) * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF)
    tag = np.arange(m, dtype=np.uint64) * C + own
    out = mix(total + mix(tag))
    if int((count == 0).sum()) <= s:
        return out[count > 0]
    out = out if deep > m else out[count > 0]
    if deep:
        at = np.flatnonzero((segment < deep) & (count[segment] > 1))
        out = np.concatenate((out, mix(total[segment[at]] - value[at] + mix(tag[segment[at]]))))
    return out


def _node(ids: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's 128-bit hash."""
    both = xxhash.xxh3_128_intdigest(ids.tobytes())
    return (both & (1 << 64) - 1) - (1 << 63), (both >> 64) - (1 << 63)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def profile(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, mark, n_shingles, node and check (hash of the set, null if empty), band, need0 and need1 (see `needed`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent)
        for batch in batches:
            rows = []
            with np.errstate(over="ignore"):
                for ids in batch_shingles(_texts(batch), width):
                    if not ids.size:
                        rows.append((0, None, None, None, None, None))
                        continue
                    need = [needed(ids, k, *bands.layout(k)) for k in bands.roles(ids.size)]
                    rows.append((ids.size, *_node(ids), bands.of(ids.size), need[0], need[1] if len(need) > 1 else None))
            columns = [pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), *columns], names=["doc_id", "mark", "n_shingles", "node", "check", "band", "need0", "need1"])

    return docs.mapInArrow(run, "doc_id long, mark long, n_shingles long, node long, check long, band int, need0 int, need1 int")


def index(docs: DataFrame, width: int, percent: int, deep: dict[int, int]) -> DataFrame:
    """(key, node, band) of every set; a set that comes again in the same partition is indexed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(percent), set()
        for batch in batches:
            found, nodes, roles, held = [], [], [], 0
            with np.errstate(over="ignore"):
                for ids in batch_shingles(_texts(batch), width):
                    if not ids.size or (node := _node(ids)[0]) in seen:
                        continue
                    seen.add(node)
                    for k in bands.roles(ids.size):
                        own = keys(ids, k, *bands.layout(k), deep.get(k, 0))
                        found.append(own.view(np.int64))
                        nodes.append(np.full(own.size, node, dtype=np.int64))
                        roles.append(np.full(own.size, k, dtype=np.int32))
                        held += own.size
                    if held > 200_000:
                        yield out(found, nodes, roles)
                        found, nodes, roles, held = [], [], [], 0
            if held:
                yield out(found, nodes, roles)

    def out(*columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns], names=["key", "node", "band"])

    return docs.mapInArrow(run, "key long, node long, band int")


def shared(indexed: DataFrame) -> DataFrame:
    """key, node, band, n: keys that several sets have, with their number of rows. Spark keeps a key's rows on disk where
    they are many."""
    w = Window.partitionBy("key")
    own = indexed.withColumns({"n": F.count(F.lit(1)).over(w), "lo": F.min("node").over(w), "hi": F.max("node").over(w)})
    return own.where("lo < hi").drop("lo", "hi")


def rarest(rows: DataFrame, spare: dict[int, int]) -> DataFrame:
    """key, node, size: without the keys of each set and band that most sets have, as many as linked sets share besides."""
    most = F.dense_rank().over(Window.partitionBy("node", "band").orderBy(F.desc("n"), "key"))
    left = F.element_at(F.create_map(*[F.lit(x) for kv in spare.items() for x in kv]), F.col("band"))
    return rows.withColumn("at", most).where(F.col("at") > left).select("key", "node", "size")


def meetings(indexed: DataFrame, percent: int) -> DataFrame:
    """a, b, star, fit: under each key that several sets (key, node, size) have, every set b with the least one a (star),
    and with the one before it in order; fit: by their sizes they may be linked.

    Rows arrive sorted and stream through; what is held between batches is two rows, however many a key has.
    """
    names = ["a", "b", "star", "fit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key, its least node and that one's size, node and size of the last row
        for batch in batches:
            key, node, size = (batch.column(i).to_numpy() for i in range(3))
            if held is not None:
                key, node, size = np.concatenate(([held[0]], key)), np.concatenate(([held[3]], node)), np.concatenate(([held[4]], size))
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
            key, node, size = key[fresh], node[fresh], size[fresh]
            if not key.size:
                continue
            new = np.concatenate(([True], key[1:] != key[:-1]))
            begin = np.maximum.accumulate(np.where(new, np.arange(key.size), 0))
            first, first_size = node[begin], size[begin]
            if held is not None:
                same = np.argmax(new[1:]) + 1 if new[1:].any() else key.size
                first[:same], first_size[:same] = held[1], held[2]
            at = np.flatnonzero(~new)
            if at.size:
                least, last, own = first[at], node[at - 1], node[at]
                apart = least != last
                pairs = np.concatenate((least, last[apart])), np.concatenate((own, own[apart]))
                sizes = np.concatenate((first_size[at], size[at - 1][apart])), np.concatenate((size[at], size[at][apart]))
                fit = 100 * np.minimum(*sizes) >= percent * np.maximum(*sizes)
                # near copies meet under many keys: what a batch repeats is given out once
                order = np.lexsort(pairs)
                x, y, star, fit = pairs[0][order], pairs[1][order], order < at.size, fit[order]
                begin = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]))))
                yield pa.RecordBatch.from_arrays([pa.array(x[begin]), pa.array(y[begin]), pa.array(np.logical_or.reduceat(star, begin)), pa.array(fit[begin])], names=names)
            held = (key[-1], first[-1], first_size[-1], node[-1], size[-1])

    return indexed.select("key", "node", "size").repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a long, b long, star boolean, fit boolean")


def sets(docs: DataFrame, width: int) -> DataFrame:
    """node, ids: each document's set as sorted little-endian 64-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            with np.errstate(over="ignore"):
                found = list(batch_shingles(_texts(batch), width))
            yield pa.RecordBatch.from_arrays([pa.array([_node(x)[0] for x in found], type=pa.int64()), pa.array([x.tobytes() for x in found], type=pa.binary())], names=["node", "ids"])

    return docs.mapInArrow(run, "node long, ids binary")


def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Number of elements that two sets share."""
    out = []
    for x, y in zip(a, b):
        both = np.concatenate((np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)))
        both.sort(kind="stable")
        out.append(int((both[1:] == both[:-1]).sum()))
    return pd.Series(out, dtype="int64")


def _difference(a: pd.Series, b: pd.Series) -> pd.Series:
    """Elements of one set but not of both."""
    out = []
    for x, y in zip(a, b):
        both = np.concatenate((np.frombuffer(x, dtype=np.int64), np.frombuffer(y, dtype=np.int64)))
        both.sort()
        new = np.concatenate(([True], both[1:] != both[:-1], [True]))
        out.append(both[new[1:] & new[:-1]])
    return pd.Series(out)


class Join:
    """The join's tables. profile: doc_id, mark (hash of the text), n_shingles, node, check. components: node, component
    (the least node of its group) for nodes, classes of equal sets, with links. Pairs of classes that other links
    already join are not compared."""

    def __init__(self, docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"):
        text = F.col(text_col).cast("string")
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
        with arrow_rows(own.sparkSession, ROWS):
            self.profile = durable(profile(own, width, percent), "profile")
            deep = self._allocation()
            common = durable(shared(index(own, width, percent, deep)), "shared")
            sizes = self.profile.where("node is not null").groupBy("node").agg(F.min("n_shingles").alias("n"))
            # sizes come to keys, of which each set has so many, not to pairs
            sized = common.join(sizes.toDF("node", "size"), "node")
            few = durable(rarest(sized, {k: Bands(percent).layout(k)[1] - 1 for k in deep}) if deep else sized, "rarest")
            pairs = durable(meetings(few, percent).groupBy("a", "b").agg(F.max("star").alias("star"), F.max("fit").alias("fit")), "pairs")
        release(common, few)
        near = pairs.where("fit").select("a", "b", "star")
        # a class's set is taken from one of its documents
        speaks = self.profile.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        chosen = speaks.join(ends, "node").select("doc_id", "node")
        held = sets(own.join(chosen.select("doc_id").distinct(), "doc_id").select("doc_id", "text"), width)
        with arrow_rows(own.sparkSession, ROWS):
            self.sets = durable(held.join(chosen.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")
        self.percent, self.components = percent, None

        # each set with one other first: in groups of copies that leaves little to compare
        first = self._compare(near.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        self._tie(first)
        rest = self._compare(self._apart(near.join(first, ["a", "b"], "left_anti")).select("a", "b"))
        self._tie(rest)
        members, more = self._members(pairs, sizes)
        apart = members.where(f"k > {FEW}").select(F.col("p").alias("a"), F.col("x").alias("b"))
        known = first.union(rest)
        spare = self._compare(apart.join(known, ["a", "b"], "left_anti"))
        prefixes, central = self._differences(members, known.union(spare))
        near_by = self._compare(self._unseen(more.union(central), near))
        self._tie(near_by)
        across = self._compare(self._unseen(self._across(prefixes), near))
        self._tie(across)
        release(self.sets, pairs, first, rest, members, spare, prefixes, near_by, across)

    def _tie(self, compared: DataFrame) -> None:
        """Joins the groups that links among compared pairs tie; only links between two groups are looked at."""
        found = self._linked(compared)
        if self.components is None:
            self.components = connected_components(found)
            return
        between = durable(self._apart(found).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "between")
        if not between.isEmpty():
            before, tied = self.components, connected_components(between)
            moved = before.join(tied.toDF("component", "to"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
            self.components = durable(moved.union(tied.join(before, "node", "left_anti").select("node", "component")), "groups")
            release(before, tied)
        release(between)

    def _apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs that aren't in one group, with their groups ca and cb."""
        c = self.components
        out = pairs.join(c.toDF("a", "ca"), "a", "left").join(c.toDF("b", "cb"), "b", "left")
        return out.withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).where("ca <> cb")

    def _allocation(self) -> dict[int, int]:
        """Per band the leading segments with deletion neighbourhoods; a row per band, of which a text's length allows
        a hundred or so."""
        own = self.profile.where("node is not null").select("band", F.col("need0").alias("need"))
        up = self.profile.where("need1 is not null").select((F.col("band") + 1).alias("band"), F.col("need1").alias("need"))
        return {r["band"]: r["need"] for r in own.union(up).groupBy("band").agg(F.max("need").alias("need")).collect()}

    def _compare(self, pairs: DataFrame) -> DataFrame:
        """a, b, na, nb, common: pairs of sets with their sizes and what they share."""
        a = self.sets.select(F.col("node").alias("a"), F.col("ids").alias("ids_a"))
        b = self.sets.select(F.col("node").alias("b"), F.col("ids").alias("ids_b"))
        both = pairs.join(a, "a").join(b, "b").withColumn("common", F.pandas_udf(_common, "long")("ids_a", "ids_b"))
        size = lambda c: (F.octet_length(c) / 8).cast("long")
        with arrow_rows(pairs.sparkSession, ROWS):
            return durable(both.select("a", "b", size("ids_a").alias("na"), size("ids_b").alias("nb"), "common"), "compared")

    def _linked(self, compared: DataFrame) -> DataFrame:
        return compared.where(f"100 * common >= {self.percent} * (na + nb - common)").select("a", "b")

    @staticmethod
    def _unseen(pairs: DataFrame, done: DataFrame) -> DataFrame:
        return pairs.distinct().join(done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")

    def _members(self, pairs: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Where sets that share a key aren't in one group yet: (p, x, component, nx, k of all sets x with the least set p
        of such keys, pairs to compare). Up to FEW sets with the same p are paired with each other."""
        t = self.percent
        members = pairs.where("star").select(F.col("a").alias("p"), F.col("b").alias("x"))
        members = members.join(self.components.toDF("x", "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))
        mixed = members.groupBy("p").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("k")).where("lo <> hi").select("p", "k")
        members = durable(members.join(mixed, "p").join(sizes.toDF("x", "nx"), "x").select("p", "x", "component", "nx", "k"), "members")
        few = members.where(f"k <= {FEW}").drop("k")
        near = few.join(few.toDF("p", "y", "cy", "ny"), "p").where(f"x < y and component <> cy and 100 * least(nx, ny) >= {t} * greatest(nx, ny)")
        return members, near.select(F.col("x").alias("a"), F.col("y").alias("b"))

    def _differences(self, members: DataFrame, compared: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(prefixes, pairs to compare) of sets that more than FEW share the least set p of a key with.

        All of them were compared with p. Prefixes of their differences from p are returned (see `_across`), and pairs
        of each with the most central one, whose difference holds the fewest elements of its own: what can be linked
        is mostly linked with it.
        """
        t = self.percent
        known = compared.select(F.col("a").alias("p"), F.col("b").alias("x"), F.col("na").alias("np"), (F.col("na") + F.col("nb") - 2 * F.col("common")).alias("a"))
        own = members.where(f"k > {FEW}").join(known, ["p", "x"])

        most = F.floor((100 - t) * (F.col("nx") + F.floor(F.col("nx") * 100 / t)) / (100 + t))
        from_p = F.floor((100 - t) * (F.col("nx") + F.col("np")) / (100 + t))
        least = F.floor((100 - t) * (F.ceil(F.col("nx") * t / 100) + F.col("np")) / (100 + t))
        own = own.withColumn("apart", F.col("a") > from_p)
        # the other's difference is at least a - H in size, and `least` + 1 if this one is linked with p
        agree = F.greatest(F.ceil((F.col("a") + least + 1 - most) / 2), F.col("a") - most, F.lit(1))
        own = own.withColumn("short", F.col("a") - agree + 1).withColumn("long", F.when(F.col("apart"), F.least(F.col("a"), most + 1)).otherwise(0))
        own = own.withColumn("member", F.xxhash64("p", "x"))
        a = self.sets.select(F.col("node").alias("p"), F.col("ids").alias("ids_p"))
        b = self.sets.select(F.col("node").alias("x"), F.col("ids").alias("ids_x"))
        differs = own.join(a, "p").join(b, "x").select("p", "member", F.pandas_udf(_difference, "array<long>")("ids_p", "ids_x").alias("differs"))
        each = differs.select("member", F.explode(F.transform("differs", lambda e: F.xxhash64("p", e))).alias("e"))
        each = each.withColumn("n_e", F.count(F.lit(1)).over(Window.partitionBy("e"))).where("n_e > 1")
        each = each.join(own, "member")
        w = Window.partitionBy("member")
        # elements that no other difference has come first and are left out
        each = each.withColumn("alone", F.col("a") - F.count(F.lit(1)).over(w)).withColumn("place", F.col("alone") + F.row_number().over(w.orderBy("n_e", "e")))
        with arrow_rows(members.sparkSession, ROWS):
            each = durable(each.where("place <= greatest(short, long) or place = alone + 1").select("p", "e", "x", "nx", "a", "alone", "place", "short", "long"), "prefixes")
        heart = each.groupBy("p").agg(F.min(F.struct("alone", "x"))["x"].alias("q"))
        grouped = own.select("p", "x", "component")
        q = heart.join(grouped.select("p", F.col("x").alias("q"), F.col("component").alias("cq")), ["p", "q"])
        central = grouped.join(q, "p").where("component <> cq").select(F.least("x", "q").alias("a"), F.greatest("x", "q").alias("b"))
        return each, central

    def _across(self, prefixes: DataFrame) -> DataFrame:
        """Pairs that may be linked though neither is the least set of a key that they share and their groups differ.

        Such x and y were both compared with that least set p. With a(x) the size of x's difference from p, the two
        differ by a(x) + a(y) less twice what their differences share. If they are in two groups, one of them, x, isn't
        linked with p, so that their differences must share much: x all but H of its own, y about half (H: how far
        linked sets of that size can differ). A prefix of each difference, rarest elements first, meets the other's
        if they share that much, and only such pairs go on.
        """
        t = self.percent
        each = prefixes.join(self.components.toDF("x", "component"), "x", "left").withColumn("component", F.coalesce("component", "x"))
        far = each.where("place <= long").select("p", "e", F.col("x").alias("y"), F.col("component").alias("cy"), F.col("nx").alias("ny"), F.col("a").alias("ay"), F.col("place").alias("place_y"))
        near = each.where("place <= short").select("p", "e", "x", "component", "nx", "a", "place")
        # from the first element that two differences share on, each must have enough left
        enough = f"2 * (1 + least(a - place, ay - place_y)) >= a + ay - floor({100 - t} * (nx + ny) / {100 + t})"
        both = near.join(far.drop("p"), "e").where(f"x <> y and component <> cy and 100 * least(nx, ny) >= {t} * greatest(nx, ny) and {enough}")
        return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    def classes(self) -> DataFrame:
        """node, check, least (id), component: a row for each class of equal sets; component is one of its group's nodes.

        Where two sets share a node but not the check, as a few in 10^10 may, the node is the first one's; the other
        is a group by itself, rather than part of one that it isn't linked with."""
        own = self.profile.where("node is not null").groupBy("node", "check").agg(F.min("doc_id").alias("least"))
        first = own.groupBy("node").agg(F.min("check").alias("check"))
        tied = first.join(self.components, "node", "left").withColumn("component", F.coalesce("component", "node"))
        return own.join(tied, ["node", "check"], "left")

    def groups(self) -> DataFrame:
        """doc_id, n_shingles, component_id for every document: the smallest id that links reach."""
        classes = self.classes()
        root = classes.where("component is not null").groupBy("component").agg(F.min("least").alias("component_id"))
        of = classes.join(root, "component", "left").select("node", "check", F.coalesce("component_id", "least").alias("component_id"))
        own = self.profile.select("doc_id", "n_shingles", "node", "check").join(of, ["node", "check"], "left")
        alone = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
        return own.select("doc_id", "n_shingles", alone.alias("component_id"))

    def release(self) -> None:
        """Deletes the join's tables, once nothing reads them any more."""
        release(self.profile, self.components)


def jaccard_groups(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link when their sets of `width`-word shingles have
    100 * intersection >= percent * union; component_id is the smallest id reachable.

    Null and empty texts, and texts of white space, have no shingles and link with nothing; a text with fewer than
    `width` words is one shingle; equal sets link. A row with a null id comes back with a null component; if all
    documents of a set have null ids, the set links nothing. Rows that repeat an id count as one document where
    their sets are equal. An empty table gives no rows; other columns are not read. Shingles go by 64-bit hashes, sets
    by 128-bit ones.
    """
    return Join(docs, width=width, percent=percent, id_col=id_col, text_col=text_col).groups()


def deduplicate(docs: DataFrame, *, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one row of each group that `jaccard_groups` makes: the one of the least id, and of rows
    with that id the one whose text has the least hash.

    What goes are rows, not ids: of rows that share an id but not their groups each group's own stays, and of rows that
    repeat id and text one. Rows without an id are chosen only where their group has no other; they group by equal sets
    alone. Null, empty and blank texts aren't copies of each other, and all their rows stay. An empty table gives no
    rows; other columns may have any name.
    """
    join = Join(docs, width=width, percent=percent, id_col=id_col, text_col=text_col)
    classes = join.classes().select("node", "check", F.coalesce("component", "check").alias("group"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark"))
    chosen = join.profile.where("node is not null").join(classes, ["node", "check"]).groupBy("group").agg(least.alias("kept")).select("kept.*")
    chosen = durable(chosen.select(F.coalesce("doc_id", F.lit(0).cast("long")).alias("key"), "none", "mark").distinct(), "kept")
    join.release()
    text, own = F.col(text_col).cast("string"), F.col(id_col).cast("long")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(own, F.lit(0).cast("long")).alias("key"), own.isNull().alias("none"), F.xxhash64(text).alias("mark"), F.coalesce(F.rlike(text, F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)).alias("said"))
    by = ["key", "none", "mark"]
    stays = rows.where("said").join(chosen, by, "left_semi").dropDuplicates(by)
    return rows.where("not said").select("row").union(stays.select("row")).select("row.*")
