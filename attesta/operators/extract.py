"""From raw sources to units: HTML blocks, numbered clauses, ordered acceptance, keyed joins, alignment."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.functions.text import blocks, strip_tags


def html_blocks(pages: DataFrame, tag: str, entities: Mapping[str, str] | None = None) -> DataFrame:
    """page_id, pos, text of every non-blank <tag>, in order; entities as in `strip_tags`."""
    own = pages.select("page_id", F.posexplode(blocks(F.col("html"), tag)).alias("pos", "raw"))
    return own.select("page_id", F.col("pos").cast("long").alias("pos"), strip_tags(F.col("raw"), entities).alias("text")).where("text is not null")


def numbered(lines: Column) -> Column:
    """array<long>: numbers at the start of lines."""
    return F.transform(F.filter(lines, lambda x: F.rlike(x, F.lit(r"^\(?\d+[.)]"))), lambda x: F.regexp_extract(x, r"(\d+)", 1).cast("long"))


def accept(numbers: Column, jump: int = 4) -> Column:
    """Numbers that continue a sequence: the first 1, then each n above the last accepted by at most `jump`."""
    def step(s: Column, n: Column) -> Column:
        ok = ((s["last"] == 0) & (n == 1)) | ((s["last"] > 0) & (n > s["last"]) & (n <= s["last"] + jump))
        return F.struct(F.when(ok, n).otherwise(s["last"]).alias("last"), F.when(ok, F.concat(s["out"], F.array(n))).otherwise(s["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("last"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(numbers, start, step, lambda s: s["out"])


def clauses(text: Column) -> Column:
    """array<struct<n, text>>: clauses marked (1), (2), ... at line starts; null unless there are two or more and they
    run from 1 without gaps."""
    marks = F.regexp_extract_all(text, F.lit(r"(?m)^\((\d+)\)"), F.lit(1))
    numbers = F.transform(marks, lambda x: x.try_cast("int"))
    parts = F.slice(F.split(text, r"(?m)^\(\d+\)"), F.lit(2), F.greatest(F.size(marks), F.lit(1)))
    whole = F.transform(F.arrays_zip(numbers.alias("n"), parts.alias("t")), lambda x: F.struct(x["n"].alias("n"), F.regexp_replace(x["t"], r"^\s+|\s+$", "").alias("text")))
    return F.when((F.size(marks) >= 2) & (numbers == F.sequence(F.lit(1), F.greatest(F.size(marks), F.lit(1)))), whole)


def carry(rows: DataFrame, group: str, order: str, mark: str) -> DataFrame:
    """Rows with `section`: the last mark at or before them in their group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(mark, ignorenulls=True).over(w))


def previous_line(rows: DataFrame, group: str, order: str, number: str, original: str, text: str) -> DataFrame:
    """Rows that have `text`, with `matched`: the last `original` before them in their group, if it has the same number.

    A row has either an original or a text, and a number."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(original).isNotNull(), F.struct(F.col(number).alias("n"), F.col(original).alias("o"))), ignorenulls=True).over(w)
    own = rows.withColumn("_last", last).where(F.col(text).isNotNull())
    return own.withColumn("matched", F.when(F.col("_last.n") == F.col(number), F.col("_last.o"))).drop("_last")


def ranges(keys: DataFrame, key: str, n: int | None = None) -> Callable[[Column], Column]:
    """A Column function: the range, from 0, that a key falls into; ranges hold about equally many of the keys (numbers,
    dates or timestamps). Only the ends of ranges come to the driver."""
    n = n or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ends = keys.select(F.percentile_approx(key, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    kind, ends = keys.schema[key].dataType, list(dict.fromkeys(ends))
    bounds = F.array(*[F.lit(str(e)).cast(kind) for e in ends]).cast(f"array<{kind.simpleString()}>")
    steps = [1 << i for i in reversed(range(len(ends).bit_length()))]

    def bucket(k: Column) -> Column:
        if not ends:
            return F.lit(0)
        halved = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(F.coalesce(F.get(bounds, at + s - 1) <= k, F.lit(False)), at + s).otherwise(at))
        return F.coalesce(halved, F.lit(0))

    return bucket


def asof(rows: DataFrame, starts: DataFrame, key: str, start: str, by: Sequence[str] = ()) -> DataFrame:
    """rows with the columns of the last of `starts` at or before their key (with equal `by`), null before the first and
    for null keys or `by`. Starts are unique.

    Distinct keys and starts are sorted together within ranges, where the last start is carried forward; a second pass
    over one row per range carries it from range to range. Then rows look their key up: no side need be small, and a
    key that very many rows share is one key.
    """
    by = list(by)
    known = starts.where(F.col(start).isNotNull()).select(*by, F.col(start).alias("_k"), F.struct(*[c for c in starts.columns if c not in by]).alias("_s"))
    both = known.unionByName(rows.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("_k")), allowMissingColumns=True)
    own = both.groupBy(*by, "_k").agg(F.first("_s", True).alias("_s"))
    own = own.withColumn("_b", ranges(both.select("_k"), "_k")(F.col("_k")))
    here = Window.partitionBy(*by, "_b").orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy(*by, "_b").agg(F.max_by("_s", F.when(F.col("_s").isNotNull(), F.col("_k"))).alias("_t"))
    carried = carried.select(*by, "_b", F.last("_t", True).over(before).alias("_t"))  # a row per range
    found = own.withColumn("_l", F.last("_s", True).over(here)).join(carried, [*by, "_b"])
    found = found.select(*[F.col(c).alias(f"_by_{c}") for c in by], "_k", F.coalesce("_l", "_t").alias("_f")).where("_f is not null")
    same = [F.col(c) == F.col(f"_by_{c}") for c in by]
    out = rows.join(found, functools.reduce(lambda a, b: a & b, same, F.col(key) == F.col("_k")), "left")
    return out.select(*rows.columns, "_f.*")


def supplement(base: DataFrame, side: DataFrame, key: str, column: str) -> DataFrame:
    """base with `column` taken from a side table where that has one, and `supplied`; rows and their number stay."""
    own = side.select(key, F.col(column).alias("_side")).where("_side is not null")
    return base.join(own, key, "left").withColumn("supplied", F.col("_side").isNotNull()).withColumn(column, F.coalesce("_side", column)).drop("_side")


def append_missing(base: DataFrame, extra: DataFrame, *key: str) -> DataFrame:
    """base and those rows of extra whose key base lacks."""
    return base.unionByName(extra.join(base.select(*key), list(key), "left_anti").select(base.columns))


def siblings(rows: DataFrame, container: str, k: int = 3, seed: str = "s") -> DataFrame:
    """id, sibling, place: for each id k others of its container, in an order by hash, and where a container has fewer,
    others of all rows. Only the first few of a container, and of all, are joined."""
    own = rows.select("id", F.col(container).alias("c"), F.md5(F.concat(F.lit(seed), F.col("id").cast("string"))).alias("h"))
    w = Window.partitionBy("c").orderBy("h", "id")
    first = own.withColumn("p", F.row_number().over(w)).where(F.col("p") <= k + 1).select("c", F.col("id").alias("sibling"), "h")
    picks = own.select("id", "c").join(first, "c").where("id <> sibling").select("id", "sibling", "h", F.lit(0).alias("far"))
    few = own.select("id").join(picks.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id", "left").where(F.coalesce("n", F.lit(0)) < k).select("id")
    everywhere = F.broadcast(own.orderBy("h", "id").limit(2 * k + 1).select(F.col("id").alias("sibling"), "h"))  # 2 k + 1 rows
    fill = few.crossJoin(everywhere).where("id <> sibling").join(picks.select("id", "sibling"), ["id", "sibling"], "left_anti")
    both = picks.unionByName(fill.select("id", "sibling", "h", F.lit(1).alias("far")))
    place = F.row_number().over(Window.partitionBy("id").orderBy("far", "h", "sibling"))
    return both.withColumn("place", place).where(F.col("place") <= k).select("id", "sibling", "place")


def monotone(rows: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """Rows whose value is above all before it in their group."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_m", F.max(value).over(w)).where(F.col("_m").isNull() | (F.col(value) > F.col("_m"))).drop("_m")


def gaps(rows: DataFrame, group: str, number: str) -> DataFrame:
    """group, present, missing: numbers from 1 to the largest that a group lacks."""
    own = rows.groupBy(group).agg(F.collect_set(F.col(number).cast("int")).alias("s"), F.max(F.col(number).cast("int")).alias("m"))
    lost = F.array_sort(F.array_except(F.sequence(F.lit(1), F.greatest("m", F.lit(1))), "s"))
    return own.select(group, F.size("s").cast("long").alias("present"), F.array_join(lost.cast("array<string>"), ",").alias("missing")).where("missing <> ''")


@functools.cache
def _marked() -> tuple[str, str]:
    """Characters that are one of a to z with marks, and those letters."""
    own = [(chr(i), next((x for x in unicodedata.normalize("NFD", chr(i)) if "a" <= x <= "z"), "")) for i in range(128, 0x110000) if unicodedata.decomposition(chr(i))]
    return "".join(c for c, x in own if x), "".join(x for _, x in own if x)


def skeleton(text: pd.Series) -> pd.Series:
    """The letters a to z without marks and h, m as n, runs squeezed: spellings of one word in different romanisations
    agree."""
    plain = text.fillna("").str.lower().str.normalize("NFD").str.replace(r"[^a-z]|h", "", regex=True)
    return plain.str.replace("m", "n").str.replace(r"(.)\1+", r"\1", regex=True)


def signature(text: Column) -> Column:
    """`skeleton` as an expression: texts don't pass through Python."""
    marked, plain = _marked()
    low = F.lower(F.coalesce(text, F.lit("")))
    bare = F.when(F.octet_length(low) > F.length(low), F.translate(low, marked, plain)).otherwise(low)
    return F.regexp_replace(F.replace(F.regexp_replace(bare, "[^a-gi-z]++", ""), F.lit("m"), F.lit("n")), r"(.)\1++", "$1")


def signed(lines: DataFrame) -> DataFrame:
    """Lines (group, ord, text) as group, ord, sig, as columns of their own: both editions may come from one table."""
    return lines.select(F.col("group").alias("group"), F.col("ord").alias("ord"), signature(F.col("text").cast("string")).alias("sig"))


def anchors(left: DataFrame, right: DataFrame) -> DataFrame:
    """group, l, r: lines (group, ord, sig) whose signatures stand once on each side, kept where r rises."""
    # signatures of long lines go by their digests; blank ones are left out after the count, so that each is made once
    digest = F.coalesce(F.sha2("sig", 256), F.lit(""))
    once = lambda d, name: d.groupBy("group", digest.alias("sig")).agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias(name), F.max(F.length("sig")).alias("_n")).where("n = 1 and _n > 0").select("group", "sig", name)
    pairs = once(left, "l").join(once(right, "r"), ["group", "sig"])
    # the largest r so far, carried within ranges of l and then from range to range
    own = pairs.withColumn("_b", ranges(pairs, "l")(F.col("l")))
    before = Window.partitionBy("group").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = own.groupBy("group", "_b").agg(F.max("r").alias("_m")).select("group", "_b", F.max("_m").over(before).alias("_c"))
    here = Window.partitionBy("group", "_b").orderBy("l").rowsBetween(Window.unboundedPreceding, -1)
    most = own.withColumn("_h", F.max("r").over(here)).join(carried, ["group", "_b"]).withColumn("_m", F.greatest("_h", "_c"))
    return most.where(F.col("_m").isNull() | (F.col("r") > F.col("_m"))).select("group", "l", "r")


def align(left: DataFrame, right: DataFrame, *, least: float = 0.86, high: float = 0.97) -> DataFrame:
    """group, l, r, ratio, confidence: pairs of lines (group, ord, text) of two editions in the same order.

    Lines whose skeletons occur once on both sides are anchors, kept where they rise. The stretches between two anchors
    are matched each for itself: a line takes the most similar free line of its stretch that comes after those taken.
    Only a stretch is in one place at once, however long the editions are. Signatures and anchors are persisted, on disk
    where they outgrow memory, as several steps read them.
    """
    a, b = signed(left).persist(), signed(right).persist()
    sure = anchors(a, b).persist()

    def stretch(lines: DataFrame, side: str) -> DataFrame:
        """Lines that are no anchors, with the anchor before them."""
        marks = sure.select("group", F.col(side).alias("_at"), F.col("l").alias("_anchor"))
        return asof(lines, marks, "ord", "_at", ["group"]).where(F.col("_at").isNull() | (F.col("_at") < F.col("ord"))).select("group", F.coalesce("_anchor", F.lit(-(1 << 62))).alias("anchor"), "ord", "sig")

    def fill(key, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        from difflib import SequenceMatcher

        def ratio(s: str, t: str, floor: float) -> float:
            """0 where an upper bound shows that the ratio is under `floor`."""
            if not s or not t or 2.0 * min(len(s), len(t)) / (len(s) + len(t)) < floor:
                return 0.0
            m = SequenceMatcher(None, s, t)
            return m.ratio() if m.quick_ratio() >= floor else 0.0

        a, b = a.sort_values("ord"), b.sort_values("ord")
        theirs, out, at = b["sig"].tolist(), [], 0
        for i, s in zip(a["ord"], a["sig"]):
            best, j = 0.0, at
            for t in range(at, len(theirs)):
                if (found := ratio(s, theirs[t], max(least, best))) > best:
                    best, j = found, t
                if best >= 0.999:
                    break
            if best >= least:
                out.append((key[0], int(i), int(b["ord"].iloc[j]), round(best, 6)))
                at = j + 1
        return pd.DataFrame(out, columns=["group", "l", "r", "ratio"])

    own = lambda d: d.groupBy("group", "anchor")
    filled = own(stretch(a, "l")).cogroup(own(stretch(b, "r"))).applyInPandas(fill, "group string, l long, r long, ratio double")
    both = sure.select(F.col("group").cast("string").alias("group"), F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), F.lit(1.0).alias("ratio")).unionByName(filled)
    return both.withColumn("confidence", F.when(F.col("ratio") >= high, F.lit("high")).otherwise(F.lit("medium")))
