"""Citations as ranges: gold passages and cited ranges over the order of ids, and how far they overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window, functions as F

KEPT = StorageLevel.MEMORY_AND_DISK


def located(spans: DataFrame, units: DataFrame) -> DataFrame:
    """spans (item_id, corpus, id_start, id_end) with lo and hi, the places of their ends in units (corpus, id, ord), and
    `valid`: both ends exist in the corpus and don't run backwards. A null id_end is the start itself."""
    place = units.groupBy("corpus", "id").agg(F.min("ord").alias("ord"))
    own = spans.withColumn("id_end", F.coalesce("id_end", "id_start"))
    own = own.join(place.select("corpus", F.col("id").alias("id_start"), F.col("ord").alias("lo")), ["corpus", "id_start"], "left")
    own = own.join(place.select("corpus", F.col("id").alias("id_end"), F.col("ord").alias("hi")), ["corpus", "id_end"], "left")
    return own.withColumn("valid", F.coalesce(F.col("lo") <= F.col("hi"), F.lit(False)))


def overlaps(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Pairs of ranges with equal `by` that overlap: `by`, l, r; left has l, lo, hi, right has r, lo, hi (longs, both
    ends in).

    A range lies in at most two bins as wide as itself, rounded up to a power of two. Each is put into the bins of its
    own width, and looks for wider ones of the other side in the bins of their width: an equi-join by bin, with at most
    two bins for each width that occurs, however long the ranges are.
    """

    def sized(d: DataFrame, name: str) -> DataFrame:
        size = F.length(F.bin(F.col("hi") - F.col("lo")))  # a range isn't longer than 2 to the power of its size
        return d.select(*by, name, F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"), size.alias(f"{name}_size"))

    def binned(d: DataFrame, name: str) -> DataFrame:
        return d.withColumn("bin", F.explode(F.array_distinct(F.array(*[F.expr(f"shiftright({name}_{end}, level)") for end in ("lo", "hi")]))))

    def meet(narrow: DataFrame, n: str, wide: DataFrame, w: str, strictly: bool) -> DataFrame:
        sizes = sorted(r[0] for r in wide.select(f"{w}_size").distinct().collect())  # 64 at most
        own = F.col(f"{n}_size")
        levels = F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda s: (s > own) if strictly else (s >= own))
        asked = binned(narrow.withColumn("level", F.explode(levels)), n)
        met = asked.join(binned(wide.withColumn("level", F.col(f"{w}_size")), w), [*by, "level", "bin"])
        return met.where("l_lo <= r_hi AND r_lo <= l_hi").select(*by, "l", "r")

    a, b = sized(left, "l"), sized(right, "r")
    return meet(a, "l", b, "r", False).union(meet(b, "r", a, "l", True)).distinct()


def merged(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ranges (by, lo, hi) without overlaps: those that overlap or touch become one."""
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    own = spans.select(*by, "lo", "hi").withColumn("_m", F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    own = own.withColumn("_n", F.sum(F.when(F.col("lo") <= F.col("_m") + 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*by, "_n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_n")


def score(cited: DataFrame, gold: DataFrame, units: DataFrame, *, tol: int = 0) -> DataFrame:
    """One row per item that has a range, cited or gold: item_id, n_cited, n_gold, n_invalid (ranges whose ends the
    corpus lacks, or has the wrong way round; they match nothing, and count), p and r (share of cited ranges that
    overlap a gold one, and of gold ranges that a cited one overlaps, within `tol` units), f1, unit_p, unit_r (share of
    the units of all valid cited ranges that gold covers, and the other way; null without units).

    cited, gold: item_id, corpus, id_start, id_end (null: the start). Repeated ranges count once."""
    key = ["item_id", "corpus"]

    def own(d: DataFrame) -> DataFrame:
        return located(d.select(*key, "id_start", "id_end").withColumn("id_end", F.coalesce("id_end", "id_start")).distinct(), units)

    # located and merged ranges are read by several steps and by the counts of sizes: kept, on disk where memory ends
    c, g = own(cited).persist(KEPT), own(gold).persist(KEPT)
    named = lambda d, n: d.where("valid").withColumn(n, F.struct("id_start", "id_end")).select(*key, n, F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    wide = named(c, "l").withColumns({"lo": F.col("lo") - tol, "hi": F.col("hi") + tol})
    met = overlaps(wide, named(g, "r"), key).groupBy("item_id").agg(F.count_distinct("corpus", "l").alias("hit_c"), F.count_distinct("corpus", "r").alias("hit_g"))

    mc, mg = merged(named(c, "l"), key).persist(KEPT), merged(named(g, "r"), key).persist(KEPT)
    both = overlaps(mc.withColumn("l", F.struct("lo", "hi")), mg.withColumn("r", F.struct("lo", "hi")), key)
    shared = both.groupBy("item_id").agg(F.sum(F.least("l.hi", "r.hi") - F.greatest("l.lo", "r.lo") + 1).alias("shared"))
    length = lambda d, n: d.groupBy("item_id").agg(F.sum(F.col("hi") - F.col("lo") + 1).alias(n))
    count = lambda d, n: d.groupBy("item_id").agg(F.count(F.lit(1)).alias(n), F.count_if(~F.col("valid")).alias(f"{n}_bad"))
    out = count(c, "n_cited").join(count(g, "n_gold"), "item_id", "full")
    for part in (met, shared, length(mc, "len_c"), length(mg, "len_g")):
        out = out.join(part, "item_id", "left")
    out = out.na.fill(0)
    share = lambda hits, of, other: F.when(F.col(of) > 0, F.col(hits) / F.col(of)).otherwise(F.when(F.col(other) == 0, 1.0).otherwise(0.0))
    out = out.withColumns({"p": share("hit_c", "n_cited", "n_gold"), "r": share("hit_g", "n_gold", "n_cited"), "n_invalid": F.col("n_cited_bad") + F.col("n_gold_bad")})
    f1 = F.when(F.col("p") + F.col("r") > 0, 2 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).otherwise(0.0)
    units_of = lambda of: F.when(F.col(of) > 0, F.col("shared") / F.col(of))
    return out.select("item_id", "n_cited", "n_gold", "n_invalid", "p", "r", f1.alias("f1"), units_of("len_c").alias("unit_p"), units_of("len_g").alias("unit_r"))
