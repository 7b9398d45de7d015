"""Set measures over arrays of ids, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def share(hits: Column, of: Column, other: Column) -> Column:
    """hits / of; of an empty set 1 if the other is empty as well, else 0."""
    return F.when(of > 0, hits / of).otherwise(F.when(other == 0, 1.0).otherwise(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)


def prf(matched_cited: Column, matched_gold: Column, cited: Column, gold: Column) -> Column:
    def of(v: Column) -> Column:
        return F.struct(v["p"].alias("p"), v["r"].alias("r"), f1(v["p"], v["r"]).alias("f1"))

    pair = F.struct(share(matched_cited, cited, gold).alias("p"), share(matched_gold, gold, cited).alias("r"))
    return F.get(F.transform(F.array(pair), of), F.lit(0))


def exact_prf(cited: Column, gold: Column) -> Column:
    hits = F.size(F.array_intersect(cited, gold))
    return prf(hits, hits, F.size(F.array_distinct(cited)), F.size(F.array_distinct(gold)))


def span_prf(cited: Column, gold: Column, near) -> Column:
    """near(c, g): whether two ids count as the same place."""
    c, g = F.array_distinct(cited), F.array_distinct(gold)
    of_c = F.size(F.filter(c, lambda x: F.exists(g, lambda y: near(x, y))))
    of_g = F.size(F.filter(g, lambda y: F.exists(c, lambda x: near(x, y))))
    return prf(of_c, of_g, F.size(c), F.size(g))


def fraction_in(part: Column, whole: Column) -> Column:
    """Share of distinct elements that are in the other set; null for no elements."""
    d = F.array_distinct(part)
    return F.when(F.size(d) > 0, F.size(F.array_intersect(d, whole)) / F.size(d))


def masi_distance(a: Column, b: Column) -> Column:
    """1 - Jaccard times monotonicity (equal 1, subset 2/3, overlap 1/3, disjoint 0); two empty sets are equal."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    same = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    subset = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    jaccard = F.when(either == 0, F.lit(1.0)).otherwise(both / F.greatest(either, F.lit(1)))
    mono = F.when(same, 1.0).when(both == 0, 0.0).when(subset, 2.0 / 3).otherwise(1.0 / 3)
    return 1.0 - jaccard * mono
