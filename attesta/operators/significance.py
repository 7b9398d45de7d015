"""Intervals and tests over scored items: Poisson bootstrap, paired or not, and McNemar's test."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: How often an item is drawn in a replicate: Poisson with mean 1, as the shares of draws that are above 0, 1, 2, ...
DRAWS = tuple(itertools.accumulate(math.exp(-1) / math.factorial(i) for i in range(9)))
#: Discordant pairs up to which McNemar's test is exact.
EXACT = 1000


def draws(item: Column, replicate: Column, seed: str = "") -> Column:
    """The item's weight in a replicate: by hash alone, so that every system is weighed on the same draw, wherever and
    whenever its row is read."""
    hashed = F.md5(F.concat_ws(":", F.lit(seed), item.cast("string"), replicate.cast("string")))
    u = F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") / float(1 << 32)
    return sum((F.when(u >= p, 1).otherwise(0) for p in DRAWS), F.lit(0))


def _replicates(rows: DataFrame, item: str, n: int, seed: str) -> DataFrame:
    """rows with `replicate`, from 0 (all rows once) to n, and their weight `w`; what isn't drawn goes at once."""
    own = rows.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n))))
    w = F.when(F.col("replicate") == 0, 1).otherwise(draws(F.col(item), F.col("replicate"), seed))
    return own.withColumn("w", w).where("w > 0")


def _summary(values: DataFrame, keys: Sequence[str], names: Sequence[str], level: float, more=lambda c: []) -> DataFrame:
    """keys, metric, estimate, lo, hi of values (keys, replicate, names)."""
    long_ = values.select(*keys, "replicate", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names])))
    drawn = F.when(F.col("replicate") > 0, F.col("value"))
    ends = [F.percentile(drawn, F.lit((1 - level) / 2)).alias("lo"), F.percentile(drawn, F.lit((1 + level) / 2)).alias("hi")]
    return long_.groupBy(*keys, "metric").agg(F.max(F.when(F.col("replicate") == 0, F.col("value"))).alias("estimate"), *ends, *more(drawn))


def intervals(scores: DataFrame, metrics: Sequence[str], by: Sequence[str] = (), *, item: str = "item_id", n: int = 200, level: float = 0.95, seed: str = "") -> DataFrame:
    """by, metric, estimate, lo, hi: means of metrics over items, nulls skipped, with percentile intervals from n
    replicates. All replicates are summed in one pass: a task keeps one row per group and replicate.

    A metric that is null throughout, or in a replicate, is null there; an empty table gives no rows."""
    by = list(by)
    drawn = _replicates(scores.select(*by, item, *metrics), item, n, seed)
    sums = [(F.sum(F.col("w") * F.col(m)) / F.nullif(F.sum(F.when(F.col(m).isNotNull(), F.col("w"))), F.lit(0))).alias(m) for m in metrics]
    return _summary(drawn.groupBy(*by, "replicate").agg(*sums), by, metrics, level)


def paired(scores: DataFrame, metrics: Sequence[str], system: str, a: str, b: str, by: Sequence[str] = (), *, item: str = "item_id", n: int = 200, level: float = 0.95, seed: str = "") -> DataFrame:
    """by, metric, estimate, lo, hi, p: means of system a less those of b over the items that both have a value for, each
    replicate weighing both alike; p is twice the smaller share of replicates on either side of 0, 1 at most."""
    by = list(by)
    own = lambda s: scores.where(F.col(system) == s).select(*by, item, *[F.col(m).cast("double").alias(f"_{s}_{m}") for m in metrics])
    both = own(a).join(own(b), [*by, item]).select(*by, item, *[(F.col(f"_{a}_{m}") - F.col(f"_{b}_{m}")).alias(m) for m in metrics])
    drawn = _replicates(both, item, n, seed)
    sums = [(F.sum(F.col("w") * F.col(m)) / F.nullif(F.sum(F.when(F.col(m).isNotNull(), F.col("w"))), F.lit(0))).alias(m) for m in metrics]
    side = lambda c: [F.least(F.lit(1.0), 2 * F.least(F.avg((c <= 0).cast("double")), F.avg((c >= 0).cast("double")))).alias("p")]
    return _summary(drawn.groupBy(*by, "replicate").agg(*sums), by, metrics, level, side)


def mcnemar(outcomes: DataFrame, system: str, right: str, a: str, b: str, by: Sequence[str] = (), *, item: str = "item_id") -> DataFrame:
    """by, both, only_a, only_b, neither, statistic (with continuity correction), p, of items that both systems have a
    true or false for. p is exact up to 1,000 discordant pairs, else from the chi-square distribution; without any it
    and the statistic are null."""
    by = list(by)
    own = lambda s, n: outcomes.where((F.col(system) == s) & F.col(right).isNotNull()).groupBy(*by, item).agg(F.bool_and(right).alias(n))
    x, y = F.col("_a"), F.col("_b")
    counts = own(a, "_a").join(own(b, "_b"), [*by, item]).groupBy(*by).agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))
    n, least = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    step = lambda s, i: F.struct((s["t"] * (n - i) / (i + 1)).alias("t"), (s["p"] + s["t"]).alias("p"))
    start = F.struct(F.pow(F.lit(0.5), n.cast("double")).alias("t"), F.lit(0.0).alias("p"))
    exact = F.least(F.lit(1.0), 2 * F.aggregate(F.sequence(F.lit(0).cast("long"), least), start, step, lambda s: s["p"]))
    statistic = F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0)), F.lit(2)) / n
    out = counts.withColumn("statistic", F.when(n > 0, statistic))
    return out.withColumn("p", F.when(n == 0, None).when(n <= EXACT, exact).otherwise(_erfc(F.sqrt(F.col("statistic") / 2))))


def _erfc(x: Column) -> Column:
    """The complementary error function for x >= 0, to about 1e-7 of its value."""
    # The coefficients of a published Chebyshev fit, from the highest power down.
    fit = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    t = 1 / (1 + x / 2)
    poly = F.lit(fit[0])
    for c in fit[1:]:
        poly = poly * t + F.lit(c)
    return t * F.exp(-x * x + poly)
