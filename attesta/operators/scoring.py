"""Scores of answers against gold citations, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from attesta.functions import sets


def rate(condition: Column, base: Column | None = None) -> Column:
    """Share of rows with the condition among those of base; null where base has none."""
    return F.avg(F.when(base, condition.cast("double")) if base is not None else condition.cast("double"))


def existing(outputs: DataFrame, units: DataFrame) -> DataFrame:
    """outputs with `existing`, the cited ids that the id space has; ids are joined, never collected."""
    cites = outputs.select("item_id", F.explode(F.array_distinct("cited")).alias("id"))
    there = cites.join(units.select("id").distinct(), "id", "left_semi").groupBy("item_id").agg(F.collect_set("id").alias("existing"))
    return outputs.join(there, "item_id", "left").withColumn("existing", F.coalesce("existing", F.array().cast("array<string>")))


def score_items(rows: DataFrame, near=None) -> DataFrame:
    """One row per item with gold, near_miss, must_abstain, answerable, cited, retrieved, existing, abstained: all its
    scores. near(c, g): adjacency for the span measures, equality by default. support, where rows have it, maps ids to a
    judge's labels, which go before gold: without one, gold ids are "full", others "none"."""
    near = near or (lambda c, g: c == g)
    c, g = F.array_distinct("cited"), F.array_distinct("gold")
    wrong = F.array_except(c, g)
    exact, span = sets.exact_prf(c, g), sets.span_prf(c, g, near)
    exist_error = F.size(F.array_except(c, F.col("existing"))) > 0
    label = lambda x: F.when(F.array_contains(g, x), "full").otherwise("none")
    if "support" in rows.columns:
        known = F.coalesce("support", F.create_map().cast("map<string,string>"))
        judged = lambda x: F.coalesce(F.element_at(known, x), label(x))
    support_error = F.exists("existing", lambda x: (judged if "support" in rows.columns else label)(x) == "none")
    kept = [x for x in rows.columns if x not in ("gold", "near_miss", "cited", "retrieved", "existing", "support")]
    return rows.select(
        *kept,
        F.size(c).cast("long").alias("n_cited"),
        sets.fraction_in(c, F.col("existing")).alias("cer"),
        sets.fraction_in(c, F.col("retrieved")).alias("cg"),
        exact["p"].alias("p"), exact["r"].alias("r"), exact["f1"].alias("f1"), span["f1"].alias("span_f1"),
        (exist_error | support_error).alias("misattributed"), exist_error.alias("exist_error"), support_error.alias("support_error"),
        F.size(F.array_intersect(wrong, F.col("near_miss"))).cast("long").alias("near_missed"), F.size(wrong).cast("long").alias("wrong"),
    )


def metrics() -> list[Column]:
    """The block of aggregates over scored items."""
    citing, unanswerable = F.col("n_cited") > 0, F.col("must_abstain")
    r6 = lambda c, n: F.round(c, 6).alias(n)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(citing).alias("n_citing"),
        F.count_if(unanswerable).alias("n_unanswerable"),
        r6(F.avg("cer"), "cer"),
        r6(F.avg("cg"), "cg"),
        r6(F.avg("f1"), "f1_exact"),
        r6(F.avg("span_f1"), "f1_span"),
        r6(rate(F.col("misattributed"), citing), "mar"),
        r6(rate(F.col("exist_error"), citing), "mar_exist"),
        r6(rate(F.col("support_error"), citing), "mar_support"),
        r6(F.try_divide(F.sum("near_missed"), F.sum("wrong")), "nmr"),
        r6(rate(F.col("abstained") & ~citing, unanswerable), "abstention_accuracy"),
        r6(rate(citing, unanswerable), "over_citation_rate"),
        r6(rate(F.col("abstained"), ~unanswerable), "wrong_abstention_rate"),
    ]
