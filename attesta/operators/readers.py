"""Readers and verifiers as relations: models' judgements come in as tables, the control flow is plain columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_cites(ranked: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    """item_id, cited (the first k), retrieved (all), for items whose best result scores `least` or more."""
    in_order = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda x: x["id"])
    place = F.struct("rank", "id")
    own = ranked.groupBy("item_id").agg(in_order(F.when(F.col("rank") <= k, place)).alias("cited"), in_order(place).alias("retrieved"), F.max("score").alias("best"))
    return own.select("item_id", F.when(F.col("best") >= least, F.col("cited")).otherwise(F.array().cast("array<string>")).alias("cited"), "retrieved")


def decide(answers: DataFrame) -> DataFrame:
    """Model answers (item_id, answerable, answer, citations) -> cited, abstained: abstain if the model says so, or if
    there is neither a citation nor an answer; a failed call (all null) abstains; abstaining clears citations."""
    none = F.array().cast("array<string>")
    cites = F.coalesce("citations", none)
    blank = F.trim(F.coalesce("answer", F.lit(""))) == ""
    abstained = (F.coalesce("answerable", F.lit(True)) == F.lit(False)) | ((F.size(cites) == 0) & blank)
    return answers.select("item_id", F.when(abstained, none).otherwise(cites).alias("cited"), abstained.alias("abstained"))


def verify_repair(items: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """judged: item_id, id, rank, grounded. The grounded ones of the first k stand; else the first grounded candidate
    does; else the item abstains."""
    place = F.struct("rank", "id")
    kept = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("grounded") & (F.col("rank") <= k), place))), lambda x: x["id"]), ",")
    own = judged.groupBy("item_id").agg(F.nullif(kept, F.lit("")).alias("kept"), F.min_by(F.when(F.col("grounded"), F.col("id")), F.when(F.col("grounded"), F.col("rank"))).alias("best"))
    own = items.select("item_id").join(own, "item_id", "left")
    return own.select("item_id", F.coalesce("kept", "best", F.lit("")).alias("cited"), (F.col("kept").isNull() & F.col("best").isNull()).alias("abstained"), (F.col("kept").isNull() & F.col("best").isNotNull()).alias("repaired"))


def joint_select(items: DataFrame, candidates: DataFrame, picks: DataFrame) -> DataFrame:
    """picks: item_id, best_id or null; one that is no candidate counts as none. repaired: the pick isn't the first."""
    valid = picks.select("item_id", F.col("best_id").alias("id")).join(candidates.select("item_id", "id"), ["item_id", "id"], "left_semi")
    base = candidates.groupBy("item_id").agg(F.min_by("id", "rank").alias("base"))
    own = items.select("item_id").join(valid, "item_id", "left").join(base, "item_id", "left")
    return own.select("item_id", F.coalesce("id", F.lit("")).alias("cited"), F.col("id").isNull().alias("abstained"), F.coalesce(F.col("id") != F.col("base"), F.lit(False)).alias("repaired"))


def self_reflect(items: DataFrame, judged: DataFrame) -> DataFrame:
    """judged: item_id, id, rank, relevance, support. Incorrect candidates go; of the rest the first with support is
    cited; unknown relevance is ambiguous, unknown support none."""
    kept = judged.where(F.coalesce("relevance", F.lit("ambiguous")) != "incorrect")
    ok = F.coalesce("support", F.lit("no")).isin("fully", "partially")
    own = kept.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_kept"), F.min_by(F.when(ok, F.col("id")), F.when(ok, F.col("rank"))).alias("pick"))
    own = items.select("item_id").join(own, "item_id", "left")
    return own.select("item_id", F.coalesce("pick", F.lit("")).alias("cited"), F.col("pick").isNull().alias("abstained"), F.coalesce("n_kept", F.lit(0).cast("long")).alias("n_kept"))
