"""Item rules and id-space checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The enumerations of items.
QUESTION_TYPES = ("factual", "retrieval", "conceptual", "interpretive", "unanswerable")
AMBIGUITY = ("low", "medium", "high")
SUPPORT = ("full", "partial", "none")
LANGS = ("hi", "sa", "ta", "pa", "pi")


def _issue(condition: Column, level: str, rule: str) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule")))


def missing(items: DataFrame, units: DataFrame, column: str) -> DataFrame:
    """item_id, n: distinct ids of a column that the id space lacks."""
    ids = items.select("item_id", F.explode(F.array_distinct(column)).alias("id"))
    return ids.join(units.select("id").distinct(), "id", "left_anti").groupBy("item_id").agg(F.count(F.lit(1)).alias("n"))


def issues(items: DataFrame, units: DataFrame, parses=None) -> DataFrame:
    """item_id, level, rule: one row per rule that an item breaks. parses(id): whether an id of the space keeps to the
    corpus's grammar. answer_support (array<struct<citation, support>>), translations (map<lang, struct<question,
    gold_answer>>) and translations_json (a string that should hold that map) are checked where items have them."""
    own = items.join(missing(items, units, "gold").withColumnRenamed("n", "no_gold"), "item_id", "left")
    own = own.join(missing(items, units, "near_miss").withColumnRenamed("n", "no_near"), "item_id", "left")
    if parses:
        there = items.select("item_id", F.explode(F.array_distinct("gold")).alias("id")).join(units.select("id").distinct(), "id", "left_semi")
        bad = there.where(~F.coalesce(parses(F.col("id")), F.lit(False))).groupBy("item_id").agg(F.count(F.lit(1)).alias("bad_gold"))
        own = own.join(bad, "item_id", "left")
    gold, near = F.size(F.array_distinct("gold")), F.size(F.array_distinct("near_miss"))
    unanswerable, abstain = F.col("question_type") == "unanswerable", F.col("must_abstain")
    has = lambda c: c in items.columns
    no = F.lit(False)
    bad_ids = F.col("bad_gold") > 0 if parses else no
    cited = F.exists("answer_support", lambda x: x["citation"].isNotNull() & ~F.array_contains("gold", x["citation"])) if has("answer_support") else no
    labels = F.exists("answer_support", lambda x: ~F.coalesce(x["support"], F.lit("")).isin(*SUPPORT)) if has("answer_support") else no
    langs = F.exists(F.map_keys("translations"), lambda x: ~x.isin(*LANGS)) if has("translations") else no
    asked = F.exists(F.map_entries("translations"), lambda e: e["key"].isin(*LANGS) & (F.trim(F.coalesce(e["value"]["question"], F.lit(""))) == "")) if has("translations") else no
    kind = F.col("translations_json").isNotNull() & ~F.rlike("translations_json", F.lit(r"(?s)^\s*\{.*\}\s*$")) if has("translations_json") else no
    rules = F.array(
        _issue(~F.coalesce(F.col("question_type"), F.lit("")).isin(*QUESTION_TYPES), "error", "question_type"),
        _issue(~F.coalesce(F.col("ambiguity"), F.lit("")).isin(*AMBIGUITY), "error", "ambiguity"),
        _issue(F.trim(F.coalesce("question", F.lit(""))) == "", "error", "empty_question"),
        _issue(F.col("no_gold") > 0, "error", "gold_not_in_space"),
        _issue(F.col("no_near") > 0, "error", "near_miss_not_in_space"),
        _issue(F.size(F.array_intersect("gold", "near_miss")) > 0, "error", "overlap"),
        _issue(unanswerable != abstain, "error", "abstain_mismatch"),
        _issue(abstain & (gold > 0), "error", "abstain_with_gold"),
        _issue(abstain & F.col("answerable"), "error", "abstain_answerable"),
        _issue(abstain & (F.coalesce("abstain_reason", F.lit("")) == ""), "warn", "no_abstain_reason"),
        _issue(~abstain & (gold == 0), "error", "no_gold"),
        _issue(bad_ids, "error", "gold_grammar"),
        _issue(cited, "warn", "support_not_in_gold"),
        _issue(labels, "error", "support_label"),
        _issue(F.col("question_type").isin("factual", "retrieval") & (near < 2), "warn", "few_distractors"),
        _issue(kind, "error", "translations_kind"),
        _issue(langs, "error", "translation_lang"),
        _issue(asked, "error", "translation_question"),
    )
    return own.select("item_id", F.inline(F.filter(rules, lambda x: x.isNotNull())))


def summary(items: DataFrame, found: DataFrame) -> DataFrame:
    """One row: items, errors, warnings, items with errors, duplicate ids, ok."""
    n = items.agg(F.count(F.lit(1)).alias("n_items"))
    per = found.agg(F.count_if(F.col("level") == "error").alias("n_errors"), F.count_if(F.col("level") == "warn").alias("n_warnings"), F.count_distinct(F.when(F.col("level") == "error", F.col("item_id"))).alias("n_bad_items"))
    twice = duplicates(items, "item_id").agg(F.count(F.lit(1)).alias("n_duplicates"))
    return n.join(per).join(twice).withColumn("ok", (F.col("n_errors") == 0) & (F.col("n_duplicates") == 0))  # one row each


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
