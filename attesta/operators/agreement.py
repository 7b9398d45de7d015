"""Inter-annotator agreement and adjudication over verdicts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from attesta.functions.sets import masi_distance

KEY = ["corpus", "item_id"]


def latest(verdicts: DataFrame) -> DataFrame:
    """The last verdict of each reviewer on an item; of equal times the later row. first_row keeps the place at which
    the reviewer first appeared for the item."""
    w = Window.partitionBy(*KEY, "reviewer")
    own = verdicts.withColumn("first_row", F.min("row_idx").over(w))
    return own.withColumn("_n", F.row_number().over(w.orderBy(F.desc("ts"), F.desc("row_idx")))).where("_n = 1").drop("_n")


def effective(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """What each verdict asserts: gold (sorted), question_type, ambiguity. A reject asserts no gold; an edit overrides
    what it names. known: whether the item exists."""
    own = verdicts.join(items.select("item_id", F.col("gold").alias("i_gold"), F.col("question_type").alias("i_type"), F.col("ambiguity").alias("i_ambiguity"), F.lit(True).alias("known")), "item_id", "left")
    none = F.array().cast("array<string>")
    edit = F.col("status") == "edit"
    gold = F.when(F.col("status") == "reject", none).when(edit & F.col("edit_gold").isNotNull(), F.col("edit_gold")).otherwise(F.coalesce("i_gold", none))
    return own.select(
        *KEY, "reviewer", "status", "first_row", F.coalesce("known", F.lit(False)).alias("known"), "i_type",
        F.array_sort(F.array_distinct(gold)).alias("gold"),
        F.coalesce(F.when(edit, F.nullif("edit_type", F.lit(""))), "i_type").alias("question_type"),
        F.coalesce(F.when(edit, F.nullif("edit_ambiguity", F.lit(""))), "i_ambiguity").alias("ambiguity"),
    )


def double_rated(ratings: DataFrame, value: str = "value") -> DataFrame:
    """Ratings (group, unit, rater, value) without nulls, of units with two or more; m: ratings of the unit."""
    own = ratings.where(F.col(value).isNotNull())
    return own.withColumn("m", F.count(F.lit(1)).over(Window.partitionBy("group", "unit"))).where("m >= 2")


def _alpha(own: DataFrame, distance, expected: DataFrame) -> DataFrame:
    """Alpha from ratings of units with two or more and from the disagreement `de` to expect of each group. Only values
    of one unit are paired here."""
    unit = own.groupBy("group", "unit", "m", "value").agg(F.count(F.lit(1)).alias("c"))
    a, b = unit.select("group", "unit", "m", F.col("value").alias("x"), F.col("c").alias("cx")), unit.select("group", "unit", F.col("value").alias("y"), F.col("c").alias("cy"))
    d = F.col("cx") * F.col("cy") * distance(F.col("x"), F.col("y"))
    observed = a.join(b, ["group", "unit"]).groupBy("group").agg(F.sum(d / (F.col("m") - 1)).alias("do"))
    n = own.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    value = 1 - (F.col("do") / F.col("n")) / (F.col("de") / (F.col("n") * (F.col("n") - 1)))
    return n.join(observed, "group").join(expected, "group").select("group", "n", F.when((F.col("n") >= 2) & (F.col("de") > 0), value).alias("alpha"))


def alpha(ratings: DataFrame, distance) -> DataFrame:
    """Krippendorff's alpha per group, for any distance(a, b) of values: values and counts are paired, never raters. All
    different values of a group meet; for values of many kinds see `nominal_alpha` and `masi_alpha`."""
    own = double_rated(ratings)
    pool = own.groupBy("group", "value").agg(F.count(F.lit(1)).alias("c"))
    p, q = pool.select("group", F.col("value").alias("x"), F.col("c").alias("cx")), pool.select("group", F.col("value").alias("y"), F.col("c").alias("cy"))
    expected = p.join(q, "group").groupBy("group").agg(F.sum(F.col("cx") * F.col("cy") * distance(F.col("x"), F.col("y"))).alias("de"))
    return _alpha(own, distance, expected)


def _apart(own: DataFrame) -> DataFrame:
    """group, de: ordered pairs of ratings with different values, from counts alone."""
    pool = own.groupBy("group", "value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    return pool.groupBy("group").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("de"))


def nominal_alpha(ratings: DataFrame) -> DataFrame:
    """Alpha of values that are alike or not; no two values of a group are paired."""
    own = double_rated(ratings)
    return _alpha(own, lambda a, b: F.when(a == b, 0.0).otherwise(1.0), _apart(own))


def masi_alpha(ratings: DataFrame) -> DataFrame:
    """Alpha of sets under MASI. Sets without a common element disagree wholly and equal ones not at all, so that only
    different sets that share an element meet, by a join on elements. An element that most sets hold still brings all
    of them together."""
    own = double_rated(ratings).withColumn("value", F.array_sort(F.array_distinct("value")))
    pool = own.groupBy("group", "value").agg(F.count(F.lit(1)).cast("double").alias("c"))
    each = pool.select("group", "value", "c", F.explode("value").alias("e"))
    a, b = each.select("group", "e", F.col("value").alias("x"), F.col("c").alias("cx")), each.select("group", "e", F.col("value").alias("y"), F.col("c").alias("cy"))
    both = a.join(b, ["group", "e"]).where("x < y").groupBy("group", "x", "y", "cx", "cy").agg(F.count(F.lit(1)).alias("both"))
    like = F.col("both") / (F.size("x") + F.size("y") - F.col("both")) * F.when(F.col("both") == F.least(F.size("x"), F.size("y")), 2.0 / 3).otherwise(1.0 / 3)
    like = both.groupBy("group").agg(F.sum(2 * F.col("cx") * F.col("cy") * like).alias("like"))
    expected = _apart(own).join(like, "group", "left").select("group", (F.col("de") - F.coalesce("like", F.lit(0.0))).alias("de"))
    return _alpha(own, masi_distance, expected)


def cohen(ratings: DataFrame) -> DataFrame:
    """Cohen's kappa per group over units with exactly two ratings, by place: rater order is that of `rater`."""
    w = Window.partitionBy("group", "unit")
    own = double_rated(ratings).withColumn("at", F.row_number().over(w.orderBy("rater")))
    pairs = own.groupBy("group", "unit").agg(F.max(F.when(F.col("at") == 1, F.col("value"))).alias("a"), F.max(F.when(F.col("at") == 2, F.col("value"))).alias("b"), F.max("m").alias("m")).where("m = 2")
    po = pairs.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("a") == F.col("b")).cast("double")).alias("po"))
    ma, mb = pairs.groupBy("group", F.col("a").alias("v")).agg(F.count(F.lit(1)).alias("ca")), pairs.groupBy("group", F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("cb"))
    pe = ma.join(mb, ["group", "v"]).groupBy("group").agg(F.sum(F.col("ca") * F.col("cb")).alias("both"))
    own = po.join(pe, "group", "left").withColumn("pe", F.coalesce("both", F.lit(0)) / (F.col("n") * F.col("n")))
    return own.select("group", "n", F.when((F.col("n") >= 2) & (F.col("pe") < 1), (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def fleiss(ratings: DataFrame) -> DataFrame:
    """Fleiss' kappa per group, for any number of ratings of a unit from two on."""
    own = double_rated(ratings).groupBy("group", "unit", "m", "value").agg(F.count(F.lit(1)).alias("c"))
    p = own.groupBy("group", "unit", "m").agg(F.sum(F.col("c") * F.col("c")).alias("ss"))
    p = p.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("m").alias("total"), F.avg((F.col("ss") - F.col("m")) / (F.col("m") * (F.col("m") - 1))).alias("pbar"))
    pe = own.groupBy("group", "value").agg(F.sum("c").alias("c")).groupBy("group").agg(F.sum((F.col("c") * F.col("c")).cast("double")).alias("cc"), F.count(F.lit(1)).alias("cats"))
    own = p.join(pe, "group").withColumn("pe", F.col("cc") / (F.col("total") * F.col("total")))
    return own.select("group", "n", F.when((F.col("cats") >= 2) & (F.col("pe") < 1), (F.col("pbar") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def categorical(ratings: DataFrame) -> DataFrame:
    """group, method, kappa: Cohen where every rated unit has two ratings, else Fleiss."""
    method = double_rated(ratings).groupBy("group").agg(F.when(F.max("m") == 2, "cohen").otherwise("fleiss").alias("method"))
    both = cohen(ratings).select("group", F.col("kappa").alias("c")).join(fleiss(ratings).select("group", F.col("kappa").alias("f")), "group", "full")
    return method.join(both, "group", "left").select("group", "method", F.when(F.col("method") == "cohen", F.col("c")).otherwise(F.col("f")).alias("kappa"))


def adjudicate(labels: DataFrame, items: DataFrame) -> DataFrame:
    """One row per item with a verdict: resolution, reason, conflicts, edited and the agreed labels."""
    tag = lambda c: F.coalesce(c, F.lit("∅"))
    agg = labels.where("known").groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_reviewers"), F.count_if(F.col("status") == "reject").alias("n_reject"),
        F.size(F.collect_set(F.array_join("gold", "\n"))).alias("golds"), F.size(F.collect_set(tag(F.col("question_type")))).alias("types"), F.size(F.collect_set(tag(F.col("ambiguity")))).alias("ambiguities"),
        F.max(F.array_join("gold", ",")).alias("agreed_gold"), F.max("question_type").alias("agreed_type"), F.max("ambiguity").alias("agreed_ambiguity"),
    )
    own = agg.join(items.select("item_id", F.array_join(F.array_sort("gold"), ",").alias("i_gold"), F.col("question_type").alias("i_type"), F.col("ambiguity").alias("i_ambiguity")), "item_id")
    n, r = F.col("n_reviewers"), F.col("n_reject")
    conflicts = F.concat_ws(",", F.when(F.col("golds") > 1, F.lit("gold_citations")), F.when(F.col("types") > 1, F.lit("question_type")), F.when(F.col("ambiguities") > 1, F.lit("ambiguity")))
    reason = F.when(n < 2, F.lit(None).cast("string")).when((r > 0) & (r < n), "reject_approve_split").when(r == n, "all_reject").when(conflicts != "", "edit_conflict")
    resolution = F.when(n < 2, "insufficient_reviews").when(reason.isNotNull(), "needs_adjudication").otherwise("verified")
    verified = resolution == "verified"
    changed = ~(F.col("agreed_gold").eqNullSafe(F.col("i_gold")) & F.col("agreed_type").eqNullSafe(F.col("i_type")) & F.col("agreed_ambiguity").eqNullSafe(F.col("i_ambiguity")))
    return own.select(
        "item_id", "n_reviewers", resolution.alias("resolution"), reason.alias("reason"),
        F.when(reason == "edit_conflict", conflicts).alias("conflicts"), F.when(verified, changed).alias("edited"),
        F.when(verified, F.col("agreed_gold")).alias("gold"),
        F.when(verified & (F.col("agreed_type") == "unanswerable"), F.lit(True)).otherwise(F.lit(False)).alias("must_abstain"),
    )


def gold_items(labels: DataFrame, items: DataFrame) -> DataFrame:
    """The reviewed items (item_id, gold, question_type, ambiguity, other columns as they are) as they go into the gold
    set: items without a known verdict are left out, flagged ones stay as they were.

    Verified items take what all reviewers agree on, gold sorted; as unanswerable they must be abstained from. Adds
    answerable and must_abstain (where agreed so; else the item's own, or null without such a column), verified,
    needs_adjudication, and disagreement (reason, conflicting_fields, reviewer_labels in the order in which reviewers
    came), null where there is none."""
    said = F.struct("first_row", "reviewer", "status", "gold", "question_type", "ambiguity")
    agreed = labels.where("known").groupBy("item_id").agg(F.min("gold").alias("_gold"), F.max("question_type").alias("_type"), F.max("ambiguity").alias("_ambiguity"), F.array_sort(F.collect_list(said)).alias("_said"))
    decided = adjudicate(labels, items).select("item_id", F.col("resolution").alias("_resolution"), F.col("reason").alias("_reason"), F.split(F.nullif("conflicts", F.lit("")), ",").alias("_conflicts"))
    ok, flagged = F.col("_resolution") == "verified", F.col("_resolution") == "needs_adjudication"
    own = lambda c: F.col(c) if c in items.columns else F.lit(None).cast("boolean")
    unanswerable = ok & (F.col("_type") == "unanswerable")
    told = F.transform("_said", lambda x: F.struct(x["status"].alias("status"), x["gold"].alias("gold"), x["question_type"].alias("question_type"), x["ambiguity"].alias("ambiguity")))
    return items.join(decided, "item_id").join(agreed, "item_id").withColumns({
        "gold": F.when(ok, F.col("_gold")).otherwise(F.col("gold")), "question_type": F.when(ok, F.col("_type")).otherwise(F.col("question_type")), "ambiguity": F.when(ok, F.col("_ambiguity")).otherwise(F.col("ambiguity")),
        "answerable": F.when(unanswerable, F.lit(False)).otherwise(own("answerable")), "must_abstain": F.when(unanswerable, F.lit(True)).otherwise(own("must_abstain")),
        "verified": ok, "needs_adjudication": flagged, "disagreement": F.when(flagged, F.struct(F.col("_reason").alias("reason"), F.col("_conflicts").alias("conflicting_fields"), told.alias("reviewer_labels"))),
    }).drop("_resolution", "_reason", "_conflicts", "_gold", "_type", "_ambiguity", "_said")


# Targets of the gates.
ALPHA, KAPPA = 0.67, 0.60


def gate(value: Column, target: float) -> Column:
    """PASS or FAIL; blank where the statistic is undefined."""
    return F.when(value.isNull(), " ").when(value >= target, "PASS").otherwise("FAIL")


def report(labels: DataFrame) -> DataFrame:
    """grouping, group, n, alpha, alpha_gate, kappa, kappa_gate: agreement on gold (alpha over MASI) and on status (kappa)
    over all labels, by corpus, and by the items' question type."""
    by = {"overall": F.lit("all"), "corpus": F.col("corpus"), "question_type": F.coalesce("i_type", F.lit("unknown"))}
    own = labels.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("grouping"), v.alias("group")) for k, v in by.items()])).alias("g"))
    rated = lambda value: own.select(F.concat_ws("\x01", "g.grouping", "g.group").alias("group"), F.concat_ws("/", "corpus", "item_id").alias("unit"), F.col("first_row").alias("rater"), F.col(value).alias("value"))
    both = masi_alpha(rated("gold")).join(categorical(rated("status")).select("group", "kappa"), "group", "full")
    both = both.withColumns({"alpha": F.round("alpha", 6), "kappa": F.round("kappa", 6), "g": F.split("group", "\x01")})
    return both.select(F.get("g", F.lit(0)).alias("grouping"), F.get("g", F.lit(1)).alias("group"), "n", "alpha", gate(F.col("alpha"), ALPHA).alias("alpha_gate"), "kappa", gate(F.col("kappa"), KAPPA).alias("kappa_gate"))


def weighted_kappa(ratings: DataFrame, scale: Sequence[str], *, power: int = 1) -> DataFrame:
    """group, n, kappa: Cohen's kappa over the order of `scale` for units with two ratings (group, unit, rater, value):
    a disagreement weighs its distance on the scale, to the power of 1 (linear) or 2 (quadratic). Values that aren't on
    the scale don't count. Null where all ratings are one value, or no unit has two."""
    known = ratings.where(F.col("value").isin(*scale))
    w = Window.partitionBy("group", "unit")
    own = known.withColumn("_n", F.row_number().over(w.orderBy("rater"))).withColumn("_m", F.count(F.lit(1)).over(w)).where("_m = 2")
    at = F.array_position(F.array(*map(F.lit, scale)), F.col("value")) - 1
    pairs = own.groupBy("group", "unit").agg(F.max(F.when(F.col("_n") == 1, at)).alias("a"), F.max(F.when(F.col("_n") == 2, at)).alias("b"))
    joint = pairs.groupBy("group", "a", "b").agg(F.count(F.lit(1)).alias("c"))  # at most a row per pair of labels
    margin = lambda side: [F.sum(F.when(F.col(side) == i, F.col("c")).otherwise(0)).cast("double").alias(f"{side}{i}") for i in range(len(scale))]
    seen = F.sum(F.col("c") * F.pow(F.abs(F.col("a") - F.col("b")).cast("double"), F.lit(float(power))))
    total = joint.groupBy("group").agg(F.sum("c").alias("n"), seen.alias("seen"), *margin("a"), *margin("b"))
    chance = sum((F.col(f"a{i}") * F.col(f"b{j}") * float(abs(i - j) ** power) for i in range(len(scale)) for j in range(len(scale))), F.lit(0.0)) / F.col("n")
    return total.select("group", "n", F.when(chance > 0, 1 - F.col("seen") / chance).alias("kappa"))
