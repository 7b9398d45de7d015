"""What a validation report says of a table, from one pass over it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

#: Longer values are cut in histograms, so that they end in three dots at this length.
WIDTH = 60


def profile(rows: DataFrame, section: str, *, filled: Sequence[str] = (), number: str | None = None, values: Sequence[str] = (), expected: Mapping[str, int] | None = None, width: int = WIDTH) -> DataFrame:
    """section, check, item, n, share: everything a report shows, in one long table.

    | check | item | n | share |
    |-|-|-|-|
    | rows | null | rows of the section | expected rows over n, where known |
    | filled | column | rows with a value that isn't null or blank | of the section's rows |
    | value:<column> | value, cut at `width`; null: no value | rows | of the section's rows |
    | missing | first number of a run that lacks, from 1 on | length of the run | null |
    | repeated | number | rows that have it | null |
    | unnumbered | null | rows without a number, or with one below 1 | of the section's rows |

    Sections that are expected but have no row come with n = 0. A row becomes a short array of facts, which are counted
    by section, check and item before anything is shuffled. Runs are found at their ends: a number tells itself
    and its successor, and only places where one lacks are ordered within a section. After the first shuffle only counts
    move."""
    here = F.col(section).cast("string")
    fact = lambda check, item=None, k=None, hit=True, probe=False: F.struct(F.lit(check).alias("check"), (F.lit(None) if item is None else item).cast("string").alias("item"), (F.lit(None) if k is None else k).cast("long").alias("k"), F.lit(hit).cast("long").alias("hit") if isinstance(hit, bool) else hit.cast("long").alias("hit"), F.lit(int(probe)).cast("long").alias("probe"))
    cut = lambda c: F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 3), F.lit("..."))).otherwise(c)
    facts = [fact("rows")]
    facts += [fact("filled", F.lit(c), hit=F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))) for c in filled]
    facts += [fact(f"value:{c}", cut(F.col(c).cast("string"))) for c in values]
    if number:
        n = F.col(number).cast("long")
        facts += [F.when(n >= 1, fact("number", k=n)), F.when(n >= 1, fact("number", k=n + 1, hit=False, probe=True)), fact("unnumbered", hit=~F.coalesce(n >= 1, F.lit(False)))]
    own = rows.select(here.alias("section"), F.inline(F.array_compact(F.array(*facts))))
    own = own.groupBy("section", "check", "item", "k").agg(F.count(F.lit(1)).alias("all"), F.sum("hit").alias("n"), F.max("probe").alias("after"))

    # a number: the start of a run that lacks (after one, not there), the end of one (there, after none), and repeats
    k, there = F.col("k"), F.col("n") > 0
    told = lambda check, item, n, at=None: F.struct(F.lit(check).alias("c"), item.cast("string").alias("i"), n.cast("long").alias("m"), (F.lit(None) if at is None else at).cast("long").alias("at"))
    isnt = F.col("check") != "number"
    out = F.array(
        F.when(isnt, F.struct(F.col("check").alias("c"), F.col("item").alias("i"), F.col("n").alias("m"), F.lit(None).cast("long").alias("at"))),
        F.when(~isnt & ~there, told("missing", k, F.lit(0), k)), F.when(~isnt & there & (F.col("after") == 0), told("missing", k, F.lit(1), k)),
        F.when(~isnt & (F.col("n") > 1), told("repeated", k, F.col("n"))),
    )
    own = own.select("section", "all", F.inline(F.array_compact(out)))
    if expected is not None:
        rows_ = rows.sparkSession.createDataFrame([(s, int(n)) for s, n in expected.items()], "section string, _want long")
        none = rows_.select("section", F.lit(0).cast("long").alias("all"), F.lit("rows").alias("c"), F.lit(None).cast("string").alias("i"), F.lit(0).cast("long").alias("m"), F.lit(None).cast("long").alias("at"))
        own = own.unionByName(none)  # counts of nothing, so that every expected section has a row
    # rows without a place aren't ordered: they are spread by check and item
    w = Window.partitionBy("section", "c", F.when(F.col("at").isNull(), F.col("i"))).orderBy("at")
    last, lack = F.lag("at").over(w), F.lag("m").over(w)
    n = F.when(F.col("at").isNull(), F.col("m")).when((F.col("m") == 1) & (lack == 0), F.col("at") - last).when((F.col("m") == 1) & last.isNull(), F.col("at") - 1)
    item = F.when(F.col("at").isNull(), F.col("i")).otherwise(F.coalesce(last, F.lit(1)).cast("string"))
    own = own.select("section", F.col("c").alias("check"), item.alias("item"), n.alias("n"), "all").where("n is not null and not (check = 'missing' and n = 0)")
    own = own.groupBy("section", "check", "item").agg(F.sum("n").alias("n"), F.sum("all").alias("all"))
    total = F.max(F.when(F.col("check") == "rows", F.col("n"))).over(Window.partitionBy("section"))
    part = F.col("check").isin("filled", "unnumbered") | F.startswith("check", F.lit("value:"))
    own = own.withColumn("share", F.when(part, F.round(F.try_divide(F.col("n"), total), 6)))
    if expected is not None:
        own = own.join(F.broadcast(rows_), "section", "left")  # the caller's own list
        own = own.withColumn("share", F.when(F.col("check") == "rows", F.round(F.try_divide(F.col("_want").cast("double"), F.col("n")), 6)).otherwise(F.col("share"))).drop("_want")
    return own.select("section", "check", "item", "n", "share")


def failed(profiled: DataFrame) -> DataFrame:
    """The lines of a profile that call for a look: wrong row counts, sections without rows, lacking and repeated
    numbers, rows without one, columns that aren't filled."""
    wrong = (F.col("check") == "rows") & ((F.col("n") == 0) | (F.col("share") != 1))
    return profiled.where(wrong | F.col("check").isin("missing", "repeated") | ((F.col("check") == "unnumbered") & (F.col("n") > 0)) | ((F.col("check") == "filled") & (F.col("share") < 1)))
