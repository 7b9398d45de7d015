"""The evaluation grid: remaining cells and the summary over languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def remaining(cells: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return cells.select(*key).distinct().join(done.select(*key).distinct(), key, "left_anti")


def summary(grid: DataFrame) -> DataFrame:
    """Means of value over cells (corpus, qlang): English, other languages, and the gap; undefined cells are skipped."""
    en, xl = F.avg(F.when(F.col("qlang") == "en", F.col("value"))), F.avg(F.when(F.col("qlang") != "en", F.col("value")))
    return grid.agg(F.round(en, 6).alias("en"), F.round(xl, 6).alias("xl"), F.round(en - xl, 6).alias("gap"), F.round((en - xl) / en, 6).alias("relative"))
