"""Checks and totals of a release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def not_allowed(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Rows whose value is neither null nor on the list."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*allowed))


def forbidden(rows: DataFrame, columns: list[str], tokens: list[str]) -> DataFrame:
    """Rows that hold a token in a column, with `found`: which, case-sensitive."""
    hits = [F.when(F.greatest(F.lit(False), *[F.coalesce(F.contains(F.col(c), F.lit(t)), F.lit(False)) for c in columns]), F.lit(t)) for t in tokens]
    return rows.withColumn("found", F.concat_ws(",", *hits)).where("found <> ''")


def must_be_blank(rows: DataFrame, column: str, values: list[str], text: str) -> DataFrame:
    """Groups of the listed values that have text all the same."""
    return rows.where(F.col(column).isin(*values) & (F.coalesce(F.trim(text), F.lit("")) != "")).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def manifest(rows: DataFrame) -> DataFrame:
    """Per language and in total: units, characters, sources."""
    return rows.rollup("lang").agg(F.count(F.lit(1)).alias("units"), F.sum("n_chars").alias("chars"), F.count_distinct("source").alias("sources"), F.grouping("lang").cast("long").alias("total"))


def _hashed(x: str) -> Column:
    """Hash of the hashes h of structs (o, h), in their order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(x)), lambda y: y["h"]), "\n"), 256)


def _hashes(order: str, text: str) -> Column:
    return F.struct(F.col(order).alias("o"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("h")).alias("x")


def version(rows: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """Content version of a group: hash of its rows' hashes in order. Only hashes are gathered, all of a group at one
    place; see `ranged_version` for groups that are too large for that."""
    return rows.select(group, _hashes(order, text)).groupBy(group).agg(_hashed("x").alias("version"))


def ranged_version(rows: DataFrame, group: str, order: str, text: str, span: int = 65_536) -> DataFrame:
    """Content version of a group of any size, whose `order` is a whole number: each `span` numbers are a range with a
    version of its own, and the group's is the hash of its ranges' versions in order. One place gathers the hashes of a
    range, or one hash for each range. Rows without a number come first, as a range."""
    least = F.col(order) - F.pmod(F.col(order), F.lit(span))
    parts = rows.select(group, least.alias("o"), _hashes(order, text)).groupBy(group, "o").agg(_hashed("x").alias("h"))
    return parts.select(group, F.struct("o", "h").alias("x")).groupBy(group).agg(F.count(F.lit(1)).alias("ranges"), _hashed("x").alias("version"))


def assert_clean(rows: DataFrame, what: str) -> None:
    """Raises if a check found rows."""
    found = rows.limit(5).collect()
    if found:
        raise ValueError(f"{what}: {[r.asDict() for r in found]}")


def forbidden_paths(rows: DataFrame, path: str, parts: list[str], folders: list[str]) -> DataFrame:
    """Rows whose file name holds one of `parts`, or that lie in a folder of one of these names."""
    steps = F.split(F.col(path), "/")
    name = F.element_at(steps, -1)
    inside = F.arrays_overlap(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - 1, F.lit(0))), F.array(*map(F.lit, folders)))
    return rows.where(F.greatest(inside, *[F.contains(name, F.lit(p)) for p in parts]))


def share_known(ids: DataFrame, space: DataFrame, column: str, least: float = 0.95) -> DataFrame:
    """One row: n distinct ids, n_known of them in the space, share, ok (share is `least` or more; null without ids)."""
    there = space.select(F.col(column), F.lit(True).alias("there")).distinct()
    own = ids.select(column).distinct().join(there, column, "left").agg(F.count(F.lit(1)).alias("n"), F.count("there").alias("n_known"))
    return own.withColumn("share", F.round(F.try_divide("n_known", "n"), 6)).withColumn("ok", F.col("share") >= least)
