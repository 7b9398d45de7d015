"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def canonical_json(rows: DataFrame, keys: list[str]) -> DataFrame:
    """value: each row as JSON with sorted keys, in key order; write with .text()."""
    return rows.orderBy(*keys).select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def json_lines(rows: DataFrame, path: str, *keys) -> None:
    """Canonical lines in the order of keys (names or Columns): gold sets, result rows, diagnostics, supplements."""
    own = rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"), *[(F.col(k) if isinstance(k, str) else k).alias(f"_key{i}") for i, k in enumerate(keys)])
    own.orderBy(*[f"_key{i}" for i in range(len(keys))]).select("value").write.text(path)


def by_corpus(verdicts: DataFrame, path: str) -> None:
    """One folder per corpus; files sorted by item, reviewer and time."""
    verdicts.repartition("corpus").sortWithinPartitions("corpus", "item_id", "reviewer", "ts").write.mode("overwrite").partitionBy("corpus").json(path)


def append_cells(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def web_export(items: DataFrame, units: DataFrame) -> DataFrame:
    """Items with `sources`, the cited units in order of citation; ids without a unit keep null texts."""
    cites = items.select("item_id", F.posexplode_outer("gold").alias("at", "id"))
    own = cites.join(units.select("id", "text"), "id", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "id", "text"))).alias("s"))
    own = own.select("item_id", F.filter(F.transform("s", lambda x: F.struct(x["id"].alias("id"), x["text"].alias("text"))), lambda x: x["id"].isNotNull()).alias("sources"))
    return items.join(own, "item_id", "left")


def files(spark, path: str) -> DataFrame:
    """path, bytes, sha256 of every file below a folder."""
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return own.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def rendered(rows: DataFrame, digits: int = 3) -> DataFrame:
    """All columns as text: numbers with fixed digits, nulls as a dash."""
    show = lambda c, t: F.format_number(c, digits) if t in ("double", "float") else F.col(c).cast("string")
    return rows.select(*[F.coalesce(show(c, t), F.lit("—")).alias(c) for c, t in rows.dtypes])
