"""A cache of vectors by content: a text is embedded once, whoever asks for it, and only its bucket is rewritten."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attesta.sources.bundle import _at

SCHEMA = "hash string, embedding array<float>, bucket int"
#: Buckets of a cache; fixed when it is begun.
BUCKETS = 64


def content_hash(model: str, text: Column) -> Column:
    """Of a model's name and a text; null texts are empty."""
    return F.sha2(F.concat(F.lit(f"{model}\n"), F.coalesce(text, F.lit(""))), 256)


def _bucket(hashed: Column, buckets: int) -> Column:
    return (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("long") % buckets).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p) and any(x.getPath().getName().startswith("bucket=") for x in fs.listStatus(p))


def read(spark: SparkSession, path: str) -> DataFrame:
    """hash, embedding, bucket; one row per hash, also where a run ended between two steps of an upsert."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    own = spark.read.schema(SCHEMA + ", gen string").parquet(path)
    return own.dropDuplicates(["hash"]).select("hash", "embedding", "bucket")


def missing(texts: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """hash, text: distinct texts without a vector in the cache. Equal texts are one row."""
    own = texts.select(content_hash(model, F.col(text)).alias("hash"), F.coalesce(text, F.lit("")).alias("text"))
    return own.join(cache.select("hash"), "hash", "left_anti").dropDuplicates(["hash"])


def upsert(texts: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], model: str, *, text: str = "text", buckets: int = BUCKETS) -> list[int]:
    """Embeds texts that the cache lacks and returns the buckets rewritten, none where nothing was missing.

    `embed` makes (hash, embedding) of (hash, text). New vectors are written once to a staging folder; then each bucket
    that they touch is written anew, as a new generation beside the old one, which goes last. A run that ends anywhere
    leaves a cache that reads the same or with more vectors, and may be repeated. Writers of one cache take turns."""
    spark = texts.sparkSession
    path = path.rstrip("/")
    gen = uuid.uuid4().hex
    stage = f"{path}/_staged-{gen}"  # readers skip names with an underscore
    fs, staged = _at(spark, stage)
    try:
        own = embed(missing(texts, read(spark, path), model, text)).select("hash", F.col("embedding").cast("array<float>").alias("embedding"))
        own.withColumn("bucket", _bucket(F.col("hash"), buckets)).write.parquet(f"{stage}/new")
        new = spark.read.schema(SCHEMA).parquet(f"{stage}/new")
        touched = sorted(x["bucket"] for x in new.select("bucket").distinct().collect())  # at most `buckets`
        if not touched:
            return []
        old = read(spark, path).where(F.col("bucket").isin(touched))
        both = old.unionByName(new).dropDuplicates(["hash"]).repartition(len(touched), "bucket")
        both.write.partitionBy("bucket").parquet(f"{stage}/merged")
        for b in touched:
            folder = _at(spark, f"{path}/bucket={b}")[1]
            before = [x.getPath() for x in fs.listStatus(folder)] if fs.exists(folder) else []
            fs.mkdirs(folder)
            if not fs.rename(_at(spark, f"{stage}/merged/bucket={b}")[1], _at(spark, f"{path}/bucket={b}/gen={gen}")[1]):
                raise OSError(f"bucket {b} of {path} could not be replaced")
            for p in before:
                fs.delete(p, True)
        return touched
    finally:
        fs.delete(staged, True)


def vectors(units: DataFrame, cache: DataFrame, model: str, text: str = "text") -> DataFrame:
    """units with `embedding`; null where the cache lacks their text."""
    own = units.withColumn("_hash", content_hash(model, F.col(text)))
    return own.join(cache.select(F.col("hash").alias("_hash"), "embedding"), "_hash", "left").drop("_hash")


def normalised(vector: Column) -> Column:
    """A vector at length 1, so that inner products are cosines; a zero vector stays."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(F.transform(vector, lambda x: x.cast("double")))
