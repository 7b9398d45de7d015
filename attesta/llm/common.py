"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=1)
def _own_dir() -> str:
    path = tempfile.mkdtemp(prefix="attesta-shared-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, read from the session, or the folder given to
    setCheckpointDir. Only where both are unset and all runs on one machine, as in tests, a temporary folder takes
    their place until the process ends; on a cluster its files would be lost, so that this is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.sparkContext.master
        if not re.match(r"local($|\[)", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors share (master {master})")
        path = _own_dir()
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/attesta-{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage is cut, the files outlive any executor, and the
    shuffle files behind them go at once instead of when the driver happens to collect its garbage."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the folders of durable tables whose last reader has been written."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """Within, the session has this setting."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Within, Python functions get at most so many rows at a time: their columns may be as long as a text."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(a, b) links, either order -> (node, component): component is the smallest node reachable.

    Alternating large-star and small-star rounds over the edge table; each round is written to the
    shared folder, and the rounds stop when all that is left is stars. A node's neighbours are never
    gathered: a star is a minimum per node joined back to its edges.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        # a > b in e. Large: every neighbour above u is tied to the least of u and its neighbours.
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m0")).select("u", F.least("u", "m0").alias("m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                low.select(F.col("u").alias("a"), F.col("m").alias("b"))
            )
        return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def settled(e: DataFrame) -> bool:
        """Every a has one b, and no b is an a."""
        ends = e.select(F.col("a").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.union(e.select(F.col("b").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up = 1 and down = 1").isEmpty()

    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = durable(e, name)
    while not settled(e):
        before, e = e, durable(star(star(e, True), False), name)
        release(before)
    roots = e.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = durable(e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots).distinct(), name)
    release(e)
    return out


def binary_path(path: str) -> tuple:
    """(file system, path in it) of a shared path, for executors that write other than Spark's formats."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(path)
