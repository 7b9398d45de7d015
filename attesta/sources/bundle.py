"""Release bundles: staged, looked through as written, then published whole with a manifest."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.operators import release
from attesta.sources.sinks import files

#: Rows of a file at most: files are hashed whole.
ROWS = 100_000


def _at(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _write(rows: DataFrame, path: str) -> None:
    rows.write.option("maxRecordsPerFile", ROWS).json(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of every data file; Spark's readers pass over those of 0 bytes, which the file system tells."""
    own = files(spark, path).select("path", "bytes", "sha256")
    fs, at = _at(spark, path)
    root, empty, found = fs.makeQualified(at).toString().rstrip("/"), [], fs.listFiles(at, True)
    while found.hasNext():
        status = found.next()
        name = status.getPath().toString()
        if not status.getLen() and not any(x[:1] in "._" for x in name[len(root) + 1 :].split("/")):
            empty.append((name, 0, hashlib.sha256(b"").hexdigest()))
    return own.union(spark.createDataFrame(empty, "path string, bytes long, sha256 string"))


def listing(spark: SparkSession, path: str) -> DataFrame:
    """path (below the bundle), bytes, sha256, lines of every data file of a bundle, the manifest left out."""
    top = path.rstrip("/").rpartition("/")[2]
    below = lambda c: F.regexp_replace(c, rf"^.*/\Q{top}\E/", "")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).groupBy(below(F.col("_metadata.file_path")).alias("path")).agg(F.count(F.lit(1)).alias("lines"))
    own = _files(spark, path).withColumn("path", below(F.col("path"))).join(lines, "path", "left").na.fill(0, ["lines"])
    return own.where(~F.startswith("path", F.lit("manifest/")))


def offences(spark: SparkSession, path: str, tokens: Sequence[str] = (), parts: Sequence[str] = (), folders: Sequence[str] = ()) -> DataFrame:
    """path, found: files below path that hold a token, as it is or as JSON writes it, and files by a forbidden name or
    in a forbidden folder. Reads what lies there, not what was meant to be written."""
    spelt = list(dict.fromkeys(t for token in tokens for t in (token, json.dumps(token, ensure_ascii=False)[1:-1])))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("path"))
    said = release.forbidden(lines, ["value"], spelt).select("path", "found").distinct()
    top = path.rstrip("/").rpartition("/")[2]
    below = _files(spark, path).select("path", F.regexp_replace("path", rf"^.*/\Q{top}\E/", "").alias("below"))
    named = release.forbidden_paths(below, "below", list(parts), list(folders)) if parts or folders else below.limit(0)
    return said.union(named.select("path", F.lit("name").alias("found")))


def publish(tables: dict[str, DataFrame], target: str, version: str, *, tokens: Sequence[str] = (), parts: Sequence[str] = (), folders: Sequence[str] = ()) -> str:
    """Writes tables as JSON lines below target/version and returns that path: first to a staging folder, whose files
    are then looked through for forbidden tokens, names and folders and listed in a manifest; last the folder is renamed.
    A version is published once; whatever fails leaves nothing there, and nothing staged."""
    spark = next(iter(tables.values())).sparkSession
    final, stage = f"{target.rstrip('/')}/{version}", f"{target.rstrip('/')}/staged-{uuid.uuid4().hex}"
    fs, end = _at(spark, final)
    if fs.exists(end):
        raise FileExistsError(final)
    try:
        for name, rows in tables.items():
            _write(rows, f"{stage}/{name}")
        release.assert_clean(offences(spark, stage, tokens, parts, folders), "forbidden in the bundle")
        _write(listing(spark, stage).coalesce(1).sortWithinPartitions("path"), f"{stage}/manifest")
        if not fs.rename(_at(spark, stage)[1], end):
            raise OSError(f"{final} could not be published")
    finally:
        fs.delete(_at(spark, stage)[1], True)
    return final


def differences(spark: SparkSession, path: str) -> DataFrame:
    """path, what ("missing", "extra", "changed") of files of a published bundle against its manifest."""
    said = spark.read.schema("path string, bytes long, sha256 string, lines long").json(f"{path}/manifest").select("path", F.col("sha256").alias("_said"))
    both = listing(spark, path).select("path", "sha256").join(said, "path", "full")
    what = F.when(F.col("sha256").isNull(), "missing").when(F.col("_said").isNull(), "extra").when(F.col("sha256") != F.col("_said"), "changed")
    return both.select("path", what.alias("what")).where("what is not null")
