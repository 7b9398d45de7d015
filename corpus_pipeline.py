"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame, which is
written as Parquet and read again for the next one.

Null texts count as empty, and stay null until they are packed; null ids are documents like others; of rows that repeat
one stays, unless they are blank; an empty table gives no rows; documents may have other columns of any name, which all
but the last stage hand on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm import decontaminate, packing, pii, set_join, toxicity
from attesta.llm.common import durable, table
from attesta.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the noisy-channel score rejects go."""
    return toxicity.keep(docs, toxicity.train_rows(table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 or more over five-word shingles make, one row stays (see
    `set_join.deduplicate` for repeated and null ids). Blank texts stay."""
    return set_join.deduplicate(docs, width=5, percent=80)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the words that disclose it are replaced in the texts; n_chars follows the text."""
    out = pii.sanitised(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, one row per piece, with its token ids."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("pii", sanitise),
    ("packing", pack),
]

#: Models, exact set joins and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
