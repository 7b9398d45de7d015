"""Training-order materialisation of token sequences.

A keyed Feistel permutation with cycle-walking gives every sequence a global slot; ranges of slots are written as
shard files of fixed stride, so that a reader can start at any slot and go on sequentially.
"""

from __future__ import annotations

import hashlib
import secrets
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from attesta.llm.common import arrow_rows, binary_path, durable, release
from attesta.llm.tokens import tokens

ROUNDS = 6
#: Text of a group of documents, in bytes; ranges of slots that are written one after the other, and tasks of each at most.
GROUP_BYTES, WAVES, TASKS = 16 << 20, 4, 10_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slots(index: np.ndarray, total: int, key: str) -> np.ndarray:
    """A permutation of range(total), keyed; values that leave the range walk their cycle until they are back in it."""
    half = max(1, (max(total - 1, 1).bit_length() + 1) // 2)
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    digest = hashlib.sha256(key.encode()).digest() * 2
    keys = [np.uint64(int.from_bytes(digest[8 * r : 8 * r + 8], "little")) for r in range(ROUNDS)]

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right + k) & mask)
        return left << shift | right

    with np.errstate(over="ignore"):
        out = once(index.astype(np.uint64))
        while (far := out >= np.uint64(total)).any():
            out[far] = once(out[far])
    return out.astype(np.int64)


def materialise(
    docs: DataFrame,
    tokenizer_path: str,
    path: str,
    *,
    key: str = "order-1",
    length: int = 1024,
    end_id: int = 0,
    shard_sequences: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Writes shards below path; one row per sequence: slot, shard, byte_offset, n_tokens, ids_crc32, doc_ids (of the
    documents it holds tokens of, in order).

    Texts become ids and end_id. Documents are dealt by hash into groups whose number follows from the size of all
    texts; in a group they are joined in order of id, then text, and cut every `length` ids, so that neither sequences
    nor slots depend on how the input is split. The last sequence of a group is padded with end_id (n_tokens counts
    without padding). Ids take 2 bytes where the vocabulary allows, else 4. Null texts count as empty; null ids come
    last and stay null in doc_ids; repeated rows are written as often as they come; an empty table writes nothing;
    other columns are not read. Slots are written in WAVES ranges, one after the other, so that a part of the ids at a
    time is in the shuffle. A retried task writes the same file again under the same name.
    """
    spark = docs.sparkSession
    wide = tokens(tokenizer_path).slow.get_vocab_size() > 1 << 16
    kind, stride = ("<u4" if wide else "<u2"), length * (4 if wide else 2)
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, buffer, held, n = tokens(tokenizer_path), [], [], 0
        group, k, rows, size = None, 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=x) for i, x in enumerate(types)], names=["grp", "idx", "n_tokens", "ids", "doc_ids"])
            rows, size = [], 0
            return out

        def sequence() -> None:
            nonlocal k, buffer, held, n, size
            ids = np.concatenate(buffer)
            rows.append((group, k, ids.size, ids.astype(kind).tobytes(), held))
            size += 2 * ids.size + 8 * len(held)
            buffer, held, n, k = [], [], 0, k + 1

        for batch in batches:
            for g, d, x in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if g != group:
                    if n:
                        sequence()
                    group, k = g, 0
                ids = np.frombuffer(t.encode(x) + end, dtype="<u4")
                while ids.size:
                    part, ids = ids[: length - n], ids[length - n :]
                    buffer.append(part)
                    held.append(d)
                    n += part.size
                    if n == length:
                        sequence()
                        if size > 4 << 20:
                            yield flush()
            if rows:
                yield flush()
        if n:
            sequence()
        if rows:
            yield flush()

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = own.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    dealt = own.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(max(1, -(-size // GROUP_BYTES)))).alias("grp"), "doc_id", "text")
    dealt = dealt.repartition("grp").sortWithinPartitions("grp", F.asc_nulls_last("doc_id"), "text")
    with arrow_rows(spark, 500):
        made = durable(dealt.mapInArrow(cut, "grp long, idx long, n_tokens long, ids binary, doc_ids array<long>"), "sequences")
    counts = made.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    before = durable(counts.select("grp", (F.sum("n").over(Window.orderBy("grp")) - F.col("n")).alias("before")), "before")

    @F.pandas_udf("long")
    def slot(index: pd.Series) -> pd.Series:
        return pd.Series(slots(index.to_numpy(), total, key))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of slots; a shard's file grows sequence by sequence and gets its name when it is whole."""
        store, root = binary_path(path)
        store.create_dir(root, recursive=True)
        out, shard, temp = None, None, ""

        def close() -> None:
            if out is not None:
                out.close()
                store.move(temp, f"{root}/shard-{shard:010d}.bin")

        for batch in batches:
            rows = {c: batch.column(c).to_pylist() for c in ("slot", "shard", "ids")}
            crc, at = [], []
            for s, h, ids in zip(rows["slot"], rows["shard"], rows["ids"]):
                if h != shard:
                    close()
                    shard, temp = h, f"{root}/.{h:010d}-{secrets.token_hex(8)}"
                    out = store.open_output_stream(temp)
                out.write(ids + np.full((stride - len(ids)) // np.dtype(kind).itemsize, end_id, dtype=kind).tobytes())
                crc.append(zlib.crc32(np.frombuffer(ids, dtype=kind).astype("<u4").tobytes()))
                at.append((s - h * shard_sequences) * stride)
            columns = [batch.column("slot"), batch.column("shard"), pa.array(at, type=pa.int64()), batch.column("n_tokens"), pa.array(crc, type=pa.int64()), batch.column("doc_ids")]
            yield pa.RecordBatch.from_arrays(columns, names=["slot", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids"])
        close()

    spark.createDataFrame([(total, stride, length, kind, shard_sequences, key)], "sequences long, stride long, length long, kind string, shard_sequences long, key string").coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    # a row per group of GROUP_BYTES; past a million of them Spark joins by shuffle
    starts = F.broadcast(before) if size <= GROUP_BYTES * 1_000_000 else before
    # called nondeterministic so that the filters on slots below don't compute them a second time
    placed = made.join(starts, "grp").select(slot.asNondeterministic()(F.col("before") + F.col("idx")).alias("slot"), "n_tokens", "ids", "doc_ids")
    placed = placed.withColumn("shard", F.floor(F.col("slot") / shard_sequences))
    shards = -(-total // shard_sequences)
    wave = max(1, -(-shards // WAVES))
    each = max(1, -(-wave // TASKS))
    written = []
    for low in range(0, max(shards, 1), wave):
        # slots are dense, so that the ranges are known without looking at the rows
        part = placed.where((F.col("shard") >= low) & (F.col("shard") < low + wave))
        part = part.repartitionById(-(-wave // each), F.floor((F.col("shard") - low) / each).cast("int")).sortWithinPartitions("slot")
        with arrow_rows(spark, 500):
            written.append(durable(part.mapInArrow(write, "slot long, shard long, byte_offset long, n_tokens long, ids_crc32 long, doc_ids array<long>"), "order"))
    release(made, before)
    return reduce(DataFrame.union, written)


def read(spark: SparkSession, path: str, start: int = 0) -> Iterator[np.ndarray]:
    """Sequences in training order from slot `start` on, read front to back; padding included."""
    meta = spark.read.json(f"{path}/meta").first()
    store, root = binary_path(path)
    at = start
    while at < meta["sequences"]:
        shard, skip = divmod(at, meta["shard_sequences"])
        with store.open_input_stream(f"{root}/shard-{shard:010d}.bin") as f:
            f.read(skip * meta["stride"])
            for _ in range(min(meta["shard_sequences"] - skip, meta["sequences"] - at)):
                yield np.frombuffer(f.read(meta["stride"]), dtype=meta["kind"]).astype(np.uint32)
                at += 1
