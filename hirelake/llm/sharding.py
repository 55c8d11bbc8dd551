"""Sharding by jump consistent hashing.

A row's shard follows from its key and the number of shards alone.  No ring or
table is kept, and a further shard only takes rows into itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.session import materialize

#: Bytes counted for each row besides its text.
ROW_BYTES = 16
#: Copies of one row that are numbered in one array.
COPIES = 65_536


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key among ``shards``, all keys stepped together."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while live.size:
        shard[live] = jump[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        draw = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        jump[live] = ((shard[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        live = live[jump[live] < shards]
    return shard


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key of any type; a null key is a key like any other.

    The key's text is hashed first, so consecutive numbers spread evenly.
    """

    @F.pandas_udf("int")
    def jump(hashed: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(hashed.to_numpy(), shards).astype(np.int32))

    return jump(F.xxhash64(key.cast("string")))


def assign_shards(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text", buckets: int = 1024) -> DataFrame:
    """Shard, gapless slot and the shard after growth of every row.

    Equal rows are counted before anything is ordered, so a row that is
    repeated without end is one row until its copies get their slots.  Slots
    run over ``buckets`` hash buckets of each shard and within a bucket by key,
    size and checksum; only the counts of buckets meet in one task.  The rows
    of one key spread over the buckets when their texts differ.

    Null keys share a shard, a null text has no bytes and the checksum of an
    empty text, repeated rows get slots of their own, and no rows give no rows.
    Only ``key`` and ``text`` are read; other columns don't matter.
    """
    body = F.col(text).cast("string")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    distinct = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    placed = materialize(
        distinct.select(
            "*",
            shard_of(F.col("doc_id"), shards).alias("shard"),
            shard_of(F.col("doc_id"), shards + 1).alias("grown_shard"),
            F.pmod(
                F.xxhash64(F.lit("slot"), F.col("doc_id").cast("string"), "size", "text_crc32"), F.lit(buckets)
            ).cast("int").alias("bucket"),
        ),
        "shards",
    )
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("shard", "bucket").agg(F.sum("copies").alias("n")).select(
        "shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    inside = (
        Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    numbered = placed.withColumn("seen", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
    runs = numbered.join(starts, ["shard", "bucket"]).withColumn(
        "run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES)))
    )
    last = F.least(F.col("copies"), (F.col("run") + 1) * COPIES) - 1
    # The runs of a row with endless copies go to different tasks before they become rows.
    spread = runs.repartition("doc_id", "size", "text_crc32", "run")
    return spread.withColumn("copy", F.explode(F.sequence(F.col("run") * COPIES, last))).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("start") + F.col("seen") + F.col("copy")).cast("long").alias("slot"), "grown_shard",
    )
