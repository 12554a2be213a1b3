"""Assigning rows to shards by jump consistent hashing (Lamping and Veach, 2014)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import order_bucket, section_bits, staged, text_bytes, with_running_total

#: Rows that share a shard, or an id, are counted in sections of about so many.
SECTION_ROWS = 1 << 20
STEP = np.uint64(2862933555777941757)


def jump_shards(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of every 64-bit key. With one more shard a key stays or moves into the new one."""
    state = keys.astype(np.uint64)
    shard = np.zeros(len(state), dtype=np.int64)
    following = np.zeros(len(state), dtype=np.int64)
    moving = np.arange(len(state))
    while len(moving):
        shard[moving] = following[moving]
        state[moving] = state[moving] * STEP + np.uint64(1)
        draw = ((state[moving] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        following[moving] = ((shard[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
        moving = moving[following[moving] < shards]
    return shard.astype(np.int32)


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a 64-bit key column, 0 to shards - 1."""

    @F.pandas_udf("int")
    def place(values: pd.Series) -> pd.Series:
        return pd.Series(jump_shards(values.to_numpy(dtype=np.int64), shards))

    return place(key)


def assign_shards(docs: DataFrame, shards: int = 40, section_rows: int = SECTION_ROWS) -> DataFrame:
    """Shard, slot within it, and the shard if there were one more, for every row of `docs`.

    The doc_id and the number of shards decide; rows that share a doc_id share a shard, and rows
    without one all go where the hash of null leads. A null text counts as empty. Slots are gapless
    from 0 and follow a hash of doc_id, size and checksum; they are counted in sections of about
    `section_rows` rows, so no task holds a whole shard, and rows that share a doc_id are counted
    by many tasks unless their texts are equal too. Only doc_id and text are read.
    """
    body = text_bytes()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.length(body) + 16).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
    ).withColumn("key", F.xxhash64("doc_id"))
    placed = rows.withColumns({
        "shard": jump_shard(F.col("key"), shards),
        "grown_shard": jump_shard(F.col("key"), shards + 1),
        "place": F.xxhash64("key", "size", "text_crc32"),
    })
    written = staged(placed, "shards")
    sections = order_bucket(F.col("place"), section_bits(written.count(), section_rows))
    counted = with_running_total(
        written.withColumn("section", sections), ["shard"], "section", ["place", "doc_id", "size", "text_crc32"], F.lit(1), "slot"
    )
    return counted.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
