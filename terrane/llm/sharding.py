"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and one more shard
takes rows only into itself.

Nulls: a null key is a key like any other; a null text has no bytes. Repeated rows get slots of their own.
Other columns are left aside by `assigned` and kept by `write_shards`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrane.functions.numbering import HASH_BITS, hash60, numbered
from terrane.llm.common import saved


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each unsigned 64-bit key, all keys at once; only keys that still jump stay in the loop."""
    key, out = keys.astype(np.uint64), np.zeros(len(keys), dtype=np.int64)
    at, live, last = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys)), np.full(len(keys), -1, dtype=np.int64)
    while len(live):
        last[live] = at[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (last[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))
        at[live] = step.astype(np.int64)
        done = at[live] >= shards
        out[live[done]] = last[live[done]]
        live = live[~done]
    return out


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(jump(s.to_numpy(dtype=np.int64).view(np.uint64), shards).astype(np.int32))

    return of(key)


def assigned(docs: DataFrame, shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard. Only ids, sizes and checksums are shuffled."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes_"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    rows = rows.select("doc_id", (F.col("bytes_") + 1).alias("size"), "text_crc32", hash60(F.col("doc_id")).alias("key_"))
    rows = rows.withColumn("shard", shard_of(F.col("key_"), shards)).withColumn("grown_shard", shard_of(F.col("key_"), shards + 1))
    rows = saved(rows)
    # rows of one id are dealt apart by their number in the saved table, which doesn't change when it is read again
    spread = F.xxhash64("doc_id", F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << HASH_BITS) - 1))
    out = numbered(rows.withColumn("spread_", spread), "shard", "spread_", ["doc_id", "text_crc32", "size"], rows.count(), "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", shards: int = 16, files: int = 1) -> None:
    """The rows with all their columns as Parquet, a folder `shard=N` each; `files` tasks write a shard."""
    placed = docs.withColumn("shard", shard_of(hash60(F.col(key)), shards))
    placed.repartition(shards * files, "shard", F.pmod(F.xxhash64(key), F.lit(files))).write.mode("overwrite").partitionBy("shard").parquet(path)
