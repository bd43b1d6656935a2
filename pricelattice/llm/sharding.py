"""Sharding by jump consistent hashing: no ring table, and one more shard takes rows only into itself."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, ship, table, with_fields
from .words import mix

NULL_KEY = 0x6E756C6C


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of 64-bit keys into 0..shards-1, all keys at once."""
    key = mix(keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    b = np.zeros(len(key), np.int64)
    j = np.zeros(len(key), np.float64)
    live = j < shards
    while live.any():
        b[live] = j[live].astype(np.int64)
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = (b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1.0))
        live &= j < shards
    return b.astype(np.int32)


def _deal(shards: int, key: str):
    def run(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
        for batch in batches:
            ids = batch.column(key)
            keys = ids.fill_null(NULL_KEY).cast(pa.int64()).to_numpy(zero_copy_only=False)
            shard, grown = jump_hash(keys, shards), jump_hash(keys, shards + 1)
            order = np.argsort(shard, kind="stable")
            count = np.bincount(shard, minlength=shards)
            at = np.empty(len(shard), np.int64)
            at[order] = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count)
            at += seen[shard]
            seen += count
            n = len(shard)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(shard), pa.array(grown), pa.array(np.full(n, part, np.int32)), pa.array(at)],
                [*batch.schema.names, "shard", "grown_shard", "_part", "_at"],
            )

    return run


def shard_rows(rows: DataFrame, shards: int = 8, key: str = "doc_id") -> DataFrame:
    """Adds shard, grown_shard (with one shard more) and slot (gapless from 0 in each shard).

    Only the integer key and the shard count decide; a null key is one fixed key. Rows that repeat a key share
    its shard and get slots of their own. Columns named like the added ones are replaced. The slots come from
    one pass that counts inside each task, and the tasks' counts added up: no shard is ever gathered in one place.
    """
    spark = rows.sparkSession
    ship(spark)
    rows = rows.drop("shard", "grown_shard", "slot", "_part", "_at")
    schema = with_fields(rows.schema, "shard int, grown_shard int, _part int, _at long")
    dealt = Work(spark, "shards").table(rows.mapInArrow(_deal(shards, key), schema), "dealt")
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    starts = counts.select("shard", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return dealt.join(starts, ["shard", "_part"]).withColumn("slot", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
    )
    out = shard_rows(rows, 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
