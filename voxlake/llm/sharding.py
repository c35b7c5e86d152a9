"""Sharding by jump consistent hashing: a stable key and the shard count decide, with no ring table."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import HOT_ROWS, PARTS, columns, fresh, read_table, store

#: Slots are dealt per shard and sub-bucket, so no task ranks a whole shard; the table of offsets has
#: shards x SUB_BUCKETS rows at most.
SUB_BUCKETS = 512


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key (Lamping and Veach, 2014), all keys at once.

    The candidate bucket only grows, and expected O(log shards) rounds suffice.
    """
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    todo = np.arange(len(state))
    reached = np.zeros(len(state), np.int64)
    while len(todo):
        shard[todo] = reached[todo]
        with np.errstate(over="ignore"):
            state[todo] = state[todo] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[todo] >> np.uint64(33)).astype(np.float64) + 1.0)
        reached[todo] = np.floor((shard[todo] + 1) * step).astype(np.int64)
        todo = todo[reached[todo] < shards]
    return shard.astype(np.int32)


def stable_key(key: Column) -> Column:
    """60 bits of the key's md5; the same on any engine. A null key counts as an empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def shard_of(key: Column, shards: int) -> Column:
    """Shard from 0 of a key column."""

    @F.pandas_udf("int")
    def jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(np.int64), shards))

    return jump(stable_key(key))


def assign(docs: DataFrame, key: str, shards: int, ties: list[str], sub_buckets: int = SUB_BUCKETS) -> DataFrame:
    """docs with shard, grown_shard (with one shard more) and slot, gapless from 0 in each shard.

    A row's shard depends on its key and the shard count alone, so all rows of a key share a shard and one
    more shard takes rows only into itself. Null keys hash as an empty text. Slots order by a sub-bucket of
    `ties`, then by `ties`; rows equal in all of them take neighbouring slots in any order. An empty table
    gives an empty result. Only counts per shard and sub-bucket are broadcast (shards x sub_buckets rows), and
    groups of rows equal in `ties` that are hot: PARTS at most. Such a group is one row in the order of its
    sub-bucket, and its own rows are numbered in many tasks.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    sub, uid, n, start, slot_in, chunk, group = (fresh(x, docs) for x in ("sub", "uid", "n", "start", "within", "chunk", "group"))
    places = {
        "shard": shard_of(F.col(key), shards),
        "grown_shard": shard_of(F.col(key), shards + 1),
        sub: (stable_key(F.concat_ws("/", *ties)) % sub_buckets).cast("int"),
        uid: F.monotonically_increasing_id(),
    }
    placed = store(docs.withColumns(places), "placed")
    total = placed.count()
    counts = placed.groupBy("shard", sub).agg(F.count("*").alias(n))
    before = Window.partitionBy("shard").orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select("shard", sub, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start)))
    hot = placed.groupBy("shard", sub, *ties).agg(F.count("*").alias(n)).where(F.col(n) >= max(HOT_ROWS, total // PARTS))
    hot = store(hot.withColumn(group, F.monotonically_increasing_id()), "hot-keys")
    order = Window.partitionBy("shard", sub).orderBy(*ties)
    if hot.isEmpty():
        ranked = placed.withColumn(slot_in, F.row_number().over(order) - 1)
    else:
        same = reduce(Column.__and__, [placed[t].eqNullSafe(hot[t]) for t in ties])
        rest = placed.join(F.broadcast(hot.select(*ties)), same, "left_anti").withColumn(n, F.lit(1).cast("long"))
        both = rest.unionByName(hot, allowMissingColumns=True)
        led = both.withColumn(slot_in, F.coalesce(F.sum(n).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        led = store(led, "ranked")
        heads = F.broadcast(led.where(F.col(group).isNotNull()).select(group, F.col(slot_in).alias(f"{slot_in}_")))
        rows = placed.join(F.broadcast(hot.select(*[F.col(t).alias(f"{t}_hot") for t in ties], group)), reduce(Column.__and__, [F.col(t).eqNullSafe(F.col(f"{t}_hot")) for t in ties]))
        rows = rows.drop(*[f"{t}_hot" for t in ties]).withColumn(chunk, F.shiftright(uid, 16))
        up = Window.partitionBy(group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
        chunks = rows.groupBy(group, chunk).agg(F.count("*").alias(n)).select(group, chunk, F.coalesce(F.sum(n).over(up), F.lit(0)).alias(n))
        own = F.row_number().over(Window.partitionBy(group, chunk).orderBy(uid)) - 1
        rows = rows.withColumn(f"{chunk}_", own).join(chunks, [group, chunk]).join(heads, group)
        rows = rows.withColumn(slot_in, F.col(f"{slot_in}_") + F.col(n) + F.col(f"{chunk}_"))
        ranked = led.where(F.col(group).isNull()).select(*placed.columns, slot_in).unionByName(rows.select(*placed.columns, slot_in))
    found = ranked.join(offsets, ["shard", sub]).withColumn("slot", F.col(start) + F.col(slot_in))
    return found.select(*columns(docs), "shard", "grown_shard", "slot")


def op4_jump_shards(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    """All documents in shards 0 to 15 under the law `key`; sizes and checksums of the whole UTF-8 texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = read_table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return assign(docs, "doc_id", shards, ["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )
