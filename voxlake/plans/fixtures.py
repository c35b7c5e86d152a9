"""Tables of the driver read as image data: voxel grids, series and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GRID = (16, 16, 8)
KEYS = ["x", "y", "z"]
#: Keep rounded means off ties, which two engines may round apart.
SCALES = (0.98765432, 1.01234567)

#: The same grid in DuckDB.
VOX = """vox AS (
  SELECT (l_orderkey % 16)::INT AS x, (l_partkey % 16)::INT AS y, (l_suppkey % 8)::INT AS z,
         avg(l_extendedprice) * 0.98765432 AS v, avg(l_quantity) * 1.01234567 AS w,
         (sum(l_linenumber) % 4)::INT AS seg, (sum(l_linenumber + l_orderkey) % 4)::INT AS tpl,
         (sum(l_linenumber) % 8 = 0) AS mask
  FROM lineitem GROUP BY 1, 2, 3)"""
SERIES = """series AS (
  SELECT user_id, value AS v, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS t FROM events)"""


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """x, y, z, v, w, seg, tpl, mask: intensities, two label maps and a sparse mask on one grid."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    x, y, z = ((F.col(c) % n).cast("int").alias(a) for c, n, a in zip(("l_orderkey", "l_partkey", "l_suppkey"), GRID, KEYS, strict=True))
    return items.groupBy(x, y, z).agg(
        (F.avg("l_extendedprice") * SCALES[0]).alias("v"),
        (F.avg("l_quantity") * SCALES[1]).alias("w"),
        (F.sum("l_linenumber") % 4).cast("int").alias("seg"),
        (F.sum(F.col("l_linenumber") + F.col("l_orderkey")) % 4).cast("int").alias("tpl"),
        (F.sum("l_linenumber") % 8 == 0).alias("mask"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, t, v: a series per user in time order."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    t = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return events.select("user_id", t.alias("t"), F.col("value").alias("v"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, profile: one array over depth per vector."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", "label", F.transform("embedding", lambda e: e.cast("double")).alias("profile"))
