"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_path, hot_join, new_path


def _with_least(edges: DataFrame, total: int, down: bool) -> DataFrame:
    """Edges (a, b) with m, the least of a's ends b, and of a itself unless edges go down; hubs aren't shuffled."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    if not down:
        least = least.select("a", F.least("a", "m").alias("m"), "n")
    return hot_join(edges, least.select("a", "m"), "a", least, total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour above a node is hung on the node's least neighbour."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, 2 * total, False).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """A node and its neighbours below it are hung on the least of those; edges point from a down to b."""
    hung = _with_least(edges, total, True).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.unionAll(edges.groupBy("a").agg(F.min("b").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of an edge table (a long, b long); component is the least node reachable.

    Loops and repeated edges are allowed, null ends are ignored. Minima are combined before each shuffle and a hub's
    edges meet them by a broadcast. Each half round is written to the shared folder; nothing but counts and checksums
    reaches the driver.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    seen, held = None, []
    while True:
        path = new_path(spark, "components")
        now.write.parquet(path)
        for old in held:
            drop_path(spark, old)
        now = spark.read.schema("a long, b long").parquet(path)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen, half = state, new_path(spark, "components")
        _large_star(now, state[0]).distinct().write.parquet(half)
        held = [path, half]
        now = _small_star(spark.read.schema("a long, b long").parquet(half), state[0]).distinct()
