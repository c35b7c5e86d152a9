"""Label maps and masks: relabelling, set algebra, top-k probabilities, cropping and reorientation."""

from __future__ import annotations

import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREDICATES = {"equal": operator.eq, "unequal": operator.ne, "superior": operator.gt, "inferior": operator.lt, "supequal": operator.ge, "infequal": operator.le}


def extracted(rows: DataFrame, column: str, how: str, level: float) -> DataFrame:
    """Voxels whose value stands in the named relation to level; the filter reaches the scan."""
    return rows.where(PREDICATES[how](F.col(column), F.lit(level)))


def relabelled(rows: DataFrame, label: str, table: DataFrame) -> DataFrame:
    """Labels replaced by a table (old, new); unmatched ones become 0. Spark broadcasts the table by its size."""
    return rows.join(table.select(F.col("old").alias(label), "new"), label, "left").withColumn("new", F.coalesce("new", F.lit(0)))


def mask_and(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def mask_or(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).union(b.select(*keys)).distinct()


def mask_xor(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    both = a.select(*keys, F.lit(1).alias("_s")).union(b.select(*keys, F.lit(2).alias("_s")))
    return both.groupBy(*keys).agg(F.countDistinct("_s").alias("_n")).where("_n = 1").select(*keys)


def mask_not(a: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    return grid.select(*keys).join(a.select(*keys), keys, "left_anti")


def top_labels(rows: DataFrame, keys: list[str], label: str, p: str, k: int) -> DataFrame:
    """The k most probable labels of each voxel; ties go to the smaller label."""
    best = Window.partitionBy(*keys).orderBy(F.desc(p), label)
    return rows.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def merged_labels(maps: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Majority label of each voxel over several maps; ties go to the smaller label."""
    votes = maps.groupBy(*keys, label).agg(F.count("*").alias("votes"))
    return votes.groupBy(*keys).agg(F.max_by(label, F.struct("votes", -F.col(label))).alias(label), F.max("votes").alias("votes"), F.sum("votes").alias("maps"))


def cropped(rows: DataFrame, keys: list[str], low: tuple[int, ...], high: tuple[int, ...]) -> DataFrame:
    """Voxels of a box (ends inside), moved so that it begins at 0."""
    for k, a, b in zip(keys, low, high, strict=True):
        rows = rows.where(F.col(k).between(a, b))
    return rows.withColumns({k: F.col(k) - a for k, a in zip(keys, low, strict=True)})


def bounding_boxes(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    ends = [f(k).alias(f"{k}_{n}") for k in keys for f, n in ((F.min, "low"), (F.max, "high"))]
    return rows.groupBy(label).agg(*ends)


def mirrored(rows: DataFrame, axis: str, n: int) -> DataFrame:
    return rows.withColumn(axis, F.lit(n - 1) - F.col(axis))


def permuted(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Axes in another order: the first key takes what `order` names first."""
    return rows.withColumns({k: F.col(o) for k, o in zip(keys, order, strict=True)})


def padded_slices(rows: DataFrame, axis: str, keep: int) -> DataFrame:
    return rows.where(F.col(axis) == keep)


def distinct_labels(rows: DataFrame, label: str) -> DataFrame:
    return rows.select(label).distinct().withColumn("number", F.dense_rank().over(Window.orderBy(label)) - 1)


def signed_level(inside: Column, distance: Column) -> Column:
    """Signed distance, negative inside."""
    return F.when(inside, -distance).otherwise(distance)


def level_to_probability(phi: Column, scale: float) -> Column:
    """Membership from a level set: 0.5 at its zero, towards 1 inside."""
    return 0.5 + 0.5 * F.least(F.greatest(-phi / scale, F.lit(-1.0)), F.lit(1.0))
