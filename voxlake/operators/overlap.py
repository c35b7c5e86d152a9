"""Agreement of two label maps beyond plain overlap: dilated rates, clusters and distances of surfaces."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixpoint, stencil


def dilated_rates(voxels: DataFrame, keys: list[str], a: str, b: str, voxel_volume: float = 1.0, background: int = 0) -> DataFrame:
    """Per label, what of each map lies outside the other's dilation by one voxel on all sides: shares of the map's own
    voxels (NaN without any) and volumes. A label is dilated within the grid's present voxels."""
    box = stencil.box(1, len(keys))

    def missed(own: str, other: str, name: str) -> DataFrame:
        spread = stencil.shifted(voxels.where(F.col(other) != background), keys, box, [other]).select(*keys, F.col(f"n_{other}").alias("label")).distinct()
        mine = voxels.where(F.col(own) != background).select(*keys, F.col(own).alias("label"))
        hit = mine.join(spread.withColumn("_hit", F.lit(1)), [*keys, "label"], "left")
        return hit.groupBy("label").agg(F.count("*").alias(f"n_{name}"), F.sum(F.when(F.col("_hit").isNull(), 1).otherwise(0)).alias(f"m_{name}"))

    both = missed(a, b, "a").join(missed(b, a, "b"), "label", "full").na.fill(0)
    share = lambda m, n: F.when(F.col(n) > 0, F.col(m) / F.col(n)).otherwise(F.lit(float("nan")))
    return both.select(
        "label",
        share("m_a", "n_a").alias("false_positive"),
        share("m_b", "n_b").alias("false_negative"),
        (F.col("m_a") * voxel_volume).alias("false_positive_volume"),
        (F.col("m_b") * voxel_volume).alias("false_negative_volume"),
    )


def matched_clusters(voxels: DataFrame, keys: list[str], size: tuple[int, ...], a: str, b: str, background: int = 0) -> tuple[DataFrame, DataFrame]:
    """26-connected clusters of each label in both maps, as voxels (keys, label, component) with `hit`: whether any voxel
    of the cluster has the label in the other map too."""

    def parts(own: str, other: str) -> DataFrame:
        mine = voxels.where(F.col(own) != background)
        found = fixpoint.components(mine, keys, size, 26, within=own).withColumnRenamed(own, "label")
        both = found.join(voxels.select(*keys, F.col(other).alias("_other")), keys).withColumn("_hit", F.col("_other") == F.col("label"))
        hits = both.groupBy("label", "component").agg(F.max("_hit").alias("hit"), F.count("*").alias("voxels"))
        return found.join(hits, ["label", "component"])

    return parts(a, b), parts(b, a)


def cluster_numbers(voxels: DataFrame, keys: list[str], size: tuple[int, ...], a: str, b: str) -> DataFrame:
    """Per label: clusters of the template b that a touches and misses, clusters of a that touch nothing, totals, and the
    mean sizes of each kind (null where there are none)."""
    of_a, of_b = matched_clusters(voxels, keys, size, a, b)
    one = lambda t: t.select("label", "component", "hit", "voxels").distinct()
    hit = F.col("hit")
    count = lambda c: F.sum(c.cast("int"))
    mean = lambda c: F.avg(F.when(c, F.col("voxels")))
    seg = one(of_a).groupBy("label").agg(count(~hit).alias("false_positives"), F.count("*").alias("segmented"), mean(~hit).alias("false_positive_size"), F.avg("voxels").alias("segmented_size"))
    tpl = one(of_b).groupBy("label").agg(
        count(hit).alias("true_positives"), count(~hit).alias("false_negatives"), F.count("*").alias("template"),
        mean(hit).alias("true_positive_size"), mean(~hit).alias("false_negative_size"), F.avg("voxels").alias("template_size"),
    )
    counts = ["false_positives", "segmented", "true_positives", "false_negatives", "template"]
    return seg.join(tpl, "label", "full").na.fill(0, counts)


def cluster_map(voxels: DataFrame, keys: list[str], size: tuple[int, ...], a: str, b: str, labels: list[int]) -> DataFrame:
    """A code per voxel of a cluster: 3n + 3 found, 3n + 2 false, 3n + 1 missed, for the n-th of the labels; of several,
    the last label's and, within it, the missed one's before the false one's."""
    of_a, of_b = matched_clusters(voxels, keys, size, a, b)
    number = F.array_position(F.array(*map(F.lit, labels)), F.col("label").cast("int")) - 1
    coded = lambda t, code: t.where(number >= 0).select(*keys, number.alias("n"), code.alias("k"))
    codes = coded(of_b, F.when(F.col("hit"), 3).otherwise(1)).unionAll(coded(of_a.where(~F.col("hit")), F.lit(2)))
    return codes.groupBy(*keys).agg(F.max_by(3 * F.col("n") + F.col("k"), F.struct("n", -F.col("k"))).alias("code"))


def inner_boundary(mask: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Voxels of the mask with a 6-neighbour in the grid that is outside it."""
    outside = grid.select(*keys).join(mask.select(*keys), keys, "left_anti")
    return mask.select(*keys).join(stencil.shifted(outside, keys, stencil.neighbours(6, len(keys)), []).select(*keys).distinct(), keys, "left_semi")


def _along(keys: list[str], axis: str, step: float, low: int, high: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The least over a line of squared distance so far plus the squared step, at all places from low to high."""
    others = [k for k in keys if k != axis]

    def nearest(key: tuple, table: pa.Table) -> pa.Table:
        place, at, d = np.arange(low, high + 1), table[axis].to_numpy(), table["_d"].to_numpy()
        best = np.full(len(place), np.inf)
        for first in range(0, len(at), 1024):
            own = slice(first, first + 1024)
            best = np.minimum(best, (((place[:, None] - at[None, own]) * step) ** 2 + d[None, own]).min(axis=1))
        line = {k: np.full(len(place), v.as_py(), np.int32) for k, v in zip(others, key, strict=True)} | {axis: place.astype(np.int32)}
        return pa.table({**{k: line[k] for k in keys}, "_d": best})

    return nearest


def euclidean(grid: DataFrame, keys: list[str], source: Column, resolution: tuple[float, ...] | None = None) -> DataFrame:
    """Exact Euclidean distance of every voxel of the grid to the nearest `source` voxel, null without one.

    One pass per axis: along each line, the least of the others' squared distance so far plus the squared step. A line
    is one group, so a task holds a line at a time and each place travels once per axis; lines without a source so far
    have no rows. Places absent from the grid are passed through.
    """
    resolution = resolution or (1.0,) * len(keys)
    bounds = grid.agg(*[f(k) for k in keys for f in (F.min, F.max)]).first()
    state = grid.where(source).select(*[F.col(k).cast("int").alias(k) for k in keys], F.lit(0.0).alias("_d"))
    schema = ", ".join(f"{k} int" for k in keys) + ", _d double"
    for i, (axis, step) in enumerate(zip(keys, resolution, strict=True)):
        if bounds[0] is not None:
            state = state.groupBy(*[k for k in keys if k != axis]).applyInArrow(_along(keys, axis, step, bounds[2 * i], bounds[2 * i + 1]), schema)
    return grid.select(*keys).join(state, keys, "left").select(*keys, F.sqrt("_d").alias("distance"))


def surface_agreement(voxels: DataFrame, keys: list[str], a: str, b: str, labels: list[int], resolution: tuple[float, ...] | None = None) -> DataFrame:
    """Per label, over the boundary voxels of both maps: mean, mean squared and largest Euclidean distance to the other
    boundary, and the signed mean (positive where the boundary of a lies inside b, or that of b outside a)."""
    out = []
    for label in labels:
        masks = [voxels.where(F.col(c) == label) for c in (a, b)]
        rims = [fixpoint.cut(inner_boundary(m, voxels, keys)) for m in masks]
        parts = []
        for i in (0, 1):
            there = voxels.select(*keys, (F.col((a, b)[1 - i]) == label).alias("_in")).join(rims[1 - i].withColumn("_rim", F.lit(True)), keys, "left")
            field = euclidean(there, keys, F.col("_rim").isNotNull(), resolution)
            sign = F.when(F.col("_in"), 1.0 if i == 0 else -1.0).otherwise(-1.0 if i == 0 else 1.0)
            parts.append(field.join(rims[i], keys, "left_semi").join(there.select(*keys, "_in"), keys).select("distance", (sign * F.col("distance")).alias("signed")))
        both = parts[0].unionAll(parts[1]).where("distance is not null")
        d = F.col("distance")
        out.append(both.agg(F.lit(label).alias("label"), F.count("*").alias("voxels"), F.avg(d).alias("average"), F.avg("signed").alias("difference"), F.avg(d * d).alias("squared"), F.max(d).alias("hausdorff")))
    return reduce(DataFrame.unionAll, out)


def level_of_probability(voxels: DataFrame, keys: list[str], p: str, uncrossed: float | None = 1.0) -> DataFrame:
    """Level set of a probability's half: half less the probability at voxels with a 6-neighbour on the other side; else
    signed distance to the nearest of these, negative inside. Where no neighbours lie on different sides, the distance is
    `uncrossed`; if that is None there are no rows. Probabilities are computed once, so that all steps see the same sides."""
    voxels = fixpoint.cut(voxels.select(*keys, p))
    inside = F.col(p) >= 0.5
    other = F.col(f"n_{p}") >= 0.5
    pairs = stencil.stencil(voxels, keys, stencil.neighbours(6, len(keys)), [p], [p])
    rim = fixpoint.cut(pairs.where(inside != other).select(*keys).distinct())
    marked = voxels.join(rim.withColumn("_rim", F.lit(True)), keys, "left")
    far = euclidean(marked, keys, F.col("_rim").isNotNull())
    if uncrossed is None:
        far = far.where(F.col("distance").isNotNull())
    side = F.when(inside, -1.0).otherwise(1.0)
    return marked.join(far, keys).select(*keys, F.when(F.col("_rim").isNotNull(), 0.5 - F.col(p)).otherwise(side * F.coalesce("distance", F.lit(uncrossed))).alias("phi"))
