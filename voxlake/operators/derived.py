"""Maps derived from labels, layers and series: distance memberships, layer smoothing, partial correlations, unwrapping,
component trees and extracted regions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fixpoint, overlap, stencil

TURN = 2 * math.pi


def label_level(voxels: DataFrame, keys: list[str], label: str, which: int) -> DataFrame:
    """Signed distance to a label's border half way between voxels, negative inside; null on a map without a border."""
    inside = F.col(label) == which
    out, into = (overlap.euclidean(voxels, keys, c).withColumnRenamed("distance", n) for c, n in ((inside, "_out"), (~inside, "_in")))
    joined = voxels.select(*keys, label).join(out, keys).join(into, keys)
    return joined.select(*keys, label, F.when(inside, 0.5 - F.col("_in")).otherwise(F.col("_out") - 0.5).alias("level"))


def distance_memberships(voxels: DataFrame, keys: list[str], label: str, labels: list[int], ratio: float, background_scale: float) -> DataFrame:
    """keys, label, membership: half at a label's border, rising inside and falling outside by the signed distance over
    `ratio` times the label's greatest depth (the first label, the background: over background_scale), and the background
    at most what the others leave."""
    parts = []
    for which in labels:
        level = fixpoint.cut(label_level(voxels, keys, label, which))
        if which == labels[0]:
            scale = F.lit(background_scale)
        else:
            depth = level.where(F.col(label) == which).agg(F.max(-F.col("level"))).first()[0]
            scale = F.lit(ratio * float(depth or 0.5))
        share = F.least(F.greatest(0.5 - 0.5 * F.col("level") / scale, F.lit(0.0)), F.lit(1.0))
        whole = F.when(F.col(label) == which, 1.0).otherwise(0.0)
        parts.append(level.select(*keys, F.lit(which).alias("of"), F.coalesce(share, whole).alias("p")))
    every = reduce(DataFrame.unionAll, parts)
    others = F.sum(F.when(F.col("of") != labels[0], F.col("p")).otherwise(0.0)).over(Window.partitionBy(*keys))
    left = F.least(F.col("p"), F.greatest(1 - others, F.lit(0.0)))
    return every.select(*keys, F.col("of").alias("label"), F.when(F.col("of") == labels[0], left).otherwise(F.col("p")).alias("membership"))


def merged_membership(distance: Column, prior: Column, how: str) -> Column:
    """A distance membership and a prior as geometric mean (product), minimum or mean (sum)."""
    return {"product": F.sqrt(distance * prior), "minimum": F.least(distance, prior), "sum": 0.5 * (distance + prior)}[how]


def layer_smoothed(voxels: DataFrame, keys: list[str], value: str, layers: list[str], sigma: float, size: tuple[int, ...], margin: int = 2) -> DataFrame:
    """Smoothing along layers between the level sets in columns `layers`, from inner to outer.

    A voxel's share in a layer is the difference of its shares inside the layer's two surfaces. Each round averages, per
    layer, over the 26 neighbours in the ribbon by share, a Gaussian weight and inverse distance, and then over layers
    by the voxel's own shares; as many rounds as half-voxel Gaussians make up `sigma` voxels. `margin` voxels at the
    grid's edge are left out.
    """
    rounds = max(1, math.ceil(sigma * sigma / 0.25))
    weight = math.exp(-1 / (2 * sigma * sigma / rounds))
    rim = [F.col(k).between(margin, n - 1 - margin) for k, n in zip(keys, size, strict=True)]
    ribbon = (F.col(layers[0]) >= 0) & (F.col(layers[-1]) <= 0)
    inside = [F.least(F.greatest(0.5 - F.col(c), F.lit(0.0)), F.lit(1.0)) for c in layers]
    shares = [F.greatest(b - a, F.lit(0.0)).alias(f"_s{i}") for i, (a, b) in enumerate(zip(inside, inside[1:], strict=False))]
    names = [f"_s{i}" for i in range(len(shares))]
    state = fixpoint.cut(voxels.where(reduce(Column.__and__, [ribbon, *rim])).select(*keys, F.col(value).cast("double").alias("smooth"), *shares))
    for _ in range(rounds):
        near = stencil.stencil(state, keys, stencil.neighbours(26, len(keys)), ["smooth", *names], ["smooth", *names])
        w = weight / F.sqrt(reduce(Column.__add__, [(F.col(f"d{k}") * F.col(f"d{k}")).cast("double") for k in keys]))
        sums = [f(w * F.col(f"n_{n}") * v).alias(a) for n in names for f, v, a in ((F.sum, F.col("n_smooth"), f"v{n}"), (F.sum, F.lit(1.0), f"w{n}"))]
        joined = state.join(near.groupBy(*keys).agg(*sums), keys, "left")
        layer = [F.when(F.col(n) > 0, F.col(n) * (F.col(n) * F.col("smooth") + F.coalesce(f"v{n}", F.lit(0.0))) / (F.col(n) + F.coalesce(f"w{n}", F.lit(0.0)))).otherwise(0.0) for n in names]
        total = reduce(Column.__add__, [F.col(n) for n in names])
        state = fixpoint.cut(joined.select(*keys, F.when(total > 0, reduce(Column.__add__, layer) / total).otherwise(F.col("smooth")).alias("smooth"), *names))
    return state.select(*keys, "smooth")


def partial_correlations(voxels: DataFrame, keys: list[str], series: str) -> DataFrame:
    """Per voxel, the number of its opposite pairs of 26-neighbours that are both present, and the mean and least partial
    correlation of a pair given the voxel between them."""
    mean = F.aggregate(series, F.lit(0.0), lambda a, v: a + v) / F.size(series)
    centred = F.transform(series, lambda v: v - mean)
    length = F.sqrt(F.aggregate(centred, F.lit(0.0), lambda a, v: a + v * v))
    rows = voxels.select(*keys, F.transform(centred, lambda v: v / length).alias("u"))
    ahead = [o for o in stencil.neighbours(26, len(keys)) if o > (0,) * len(keys)]
    one = stencil.stencil(rows, keys, [tuple(-k for k in o) for o in ahead], ["u"], ["u"])
    two = stencil.shifted(rows, keys, ahead, ["u"]).select(*keys, F.col("n_u").alias("back"), *[(-F.col(f"d{k}")).alias(f"d{k}") for k in keys])
    both = one.join(two, [*keys, *[f"d{k}" for k in keys]])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    ends, left, right = dot("n_u", "back"), dot("u", "n_u"), dot("u", "back")
    power = (1 - left * left) * (1 - right * right)
    partial = both.select(*keys, F.when(power > 1e-12, (ends - left * right) / F.sqrt(power)).alias("r"))
    return partial.groupBy(*keys).agg(F.count("r").alias("pairs"), F.avg("r").alias("mean"), F.min("r").alias("least"))


def unwrapped(volumes: DataFrame, group: str, keys: list[str], phase: str) -> DataFrame:
    """Phases without jumps of a turn: along the spanning forest of 6-neighbours that takes the smallest steps first, whole
    turns are added so that no step exceeds half a turn. Each part keeps the phase of its first voxel.

    Steps are taken in order of size, so each volume is one task: a volume must fit in it.
    """
    name = F.col(phase).cast("double").alias(phase)
    schema = f"{group} {dict(volumes.dtypes)[group]}, " + ", ".join(f"{k} int" for k in keys) + f", {phase} double, unwrapped double"
    steps = [o for o in stencil.neighbours(6, len(keys)) if o > (0,) * len(keys)]

    def kernel(table: pa.Table) -> pa.Table:
        at = np.stack([table[k].to_numpy() for k in keys], 1)
        at = at - at.min(axis=0)
        order = np.lexsort(at.T)
        table, at = table.take(pa.array(order)), at[order]
        value = table[phase].to_numpy()
        cube = np.full(at.max(axis=0) + 2, -1)
        cube[tuple(at.T)] = np.arange(len(at))
        pairs = []
        for step in steps:
            other = cube[tuple((at + step).T)]
            hit = np.flatnonzero(other >= 0)
            pairs.append(np.stack([hit, other[hit]]))
        a, b = np.concatenate(pairs, axis=1)
        gap = value[a] - value[b]
        turns = np.floor(gap / TURN + 0.5).astype(np.int64)
        ranked = np.argsort(np.abs(gap - turns * TURN), kind="stable")
        parent, shift = list(range(len(at))), [0] * len(at)  # turns to add beyond those of the parent

        def root(i: int) -> tuple[int, int]:
            path, total = [], 0
            while parent[i] != i:
                path.append(i)
                i = parent[i]
            for p in reversed(path):
                total += shift[p]
                parent[p], shift[p] = i, total
            return i, total

        for i, j, k in zip(a[ranked].tolist(), b[ranked].tolist(), turns[ranked].tolist(), strict=True):
            (p, m), (q, n) = root(i), root(j)
            if p == q:
                continue
            if p < q:  # the earlier voxel's part keeps its turns
                parent[q], shift[q] = p, m + k - n
            else:
                parent[p], shift[p] = q, n - k - m
        added = np.array([root(i)[1] for i in range(len(at))])
        return table.append_column("unwrapped", pa.array(value + TURN * added))

    return volumes.select(group, *[F.col(k).cast("int").alias(k) for k in keys], name).groupBy(group).applyInArrow(kernel, schema)


def component_tree(voxels: DataFrame, keys: list[str], size: tuple[int, ...], value: str, levels: list[float], connectivity: int = 6) -> DataFrame:
    """level, component, voxels, peak and parent: the parts of the voxels at or above each of the rising levels, and the
    part of the level below that holds each; null at the lowest level."""
    out, below = [], None
    for n, level in enumerate(levels):
        above = voxels.where(F.col(value) >= level)
        parts = fixpoint.cut(fixpoint.components(above, keys, size, connectivity))
        sized = parts.join(above.select(*keys, value), keys)
        sized = sized.join(below, keys) if below is not None else sized.withColumn("parent", F.lit(None).cast("long"))
        out.append(sized.groupBy("component").agg(F.count("*").alias("voxels"), F.max(value).alias("peak"), F.first("parent").alias("parent")).select(F.lit(n).alias("level"), "component", "voxels", "peak", "parent"))
        below = parts.withColumnRenamed("component", "parent")
    return reduce(DataFrame.unionAll, out)


def extracted_region(voxels: DataFrame, keys: list[str], label: str, region: list[int], size: tuple[int, ...], margin: int = 1) -> DataFrame:
    """Labels of a region numbered from 1 in the order given, 0 elsewhere, on the region's bounding box with a margin
    within the grid, moved to begin at 0."""
    number = F.coalesce(F.array_position(F.array(*map(F.lit, region)), F.col(label).cast("int")), F.lit(0)).cast("int")
    inside = F.when(number > 0, 1)
    box = voxels.agg(*[f(F.when(inside.isNotNull(), F.col(k))).alias(f"_{n}{k}") for k in keys for n, f in (("a", F.min), ("b", F.max))])
    joined = voxels.crossJoin(F.broadcast(box))  # one row
    for k, n in zip(keys, size, strict=True):
        joined = joined.where(F.col(k).between(F.greatest(F.col(f"_a{k}") - margin, F.lit(0)), F.least(F.col(f"_b{k}") + margin, F.lit(n - 1))))
    moved = [(F.col(k) - F.greatest(F.col(f"_a{k}") - margin, F.lit(0))).cast("int").alias(k) for k in keys]
    return joined.select(*moved, number.alias("part"))


def label_probability(top: DataFrame, keys: list[str], label: str, p: str, which: int) -> DataFrame:
    """One label's probability out of the most probable labels of each voxel, 0 where it isn't among them."""
    return top.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col(label) == which, F.col(p))), F.lit(0.0)).alias("probability"))
