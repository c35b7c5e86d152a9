"""Profiles across layers in space: points along the layers' gradients, what images hold there, and fits over depth."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stencil

#: Gradient below which a level has no direction, squared residual at which a point lies on it, and rounds at most:
#: fixed values.
LEAST_GRADIENT, CLOSE, ROUNDS = 0.01, 0.0001, 100


def interpolated(cube: np.ndarray, at: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Linear interpolation of a cube at points (n, 3). Without a mask, corners that count and are absent make it 0; with
    one, the mean over the corners in the mask, NaN without any."""
    low = np.floor(at).astype(int)
    share = at - low
    total, weight, whole = np.zeros(len(at)), np.zeros(len(at)), np.ones(len(at), bool)
    size = np.array(cube.shape)
    for corner in np.ndindex(2, 2, 2):
        place = low + corner
        w = np.prod(np.where(corner, share, 1 - share), axis=1)
        inside = ((place >= 0) & (place < size)).all(axis=1)
        place = np.where(inside[:, None], place, 0)
        value = np.where(inside, cube[tuple(place.T)], np.nan)
        known = ~np.isnan(value) & (True if mask is None else inside & mask[tuple(place.T)])
        total += np.where(known, w * np.nan_to_num(value), 0.0)
        weight += np.where(known, w, 0.0)
        whole &= known | (w == 0)
    if mask is None:
        return np.where(whole, total, 0.0)
    return np.where(weight > 0, total / np.where(weight > 0, weight, 1), np.nan)


def on_level(cube: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Points moved onto a level set: a step of its value against its gradient, then rounds that take half of the last step
    back and step anew, until the value there is close to 0 or the gradient is lost."""

    def slope(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = np.stack([0.5 * (interpolated(cube, at + step) - interpolated(cube, at - step)) for step in np.eye(3)], 1)
        norm = np.sqrt((d * d).sum(axis=1))
        return interpolated(cube, at), d / np.where(norm > 0, norm, 1)[:, None], norm

    length, way, norm = slope(start)
    moving = norm > LEAST_GRADIENT
    at = np.where(moving[:, None], start - length[:, None] * way, start)
    for _ in range(ROUNDS):
        moving = moving & (interpolated(cube, at) ** 2 > CLOSE)
        run = np.flatnonzero(moving)
        if not len(run):
            break
        back = at[run] + 0.5 * length[run, None] * way[run]
        l, w, n = slope(back)
        good = n > LEAST_GRADIENT
        at[run] = np.where(good[:, None], back - l[:, None] * w, back)
        length[run], way[run], moving[run] = l, w, good
    return at


def trajectories(layers: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Points (n, layers, 3) of the profiles through voxels: onto the nearest layer, the first of equals, then from each
    layer's point onto the next."""
    centre = np.stack([layer[tuple(start.astype(int).T)] for layer in layers])
    first = np.argmin(np.abs(centre), axis=0)
    points = np.zeros((len(start), len(layers), 3))
    for f in np.unique(first):
        own = np.flatnonzero(first == f)
        points[own, f] = on_level(layers[f], start[own])
        for i in range(f - 1, -1, -1):
            points[own, i] = on_level(layers[i], points[own, i + 1])
        for i in range(f + 1, len(layers)):
            points[own, i] = on_level(layers[i], points[own, i - 1])
    return points


def sampled(rows: DataFrame, keys: list[str], layers: list[str], value: str, reach: int, resolution: tuple[float, float, float] = (1.0, 1.0, 1.0), mask: str | None = None, nearest: bool = False) -> DataFrame:
    """Per voxel of the mask (by default, those between the first and the last layer): s0, s1, ... the image where the
    voxel's profile meets each layer, linear (or nearest) within the mask and null without it, and the profile's length,
    mean curvature and mean torsion (null with fewer than three intervals).

    Blocks travel with a halo of `reach` voxels, which profiles mustn't leave: a profile that does raises an error, as a
    larger reach is needed. Rows with a null or NaN level or value are absent.
    """
    columns = [*layers, value, *([mask] if mask else [])]
    n = len(layers)
    outputs = {"length": "double", "curvature": "double", "torsion": "double"} | {f"s{i}": "double" for i in range(n)}

    def kernel(cubes: np.ndarray, shift: Callable) -> dict[str, np.ndarray]:
        levels, image = cubes[:n], cubes[n]
        inside = (np.nan_to_num(cubes[n + 1]) > 0) if mask else (levels[0] >= 0) & (levels[-1] <= 0)
        side = cubes.shape[1] - 2 * reach
        own = np.argwhere(inside[(slice(reach, reach + side),) * 3]) + reach
        shape = (side,) * 3
        out = {name: np.full(shape, np.nan) for name in outputs}
        if not len(own):
            return out
        points = trajectories(levels, own.astype(float))
        if (np.abs(points - own[:, None]) > reach - 1).any():
            raise ValueError(f"a profile is longer than the reach of {reach} voxels")
        place = tuple((own - reach).T)
        for i in range(n):
            at = np.floor(points[:, i] + 0.5) if nearest else points[:, i]
            out[f"s{i}"][place] = interpolated(image, at, inside)
        step = np.diff(points, axis=1) * np.array(resolution)
        out["length"][place] = np.sqrt((step * step).sum(axis=2)).sum(axis=1)
        if n > 3:
            bends = bent(points)
            out["curvature"][place], out["torsion"][place] = bends
        return out

    found = stencil.by_block_many(rows, keys, columns, reach, outputs, kernel, side=16)
    empty = [F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in outputs]
    return found.select(*keys, *empty)


def bent(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of curvature and torsion by central differences over the intervals less two."""
    share = points.shape[1] - 3
    p = lambda i, j: points[:, i : points.shape[1] - j]
    first, second = (p(2, 0) - p(0, 2)) / 2, p(2, 0) - 2 * p(1, 1) + p(0, 2)
    across = np.cross(first, second)
    with np.errstate(divide="ignore", invalid="ignore"):
        curvature = np.sqrt((across**2).sum(axis=2)) / (first**2).sum(axis=2) ** 1.5
        if points.shape[1] < 5:
            return curvature.sum(axis=1) / share, np.zeros(len(points))
        third = (p(4, 0) - 2 * p(3, 1) + 2 * p(1, 3) - p(0, 4)) / 2
        inner, outer = first[:, 1:-1], second[:, 1:-1]
        torsion = (third * across[:, 1:-1]).sum(axis=2) / ((inner**2).sum(axis=2) * (outer**2).sum(axis=2))
    return curvature.sum(axis=1) / share, torsion.sum(axis=1) / share


def measured(rows: DataFrame, keys: list[str], samples: list[str]) -> DataFrame:
    """Mean, deviation (n - 1), least, greatest and median of each profile's samples that aren't null."""
    every = F.array_sort(F.filter(F.array(*samples), lambda v: v.isNotNull()))
    n = F.size("_s")
    mean = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v) / n
    spread = F.aggregate("_s", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    middle = (F.element_at("_s", F.floor((n + 1) / 2).cast("int")) + F.element_at("_s", F.floor(n / 2).cast("int") + 1)) / 2
    held = rows.select(*keys, every.alias("_s")).where(n > 0).withColumn("mean", mean)
    return held.select(*keys, n.alias("n"), "mean", F.when(n > 1, F.sqrt(spread / (n - 1))).alias("std"), F.array_min("_s").alias("least"), F.array_max("_s").alias("most"), middle.alias("median"))


def chebyshev_fit(rows: DataFrame, ids: list[str], profile: str, depths: int, degree: int = 5) -> DataFrame:
    """c0, c1, ... of the least-squares Chebyshev polynomial over depth and `residual`, the greatest deviation from it:
    fixed linear maps of the profile, with no shuffle. All profiles have `depths` samples; others have nulls."""
    basis = np.polynomial.chebyshev.chebvander(np.linspace(-1, 1, depths), degree)
    inverse = np.linalg.pinv(basis)
    row = lambda values: F.array(*[F.lit(float(v)) for v in values])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    p = F.col(profile)
    rows = rows.select(*ids, p.alias("_p"), *[dot(p, row(r)).alias(f"c{d}") for d, r in enumerate(inverse)])
    fits = F.array(*[F.abs(sum((F.col(f"c{d}") * float(b) for d, b in enumerate(line)), F.lit(0.0)) - F.col("_p")[i]) for i, line in enumerate(basis)])
    return rows.select(*ids, *[f"c{d}" for d in range(degree + 1)], F.array_max(fits).alias("residual"))


def binned_percentiles(rows: DataFrame, group: str, value: str, shares: dict[str, float], bins: int) -> DataFrame:
    """Per group, values below which shares lie, linear within the bin of a histogram between least and greatest value."""
    ends = rows.groupBy(group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.count(value).alias("_n"))
    width = F.col("_hi") - F.col("_lo")
    at = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width * bins), F.lit(bins - 1))).otherwise(0)
    counts = rows.join(ends, group).where(F.col(value).isNotNull()).groupBy(group, at.alias("_b"), "_lo", "_hi", "_n").agg(F.count("*").alias("_c"))
    up = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)  # `bins` rows a group
    run = counts.withColumn("_u", F.sum("_c").over(up))
    edge: Callable[[Column], Column] = lambda b: F.col("_lo") + b / bins * width
    out = []
    for name, share in shares.items():
        want = share * F.col("_n")
        hit = (F.col("_u") >= want) & (F.col("_u") - F.col("_c") < want)
        out.append(F.max(F.when(hit, (edge(F.col("_b")) * (F.col("_u") - want) + edge(F.col("_b") + 1) * (want - F.col("_u") + F.col("_c"))) / F.col("_c"))).alias(name))
    return run.groupBy(group).agg(*out)


def profile_weights(rows: DataFrame, ids: list[str], coefficients: list[str], bins: int = 100) -> DataFrame:
    """Weight of each profile by how near its coefficients are to their medians, in units of 1.349 quartile ranges:
    exp(-half the sum of squares); coefficients without a range don't count."""
    pairs = F.array(*[F.struct(F.lit(i).alias("d"), F.col(c).alias("c")) for i, c in enumerate(coefficients)])
    long = rows.select(*ids, F.inline(pairs))
    found = binned_percentiles(long, "d", "c", {"q1": 0.25, "q2": 0.5, "q3": 0.75}, bins)
    table = found.agg(F.map_from_entries(F.collect_list(F.struct("d", F.struct("q1", "q2", "q3")))).alias("_t"))  # a row per coefficient
    terms = []
    for i, c in enumerate(coefficients):
        q = F.col("_t")[i]
        scale = 1.349 * (q["q3"] - q["q1"])
        terms.append(F.when(scale > 0, F.pow((F.col(c) - q["q2"]) / scale, F.lit(2))).otherwise(0.0))
    return rows.crossJoin(F.broadcast(table)).select(*ids, F.exp(-0.5 * sum(terms, F.lit(0.0))).alias("weight"))  # one row
