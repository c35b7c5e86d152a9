"""Neighbourhoods on voxel grids: offsets, shifted joins, windows along an axis, morphology, filters and gradients."""

from __future__ import annotations

import itertools
import math
import warnings
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Offsets = list[tuple[int, ...]]


def neighbours(connectivity: int, dimensions: int = 3) -> Offsets:
    """Offsets of 4 or 8 (2-D) and 6, 18 or 26 (3-D) neighbours."""
    reach = {4: 1, 8: 2, 6: 1, 18: 2, 26: 3}[connectivity]
    every = itertools.product((-1, 0, 1), repeat=dimensions)
    return [o for o in every if 0 < sum(map(abs, o)) <= reach]


def box(radius: int, dimensions: int = 3) -> Offsets:
    return list(itertools.product(range(-radius, radius + 1), repeat=dimensions))


def ball(radius: float, dimensions: int = 3) -> Offsets:
    r = math.floor(radius)
    return [o for o in box(r, dimensions) if sum(d * d for d in o) <= radius * radius]


def shifted(rows: DataFrame, keys: list[str], offsets: Offsets, others: list[str]) -> DataFrame:
    """Every row sent to each of its neighbours' places: keys of the receiver, `others` of the sender as n_*, and where the
    sender lies from the receiver as d*."""
    moves = F.explode(F.array(*[F.struct(*[F.lit(d).alias(k) for k, d in zip(keys, o, strict=True)]) for o in offsets])).alias("_o")
    names = [F.col(c).alias(f"n_{c}") for c in others]
    return rows.select(*keys, *names, moves).select(*[(F.col(k) + F.col(f"_o.{k}")).alias(k) for k in keys], *[f"n_{c}" for c in others], *[(-F.col(f"_o.{k}")).alias(f"d{k}") for k in keys])


def stencil(rows: DataFrame, keys: list[str], offsets: Offsets, others: list[str], own: list[str]) -> DataFrame:
    """Pairs of a voxel (`own` columns) and its present neighbours (`others` as n_*), one equi-join on the place."""
    return rows.select(*keys, *own).join(shifted(rows, keys, offsets, others), keys)


def dilated(mask: DataFrame, keys: list[str], offsets: Offsets, size: tuple[int, ...] | None = None) -> DataFrame:
    """Places that a mask's dilation by `offsets` (with the centre) covers, within the grid."""
    out = shifted(mask.select(*keys), keys, [*offsets, (0,) * len(keys)], []).select(*keys).distinct()
    if size:
        out = out.where(reduce(Column.__and__, [F.col(k).between(0, n - 1) for k, n in zip(keys, size, strict=True)]))
    return out


def eroded(mask: DataFrame, keys: list[str], offsets: Offsets) -> DataFrame:
    """Places whose neighbours all lie in the mask; outside the grid counts as outside the mask."""
    held = shifted(mask.select(*keys), keys, offsets, []).groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") == len(set(offsets)))
    return mask.select(*keys).join(held.select(*keys), keys, "left_semi")


def opened(mask: DataFrame, keys: list[str], offsets: Offsets, size: tuple[int, ...] | None = None) -> DataFrame:
    return dilated(eroded(mask, keys, offsets), keys, offsets, size)


def closed(mask: DataFrame, keys: list[str], offsets: Offsets, size: tuple[int, ...] | None = None) -> DataFrame:
    return eroded(dilated(mask, keys, offsets, size), keys, offsets)


def boundary(rows: DataFrame, keys: list[str], label: str, connectivity: int = 6) -> DataFrame:
    """Voxels with a neighbour of another label."""
    pairs = stencil(rows, keys, neighbours(connectivity, len(keys)), [label], [label])
    return pairs.where(F.col(label) != F.col(f"n_{label}")).select(*keys, label).distinct()


#: Side of the blocks that are filtered in one step.
BLOCK = 32
Cube = np.ndarray


def by_block_many(rows: DataFrame, keys: list[str], values: list[str], radius: int, outputs: dict[str, str], kernel: Callable[[Cube, Callable], dict[str, np.ndarray]], side: int = BLOCK) -> DataFrame:
    """keys and outputs of a kernel over blocks of voxels with a halo of `radius`; absent voxels are NaN, and rows with a
    null among the values are absent.

    A voxel travels to its block and to those whose halo holds it, so inner voxels travel once. kernel(cubes, shift) gets a
    block's values with its halo, one cube per value, and a function of a value's number and an offset that gives the
    block's neighbours there; it returns arrays over the block, of which those at present voxels that are not NaN in the
    first output become rows.
    """
    names = [f"_v{i}" for i in range(len(values))]
    near = rows.select(*[F.col(k).cast("int").alias(k) for k in keys], *[F.col(v).cast("double").alias(n) for v, n in zip(values, names, strict=True)]).na.drop(subset=names)
    for i, k in enumerate(keys):
        blocks = F.sequence(F.floor((F.col(k) - radius) / side).cast("int"), F.floor((F.col(k) + radius) / side).cast("int"))
        near = near.withColumn(f"_b{i}", F.explode(blocks))
    schema = ", ".join([*(f"{k} int" for k in keys), *(f"{name} {kind}" for name, kind in outputs.items())])
    kinds = {"double": pa.float64(), "long": pa.int64()}

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low = np.array([k.as_py() * side for k in key])
        at = np.stack([table[k].to_numpy() for k in keys], 1) - low
        cubes = np.full((len(names), *(side + 2 * radius,) * len(keys)), np.nan)
        for cube, name in zip(cubes, names, strict=True):
            cube[tuple((at + radius).T)] = table[name].to_numpy()
        own = at[((at >= 0) & (at < side)).all(axis=1)]

        def shift(value: int, offset: tuple[int, ...]) -> Cube:
            return cubes[value][tuple(slice(radius + o, radius + o + side) for o in offset)]

        with warnings.catch_warnings():
            warnings.simplefilter("ignore", RuntimeWarning)  # neighbourhoods without a voxel
            found = kernel(cubes, shift)
        done = {name: found[name][tuple(own.T)] for name in outputs}
        kept = ~np.isnan(next(iter(done.values())).astype(float))
        places = {k: pa.array((own[kept, i] + low[i]).astype(np.int32)) for i, k in enumerate(keys)}
        return pa.table(places | {name: pa.array(v[kept].astype(np.float64 if outputs[name] == "double" else np.int64), kinds[outputs[name]]) for name, v in done.items()})

    return near.groupBy(*[f"_b{i}" for i in range(len(keys))]).applyInArrow(run, schema)


def by_block(rows: DataFrame, keys: list[str], value: str, radius: int, outputs: dict[str, str], kernel: Callable[[Cube, Callable], dict[str, np.ndarray]]) -> DataFrame:
    """by_block_many of one value: kernel(cube, shift) with shift a function of an offset alone."""
    return by_block_many(rows, keys, [value], radius, outputs, lambda cubes, shift: kernel(cubes[0], lambda offset: shift(0, offset)))


def _reach(offsets: Offsets) -> int:
    return max(max(map(abs, o)) for o in offsets)


def neighbour_mean(rows: DataFrame, keys: list[str], value: str, offsets: Offsets) -> DataFrame:
    """Mean over the present neighbours, of each voxel that has one."""

    def kernel(cube: Cube, shift: Callable) -> dict[str, np.ndarray]:
        total, n = 0.0, 0
        for o in offsets:
            there = shift(o)
            known = ~np.isnan(there)
            total, n = total + np.where(known, there, 0.0), n + known
        return {"mean": np.where(n > 0, total / np.maximum(n, 1), np.nan), "n": n}

    return by_block(rows, keys, value, _reach(offsets), {"mean": "double", "n": "long"}, kernel)

def neighbour_rank(rows: DataFrame, keys: list[str], value: str, offsets: Offsets) -> DataFrame:
    """Least, median and greatest value of each voxel's neighbourhood, the voxel included."""

    def kernel(cube: Cube, shift: Callable) -> dict[str, np.ndarray]:
        every = np.stack([shift(o) for o in [*offsets, (0,) * len(keys)]])
        return {"least": np.nanmin(every, axis=0), "median": np.nanmedian(every, axis=0), "most": np.nanmax(every, axis=0)}

    return by_block(rows, keys, value, _reach(offsets), {"least": "double", "median": "double", "most": "double"}, kernel)

def _unit(i: int, n: int, sign: int) -> tuple[int, ...]:
    return tuple(sign if j == i else 0 for j in range(n))


def gradient(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Central differences per axis and the gradient's norm, of voxels with all axis neighbours."""
    n = len(keys)

    def kernel(cube: Cube, shift: Callable) -> dict[str, np.ndarray]:
        parts = {f"g{k}": (shift(_unit(i, n, 1)) - shift(_unit(i, n, -1))) / 2 for i, k in enumerate(keys)}
        norm = np.sqrt(sum(p * p for p in parts.values()))
        return {k: np.where(np.isnan(norm), np.nan, p) for k, p in parts.items()} | {"norm": norm}

    return by_block(rows, keys, value, 1, {**{f"g{k}": "double" for k in keys}, "norm": "double"}, kernel)

def laplacian(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum of differences to the axis neighbours, of voxels with all of them."""
    steps = neighbours(6, len(keys)) if len(keys) == 3 else [_unit(i, len(keys), s) for i in range(len(keys)) for s in (-1, 1)]

    def kernel(cube: Cube, shift: Callable) -> dict[str, np.ndarray]:
        return {"laplacian": sum(shift(o) for o in steps) - len(steps) * shift((0,) * len(keys))}

    return by_block(rows, keys, value, 1, {"laplacian": "double"}, kernel)

def boundary_gradient(rows: DataFrame, keys: list[str], label: str, value: str) -> DataFrame:
    """Mean difference, and mean absolute difference, to 26-neighbours of another label, per label."""
    pairs = stencil(rows, keys, neighbours(26), [label, value], [label, value]).where(F.col(label) != F.col(f"n_{label}"))
    d = F.col(value) - F.col(f"n_{value}")
    return pairs.groupBy(label).agg(F.avg(d).alias("gradient"), F.avg(F.abs(d)).alias("magnitude"))


def gaussian_kernel(sigma: float) -> list[float]:
    """Weights from -half to half, half = ceil(3 sigma - 0.5), of sum one."""
    half = math.ceil(3 * sigma - 0.5)
    raw = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(-half, half + 1)]
    return [w / sum(raw) for w in raw]


def convolved(rows: DataFrame, keys: list[str], axis: str, value: str, kernel: list[float], name: str) -> DataFrame:
    """One axis of a masked separable filter: sum of weights times values over the sum of weights of present voxels."""
    half = len(kernel) // 2
    taps = [F.struct(F.lit(d).alias("d"), F.lit(w).alias("w")) for d, w in zip(range(-half, half + 1), kernel, strict=True)]
    sent = rows.select(*keys, value, F.explode(F.array(*taps)).alias("t")).withColumn(axis, F.col(axis) + F.col("t.d"))
    sums = sent.groupBy(*keys).agg((F.sum(F.col(value) * F.col("t.w")) / F.sum("t.w")).alias(name))
    return rows.join(sums, keys)


def smoothed(rows: DataFrame, keys: list[str], value: str, sigma: float) -> DataFrame:
    """Separable masked Gaussian over all axes: along each, the weighted mean of the present voxels."""
    weights = gaussian_kernel(sigma)
    half = len(weights) // 2

    def kernel(cube: Cube, shift: Callable) -> dict[str, np.ndarray]:
        known = ~np.isnan(cube)
        now = np.where(known, cube, 0.0)
        for axis in range(cube.ndim):
            size = cube.shape[axis] - 2 * half
            part = lambda x, d, axis=axis, size=size: np.take(x, range(half + d, half + d + size), axis)
            total = sum(w * part(now, d) for d, w in zip(range(-half, half + 1), weights, strict=True))
            mass = sum(w * part(known, d) for d, w in zip(range(-half, half + 1), weights, strict=True))
            known = part(known, 0)
            now = np.where(known, total / np.maximum(mass, 1e-300), 0.0)
        return {"smooth": np.where(known, now, np.nan)}

    return by_block(rows, keys, value, half, {"smooth": "double"}, kernel)

def moving(rows: DataFrame, line: list[str], axis: str, value: str, radius: int) -> DataFrame:
    """Moving mean along one axis by a range window, which skips absent voxels."""
    frame = Window.partitionBy(*line).orderBy(axis).rangeBetween(-radius, radius)
    return rows.withColumn("moving", F.avg(value).over(frame))


def ridge(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Strongest second difference over the 13 directions of a 26-neighbourhood, of voxels with all neighbours."""
    ahead = [o for o in neighbours(26, len(keys)) if o > (0,) * len(keys)]

    def kernel(cube: Cube, shift: Callable) -> dict[str, np.ndarray]:
        here = shift((0,) * len(keys))
        every = np.stack([here - (shift(o) + shift(tuple(-d for d in o))) / 2 for o in ahead])
        return {"bright": every.max(axis=0), "dark": every.min(axis=0)}

    return by_block(rows, keys, value, 1, {"bright": "double", "dark": "double"}, kernel)

def tensor_products(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Outer product of the gradient per voxel."""
    g = gradient(rows, keys, value)
    pairs = itertools.combinations_with_replacement(keys, 2)
    return g.select(*keys, *[(F.col(f"g{a}") * F.col(f"g{b}")).alias(f"{a}{b}") for a, b in pairs])
