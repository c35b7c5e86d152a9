"""Level sets and distances: Eikonal distance, iso-surface crossings, fusion, surface distances and geodesic smoothing."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixpoint, stencil


def zero_boundary(rows: DataFrame, keys: list[str], phi: str) -> DataFrame:
    """Voxels inside (phi < 0) with a 6-neighbour that is not."""
    pairs = stencil.stencil(rows, keys, stencil.neighbours(6, len(keys)), [phi], [phi])
    return pairs.where((F.col(phi) < 0) & (F.col(f"n_{phi}") >= 0)).select(*keys).distinct()


def iso_crossings(rows: DataFrame, keys: list[str], value: str, level: float) -> DataFrame:
    """Where the iso-surface cuts the grid's edges: the edge's lower end, its axis and the fraction along it."""
    ahead = [o for o in stencil.neighbours(6, len(keys)) if sum(o) == 1]
    pairs = stencil.stencil(rows, keys, [tuple(-d for d in o) for o in ahead], [value], [value])
    a, b = F.col(value) - level, F.col(f"n_{value}") - level
    axis = reduce(lambda c, k: F.when(F.col(f"d{k}") != 0, F.lit(k)).otherwise(c), keys, F.lit(None).cast("string"))
    return pairs.where(((a < 0) & (b >= 0)) | ((a >= 0) & (b < 0))).select(*keys, axis.alias("axis"), (a / (a - b)).alias("fraction"))


def fused(rows: DataFrame, keys: list[str], phi: str) -> DataFrame:
    """Mean level set over subjects."""
    return rows.groupBy(*keys).agg(F.avg(phi).alias("phi"), F.count("*").alias("subjects"))


def eikonal(grid: DataFrame, keys: list[str], source: Column, rounds: int | None = None) -> DataFrame:
    """Distance that solves the upwind Eikonal equation on present voxels, by repeated updates until none changes.

    Per axis the smaller neighbour counts; with the n smallest axes, distance = (s + sqrt(s^2 - n (q - 1))) / n for
    the sum s and the sum of squares q, taken for the largest n that keeps it above all values used.
    """
    infinity = F.lit(float("inf"))
    start = grid.select(*keys, F.when(source, 0.0).otherwise(infinity).alias("distance"))

    def step(state: DataFrame) -> DataFrame:
        sent = stencil.shifted(state.where(F.col("distance") < infinity), keys, stencil.neighbours(6, len(keys)), ["distance"])
        least = sent.groupBy(*keys).agg(*[F.min(F.when(F.col(f"d{k}") != 0, F.col("n_distance"))).alias(f"m{k}") for k in keys])
        near = F.array_sort(F.filter(F.array(*[F.col(f"m{k}") for k in keys]), lambda v: v.isNotNull()))
        best = infinity
        for n in range(1, len(keys) + 1):
            part = F.slice(near, 1, n)
            s = F.aggregate(part, F.lit(0.0), lambda a, v: a + v)
            q = F.aggregate(part, F.lit(0.0), lambda a, v: a + v * v)
            inside = s * s - n * (q - 1)
            root = (s + F.sqrt(F.greatest(inside, F.lit(0.0)))) / n
            best = F.when((F.size(near) >= n) & (inside >= 0) & (root >= F.array_max(part)), root).otherwise(best)
        new = least.select(*keys, best.alias("new"))
        return state.join(new, keys, "left").select(*keys, F.least("distance", F.coalesce("new", infinity)).alias("distance"))

    def measure(state: DataFrame) -> tuple:
        finite = F.when(F.col("distance") < infinity, F.round("distance", 6).cast("decimal(20,6)"))
        return tuple(state.agg(F.count(finite), F.sum(finite)).first())

    return fixpoint.fixpoint(start, step, measure, rounds)


def surface_distances(a: DataFrame, b: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and largest city-block distance between the boundaries of two masks, both ways; no pair of voxels is built."""
    parts = []
    for own, other in ((a, b), (b, a)):
        there = grid.join(other.select(*keys).withColumn("_in", F.lit(True)), keys, "left").select(*keys, F.coalesce("_in", F.lit(False)).alias("_in"))
        field = fixpoint.chamfer_distance(there, keys, F.col("_in"), {1: 1.0})
        parts.append(field.join(own.select(*keys), keys, "left_semi").select("distance"))
    both = parts[0].unionAll(parts[1])
    return both.agg(F.count("*").alias("voxels"), F.avg("distance").alias("average"), F.max("distance").alias("hausdorff"))


def geodesic_smoothed(grid: DataFrame, keys: list[str], value: str, sigma: float, reach: int) -> DataFrame:
    """Gaussian mean by path length through present voxels, up to `reach` steps: each round carries every start one
    step on, keeping the first arrival."""
    front = grid.select(*[F.col(k).alias(f"o_{k}") for k in keys], *keys, F.lit(0).alias("steps"))
    origin = [f"o_{k}" for k in keys]
    seen = front
    present = grid.select(*keys)
    for n in range(1, reach + 1):
        moved = stencil.shifted(front, keys, stencil.neighbours(6, len(keys)), origin).select(*[F.col(f"n_{o}").alias(o) for o in origin], *keys).distinct()
        front = fixpoint.cut(moved.join(present, keys).join(seen.select(*origin, *keys), [*origin, *keys], "left_anti").withColumn("steps", F.lit(n)).select(*origin, *keys, "steps"))
        seen = seen.unionByName(front)
    weight = F.exp(-F.col("steps") * F.col("steps") / (2 * sigma * sigma))
    sums = seen.join(grid.select(*keys, F.col(value).alias("_v")), keys).groupBy(*origin).agg((F.sum(weight * F.col("_v")) / F.sum(weight)).alias("smooth"), F.count("*").alias("n"))
    return sums.select(*[F.col(o).alias(k) for o, k in zip(origin, keys, strict=True)], "smooth", "n")


def random_walk(grid: DataFrame, keys: list[str], value: str, seed: str, labels: int, scale: float, rounds: int) -> DataFrame:
    """Label probabilities by Jacobi steps of a random walk on 6-neighbours; seeds (label from 1, else 0) stay fixed."""
    names = [f"p{i}" for i in range(1, labels + 1)]
    state = grid.select(*keys, value, seed, *[F.when(F.col(seed) == i, 1.0).when(F.col(seed) > 0, 0.0).otherwise(1.0 / labels).alias(n) for i, n in enumerate(names, 1)])
    weight = 1 / (1 + F.pow((F.col(value) - F.col(f"n_{value}")) / scale, F.lit(2)))
    for _ in range(rounds):
        pairs = stencil.stencil(state, keys, stencil.neighbours(6, len(keys)), [value, *names], [value])
        mean = pairs.groupBy(*keys).agg(*[(F.sum(weight * F.col(f"n_{n}")) / F.sum(weight)).alias(f"m_{n}") for n in names])
        state = state.join(mean, keys, "left").select(*keys, value, seed, *[F.when(F.col(seed) > 0, F.col(n)).otherwise(F.coalesce(f"m_{n}", n)).alias(n) for n in names])
        state = fixpoint.cut(state)
    return state.select(*keys, *names)


def total_variation(grid: DataFrame, keys: list[str], value: str, weight: float, rounds: int, step: float = 0.1, eps: float = 1e-3) -> DataFrame:
    """Gradient descent of the smoothed total-variation energy: sum |v - n| over 6-neighbours plus weight / 2 (v - f)^2."""
    state = grid.select(*keys, F.col(value).alias("_f"), F.col(value).alias("u"))
    for _ in range(rounds):
        d = F.col("n_u") - F.col("u")
        pull = stencil.stencil(state, keys, stencil.neighbours(6, len(keys)), ["u"], ["u"]).groupBy(*keys).agg(F.sum(d / F.sqrt(d * d + eps * eps)).alias("_g"))
        state = state.join(pull, keys, "left").select(*keys, "_f", (F.col("u") + step * (F.coalesce("_g", F.lit(0.0)) + weight * (F.col("_f") - F.col("u")))).alias("u"))
        state = fixpoint.cut(state)
    return state.select(*keys, F.col("u").alias("denoised"))


def simple_point(cube: np.ndarray) -> bool:
    """Whether flipping the centre of a 3x3x3 object keeps its topology: one 26-connected object part, and one
    6-connected background part within the 18-neighbourhood that touches the centre's faces."""

    def parts(cells: set, steps: list, seeds: set) -> int:
        left, n = set(cells), 0
        while left:
            stack, own = [left.pop()], set()
            while stack:
                p = stack.pop()
                own.add(p)
                for s in steps:
                    q = (p[0] + s[0], p[1] + s[1], p[2] + s[2])
                    if q in left:
                        left.remove(q)
                        stack.append(q)
            n += bool(own & seeds)
        return n

    around = [p for p in np.ndindex(3, 3, 3) if p != (1, 1, 1)]
    inside = {p for p in around if cube[p]}
    near = {p for p in around if not cube[p] and sum(abs(k - 1) for k in p) <= 2}
    faces = {p for p in around if sum(abs(k - 1) for k in p) == 1}
    return parts(inside, stencil.neighbours(26), inside) == 1 and parts(near, stencil.neighbours(6), near & faces) == 1


def thinned(mask: DataFrame, group: str, keys: list[str], order: str) -> DataFrame:
    """Skeleton of each volume: voxels go from the smallest `order` on while they are simple and no line ends.

    The order of removal decides, so each volume is one task: a volume must fit in it."""
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        place = pdf[keys].to_numpy()
        low = place.min(axis=0) - 1
        size = place.max(axis=0) - low + 2
        cube = np.zeros(size, bool)
        at = [tuple(p) for p in place - low]
        for p in at:
            cube[p] = True
        changed = True
        ranked = sorted(zip(pdf[order], at), key=lambda x: (x[0], x[1]))
        while changed:
            changed = False
            for _, p in ranked:
                if cube[p]:
                    block = cube[p[0] - 1 : p[0] + 2, p[1] - 1 : p[1] + 2, p[2] - 1 : p[2] + 2]
                    if block.sum() > 2 and simple_point(block):
                        cube[p] = False
                        changed = True
        return pdf[[cube[p] for p in at]]

    return mask.groupBy(group).applyInPandas(kernel, mask.schema)


def fractional_anisotropy(tensor: DataFrame, parts: list[str]) -> DataFrame:
    """Eigenvalues (descending), mean diffusivity and fractional anisotropy of xx, yy, zz, xy, xz, yz."""
    @F.pandas_udf("array<double>")
    def eigen(xx: pd.Series, yy: pd.Series, zz: pd.Series, xy: pd.Series, xz: pd.Series, yz: pd.Series) -> pd.Series:
        m = np.stack([np.stack(r, -1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -2).astype(float)
        return pd.Series(list(np.linalg.eigvalsh(m)[:, ::-1])) if len(m) else pd.Series([], dtype=object)

    e = tensor.withColumn("_e", eigen(*parts))
    a, b, c = (F.col("_e")[i] for i in range(3))
    mean = (a + b + c) / 3
    power = a * a + b * b + c * c
    spread = F.pow(a - mean, F.lit(2)) + F.pow(b - mean, F.lit(2)) + F.pow(c - mean, F.lit(2))
    return e.withColumns({"first": a, "mean_diffusivity": mean, "anisotropy": F.when(power > 0, F.sqrt(1.5 * spread / power)).otherwise(0.0)}).drop("_e")


def kittler_illingworth(counts: list[int]) -> int:
    """Bin that minimises the two-class minimum-error criterion of a histogram."""
    h = np.asarray(counts, float)
    n, at = len(h), np.arange(len(h))
    p = h / h.sum()
    best, where = math.inf, 0
    for t in range(2, n - 2):
        a, b = p[:t].sum(), p[t:].sum()
        if a <= 0 or b <= 0:
            continue
        ma, mb = (p[:t] @ at[:t]) / a, (p[t:] @ at[t:]) / b
        va, vb = (p[:t] @ (at[:t] - ma) ** 2) / a, (p[t:] @ (at[t:] - mb) ** 2) / b
        if va <= 0 or vb <= 0:
            continue
        j = 1 + 2 * (a * math.log(va) + b * math.log(vb)) - 2 * (a * math.log(a) + b * math.log(b))
        if j < best:
            best, where = j, t
    return where
