"""Probabilities of filter responses and masks: background masks, contrasts, plane scores, noise maps and correlation
tensors, and quantities along level sets."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import fixpoint, intensity, statistics, stencil


def foreground(rows: DataFrame, keys: list[str], value: str, model: str = "half-normal", rounds: int = 20, skip_zero: bool = False) -> DataFrame:
    """keys, proba (of not being background) and mask (0 or 1: background at most even): a model of the background fitted
    by EM to the values scaled to 0..1; with skip_zero, zeros of the scaled image don't count in the fit. No row where
    all values are equal."""
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    if lo is None or lo == hi:
        return rows.limit(0).select(*keys, F.lit(0.0).alias("proba"), F.lit(0).alias("mask"))
    v = (F.col(value) - lo) / (hi - lo)
    mean, _ = intensity.background_mean(rows.where(v != 0) if skip_zero else rows, v, model, rounds)
    p = intensity.background_posterior(v, mean, model)
    return rows.where(F.col(value).isNotNull()).select(*keys, (1 - p).alias("proba"), F.when(p <= 0.5, 1).otherwise(0).alias("mask"))


def masked(rows: DataFrame, found: DataFrame, keys: list[str], value: str, how: str) -> DataFrame:
    """value times the probability ("proba"), the mask ("binary") or the mask dilated by two voxels a side ("dilated")."""
    if how not in ("proba", "binary", "dilated"):
        raise ValueError(f"unknown masking {how}")
    if how == "dilated":
        spread = stencil.dilated(found.where("mask = 1"), keys, stencil.box(2, len(keys))).withColumn("_m", F.lit(1.0))
        joined = rows.select(*keys, value).join(spread, keys, "left").na.fill(0.0, ["_m"])
    else:
        joined = rows.select(*keys, value).join(found.select(*keys, F.col("proba" if how == "proba" else "mask").alias("_m")), keys)
    return joined.select(*keys, (F.col(value) * F.col("_m")).alias("masked"))


#: Square of the median of a standard half-normal variate: fixed value.
MEDIAN_SQUARE = 0.45493642


def normalized_response(rows: DataFrame, keys: list[str], value: str, model: str = "exponential", measure: str = "mean", iterated: bool = False, rounds: int = 20) -> DataFrame:
    """Probability of a positive response against noise, exponential or Gaussian, whose scale comes from the mean or the
    median; responses of 0 or less have 0. Iterated, means weigh by the probability and medians count what is below a half,
    until the scale changes by less than a hundredth. Each round is an aggregation to one row."""
    if model not in ("exponential", "gaussian") or measure not in ("mean", "median"):
        raise ValueError(f"unknown model {model} or measure {measure}")
    v, some = F.col(value), rows.where(F.col(value) > 0)
    most = some.agg(F.max(v)).first()[0]
    if most is None:
        return rows.select(*keys, F.lit(0.0).alias("response"))

    def scale(weight: Column | None) -> float:
        if measure == "mean":
            w = F.lit(1.0) if weight is None else weight
            total, square = some.agg(F.sum(w * v) / F.sum(w), F.sum(w * v * v) / F.sum(w)).first()
            return total if model == "exponential" else math.sqrt(square)
        low = some if weight is None else some.where(weight < 0.5)
        median = statistics.ranked_percentiles(low.withColumn("_g", F.lit(0)), ["_g"], value, [50.0]).first()
        if median is None:
            return math.nan
        return median["p50"] / math.log(2) if model == "exponential" else median["p50"] / math.sqrt(MEDIAN_SQUARE)

    def response(s: float) -> Column:
        noise = F.exp(-v / s) / s if model == "exponential" else F.exp(-v * v / (2 * s * s)) * (math.sqrt(2 / math.pi) / s)
        return 1 / (1 + most * noise)

    now = scale(None)
    for _ in range(rounds if iterated else 0):
        new = scale(response(now))
        if math.isnan(new):
            break
        now, change = new, 2 * abs(new - now) / (new + now)
        if change < 0.01:
            break
    return rows.select(*keys, F.when(v > 0, response(now)).otherwise(0.0).alias("response"))


#: Percent on each side of the median that hold a normal variate's standard deviation.
ONE_DEVIATION = 50 * math.erf(1 / math.sqrt(2))


def contrast_probability(rows: DataFrame, keys: list[str], value: str, region: str, background: str) -> DataFrame:
    """Probability of a region against a background by normal densities, whose medians and deviations are percentiles
    weighted by the shares `region` and `background` (0: not part of it) of each voxel."""

    def fitted(weight: str) -> tuple[float, float]:
        part = rows.where(F.col(weight) > 0)
        low, mid, high = (statistics.weighted_percentile(part, value, weight, 50 + d) for d in (-ONE_DEVIATION, 0.0, ONE_DEVIATION))
        if mid is None or high <= low:
            raise ValueError(f"no spread of {value} in {weight}")
        return mid, 0.5 * (high - low)

    def density(fit: tuple[float, float]) -> Column:
        z = (F.col(value) - fit[0]) / fit[1]
        return F.exp(-0.5 * z * z) / fit[1]

    own, other = density(fitted(region)), density(fitted(background))
    both = own + other
    return rows.select(*keys, F.when(both > 0, own / both).otherwise(0.5).alias("region"), F.when(both > 0, other / both).otherwise(0.5).alias("background"))


def flair_outliers(rows: DataFrame, keys: list[str], value: str, inlier_ratio: float, outlier_ratio: float) -> DataFrame:
    """proba and filtered: squared normal fall-off below the robust maximum that leaves `outlier_ratio` of all voxels above,
    with the distance to that of `inlier_ratio` for its scale; likely outliers are lifted to the sum of both. Only positive
    values count in the maxima."""
    n, some = rows.count(), rows.where(F.col(value) > 0)
    inner, outer = (statistics.refined_value(some, value, r * n, 4, from_top=True) for r in (inlier_ratio, outlier_ratio))
    if inner is None or inner == outer:
        return rows.select(*keys, F.lit(0.0).alias("proba"), F.col(value).alias("filtered"))
    z = F.greatest(outer - F.col(value), F.lit(0.0)) / (outer - inner)
    proba = F.exp(-z * z)
    lift = F.greatest(2 * proba - 1, F.lit(0.0))
    return rows.select(*keys, proba.alias("proba"), (lift * (2 * outer - inner) + (1 - lift) * F.col(value)).alias("filtered"))


def plane_offsets(direction: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Places of the plane across a direction to one of 26 neighbours: the nine at right angles to it, and for a diagonal
    of space the centre and the six other corners."""
    if all(direction):
        opposite = tuple(-d for d in direction)
        return [(0, 0, 0), *[o for o in itertools.product((-1, 1), repeat=3) if o not in (direction, opposite)]]
    return [o for o in stencil.box(1) if sum(a * b for a, b in zip(o, direction, strict=True)) == 0]


def plane_scores(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Strongest mean second difference across the planes of the 13 directions, halved, at voxels with all neighbours two
    steps around that aren't all equal to it within a radius of sqrt 8."""
    ahead = [o for o in stencil.neighbours(26) if o > (0, 0, 0)]
    near = [o for o in stencil.box(2) if sum(d * d for d in o) <= 8]

    def kernel(cube: stencil.Cube, shift: Callable) -> dict[str, np.ndarray]:
        best = np.zeros(shift((0, 0, 0)).shape)
        for d in ahead:
            plane = plane_offsets(d)
            sides = [tuple(a + s * b for a, b in zip(o, d, strict=True)) for o in plane for s in (-1, 1)]
            score = 0.5 * (2 * sum(shift(o) for o in plane) - sum(shift(o) for o in sides)) / (2 * len(plane))
            best = np.where(np.abs(score) > np.abs(best), score, best)
        whole = ~np.isnan(sum(shift(o) for o in stencil.box(2)))
        flat = np.all([shift(o) == shift((0, 0, 0)) for o in near], axis=0)
        return {"score": np.where(whole & ~flat, best, np.nan)}

    return stencil.by_block(rows, keys, value, 2, {"score": "double"}, kernel)


def partial_volume(rows: DataFrame, keys: list[str], value: str, kind: str = "both", probability: bool = False) -> DataFrame:
    """Plane scores of bright, dark or both kinds of sheets, others 0; as a probability, one less a normal fall-off around
    the mean score with the scores' variance."""
    if kind not in ("bright", "dark", "both"):
        raise ValueError(f"unknown kind {kind}")
    scores, s = fixpoint.cut(plane_scores(rows, keys, value)), F.col("score")
    kept = {"bright": F.greatest(s, F.lit(0.0)), "dark": F.greatest(-s, F.lit(0.0)), "both": s}[kind]
    if not probability:
        return scores.select(*keys, kept.alias("sheet"))
    stats = scores.agg(F.avg(s).alias("_m"), F.var_samp(s).alias("_s"))
    return scores.crossJoin(F.broadcast(stats)).select(*keys, (1 - F.exp(-0.5 * (kept - F.col("_m")) * (kept - F.col("_m")) / F.col("_s"))).alias("sheet"))  # one row


def median_noise(rows: DataFrame, keys: list[str], value: str, radius: int = 1, ratio: float = 0.5, model: str = "half-normal") -> DataFrame:
    """noise and boundary per voxel: half the percentile of absolute differences within a box, the voxel itself included,
    over that percentile of a unit half-normal or exponential variate ("raw": as it is). boundary is 1 where a neighbour is
    absent."""
    from statistics import NormalDist

    unit = {"raw": 1.0, "half-normal": NormalDist().inv_cdf((1 + ratio) / 2), "exponential": -math.log(1 - ratio)}[model]
    box = stencil.box(radius, len(keys))

    def kernel(cube: stencil.Cube, shift: Callable) -> dict[str, np.ndarray]:
        here = shift((0,) * len(keys))
        every = np.sort(np.stack([np.abs(here - shift(o)) for o in box]), axis=0)  # absent ones last
        n = (~np.isnan(every)).sum(axis=0)
        at = ratio * (n + 1)
        low = np.clip(np.floor(at).astype(int), 1, np.maximum(n, 1))
        high = np.clip(low + 1, 1, np.maximum(n, 1))
        a, b = (np.take_along_axis(every, (i - 1)[None], 0)[0] for i in (low, high))
        share = np.where((at < 1) | (at >= n), 0.0, at - np.floor(at))
        return {"noise": 0.5 * (a + share * (b - a)) / unit, "boundary": (n < len(box)).astype(float)}

    return stencil.by_block(rows, keys, value, radius, {"noise": "double", "boundary": "long"}, kernel)


def noise_by_intensity(rows: DataFrame, noise: DataFrame, keys: list[str], value: str, bins: int = 1000) -> DataFrame:
    """Noise of each voxel's intensity: medians of the noise in `bins` bins of intensity, linear between the two bins
    around it, or of the one that has voxels; the median of all for boundary voxels and where neither has. Boundary voxels
    have no part in the medians."""
    joined = fixpoint.cut(rows.select(*keys, F.col(value).alias("_i")).join(noise, keys))
    inner = joined.where("boundary = 0")
    lo, hi = inner.agg(F.min("_i"), F.max("_i")).first()
    width = (hi - lo) or 1.0 if lo is not None else 1.0
    place = (F.col("_i") - F.lit(lo)) / width * (bins - 1)
    medians = statistics.ranked_percentiles(inner.withColumn("_bin", F.floor(place + 0.5).cast("int")), ["_bin"], "noise", [50.0])
    table = medians.select("_bin", F.col("p50").alias("_m"))  # `bins` rows at most
    whole = statistics.ranked_percentiles(inner.withColumn("_g", F.lit(0)), ["_g"], "noise", [50.0]).select(F.col("p50").alias("_all"))
    low, high = F.greatest(F.floor(place), F.lit(0)).cast("int"), F.least(F.ceil(place), F.lit(bins - 1)).cast("int")
    at = joined.withColumns({"_at": place, "_l": low, "_h": high})
    for name in ("_l", "_h"):
        at = at.join(F.broadcast(table.select(F.col("_bin").alias(name), F.col("_m").alias(f"{name}m"))), name, "left")
    share = F.col("_at") - F.col("_l")
    between = F.when((F.col("_h") > F.col("_l")) & F.col("_lm").isNotNull() & F.col("_hm").isNotNull(), (1 - share) * F.col("_lm") + share * F.col("_hm"))
    chosen = F.when(F.col("boundary") == 0, F.coalesce(between, "_lm", "_hm"))
    one = F.broadcast(whole)  # one row
    return at.join(one, F.lit(True), "left").select(*keys, F.coalesce(chosen, "_all").alias("noise"))


def correlation_tensors(voxels: DataFrame, keys: list[str], series: str, how: str = "raw", side: int = 8) -> DataFrame:
    """Mean over the 26 neighbours of the squared correlation with them times the outer product of the direction, at voxels
    with all of them; correlations (of n over n - 1 less than one) may be taken absolute, positive, negative or shifted to
    0..1. Series that don't vary are absent; all others have one length. Blocks of `side` voxels a side travel with a halo."""
    ways = {"raw": lambda c: c, "absolute": np.abs, "positive": lambda c: np.maximum(c, 0), "negative": lambda c: -np.minimum(c, 0), "shifted": lambda c: 0.5 * (1 + c)}
    how_of = ways[how]
    names = [f"{a}{b}" for a, b in itertools.combinations_with_replacement(keys, 2)]
    pairs = list(itertools.combinations_with_replacement(range(3), 2))
    near = voxels.select(*[F.col(k).cast("int").alias(k) for k in keys], F.col(series).cast("array<double>").alias("_s")).where(F.col("_s").isNotNull())
    for i, k in enumerate(keys):
        near = near.withColumn(f"_b{i}", F.explode(F.sequence(F.floor((F.col(k) - 1) / side).cast("int"), F.floor((F.col(k) + 1) / side).cast("int"))))
    schema = ", ".join([*(f"{k} int" for k in keys), *(f"{n} double" for n in names)])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low = np.array([k.as_py() * side for k in key])
        at = np.stack([table[k].to_numpy() for k in keys], 1) - low
        rows = np.array(table["_s"].combine_chunks().flatten(), dtype=float).reshape(len(at), -1)
        rows = rows - rows.mean(axis=1, keepdims=True)
        length = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        rows = np.where(length > 0, rows / np.where(length > 0, length, 1), np.nan)
        cube = np.full((*(side + 2,) * 3, rows.shape[1]), np.nan)
        cube[tuple((at + 1).T)] = rows
        own = at[((at >= 0) & (at < side)).all(axis=1)]
        here, scale = cube[tuple((own + 1).T)], (rows.shape[1] - 1) / rows.shape[1]
        total = np.zeros((len(own), len(pairs)))
        for o in stencil.neighbours(26):
            weight = how_of((here * cube[tuple((own + 1 + np.array(o)).T)]).sum(axis=1) * scale) ** 2
            square = sum(d * d for d in o)
            total += weight[:, None] * np.array([o[a] * o[b] / square for a, b in pairs]) / 26
        kept = ~np.isnan(total).any(axis=1)
        places = {k: pa.array((own[kept, i] + low[i]).astype(np.int32)) for i, k in enumerate(keys)}
        return pa.table(places | {n: pa.array(total[kept, i]) for i, n in enumerate(names)})

    return near.groupBy("_b0", "_b1", "_b2").applyInArrow(run, schema)


def level_curvatures(cubes_shift: Callable, dims: int = 3) -> dict[str, np.ndarray]:
    """Mean and Gaussian curvature, shape index, curvedness and unit normal of a level set from a function of offsets."""
    unit = lambda *steps: tuple(sum(s for a, s in steps if a == i) for i in range(dims))
    f, here = cubes_shift, cubes_shift((0,) * dims)
    g = [(f(unit((i, 1))) - f(unit((i, -1)))) / 2 for i in range(dims)]
    h = [[None] * dims for _ in range(dims)]
    for i, j in itertools.combinations_with_replacement(range(dims), 2):
        h[i][j] = h[j][i] = f(unit((i, 1))) + f(unit((i, -1))) - 2 * here if i == j else (f(unit((i, 1), (j, 1))) + f(unit((i, -1), (j, -1))) - f(unit((i, 1), (j, -1))) - f(unit((i, -1), (j, 1)))) / 4
    square = sum(d * d for d in g)
    norm = np.sqrt(square)
    # g^T H g and g^T adj(H) g
    bend = sum(g[i] * g[j] * h[i][j] for i in range(3) for j in range(3))
    trace = h[0][0] + h[1][1] + h[2][2]
    cofactor = lambda i, j: h[(i + 1) % 3][(j + 1) % 3] * h[(i + 2) % 3][(j + 2) % 3] - h[(i + 1) % 3][(j + 2) % 3] * h[(i + 2) % 3][(j + 1) % 3]
    known = np.where(norm > 0, norm, np.nan)
    mean = np.nan_to_num((trace * square - bend) / (2 * known**3))
    gauss = np.nan_to_num(sum(g[i] * g[j] * cofactor(i, j) for i in range(3) for j in range(3)) / known**4)
    flat = norm == 0
    spread = np.sqrt(np.abs(mean * mean - gauss))
    out = {"mean": mean, "gauss": gauss, "shape": np.where(flat, 0.0, 2 / math.pi * np.arctan2(mean, spread)), "curved": np.where(flat, 0.0, np.sqrt(np.abs(2 * mean * mean - gauss)))}
    out |= {f"n{i}": np.nan_to_num(g[i] / known) for i in range(3)}
    absent = np.isnan(sum(f(o) for o in stencil.box(1, dims)))
    return {k: np.where(absent, np.nan, v) for k, v in out.items()}


def profile_geometry(rows: DataFrame, keys: list[str], layers: list[str], extra: float = 0.0) -> DataFrame:
    """Per voxel between the first and last layer, within `extra`, that has all 26 neighbours: thickness, and curvatures and
    unit normal (n0, n1, n2) of the layer nearest to it, the first of equals."""

    def kernel(cubes: np.ndarray, shift: Callable) -> dict[str, np.ndarray]:
        centre = np.stack([shift(i, (0, 0, 0)) for i in range(len(layers))])
        inside = (centre[0] >= -extra) & (centre[-1] <= extra)
        nearest = np.argmin(np.abs(centre), axis=0)
        found: dict[str, np.ndarray] = {}
        for i in range(len(layers)):
            for name, v in level_curvatures(lambda o, i=i: shift(i, o)).items():
                found[name] = np.where(nearest == i, v, found.get(name, np.nan))
        return {"thickness": np.where(inside & ~np.isnan(found["mean"]), centre[0] - centre[-1], np.nan)} | found

    outputs = {n: "double" for n in ("thickness", "mean", "gauss", "shape", "curved", "n0", "n1", "n2")}
    return stencil.by_block_many(rows, keys, layers, 1, outputs, kernel)


def integrated(rows: DataFrame, keys: list[str], level: str, value: str, start: float, stop: float, size: tuple[int, ...], how: str = "mean") -> DataFrame:
    """Values summed up from one level to another: in each of ceil(|start - stop|) rounds voxels reached so far hand their
    result to 26-neighbours that aren't, weighted by the rise of the level towards them. "mean": a voxel's own value plus
    the weighted mean of what it gets, 0 to begin with; "max" and "min": the more extreme of its own, where it lies between
    the levels, and that of the steepest sender, the greatest (least) of equals. Voxels on the grid's faces only receive."""
    if how not in ("mean", "max", "min"):
        raise ValueError(f"unknown measure {how}")
    sign = -1.0 if start > stop else 1.0
    phi = sign * F.col(level)
    between = (phi >= sign * start) & (phi <= sign * stop)
    own = F.lit(0.0) if how == "mean" else F.when(between, F.col(value)).otherwise(0.0)
    state = rows.select(*keys, phi.alias("_p"), F.col(value).alias("_v"), own.alias("result"), (phi < sign * start).alias("_in"))
    inner = None
    for k, n in zip(keys, size, strict=True):
        inner = F.col(k).between(1, n - 2) if inner is None else inner & F.col(k).between(1, n - 2)
    for _ in range(math.ceil(abs(start - stop))):
        sent = stencil.shifted(state.where("_in").where(inner), keys, stencil.neighbours(26, len(keys)), ["_p", "result"])
        rise = F.greatest(F.col("_p") - F.col("n__p"), F.lit(0.0))
        met = state.where(~F.col("_in")).select(*keys, "_p").join(sent, keys).withColumn("_w", rise).where("_w > 0")
        if how == "mean":
            got = met.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("n_result")) / F.sum("_w")).alias("_got"))
            new = F.col("_v") + F.col("_got")
        else:
            by = F.struct(F.col("_w"), F.col("n_result") if how == "max" else -F.col("n_result"))
            got = met.groupBy(*keys).agg(F.max_by("n_result", by).alias("_got"))
            new = F.greatest("result", "_got") if how == "max" else F.least("result", "_got")
        state = state.join(got, keys, "left").select(*keys, "_p", "_v", F.when(F.col("_got").isNotNull(), new).otherwise(F.col("result")).alias("result"), (F.col("_in") | F.col("_got").isNotNull()).alias("_in"))
        state = fixpoint.cut(state)
    return state.select(*keys, "result")


def jensen_shannon_table(reach: float, resolution: float, sampling: float) -> np.ndarray:
    """Divergence of a unit normal from one at `row` steps of the resolution off, of a deviation of `column` steps: a sum
    over equal steps of three deviations around both. The first column, of no deviation, is 0."""
    shift = np.arange(math.ceil(reach / resolution))[:, None, None] * resolution
    width = np.arange(1, math.ceil(1 / resolution))[None, :, None] * resolution
    low, high = np.minimum(-3.0, shift - 3 * width), np.maximum(3.0, shift + 3 * width)
    x = low + np.arange(math.floor(1 / sampling + 1e-9) + 1) * sampling * (high - low)
    p = np.exp(-0.5 * x * x) / math.sqrt(2 * math.pi)
    q = np.exp(-0.5 * ((x - shift) / width) ** 2) / (width * math.sqrt(2 * math.pi))
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(p > 0, p * np.log(2 * p / (p + q)), 0.0) + np.where(q > 0, q * np.log(2 * q / (p + q)), 0.0)
    table = terms.sum(axis=2) * (sampling * (high - low))[:, :, 0] / 2
    return np.concatenate([np.zeros((len(table), 1)), table], axis=1)


def jensen_shannon(rows: DataFrame, first: tuple[str, str], second: tuple[str, str], reach: float = 3.0, resolution: float = 0.05, sampling: float = 0.01) -> DataFrame:
    """rows with `divergence` of two normals (mean, deviation) from a table of bounded size: the wider one's deviation is
    the unit. Beyond the table, equal deviations included, its last entry holds; null where the wider deviation is 0."""
    table = jensen_shannon_table(reach, resolution, sampling)
    n, k = table.shape
    lut = rows.sparkSession.createDataFrame([([float(v) for v in table.ravel()],)], "_t array<double>")
    (m1, s1), (m2, s2) = [[F.col(c) for c in p] for p in (first, second)]
    wide, narrow = F.greatest(s1, s2), F.least(s1, s2)
    steps = lambda v: F.floor(v / wide / resolution + 0.5)
    i, j = steps(F.abs(m1 - m2)), steps(narrow)
    at = F.when((i < n) & (j < k), i * k + j).otherwise(n * k - 1).cast("int")
    return rows.crossJoin(F.broadcast(lut)).withColumn("divergence", F.when(wide > 0, F.element_at("_t", at + 1))).drop("_t")  # one row


def space_converted(vertices: DataFrame, at: tuple[str, str, str], size: tuple[int, int, int], resolution: tuple[float, float, float]) -> DataFrame:
    """Vertices with y and z mirrored in the volume: scaled by (1, -1, -1) and moved by the extent less a voxel."""
    flipped = {a: (n - 1) * r - F.col(a) for a, n, r in zip(at[1:], size[1:], resolution[1:], strict=True)}
    return vertices.withColumns(flipped)
