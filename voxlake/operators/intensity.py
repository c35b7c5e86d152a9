"""Intensity transforms: point operators, reducers over components, fits and matching."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def sigmoid(v: Column, center: float, slope: float) -> Column:
    return 1 / (1 + F.exp(-(v - center) / slope))


def range_normalized(rows: DataFrame, value: str, keys: list[str], invert: bool = False) -> DataFrame:
    """value scaled to 0..1 by its minimum and maximum per group (all rows without keys)."""
    bounds = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = rows.join(bounds, keys) if keys else rows.crossJoin(F.broadcast(bounds))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return joined.withColumn("normalized", 1 - scaled if invert else scaled).drop("_lo", "_hi")


def combined(a: Column, b: Column, how: str) -> Column:
    """min, max, signed max, sum, difference, product or ratio of two images."""
    ways = {
        "min": F.least(a, b),
        "max": F.greatest(a, b),
        "signed_max": F.when(F.abs(a) >= F.abs(b), a).otherwise(b),
        "sum": a + b,
        "difference": a - b,
        "product": a * b,
        "ratio": F.when(b != 0, a / b).otherwise(0.0),
    }
    return ways[how]


def weighted(parts: list[Column], weights: list[Column]) -> Column:
    """Weighted mean of images; 0 where all weights are 0."""
    total = reduce(Column.__add__, weights)
    return F.when(total != 0, reduce(Column.__add__, [p * w for p, w in zip(parts, weights, strict=True)]) / total).otherwise(0.0)


def reduced(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Average, sum, root mean square, minimum, maximum, range and deviation over the components of a 4-D image."""
    v = F.col(value)
    return rows.groupBy(*keys).agg(
        F.avg(v).alias("average"),
        F.sum(v).alias("total"),
        F.sqrt(F.avg(v * v)).alias("rms"),
        F.min(v).alias("least"),
        F.max(v).alias("most"),
        (F.max(v) - F.min(v)).alias("spread"),
        F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("deviation"),
    )


def exponential_fit(rows: DataFrame, keys: list[str], time: str, signal: str) -> DataFrame:
    """S0, decay rate and R^2 of a log-linear fit per voxel; voxels with a sample of 0 or less are left out."""
    fit = rows.groupBy(*keys).agg(
        F.min(signal).alias("_least"),
        F.regr_slope(F.log(F.when(F.col(signal) > 0, F.col(signal))), F.col(time)).alias("slope"),
        F.regr_intercept(F.log(F.when(F.col(signal) > 0, F.col(signal))), F.col(time)).alias("cut"),
        F.regr_r2(F.log(F.when(F.col(signal) > 0, F.col(signal))), F.col(time)).alias("r2"),
    )
    return fit.where("_least > 0").select(*keys, F.exp("cut").alias("s0"), (-F.col("slope")).alias("rate"), "r2")


def cumulative(rows: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """Histogram bins of a fixed range with their cumulative share."""
    at = F.least(F.greatest(F.floor((F.col(value) - low) / (high - low) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = rows.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    up = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)  # `bins` rows at most
    every = Window.partitionBy()
    return counts.select("bin", "n", (F.sum("n").over(up) / F.sum("n").over(every)).alias("cdf"))


def histogram_matching(source: DataFrame, target: DataFrame, value: str, bins: int, low: float, high: float) -> DataFrame:
    """For each bin of the source the first target bin whose cumulative share reaches the source bin's.

    Both tables have one row per bin, so the range join is bounded by bins squared, whatever the images' size."""
    s, t = cumulative(source, value, bins, low, high), cumulative(target, value, bins, low, high)
    t = t.select(F.col("bin").alias("to"), F.col("cdf").alias("reach"))
    return s.join(F.broadcast(t), F.round("reach", 12) >= F.round("cdf", 12)).groupBy("bin", "n").agg(F.min("to").alias("matched"))


def background_density(v: Column, mean: float, model: str) -> Column:
    """Density of the background at v: exponential or half-normal of a mean."""
    if model not in ("exponential", "half-normal"):
        raise ValueError(f"unknown model {model}")
    return F.exp(-v / mean) / mean if model == "exponential" else F.exp(-v * v / (math.pi * mean * mean)) * (2 / (mean * math.pi))


def background_posterior(v: Column, mean: float, model: str) -> Column:
    """Probability of the background at v against a uniform density of one."""
    density = background_density(v, mean, model)
    return density / (1 + density)


def background_mean(rows: DataFrame, v: Column, model: str, rounds: int, tolerance: float = 1e-4) -> tuple[float, int]:
    """Mean of the background on intensities v of 0..1 by EM, and the rounds used: each round is one aggregation to a
    row; it stops when two rounds' means differ by no more than `tolerance` of their middle."""
    mean, used = rows.agg(F.avg(v)).first()[0], 0
    for used in range(1, rounds + 1):
        p = background_posterior(v, mean, model)
        before, mean = mean, rows.agg(F.sum(v * p) / F.sum(p)).first()[0]
        if mean <= 0 or abs(mean - before) / (0.5 * (mean + before)) <= tolerance:
            break
    return mean, used


def background_em(rows: DataFrame, value: str, model: str = "exponential", rounds: int = 50, tolerance: float = 1e-4) -> DataFrame:
    """Background mean and foreground share by EM on intensities scaled to 0..1; no row where all are equal."""
    lo, hi, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if not n or hi == lo:
        return rows.sparkSession.createDataFrame([], "background_mean double, foreground double, rounds int")
    v = (F.col(value) - lo) / (hi - lo)
    mean, used = background_mean(rows, v, model, rounds, tolerance)
    foreground = F.avg((background_posterior(v, mean, model) <= 0.5).cast("double"))
    return rows.agg(foreground.alias("foreground")).select(F.lit(mean).alias("background_mean"), "foreground", F.lit(used).alias("rounds"))


def unified_mp2rage(first: Column, second: Column, phase_difference: Column) -> Column:
    """Combined MP2RAGE contrast of two inversions; 0 where both are 0."""
    power = first * first + second * second
    return F.when(power > 0, first * second * F.cos(phase_difference) / power).otherwise(0.0)


def looked_up(rows: DataFrame, value: str, table: DataFrame) -> DataFrame:
    """Linear interpolation of `value` in a bounded table(key, mapped), clamped to its ends."""
    lut = table.agg(F.array_sort(F.collect_list(F.struct("key", "mapped"))).alias("lut"))
    joined = rows.crossJoin(F.broadcast(lut))
    low = F.greatest(F.lit(1), F.size(F.filter("lut", lambda e: e["key"] <= F.col(value))))
    low = F.least(low, F.size("lut") - 1)
    a, b = F.element_at("lut", low), F.element_at("lut", low + 1)
    share = clamp((F.col(value) - a["key"]) / (b["key"] - a["key"]), 0.0, 1.0)
    return joined.withColumn("mapped", a["mapped"] + share * (b["mapped"] - a["mapped"])).drop("lut")


def bloch_table(
    inversion_times: tuple[float, float], inversion_repeat: float, excitation_repeats: tuple[float, float], angles: tuple[float, float],
    excitations: int, efficiency: float, t1_range: tuple[float, float] = (0.05, 4.05), t1_samples: int = 400, contrast_samples: int = 1000,
) -> np.ndarray:
    """T1 at `contrast_samples` equal steps of the unified contrast from -0.5 to 0.5.

    The steady state of a pair of gradient-echo trains after an inversion gives the contrast of each T1, which falls as
    T1 grows; the table inverts it linearly and is clamped to the range of T1. Times share one unit, angles are degrees.
    """
    (first, second), (repeat1, repeat2) = inversion_times, excitation_repeats
    half = excitations / 2
    rest = (first - half * repeat1, second - first - half * (repeat1 + repeat2), inversion_repeat - second - half * repeat2)
    cos1, cos2 = (math.cos(math.radians(a)) for a in angles)
    low, high = t1_range
    t1 = low + np.arange(t1_samples) * (high - low) / (t1_samples - 1)
    e1, e2, inverted = np.exp(-repeat1 / t1), np.exp(-repeat2 / t1), np.exp(-inversion_repeat / t1)
    ea, eb, ec = (np.exp(-r / t1) for r in rest)
    train = lambda m, e, c, n: m * (c * e) ** n + (1 - e) * (1 - (c * e) ** n) / (1 - c * e)  # noqa: E731  n echoes from m on
    steady = (train(train(1 - ea, e1, cos1, excitations) * eb + 1 - eb, e2, cos2, excitations) * ec + 1 - ec) / (1 + efficiency * (cos1 * cos2) ** excitations * inverted)
    echo1 = train(1 - ea - efficiency * steady * ea, e1, cos1, half)
    after = echo1 * (cos1 * e1) ** half + (1 - e1)  # the reference's second half train keeps its recovery whole
    echo2 = train(after * eb + 1 - eb, e2, cos2, half)
    gre1, gre2 = math.sin(math.radians(angles[0])) * echo1, math.sin(math.radians(angles[1])) * echo2
    contrast = gre1 * gre2 / (gre1**2 + gre2**2)
    wanted = -0.5 + np.arange(contrast_samples) / (contrast_samples - 1)
    below = np.array([np.argmax(contrast <= w) if (contrast <= w).any() else t1_samples for w in wanted])
    at = np.clip(below, 1, t1_samples - 1)
    share = np.clip((contrast[at - 1] - wanted) / (contrast[at - 1] - contrast[at]), 0, 1)
    found = low + (at - 1 + share) * (high - low) / (t1_samples - 1)
    return np.where(below == 0, low, np.where(below >= t1_samples, high, found))


def t1_map(rows: DataFrame, contrast: str, table: np.ndarray) -> DataFrame:
    """rows with t1 and r1 from the unified contrast, whatever its range, by a table of equal steps; the table alone is
    broadcast."""
    spark, n = rows.sparkSession, len(table)
    bounds = rows.agg(F.min(contrast).alias("_lo"), F.max(contrast).alias("_hi"))
    lut = spark.createDataFrame([([float(v) for v in table],)], "_t array<double>")
    joined = rows.crossJoin(F.broadcast(bounds)).crossJoin(F.broadcast(lut))  # two one-row tables
    unit = (F.col(contrast) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    at = unit * (n - 1)
    low = F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(n - 1)).cast("int")
    high = F.least(F.greatest(F.ceil(at), F.lit(0)), F.lit(n - 1)).cast("int")
    share = clamp(at - low, 0.0, 1.0)
    t1 = (1 - share) * F.element_at("_t", low + 1) + share * F.element_at("_t", high + 1)
    return joined.withColumn("t1", t1).withColumn("r1", F.when(F.col("t1") > 0, 1 / F.col("t1")).otherwise(0.0)).drop("_t", "_lo", "_hi")
