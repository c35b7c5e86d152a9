"""Profiles across depth: moments, slopes, region means, layer sampling and regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def profile_moments(rows: DataFrame, ids: list[str], profile: str = "profile") -> DataFrame:
    """Mean, deviation (n - 1), skewness by that deviation, and excess kurtosis of each array, with no shuffle."""
    p = F.col(profile)
    n = F.size(p).cast("double")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    rows = rows.select(*ids, p.alias("_p"), n.alias("n"), (total(p) / n).alias("mean"))
    power = lambda k: total(F.transform("_p", lambda v: F.pow(v - F.col("mean"), F.lit(k))))
    rows = rows.withColumns({"_m2": power(2), "_m3": power(3), "_m4": power(4)})
    std = F.sqrt(F.col("_m2") / (F.col("n") - 1))
    return rows.select(
        *ids,
        F.col("n").cast("long").alias("n"),
        "mean",
        F.when(F.col("n") > 1, std).otherwise(0.0).alias("std"),
        F.when(F.col("_m2") > 0, F.col("_m3") / F.col("n") / F.pow(std, F.lit(3))).alias("skewness"),
        F.when(F.col("_m2") > 0, F.col("_m4") / F.col("n") / F.pow(F.col("_m2") / F.col("n"), F.lit(2)) - 3).alias("kurtosis"),
    )


def profile_peak(rows: DataFrame, ids: list[str], profile: str = "profile") -> DataFrame:
    """Maximum, its depth from 0, minimum, and the largest rise between neighbouring depths of each array."""
    p = F.col(profile)
    rise = F.array_max(F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: F.element_at(p, i + 1) - F.element_at(p, i)))
    return rows.select(*ids, F.array_max(p).alias("most"), (F.array_position(p, F.array_max(p)) - 1).cast("int").alias("depth"), F.array_min(p).alias("least"), rise.alias("rise"))


def mean_profile(rows: DataFrame, label: str, profile: str = "profile") -> DataFrame:
    """Mean and population deviation per label and depth; partial sums are combined before the shuffle."""
    long = rows.select(label, F.posexplode(profile).alias("depth", "v"))
    return long.groupBy(label, "depth").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def thickness(rows: DataFrame, ids: list[str], inner: str, outer: str) -> DataFrame:
    return rows.select(*ids, F.abs(F.col(outer) - F.col(inner)).alias("thickness"))


def equivolume_ratio(fraction: Column, inner_area: Column, outer_area: Column) -> Column:
    """Distance ratio that splits the volume between two surfaces at `fraction`; plain where areas agree."""
    mixed = fraction * outer_area * outer_area + (1 - fraction) * inner_area * inner_area
    return F.when(F.abs(outer_area - inner_area) < 1e-8, fraction).otherwise((-inner_area + F.sqrt(mixed)) / (outer_area - inner_area))


def sampled_at(rows: DataFrame, ids: list[str], depth: Column, profile: str = "profile") -> DataFrame:
    """Linear interpolation of each array at a depth of 0..1."""
    p = F.col(profile)
    at = depth * (F.size(p) - 1)
    low = F.least(F.floor(at), F.size(p) - 2).cast("int")
    a, b = F.element_at(p, low + 1), F.element_at(p, low + 2)
    return rows.select(*ids, (a + (at - low) * (b - a)).alias("sampled"))


def linear_model(rows: DataFrame, keys: list[str], y: str, x: list[str]) -> DataFrame:
    """Least-squares coefficients with an intercept per group: sums of products in one aggregation, then a solve of
    a matrix of len(x) + 1 rows per group."""
    names = ["intercept", *x]
    terms = [F.lit(1.0), *map(F.col, x)]
    sums = [F.sum(a * b) for a in terms for b in terms] + [F.sum(a * F.col(y)) for a in terms]
    moments = rows.groupBy(*keys).agg(F.array(*sums).alias("_s"))
    k = len(names)

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series) -> pd.Series:
        table = np.stack(s.to_numpy()).astype(float)
        left, right = table[:, : k * k].reshape(-1, k, k), table[:, k * k :]
        return pd.Series(list(np.stack([np.linalg.lstsq(a, b, rcond=None)[0] for a, b in zip(left, right, strict=True)])))

    return moments.withColumn("_b", solve("_s")).select(*keys, *[F.col("_b")[i].alias(f"b_{n}") for i, n in enumerate(names)])


def lag_noise(rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Median of absolute differences of consecutive samples."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(time))
    return rows.withColumn("_d", F.abs(F.col(value) - before)).groupBy(*keys).agg(F.percentile("_d", 0.5).alias("noise"))


def standardized(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Z-scores within each group by the sample deviation."""
    stats = rows.groupBy(*keys).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    return rows.join(stats, keys).withColumn("z", F.when(F.col("_s") > 0, (F.col(value) - F.col("_m")) / F.col("_s")).otherwise(0.0)).drop("_m", "_s")


def detrended(rows: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Residuals of a line fitted to each series."""
    fit = rows.groupBy(*keys).agg(F.regr_slope(value, time).alias("_b"), F.regr_intercept(value, time).alias("_a"))
    return rows.join(fit, keys).withColumn("residual", F.col(value) - F.col("_a") - F.col("_b") * F.col(time)).drop("_a", "_b")


def autocorrelation(rows: DataFrame, keys: list[str], time: str, value: str, lag: int) -> DataFrame:
    before = F.lag(value, lag).over(Window.partitionBy(*keys).orderBy(time))
    return rows.withColumn("_p", before).groupBy(*keys).agg(F.corr(value, "_p").alias("autocorrelation"))
