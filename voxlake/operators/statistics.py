"""Statistics of regions, overlaps and distributions over voxel tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stencil
from .fixpoint import cut


def legacy_percentile(values: Column, p: float) -> Column:
    """Percentile of a sorted array at position p (n + 1) / 100, clamped to its ends; null for an empty array."""
    n = F.size(values)
    at = F.lit(p / 100.0) * (n + 1)
    low = F.floor(at).cast("int")
    between = F.element_at(values, low) + (at - low) * (F.element_at(values, low + 1) - F.element_at(values, low))
    return F.when(n == 0, F.lit(None)).when(at < 1, F.element_at(values, 1)).when(at >= n, F.element_at(values, -1)).otherwise(between)


def ranked_percentiles(rows: DataFrame, keys: list[str], value: str, percents: list[float]) -> DataFrame:
    """Legacy percentiles per group from ranks: only the two rows around each position are kept.

    Rows are dealt by ranges of (group, value, hash), so a large group or a frequent value is ranked in many tasks; the
    ranges' counts place each task's ranks.
    """
    tie = F.xxhash64(F.monotonically_increasing_id())
    base = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"), tie.alias("_t"))
    dealt = cut(base.repartitionByRange(*keys, "_v", "_t").withColumn("_p", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_p").agg(F.count("*").alias("_c"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_c").over(group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = counts.select(*keys, "_p", before.alias("_from"), F.sum("_c").over(group).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_v"))
    sized = dealt.withColumn("_k", rank).join(places, [*keys, "_p"]).withColumn("_r", F.col("_k") + F.col("_from"))
    out = []
    for p in percents:
        at = F.lit(p / 100.0) * (F.col("_n") + 1)
        low = F.greatest(F.lit(1), F.least(F.floor(at), F.col("_n")))
        high = F.greatest(F.lit(1), F.least(F.floor(at) + 1, F.col("_n")))
        share = F.when((at < 1) | (at >= F.col("_n")), 0.0).otherwise(at - F.floor(at))
        term = F.when(F.col("_r") == low, F.col("_v") * (1 - share)).otherwise(0.0) + F.when(F.col("_r") == high, F.col("_v") * share).otherwise(0.0)
        out.append(F.sum(term).alias(f"p{p:g}"))
    return sized.groupBy(*keys).agg(*out)


def region_intensity(voxels: DataFrame, label: str = "seg", value: str = "v", voxel_volume: float = 1.0, ignore_zero: bool = True) -> DataFrame:
    """Voxels, volume, mean, population deviation, sum and SNR per label; zeros are missing but for the sum."""
    v = F.when((F.col(value) != 0) | F.lit(not ignore_zero), F.col(value))
    return voxels.groupBy(label).agg(
        F.count("*").alias("voxels"),
        (F.count("*") * F.lit(voxel_volume)).alias("volume"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
        F.coalesce(F.stddev_pop(v), F.lit(0.0)).alias("std"),
        F.sum(value).alias("total"),
        F.when(F.stddev_pop(v) > 0, F.avg(v) / F.stddev_pop(v)).otherwise(F.lit(float("nan"))).alias("snr"),
    )


def overlap(voxels: DataFrame, a: str = "seg", b: str = "tpl", background: int = 0) -> DataFrame:
    """Dice, Jaccard, volume difference, false positives and negatives per label of two maps on one grid.

    Each voxel counts for its two labels in one aggregation; no join is needed. 0 / 0 is NaN.
    """
    one = voxels.select(F.explode(F.array_distinct(F.array(a, b))).alias("label"), (F.col(a)).alias("a"), F.col(b).alias("b")).where(F.col("label") != background)
    na, nb = F.sum((F.col("a") == F.col("label")).cast("double")), F.sum((F.col("b") == F.col("label")).cast("double"))
    both = F.sum(((F.col("a") == F.col("label")) & (F.col("b") == F.col("label"))).cast("double"))
    counts = one.groupBy("label").agg(na.alias("na"), nb.alias("nb"), both.alias("both"))
    ratio = lambda p, q: F.when(q == 0, F.lit(float("nan"))).otherwise(p / q)
    na, nb, both = F.col("na"), F.col("nb"), F.col("both")
    return counts.select(
        "label",
        na.cast("long").alias("voxels_a"),
        nb.cast("long").alias("voxels_b"),
        ratio(2 * both, na + nb).alias("dice"),
        ratio(both, na + nb - both).alias("jaccard"),
        F.abs(ratio(na, nb) - 1).alias("volume_difference"),
        ratio(na - both, na).alias("false_positives"),
        ratio(nb - both, nb).alias("false_negatives"),
    )


def confusion(voxels: DataFrame, a: str = "seg", b: str = "tpl") -> DataFrame:
    return voxels.groupBy(a, b).agg(F.count("*").alias("voxels"))


def center_of_mass(voxels: DataFrame, label: str, keys: list[str]) -> DataFrame:
    return voxels.groupBy(label).agg(*[F.avg(k).alias(f"c{k}") for k in keys])


def center_distance(voxels: DataFrame, a: str, b: str, keys: list[str], resolution: tuple[float, ...]) -> DataFrame:
    """Distance in mm of the centroids of equal labels in two maps."""
    first = center_of_mass(voxels, a, keys).withColumnRenamed(a, "label")
    second = center_of_mass(voxels, b, keys).select(F.col(b).alias("label"), *[F.col(f"c{k}").alias(f"d{k}") for k in keys])
    square = reduce(Column.__add__, [F.pow((F.col(f"c{k}") - F.col(f"d{k}")) * r, F.lit(2)) for k, r in zip(keys, resolution, strict=True)])
    return first.join(second, "label").select("label", F.sqrt(square).alias("distance"))


def direction_tensor(rows: DataFrame, label: str, parts: list[str]) -> DataFrame:
    """Mean outer product of a 3-component image per label: xx, yy, zz, xy, xz, yz."""
    x, y, z = map(F.col, parts)
    pairs = {"xx": x * x, "yy": y * y, "zz": z * z, "xy": x * y, "xz": x * z, "yz": y * z}
    return rows.groupBy(label).agg(*[F.avg(e).alias(k) for k, e in pairs.items()])


def moments(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, skewness and excess kurtosis (population forms) per group."""
    return rows.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.skewness(value).alias("skewness"),
        F.kurtosis(value).alias("kurtosis"),
    )


def histogram(rows: DataFrame, value: str, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts of equal bins between the minimum and maximum of each group; the top edge is in the last bin.

    The values are computed once and written through `spark.checkpoint.dir`: computed twice, sums of doubles may differ in
    their last digits, and a value could lie outside the bounds.
    """
    rows = cut(rows.where(F.col(value).isNotNull()).select(*dict.fromkeys([*keys, value])))
    bounds = rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = rows.join(bounds, list(keys)) if keys else rows.crossJoin(F.broadcast(bounds))
    at = F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    bin_ = F.when(F.col("_hi") == F.col("_lo"), F.lit(0)).otherwise(F.least(at, F.lit(bins - 1))).cast("int")
    return joined.groupBy(*keys, bin_.alias("bin")).agg(F.count("*").alias("n"))


def mutual_information(rows: DataFrame, a: str, b: str, bins: int, keys: list[str]) -> DataFrame:
    """Mutual information (natural logarithm) of two images per group from joint histograms."""
    bounds = rows.agg(F.min(a).alias("al"), F.max(a).alias("ah"), F.min(b).alias("bl"), F.max(b).alias("bh"))
    at = lambda c, lo, hi: F.least(F.floor((F.col(c) - F.col(lo)) / (F.col(hi) - F.col(lo)) * bins), F.lit(bins - 1)).cast("int")
    joint = rows.crossJoin(F.broadcast(bounds)).groupBy(*keys, at(a, "al", "ah").alias("i"), at(b, "bl", "bh").alias("j")).agg(F.count("*").alias("n"))
    over = lambda *c: F.sum("n").over(Window.partitionBy(*keys, *c))
    p = joint.select(*keys, F.col("n"), over("i").alias("ni"), over("j").alias("nj"), over().alias("nn"))
    return p.groupBy(*keys).agg(F.sum(F.col("n") / F.col("nn") * F.log(F.col("n") * F.col("nn") / (F.col("ni") * F.col("nj")))).alias("mutual_information"))


def correlation(rows: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.corr(a, b).alias("correlation"), F.covar_pop(a, b).alias("covariance"))


def weighted_average(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    return rows.groupBy(*keys).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias("weighted_mean"))


def refined_value(rows: DataFrame, value: str, target: float, rounds: int, weight: Column | None = None, from_top: bool = False, bins: int = 10) -> float | None:
    """Middle of the bin where the sum of weights, counted from the least value (or the greatest), reaches `target`, after
    `rounds` histograms, each of the bin found before. A bin holds its upper end, the first one its lower end too. Each
    round is one aggregation to `bins` rows; None without a value."""
    base = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_v"), (F.lit(1.0) if weight is None else weight).alias("_w"))
    lo, hi = base.agg(F.min("_v"), F.max("_v")).first()
    found = lo
    for _ in range(rounds):
        if lo is None or hi <= lo:
            break
        at = F.greatest(F.ceil((F.col("_v") - lo) / (hi - lo) * bins) - 1, F.lit(0)).cast("int")
        sums = dict(base.where((F.col("_v") >= lo) & (F.col("_v") <= hi)).groupBy(at.alias("k")).agg(F.sum("_w")).collect())  # `bins` rows
        order = range(bins - 1, -1, -1) if from_top else range(bins)
        total = 0.0
        for k in order:
            total += sums.get(k, 0.0)
            if total >= target:
                break
        target -= total - sums.get(k, 0.0)
        width = hi - lo
        found, lo, hi = lo + (k + 0.5) / bins * width, lo + k / bins * width, lo + (k + 1) / bins * width
    return found


def robust_range(rows: DataFrame, value: str, ratio: float, rounds: int) -> DataFrame:
    """Robust minimum and maximum: where `ratio` of the values lie below and above, by refined histograms."""
    n = rows.where(F.col(value).isNotNull()).count()
    schema = "robust_min double, robust_max double"
    if not n:
        return rows.sparkSession.createDataFrame([], schema)
    ends = [refined_value(rows, value, ratio * n, rounds, from_top=top) for top in (False, True)]
    return rows.sparkSession.createDataFrame([tuple(ends)], schema)


def weighted_percentile(rows: DataFrame, value: str, weight: str, percent: float, rounds: int = 5) -> float | None:
    """Percentile by weight, to within 10^-rounds of the range of values."""
    total = rows.where(F.col(value).isNotNull()).agg(F.sum(weight)).first()[0]
    return None if total is None else refined_value(rows, value, percent / 100 * total, rounds, F.col(weight))


def robust_noise(rows: DataFrame, keys: list[str], value: str, half: float = 19.15) -> DataFrame:
    """Pairs of 26-neighbours and the range of their differences within `half` percent on both sides of the median, which
    is the deviation of normal noise. All pairs count, so the result doesn't depend on a sample."""
    pairs = stencil.stencil(rows, keys, stencil.neighbours(26, len(keys)), [value], [value]).select((F.col(value) - F.col(f"n_{value}")).alias("d"), F.lit(0).alias("_g"))
    found = ranked_percentiles(pairs, ["_g"], "d", [50 - half, 50 + half])
    return pairs.groupBy("_g").agg(F.count("*").alias("pairs")).join(found, "_g").select("pairs", (F.col(f"`p{50 + half:g}`") - F.col(f"`p{50 - half:g}`")).alias("noise"))
