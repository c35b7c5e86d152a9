"""Intensity priors of regions: guarded erosion, medians and spreads per subject, and over a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fixpoint, stencil


def eroded_labels(rows: DataFrame, subject: str, keys: list[str], label: str, rounds: int = 1, background: int | None = 1, least: int = 5, null_label: int = 0) -> DataFrame:
    """Label maps of all subjects with each label eroded by its six neighbours `rounds` times (dilated for negative
    rounds, then a voxel takes the greatest label that reaches it). A step that would leave fewer than `least` voxels of
    a subject's label isn't taken. The background keeps its voxels; those that lose their label get `null_label`."""
    kept = rows.where(F.col(label) == background) if background is not None else rows.limit(0)
    now = rows.where(F.col(label) != background) if background is not None else rows
    now = now.select(subject, *keys, label)
    own = [subject, *keys, label]
    steps = [(0, *o, 0) for o in [(0,) * len(keys), *stencil.neighbours(6, len(keys))]]
    for _ in range(abs(rounds)):
        reach = stencil.shifted(now, own, steps, []).groupBy(*own).agg(F.count("*").alias("_n"))
        new = reach.where(F.col("_n") == len(steps)) if rounds > 0 else reach
        new = new.select(*own).join(rows.select(subject, *keys), [subject, *keys], "left_semi")
        enough = new.groupBy(subject, label).count().where(F.col("count") >= least).select(subject, label)
        now = fixpoint.cut(new.join(enough, [subject, label], "left_semi").unionByName(now.join(enough, [subject, label], "left_anti")))
    last = now.unionByName(kept.select(*own)).groupBy(subject, *keys).agg(F.max(label).alias("_label"))
    return rows.select(subject, *keys).join(last, [subject, *keys], "left").select(subject, *keys, F.coalesce("_label", F.lit(null_label)).alias(label))


def region_metrics(rows: DataFrame, subject: str, label: str, value: str, background: int | None = 1, normalize: bool = True, null_label: int | None = 0) -> DataFrame:
    """Median and upper and lower quartile of each label per subject, of values scaled to 0..1 over the subject's voxels
    outside the background; the background itself is left as it is."""
    v = F.col(value)
    if normalize:
        outside = F.when(F.col(label) != background, v) if background is not None else v
        bounds = rows.groupBy(subject).agg(F.min(outside).alias("_lo"), F.max(outside).alias("_hi"))
        rows = rows.join(bounds, subject)
        scaled = (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        v = F.when(F.col(label) == background, v).otherwise(scaled) if background is not None else scaled
    rows = rows.where(F.col(label) != null_label) if null_label is not None else rows
    return rows.groupBy(subject, label).agg(F.percentile(v, F.array(F.lit(0.5), F.lit(0.75), F.lit(0.25))).alias("q")).select(
        subject, label, F.col("q")[0].alias("median"), F.col("q")[1].alias("upper"), F.col("q")[2].alias("lower")
    )


def group_priors(metrics: DataFrame, label: str, least_spread: float = 0.1) -> DataFrame:
    """Median over subjects of medians and of quartile differences, each difference at least `least_spread`."""
    spread = F.greatest(F.abs(F.col("upper") - F.col("lower")), F.lit(least_spread))
    return metrics.groupBy(label).agg(F.count("*").alias("subjects"), F.percentile("median", 0.5).alias("prior_median"), F.percentile(spread, 0.5).alias("prior_spread"))


def magnitude_and_phase(series: DataFrame, t: str, size: int) -> DataFrame:
    """A 4-D image whose second half of components is phase, as part (mag or phs) and component within it."""
    half = size // 2
    return series.withColumn("part", F.when(F.col(t) < half, "mag").otherwise("phs")).withColumn(t, F.col(t) % half)
