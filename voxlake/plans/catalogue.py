"""Every query of the voxel, series, profile, mesh and graph operators by name, with the SQL that it must equal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clustering, fixpoint, geometry, intensity, laminar, segmentation, statistics, stencil, surface
from ..streaming import windows
from .fixtures import GRID, KEYS, SCALES, SERIES, VOX, profiles, series, volume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, so that two engines' sums compare."""
    return df.select(*[F.round(c, digits).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes])


def query(sql: str | None = None, digits: int = DIGITS) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLES[f.__name__] = sql.replace("$VOX", VOX).replace("$SERIES", SERIES)
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return volume(spark, sf_dir).where("mask").select(*KEYS)


# Regions and overlaps


@query("""WITH $VOX SELECT seg, count(*) AS voxels, count(*) * 1.0::DOUBLE AS volume, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std,
  round(sum(v), 6) AS total, round(avg(v) / stddev_pop(v), 6) AS snr FROM vox GROUP BY seg""")
def region_intensity(spark, d):
    return statistics.region_intensity(volume(spark, d))


_RANKS = """WITH $VOX, r AS (SELECT seg, v, row_number() OVER (PARTITION BY seg ORDER BY v) AS r, count(*) OVER (PARTITION BY seg) AS n FROM vox),
  q AS (SELECT unnest([10, 25, 50, 75, 90]) AS p),
  t AS (SELECT seg, p, n, p / 100.0 * (n + 1) AS pos FROM (SELECT DISTINCT seg, n FROM r) CROSS JOIN q),
  e AS (SELECT t.seg, p, CASE WHEN pos < 1 THEN (SELECT min(v) FROM r WHERE r.seg = t.seg) WHEN pos >= n THEN (SELECT max(v) FROM r WHERE r.seg = t.seg)
    ELSE (SELECT a.v + (t.pos - floor(t.pos)) * (b.v - a.v) FROM r a, r b WHERE a.seg = t.seg AND b.seg = t.seg AND a.r = floor(t.pos) AND b.r = floor(t.pos) + 1) END AS x FROM t)"""


@query(_RANKS + " SELECT seg, " + ", ".join(f"round(max(x) FILTER (WHERE p = {p}), 6) AS p{p}" for p in (10, 25, 50, 75, 90)) + " FROM e GROUP BY seg")
def region_percentiles(spark, d):
    return statistics.ranked_percentiles(volume(spark, d), ["seg"], "v", [10, 25, 50, 75, 90])


@query(_RANKS + """ SELECT seg, round(max(x) FILTER (WHERE p = 75) - max(x) FILTER (WHERE p = 25), 6) AS iqr,
  round(max(x) FILTER (WHERE p = 50) / (max(x) FILTER (WHERE p = 75) - max(x) FILTER (WHERE p = 25)), 6) AS rsnr FROM e GROUP BY seg""")
def region_robust_snr(spark, d):
    p = statistics.ranked_percentiles(volume(spark, d), ["seg"], "v", [25, 50, 75])
    iqr = F.col("p75") - F.col("p25")
    return p.select("seg", iqr.alias("iqr"), F.when(iqr > 0, F.col("p50") / iqr).otherwise(0.0).alias("rsnr"))


@query("""WITH $VOX, c AS (SELECT l.label, count(*) FILTER (WHERE seg = label)::DOUBLE AS na, count(*) FILTER (WHERE tpl = label)::DOUBLE AS nb,
    count(*) FILTER (WHERE seg = label AND tpl = label)::DOUBLE AS nab FROM vox, (SELECT unnest([1, 2, 3]) AS label) l GROUP BY 1)
  SELECT label, na::BIGINT AS voxels_a, nb::BIGINT AS voxels_b, round(2 * nab / (na + nb), 6) AS dice, round(nab / (na + nb - nab), 6) AS jaccard,
    round(abs(na / nb - 1), 6) AS volume_difference, round((na - nab) / na, 6) AS false_positives, round((nb - nab) / nb, 6) AS false_negatives FROM c""")
def label_overlap(spark, d):
    return statistics.overlap(volume(spark, d))


@query("WITH $VOX SELECT seg, tpl, count(*) AS voxels FROM vox GROUP BY 1, 2")
def label_confusion(spark, d):
    return statistics.confusion(volume(spark, d))


@query("""WITH $VOX, a AS (SELECT seg AS label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM vox GROUP BY 1),
  b AS (SELECT tpl AS label, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM vox GROUP BY 1)
  SELECT label, round(sqrt(((a.x - b.x) * 0.5) ** 2 + ((a.y - b.y) * 0.5) ** 2 + ((a.z - b.z) * 2.0) ** 2), 6) AS distance FROM a JOIN b USING (label)""")
def center_distance(spark, d):
    return statistics.center_distance(volume(spark, d), "seg", "tpl", KEYS, (0.5, 0.5, 2.0))


@query("WITH $VOX SELECT seg, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM vox GROUP BY 1")
def center_of_mass(spark, d):
    return statistics.center_of_mass(volume(spark, d), "seg", KEYS)


@query("""SELECT label, round(avg(a * a), 9) AS xx, round(avg(b * b), 9) AS yy, round(avg(c * c), 9) AS zz, round(avg(a * b), 9) AS xy,
  round(avg(a * c), 9) AS xz, round(avg(b * c), 9) AS yz
  FROM (SELECT label, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings) GROUP BY 1""", 9)
def direction_tensor(spark, d):
    rows = profiles(spark, d).select("label", *[F.col("profile")[i].alias(k) for i, k in enumerate("abc")])
    return statistics.direction_tensor(rows, "label", ["a", "b", "c"])


@query("""SELECT user_id, count(v) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std,
  round(sum((v - m) ** 3) / count(*) / (sum((v - m) ** 2) / count(*)) ** 1.5, 6) AS skewness,
  round(sum((v - m) ** 4) / count(*) / (sum((v - m) ** 2) / count(*)) ** 2 - 3, 6) AS kurtosis
  FROM (SELECT user_id, value AS v, avg(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY 1""")
def series_moments(spark, d):
    return statistics.moments(series(spark, d), ["user_id"], "v")


@query("""WITH $VOX, b AS (SELECT seg, min(v) AS lo, max(v) AS hi FROM vox GROUP BY 1)
  SELECT seg, CASE WHEN hi = lo THEN 0 ELSE least(floor((v - lo) / (hi - lo) * 20), 19) END::INT AS bin, count(*) AS n FROM vox JOIN b USING (seg) GROUP BY 1, 2""")
def label_histogram(spark, d):
    return statistics.histogram(volume(spark, d), "v", 20, ("seg",))


@query("""WITH $VOX, b AS (SELECT min(v) AS al, max(v) AS ah, min(w) AS bl, max(w) AS bh FROM vox),
  j AS (SELECT seg, least(floor((v - al) / (ah - al) * 10), 9) AS i, least(floor((w - bl) / (bh - bl) * 10), 9) AS k, count(*)::DOUBLE AS n FROM vox, b GROUP BY ALL),
  p AS (SELECT seg, n, sum(n) OVER (PARTITION BY seg, i) AS ni, sum(n) OVER (PARTITION BY seg, k) AS nk, sum(n) OVER (PARTITION BY seg) AS nn FROM j)
  SELECT seg, round(sum(n / nn * ln(n * nn / (ni * nk))), 6) AS mutual_information FROM p GROUP BY 1""")
def mutual_information(spark, d):
    return statistics.mutual_information(volume(spark, d), "v", "w", 10, ["seg"])


@query("WITH $VOX SELECT seg, round(corr(v, w), 6) AS correlation, round(covar_pop(v, w), 6) AS covariance FROM vox GROUP BY 1")
def image_correlation(spark, d):
    return statistics.correlation(volume(spark, d), "v", "w", ["seg"])


@query("WITH $VOX SELECT seg, round(sum(v * w) / sum(w), 6) AS weighted_mean FROM vox GROUP BY 1")
def weighted_region_mean(spark, d):
    return statistics.weighted_average(volume(spark, d), ["seg"], "v", "w")


@query()
def robust_range(spark, d):
    return statistics.robust_range(volume(spark, d), "v", 0.05, 3)


# Intensities


@query("""WITH $VOX SELECT x, y, z, round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 9) AS normalized FROM vox""", 9)
def range_normalized(spark, d):
    return intensity.range_normalized(volume(spark, d), "v", []).select(*KEYS, "normalized")


@query("""WITH $VOX SELECT x, y, z, round(least(greatest(v, 30000), 40000), 6) AS clamped, round(1 / (1 + exp(-(v - 36000) / 500)), 9) AS membership FROM vox""", 9)
def clamp_and_sigmoid(spark, d):
    v = F.col("v")
    return rounded(volume(spark, d).select(*KEYS, F.round(intensity.clamp(v, 30000.0, 40000.0), 6).alias("clamped"), intensity.sigmoid(v, 36000.0, 500.0).alias("membership")), 9)


@query("""WITH $VOX, i AS (SELECT x, y, z, v / 1000 - 37 AS a, w - 25 AS b FROM vox)
  SELECT x, y, z, round(least(a, b), 6) AS least, round(greatest(a, b), 6) AS most, round(CASE WHEN abs(a) >= abs(b) THEN a ELSE b END, 6) AS signed_max,
    round(a + b, 6) AS total, round(a - b, 6) AS difference, round(a * b, 6) AS product FROM i""")
def image_combinations(spark, d):
    rows = volume(spark, d).select(*KEYS, (F.col("v") / 1000 - 37).alias("a"), (F.col("w") - 25).alias("b"))
    ways = {"least": "min", "most": "max", "signed_max": "signed_max", "total": "sum", "difference": "difference", "product": "product"}
    return rows.select(*KEYS, *[intensity.combined(F.col("a"), F.col("b"), how).alias(name) for name, how in ways.items()])


@query("""WITH $VOX SELECT x, y, z, round(CASE WHEN seg + tpl <> 0 THEN (v * seg + w * tpl) / (seg + tpl) ELSE 0 END, 6) AS mixed FROM vox""")
def weighted_combination(spark, d):
    return volume(spark, d).select(*KEYS, intensity.weighted([F.col("v"), F.col("w")], [F.col("seg"), F.col("tpl")]).alias("mixed"))


@query("""SELECT user_id, round(avg(value), 6) AS average, round(sum(value), 4) AS total, round(sqrt(avg(value * value)), 6) AS rms, round(min(value), 6) AS least,
  round(max(value), 6) AS most, round(max(value) - min(value), 6) AS spread, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY 1""")
def series_reducers(spark, d):
    r = intensity.reduced(series(spark, d), ["user_id"], "v")
    return r.withColumn("total", F.round("total", 4))


@query("""SELECT l_orderkey % 64 AS voxel, round(exp(regr_intercept(ln(l_extendedprice), l_linenumber)), 6) AS s0, round(-regr_slope(ln(l_extendedprice), l_linenumber), 9) AS rate,
  round(regr_r2(ln(l_extendedprice), l_linenumber), 9) AS r2 FROM lineitem GROUP BY 1""", 9)
def exponential_fit(spark, d):
    rows = _table(spark, d, "lineitem").select((F.col("l_orderkey") % 64).alias("voxel"), "l_linenumber", "l_extendedprice")
    return intensity.exponential_fit(rows, ["voxel"], "l_linenumber", "l_extendedprice").withColumn("s0", F.round("s0", 6))


@query("""WITH $VOX, s AS (SELECT least(greatest(floor((v - 20000) / 40000 * 50), 0), 49)::INT AS bin, count(*) AS n FROM vox WHERE seg = 1 GROUP BY 1),
  t AS (SELECT least(greatest(floor((v - 20000) / 40000 * 50), 0), 49)::INT AS bin, count(*) AS n FROM vox WHERE seg = 2 GROUP BY 1),
  a AS (SELECT bin, n, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cdf FROM s), b AS (SELECT bin, sum(n) OVER (ORDER BY bin) / sum(n) OVER () AS cdf FROM t)
  SELECT a.bin, n, min(b.bin) AS matched FROM a JOIN b ON round(b.cdf, 12) >= round(a.cdf, 12) GROUP BY 1, 2""")
def histogram_matching(spark, d):
    v = volume(spark, d)
    return intensity.histogram_matching(v.where("seg = 1"), v.where("seg = 2"), "v", 50, 20000.0, 60000.0)


@query()
def background_em(spark, d):
    return intensity.background_em(volume(spark, d), "v")


@query("""WITH $VOX, i AS (SELECT x, y, z, v / 1000 AS a, w AS b FROM vox)
  SELECT x, y, z, round(CASE WHEN a * a + b * b > 0 THEN a * b * cos((a - b) / 10) / (a * a + b * b) ELSE 0 END, 9) AS uni FROM i""", 9)
def unified_contrast(spark, d):
    a, b = F.col("v") / 1000, F.col("w")
    return volume(spark, d).select(*KEYS, intensity.unified_mp2rage(a, b, (a - b) / 10).alias("uni"))


@query("""WITH $VOX SELECT x, y, z, round(CASE WHEN w <= 10 THEN 1 WHEN w >= 40 THEN 4 WHEN w < 20 THEN 1 + (w - 10) / 10 * 2 ELSE 3 + (w - 20) / 20 END, 9) AS mapped FROM vox""", 9)
def table_lookup(spark, d):
    lut = spark.createDataFrame([(10.0, 1.0), (20.0, 3.0), (40.0, 4.0)], "key double, mapped double")
    return intensity.looked_up(volume(spark, d).select(*KEYS, "w"), "w", lut).drop("w")


# Label maps and masks


@query("""SELECT c_custkey, coalesce(n.n_regionkey, 0)::INT AS new FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) n ON c_nationkey = n_nationkey""")
def relabelled(spark, d):
    table = _table(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("old"), F.col("n_regionkey").alias("new"))
    rows = _table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("label"))
    return segmentation.relabelled(rows, "label", table).select("c_custkey", F.col("new").cast("int").alias("new"))


_OPS = {"and": "INTERSECT", "or": "UNION"}


@query("""WITH $VOX, a AS (SELECT x, y, z FROM vox WHERE seg = 1), b AS (SELECT x, y, z FROM vox WHERE tpl = 1)
  SELECT 'and' AS op, * FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'or', * FROM (FROM a UNION FROM b)
  UNION ALL SELECT 'xor', * FROM ((FROM a EXCEPT FROM b) UNION (FROM b EXCEPT FROM a)) UNION ALL SELECT 'not', * FROM (SELECT x, y, z FROM vox EXCEPT FROM a)""")
def mask_algebra(spark, d):
    v = volume(spark, d)
    a, b = segmentation.extracted(v, "seg", "equal", 1), segmentation.extracted(v, "tpl", "equal", 1)
    parts = {"and": segmentation.mask_and(a, b, KEYS), "or": segmentation.mask_or(a, b, KEYS), "xor": segmentation.mask_xor(a, b, KEYS), "not": segmentation.mask_not(a, v, KEYS)}
    out = None
    for op, rows in parts.items():
        rows = rows.select(F.lit(op).alias("op"), *KEYS)
        out = rows if out is None else out.unionAll(rows)
    return out


@query("""WITH p AS (SELECT l_orderkey % 500 AS voxel, l_linenumber AS label, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY l_orderkey % 500) AS p FROM lineitem GROUP BY 1, 2)
  SELECT voxel, label, round(p, 6) AS p, (row_number() OVER (PARTITION BY voxel ORDER BY p DESC, label))::INT AS rank FROM p
  QUALIFY row_number() OVER (PARTITION BY voxel ORDER BY p DESC, label) <= 3""")
def top_labels(spark, d):
    counts = _table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 500).alias("voxel"), F.col("l_linenumber").alias("label")).count()
    from pyspark.sql import Window

    p = counts.select("voxel", "label", (F.col("count") / F.sum("count").over(Window.partitionBy("voxel"))).alias("p"))
    return segmentation.top_labels(p, ["voxel"], "label", "p", 3)


@query("""WITH m AS (SELECT (l_orderkey % 16)::INT AS x, (l_partkey % 16)::INT AS y, l_linenumber AS label, count(*) AS votes FROM lineitem GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY votes DESC, label) AS r, sum(votes) OVER (PARTITION BY x, y) AS maps FROM m)
  SELECT x, y, label, votes, maps::BIGINT AS maps FROM r WHERE r = 1""")
def majority_labels(spark, d):
    rows = _table(spark, d, "lineitem").select((F.col("l_orderkey") % 16).cast("int").alias("x"), (F.col("l_partkey") % 16).cast("int").alias("y"), F.col("l_linenumber").alias("label"))
    return segmentation.merged_labels(rows, ["x", "y"], "label")


@query("""WITH $VOX SELECT x - 2 AS x, 15 - (y - 3) AS y, z, round(v, 6) AS v FROM vox WHERE x BETWEEN 2 AND 9 AND y BETWEEN 3 AND 12 AND z BETWEEN 0 AND 5""")
def crop_and_mirror(spark, d):
    rows = segmentation.cropped(volume(spark, d).select(*KEYS, "v"), KEYS, (2, 3, 0), (9, 12, 5))
    return segmentation.mirrored(rows, "y", 16)


@query("""WITH $VOX SELECT seg, min(x) AS x_low, max(x) AS x_high, min(y) AS y_low, max(y) AS y_high, min(z) AS z_low, max(z) AS z_high FROM vox WHERE mask GROUP BY 1""")
def bounding_boxes(spark, d):
    return segmentation.bounding_boxes(volume(spark, d).where("mask"), KEYS, "seg")


@query("""WITH $VOX SELECT z AS x, x AS y, y AS z, round(v, 6) AS v FROM vox""")
def axes_permuted(spark, d):
    return segmentation.permuted(volume(spark, d).select(*KEYS, "v"), KEYS, ["z", "x", "y"])


# Neighbourhoods

_BOX = "(SELECT unnest([-1, 0, 1]) AS dx) a, (SELECT unnest([-1, 0, 1]) AS dy) b, (SELECT unnest([-1, 0, 1]) AS dz) c"
_N6 = f"n AS (SELECT * FROM {_BOX} WHERE abs(dx) + abs(dy) + abs(dz) = 1)"
_N26 = f"n AS (SELECT * FROM {_BOX} WHERE abs(dx) + abs(dy) + abs(dz) > 0)"
_ALL = f"n AS (SELECT * FROM {_BOX})"
_AT = "ON q.x = p.x + n.dx AND q.y = p.y + n.dy AND q.z = p.z + n.dz"


@query(f"""WITH $VOX, {_N6}, m AS (SELECT x, y, z FROM vox WHERE mask)
  SELECT DISTINCT p.x + dx AS x, p.y + dy AS y, p.z + dz AS z FROM m p, (FROM n UNION ALL SELECT 0, 0, 0) n
  WHERE p.x + dx BETWEEN 0 AND 15 AND p.y + dy BETWEEN 0 AND 15 AND p.z + dz BETWEEN 0 AND 7""")
def mask_dilated(spark, d):
    return stencil.dilated(_mask(spark, d), KEYS, stencil.neighbours(6), GRID)


@query(f"""WITH $VOX, {_N6}, m AS (SELECT x, y, z FROM vox WHERE seg >= 1)
  SELECT p.x, p.y, p.z FROM m p, n JOIN m q {_AT} GROUP BY ALL HAVING count(*) = 6""")
def mask_eroded(spark, d):
    return stencil.eroded(volume(spark, d).where("seg >= 1"), KEYS, stencil.neighbours(6))


@query(f"""WITH $VOX, {_N6} SELECT DISTINCT p.x, p.y, p.z, p.seg FROM vox p, n JOIN vox q {_AT} WHERE p.seg <> q.seg""")
def label_boundary(spark, d):
    return stencil.boundary(volume(spark, d), KEYS, "seg")


@query(f"""WITH $VOX, {_N26} SELECT p.x, p.y, p.z, round(avg(q.v), 6) AS mean, count(*) AS n FROM vox p, n JOIN vox q {_AT} GROUP BY ALL""")
def neighbour_mean(spark, d):
    return stencil.neighbour_mean(volume(spark, d), KEYS, "v", stencil.neighbours(26))


@query(f"""WITH $VOX, {_ALL} SELECT p.x, p.y, p.z, round(min(q.v), 6) AS least, round(median(q.v), 6) AS median, round(max(q.v), 6) AS most FROM vox p, n JOIN vox q {_AT} GROUP BY ALL""")
def neighbour_rank(spark, d):
    return stencil.neighbour_rank(volume(spark, d), KEYS, "v", stencil.neighbours(26))


@query(f"""WITH $VOX, {_N6}, g AS (SELECT p.x, p.y, p.z, count(*) AS c, sum(q.v * dx) / 2 AS gx, sum(q.v * dy) / 2 AS gy, sum(q.v * dz) / 2 AS gz FROM vox p, n JOIN vox q {_AT} GROUP BY ALL)
  SELECT x, y, z, round(gx, 6) AS gx, round(gy, 6) AS gy, round(gz, 6) AS gz, round(sqrt(gx * gx + gy * gy + gz * gz), 6) AS norm FROM g WHERE c = 6""")
def image_gradient(spark, d):
    return stencil.gradient(volume(spark, d), KEYS, "v")


@query(f"""WITH $VOX, {_N6} SELECT p.x, p.y, p.z, round(sum(q.v - p.v), 6) AS laplacian FROM vox p, n JOIN vox q {_AT} GROUP BY ALL HAVING count(*) = 6""")
def image_laplacian(spark, d):
    return stencil.laplacian(volume(spark, d), KEYS, "v")


@query(f"""WITH $VOX, {_N26} SELECT p.seg, round(avg(p.v - q.v), 4) AS gradient, round(avg(abs(p.v - q.v)), 4) AS magnitude FROM vox p, n JOIN vox q {_AT} WHERE p.seg <> q.seg GROUP BY 1""", 4)
def boundary_gradient(spark, d):
    return stencil.boundary_gradient(volume(spark, d), KEYS, "seg", "v")


_TAPS = ", ".join(f"({i - len(stencil.gaussian_kernel(1.0)) // 2}, {w!r}::DOUBLE)" for i, w in enumerate(stencil.gaussian_kernel(1.0)))


@query(f"""WITH $VOX, k AS (SELECT * FROM (VALUES {_TAPS}) t(d, g)),
  a AS (SELECT p.x, p.y, p.z, sum(q.v * g) / sum(g) AS s FROM vox p, k JOIN vox q ON q.x = p.x + d AND q.y = p.y AND q.z = p.z GROUP BY ALL),
  b AS (SELECT p.x, p.y, p.z, sum(q.s * g) / sum(g) AS s FROM a p, k JOIN a q ON q.x = p.x AND q.y = p.y + d AND q.z = p.z GROUP BY ALL)
  SELECT p.x, p.y, p.z, round(sum(q.s * g) / sum(g), 6) AS smooth FROM b p, k JOIN b q ON q.x = p.x AND q.y = p.y AND q.z = p.z + d GROUP BY ALL""")
def gaussian_smoothed(spark, d):
    return stencil.smoothed(volume(spark, d), KEYS, "v", 1.0)


@query("""WITH $VOX SELECT x, y, z, round(avg(v) OVER (PARTITION BY y, z ORDER BY x RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS moving FROM vox""")
def moving_mean(spark, d):
    return stencil.moving(volume(spark, d).select(*KEYS, "v"), ["y", "z"], "x", "v", 2).drop("v")


@query(f"""WITH $VOX, n AS (SELECT * FROM {_BOX} WHERE dx > 0 OR (dx = 0 AND (dy > 0 OR (dy = 0 AND dz > 0)))),
  s AS (SELECT p.x, p.y, p.z, p.v - (q.v + r.v) / 2 AS s FROM vox p, n JOIN vox q {_AT} JOIN vox r ON r.x = p.x - dx AND r.y = p.y - dy AND r.z = p.z - dz)
  SELECT x, y, z, round(max(s), 6) AS bright, round(min(s), 6) AS dark FROM s GROUP BY ALL HAVING count(*) = 13""")
def ridge_filter(spark, d):
    return stencil.ridge(volume(spark, d), KEYS, "v")


@query(f"""WITH $VOX, {_ALL}, a AS (SELECT x, y, z FROM vox WHERE seg = 1), b AS (SELECT x, y, z FROM vox WHERE tpl = 1),
  da AS (SELECT DISTINCT p.x + dx AS x, p.y + dy AS y, p.z + dz AS z FROM a p, n), db AS (SELECT DISTINCT p.x + dx AS x, p.y + dy AS y, p.z + dz AS z FROM b p, n)
  SELECT round(((SELECT count(*) FROM (FROM da INTERSECT FROM b)) + (SELECT count(*) FROM (FROM a INTERSECT FROM db))) / ((SELECT count(*) FROM a) + (SELECT count(*) FROM b)), 6) AS dilated_dice""")
def dilated_overlap(spark, d):
    v = volume(spark, d)
    a, b = v.where("seg = 1").select(*KEYS), v.where("tpl = 1").select(*KEYS)
    box = stencil.neighbours(26)
    hit = lambda grown, other: stencil.dilated(grown, KEYS, box).join(other, KEYS, "left_semi").agg(F.count("*").alias("n"))
    size = a.unionAll(b).agg(F.count("*").alias("m"))
    hits = hit(a, b).unionAll(hit(b, a)).agg(F.sum("n").alias("n"))
    return hits.crossJoin(size).select((F.col("n") / F.col("m")).alias("dilated_dice"))


# Fixpoints

_FLOOD = """WITH RECURSIVE $VOX, m AS (SELECT x, y, z, x + 16 * y + 256 * z AS id FROM vox WHERE mask), {near},
  e AS MATERIALIZED (SELECT p.id AS a, q.id AS b FROM m p, n JOIN m q {at}),
  r AS (SELECT id AS a, id AS b FROM m UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)"""


@query(_FLOOD.format(near=_N6, at=_AT) + " SELECT x, y, z, min(r.b)::BIGINT AS component FROM m JOIN r ON m.id = r.a GROUP BY ALL")
def components_6(spark, d):
    return fixpoint.components(_mask(spark, d), KEYS, GRID, 6)


_N18 = f"n AS (SELECT * FROM {_BOX} WHERE abs(dx) + abs(dy) + abs(dz) BETWEEN 1 AND 2)"


@query(_FLOOD.format(near=_N18, at=_AT) + """, c AS (SELECT a, min(b) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS voxels FROM c GROUP BY 1)
  SELECT component::BIGINT AS component, voxels, (row_number() OVER (ORDER BY voxels DESC, component))::INT AS rank FROM s""")
def component_sizes_18(spark, d):
    return fixpoint.component_sizes(fixpoint.components(_mask(spark, d), KEYS, GRID, 18))


@query(_FLOOD.format(near=_N6, at=_AT) + """, c AS (SELECT a, min(b) AS component FROM r GROUP BY 1), s AS (SELECT component FROM c GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1)
  SELECT c.component::BIGINT AS component, x, y, z FROM m JOIN c ON m.id = c.a JOIN s USING (component)""")
def largest_component(spark, d):
    return fixpoint.largest(fixpoint.components(_mask(spark, d), KEYS, GRID, 6))


@query()
def holes_filled(spark, d):
    v = volume(spark, d)
    return fixpoint.filled(v.where("seg >= 1").select(*KEYS), v, KEYS, GRID)


@query()
def cluster_detection(spark, d):
    v = volume(spark, d)
    return fixpoint.detection(v.where("mask").select(*KEYS), v.where("tpl = 1 and seg = 1").select(*KEYS), KEYS, GRID)


@query(f"""WITH RECURSIVE $VOX, {_N6}, g AS (SELECT x, y, z FROM vox), r AS (SELECT x, y, z, 0 AS s FROM vox WHERE mask
    UNION SELECT q.x, q.y, q.z, s + 1 FROM r p, n JOIN g q {_AT} WHERE s < 24)
  SELECT x, y, z, min(s)::DOUBLE AS distance FROM r GROUP BY ALL""")
def city_block_distance(spark, d):
    return fixpoint.chamfer_distance(volume(spark, d), KEYS, F.col("mask"), {1: 1.0})


@query()
def chamfer_distance(spark, d):
    return fixpoint.chamfer_distance(volume(spark, d), KEYS, F.col("mask"), {1: 1.0, 2: 2**0.5, 3: 3**0.5})


_DIFFUSE = "s{k} AS (SELECT p.x, p.y, p.z, p.u + 0.5 * (coalesce(avg(q.u), p.u) - p.u) AS u FROM s{j} p CROSS JOIN n LEFT JOIN s{j} q {at} GROUP BY p.x, p.y, p.z, p.u)"


@query(f"WITH $VOX, {_N6}, s0 AS (SELECT x, y, z, v AS u FROM vox), " + ", ".join(_DIFFUSE.format(k=k, j=k - 1, at=_AT) for k in (1, 2, 3)) + " SELECT x, y, z, round(u, 6) AS diffused FROM s3")
def diffusion(spark, d):
    return fixpoint.diffused(volume(spark, d), KEYS, "v", 0.5, 3)


@query(f"""WITH $VOX, {_N26}, s0 AS (SELECT x, y, z, CASE WHEN mask THEN v END AS u FROM vox),
  s1 AS (SELECT p.x, p.y, p.z, coalesce(p.u, avg(q.u)) AS u FROM s0 p CROSS JOIN n LEFT JOIN s0 q {_AT} GROUP BY p.x, p.y, p.z, p.u),
  s2 AS (SELECT p.x, p.y, p.z, coalesce(p.u, avg(q.u)) AS u FROM s1 p CROSS JOIN n LEFT JOIN s1 q {_AT} GROUP BY p.x, p.y, p.z, p.u)
  SELECT x, y, z, round(u, 6) AS carried FROM s2""")
def propagation(spark, d):
    return fixpoint.propagated(volume(spark, d), KEYS, "v", F.col("mask"), 2)


# Profiles and series


@query("""WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT vec_id, v, avg(v) OVER (PARTITION BY vec_id) AS a FROM p),
  s AS (SELECT vec_id, count(*) AS n, avg(v) AS mean, sum((v - a) ** 2) AS m2, sum((v - a) ** 3) AS m3, sum((v - a) ** 4) AS m4 FROM m GROUP BY 1)
  SELECT vec_id, n, round(mean, 6) AS mean, round(sqrt(m2 / (n - 1)), 6) AS std, round(m3 / n / sqrt(m2 / (n - 1)) ** 3, 6) AS skewness, round(m4 / n / (m2 / n) ** 2 - 3, 6) AS kurtosis FROM s""")
def profile_moments(spark, d):
    return laminar.profile_moments(profiles(spark, d), ["vec_id"])


@query("""SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS most, (list_position(embedding, list_max(embedding)) - 1)::INT AS depth, round(list_min(embedding)::DOUBLE, 6) AS least,
  round(list_max(list_transform(range(1, 64), lambda i: embedding[i + 1]::DOUBLE - embedding[i]::DOUBLE)), 6) AS rise FROM embeddings""")
def profile_peak(spark, d):
    return laminar.profile_peak(profiles(spark, d), ["vec_id"])


@query("""SELECT label, (i - 1)::INT AS depth, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
  FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2""")
def mean_profile(spark, d):
    return laminar.mean_profile(profiles(spark, d), "label")


@query("""SELECT vec_id, round(embedding[16]::DOUBLE + 0.75 * (embedding[17]::DOUBLE - embedding[16]::DOUBLE), 6) AS sampled FROM embeddings""")
def profile_sampled(spark, d):
    return laminar.sampled_at(profiles(spark, d), ["vec_id"], F.lit(0.25))


@query("""WITH $SERIES, l AS (SELECT user_id, abs(v - lag(v) OVER (PARTITION BY user_id ORDER BY t)) AS d FROM series) SELECT user_id, round(median(d), 6) AS noise FROM l GROUP BY 1""")
def lag_noise(spark, d):
    return laminar.lag_noise(series(spark, d), ["user_id"], "t", "v")


@query("""WITH $SERIES SELECT user_id, t, round((v - avg(v) OVER w) / stddev_samp(v) OVER w, 6) AS z FROM series WINDOW w AS (PARTITION BY user_id)""")
def series_zscores(spark, d):
    return laminar.standardized(series(spark, d), ["user_id"], "v").select("user_id", "t", "z")


@query("""WITH $SERIES, s AS (SELECT user_id, t, v * 0.98765432 AS v FROM series), f AS (SELECT user_id, regr_slope(v, t) AS b, regr_intercept(v, t) AS a FROM s GROUP BY 1)
  SELECT user_id, t, round(v - a - b * t, 6) AS residual FROM s JOIN f USING (user_id)""")
def series_detrended(spark, d):
    rows = series(spark, d).withColumn("v", F.col("v") * SCALES[0])  # off ties of rounding
    return laminar.detrended(rows, ["user_id"], "t", "v").select("user_id", "t", "residual")


@query("""WITH $SERIES, l AS (SELECT user_id, v, lag(v) OVER (PARTITION BY user_id ORDER BY t) AS p FROM series) SELECT user_id, round(corr(v, p), 6) AS autocorrelation FROM l GROUP BY 1""")
def series_autocorrelation(spark, d):
    return laminar.autocorrelation(series(spark, d), ["user_id"], "t", "v", 1)


@query("""SELECT l_returnflag, round(regr_intercept(l_extendedprice, l_quantity), 4) AS b_intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS b_l_quantity FROM lineitem GROUP BY 1""", 4)
def linear_model(spark, d):
    return laminar.linear_model(_table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", ["l_quantity"])


# Coordinates


@query("""WITH $VOX, p AS (SELECT x, y, z, floor(15 - y + 0.5)::INT AS a, floor(x + 0.5)::INT AS b, floor(z + 1 + 0.5)::INT AS c FROM vox)
  SELECT p.x, p.y, p.z, round(v, 6) AS sampled FROM p LEFT JOIN vox q ON q.x = a AND q.y = b AND q.z = c""")
def nearest_resampled(spark, d):
    turn = np.array([[0, -1, 0, 15], [1, 0, 0, 0], [0, 0, 1, 1], [0, 0, 0, 1]], float)
    return geometry.resampled(volume(spark, d), KEYS, "v", turn, linear=False)


@query(f"""WITH $VOX, p AS (SELECT x, y, z, x * 0.75 + 0.3 AS a, y * 0.75 + 0.6 AS b, z * 0.75 + 0.1 AS c FROM vox),
  n AS (SELECT * FROM {_BOX} WHERE dx >= 0 AND dy >= 0 AND dz >= 0),
  w AS (SELECT p.*, (floor(a) + dx)::INT AS i, (floor(b) + dy)::INT AS j, (floor(c) + dz)::INT AS k,
    (CASE WHEN dx = 1 THEN a - floor(a) ELSE 1 - (a - floor(a)) END) * (CASE WHEN dy = 1 THEN b - floor(b) ELSE 1 - (b - floor(b)) END) * (CASE WHEN dz = 1 THEN c - floor(c) ELSE 1 - (c - floor(c)) END) AS g FROM p, n)
  SELECT w.x, w.y, w.z, round(sum(g * coalesce(v, 0)), 6) AS sampled FROM w LEFT JOIN vox q ON q.x = i AND q.y = j AND q.z = k GROUP BY ALL""")
def trilinear_resampled(spark, d):
    scale = geometry.affine(np.eye(3) * 0.75, (0.3, 0.6, 0.1))
    return geometry.resampled(volume(spark, d), KEYS, "v", scale)


# Meshes, graphs and clusters


def _mesh(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    heights = volume(spark, sf_dir).groupBy("x", "y").agg((F.avg("v") / 1000).alias("h"))
    return surface.height_mesh(heights, "x", "y", "h", GRID[0])


_MESH = """$VOX, ve AS (SELECT x + 16 * y AS vid, x::DOUBLE AS px, y::DOUBLE AS py, avg(v) / 1000 AS pz FROM vox GROUP BY x, y),
  q AS (SELECT vid AS a FROM ve WHERE vid % 16 < 15 AND vid + 17 <= (SELECT max(vid) FROM ve)),
  fa AS (SELECT a * 2 AS fid, a AS v0, a + 1 AS v1, a + 17 AS v2 FROM q UNION ALL SELECT a * 2 + 1, a, a + 17, a + 16 FROM q),
  ar AS (SELECT fid, v0, v1, v2, sqrt(((b.py - a.py) * (c.pz - a.pz) - (b.pz - a.pz) * (c.py - a.py)) ** 2 + ((b.pz - a.pz) * (c.px - a.px) - (b.px - a.px) * (c.pz - a.pz)) ** 2
    + ((b.px - a.px) * (c.py - a.py) - (b.py - a.py) * (c.px - a.px)) ** 2) / 2 AS area FROM fa JOIN ve a ON a.vid = v0 JOIN ve b ON b.vid = v1 JOIN ve c ON c.vid = v2)"""


@query(f"WITH {_MESH}, u AS (SELECT unnest([v0, v1, v2]) AS vid, area / 3 AS area FROM ar) SELECT vid, round(sum(area), 6) AS area FROM u GROUP BY 1")
def vertex_areas(spark, d):
    vertices, faces = _mesh(spark, d)
    return surface.vertex_areas(faces, vertices)


@query(f"""WITH {_MESH}, u AS (SELECT DISTINCT unnest([v0, v1, v0, v2, v1, v2]) AS vid, unnest([v1, v0, v2, v0, v2, v1]) AS nid FROM fa)
  SELECT (SELECT count(*) FROM fa) AS faces, (count(*) / 2)::BIGINT AS edges, count(DISTINCT vid) AS vertices, (count(DISTINCT vid) - count(*) / 2 + (SELECT count(*) FROM fa))::BIGINT AS euler FROM u""")
def mesh_euler(spark, d):
    return surface.euler(_mesh(spark, d)[1])


@query(f"""WITH {_MESH}, u AS (SELECT DISTINCT unnest([v0, v1, v0, v2, v1, v2]) AS vid, unnest([v1, v0, v2, v0, v2, v1]) AS nid FROM fa),
  s1 AS (SELECT p.vid, p.pz + 0.5 * (avg(q.pz) - p.pz) AS s FROM ve p JOIN u ON u.vid = p.vid JOIN ve q ON q.vid = u.nid GROUP BY p.vid, p.pz)
  SELECT p.vid, round(p.s + 0.5 * (avg(q.s) - p.s), 6) AS smooth FROM s1 p JOIN u ON u.vid = p.vid JOIN s1 q ON q.vid = u.nid GROUP BY p.vid, p.s""")
def mesh_smoothed(spark, d):
    vertices, faces = _mesh(spark, d)
    return surface.smoothed(vertices, faces, "pz", 0.5, 2)


@query("""SELECT node, count(*) AS degree FROM (SELECT unnest([o_custkey * 2, o_orderkey * 2 + 1]) AS node FROM orders) GROUP BY 1""")
def graph_degrees(spark, d):
    edges = _table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("a"), (F.col("o_orderkey") * 2 + 1).alias("b"))
    return clustering.degrees(edges, "a", "b")


@query("""WITH e AS (SELECT l_partkey AS a, l_suppkey + 1000000 AS b, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
  t AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY w DESC, b) AS r FROM t),
  m AS (SELECT a, b AS best FROM r WHERE r = 1)
  SELECT m.a, m.best FROM m JOIN m n ON m.best = n.a AND n.best = m.a WHERE m.a < m.best""")
def mutual_best_pairs(spark, d):
    edges = _table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 1000000).alias("b")).agg(F.sum("l_quantity").alias("w"))
    return clustering.best_partners(edges, "a", "b", "w").select("a", "best")


@query("""WITH $VOX, l AS (SELECT unnest([0, 1, 2, 3]) AS level)
  SELECT level, (x // (1 << level))::INT AS x, (y // (1 << level))::INT AS y, (z // (1 << level))::INT AS z, count(*) AS n, round(avg(v), 4) AS mean, round(var_pop(v) * count(*), 2) AS deviation FROM vox, l GROUP BY ALL""", 4)
def octree_levels(spark, d):
    return clustering.octree(volume(spark, d), KEYS, "v", 3).withColumn("deviation", F.round("deviation", 2))


@query("""SELECT i, j, round(covar_pop(a, b), 9) AS value FROM (SELECT i - 1 AS i, j - 1 AS j, embedding[i]::DOUBLE AS a, embedding[j]::DOUBLE AS b
  FROM embeddings, (SELECT unnest(range(1, 65))::INT AS i) p, (SELECT unnest(range(1, 65))::INT AS j) q WHERE i <= j) GROUP BY 1, 2""", 9)
def vector_covariance(spark, d):
    return clustering.covariance(profiles(spark, d), "profile", 64)


@query()
def fuzzy_clusters(spark, d):
    v = volume(spark, d)
    centroids = clustering.fuzzy_centroids(v, "v", [34000.0, 37000.0, 40000.0], 5)
    return clustering.memberships(v.select(*KEYS, "v"), "v", centroids)


# Event-time windows


@query("""SELECT date_trunc('day', ts) AS begins, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def daily_windows(spark, d):
    return windows.tumbling(_table(spark, d, "events"), "ts", "1 day", ["event_type"], "value")


@query("""SELECT begins, count(*) AS n, round(max(value), 6) AS most FROM (SELECT value, unnest([time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01'), time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 12 HOUR]) AS begins FROM events) GROUP BY 1""")
def sliding_windows(spark, d):
    return windows.sliding(_table(spark, d, "events"), "ts", "1 day", "12 hours", [], "value")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT min(ts) AS begins, max(ts) + INTERVAL 6 HOUR AS ends, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""", 4)
def user_sessions(spark, d):
    return windows.sessions(_table(spark, d, "events"), "ts", "6 hours", ["user_id"], "value")
