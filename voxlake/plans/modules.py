"""More queries: whole modules composed from the operators, with the SQL that they must equal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import clustering, fixpoint, geometry, intensity, laminar, levelset, segmentation, shape, statistics, stencil, surface
from ..sources import tables
from .catalogue import _AT, _BOX, _FLOOD, _MESH, _N6, _N18, _N26, _mask, _mesh, _table, query
from .fixtures import GRID, KEYS, profiles, series, volume


@query("""SELECT l_returnflag AS label, l_linenumber AS t, count(*) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS std FROM lineitem GROUP BY 1, 2""", 4)
def statistics_4d(spark, d):
    m = statistics.moments(_table(spark, d, "lineitem"), ["l_returnflag", "l_linenumber"], "l_extendedprice")
    return m.select(F.col("l_returnflag").alias("label"), F.col("l_linenumber").alias("t"), "n", "mean", "std")


@query(_FLOOD.format(near=_N18, at=_AT) + """, c AS (SELECT a, min(b) AS component FROM r GROUP BY 1), s AS (SELECT component, count(*) AS voxels FROM c GROUP BY 1),
  k AS (SELECT *, row_number() OVER (ORDER BY voxels DESC, component) AS rank, sum(voxels) OVER (ORDER BY voxels DESC, component ROWS UNBOUNDED PRECEDING) / sum(voxels) OVER () AS coverage FROM s)
  SELECT component::BIGINT AS component, voxels, rank::INT AS rank, round(coverage, 6) AS coverage FROM k WHERE rank <= 5 OR coverage <= 0.5""")
def cluster_post_process(spark, d):
    sizes = fixpoint.component_sizes(fixpoint.components(_mask(spark, d), KEYS, GRID, 18))
    up = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("coverage", F.sum("voxels").over(up) / F.sum("voxels").over(Window.partitionBy())).where("rank <= 5 or coverage <= 0.5")


@query(_FLOOD.format(near=_N26, at=_AT) + """, c AS (SELECT a, min(b) AS component FROM r GROUP BY 1)
  SELECT component::BIGINT AS component, count(*) AS voxels, CASE WHEN count(*) FILTER (WHERE q.seg = 1) > count(*) FILTER (WHERE q.seg <> 1) THEN 'near' ELSE 'deep' END AS place
  FROM c JOIN m ON m.id = c.a JOIN vox p ON p.x = m.x AND p.y = m.y AND p.z = m.z CROSS JOIN n JOIN vox q ON q.x = p.x + dx AND q.y = p.y + dy AND q.z = p.z + dz GROUP BY 1""".replace("count(*) AS voxels", "count(DISTINCT m.id) AS voxels"))
def lesion_classes(spark, d):
    v = volume(spark, d)
    parts = fixpoint.components(v.where("mask").select(*KEYS), KEYS, GRID, 26)
    pairs = parts.join(stencil.shifted(v, KEYS, stencil.neighbours(26), ["seg"]), KEYS)
    near, far = F.sum((F.col("n_seg") == 1).cast("int")), F.sum((F.col("n_seg") != 1).cast("int"))
    return pairs.groupBy("component").agg(F.countDistinct(*KEYS).alias("voxels"), F.when(near > far, "near").otherwise("deep").alias("place"))


@query(f"""WITH $VOX, n AS (SELECT * FROM {_BOX} WHERE dx > 0 OR (dx = 0 AND (dy > 0 OR (dy = 0 AND dz > 0)))),
  t AS (SELECT p.x, p.y, p.z, q.v - p.v AS a, r.v - p.v AS b FROM vox p, n JOIN vox q {_AT} JOIN vox r ON r.x = p.x - dx AND r.y = p.y - dy AND r.z = p.z - dz)
  SELECT x, y, z, count(*) AS triples, round(max(abs(a - b)), 6) AS boundary FROM t GROUP BY ALL""")
def opposite_neighbours(spark, d):
    v = volume(spark, d)
    ahead = [o for o in stencil.neighbours(26) if o > (0, 0, 0)]
    one = stencil.stencil(v, KEYS, [tuple(-k for k in o) for o in ahead], ["v"], ["v"])
    two = stencil.stencil(v, KEYS, ahead, ["v"], [])
    turned = two.select(*KEYS, F.col("n_v").alias("back"), *[(-F.col(f"d{k}")).alias(f"d{k}") for k in KEYS])
    both = one.join(turned, [*KEYS, "dx", "dy", "dz"])
    return both.groupBy(*KEYS).agg(F.count("*").alias("triples"), F.max(F.abs(F.col("n_v") - F.col("back"))).alias("boundary"))


@query("""WITH l AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events), m AS (SELECT user_id, median(d) AS noise FROM l GROUP BY 1)
  SELECT count(*) AS series, round(median(noise), 6) AS noise FROM m""")
def global_noise(spark, d):
    noise = laminar.lag_noise(series(spark, d), ["user_id"], "t", "v")
    return noise.agg(F.count("*").alias("series"), F.percentile("noise", 0.5).alias("noise"))


@query("""SELECT label, (i - 1)::INT AS layer, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std
  FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2""")
def roi_averages(spark, d):
    return laminar.mean_profile(profiles(spark, d), "label").withColumnRenamed("depth", "layer")


@query("""WITH $VOX SELECT x, y, z, round(0.5 + 0.5 * least(greatest(-(v - 37000) / 2000, -1), 1), 9) AS p FROM vox""", 9)
def level_to_probability(spark, d):
    return volume(spark, d).select(*KEYS, segmentation.level_to_probability(F.col("v") - 37000, 2000.0).alias("p"))


@query(f"WITH $VOX, {_N6} SELECT DISTINCT p.x, p.y, p.z FROM vox p, n JOIN vox q {_AT} WHERE p.v < 37000 AND q.v >= 37000")
def level_boundary(spark, d):
    return levelset.zero_boundary(volume(spark, d).select(*KEYS, (F.col("v") - 37000).alias("phi")), KEYS, "phi")


@query(f"""WITH $VOX, n AS (SELECT * FROM {_BOX} WHERE dx + dy + dz = 1 AND abs(dx) + abs(dy) + abs(dz) = 1)
  SELECT p.x, p.y, p.z, CASE WHEN dx = 1 THEN 'x' WHEN dy = 1 THEN 'y' ELSE 'z' END AS axis, round((p.v - 37000) / (p.v - q.v), 6) AS fraction
  FROM vox p, n JOIN vox q {_AT} WHERE (p.v < 37000) <> (q.v < 37000)""")
def iso_crossings(spark, d):
    return levelset.iso_crossings(volume(spark, d), KEYS, "v", 37000.0)


@query()
def eikonal_distance(spark, d):
    return levelset.eikonal(volume(spark, d), KEYS, F.col("mask"))


@query(f"""WITH RECURSIVE $VOX, {_N6}, a AS (SELECT x, y, z FROM vox WHERE mask), b AS (SELECT x, y, z FROM vox WHERE seg = 1 AND tpl = 1),
  fa AS (SELECT x, y, z, 0 AS s FROM a UNION SELECT q.x, q.y, q.z, s + 1 FROM fa p, n JOIN vox q {_AT} WHERE s < 20),
  fb AS (SELECT x, y, z, 0 AS s FROM b UNION SELECT q.x, q.y, q.z, s + 1 FROM fb p, n JOIN vox q {_AT} WHERE s < 20),
  d AS (SELECT x, y, z, min(s) AS s FROM fa JOIN b USING (x, y, z) GROUP BY ALL UNION ALL SELECT x, y, z, min(s) FROM fb JOIN a USING (x, y, z) GROUP BY ALL)
  SELECT count(*) AS voxels, round(avg(s), 6) AS average, max(s)::DOUBLE AS hausdorff FROM d""")
def surface_distances(spark, d):
    v = volume(spark, d)
    return levelset.surface_distances(v.where("mask"), v.where("seg = 1 and tpl = 1"), v.select(*KEYS), KEYS)


@query(f"""WITH RECURSIVE $VOX, {_N6}, g AS (SELECT * FROM vox WHERE seg >= 2), r AS (SELECT x AS ox, y AS oy, z AS oz, x, y, z, 0 AS s FROM g
    UNION SELECT ox, oy, oz, q.x, q.y, q.z, s + 1 FROM r p, n JOIN g q {_AT} WHERE s < 2),
  f AS (SELECT ox, oy, oz, x, y, z, min(s) AS s FROM r GROUP BY ALL)
  SELECT ox AS x, oy AS y, oz AS z, round(sum(exp(-s * s / 2.0) * v) / sum(exp(-s * s / 2.0)), 6) AS smooth, count(*) AS n FROM f JOIN vox USING (x, y, z) GROUP BY 1, 2, 3""")
def geodesic_smoothing(spark, d):
    return levelset.geodesic_smoothed(volume(spark, d).where("seg >= 2"), KEYS, "v", 1.0, 2)


@query()
def random_walk_segmentation(spark, d):
    v = volume(spark, d).withColumn("seed", F.when(F.col("mask"), F.when(F.col("v") < 37000, 1).otherwise(2)).otherwise(0))
    return levelset.random_walk(v, KEYS, "v", "seed", 2, 2000.0, 5)


@query()
def total_variation(spark, d):
    return levelset.total_variation(volume(spark, d).select(*KEYS, (F.col("v") / 1000).alias("v")), KEYS, "v", 1.0, 5)


@query()
def thinned_mask(spark, d):
    v = volume(spark, d).where("seg >= 1").select(F.lit(1).alias("vol_id"), *KEYS, "v")
    return levelset.thinned(v, "vol_id", KEYS, "v")


@query()
def gradient_anisotropy(spark, d):
    t = stencil.tensor_products(volume(spark, d), KEYS, "v")
    mean = t.join(volume(spark, d).select(*KEYS, "seg"), KEYS).groupBy("seg").agg(*[F.avg(c).alias(c) for c in ("xx", "yy", "zz", "xy", "xz", "yz")])
    return levelset.fractional_anisotropy(mean, ["xx", "yy", "zz", "xy", "xz", "yz"]).select("seg", "first", "mean_diffusivity", "anisotropy")


@query()
def minimum_error_threshold(spark, d):
    h = {r.bin: r.n for r in statistics.histogram(volume(spark, d), "v", 64).collect()}  # 64 bins
    return spark.createDataFrame([(levelset.kittler_illingworth([h.get(i, 0) for i in range(64)]),)], "bin int")


@query("""WITH $VOX, f AS (SELECT x, y, z, CASE WHEN w > 28 THEN 4 + w / 100 WHEN v > 38000 THEN 2 + v / 100000 WHEN seg > 1 THEN seg / 10.0 ELSE 0 END AS stacked FROM vox)
  SELECT x, y, z, round(stacked, 6) AS stacked FROM f""")
def filter_stacking(spark, d):
    s = F.when(F.col("w") > 28, 4 + F.col("w") / 100).when(F.col("v") > 38000, 2 + F.col("v") / 100000).when(F.col("seg") > 1, F.col("seg") / 10).otherwise(0.0)
    return volume(spark, d).select(*KEYS, s.alias("stacked"))


@query("""WITH $VOX, g AS (SELECT x::INT AS x, y::INT AS y, z::INT AS z FROM range(-2, 18) a(x), range(-2, 18) b(y), range(-2, 10) c(z))
  SELECT x, y, z, round(coalesce(v, 0), 6) AS padded FROM g LEFT JOIN vox USING (x, y, z)""")
def image_border(spark, d):
    axis = lambda k, n: spark.range(-2, n + 2).select(F.col("id").cast("int").alias(k))
    grid = axis("x", GRID[0]).crossJoin(axis("y", GRID[1])).crossJoin(axis("z", GRID[2]))  # the grid itself
    return grid.join(volume(spark, d), KEYS, "left").select(*KEYS, F.coalesce("v", F.lit(0.0)).alias("padded"))


@query("""WITH $VOX SELECT x, y, z, round(v, 6) AS v FROM vox UNION ALL SELECT 31 + 4 - x, y, z, round(v, 6) FROM vox""")
def mirrored_pair(spark, d):
    v = volume(spark, d).select(*KEYS, "v")
    return v.unionByName(segmentation.mirrored(v, "x", 2 * GRID[0] + 4))


@query("""SELECT page_id, regexp_replace(url, '/?[^/]*$', '') AS folder, regexp_replace(regexp_extract(url, '[^/]*$'), '(\\.nii)?\\.[A-Za-z0-9]+$', '') AS base,
  regexp_extract(regexp_extract(url, '[^/]*$'), '((\\.nii)?\\.[A-Za-z0-9]+)$', 1) AS extension FROM pages""")
def names_from_paths(spark, d):
    return _table(spark, d, "pages").select("page_id", *tables.file_parts(F.col("url")))


@query("""WITH $VOX, m AS (SELECT z AS subject, x + 16 * y AS vid, v FROM vox)
  SELECT vid, count(*) AS subjects, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(sum(v * subject), 4) AS weighted FROM m GROUP BY 1""")
def vertex_group_statistics(spark, d):
    rows = volume(spark, d).select(F.col("z").alias("subject"), (F.col("x") + 16 * F.col("y")).alias("vid"), "v")
    return rows.groupBy("vid").agg(F.count("*").alias("subjects"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.round(F.sum(F.col("v") * F.col("subject")), 4).alias("weighted"))


@query(f"""WITH {_MESH}, u AS (SELECT unnest([v0, v1, v2]) AS vid, area / 3 AS area FROM ar), s AS (SELECT vid, sum(area) AS area FROM u GROUP BY 1)
  SELECT (vid % 3)::BIGINT AS label, count(*) AS vertices, round(sum(area), 6) AS area, round(sum(area * pz) / sum(area), 6) AS mean FROM ve JOIN s USING (vid) GROUP BY 1""")
def surface_regions(spark, d):
    vertices, faces = _mesh(spark, d)
    return surface.region_surface(faces, vertices.withColumn("label", (F.col("vid") % 3).cast("long")), "label", "pz")


@query("""WITH $VOX, m AS (SELECT seg, v, median(v) OVER (PARTITION BY seg) AS mid, quantile_cont(v, 0.75) OVER (PARTITION BY seg) - quantile_cont(v, 0.25) OVER (PARTITION BY seg) AS iqr, x, y, z FROM vox)
  SELECT x, y, z, round((v - mid) / iqr, 6) AS z_robust FROM m""")
def robust_zscores(spark, d):
    v = volume(spark, d)
    stats = v.groupBy("seg").agg(F.percentile("v", [0.25, 0.5, 0.75]).alias("q"))
    return v.join(stats, "seg").select(*KEYS, ((F.col("v") - F.col("q")[1]) / (F.col("q")[2] - F.col("q")[0])).alias("z_robust"))


@query("""WITH $VOX SELECT x, y, z, round(x * 0.5 - 4, 6) AS mx, round(y * 0.5 - 4, 6) AS my, round(z * 2.0 - 8, 6) AS mz FROM vox""")
def voxel_to_mm(spark, d):
    matrix = geometry.affine(np.diag([0.5, 0.5, 2.0]), (-4.0, -4.0, -8.0))
    return volume(spark, d).select(*KEYS, *[c.alias(a) for c, a in zip(geometry.moved(KEYS, matrix), ("mx", "my", "mz"), strict=True)])


@query(f"""WITH $VOX, {_N26}, e AS (SELECT p.x, p.y, p.z, exp(-(((p.v - q.v) / 3000) ** 2) / 2) AS a FROM vox p, n JOIN vox q {_AT})
  SELECT x, y, z, round(sum(a), 6) AS affinity, round(max(a), 6) AS strongest FROM e GROUP BY ALL""")
def neighbour_affinity(spark, d):
    pairs = stencil.stencil(volume(spark, d), KEYS, stencil.neighbours(26), ["v"], ["v"])
    a = clustering.affinity(F.col("v"), F.col("n_v"), 3000.0)
    return pairs.groupBy(*KEYS).agg(F.sum(a).alias("affinity"), F.max(a).alias("strongest"))


@query("""WITH $VOX, i AS (SELECT x, y, z, seg, v FROM vox), s AS (SELECT seg, avg(v) AS m, stddev_pop(v) AS s FROM i GROUP BY 1),
  p AS (SELECT x, y, z, s.seg AS label, exp(-(((v - m) / s) ** 2) / 2) / s AS p FROM i, s)
  SELECT x, y, z, label, round(p / sum(p) OVER (PARTITION BY x, y, z), 6) AS posterior FROM p""")
def label_posteriors(spark, d):
    v = volume(spark, d)
    stats = v.groupBy(F.col("seg").alias("label")).agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    rows = v.select(*KEYS, "v").crossJoin(F.broadcast(stats))  # one row per label
    p = F.exp(-F.pow((F.col("v") - F.col("m")) / F.col("s"), F.lit(2)) / 2) / F.col("s")
    rows = rows.select(*KEYS, "label", p.alias("p"))
    return rows.select(*KEYS, "label", (F.col("p") / F.sum("p").over(Window.partitionBy(*KEYS))).alias("posterior"))


@query("""WITH $VOX, e AS (SELECT x, y, z, v / 1000 AS inner_area, w AS outer_area FROM vox)
  SELECT x, y, z, round((-inner_area + sqrt(0.5 * outer_area ** 2 + 0.5 * inner_area ** 2)) / (outer_area - inner_area), 6) AS ratio FROM e""")
def equivolume_layers(spark, d):
    ratio = laminar.equivolume_ratio(F.lit(0.5), F.col("v") / 1000, F.col("w"))
    return volume(spark, d).select(*KEYS, ratio.alias("ratio"))


@query("""WITH e AS (SELECT DISTINCT o_custkey * 2 AS a, o_orderkey * 2 + 1 AS b FROM orders), n AS (SELECT a AS component, count(*) AS edges FROM e GROUP BY 1)
  SELECT component, edges + 1 AS nodes, edges, 0::BIGINT AS loops FROM n""")
def graph_loops(spark, d):
    edges = _table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("a"), (F.col("o_orderkey") * 2 + 1).alias("b")).distinct()
    parts = edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
    return clustering.loops(edges, "a", "b", parts)


@query("""WITH $VOX, i AS (SELECT z, y, x, v FROM vox WHERE z = 3) SELECT x, y, z, round(v, 6) AS v FROM i""")
def single_slice(spark, d):
    return segmentation.padded_slices(volume(spark, d).select(*KEYS, "v"), "z", 3)


@query("""WITH $VOX SELECT seg, (dense_rank() OVER (ORDER BY seg) - 1)::INT AS number FROM (SELECT DISTINCT seg FROM vox)""")
def label_numbers(spark, d):
    return segmentation.distinct_labels(volume(spark, d), "seg")


@query()
def half_normal_background(spark, d):
    return intensity.background_em(volume(spark, d), "v", "half-normal")


@query()
def shape_components(spark, d):
    p = profiles(spark, d)
    mean, variances, axes = shape.principal_components(p, "profile", 64, 3)
    return shape.projected(p, ["vec_id"], "profile", mean, axes)


@query()
def label_embedding(spark, d):
    v = volume(spark, d)
    touching = stencil.stencil(v, KEYS, stencil.neighbours(6), ["tpl"], ["seg"]).groupBy(F.col("seg").alias("a"), (F.col("n_tpl") + 10).alias("b")).agg(F.count("*").cast("double").alias("w"))
    rows = [(int(n), *map(float, c)) for n, c in shape.spectral_embedding(touching, "a", "b", "w", 2)]
    return spark.createDataFrame(rows, "region int, e0 double, e1 double")
