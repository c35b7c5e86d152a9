"""Queries on maps derived from labels, layers and series."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import derived, geometry, segmentation, surface
from .catalogue import _AT, _BOX, _MESH, _N6, _N26, _mesh, _table, query
from .fixtures import GRID, KEYS, volume

_DISTANCE = "sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2 + (p.z - q.z) ** 2)"
_MEMBERS = f"""ob AS (SELECT x, y, z, CASE WHEN x < 6 THEN 1 WHEN y < 5 AND z > 3 THEN 2 ELSE 0 END AS label, v FROM vox),
  lv AS (SELECT p.x, p.y, p.z, p.label, k.k, CASE WHEN p.label = k.k THEN 0.5 - min({_DISTANCE}) FILTER (WHERE q.label <> k.k) ELSE min({_DISTANCE}) FILTER (WHERE q.label = k.k) - 0.5 END AS d
    FROM ob p, ob q, (SELECT unnest([0, 1, 2]) AS k) k GROUP BY p.x, p.y, p.z, p.label, k.k),
  de AS (SELECT k, max(-d) AS depth FROM lv WHERE label = k GROUP BY 1),
  sh AS (SELECT x, y, z, k, least(greatest(0.5 - 0.5 * d / CASE WHEN k = 0 THEN 3.0 ELSE 0.8 * depth END, 0), 1) AS p FROM lv JOIN de USING (k)),
  me AS (SELECT x, y, z, k AS label, CASE WHEN k = 0 THEN least(p, greatest(1 - sum(CASE WHEN k <> 0 THEN p ELSE 0 END) OVER (PARTITION BY x, y, z), 0)) ELSE p END AS m FROM sh)"""


def _members(spark, d):
    label = F.when(F.col("x") < 6, 1).when((F.col("y") < 5) & (F.col("z") > 3), 2).otherwise(0)
    rows = volume(spark, d).select(*KEYS, label.alias("label"), "v")
    return rows, derived.distance_memberships(rows, KEYS, "label", [0, 1, 2], 0.8, 3.0)


@query(f"WITH $VOX, {_MEMBERS} SELECT x, y, z, label, round(m, 6) AS membership FROM me")
def distance_memberships(spark, d):
    return _members(spark, d)[1]


@query(f"""WITH $VOX, {_MEMBERS}, pr AS (SELECT x, y, z, label, m, CASE label WHEN 0 THEN 0.5 ELSE least(greatest((v - 30000) / 20000, 0), 1) END AS prior FROM me JOIN (SELECT x, y, z, v FROM ob) USING (x, y, z)),
  t AS (SELECT *, row_number() OVER (PARTITION BY x, y, z ORDER BY round(sqrt(m * prior), 9) DESC, label) AS r FROM pr)
  SELECT x, y, z, coalesce(max(round(sqrt(m * prior), 6)) FILTER (WHERE r <= 2 AND label = 1), 0) AS probability FROM t GROUP BY ALL""")
def extracted_probability(spark, d):
    rows, members = _members(spark, d)
    prior = F.when(F.col("label") == 0, 0.5).otherwise(F.least(F.greatest((F.col("v") - 30000) / 20000, F.lit(0.0)), F.lit(1.0)))
    merged = members.join(rows.select(*KEYS, "v"), KEYS).withColumn("p", F.round(derived.merged_membership(F.col("membership"), prior, "product"), 9))
    return derived.label_probability(segmentation.top_labels(merged, KEYS, "label", "p", 2), KEYS, "label", "p", 1)


#: Two rounds of half-voxel Gaussians or so.
_SIGMA = 0.7
_RIBBON = "li AS (SELECT x, y, z, v, x - 3.3 AS l0, x - 6.1 + y / 20.0 AS l1, x - 11.8 AS l2 FROM vox)"


def _layer_round(k, j):
    w = math.exp(-1 / (2 * _SIGMA * _SIGMA / 2))
    near = f"LEFT JOIN (SELECT p.x, p.y, p.z, " + ", ".join(f"sum(q.s{i} * g * q.u) AS v{i}, sum(q.s{i} * g) AS w{i}" for i in (0, 1)) + f" FROM y{j} p, (SELECT *, {w!r}::DOUBLE / sqrt(dx * dx + dy * dy + dz * dz) AS g FROM n) n JOIN y{j} q {_AT} GROUP BY ALL) t USING (x, y, z)"
    part = " + ".join(f"CASE WHEN s{i} > 0 THEN s{i} * (s{i} * u + coalesce(v{i}, 0)) / (s{i} + coalesce(w{i}, 0)) ELSE 0 END" for i in (0, 1))
    return f"y{k} AS (SELECT x, y, z, CASE WHEN s0 + s1 > 0 THEN ({part}) / (s0 + s1) ELSE u END AS u, s0, s1 FROM y{j} {near})"


_INSIDE = "least(greatest(0.5 - {c}, 0), 1)"


@query(f"""WITH $VOX, {_RIBBON}, {_N26}, y0 AS (SELECT x, y, z, v AS u, greatest({_INSIDE.format(c="l1")} - {_INSIDE.format(c="l0")}, 0) AS s0, greatest({_INSIDE.format(c="l2")} - {_INSIDE.format(c="l1")}, 0) AS s1
  FROM li WHERE l0 >= 0 AND l2 <= 0 AND x BETWEEN 2 AND 13 AND y BETWEEN 2 AND 13 AND z BETWEEN 2 AND 5), {_layer_round(1, 0)}, {_layer_round(2, 1)} SELECT x, y, z, round(u, 6) AS smooth FROM y2""")
def layer_smoothing(spark, d):
    rows = volume(spark, d).select(*KEYS, "v", (F.col("x") - 3.3).alias("l0"), (F.col("x") - 6.1 + F.col("y") / 20).alias("l1"), (F.col("x") - 11.8).alias("l2"))
    return derived.layer_smoothed(rows, KEYS, "v", ["l0", "l1", "l2"], _SIGMA, GRID)


def _brick(spark, d):
    place = [(F.col("vec_id") % 8).cast("int").alias("x"), F.floor(F.col("vec_id") / 8).cast("int").alias("_r")]
    rows = _table(spark, d, "embeddings").select(*place, F.transform("embedding", lambda e: e.cast("double")).alias("series"))
    return rows.select("x", (F.col("_r") % 8).alias("y"), F.floor(F.col("_r") / 8).cast("int").alias("z"), "series")


@query(f"""WITH e AS (SELECT vec_id % 8 AS x, (vec_id // 8) % 8 AS y, vec_id // 64 AS z, list_transform(embedding, lambda v: v::DOUBLE) AS s FROM embeddings),
  c AS (SELECT x, y, z, list_transform(s, lambda v: v - m) AS s FROM (SELECT *, list_sum(s) / len(s) AS m FROM e)),
  u AS (SELECT x, y, z, list_transform(s, lambda v: v / l) AS u FROM (SELECT *, sqrt(list_sum(list_transform(s, lambda v: v * v))) AS l FROM c)),
  n AS (SELECT * FROM {_BOX} WHERE dx > 0 OR (dx = 0 AND (dy > 0 OR (dy = 0 AND dz > 0)))),
  t AS (SELECT p.x, p.y, p.z, list_inner_product(q.u, r.u) AS e, list_inner_product(p.u, q.u) AS a, list_inner_product(p.u, r.u) AS b
    FROM u p, n JOIN u q {_AT} JOIN u r ON r.x = p.x - dx AND r.y = p.y - dy AND r.z = p.z - dz)
  SELECT x::BIGINT AS x, y::BIGINT AS y, z::BIGINT AS z, count(*) AS pairs, round(avg((e - a * b) / sqrt((1 - a * a) * (1 - b * b))), 6) AS mean, round(min((e - a * b) / sqrt((1 - a * a) * (1 - b * b))), 6) AS least FROM t GROUP BY ALL""")
def partial_correlations(spark, d):
    return derived.partial_correlations(_brick(spark, d), KEYS, "series")


@query()
def unwrapped_phase(spark, d):
    true = F.col("x") * 0.9 + F.col("y") * 0.7 - F.col("z") * 0.4 + F.col("v") / 100000
    wrapped = true - F.floor(true / derived.TURN + 0.5) * derived.TURN
    return derived.unwrapped(volume(spark, d).select(F.lit(1).alias("vol_id"), *KEYS, wrapped.alias("phase")), "vol_id", KEYS, "phase")


def _level(n, level):
    return f"""m{n} AS (SELECT x, y, z, x + 16 * y + 256 * z AS id, v FROM vox WHERE v >= {level}),
  e{n} AS MATERIALIZED (SELECT p.id AS i, q.id AS j FROM m{n} p, n JOIN m{n} q {_AT}),
  r{n} AS (SELECT id AS i, id AS j FROM m{n} UNION SELECT r.i, e.j FROM r{n} r JOIN e{n} e ON r.j = e.i), c{n} AS (SELECT i AS id, min(j) AS part FROM r{n} GROUP BY 1)"""


_LEVELS = [39500, 40500, 42000]
_TREE = ", ".join(_level(n, level) for n, level in enumerate(_LEVELS))
_PARTS = " UNION ALL ".join(
    f"SELECT {n} AS level, c{n}.part AS component, count(*) AS voxels, max(v) AS peak, " + (f"any_value(b.part) AS parent FROM c{n} JOIN m{n} USING (id) JOIN c{n - 1} b USING (id)" if n else f"NULL::BIGINT AS parent FROM c{n} JOIN m{n} USING (id)") + " GROUP BY 1, 2"
    for n in range(len(_LEVELS))
)


@query(f"WITH RECURSIVE $VOX, {_N6}, {_TREE} SELECT level, component::BIGINT AS component, voxels, round(peak, 6) AS peak, parent::BIGINT AS parent FROM ({_PARTS})")
def component_tree(spark, d):
    return derived.component_tree(volume(spark, d), KEYS, GRID, "v", _LEVELS)


@query("""WITH $VOX, r AS (SELECT x, y, z, CASE WHEN x BETWEEN 5 AND 9 AND y > 3 THEN 1 + seg % 3 ELSE 0 END AS label FROM vox), b AS (SELECT min(x) - 1 AS ax, max(x) + 1 AS bx, min(y) - 1 AS ay, max(y) + 1 AS by_, min(z) - 1 AS az, max(z) + 1 AS bz FROM r WHERE label IN (3, 1))
  SELECT (x - greatest(ax, 0))::INT AS x, (y - greatest(ay, 0))::INT AS y, (z - greatest(az, 0))::INT AS z, CASE label WHEN 3 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS part FROM r, b
  WHERE x BETWEEN ax AND bx AND y BETWEEN ay AND by_ AND z BETWEEN az AND bz""")
def extracted_region(spark, d):
    label = F.when(F.col("x").between(5, 9) & (F.col("y") > 3), 1 + F.col("seg") % 3).otherwise(0)
    return derived.extracted_region(volume(spark, d).select(*KEYS, label.alias("label")), KEYS, "label", [3, 1], GRID)


@query("WITH $VOX SELECT x, y, z, round((v - min(v) OVER ()) / max(v) OVER (), 6) AS normalised FROM vox")
def normalised_image(spark, d):
    v = volume(spark, d).select(*KEYS, "v")
    bounds = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return v.crossJoin(F.broadcast(bounds)).select(*KEYS, ((F.col("v") - F.col("lo")) / F.col("hi")).alias("normalised"))  # one row


@query("""WITH $VOX SELECT seg AS label, z AS t, count(*) AS vertices, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM vox GROUP BY 1, 2""")
def surface_time_series(spark, d):
    rows = volume(spark, d).select(F.col("seg").alias("label"), F.col("z").alias("t"), "v")
    return rows.groupBy("label", "t").agg(F.count("*").alias("vertices"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


@query(f"""WITH {_MESH} SELECT a.vid, round(a.px * 0.5 - 4, 6) AS mx, round(a.py * 0.5 - 4, 6) AS my, round(a.pz * 2.0 - 8, 6) AS mz, round(b.pz, 6) AS data FROM ve a LEFT JOIN ve b ON b.vid = a.vid + 1""")
def copied_mesh_data(spark, d):
    vertices, _ = _mesh(spark, d)
    other = vertices.select((F.col("vid") - 1).alias("vid"), F.col("pz").alias("data"))
    matrix = geometry.affine(np.diag([0.5, 0.5, 2.0]), (-4.0, -4.0, -8.0))
    moved = [c.alias(a) for c, a in zip(geometry.moved(["px", "py", "pz"], matrix), ("mx", "my", "mz"), strict=True)]
    return surface.copied(vertices, other, "data").select("vid", *moved, "data")


@query("""WITH $VOX SELECT x, y, z, round((x * 0.5 - 4 + 10) / 0.25, 6) AS tx, round((y * 0.5 - 4 + 5) / 0.5, 6) AS ty, round((z * 2.0 - 8 - 1) / -1.0, 6) AS tz FROM vox""")
def scanner_coordinates(spark, d):
    source = geometry.affine(np.diag([0.5, 0.5, 2.0]), (-4.0, -4.0, -8.0))
    target = geometry.affine(np.diag([0.25, 0.5, -1.0]), (-10.0, -5.0, 1.0))
    both = geometry.scanner_transform(source, target)
    return volume(spark, d).select(*KEYS, *[c.alias(a) for c, a in zip(geometry.moved(KEYS, both), ("tx", "ty", "tz"), strict=True)])
