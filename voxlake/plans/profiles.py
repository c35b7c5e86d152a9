"""Queries on profiles across layers in space."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import profiles
from .catalogue import query
from .fixtures import KEYS, volume
from .fixtures import profiles as vectors

_CUTS = [5.13, 6.29, 7.41, 8.87]
_SAMPLES = ", ".join(f"round(max(s) FILTER (WHERE i = {i}), 6) AS s{i}" for i in range(len(_CUTS)))
_CORNERS = "(SELECT unnest([0, 1]) AS cx) a, (SELECT unnest([0, 1]) AS cy) b"
#: On parallel planes the point of each layer lies straight across; only corners between the outer planes count.
_PLANES = f"""gr AS (SELECT x, y, z, coalesce(v, 40000.0) AS v FROM (SELECT (i % 16)::INT AS x, (i // 16 % 16)::INT AS y, (i // 256)::INT AS z FROM range(0, 2048) r(i)) LEFT JOIN vox USING (x, y, z)),
  pl AS (SELECT x, y, z, v, 0.8 * x + 0.6 * y AS h FROM gr WHERE x BETWEEN 2 AND 9 AND y BETWEEN 3 AND 9 AND z BETWEEN 2 AND 5),
  cu AS (SELECT unnest([0, 1, 2, 3]) AS i, unnest({_CUTS}::DOUBLE[]) AS c),
  inn AS (SELECT x, y, z, v, h FROM (SELECT x, y, z, v, 0.8 * x + 0.6 * y AS h FROM gr) WHERE h >= {_CUTS[0]} AND h <= {_CUTS[-1]}),
  pt AS (SELECT x, y, z, i, x - 0.8 * (h - c) AS px, y - 0.6 * (h - c) AS py FROM pl, cu WHERE h >= {_CUTS[0]} AND h <= {_CUTS[-1]}),
  wt AS (SELECT p.x, p.y, p.z, i, floor(px) + cx AS qx, floor(py) + cy AS qy, CASE cx WHEN 1 THEN px - floor(px) ELSE 1 - px + floor(px) END * CASE cy WHEN 1 THEN py - floor(py) ELSE 1 - py + floor(py) END AS w FROM pt p, {_CORNERS}),
  sa AS (SELECT t.x, t.y, t.z, i, sum(w * q.v) / sum(w) AS s FROM wt t JOIN inn q ON q.x = qx AND q.y = qy AND q.z = t.z GROUP BY t.x, t.y, t.z, i)"""


def _sampled(spark, d):
    h = 0.8 * F.col("x") + 0.6 * F.col("y")
    i = F.col("id")
    whole = spark.range(2048).select((i % 16).cast("int").alias("x"), (F.floor(i / 16) % 16).cast("int").alias("y"), F.floor(i / 256).cast("int").alias("z"))
    rows = whole.join(volume(spark, d), KEYS, "left").select(*KEYS, F.coalesce("v", F.lit(40000.0)).alias("v"), *[(h - c).alias(f"l{i}") for i, c in enumerate(_CUTS)])
    found = profiles.sampled(rows, KEYS, [f"l{i}" for i in range(len(_CUTS))], "v", 8)
    return found.where(F.col("x").between(2, 9) & F.col("y").between(3, 9) & F.col("z").between(2, 5))


@query(f"WITH $VOX, {_PLANES} SELECT x, y, z, {_SAMPLES}, round({_CUTS[-1] - _CUTS[0]!r}, 6) AS length FROM sa GROUP BY x, y, z")
def spatial_profiles(spark, d):
    return _sampled(spark, d).select(*KEYS, *[f"s{i}" for i in range(len(_CUTS))], "length")


@query(f"""WITH $VOX, {_PLANES} SELECT x, y, z, count(s)::INT AS n, round(avg(s), 6) AS mean, round(stddev_samp(s), 6) AS std, round(min(s), 6) AS least, round(max(s), 6) AS most, round(median(s), 6) AS median FROM sa GROUP BY x, y, z""")
def contrast_mapping(spark, d):
    return profiles.measured(_sampled(spark, d), KEYS, [f"s{i}" for i in range(len(_CUTS))])


_DEGREE, _DEPTHS = 4, 64
_BASIS = [np.cos(k * np.arccos(np.linspace(-1, 1, _DEPTHS))) for k in range(_DEGREE + 1)]
_FIT = np.linalg.solve(np.array(_BASIS) @ np.array(_BASIS).T, np.array(_BASIS))


def _list(values):
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


_CHEBYSHEV = f"""ch AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS p FROM embeddings), cf AS (SELECT vec_id, p, {", ".join(f"list_inner_product(p, {_list(r)}) AS c{k}" for k, r in enumerate(_FIT))} FROM ch),
  cs AS (SELECT *, {" + ".join(f"c{k} * b{k}" for k in range(_DEGREE + 1))} AS f, v FROM (SELECT * EXCLUDE (p), unnest(p) AS v, {", ".join(f"unnest({_list(b)}) AS b{k}" for k, b in enumerate(_BASIS))} FROM cf))"""


def _fits(spark, d):
    return profiles.chebyshev_fit(vectors(spark, d), ["vec_id"], "profile", _DEPTHS, _DEGREE)


@query(f"WITH {_CHEBYSHEV} SELECT vec_id, {', '.join(f'round(any_value(c{k}), 6) AS c{k}' for k in range(_DEGREE + 1))}, round(max(abs(f - v)), 6) AS residual FROM cs GROUP BY vec_id")
def chebyshev_profiles(spark, d):
    return _fits(spark, d)


@query(f"""WITH {_CHEBYSHEV}, lg AS (SELECT vec_id, unnest([{", ".join(f"c{k}" for k in range(_DEGREE + 1))}]) AS c, unnest([{", ".join(map(str, range(_DEGREE + 1)))}]) AS d FROM cf),
  en AS (SELECT d, min(c) AS lo, max(c) AS hi, count(*) AS n FROM lg GROUP BY 1), bn AS (SELECT d, least(floor((c - lo) / (hi - lo) * 20), 19) AS b, lo, hi, n, count(*) AS c FROM lg JOIN en USING (d) GROUP BY ALL),
  ru AS (SELECT *, sum(c) OVER (PARTITION BY d ORDER BY b) AS u FROM bn),
  qu AS (SELECT d, q, ((lo + b / 20 * (hi - lo)) * (u - q * n) + (lo + (b + 1) / 20 * (hi - lo)) * (q * n - u + c)) / c AS "at" FROM ru, (SELECT unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS q) WHERE u >= q * n AND u - c < q * n),
  qs AS (SELECT d, max("at") FILTER (WHERE q = 0.25) AS q1, max("at") FILTER (WHERE q = 0.5) AS q2, max("at") FILTER (WHERE q = 0.75) AS q3 FROM qu GROUP BY 1)
  SELECT vec_id, round(exp(-0.5 * sum(((c - q2) / (1.349 * (q3 - q1))) ** 2)), 6) AS weight FROM lg JOIN qs USING (d) GROUP BY 1""")
def profile_weights(spark, d):
    return profiles.profile_weights(_fits(spark, d), ["vec_id"], [f"c{k}" for k in range(_DEGREE + 1)], 20)
