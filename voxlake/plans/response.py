"""Queries on responses, masks, noise maps and quantities along level sets."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from ..operators import response
from .catalogue import _ALL, _AT, _BOX, _MESH, _N26, ORACLES, _mesh, query
from .derived import _brick
from .fixtures import GRID, KEYS, VOX, volume

_DENSITY = {"exponential": "exp(-u / m) / m", "half-normal": f"exp(-u * u / ({math.pi!r}::DOUBLE * m * m)) * 2 / ({math.pi!r}::DOUBLE * m)"}


def _em(model, rounds):
    p = _DENSITY[model]
    return f"""nv AS (SELECT x, y, z, w, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS u FROM vox),
  em(t, m, d) AS (SELECT 0, avg(u), 1.0::DOUBLE FROM nv UNION ALL SELECT t + 1, n, abs(n - m) / (0.5 * (n + m))
    FROM (SELECT t, m, sum(u * p) / sum(p) AS n FROM (SELECT t, m, u, {p} / (1 + {p}) AS p FROM em, nv WHERE t < {rounds} AND d > 1e-4) GROUP BY t, m)),
  fe AS (SELECT m, t FROM em ORDER BY t DESC LIMIT 1), fg AS (SELECT x, y, z, w, {p} / (1 + {p}) AS p FROM nv, fe)"""


_FOUND = " SELECT any_value(fe.m) AS background_mean, avg((p <= 0.5)::INT) AS foreground, any_value(fe.t) AS rounds FROM fg, fe"
for _name, _model in (("background_em", "exponential"), ("half_normal_background", "half-normal")):
    ORACLES[_name] = f"WITH RECURSIVE {VOX}, {_em(_model, 50)}" + _FOUND.replace("any_value(fe.m)", "round(any_value(fe.m), 6)").replace("avg((p <= 0.5)::INT)", "round(avg((p <= 0.5)::INT), 6)")


@query(f"WITH RECURSIVE $VOX, {_em('half-normal', 20)} SELECT x, y, z, round(1 - p, 6) AS proba, (p <= 0.5)::INT AS mask, round(w * (1 - p), 6) AS masked FROM fg")
def background_masked(spark, d):
    rows = volume(spark, d)
    found = response.foreground(rows, KEYS, "v")
    return found.join(response.masked(rows, found, KEYS, "w", "proba"), KEYS)


@query(f"""WITH RECURSIVE $VOX, {_em('exponential', 20)}, m AS (SELECT x, y, z FROM fg WHERE p <= 0.3 AND w > 28)
  SELECT x, y, z, round(CASE WHEN EXISTS (FROM m WHERE abs(m.x - fg.x) <= 2 AND abs(m.y - fg.y) <= 2 AND abs(m.z - fg.z) <= 2) THEN w ELSE 0 END, 6) AS masked FROM fg""")
def dilated_masked(spark, d):
    rows = volume(spark, d)
    found = response.foreground(rows, KEYS, "v", "exponential").join(rows.select(*KEYS, "w"), KEYS)
    strong = F.when((F.col("proba") >= 0.7) & (F.col("w") > 28), 1).otherwise(0)
    return response.masked(rows, found.select(*KEYS, strong.alias("mask")), KEYS, "w", "dilated")


_RESPONSE = "rs AS (SELECT x, y, z, greatest(v - 38000, 0) / 1000 AS u FROM vox), mx AS (SELECT max(u) AS mx FROM rs)"


def _responses(spark, d):
    return volume(spark, d).select(*KEYS, (F.greatest(F.col("v") - 38000, F.lit(0.0)) / 1000).alias("u"))


@query(f"""WITH RECURSIVE $VOX, {_RESPONSE}, it(t, s, d) AS (SELECT 0, avg(u), 1.0::DOUBLE FROM rs WHERE u > 0 UNION ALL SELECT t + 1, n, 2 * abs(n - s) / (n + s)
    FROM (SELECT t, s, sum(p * u) / sum(p) AS n FROM (SELECT t, s, u, 1 / (1 + mx * exp(-u / s) / s) AS p FROM it, rs, mx WHERE u > 0 AND t < 20 AND d >= 0.01) GROUP BY t, s))
  SELECT x, y, z, round(CASE WHEN u > 0 THEN 1 / (1 + mx * exp(-u / s) / s) ELSE 0 END, 6) AS response FROM rs, mx, (SELECT s FROM it ORDER BY t DESC LIMIT 1)""")
def exponential_response(spark, d):
    return response.normalized_response(_responses(spark, d), KEYS, "u", "exponential", "mean", True)


@query(f"""WITH $VOX, {_RESPONSE}, sg AS (SELECT median(u) / sqrt({response.MEDIAN_SQUARE!r}) AS s FROM rs WHERE u > 0)
  SELECT x, y, z, round(CASE WHEN u > 0 THEN 1 / (1 + mx * exp(-u * u / (2 * s * s)) * sqrt(2 / {math.pi!r}::DOUBLE) / s) ELSE 0 END, 6) AS response FROM rs, mx, sg""")
def gaussian_response(spark, d):
    return response.normalized_response(_responses(spark, d), KEYS, "u", "gaussian", "median")


def _refined(rounds, top):
    """Rounds of ten bins over wd(r, v, w) for targets tg(r, target); rf(r, value) is the last bin's middle."""
    bins = ", ".join(f"coalesce(sum(w) FILTER (WHERE k = {i}), 0)" for i in range(10))
    reached, inner = ("list_sum(b[i + 1:10])", "list_max") if top else ("list_sum(b[1:i + 1])", "list_min")
    before = "CASE WHEN k = 9 THEN 0 ELSE list_sum(b[k + 2:10]) END" if top else "CASE WHEN k = 0 THEN 0 ELSE list_sum(b[1:k]) END"
    return f"""rb(r, t, lo, hi, target, value) AS (SELECT r, 0, min(v), max(v), any_value(target)::DOUBLE, min(v) FROM wd JOIN tg USING (r) GROUP BY r
    UNION ALL SELECT r, t + 1, lo + k / 10 * (hi - lo), lo + (k + 1) / 10 * (hi - lo), target - {before}, lo + (k + 0.5::DOUBLE) / 10 * (hi - lo)
    FROM (SELECT *, coalesce({inner}(list_filter(range(0, 10), lambda i: {reached} >= target)), {0 if top else 9}) AS k
      FROM (SELECT r, t, lo, hi, target, [{bins}] AS b FROM (SELECT r, t, lo, hi, target, w, greatest(ceil((v - lo) / (hi - lo) * 10) - 1, 0) AS k FROM rb JOIN wd USING (r) WHERE t < {rounds} AND v >= lo AND v <= hi) GROUP BY ALL))),
  rf AS (SELECT r, arg_max(value, t) AS value FROM rb GROUP BY r)"""


def _edge(top):
    return f"(WITH RECURSIVE wd AS (SELECT 1 AS r, v, 1.0::DOUBLE AS w FROM vox), tg AS (SELECT 1 AS r, 0.05 * count(*) AS target FROM vox), {_refined(3, top)} SELECT round(value, 6) FROM rf)"


ORACLES["robust_range"] = f"WITH {VOX} SELECT {_edge(False)} AS robust_min, {_edge(True)} AS robust_max"


@query(f"""WITH RECURSIVE $VOX, wd AS (SELECT r, v, 1.0::DOUBLE AS w FROM vox, (SELECT unnest([1, 2]) AS r) WHERE v > 0), tg AS (SELECT unnest([1, 2]) AS r, unnest([0.2, 0.05]) * count(*) AS target FROM vox), {_refined(4, True)},
  io AS (SELECT any_value(value) FILTER (WHERE r = 1) AS i, any_value(value) FILTER (WHERE r = 2) AS o FROM rf), pr AS (SELECT x, y, z, v, i, o, exp(-pow(greatest(o - v, 0) / (o - i), 2)) AS p FROM vox, io)
  SELECT x, y, z, round(p, 6) AS proba, round(greatest(2 * p - 1, 0) * (2 * o - i) + (1 - greatest(2 * p - 1, 0)) * v, 6) AS filtered FROM pr""")
def flair_outliers(spark, d):
    return response.flair_outliers(volume(spark, d), KEYS, "v", 0.2, 0.05)


_ODDS = response.ONE_DEVIATION


@query(f"""WITH RECURSIVE $VOX, sh AS (SELECT *, CASE WHEN seg = 1 THEN (x + 1) / 17 ELSE 0 END AS a, CASE WHEN seg = 2 THEN (y + 1) / 17 ELSE 0 END AS b FROM vox),
  pc AS (SELECT unnest([0, 1, 2]) AS n, unnest([{50 - _ODDS!r}, 50, {50 + _ODDS!r}]::DOUBLE[]) AS pct),
  wd AS (SELECT n AS r, v, a AS w FROM sh, pc WHERE a > 0 UNION ALL SELECT 3 + n, v, b FROM sh, pc WHERE b > 0), tg AS (SELECT r, any_value(pct) / 100 * sum(w) AS target FROM wd JOIN pc ON n = r % 3 GROUP BY r), {_refined(5, False)},
  ft AS (SELECT max(value) FILTER (WHERE r = 1) AS am, (max(value) FILTER (WHERE r = 2) - max(value) FILTER (WHERE r = 0)) / 2 AS ad, max(value) FILTER (WHERE r = 4) AS bm, (max(value) FILTER (WHERE r = 5) - max(value) FILTER (WHERE r = 3)) / 2 AS bd FROM rf),
  de AS (SELECT x, y, z, exp(-0.5 * ((v - am) / ad) ** 2) / ad AS p, exp(-0.5 * ((v - bm) / bd) ** 2) / bd AS q FROM vox, ft)
  SELECT x, y, z, round(CASE WHEN p + q > 0 THEN p / (p + q) ELSE 0.5 END, 6) AS region, round(CASE WHEN p + q > 0 THEN q / (p + q) ELSE 0.5 END, 6) AS background FROM de""")
def region_contrast(spark, d):
    a = F.when(F.col("seg") == 1, (F.col("x") + 1) / 17).otherwise(0.0)
    b = F.when(F.col("seg") == 2, (F.col("y") + 1) / 17).otherwise(0.0)
    return response.contrast_probability(volume(spark, d).select(*KEYS, "v", a.alias("a"), b.alias("b")), KEYS, "v", "a", "b")


_PLANES = f"""bx AS (SELECT dx, dy, dz FROM {_BOX}), dr AS (SELECT * FROM bx WHERE dx > 0 OR (dx = 0 AND (dy > 0 OR (dy = 0 AND dz > 0)))),
  pl AS (SELECT d.dx AS ux, d.dy AS uy, d.dz AS uz, o.* FROM dr d, bx o WHERE CASE WHEN d.dx * d.dy * d.dz <> 0
    THEN (o.dx = 0 AND o.dy = 0 AND o.dz = 0) OR (o.dx * o.dy * o.dz <> 0 AND abs(o.dx * d.dx + o.dy * d.dy + o.dz * d.dz) < 3) ELSE o.dx * d.dx + o.dy * d.dy + o.dz * d.dz = 0 END),
  n AS (SELECT ux, uy, uz, dx, dy, dz, 2 AS c FROM pl UNION ALL SELECT ux, uy, uz, dx + ux, dy + uy, dz + uz, -1 FROM pl UNION ALL SELECT ux, uy, uz, dx - ux, dy - uy, dz - uz, -1 FROM pl),
  sc AS (SELECT p.x, p.y, p.z, 0.5 * sum(c * q.v) / sum(CASE WHEN c = 2 THEN 2 ELSE 0 END) AS s FROM vox p, n JOIN vox q {_AT} WHERE p.x BETWEEN 2 AND 13 AND p.y BETWEEN 2 AND 13 AND p.z BETWEEN 2 AND 5 GROUP BY p.x, p.y, p.z, ux, uy, uz),
  wh AS (SELECT p.x, p.y, p.z FROM vox p JOIN vox q ON abs(q.x - p.x) <= 2 AND abs(q.y - p.y) <= 2 AND abs(q.z - p.z) <= 2 GROUP BY ALL HAVING count(*) = 125),
  best AS (SELECT x, y, z, arg_max(s, abs(s)) AS s FROM sc JOIN wh USING (x, y, z) GROUP BY ALL)"""


@query(f"WITH $VOX, {_PLANES} SELECT x, y, z, round(s, 6) AS sheet FROM best")
def plane_scores(spark, d):
    return response.partial_volume(volume(spark, d), KEYS, "v")


@query(f"WITH $VOX, {_PLANES}, st AS (SELECT avg(s) AS m, var_samp(s) AS q FROM best) SELECT x, y, z, round(1 - exp(-0.5 * (greatest(s, 0) - m) ** 2 / q), 6) AS sheet FROM best, st")
def bright_sheets(spark, d):
    return response.partial_volume(volume(spark, d), KEYS, "v", "bright", True)


_UNIT = NormalDist().inv_cdf(0.75)
_NOISE = f"{_ALL}, ns AS (SELECT p.x, p.y, p.z, any_value(p.v) AS v, 0.5 * median(abs(p.v - q.v)) / {_UNIT!r}::DOUBLE AS noise, (count(*) < 27)::BIGINT AS boundary FROM vox p, n JOIN vox q {_AT} GROUP BY p.x, p.y, p.z)"


@query(f"WITH $VOX, {_NOISE} SELECT x, y, z, round(noise, 6) AS noise, boundary FROM ns")
def median_noise(spark, d):
    return response.median_noise(volume(spark, d), KEYS, "v")


@query(f"""WITH $VOX, {_NOISE}, bo AS (SELECT min(v) AS lo, max(v) AS hi, median(noise) AS everywhere FROM ns WHERE boundary = 0), pl AS (SELECT *, (v - lo) / (hi - lo) * 39 AS pos FROM ns, bo),
  md AS (SELECT floor(pos + 0.5)::INT AS bin, median(noise) AS m FROM pl WHERE boundary = 0 GROUP BY 1)
  SELECT x, y, z, round(CASE WHEN boundary = 1 THEN everywhere WHEN c > f AND a.m IS NOT NULL AND b.m IS NOT NULL THEN (1 - (pos - f)) * a.m + (pos - f) * b.m ELSE coalesce(a.m, b.m, everywhere) END, 6) AS noise
  FROM (SELECT *, greatest(floor(pos), 0)::INT AS f, least(ceil(pos), 39)::INT AS c FROM pl) LEFT JOIN md a ON a.bin = f LEFT JOIN md b ON b.bin = c""")
def noise_by_intensity(spark, d):
    rows = volume(spark, d)
    return response.noise_by_intensity(rows, response.median_noise(rows, KEYS, "v"), KEYS, "v", 40)


@query(f"""WITH e AS (SELECT vec_id % 8 AS x, (vec_id // 8) % 8 AS y, vec_id // 64 AS z, list_transform(embedding, lambda v: v::DOUBLE) AS s FROM embeddings),
  c AS (SELECT x, y, z, list_transform(s, lambda v: v - m) AS s FROM (SELECT *, list_sum(s) / len(s) AS m FROM e)),
  u AS (SELECT x, y, z, list_transform(s, lambda v: v / l) AS u FROM (SELECT *, sqrt(list_sum(list_transform(s, lambda v: v * v))) AS l FROM c)), {_N26},
  t AS (SELECT p.x, p.y, p.z, dx, dy, dz, sqrt(dx * dx + dy * dy + dz * dz) AS l, abs(list_inner_product(p.u, q.u) * (len(p.u) - 1) / len(p.u)) AS r FROM u p, n JOIN u q {_AT})
  SELECT x::INT AS x, y::INT AS y, z::INT AS z, {", ".join(f"round(sum(r * r * (d{a} / l) * (d{b} / l)) / 26, 9) AS {a}{b}" for a, b in ("xx", "xy", "xz", "yy", "yz", "zz"))} FROM t GROUP BY ALL HAVING count(*) = 26""", 9)
def correlation_tensors(spark, d):
    return response.correlation_tensors(_brick(spark, d), KEYS, "series", "absolute")


def _at(name, dx, dy, dz):
    return f"max(q.f) FILTER (WHERE dx = {dx} AND dy = {dy} AND dz = {dz}) AS {name}"


_STEPS = {"x": (1, 0, 0), "y": (0, 1, 0), "z": (0, 0, 1)}
_PICKS = ["max(q.f) FILTER (WHERE dx = 0 AND dy = 0 AND dz = 0) AS c"]
for _a, _s in _STEPS.items():
    _PICKS += [_at(f"{_a}p", *_s), _at(f"{_a}m", *[-v for v in _s])]
for _a, _b in ("xy", "yz", "xz"):
    for _i, _p in ((1, "p"), (-1, "m")):
        for _j, _q in ((1, "p"), (-1, "m")):
            _PICKS.append(_at(f"{_a}{_b}{_p}{_q}", *[_i * v + _j * w for v, w in zip(_STEPS[_a], _STEPS[_b], strict=True)]))
_GEOMETRY = f"""{_ALL}, di AS (SELECT x, y, z, sqrt((x - 7.3) ** 2 + (y - 8.1) ** 2 + (z - 3.4) ** 2) + v / 100000 AS r FROM vox),
  ly AS (SELECT x, y, z, k, r - CASE k WHEN 0 THEN 2.0 WHEN 1 THEN 3.5 ELSE 5.5 END AS f FROM di, (SELECT unnest([0, 1, 2]) AS k)),
  ne AS (SELECT x, y, z, arg_min(k, (abs(f), k)) AS k, max(f) - min(f) AS thickness FROM ly GROUP BY x, y, z HAVING max(f) FILTER (WHERE k = 0) >= -0.5 AND max(f) FILTER (WHERE k = 2) <= 0.5),
  pk AS (SELECT p.x, p.y, p.z, any_value(p.thickness) AS thickness, {", ".join(_PICKS)} FROM ne p, n JOIN ly q {_AT} AND q.k = p.k GROUP BY p.x, p.y, p.z HAVING count(*) = 27),
  dd AS (SELECT x, y, z, thickness, (xp - xm) / 2 AS gx, (yp - ym) / 2 AS gy, (zp - zm) / 2 AS gz, xp + xm - 2 * c AS hxx, yp + ym - 2 * c AS hyy, zp + zm - 2 * c AS hzz,
    (xypp + xymm - xypm - xymp) / 4 AS hxy, (yzpp + yzmm - yzpm - yzmp) / 4 AS hyz, (xzpp + xzmm - xzpm - xzmp) / 4 AS hxz FROM pk),
  cu AS (SELECT *, sqrt(gx * gx + gy * gy + gz * gz) AS l FROM dd),
  kk AS (SELECT *, ((hyy + hzz) * gx * gx + (hxx + hzz) * gy * gy + (hxx + hyy) * gz * gz - 2 * (gx * gy * hxy + gy * gz * hyz + gz * gx * hxz)) / (2 * l ** 3) AS k1,
    ((hyy * hzz - hyz * hyz) * gx * gx + (hzz * hxx - hxz * hxz) * gy * gy + (hxx * hyy - hxy * hxy) * gz * gz
     + 2 * (gx * gy * (hyz * hxz - hxy * hzz) + gz * gx * (hxy * hyz - hxz * hyy) + gy * gz * (hxy * hxz - hyz * hxx))) / l ** 4 AS k2 FROM cu)"""


@query(f"""WITH $VOX, {_GEOMETRY} SELECT x, y, z, round(thickness, 6) AS thickness, round(k1, 6) AS mean, round(k2, 6) AS gauss, round(2 / pi() * atan2(k1, sqrt(abs(k1 * k1 - k2))), 6) AS shape,
  round(sqrt(abs(2 * k1 * k1 - k2)), 6) AS curved, round(gx / l, 6) AS n0, round(gy / l, 6) AS n1, round(gz / l, 6) AS n2 FROM kk""")
def profile_geometry(spark, d):
    r = F.sqrt((F.col("x") - 7.3) ** 2 + (F.col("y") - 8.1) ** 2 + (F.col("z") - 3.4) ** 2) + F.col("v") / 100000
    rows = volume(spark, d).select(*KEYS, *[(r - c).alias(f"l{i}") for i, c in enumerate((2.0, 3.5, 5.5))])
    return response.profile_geometry(rows, KEYS, ["l0", "l1", "l2"], 0.5)


_LEVEL = "lv AS (SELECT x, y, z, x + 0.3 * sin(y) + v / 200000 - 6 AS p, w FROM vox)"


def _send(k, value):
    return f"""FROM (SELECT q.x, q.y, q.z, greatest(q.p - p.p, 0) AS g, p.r AS s FROM i{k} p, n JOIN i{k} q {_AT} WHERE p.done AND NOT q.done AND q.p > p.p
    AND p.x BETWEEN 1 AND 14 AND p.y BETWEEN 1 AND 14 AND p.z BETWEEN 1 AND 6) GROUP BY x, y, z"""


def _integral(k, how):
    got = "sum(g * s) / sum(g)" if how == "mean" else "arg_max(s, (g, s))"
    new = "w + t.got" if how == "mean" else "greatest(r, t.got)"
    return f"i{k + 1} AS (SELECT x, y, z, p, w, CASE WHEN t.got IS NOT NULL THEN {new} ELSE r END AS r, done OR t.got IS NOT NULL AS done FROM i{k} LEFT JOIN (SELECT x, y, z, {got} AS got {_send(k, how)}) t USING (x, y, z))"


def _integrals(how, first):
    return f"WITH $VOX, {_N26}, {_LEVEL}, i0 AS (SELECT x, y, z, p, w, {first} AS r, p < -2 AS done FROM lv), {', '.join(_integral(k, how) for k in range(3))} SELECT x, y, z, round(r, 6) AS result FROM i3"


def _levels(spark, d):
    return volume(spark, d).select(*KEYS, (F.col("x") + 0.3 * F.sin("y") + F.col("v") / 200000 - 6).alias("p"), "w")


@query(_integrals("mean", "0.0::DOUBLE"))
def integrated_mean(spark, d):
    return response.integrated(_levels(spark, d), KEYS, "p", "w", -2.0, 1.0, GRID)


@query(_integrals("max", "CASE WHEN p BETWEEN -2 AND 1 THEN w ELSE 0 END"))
def integrated_most(spark, d):
    return response.integrated(_levels(spark, d), KEYS, "p", "w", -2.0, 1.0, GRID, "max")


@query("""WITH $VOX, nm AS (SELECT x, y, z, v / 10000 AS a, 0.2 + w / 40 AS s, w / 8 AS b, 0.3 + v / 60000 AS t FROM vox),
  st AS (SELECT x, y, z, floor(abs(a - b) / greatest(s, t) / 0.05 + 0.5)::INT AS i, floor(least(s, t) / greatest(s, t) / 0.05 + 0.5)::INT AS j FROM nm),
  ij AS (SELECT x, y, z, CASE WHEN i < 60 AND j < 20 THEN i ELSE 59 END * 0.05::DOUBLE AS m, CASE WHEN i < 60 AND j < 20 THEN j ELSE 19 END * 0.05::DOUBLE AS e FROM st),
  en AS (SELECT *, least(-3, m - 3 * e) AS lo, greatest(3, m + 3 * e) AS hi FROM ij),
  de AS (SELECT x, y, z, hi - lo AS width, exp(-0.5 * u * u) / sqrt(2 * pi()) AS p, exp(-0.5 * ((u - m) / e) ** 2) / (e * sqrt(2 * pi())) AS q FROM (SELECT *, lo + k * 0.01::DOUBLE * (hi - lo) AS u FROM en, range(0, 101) r(k)))
  SELECT x, y, z, round(sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) * 0.01::DOUBLE * any_value(width) / 2, 6) AS divergence FROM de GROUP BY x, y, z""")
def jensen_shannon(spark, d):
    v, w = F.col("v"), F.col("w")
    rows = volume(spark, d).select(*KEYS, (v / 10000).alias("a"), (0.2 + w / 40).alias("s"), (w / 8).alias("b"), (0.3 + v / 60000).alias("t"))
    return response.jensen_shannon(rows, ("a", "s"), ("b", "t")).select(*KEYS, "divergence")


@query(f"WITH {_MESH} SELECT vid, round(px, 6) AS px, round(15 * 0.5 - py, 6) AS py, round(7 * 2.0 - pz, 6) AS pz FROM ve")
def space_converted(spark, d):
    return response.space_converted(_mesh(spark, d)[0], ("px", "py", "pz"), GRID, (0.5, 0.5, 2.0)).select("vid", "px", "py", "pz")
