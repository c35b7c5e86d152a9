"""Profiles in space against a plain version that follows one point at a time, and their edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import profiles, response

KEYS = ["x", "y", "z"]


def _plain_value(cube, p):
    low = [math.floor(c) for c in p]
    total = 0.0
    for c in np.ndindex(2, 2, 2):
        w = math.prod((p[i] - low[i]) if c[i] else 1 - (p[i] - low[i]) for i in range(3))
        if w:
            q = tuple(low[i] + c[i] for i in range(3))
            if any(a < 0 or a >= n for a, n in zip(q, cube.shape, strict=True)):
                return 0.0
            total += w * cube[q]
    return total


def _plain_slope(cube, p):
    d = []
    for i in range(3):
        ahead, behind = list(p), list(p)
        ahead[i] += 1
        behind[i] -= 1
        d.append((_plain_value(cube, ahead) - _plain_value(cube, behind)) / 2)
    return _plain_value(cube, p), d, math.sqrt(sum(v * v for v in d))


def _plain_point(cube, p):
    length, d, norm = _plain_slope(cube, p)
    if norm <= 0.01:
        return p
    p = [a - length * b / norm for a, b in zip(p, d, strict=True)]
    for _ in range(100):
        if _plain_value(cube, p) ** 2 <= 0.0001 or norm <= 0.01:
            break
        p = [a + 0.5 * length * b / norm for a, b in zip(p, d, strict=True)]
        length, d, norm = _plain_slope(cube, p)
        if norm > 0.01:
            p = [a - length * b / norm for a, b in zip(p, d, strict=True)]
    return p


def _plain_profile(layers, voxel):
    first = min(range(len(layers)), key=lambda i: (abs(layers[i][voxel]), i))
    points = {first: _plain_point(layers[first], [float(v) for v in voxel])}
    for i in range(first - 1, -1, -1):
        points[i] = _plain_point(layers[i], points[i + 1])
    for i in range(first + 1, len(layers)):
        points[i] = _plain_point(layers[i], points[i - 1])
    return [points[i] for i in range(len(layers))]


@pytest.fixture(scope="module")
def ball():
    """Level sets of bumpy balls in a cube of 40 voxels, so that profiles cross borders of blocks."""
    at = np.stack(np.meshgrid(*[np.arange(40.0)] * 3, indexing="ij"))
    r = np.sqrt(((at - np.array([19.3, 18.7, 20.1])[:, None, None, None]) ** 2).sum(axis=0)) + 0.3 * np.sin(at[0] / 3) * np.cos(at[1] / 4)
    return [r - c for c in (9.0, 10.2, 11.5, 12.3, 13.4, 14.6)], np.sin(at[0] / 2) + at[1] * 0.1 - np.cos(at[2])


@pytest.fixture(scope="module")
def rows(spark, ball):
    layers, image = ball
    place = np.indices(image.shape).reshape(3, -1)
    import pandas as pd

    table = pd.DataFrame({k: place[i].astype("int32") for i, k in enumerate(KEYS)} | {f"l{i}": layer.ravel() for i, layer in enumerate(layers)} | {"v": image.ravel()})
    return spark.createDataFrame(table)


def test_profiles_are_those_of_the_plain_version(spark, ball, rows):
    layers, image = ball
    names = [f"l{i}" for i in range(len(layers))]
    found = {(r.x, r.y, r.z): r for r in profiles.sampled(rows, KEYS, names, "v", 9).toLocalIterator()}
    inside = (layers[0] >= 0) & (layers[-1] <= 0)
    assert set(found) == set(map(tuple, np.argwhere(inside).tolist()))
    for voxel in sorted(found)[::97]:
        points = _plain_profile(layers, voxel)
        steps = np.diff(np.array(points), axis=0)
        assert found[voxel].length == pytest.approx(np.sqrt((steps**2).sum(axis=1)).sum(), abs=1e-9)
        for i, p in enumerate(points):
            total = weight = 0.0
            for c in np.ndindex(2, 2, 2):
                q = tuple(math.floor(p[k]) + c[k] for k in range(3))
                w = math.prod((p[k] - math.floor(p[k])) if c[k] else 1 - (p[k] - math.floor(p[k])) for k in range(3))
                if inside[q]:
                    total, weight = total + w * image[q], weight + w
            got = found[voxel][f"s{i}"]
            assert got is None if weight == 0 else got == pytest.approx(total / weight, abs=1e-6)
        n = len(points)
        p = np.array(points)
        bend = turn = 0.0
        for i in range(1, n - 1):
            a, b = (p[i + 1] - p[i - 1]) / 2, p[i + 1] - 2 * p[i] + p[i - 1]
            bend += np.linalg.norm(np.cross(a, b)) / np.linalg.norm(a) ** 3
            if 2 <= i < n - 2:
                c = (p[i + 2] - 2 * p[i + 1] + 2 * p[i - 1] - p[i - 2]) / 2
                turn += c @ np.cross(a, b) / ((a @ a) * (b @ b))
        assert found[voxel].curvature == pytest.approx(bend / (n - 3), abs=1e-9)
        assert found[voxel].torsion == pytest.approx(turn / (n - 3), rel=1e-6, abs=1e-6)


def test_profiles_that_leave_the_reach_are_refused(rows):
    with pytest.raises(Exception, match="longer than the reach"):
        profiles.sampled(rows, KEYS, ["l0", "l5"], "v", 3).count()


def test_no_voxels(rows):
    empty = rows.where("x < 0")
    assert profiles.sampled(empty, KEYS, ["l0", "l5"], "v", 9).count() == 0
    assert response.plane_scores(empty, KEYS, "v").count() == 0
    assert response.foreground(empty, KEYS, "v").count() == 0
    assert response.normalized_response(empty, KEYS, "v").count() == 0
    assert response.flair_outliers(empty, KEYS, "v", 0.2, 0.1).count() == 0


def test_flat_images(spark, rows):
    flat = rows.withColumn("v", F.lit(2.0))
    assert response.foreground(flat, KEYS, "v").count() == 0
    assert response.plane_scores(flat, KEYS, "v").count() == 0
    assert response.median_noise(flat, KEYS, "v").agg(F.max("noise")).first()[0] == 0


def test_plane_scores_find_a_sheet(spark, rows):
    sheet = rows.select(*KEYS, F.when(F.col("x") + F.col("y") == 30, 1.0).otherwise(0.0).alias("v"))
    best = response.plane_scores(sheet, KEYS, "v").where("score > 0.49").where((F.col("x") + F.col("y")) != 30)
    assert best.count() == 0
    assert response.plane_scores(sheet, KEYS, "v").where("score > 0.49").count() > 0


def test_divergence_is_nothing_between_like_normals():
    table = response.jensen_shannon_table(3.0, 0.05, 0.01)
    assert table.shape == (60, 20)
    assert table[0, 19] < 0.002 < table[20, 19] < table[59, 19] <= math.log(2) + 1e-3
