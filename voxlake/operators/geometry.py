"""Coordinates: affine maps, sampling by nearest voxel or trilinear corners, and composed deformations."""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rotation(rx: float, ry: float, rz: float) -> np.ndarray:
    """Rotation matrix of angles about x, then y, then z."""
    cx, cy, cz = map(math.cos, (rx, ry, rz))
    sx, sy, sz = map(math.sin, (rx, ry, rz))
    about_x = np.array([[1, 0, 0], [0, cx, -sx], [0, sx, cx]])
    about_y = np.array([[cy, 0, sy], [0, 1, 0], [-sy, 0, cy]])
    about_z = np.array([[cz, -sz, 0], [sz, cz, 0], [0, 0, 1]])
    return about_z @ about_y @ about_x


def affine(matrix: np.ndarray, shift: tuple[float, float, float]) -> np.ndarray:
    out = np.eye(4)
    out[:3, :3], out[:3, 3] = matrix, shift
    return out


def composed(*maps: np.ndarray) -> np.ndarray:
    """One map that applies `maps` in the order given."""
    return reduce(lambda a, b: b @ a, maps)


def inverted(matrix: np.ndarray) -> np.ndarray:
    return np.linalg.inv(matrix)


def moved(keys: list[str], matrix: np.ndarray) -> list[Column]:
    """Coordinates under an affine map, as columns."""
    return [reduce(Column.__add__, [F.col(k) * F.lit(float(matrix[i, j])) for j, k in enumerate(keys)]) + F.lit(float(matrix[i, 3])) for i in range(3)]


def nearest(points: DataFrame, at: list[str], image: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Value of the voxel at the rounded coordinates; null outside the image."""
    rounded = points.withColumns({k: F.floor(F.col(a) + 0.5).cast("int") for k, a in zip(keys, at, strict=True)})
    return rounded.join(image.select(*keys, F.col(value).alias("sampled")), keys, "left")


def trilinear(points: DataFrame, at: list[str], image: DataFrame, keys: list[str], value: str, ids: list[str]) -> DataFrame:
    """Weighted sum over the eight corners around each point; absent corners count as 0.

    Corners are rows of one equi-join, so the image and the points are each shuffled once.
    """
    corners = [F.struct(*[F.lit(c).alias(k) for k, c in zip(keys, o, strict=True)]) for o in itertools.product((0, 1), repeat=len(keys))]
    rows = points.select(*ids, *at, F.explode(F.array(*corners)).alias("_c"))
    base = {k: F.floor(a) for k, a in zip(keys, at, strict=True)}
    share = [F.when(F.col(f"_c.{k}") == 1, F.col(a) - base[k]).otherwise(1 - (F.col(a) - base[k])) for k, a in zip(keys, at, strict=True)]
    placed = rows.select(*ids, *[(base[k] + F.col(f"_c.{k}")).cast("int").alias(k) for k in keys], reduce(Column.__mul__, share).alias("_w")).where("_w > 0")
    joined = placed.join(image.select(*keys, F.col(value).alias("_v")), keys, "left")
    return joined.groupBy(*ids).agg(F.sum(F.col("_w") * F.coalesce("_v", F.lit(0.0))).alias("sampled"))


def resampled(image: DataFrame, keys: list[str], value: str, matrix: np.ndarray, linear: bool = True) -> DataFrame:
    """The image on its own grid under an affine map from grid to source coordinates."""
    at = ["_mx", "_my", "_mz"]
    points = image.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[c.alias(a) for c, a in zip(moved(keys, matrix), at, strict=True)])
    ids = [f"o_{k}" for k in keys]
    found = trilinear(points, at, image, keys, value, ids) if linear else nearest(points, at, image, keys, value).select(*ids, "sampled")
    return found.select(*[F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)], "sampled")


def jacobian_volume(deformation: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Determinant of a coordinate map's forward differences, at voxels with all forward neighbours."""
    rows = deformation.select(*keys, *parts)
    out = rows
    for k in keys:
        ahead = rows.select(*[(F.col(q) - 1).alias(q) if q == k else F.col(q) for q in keys], *[F.col(p).alias(f"{p}_{k}") for p in parts])
        out = out.join(ahead, keys)
    d = [[F.col(f"{p}_{k}") - F.col(p) for k in keys] for p in parts]
    det = d[0][0] * (d[1][1] * d[2][2] - d[1][2] * d[2][1]) - d[0][1] * (d[1][0] * d[2][2] - d[1][2] * d[2][0]) + d[0][2] * (d[1][0] * d[2][1] - d[1][1] * d[2][0])
    return out.select(*keys, det.alias("jacobian"))


#: Kinds of deformation fields: shifts from the grid or places, in voxels or in mm.
FIELDS = ("deformation(voxels)", "deformation(mm)", "mapping(voxels)", "mapping(mm)", "none")


def mapping(field: DataFrame, keys: list[str], parts: list[str], kind: str, resolution: tuple[float, ...]) -> DataFrame:
    """A field of any kind as places in voxels, in columns `parts`; `none` maps every voxel to itself."""
    if kind not in FIELDS:
        raise ValueError(f"not a kind of field: {kind}")
    if kind == "none":
        return field.select(*keys, *[F.col(k).cast("double").alias(p) for k, p in zip(keys, parts, strict=True)])
    scaled = [F.col(p) / (r if kind.endswith("(mm)") else 1.0) for p, r in zip(parts, resolution, strict=True)]
    return field.select(*keys, *[(v + F.col(k) if kind.startswith("deformation") else v).alias(p) for v, k, p in zip(scaled, keys, parts, strict=True)])


def sampled_linear(points: DataFrame, at: list[str], image: DataFrame, keys: list[str], values: list[str], ids: list[str]) -> DataFrame:
    """Several values of an image at the points, weighted over the corners that are present; null where none is. One join
    serves all values."""
    corners = [F.struct(*[F.lit(c).alias(k) for k, c in zip(keys, o, strict=True)]) for o in itertools.product((0, 1), repeat=len(keys))]
    rows = points.select(*ids, *at, F.explode(F.array(*corners)).alias("_c"))
    base = {k: F.floor(a) for k, a in zip(keys, at, strict=True)}
    share = [F.when(F.col(f"_c.{k}") == 1, F.col(a) - base[k]).otherwise(1 - (F.col(a) - base[k])) for k, a in zip(keys, at, strict=True)]
    placed = rows.select(*ids, *[(base[k] + F.col(f"_c.{k}")).cast("int").alias(f"_{k}") for k in keys], reduce(Column.__mul__, share).alias("_w")).where("_w > 0")
    found = placed.join(image.select(*[F.col(k).alias(f"_{k}") for k in keys], *[F.col(v).alias(f"_v{i}") for i, v in enumerate(values)]), [f"_{k}" for k in keys], "left")
    weight = F.sum(F.when(F.col("_v0").isNotNull(), F.col("_w")))
    return found.groupBy(*ids).agg(*[(F.sum(F.col("_w") * F.col(f"_v{i}")) / weight).alias(v) for i, v in enumerate(values)])


def chained(first: DataFrame, second: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """One map that goes through `first` and then `second`, both of places in voxels; voxels that leave the second's grid
    are left out."""
    points = first.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[F.col(p).alias(f"at_{p}") for p in parts])
    ids = [f"o_{k}" for k in keys]
    found = sampled_linear(points, [f"at_{p}" for p in parts], second, keys, parts, ids).where(F.col(parts[0]).isNotNull())
    return found.select(*[F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)], *parts)


def deformed(image: DataFrame, map_: DataFrame, keys: list[str], parts: list[str], value: str, linear: bool = True) -> DataFrame:
    """The image under a map of places in voxels; 0 where nothing is sampled."""
    points = map_.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[F.col(p).alias(f"at_{p}") for p in parts])
    ids, at = [f"o_{k}" for k in keys], [f"at_{p}" for p in parts]
    if linear:
        found = trilinear(points, at, image, keys, value, ids)
    else:
        found = nearest(points, at, image, keys, value).select(*ids, F.coalesce("sampled", F.lit(0.0)).alias("sampled"))
    return found.select(*[F.col(i).alias(k) for i, k in zip(ids, keys, strict=True)], F.col("sampled").alias("deformed"))


def orientation(matrix: np.ndarray) -> list[tuple[int, int]]:
    """(world axis, direction 1 or -1) nearest to each voxel axis of an affine map, each world axis once: the strongest
    entries of the map's rotation decide first."""
    columns = matrix[:3, :3] / np.maximum(np.linalg.norm(matrix[:3, :3], axis=0), 1e-12)
    u, _, v = np.linalg.svd(columns)
    turn = u @ v
    out: list[tuple[int, int]] = [(0, 1)] * 3
    left = np.abs(turn)
    for _ in range(3):
        world, axis = np.unravel_index(np.argmax(left), left.shape)
        out[axis] = (int(world), 1 if turn[world, axis] >= 0 else -1)
        left[world, :], left[:, axis] = -1, -1
    return out


def axis_codes(matrix: np.ndarray) -> tuple[str, str]:
    """Letters towards which the voxel axes run (R or L, A or P, S or I), and the plane of the slices."""
    letters = "".join(("LR", "PA", "IS")[world][direction > 0] for world, direction in orientation(matrix))
    return letters, {"I": "AXIAL", "S": "AXIAL", "L": "SAGITTAL", "R": "SAGITTAL"}.get(letters[2], "CORONAL")


def scanner_transform(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Map from voxels of the source to voxels of the target through the scanner's space."""
    return np.linalg.inv(target) @ source
