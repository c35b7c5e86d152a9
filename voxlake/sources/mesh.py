"""Meshes as tables of vertices and faces: legacy VTK polygon texts, and label texts of vertices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Points, triangles and the values of the points, if any, of a legacy ASCII polygon text."""
    words = text.split()
    upper = [w.upper() for w in words]

    def numbers(at: int, n: int, kind: type) -> np.ndarray:
        found = np.array(words[at : at + n], kind)
        if len(found) != n:
            raise ValueError("the mesh is cut off")
        return found

    if "POINTS" not in upper:
        raise ValueError("no points")
    at = upper.index("POINTS")
    n = int(words[at + 1])
    points, faces, data = numbers(at + 3, 3 * n, float).reshape(n, 3), np.zeros((0, 3), int), None
    if "POLYGONS" in upper:
        at = upper.index("POLYGONS")
        m, size = int(words[at + 1]), int(words[at + 2])
        if size != 4 * m:
            raise ValueError("only triangles are supported")
        faces = numbers(at + 3, size, int).reshape(m, 4)
        if np.any(faces[:, 0] != 3):
            raise ValueError("only triangles are supported")
        faces = faces[:, 1:]
    if "POINT_DATA" in upper and "LOOKUP_TABLE" in upper:
        at = upper.index("LOOKUP_TABLE")
        total = len(words) - at - 2
        data = numbers(at + 2, total - total % n if n else 0, float).reshape(n, -1)
    return points, faces, data


def encode(points: np.ndarray, faces: np.ndarray, data: np.ndarray | None = None, name: str = "mesh") -> str:
    """A legacy ASCII polygon text."""
    lines = ["# vtk DataFile Version 3.0", name, "ASCII", "DATASET POLYDATA", f"POINTS {len(points)} float"]
    lines += [" ".join(f"{v:.9g}" for v in p) for p in points]
    lines += [f"POLYGONS {len(faces)} {4 * len(faces)}", *("3 " + " ".join(map(str, f)) for f in faces)]
    if data is not None:
        data = np.asarray(data, float).reshape(len(points), -1)
        lines += [f"POINT_DATA {len(points)}", f"SCALARS values float {data.shape[1]}", "LOOKUP_TABLE default", *(" ".join(f"{v:.9g}" for v in row) for row in data)]
    return "\n".join(lines) + "\n"


def read_meshes(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertices(mesh_id, vid, px, py, pz, data) and faces(mesh_id, fid, v0, v1, v2) of all *.vtk below path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.vtk").load(path).select("path", "content")

    def vertices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                points, _, data = parse(content.decode())
                rows = [None] * len(points) if data is None else data.tolist()
                cols = [pa.array([name] * len(points)), pa.array(np.arange(len(points))), *(pa.array(points[:, i]) for i in range(3)), pa.array(rows, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["mesh_id", "vid", "px", "py", "pz", "data"])

    def faces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = parse(content.decode())[1].astype(np.int64)
                cols = [pa.array([name] * len(found)), pa.array(np.arange(len(found))), *(pa.array(np.ascontiguousarray(found[:, i])) for i in range(3))]
                yield pa.RecordBatch.from_arrays(cols, ["mesh_id", "fid", "v0", "v1", "v2"])

    return files.mapInArrow(vertices, "mesh_id string, vid long, px double, py double, pz double, data array<double>"), files.mapInArrow(faces, "mesh_id string, fid long, v0 long, v1 long, v2 long")


def encoded_meshes(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """mesh_id and content: the text of each mesh, one mesh a task; vertices are numbered from 0."""

    def build(key: tuple, points: pa.Table, polygons: pa.Table) -> pa.Table:
        order = np.argsort(points["vid"].to_numpy())
        place = np.stack([points[c].to_numpy()[order] for c in ("px", "py", "pz")], 1) if len(order) else np.zeros((0, 3))
        data = points["data"].to_pylist() if "data" in points.column_names else [None]
        values = None if not data or any(d is None for d in data) else np.array([data[i] for i in order])
        by = np.argsort(polygons["fid"].to_numpy())
        shape = np.stack([polygons[c].to_numpy()[by] for c in ("v0", "v1", "v2")], 1) if len(by) else np.zeros((0, 3), int)
        return pa.table({"mesh_id": [key[0].as_py()], "content": [encode(place, shape, values)]})

    return vertices.groupBy("mesh_id").cogroup(faces.groupBy("mesh_id")).applyInArrow(build, "mesh_id string, content string")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """vid, px, py, pz, value of label texts: lines of five numbers after a comment and a count."""
    part = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where("not startswith(value, '#')").select(part.alias("p")).where(F.size("p") == 5)
    return lines.select(F.col("p")[0].cast("long").alias("vid"), *[F.col("p")[i].cast("double").alias(n) for i, n in enumerate(("px", "py", "pz", "value"), 1)])


def labelled_voxels(vertices: DataFrame, labels: DataFrame, size: tuple[int, int, int], resolution: tuple[float, float, float]) -> DataFrame:
    """x, y, z, label of the voxels that hold vertices, in a volume whose second and third axis run against the mesh's;
    vertices without a label count as 0, of several the last vertex's counts. The volume's rim holds none."""
    joined = vertices.join(labels.select("vid", F.col("value").alias("_l")), "vid", "left")
    near = lambda c: F.floor(c + 0.5).cast("int")
    place = [near(F.col("px") / resolution[0]), near(size[1] - 1 - F.col("py") / resolution[1]), near(size[2] - 1 - F.col("pz") / resolution[2])]
    rows = joined.select("vid", *[p.alias(k) for p, k in zip(place, "xyz", strict=True)], F.coalesce("_l", F.lit(0.0)).alias("label"))
    for k, n in zip("xyz", size, strict=True):
        rows = rows.where((F.col(k) > 0) & (F.col(k) < n - 1))
    return rows.groupBy("x", "y", "z").agg(F.max_by("label", "vid").alias("label"))
