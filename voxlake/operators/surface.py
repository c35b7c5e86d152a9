"""Triangle meshes as vertex and face tables: areas, edges, smoothing and sampled statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import cut


def corners(faces: DataFrame, vertices: DataFrame, at: tuple[str, str, str] = ("px", "py", "pz")) -> DataFrame:
    """fid and the coordinates of its three corners as arrays p0, p1, p2; one join for all corners."""
    long = faces.select("fid", F.posexplode(F.array("v0", "v1", "v2")).alias("k", "vid"))
    placed = long.join(vertices.select("vid", F.array(*at).alias("p")), "vid")
    return placed.groupBy("fid").agg(*[F.max(F.when(F.col("k") == k, F.col("p"))).alias(f"p{k}") for k in range(3)], *[F.max(F.when(F.col("k") == k, F.col("vid"))).alias(f"v{k}") for k in range(3)])


def face_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    c = corners(faces, vertices)
    a = [F.col("p1")[i] - F.col("p0")[i] for i in range(3)]
    b = [F.col("p2")[i] - F.col("p0")[i] for i in range(3)]
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    return c.select("fid", "v0", "v1", "v2", (F.sqrt(cross[0] ** 2 + cross[1] ** 2 + cross[2] ** 2) / 2).alias("area"))


def vertex_areas(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """A third of each face's area to each of its corners."""
    areas = face_areas(faces, vertices)
    return areas.select(F.explode(F.array("v0", "v1", "v2")).alias("vid"), (F.col("area") / 3).alias("a")).groupBy("vid").agg(F.sum("a").alias("area"))


def edges(faces: DataFrame) -> DataFrame:
    """Directed edges vid -> nid, each once."""
    pairs = [F.struct(F.col(a).alias("vid"), F.col(b).alias("nid")) for a in ("v0", "v1", "v2") for b in ("v0", "v1", "v2") if a != b]
    return faces.select(F.explode(F.array(*pairs)).alias("e")).select("e.vid", "e.nid").distinct()


def euler(faces: DataFrame) -> DataFrame:
    """Vertices, edges, faces and Euler characteristic of a mesh."""
    links = edges(faces)
    return faces.agg(F.count("*").alias("faces")).crossJoin(links.agg((F.count("*") / 2).cast("long").alias("edges"), F.countDistinct("vid").alias("vertices"))).withColumn("euler", F.col("vertices") - F.col("edges") + F.col("faces"))


def smoothed(vertices: DataFrame, faces: DataFrame, value: str, rate: float, rounds: int) -> DataFrame:
    """Vertex data moved towards the mean of its neighbours, all vertices at once, `rounds` times."""
    links, state = edges(faces), vertices.select("vid", F.col(value).alias("smooth"))
    for _ in range(rounds):
        near = links.join(state.withColumnRenamed("vid", "nid"), "nid").groupBy("vid").agg(F.avg("smooth").alias("near"))
        state = state.join(near, "vid", "left").select("vid", (F.col("smooth") + rate * (F.coalesce("near", "smooth") - F.col("smooth"))).alias("smooth"))
        state = cut(state)
    return state


def region_surface(faces: DataFrame, vertices: DataFrame, label: str, value: str) -> DataFrame:
    """Area, and area-weighted mean of vertex data, per vertex label."""
    joined = vertices.join(vertex_areas(faces, vertices), "vid")
    return joined.groupBy(label).agg(F.count("*").alias("vertices"), F.sum("area").alias("area"), (F.sum(F.col("area") * F.col(value)) / F.sum("area")).alias("mean"))


def height_mesh(columns: DataFrame, x: str, y: str, height: str, nx: int) -> tuple[DataFrame, DataFrame]:
    """Vertices and faces of a height map on a grid of width nx: two triangles per full cell."""
    vid = F.col(x) + F.col(y) * nx
    vertices = columns.select(vid.alias("vid"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"), F.col(height).alias("pz"))
    here = vertices.select("vid").where(F.col("vid") % nx < nx - 1)
    for name, step in (("r", 1), ("u", nx), ("d", nx + 1)):
        here = here.join(vertices.select((F.col("vid") - step).alias("vid"), F.col("vid").alias(name)), "vid")
    low = here.select((F.col("vid") * 2).alias("fid"), F.col("vid").alias("v0"), F.col("r").alias("v1"), F.col("d").alias("v2"))
    high = here.select((F.col("vid") * 2 + 1).alias("fid"), F.col("vid").alias("v0"), F.col("d").alias("v1"), F.col("u").alias("v2"))
    return vertices, low.unionAll(high)


def copied(vertices: DataFrame, other: DataFrame, data: str) -> DataFrame:
    """vertices with the data of the matching vertices of another mesh; null where it has none."""
    return vertices.drop(data).join(other.select("vid", data), "vid", "left")
