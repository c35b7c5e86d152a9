"""Meshes, labels, atlas priors, orientations, contrasts, unwrapping and parts against round trips and plain loops."""

import math

import numpy as np
from pyspark.sql import functions as F

from voxlake.functions import scalars
from voxlake.operators import derived, fixpoint, geometry, intensity, overlap, statistics
from voxlake.sources import mesh, tables

KEYS = ["x", "y", "z"]


def test_meshes_round_trip(spark, tmp_path):
    points = np.random.default_rng(0).normal(size=(9, 3)).astype(np.float32).astype(float)
    faces = np.array([[0, 1, 2], [2, 3, 4], [6, 7, 8]])
    (tmp_path / "a.vtk").write_text(mesh.encode(points, faces, np.arange(9)))
    (tmp_path / "b.vtk").write_text(mesh.encode(points[:3], faces[:1]))
    vertices, polygons = mesh.read_meshes(spark, f"file://{tmp_path}")
    assert vertices.count() == 12 and polygons.count() == 4
    texts = {r.mesh_id.rsplit("/", 1)[1]: r.content for r in mesh.encoded_meshes(vertices, polygons).collect()}
    for name in ("a.vtk", "b.vtk"):
        first, again = mesh.parse((tmp_path / name).read_text()), mesh.parse(texts[name])
        assert np.allclose(first[0], again[0], rtol=1e-6) and np.array_equal(first[1], again[1])
        assert (first[2] is None and again[2] is None) or np.array_equal(first[2], again[2])


def test_vertex_labels_become_voxels(spark, tmp_path):
    (tmp_path / "l.label").write_text("#!ascii label\n2\n0 1.0 2.0 3.0 7.0\n2 1 2 3 5\n")
    labels = mesh.read_labels(spark, f"file://{tmp_path}/l.label")
    assert sorted(map(tuple, labels.collect())) == [(0, 1.0, 2.0, 3.0, 7.0), (2, 1.0, 2.0, 3.0, 5.0)]
    vertices = spark.createDataFrame([(0, 2.0, 3.0, 4.0), (1, 4.0, 3.0, 4.0), (2, 2.2, 3.0, 4.0), (3, 0.0, 1.0, 1.0)], "vid long, px double, py double, pz double")
    got = sorted(map(tuple, mesh.labelled_voxels(vertices, labels, (8, 8, 8), (1.0, 1.0, 1.0)).collect()))
    assert got == [(2, 4, 3, 5.0), (4, 4, 3, 0.0)]


def test_atlas_priors_are_read_and_replaced(spark, tmp_path):
    text = "Structures:\t2\nA\t0\tobj\nB\t1\tobj\nIntensity Prior:\tT1map\nA\t\t0.10\t0.20\t1.0\nLeft 2 B\t0.30\t0.40\t1.0\n \nIntensity Prior:\tMprage\n0.5\t0.6\t1\nB\t0.7\t0.8\t1\nend\n"
    new = tables.with_priors(text, "Mprage", {1: (0.25, 0.125)})
    (tmp_path / "atlas.txt").write_text(new)
    rows = sorted((r.contrast, r.position, r.name, r.median, r.spread, r.weight) for r in tables.read_priors(spark, f"file://{tmp_path}").collect())
    assert rows == [("Mprage", 0, "", 0.5, 0.6, 1.0), ("Mprage", 1, "B", 0.25, 0.12, 1.0), ("T1map", 0, "A", 0.1, 0.2, 1.0), ("T1map", 1, "Left 2 B", 0.3, 0.4, 1.0)]
    assert [a == b for a, b in zip(text.split("\n"), new.split("\n"), strict=True)].count(False) == 1


def test_orientations():
    assert geometry.axis_codes(np.eye(4)) == ("RAS", "AXIAL")
    turned = geometry.affine(np.array([[0.0, 0, -2], [0.5, 0, 0], [0, -1, 0]]), (0, 0, 0))
    assert geometry.axis_codes(turned) == ("AIL", "SAGITTAL")
    assert geometry.axis_codes(geometry.affine(geometry.rotation(0.3, -0.2, 0.4) @ np.diag([1, 2, 3]), (1, 2, 3)))[0] == "RAS"


def test_contrast_table_inverts_the_signal():
    table = intensity.bloch_table((0.84, 2.37), 5.5, (0.0062, 0.0062), (7.0, 6.0), 160, 0.96)
    assert np.all(np.diff(table) <= 1e-12) and table.min() >= 0.05 and table.max() <= 4.05
    assert 0.5 < table[len(table) // 2] < 3


def test_parts_of_long_paths_across_blocks(spark):
    """A spiral path of one voxel's width over many blocks, and labels that split it."""
    path = [(x, 0, 0) for x in range(200)] + [(199, y, 0) for y in range(1, 150)] + [(x, 149, 0) for x in range(198, 40, -1)]
    rows = spark.createDataFrame([(*p, 1 + (i > 300)) for i, p in enumerate(path)] + [(0, 40, 3, 1)], "x int, y int, z int, label int")
    whole = fixpoint.components(rows, KEYS, (200, 150, 4))
    assert sorted(r["count"] for r in whole.groupBy("component").count().collect()) == [1, len(path)]
    split = fixpoint.components(rows, KEYS, (200, 150, 4), 26, within="label")
    assert sorted((r.label, r["count"]) for r in split.groupBy("label", "component").count().collect()) == [(1, 1), (1, 301), (2, len(path) - 301)]


def test_distances_reach_any_length(spark):
    rows = spark.range(400).select(F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"))
    exact = overlap.euclidean(rows, KEYS, F.col("x") == 3, (0.5, 1.0, 1.0))
    assert all(abs(r.distance - abs(r.x - 3) * 0.5) < 1e-9 for r in exact.collect())
    assert overlap.euclidean(rows, KEYS, F.col("x") < 0).where("distance is not null").count() == 0
    assert overlap.euclidean(rows.limit(0), KEYS, F.col("x") == 3).count() == 0


def test_chamfer_goes_on_beyond_sixty_four_steps(spark):
    rows = spark.range(90).select(F.col("id").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(0).alias("z"))
    got = {r.x: r.distance for r in fixpoint.chamfer_distance(rows, KEYS, F.col("x") == 0, {1: 1.0}).collect()}
    assert got == {x: float(x) for x in range(90)}


def test_unwrapping_restores_a_ramp(spark):
    true = 0.9 * F.col("x") + 1.1 * F.col("y") - 0.4 * F.col("z")
    grid = spark.range(12 * 11 * 5).select((F.col("id") % 12).alias("x"), (F.floor(F.col("id") / 12) % 11).alias("y"), F.floor(F.col("id") / 132).alias("z"))
    rows = grid.select(F.lit("a").alias("vol"), *KEYS, scalars.phase_wrapped(true).alias("phase"), true.alias("true"))
    got = derived.unwrapped(rows, "vol", KEYS, "phase").join(rows.drop("phase"), ["vol", *KEYS])
    turns = {round((r.unwrapped - r.true) / (2 * math.pi), 6) for r in got.collect()}
    assert turns == {0.0}


def test_percentiles_of_ties_and_groups(spark):
    rows = spark.range(30000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 2 == 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    got = {r.g: (r.p25, r.p75) for r in statistics.ranked_percentiles(rows, ["g"], "v", [25, 75]).collect()}
    for g in range(3):
        values = np.sort([5.0 if i % 2 == 0 else float(i) for i in range(30000) if i % 3 == g])
        for p, found in zip((25, 75), got[g], strict=True):
            at = p / 100 * (len(values) + 1)
            low = int(at)
            assert found == values[low - 1] + (at - low) * (values[low] - values[low - 1])
