"""Operators against closed forms and NumPy on small grids."""

import gzip
import itertools
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxlake.operators import fixpoint, geometry, laminar, overlap, segmentation, statistics, stencil, surface
from voxlake.sources import nifti, tables

KEYS = ["x", "y", "z"]


def grid(spark, places):
    return spark.createDataFrame([tuple(map(int, p)) for p in places], "x int, y int, z int")


def test_checkerboard_components(spark):
    board = [p for p in itertools.product(range(4), repeat=3) if sum(p) % 2 == 0]
    mask = grid(spark, board)
    assert fixpoint.components(mask, KEYS, (4, 4, 4), 6).select("component").distinct().count() == len(board)
    assert fixpoint.components(mask, KEYS, (4, 4, 4), 18).select("component").distinct().count() == 1


def test_hollow_cube_is_filled(spark):
    cube = list(itertools.product(range(1, 6), repeat=3))
    shell = [p for p in cube if any(k in (1, 5) for k in p)]
    full = grid(spark, itertools.product(range(7), repeat=3))
    assert fixpoint.filled(grid(spark, shell), full, KEYS, (7, 7, 7)).count() == len(cube)


def test_distance_from_one_voxel(spark):
    full = grid(spark, itertools.product(range(5), repeat=3))
    rows = fixpoint.chamfer_distance(full, KEYS, (F.col("x") + F.col("y") + F.col("z")) == 0, {1: 1.0}).collect()
    assert all(r.distance == r.x + r.y + r.z for r in rows)


def test_erosion_undoes_dilation_of_a_box(spark):
    box = grid(spark, itertools.product(range(3, 6), repeat=3))
    near = stencil.neighbours(26)
    assert stencil.closed(box, KEYS, near).count() == 27
    assert stencil.opened(box, KEYS, near).count() == 27
    assert stencil.eroded(box, KEYS, stencil.neighbours(6)).count() == 1


def test_gradient_of_a_ramp(spark):
    rows = grid(spark, itertools.product(range(4), repeat=3)).withColumn("v", 2.0 * F.col("x") - 3.0 * F.col("z"))
    got = stencil.gradient(rows, KEYS, "v").select("gx", "gy", "gz").distinct().collect()
    assert [tuple(r) for r in got] == [(2.0, 0.0, -3.0)]


def test_smoothing_keeps_a_constant(spark):
    rows = grid(spark, itertools.product(range(5), repeat=3)).withColumn("v", F.lit(7.5))
    values = [r.smooth for r in stencil.smoothed(rows, KEYS, "v", 1.2).collect()]
    assert np.allclose(values, 7.5)


def test_legacy_percentile_ends(spark):
    for values, p, want in (([1.0, 2.0, 3.0, 4.0], 50, 2.5), ([1.0, 2.0], 10, 1.0), ([1.0, 2.0], 90, 2.0), ([], 50, None)):
        df = spark.createDataFrame([(values,)], "a array<double>")
        assert df.select(statistics.legacy_percentile(F.sort_array("a"), p)).first()[0] == want


@pytest.mark.parametrize("keys", [(), ("seg",)])
def test_histogram_computes_its_values_once(spark, keys):
    def moved(batches):  # each computation gives other values, as sums of doubles may
        at = float(time.time_ns() // 1000)
        for b in batches:
            yield b.assign(v=b.v + at)

    rows = spark.range(1000, numPartitions=1).selectExpr("cast(id % 2 as int) as seg", "cast(id as double) as v").mapInPandas(moved, "seg int, v double")
    for seg in range(max(2 * len(keys), 1)):
        own = np.arange(seg, 1000, 2) if keys else np.arange(1000)
        at = np.minimum((own - own[0]) / (own[-1] - own[0]) * 10 // 1, 9).astype(int)
        got = statistics.histogram(rows, "v", 10, keys).where(f"seg = {seg}" if keys else "true")
        assert {r.bin: r.n for r in got.collect()} == dict(enumerate(np.bincount(at, minlength=10).tolist()))


def test_level_of_a_probability_that_crosses_no_half(spark):
    for p, side in ((0.9, -1.0), (0.2, 1.0)):
        rows = grid(spark, itertools.product(range(3), repeat=3)).withColumn("p", F.lit(p))
        assert overlap.level_of_probability(rows, KEYS, "p", uncrossed=None).count() == 0
        assert [r.phi for r in overlap.level_of_probability(rows, KEYS, "p").collect()] == [side] * 27


def test_level_of_a_probability_computes_it_once(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def noted(batches):
        with open(seen, "a") as f:
            f.write("once\n")
        yield from batches

    rows = grid(spark, itertools.product(range(4), repeat=3)).withColumn("p", F.col("x") / 4).coalesce(1).mapInPandas(noted, "x int, y int, z int, p double")
    got = {(r.x, r.y, r.z): r.phi for r in overlap.level_of_probability(rows, KEYS, "p").collect()}
    assert got == {(x, y, z): (1.0, 0.25, 0.0, -1.0)[x] for x, y, z in itertools.product(range(4), repeat=3)}
    assert open(seen).read() == "once\n"


def test_trilinear_of_a_linear_image_is_exact(spark):
    rows = grid(spark, itertools.product(range(6), repeat=3)).withColumn("v", F.col("x") + 10.0 * F.col("y") + 100.0 * F.col("z"))
    points = spark.createDataFrame([(1, 0.25, 1.5, 2.75), (2, 4.0, 3.0, 2.0)], "id int, a double, b double, c double")
    got = {r.id: r.sampled for r in geometry.trilinear(points, ["a", "b", "c"], rows, KEYS, "v", ["id"]).collect()}
    assert got == {1: pytest.approx(290.25), 2: pytest.approx(234.0)}


def test_affine_maps_compose_and_invert():
    a = geometry.affine(geometry.rotation(0.1, 0.2, 0.3), (1, 2, 3))
    assert np.allclose(geometry.composed(a, geometry.inverted(a)), np.eye(4))


def test_linear_model_matches_least_squares(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = 1.5 + x @ [2.0, -1.0]
    rows = spark.createDataFrame([(1, float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "g int, a double, b double, y double")
    got = laminar.linear_model(rows, ["g"], "y", ["a", "b"]).first()
    assert np.allclose([got.b_intercept, got.b_a, got.b_b], [1.5, 2.0, -1.0])


def test_flat_mesh_area_and_euler(spark):
    cells = spark.createDataFrame([(x, y, 0.0) for x in range(4) for y in range(4)], "x int, y int, h double")
    vertices, faces = surface.height_mesh(cells, "x", "y", "h", 4)
    assert surface.face_areas(faces, vertices).agg(F.sum("area")).first()[0] == pytest.approx(9.0)
    assert surface.euler(faces).first().euler == 1


def test_relabel_and_empty_overlap(spark):
    rows = spark.createDataFrame([(1, 5), (2, 6)], "id int, label int")
    table = spark.createDataFrame([(5, 50)], "old int, new int")
    assert {r.id: r.new for r in segmentation.relabelled(rows, "label", table).collect()} == {1: 50, 2: 0}
    assert statistics.overlap(spark.createDataFrame([], "seg int, tpl int")).count() == 0


def test_nifti_round_trip(spark, tmp_path):
    volume = np.arange(24, dtype="<f4").reshape(2, 3, 4)
    (tmp_path / "a.nii").write_bytes(nifti.encode(volume, (0.5, 1.0, 2.0)))
    (tmp_path / "b.nii.gz").write_bytes(gzip.compress(nifti.encode(volume.astype("<i2"))))
    heads = {r.vol_id[-5:]: r for r in nifti.read_volumes(spark, str(tmp_path)).collect()}
    assert heads["a.nii"].nx == 2 and heads["a.nii"].rz == 2.0 and len(heads) == 2
    rows = nifti.read_voxels(spark, str(tmp_path))
    assert rows.count() == 46
    assert all(volume[r.x, r.y, r.z] == r.v for r in rows.collect())
    back = nifti.encoded_volumes(rows.where(F.col("vol_id").endswith("a.nii")), (2, 3, 4)).first().content
    assert bytes(back)[352:] == nifti.encode(volume)[352:]


def test_statistics_merge_keeps_measures_together(spark):
    old = spark.createDataFrame([("dice", 1.0, 0), ("mean", 2.0, 1)], "measure string, value double, position int")
    new = spark.createDataFrame([("dice", 3.0, 0), ("std", 4.0, 1)], "measure string, value double, position int")
    rows = tables.merged_statistics(old, new).orderBy("position").collect()
    assert [(r.measure, r.value) for r in rows] == [("dice", 1.0), ("dice", 3.0), ("mean", 2.0), ("std", 4.0)]


def test_atlas_text(spark, tmp_path):
    (tmp_path / "atlas.txt").write_text("Structure Atlas File (edit at your own risks)\n\nStructures:\t2\nBackground\t1\tobj\nCortex\t10\tobj\n")
    rows = tables.read_structures(spark, str(tmp_path / "atlas.txt")).collect()
    assert {(r.name, r.label, r.kind) for r in rows} == {("Background", 1, "obj"), ("Cortex", 10, "obj")}
