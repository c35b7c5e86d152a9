"""Level-set and shape operators against closed forms, and windows on a stream."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from voxlake.operators import fixpoint, levelset, shape
from voxlake.streaming import windows

KEYS = ["x", "y", "z"]


def grid(spark, places):
    return spark.createDataFrame([tuple(map(int, p)) for p in places], "x int, y int, z int")


def test_distances_reach_the_end_of_a_long_line(spark):
    rows = fixpoint.chamfer_distance(grid(spark, [(x, 0, 0) for x in range(68)]), KEYS, F.col("x") == 0, {1: 1.0}).collect()
    assert sorted((r.x, r.distance) for r in rows) == [(x, float(x)) for x in range(68)]


def test_eikonal_from_a_plane_is_exact(spark):
    rows = levelset.eikonal(grid(spark, itertools.product(range(5), range(4), range(4))), KEYS, F.col("x") == 0).collect()
    assert all(abs(r.distance - r.x) < 1e-9 for r in rows)


def test_crossings_of_a_ramp(spark):
    rows = levelset.iso_crossings(grid(spark, itertools.product(range(4), range(2), range(2))).withColumn("v", F.col("x") * 1.0), KEYS, "v", 1.25).collect()
    assert {(r.x, r.axis, r.fraction) for r in rows} == {(1, "x", 0.25)} and len(rows) == 4


def test_simple_points():
    cube = np.zeros((3, 3, 3), bool)
    cube[1, 1, 0] = cube[1, 1, 1] = True
    assert levelset.simple_point(cube)
    cube[1, 1, 2] = True
    assert not levelset.simple_point(cube)  # the middle of a line
    assert not levelset.simple_point(np.ones((3, 3, 3), bool))  # inside a solid


def test_thinning_keeps_one_part(spark):
    box = grid(spark, itertools.product(range(7), range(3), range(3))).select(F.lit(1).alias("vol_id"), *KEYS, F.lit(1.0).alias("d"))
    rows = levelset.thinned(box, "vol_id", KEYS, "d").collect()
    assert 1 <= len(rows) < 30


def test_two_class_threshold():
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(15, 3, 4000), rng.normal(45, 4, 4000)])
    counts = np.histogram(values, 64, (0, 64))[0]
    assert 22 <= levelset.kittler_illingworth(counts.tolist()) <= 36


def test_components_of_a_line(spark):
    t = np.linspace(-1, 1, 50)
    rows = spark.createDataFrame([(i, [float(3 * v), float(4 * v), 0.0]) for i, v in enumerate(t)], "id int, p array<double>")
    mean, values, axes = shape.principal_components(rows, "p", 3, 2)
    assert np.allclose(axes[0], [0.6, 0.8, 0]) and values[1] < 1e-12
    got = {r.id: r.c0 for r in shape.projected(rows, ["id"], "p", mean, axes).collect()}
    assert np.allclose([got[i] for i in range(50)], 5 * t)


def test_tumbling_windows_on_a_stream(spark, data, tmp_path):
    source = spark.read.parquet(f"{data}/events.parquet")
    source.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    out = windows.tumbling(stream, "ts", "1 day", ["event_type"], "value", late="60 days")
    run = out.writeStream.outputMode("complete").format("memory").queryName("tumbled").option("checkpointLocation", str(tmp_path / "state")).start()
    run.processAllAvailable()
    run.stop()
    columns = [F.col("begins").cast("string").alias("begins"), "event_type", "n"]
    want = windows.tumbling(source, "ts", "1 day", ["event_type"], "value").select(*columns)
    assert sorted(spark.table("tumbled").select(*columns).collect()) == sorted(want.collect())
