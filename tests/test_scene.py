import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pointloom.operators import scene


def test_visibility(spark):
    v = spark.createDataFrame([(0, -1.0, -1.0, 1.0), (1, 1.0, -1.0, 1.0), (2, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 2.0), (4, 5.0, 5.0, 2.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 1, 2)], "a long, b long, c long")
    got = {r.vid: r.visible for r in scene.visible_vertices(v, f, (0.0, 0.0, 0.0)).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False, 4: True}


def test_poses_and_path(spark):
    assert scene.view_poses(spark, 6, 8, 2.0).count() == 192
    two = scene.camera_path(pd.DataFrame({"x": [0.0, 1.0], "y": [0.0, 2.0], "z": [0.0, 0.0]}), 4)
    assert np.allclose(two["x"], [0, 0.25, 0.5, 0.75]) and np.allclose(two["y"], [0, 0.5, 1, 1.5])
    many = scene.camera_path(pd.DataFrame(np.random.default_rng(0).normal(0, 1, (9, 3)), columns=list("xyz")), 50)
    assert len(many) == 50 and np.isfinite(many.to_numpy()).all()


def test_vertices_and_precedence(spark):
    a = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0)], "vid long, x double, y double, z double")
    assert {(r.vid, r.new_vid) for r in scene.same_vertices(a, a.where("vid < 2")).collect()} == {(0, 0), (1, 1), (2, 0)}
    one, two = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 10)], [(1, 5), (2, 7), (2, 6)]))
    assert {tuple(r) for r in scene.precedence([one, two], "k").collect()} == {(1, 10), (2, 6)}


def test_dominant_quaternion(spark):
    q = np.random.default_rng(0).normal(0, 1, (10, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    rows = []
    for w, x, y, z in q:
        rows.append(([float(i) for i in (1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), 2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), 2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y))], [float(i) for i in (w, x, y, z)]))
    got = spark.createDataFrame(rows, "r array<double>, q array<double>").select("q", scene.dominant_quaternion(F.col("r")).alias("g")).collect()
    for r in got:
        assert abs(abs(np.dot(r.q, r.g)) - 1) < 1e-9 and r.g[0] >= 0
