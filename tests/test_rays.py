"""Rays that walk a grid of triangles, against every triangle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import rays

RAYS = "ray long, ox double, oy double, oz double, dx double, dy double, dz double, reach double"
CORNERS = "fid long, " + ", ".join(f"{k}{x} double" for k in "abc" for x in "xyz")


def brute(r, tri):
    o, d, reach = np.array(r[1:4]), np.array(r[4:7]), r[7]
    best = None
    for f in tri:
        a, b, c = (np.array(f[1 + 3 * i : 4 + 3 * i]) for i in range(3))
        e1, e2, s = b - a, c - a, o - a
        h, q = np.cross(d, e2), np.cross(s, e1)
        det = e1 @ h
        if abs(det) > 1e-12:
            u, w, t = s @ h / det, d @ q / det, e2 @ q / det
            if u >= 0 and w >= 0 and u + w <= 1 and 1e-9 < t < reach:
                best = min(best or (np.inf, 0), (t, f[0]))
    return best


def test_nearest_hits(spark, monkeypatch):
    monkeypatch.setattr(rays, "FIRST", 2)  # several rounds
    rng = np.random.default_rng(2)
    base = rng.uniform(-2, 2, (160, 1, 3))
    tri = base + rng.normal(0, 1, (160, 3, 3)) * np.where(np.arange(160) < 150, 0.15, 3.0)[:, None, None]  # small ones, and some that fill the grid
    tri = [(i, *map(float, t.ravel())) for i, t in enumerate(tri)] + [(500, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0), (400, 0.0, 0.0, 1.0, 1.0, 0.0, 1.0, 0.0, 1.0, 1.0)]
    many = [(i, *map(float, rng.uniform(-4, 4, 3)), *map(float, d / np.linalg.norm(d)), float(rng.choice([1.0, 3.0, 100.0]))) for i, d in enumerate(rng.normal(size=(120, 3)))]
    many += [(900 + i, *map(float, o), *d, 50.0) for i, (o, d) in enumerate(((0.2, 0.2, -9), d) for d in ((0.0, 0.0, 1.0), (0.0, 1.0, 0.0), (0.0, 0.0, -1.0)))]  # along an axis, past the mesh, away from it
    df = spark.createDataFrame([*many, (7777, None, 0.0, 0.0, 0.0, 0.0, 1.0, 1.0)], RAYS)
    got = {r.ray: (r.t, r.fid) for r in rays.nearest_hits(df, spark.createDataFrame(tri, CORNERS)).collect()}
    want = {r[0]: b for r in many if (b := brute(r, tri))}
    assert sorted(got) == sorted(want) and len(want) > 20
    assert all(abs(got[k][0] - want[k][0]) < 1e-9 and (got[k][1] == want[k][1] or abs(brute(many[k], [tri[got[k][1]]])[0] - want[k][0]) < 1e-12) for k in want)
    tied = rays.nearest_hits(spark.createDataFrame([(1, 0.2, 0.2, 0.9, 0.0, 0.0, 1.0, 1.0)], RAYS), spark.createDataFrame(tri[-2:], CORNERS)).first()
    assert (tied.fid, round(tied.t, 9)) == (400, 0.1)


def test_flat_and_empty_meshes(spark):
    flat = spark.createDataFrame([(i, float(i), 0.0, 0.0, i + 1.0, 0.0, 0.0, float(i), 1.0, 0.0) for i in range(30)], CORNERS)
    one = spark.createDataFrame([(i, i + 0.1, 0.1, 5.0, 0.0, 0.0, -1.0, 9.0) for i in range(31)], RAYS)
    assert {(r.ray, r.fid, r.t) for r in rays.nearest_hits(one, flat).collect()} == {(i, i, 5.0) for i in range(30)}
    assert rays.nearest_hits(one, flat.limit(0)).count() == 0 and rays.nearest_hits(one.limit(0), flat).count() == 0


def test_visibility_from_several_eyes(spark):
    v = spark.createDataFrame([(0, -1.0, -1.0, 1.0), (1, 1.0, -1.0, 1.0), (2, 0.0, 1.0, 1.0), (3, 0.0, 0.0, 2.0), (4, 0.0, None, 2.0)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 0, 1, 2)], "fid long, a long, b long, c long")
    eyes = spark.createDataFrame([("front", 0.0, 0.0, 0.0), ("back", 0.0, 0.0, 4.0)], "eye string, x double, y double, z double")
    got = {(r.eye, r.vid): r.visible for r in rays.visible_from(v, f, eyes).collect()}
    assert got == {**{(e, i): True for e in ("front", "back") for i in range(4)}, ("front", 3): False}
    monkey = eyes.crossJoin(spark.range(6000)).select(F.concat("eye", F.col("id").cast("string")).alias("eye"), "x", "y", "z")
    with pytest.raises(ValueError, match="eyes"):
        rays.visible_from(v, f, monkey)
