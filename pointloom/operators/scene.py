"""Meshes, cameras and paths: ray-cast visibility, scene bounds, views, camera paths, dense vertex matches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")


def visible_vertices(vertices: DataFrame, faces: DataFrame, eye: tuple[float, float, float], tolerance: float = 1e-4) -> DataFrame:
    """Vertices (vid, xyz) with ``visible``: no triangle (a, b, c) cuts the segment from the eye more than ``tolerance`` before the vertex (see ``rays``)."""
    from . import rays

    named = faces.select("a", "b", "c", F.monotonically_increasing_id().alias("fid"))
    eyes = vertices.sparkSession.createDataFrame([(0, *map(float, eye))], "eye int, x double, y double, z double")
    return rays.visible_from(vertices, named, eyes, tolerance).drop("eye")


def view_poses(spark, elevations: int, azimuths: int, radius: float) -> DataFrame:
    """Camera positions on a sphere and up directions: elevations x azimuths x 4, a fixed few rows."""
    rows = []
    for i in range(elevations):
        for j in range(azimuths):
            el, az = math.pi * (i + 0.5) / elevations - math.pi / 2, 2 * math.pi * j / azimuths
            for k, up in enumerate(((0, 0, 1), (0, 1, 0), (0, 0, -1), (0, -1, 0))):
                rows.append((i, j, k, radius * math.cos(el) * math.cos(az), radius * math.cos(el) * math.sin(az), radius * math.sin(el), *map(float, up)))
    return spark.createDataFrame(rows, "elevation int, azimuth int, up int, x double, y double, z double, ux double, uy double, uz double")


def camera_path(keys: pd.DataFrame, n: int) -> pd.DataFrame:
    """``n`` positions on a clamped B-spline of degree min(5, keyframes - 1) through the control points (x, y, z), at u in [0, 1)."""
    p = keys[list(XYZ)].to_numpy(float)
    m, deg = len(p), min(5, len(p) - 1)
    if m < 2:
        return pd.DataFrame(np.repeat(p, n, 0), columns=list(XYZ))
    knots = np.concatenate([np.zeros(deg), np.linspace(0, 1, m - deg + 1), np.ones(deg)])
    out = []
    for u in np.arange(n) / n:
        k = min(int(np.searchsorted(knots, u, "right")) - 1, m - 1)
        d = [p[j + k - deg].copy() for j in range(deg + 1)]
        for r in range(1, deg + 1):
            for j in range(deg, r - 1, -1):
                lo, hi = knots[j + k - deg], knots[j + 1 + k - r]
                a = (u - lo) / (hi - lo) if hi > lo else 0.0
                d[j] = (1 - a) * d[j - 1] + a * d[j]
        out.append(d[deg])
    return pd.DataFrame(out, columns=list(XYZ))


def same_vertices(original: DataFrame, reduced: DataFrame) -> DataFrame:
    """(vid, new_vid): each vertex and the one at the very same place in the reduced mesh."""
    r = reduced.select(F.col("vid").alias("new_vid"), *XYZ)
    return original.select("vid", *XYZ).join(r, list(XYZ)).groupBy("vid").agg(F.min("new_vid").alias("new_vid"))


def precedence(correspondences: list[DataFrame], key: str) -> DataFrame:
    """The union of tables with the same columns, the earliest table's row for each key; within a table the smallest row."""
    from pyspark.sql import Window

    rows = None
    for i, d in enumerate(correspondences):
        d = d.withColumn("__rank", F.lit(i))
        rows = d if rows is None else rows.unionByName(d)
    w = Window.partitionBy(key).orderBy("__rank", *[c for c in correspondences[0].columns if c != key])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__rank")


def quaternions(r: pd.Series) -> pd.Series:
    """w-first quaternion of a rotation (9 numbers) as the dominant eigenvector of a symmetric 4 x 4 matrix, with w >= 0."""
    m = np.stack([np.asarray(x, float).reshape(3, 3) for x in r]) if len(r) else np.zeros((0, 3, 3))
    k = np.zeros((len(m), 4, 4))
    k[:, 0, 0] = m[:, 0, 0] + m[:, 1, 1] + m[:, 2, 2]
    for i, (p, q) in enumerate(((2, 1), (0, 2), (1, 0)), 1):
        k[:, 0, i] = k[:, i, 0] = m[:, p, q] - m[:, q, p]
    for i in range(3):
        for j in range(3):
            k[:, i + 1, j + 1] = m[:, i, j] + m[:, j, i] - (k[:, 0, 0] if i == j else 0)
    q = np.linalg.eigh(k)[1][:, :, -1]
    return pd.Series(list(np.where(q[:, :1] < 0, -q, q)))


def dominant_quaternion(rotation: Column) -> Column:
    """``quaternions`` of a column."""
    return F.pandas_udf(quaternions, "array<double>")(rotation)
