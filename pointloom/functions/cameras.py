"""Camera matrices, intrinsics and pose errors: small tables for the driver and column expressions for rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry as G


def focal(fov: float, pixels: float) -> float:
    return pixels / (2 * math.tan(fov / 2))


def field_of_view(focal_length: float, pixels: float) -> float:
    return 2 * math.atan(pixels / (2 * focal_length))


def world_to_view(rotation, translation, shift=(0.0, 0.0, 0.0), scale: float = 1.0) -> np.ndarray:
    """4 x 4 of a camera with camera-to-world ``rotation`` and world-to-camera ``translation``; its centre is moved by ``shift`` and then scaled."""
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = np.asarray(rotation, float).T, translation
    back = np.linalg.inv(m)
    back[:3, 3] = (back[:3, 3] + np.asarray(shift, float)) * scale
    return np.linalg.inv(back)


def perspective(near: float, far: float, fov_x: float, fov_y: float) -> np.ndarray:
    """4 x 4 to clip space: depth 0 at ``near`` and 1 at ``far``, w is the depth."""
    m = np.zeros((4, 4))
    m[0, 0], m[1, 1] = 1 / math.tan(fov_x / 2), 1 / math.tan(fov_y / 2)
    m[2, 2], m[2, 3], m[3, 2] = far / (far - near), -far * near / (far - near), 1.0
    return m


def apply(m: np.ndarray, p: Sequence[Column]) -> list[Column]:
    """The four homogeneous coordinates of a point under a 4 x 4 matrix of the driver."""
    return [G.total(*[float(row[j]) * p[j] for j in range(3)]) + float(row[3]) for row in m]


def align_axis(d: Sequence[Column]) -> list[Column]:
    """The 9 entries of the rotation that takes (0, 0, 1) to the direction of ``d``: by Rodrigues' formula about their common normal; the
    identity for the same direction, and a turn about x for the opposite one."""
    n = G.norm(d)
    x, y, z = (F.try_divide(c, n) for c in d)
    k = F.try_divide(F.lit(1.0), 1.0 + z)
    straight = [1.0 - x * x * k, -x * y * k, x, -x * y * k, 1.0 - y * y * k, y, -x, -y, z]
    same, opposite = (z > 1.0 - 1e-12), (z < -1.0 + 1e-12)
    one, turn = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 0.0, 0.0, -1.0, 0.0, 0.0, 0.0, -1.0)
    return [F.when(same, F.lit(a)).when(opposite, F.lit(b)).otherwise(s) for s, a, b in zip(straight, one, turn, strict=True)]


def scale_intrinsics(fx, fy, cx, cy, by_x: float, by_y: float):
    """Intrinsics of an image resized by (1 / by_x, 1 / by_y)."""
    return fx / by_x, fy / by_y, cx / by_x, cy / by_y


def rotate_intrinsics(fx, fy, cx, cy, width: int, height: int, quarter_turns: int):
    """Intrinsics of an image turned counter-clockwise by quarters."""
    turns = quarter_turns % 4
    return ((fx, fy, cx, cy), (fy, fx, cy, width - 1 - cx), (fx, fy, width - 1 - cx, height - 1 - cy), (fy, fx, height - 1 - cy, cx))[turns]


def rotate_pose(pose: np.ndarray, quarter_turns: int) -> np.ndarray:
    """A world-to-camera pose of the turned image."""
    a = -(quarter_turns % 4) * math.pi / 2
    turn = np.eye(4)
    turn[:2, :2] = [[round(math.cos(a)), -round(math.sin(a))], [round(math.sin(a)), round(math.cos(a))]]
    return turn @ pose


def angle(cosine: Column) -> Column:
    """Degrees of an angle; rounding errors beyond -1 and 1 are cut."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))


def rotation_error(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Degrees between two rotations of 9 entries."""
    return angle((G.dot(a, b) - 1.0) / 2.0)


def direction_error(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Degrees between two translations whose sign is open; null if one is zero."""
    e = angle(F.try_divide(G.dot(a, b), G.norm(a) * G.norm(b)))
    return F.least(e, 180.0 - e)


def epipolar_error(p0: Sequence[Column], p1: Sequence[Column], e: np.ndarray) -> Column:
    """Squared symmetric epipolar distance of matched normalised points (x, y) under an essential matrix."""
    a, b = [*p0, F.lit(1.0)], [*p1, F.lit(1.0)]
    ea = [G.total(*[float(e[i][j]) * a[j] for j in range(3)]) for i in range(3)]
    eb = [G.total(*[float(e[i][j]) * b[i] for i in range(3)]) for j in range(3)]
    d = G.dot(b, ea)
    return d * d * (F.try_divide(F.lit(1.0), ea[0] * ea[0] + ea[1] * ea[1]) + F.try_divide(F.lit(1.0), eb[0] * eb[0] + eb[1] * eb[1]))


def normal(scales: Sequence[Column], rotation: Sequence[Column], p: Sequence[Column], eye: Sequence[float]) -> list[Column]:
    """The axis of the smallest scale (the first on ties), turned to the viewer."""
    at = G.smallest_axis(F.array(*scales))
    axis = [F.when(at == 0, rotation[3 * i]).when(at == 1, rotation[3 * i + 1]).otherwise(rotation[3 * i + 2]) for i in range(3)]
    toward = G.total(*[axis[i] * (float(eye[i]) - p[i]) for i in range(3)])
    return [F.when(toward < 0, -a).otherwise(a) for a in axis]


def determinant(m: Sequence[Column]) -> Column:
    """Of a 3 x 3 matrix of 9 entries."""
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Sequence[Column]) -> list[Column]:
    """The 9 entries of the inverse; null if there is none."""
    minor = lambda a, b, c, d: m[a] * m[d] - m[b] * m[c]
    adjugate = (minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4))
    return [F.try_divide(a, determinant(m)) for a in adjugate]


def inverse_affine(m: Sequence[Column]) -> list[Column]:
    """The 12 entries, row by row, of the inverse of a 3 x 4 affine transform."""
    r = inverse([m[4 * i + j] for i in range(3) for j in range(3)])
    t = [-(r[3 * i] * m[3] + r[3 * i + 1] * m[7] + r[3 * i + 2] * m[11]) for i in range(3)]
    return [x for i in range(3) for x in (*r[3 * i : 3 * i + 3], t[i])]


def rank(m: Sequence[Column], tolerance: float = 1e-9) -> Column:
    """Of a 3 x 3 matrix: 3 with a determinant, 2 with a minor, 1 with an entry beyond ``tolerance`` (times a power of the largest entry)."""
    top = F.greatest(*[F.abs(x) for x in m])
    minors = [F.abs(m[3 * i + a] * m[3 * j + b] - m[3 * i + b] * m[3 * j + a]) for i in range(3) for j in range(i + 1, 3) for a in range(3) for b in range(a + 1, 3)]
    return F.when(F.abs(determinant(m)) > tolerance * top * top * top, 3).when(F.greatest(*minors) > tolerance * top * top, 2).when(top > 0, 1).otherwise(0)
