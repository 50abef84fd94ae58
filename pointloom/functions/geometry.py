"""Projections, rotations, splat covariances and colours as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def total(*terms: Column) -> Column:
    return reduce(lambda a, b: a + b, terms)


def deproject(u: Column, v: Column, depth: Column, fx, fy, cx, cy) -> Vec:
    """Camera-frame point of a pixel: u is its column, v its row."""
    return (u - cx) * depth / fx, (v - cy) * depth / fy, depth


def deproject_general(u: Column, v: Column, depth: Column, inverse: list[list[float]]) -> Vec:
    """As ``deproject`` with any inverse intrinsic matrix."""
    h = (u * depth, v * depth, depth)
    return tuple(total(*[F.lit(m) * c for m, c in zip(row, h, strict=True)]) for row in inverse)


def transform(p: Vec, m: list[Column]) -> Vec:
    """Affine transform by the 12 columns of a 3 x 4 matrix, row by row."""
    return tuple(m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3))


def inverse_rigid(p: Vec, m: list[Column]) -> Vec:
    """Inverse of a rigid transform (rotation transposed)."""
    d = tuple(p[i] - m[4 * i + 3] for i in range(3))
    return tuple(m[j] * d[0] + m[4 + j] * d[1] + m[8 + j] * d[2] for j in range(3))


def project(p: Vec, fx, fy, cx, cy) -> tuple[Column, Column]:
    """Pinhole pixel (u, v), rounded half to even; null at depth 0."""
    return F.bround(F.try_divide(fx * p[0], p[2]) + cx).cast("long"), F.bround(F.try_divide(fy * p[1], p[2]) + cy).cast("long")


def pixel_lookup(u: Column, v: Column, depth: Column, f: float, cx: float, cy: float) -> Vec:
    """Point of a rendered depth pixel, with x and y turned; keep those with depth > 0."""
    return -(u - cx) * depth / f, -(v - cy) * depth / f, depth


def ray(u: Column, v: Column, fx, fy, cx, cy) -> Vec:
    """Unit direction through a pixel's centre."""
    x, y = (u + 0.5 - cx) / fx, (v + 0.5 - cy) / fy
    n = F.sqrt(x * x + y * y + 1.0)
    return x / n, y / n, F.lit(1.0) / n


def norm(p) -> Column:
    return F.sqrt(total(*[c * c for c in p]))


def dot(a, b) -> Column:
    return total(*[x * y for x, y in zip(a, b, strict=True)])


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def line_distance(p: Vec, direction: Vec) -> Column:
    """Distance of a point from a line through the origin."""
    return F.try_divide(norm(cross(p, direction)), norm(direction))


def normalise(array: Column) -> Column:
    """An array made a unit vector; null for the zero vector."""
    n = F.sqrt(F.aggregate(array, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(array, lambda x: F.try_divide(x, n))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (F.lit(1.0) - p))


def quaternion_matrix(q, unit: bool = True) -> list[Column]:
    """The 9 entries of a w-first quaternion's rotation; ``unit`` scales it first."""
    if unit:
        n = norm(q)
        q = [c / n for c in q]
    w, x, y, z = q
    return [1.0 - 2.0 * (y * y + z * z), 2.0 * (x * y - w * z), 2.0 * (x * z + w * y), 2.0 * (x * y + w * z), 1.0 - 2.0 * (x * x + z * z), 2.0 * (y * z - w * x), 2.0 * (x * z - w * y), 2.0 * (y * z + w * x), 1.0 - 2.0 * (x * x + y * y)]


def matrix_quaternion(r: list[Column]) -> list[Column]:
    """w-first quaternion of a rotation: by the trace if it is positive, else by the largest diagonal entry."""
    t = r[0] + r[4] + r[8]
    branches = []
    s = F.sqrt(F.greatest(t + 1.0, F.lit(1e-300))) * 2.0
    branches.append([s / 4.0, (r[7] - r[5]) / s, (r[2] - r[6]) / s, (r[3] - r[1]) / s])
    s = F.sqrt(F.greatest(1.0 + r[0] - r[4] - r[8], F.lit(1e-300))) * 2.0
    branches.append([(r[7] - r[5]) / s, s / 4.0, (r[1] + r[3]) / s, (r[2] + r[6]) / s])
    s = F.sqrt(F.greatest(1.0 + r[4] - r[0] - r[8], F.lit(1e-300))) * 2.0
    branches.append([(r[2] - r[6]) / s, (r[1] + r[3]) / s, s / 4.0, (r[5] + r[7]) / s])
    s = F.sqrt(F.greatest(1.0 + r[8] - r[0] - r[4], F.lit(1e-300))) * 2.0
    branches.append([(r[3] - r[1]) / s, (r[2] + r[6]) / s, (r[5] + r[7]) / s, s / 4.0])
    return [F.when(t > 0, a).when((r[0] > r[4]) & (r[0] > r[8]), b).when(r[4] > r[8], c).otherwise(d) for a, b, c, d in zip(*branches, strict=True)]


def quaternion_product(a, b, positive: bool = False) -> list[Column]:
    """Product of w-first quaternions; ``positive`` turns the sign so that w >= 0."""
    out = [
        a[0] * b[0] - a[1] * b[1] - a[2] * b[2] - a[3] * b[3],
        a[0] * b[1] + a[1] * b[0] + a[2] * b[3] - a[3] * b[2],
        a[0] * b[2] - a[1] * b[3] + a[2] * b[0] + a[3] * b[1],
        a[0] * b[3] + a[1] * b[2] - a[2] * b[1] + a[3] * b[0],
    ]
    return [F.when(out[0] < 0, -c).otherwise(c) for c in out] if positive else out


def covariance(scale, rotation: list[Column]) -> list[Column]:
    """Entries xx, xy, xz, yy, yz, zz of R S S^T R^T."""
    r, s2 = rotation, [s * s for s in scale]
    return [total(*[r[3 * i + k] * r[3 * j + k] * s2[k] for k in range(3)]) for i, j in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]


def screen_covariance(p: Vec, cov: list[Column], fx, fy, tan_x: float, tan_y: float) -> tuple[Column, Column, Column]:
    """Entries of the 2 x 2 covariance on screen of a view-space point, its x and y clamped to 1.3 of the field of view; 0.3 is added to
    the diagonal."""
    z = p[2]
    x = F.greatest(F.lit(-1.3 * tan_x), F.least(F.lit(1.3 * tan_x), p[0] / z)) * z
    y = F.greatest(F.lit(-1.3 * tan_y), F.least(F.lit(1.3 * tan_y), p[1] / z)) * z
    a, b, c, d = fx / z, -fx * x / (z * z), fy / z, -fy * y / (z * z)
    xx, xy, xz, yy, yz, zz = cov
    return a * a * xx + 2.0 * a * b * xz + b * b * zz + 0.3, a * c * xy + a * d * xz + b * c * yz + b * d * zz, c * c * yy + 2.0 * c * d * yz + d * d * zz + 0.3


def screen_radius(a: Column, b: Column, c: Column) -> Column:
    """Three standard deviations of the longer axis, rounded up."""
    mid, det = (a + c) * 0.5, a * c - b * b
    root = F.sqrt(F.greatest(F.lit(0.1), mid * mid - det))
    return F.ceil(3.0 * F.sqrt(F.greatest(mid + root, mid - root)))


#: Constants of the real spherical harmonics of degrees 0 to 3, fixed values.
SH0 = 0.28209479177387814
SH1 = 0.4886025119029199
SH2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)


def sh_basis(x: Column, y: Column, z: Column, degree: int = 3) -> list[Column]:
    """The basis at a unit direction."""
    out = [F.lit(SH0)]
    if degree > 0:
        out += [-SH1 * y, SH1 * z, -SH1 * x]
    if degree > 1:
        out += [SH2[0] * x * y, SH2[1] * y * z, SH2[2] * (2.0 * z * z - x * x - y * y), SH2[3] * x * z, SH2[4] * (x * x - y * y)]
    if degree > 2:
        out += [SH3[0] * y * (3.0 * x * x - y * y), SH3[1] * x * y * z, SH3[2] * y * (4.0 * z * z - x * x - y * y), SH3[3] * z * (2.0 * z * z - 3.0 * x * x - 3.0 * y * y), SH3[4] * x * (4.0 * z * z - x * x - y * y), SH3[5] * z * (x * x - y * y), SH3[6] * x * (x * x - 3.0 * y * y)]
    return out


def sh_colour(basis: list[Column], coefficients: list[Column]) -> Column:
    return F.greatest(F.lit(0.0), total(*[b * c for b, c in zip(basis, coefficients, strict=True)]) + 0.5)


def smallest_axis(scales: Column) -> Column:
    """0-based place of the smallest scale, the first on ties."""
    return F.array_position(scales, F.array_min(scales)) - 1


def shadow(p: Vec, light: tuple[float, float, float]) -> tuple[Column, Column]:
    """Projection of a point on z = 0 from a light."""
    t = F.try_divide(F.lit(light[2]), F.lit(light[2]) - p[2])
    return light[0] + t * (p[0] - light[0]), light[1] + t * (p[1] - light[1])


def over(alpha: Column, front: Column, back: Column) -> Column:
    return alpha * front + (F.lit(1.0) - alpha) * back


def unit_range(x: Column, low: float, high: float) -> Column:
    if not low < high:
        raise ValueError("low must be under high")
    return (x - low) / (high - low)


def from_unit_range(x: Column, low: float, high: float) -> Column:
    if not low < high:
        raise ValueError("low must be under high")
    return x * (high - low) + low


def rate(step: Column, first: float, last: float, delay_steps: int, delay_mult: float, most: int) -> Column:
    """Log-linear schedule with a sine warm-up; 0 before step 0 or if both ends are 0."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), step / float(most)))
    base = F.exp(F.lit(first).cast("double") * 0 + (1.0 - t) * F.log(F.lit(first)) + t * F.log(F.lit(last)))
    slow = F.lit(1.0)
    if delay_steps > 0:
        w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), step / float(delay_steps)))
        slow = delay_mult + (1 - delay_mult) * F.sin(0.5 * 3.141592653589793 * w)
    return F.when((step < 0) | F.lit(first == 0.0 and last == 0.0), 0.0).otherwise(slow * base)


def morton(x: Column, y: Column, z: Column) -> Column:
    """Z-order code of three numbers of 10 bits."""
    out = F.lit(0).cast("long")
    for axis, c in enumerate((x, y, z)):
        for bit in range(10):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(c.cast("long"), bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + axis))
    return out
