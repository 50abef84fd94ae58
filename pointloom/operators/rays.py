"""Rays through a mesh by tables: triangles are dealt to the cells of a grid by their extent, rays walk from cell to cell, and the nearest hit is a partial minimum.

No task holds the mesh. A ray asks the cells that it meets in rounds of growing length, and is done as soon as it has a hit that lies before the end of what it
has walked, so most triangles behind a surface are never met.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch

XYZ = ("x", "y", "z")
#: Cells of an axis at most, cells of the first round, eyes at most (they are met with every vertex), and the least determinant of a triangle that is no edge.
CELLS, FIRST, EYES, LEAST = 128, 8, 10_000, 1e-12
#: Triangles that sight is tried against first; more are tried as long as most rays end at them.
TRIED = (512, 4096)


def triangles(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(fid, ax, ay, ... cz): faces (fid, a, b, c) with their corners."""
    out = faces.select("fid", "a", "b", "c")
    for k in "abc":
        out = out.join(vertices.select(F.col("vid").alias(k), *[F.col(x).cast("double").alias(k + x) for x in XYZ]), k)
    return out.select("fid", *[k + x for k in "abc" for x in XYZ])


def _cross(p, q):
    return p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0]


def _dot(p, q):
    return p[0] * q[0] + p[1] * q[1] + p[2] * q[2]


def intersection() -> tuple[Column, Column]:
    """Where along the ray (ox..dz) it cuts the triangle (ax..cz), and whether it does between 0 and ``reach``."""
    a, b, c, o, d = ([F.col(k + x) for x in XYZ] for k in "abcod")
    e1, e2, from_a = ([y - x for x, y in zip(a, p, strict=True)] for p in (b, c, o))
    h, q = _cross(d, e2), _cross(from_a, e1)
    det = _dot(e1, h)
    inverse = F.try_divide(F.lit(1.0), det)
    u, w, t = _dot(from_a, h) * inverse, _dot(d, q) * inverse, _dot(e2, q) * inverse
    return t, (F.abs(det) > LEAST) & (u >= 0) & (w >= 0) & (u + w <= 1) & (t > 1e-9) & (t < F.col("reach"))


def grid(corners: DataFrame) -> dict[str, tuple[float, float, int]] | None:
    """(begin, side, cells) of each axis: cells about as long as a triangle, ``CELLS`` at most; None without triangles."""
    lo, hi = ({x: f(*[F.col(k + x) for k in "abc"]) for x in XYZ} for f in (F.least, F.greatest))
    r = corners.agg(*[e.alias(n + x) for x in XYZ for n, e in (("lo", F.min(lo[x])), ("hi", F.max(hi[x])), ("mean", F.avg(hi[x] - lo[x])))]).first()
    if r.lox is None:
        return None
    out = {}
    for x in XYZ:
        pad = 1e-6 * max(1.0, abs(r["lo" + x]), abs(r["hi" + x]))
        extent = r["hi" + x] - r["lo" + x] + 2 * pad
        n = max(1, min(CELLS, int(extent / max(r["mean" + x], extent / CELLS))))
        out[x] = (r["lo" + x] - pad, extent / n, n)
    return out


def dealt(corners: DataFrame, cells: dict[str, tuple[float, float, int]]) -> DataFrame:
    """``corners`` in every cell (kx, ky, kz) that their boxes touch."""
    out = corners
    for x, (begin, side, n) in cells.items():
        pad = 1e-7 * side
        at = lambda v, begin=begin, side=side, n=n: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v - begin) / side))).cast("int")
        out = out.withColumn("k" + x, F.explode(F.sequence(at(F.least(*[F.col(k + x) for k in "abc"]) - pad), at(F.greatest(*[F.col(k + x) for k in "abc"]) + pad))))
    return out


def _crossing(o: Column, d: Column, begin: float, side: float):
    """Where a ray crosses the k-th plane of an axis, between the ends of its walk."""
    return lambda k: F.least(F.col("__t1"), F.greatest(F.col("__t0"), F.try_divide(F.lit(begin) + k * F.lit(side) - o, d)))


def walked(rays: DataFrame, cells: dict[str, tuple[float, float, int]]) -> DataFrame:
    """``rays`` with ``steps``: the cells that each meets up to its reach, in order, with the place where it leaves them."""
    enter, leave = [F.lit(0.0)], [F.col("reach")]
    for x, (begin, side, n) in cells.items():
        o, d = F.col("o" + x), F.col("d" + x)
        one, two = F.try_divide(begin - o, d), F.try_divide(begin + n * side - o, d)
        inside = (o >= begin) & (o <= begin + n * side)
        enter.append(F.when(d != 0, F.least(one, two)).when(inside, F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        leave.append(F.when(d != 0, F.greatest(one, two)).when(inside, F.lit(float("inf"))).otherwise(F.lit(float("-inf"))))
    out = rays.withColumn("__t0", F.greatest(*enter)).withColumn("__t1", F.least(*leave)).where("__t0 <= __t1")
    crossings = []
    for x, (begin, side, n) in cells.items():
        o, d = F.col("o" + x), F.col("d" + x)
        at = lambda t, o=o, d=d, begin=begin, side=side, n=n: F.least(F.lit(n), F.greatest(F.lit(0), F.floor((o + d * t - begin) / side))).cast("int")
        i, j = at(F.col("__t0")), at(F.col("__t1"))
        planes = F.when((d != 0) & (i != j), F.sequence(F.least(i, j) + 1, F.greatest(i, j))).otherwise(F.array().cast("array<int>"))
        crossings.append(F.transform(planes, _crossing(o, d, begin, side)))
    out = out.withColumn("__ts", F.array_sort(F.concat(F.array("__t0"), *crossings, F.array("__t1"))))

    def step(i: Column) -> Column:
        t, end = F.get("__ts", i), F.get("__ts", i + 1)
        middle = (t + end) / 2
        at = [F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((F.col("o" + x) + F.col("d" + x) * middle - begin) / side))).cast("int").alias("k" + x) for x, (begin, side, n) in cells.items()]
        return F.struct(*at, end.alias("end"))

    return out.withColumn("steps", F.transform(F.sequence(F.lit(0), F.size("__ts") - 2), step)).drop("__t0", "__t1", "__ts")


def nearest_hits(rays: DataFrame, corners: DataFrame) -> DataFrame:
    """(ray, fid, t): the first triangle of ``corners`` (see ``triangles``) that each of ``rays`` (ray, ox, oy, oz, dx, dy, dz, reach) cuts between 0 and reach, in
    lengths of its direction; ties go to the smaller fid. Rays that hit nothing, or with a null, are left out."""
    spark = rays.sparkSession
    corners = scratch.store(corners, "triangles")
    cells = grid(corners)
    numbers = ["o" + x for x in XYZ] + ["d" + x for x in XYZ] + ["reach"]
    open_rays = rays.select("ray", *[F.col(n).cast("double").alias(n) for n in numbers]).dropna()
    result = f"ray {dict(rays.dtypes)['ray']}, fid {dict(corners.dtypes)['fid']}, t double"
    if cells is None:
        return spark.createDataFrame([], result)
    held = scratch.store(dealt(corners, cells), "cells")
    t, cuts = intersection()
    done, begin, length = [], 1, FIRST
    most = sum(n for _, _, n in cells.values()) + 3
    while begin <= most:
        here = walked(open_rays, cells).withColumn("part", F.slice("steps", begin, length))
        asked = here.select("ray", *numbers, F.explode("part").alias("s")).select("ray", *numbers, *[F.col("s.k" + x).alias("k" + x) for x in XYZ])
        met = asked.join(held, ["k" + x for x in XYZ]).where(cuts).groupBy("ray").agg(F.min(F.struct(t.alias("t"), "fid")).alias("hit"))
        ends = here.select("ray", *numbers, F.element_at("part", -1)["end"].alias("end"), (F.size("steps") < begin + length).alias("last"))
        now = scratch.store(ends.join(met, "ray", "left"), "rays")
        ready = F.col("hit").isNotNull() & (F.col("last") | (F.col("hit.t") <= F.col("end")))
        done.append(now.where(ready).select("ray", "hit.fid", "hit.t"))
        open_rays = now.where(~ready & ~F.col("last")).select("ray", *numbers)
        begin, length = begin + length, 2 * length
        if open_rays.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def unhidden(rays: DataFrame, corners: DataFrame) -> DataFrame:
    """``rays`` (see ``nearest_hits``) without those that one of a few of ``corners`` cuts. A ray stops at its first hit, so among large triangles most are settled by some
    tens of tests; what is left has yet to meet all triangles."""
    open_rays, n = rays, rays.count()
    for size in TRIED:
        some = F.broadcast(corners.orderBy(F.xxhash64("fid"), "fid").limit(size))  # so many rows at most
        open_rays = scratch.store(open_rays.join(some, intersection()[1], "left_anti"), "open")
        left = open_rays.count()
        if 2 * left > n:
            break
        n = left
    return open_rays


def visible_from(vertices: DataFrame, faces: DataFrame, eyes: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """(eye, vid, x, y, z, visible) of ``vertices`` (vid, x, y, z) for each of a few ``eyes`` (eye, x, y, z): no triangle of ``faces`` (fid, a, b, c) cuts the segment from
    the eye more than ``tolerance`` before the vertex. A vertex that all but touches the eye is visible, one with a null coordinate isn't told of."""
    n = eyes.count()
    if n > EYES:
        raise ValueError(f"{n} eyes; {EYES} at most are met with every vertex")
    seen = vertices.select("vid", *XYZ).dropna().crossJoin(F.broadcast(eyes.select("eye", *[F.col(x).alias("o" + x) for x in XYZ])))  # counted above
    far = F.sqrt(sum(((F.col(x) - F.col("o" + x)) * (F.col(x) - F.col("o" + x)) for x in XYZ), F.lit(0.0)))
    rays = seen.withColumn("far", far).select(F.struct("eye", "vid").alias("ray"), *XYZ, *["o" + x for x in XYZ], *[((F.col(x) - F.col("o" + x)) / F.greatest(F.col("far"), F.lit(1e-12))).alias("d" + x) for x in XYZ], (F.col("far") - tolerance).alias("reach"))
    rays = scratch.store(rays, "sight")
    corners = scratch.store(triangles(vertices, faces), "triangles")
    open_rays = unhidden(rays, corners)
    seen = open_rays.select("ray").join(nearest_hits(open_rays, corners).select("ray"), "ray", "left_anti").select("ray", F.lit(True).alias("seen"))
    return rays.join(seen, "ray", "left").select("ray.eye", "ray.vid", *XYZ, F.col("seen").isNotNull().alias("visible"))
