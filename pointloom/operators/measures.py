"""Error measures, losses, forces and other aggregations."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import AXES, nearest_join


def two_level_mean(rows: DataFrame, inner: Sequence[str], outer: Sequence[str], value: str, name: str = "mean") -> DataFrame:
    """Mean over ``outer`` of the means over ``inner`` (not one flat mean)."""
    return rows.groupBy(*outer, *inner).agg(F.avg(value).alias("__m")).groupBy(*outer).agg(F.avg("__m").alias(name), F.count("*").alias("n_groups"))


def chamfer(observed: DataFrame, predicted: DataFrame, metric: str = "l1", by: Sequence[str] = ()) -> DataFrame:
    """Each observation's distance to the nearest prediction."""
    return nearest_join(observed, predicted, metric=metric, by=by)


def track_error(truth: DataFrame, predicted: DataFrame, spine: DataFrame) -> DataFrame:
    """(frame, error): mean distance over the valid points of a frame; 0 in a frame without any."""
    both = truth.alias("t").join(predicted.alias("p"), ["frame", "pid"])
    d = F.sqrt(sum(((F.col(f"t.{c}") - F.col(f"p.{c}")) * (F.col(f"t.{c}") - F.col(f"p.{c}")) for c in AXES), F.lit(0.0)))
    per = both.groupBy("frame").agg(F.avg(d).alias("e"))
    return spine.join(per, "frame", "left").select("frame", F.coalesce("e", F.lit(0.0)).alias("error"))


def psnr(mse: Column) -> Column:
    """Infinite for equal images."""
    return F.when(mse == 0, F.lit(math.inf)).otherwise(-10.0 * F.log10(mse))


def pixel_error(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Distance of two pixels."""
    return F.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1]))


def iou(a: Column, b: Column) -> Column:
    """1 for an empty union."""
    union = F.count_if(a | b)
    return F.when(union == 0, 1.0).otherwise(F.count_if(a & b) / F.greatest(union, F.lit(1)))


def smooth_l1(x: Column) -> Column:
    return F.when(F.abs(x) < 1.0, 0.5 * x * x).otherwise(F.abs(x) - 0.5)


def anisotropy(scales: Column, ratio: float) -> Column:
    """Mean of what the largest to the smallest scale exceeds ``ratio`` by."""
    return F.avg(F.greatest(F.array_max(scales) / F.array_min(scales), F.lit(ratio)) - ratio)


def pulls(edges: DataFrame, damping: float, stiff_min: float, stiff_max: float, *keep: str) -> DataFrame:
    """(src, dst, keep, y, fx, fy, fz): what each spring (src, dst, rest, log_y; a_* and b_*: xyz, vxyz of its ends) pulls its src by."""
    d = [F.col("b_" + c) - F.col("a_" + c) for c in AXES]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    e = edges.select("src", "dst", *keep, "rest", F.exp("log_y").alias("y"), length.alias("len"), *[(x / F.greatest(length, F.lit(1e-6))).alias("d" + c) for x, c in zip(d, AXES, strict=True)], *[(F.col("b_v" + c) - F.col("a_v" + c)).alias("w" + c) for c in AXES])
    along = F.col("wx") * F.col("dx") + F.col("wy") * F.col("dy") + F.col("wz") * F.col("dz")
    size = F.greatest(F.lit(stiff_min), F.least(F.lit(stiff_max), F.col("y"))) * (F.col("len") / F.col("rest") - 1.0) + damping * along
    return e.select("src", "dst", *keep, "y", *[(size * F.col("d" + c)).alias("f" + c) for c in AXES])


def spring_force(springs: DataFrame, nodes: DataFrame, damping: float, stiff_min: float, stiff_max: float) -> DataFrame:
    """(pid, fx, fy, fz) of springs (src, dst, rest, log_y) on nodes (pid, xyz, vxyz): each edge pulls both ends, joined by ids."""
    cols = [*AXES, "vx", "vy", "vz"]
    e = springs.join(nodes.select(F.col("pid").alias("src"), *[F.col(c).alias("a_" + c) for c in cols]), "src")
    e = e.join(nodes.select(F.col("pid").alias("dst"), *[F.col(c).alias("b_" + c) for c in cols]), "dst")
    e = pulls(e, damping, stiff_min, stiff_max).where(F.col("y") > stiff_min)
    # both ends from one row, as a union would make the joins twice
    ends = e.select(F.explode(F.array(*[F.struct(F.col(end).alias("pid"), *[(s * F.col("f" + c)).alias("f" + c) for c in AXES]) for end, s in (("src", 1.0), ("dst", -1.0))])).alias("end")).select("end.*")
    return ends.groupBy("pid").agg(*[F.sum("f" + c).alias("f" + c) for c in AXES])


def counted(ends: str, wanted: str = "true") -> Column:
    """Of the ends (other, first) of pairs that may have come twice, those that count: an end that isn't ``first`` only where no other of its pair is."""
    return F.expr(f"filter({ends}, x -> ({wanted}) and (x.first or not exists({ends}, y -> y.first and y.other = x.other)))")


def one_way_force(edges: DataFrame, damping: float, stiff_min: float, stiff_max: float) -> DataFrame:
    """``spring_force`` of the edges of ``joins.one_way`` with their log_y, whose rows have all of both ends. The ends of the sure ones are summed where they are
    made; only those of the others go one by one to their node, which sees both of a pair that came twice."""
    f, live = ["f" + c for c in AXES], F.coalesce(F.col("y") > stiff_min, F.lit(False))
    e = pulls(edges, damping, stiff_min, stiff_max, "sure").withColumn("live", live).withColumn("first", F.col("src") < F.col("dst")).where("live or not sure")
    ends = e.select("sure", F.explode(F.array(*[F.struct(F.col(end).alias("pid"), F.col(other).alias("other"), "first", "live", *[(s * F.col(c)).alias(c) for c in f]) for end, other, s in (("src", "dst", 1.0), ("dst", "src", -1.0))])).alias("end"))
    of = lambda c: F.when(F.col("sure"), F.col(f"end.{c}"))
    sums = ends.groupBy("end.pid").agg(*[F.sum(of(c)).alias(c) for c in f], F.count(of("pid")).alias("n"), F.collect_list(F.when(~F.col("sure"), F.struct(*[F.col(f"end.{c}") for c in ("other", "first", "live", *f)]))).alias("more"))
    own = F.when(F.col("n") > 0, F.array(F.struct(*f)))
    more = F.transform(counted("more", "x.live"), lambda x: F.struct(*[x[c].alias(c) for c in f]))
    every = sums.select("pid", F.explode(F.concat(F.coalesce(own, F.array().cast(f"array<struct<{', '.join(c + ':double' for c in f)}>>")), more)).alias("f"))
    return every.groupBy("pid").agg(*[F.sum(f"f.{c}").alias(c) for c in f])


def side_forces(edges: DataFrame, nodes: DataFrame, side: Callable[[Column], Column], sides: Sequence[int], damping: float, stiff_min: float, stiff_max: float) -> DataFrame:
    """(side, fx, fy, fz, cx, cy, cz): of the springs of each side (of their src) the force on their dst, summed, and the mean place of dst. ``edges``: those of
    ``joins.one_way`` with log_y and the places of their ends. Velocities come from ``nodes`` (pid, vxyz), all finite, and meet a row of each node and not of each spring: along a
    spring of direction d its damping is d d' (v_dst - v_src), so a node adds its velocity times the sum of d d' over its ends."""
    c, f, p = F.col, ["f" + x for x in AXES], ["p" + x for x in AXES]
    d = [c("b_" + x) - c("a_" + x) for x in AXES]
    length = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    pull = F.greatest(F.lit(stiff_min), F.least(F.lit(stiff_max), F.exp("log_y"))) * (length / c("rest") - 1.0)
    e = edges.select("src", "dst", "sure", pull.alias("pull"), *[(x / F.greatest(length, F.lit(1e-6))).alias("d" + n) for x, n in zip(d, AXES, strict=True)], *[c("b_" + x).alias("p" + x) for x in AXES])
    # of a sure spring its src, its dst, and what it adds without velocities; of the others their ends
    end = lambda pid, other, own: F.struct(pid.cast(edges.schema["src"].dataType).alias("pid"), other.alias("other"), F.lit(own).alias("own"))
    both = [end(c("src"), c("dst"), True), end(c("dst"), c("src"), False)]
    rows = e.withColumn("end", F.explode(F.when(c("sure"), F.array(*both, end(F.lit(None), c("dst"), True))).otherwise(F.array(*both)))).withColumn("side", side(c("src")))
    pairs = [x + y for i, x in enumerate(AXES) for y in AXES[i:]]
    sums = [F.collect_list(F.when(~c("sure"), F.struct(c("end.other").alias("other"), (c("src") < c("dst")).alias("first"), c("end.own").alias("own"), "pull", *["d" + x for x in AXES], *p))).alias("more")]
    for g in sides:
        of = lambda v, node, g=g: F.when(c("sure") & (c("side") == g) & (c("end.pid").isNotNull() if node else c("end.pid").isNull()), v)
        sums += [F.sum(of(F.when(c("end.own"), -c("d" + q[0]) * c("d" + q[1])).otherwise(c("d" + q[0]) * c("d" + q[1])), True)).alias(f"{q}{g}") for q in pairs]
        sums += [F.sum(of(c("pull") * c("d" + x), False)).alias(f"f{x}{g}") for x in AXES] + [F.sum(of(c(x), False)).alias(f"{x}{g}") for x in p] + [F.count(of(F.lit(1), False)).alias(f"n{g}")]
    met = rows.groupBy(c("end.pid").alias("pid")).agg(*sums).join(nodes.select("pid", *["v" + x for x in AXES]), "pid", "left")
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    drag = lambda x, g: sum((c("v" + y) * c(f"{min(x, y)}{max(x, y)}{g}") for y in AXES), F.lit(0.0))
    settled = [F.struct(F.lit(g).alias("side"), *[(zero(c(f"f{x}{g}")) + damping * zero(drag(x, g))).alias("f" + x) for x in AXES], *[zero(c(f"{x}{g}")).alias(x) for x in p], c(f"n{g}").alias("n")) for g in sides]

    def half(x: Column) -> Column:
        along = damping * sum((c("v" + y) * x["d" + y] for y in AXES), F.lit(0.0))
        size = F.when(x["own"], x["pull"] - along).otherwise(along)
        of = side(F.when(x["own"], c("pid")).otherwise(x["other"]))
        return F.struct(of.alias("side"), *[(size * x["d" + y]).alias("f" + y) for y in AXES], *[F.when(x["own"], x[y]).otherwise(0.0).alias(y) for y in p], x["own"].cast("long").alias("n"))

    every = met.select(F.explode(F.concat(F.array(*settled), F.transform(counted("more"), half))).alias("r")).select("r.*")
    out = every.groupBy("side").agg(*[F.sum(x).alias(x) for x in (*f, *p, "n")]).where("n > 0")
    return out.select("side", *[(-c(x)).alias(x) for x in f], *[(c("p" + x) / c("n")).alias("c" + x) for x in AXES])


def velocity(v: Column, f: Column, mass: float, dt: float, drag: float, gravity: float = 0.0) -> Column:
    return (v + (f + mass * gravity) / mass * dt) * math.exp(-dt * drag)


def collision_impulse(pairs: DataFrame, mass: float, elastic: float, friction: float) -> DataFrame:
    """(pid, jx, jy, jz, hits): mean impulse over approaching neighbours; ``pairs`` have a_ and b_ positions and velocities."""
    e, f = min(1.0, max(0.0, elastic)), min(2.0, max(0.0, friction))
    d = [F.col("b_" + c) - F.col("a_" + c) for c in AXES]
    w = [F.col("b_v" + c) - F.col("a_v" + c) for c in AXES]
    rows = pairs.select(F.col("a_pid").alias("pid"), *[x.alias("d" + c) for x, c in zip(d, AXES, strict=True)], *[x.alias("w" + c) for x, c in zip(w, AXES, strict=True)])
    rows = rows.withColumn("toward", F.col("dx") * F.col("wx") + F.col("dy") * F.col("wy") + F.col("dz") * F.col("wz")).where("toward < -1e-4")
    rows = rows.withColumn("len", F.greatest(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy") + F.col("dz") * F.col("dz")), F.lit(1e-6)))
    n = [F.col("d" + c) / F.col("len") for c in AXES]
    speed = F.col("wx") * n[0] + F.col("wy") * n[1] + F.col("wz") * n[2]
    rows = rows.withColumn("speed", speed).withColumns({"n" + c: F.col("speed") * x for c, x in zip(AXES, n, strict=True)})
    rows = rows.withColumns({"t" + c: F.col("w" + c) - F.col("n" + c) for c in AXES})
    vt = F.sqrt(F.col("tx") * F.col("tx") + F.col("ty") * F.col("ty") + F.col("tz") * F.col("tz"))
    a = F.greatest(F.lit(0.0), 1.0 - f * (1.0 + e) * F.abs(F.col("speed")) / F.greatest(vt, F.lit(1e-6)))
    mu = 2.0 / mass
    return rows.groupBy("pid").agg(*[F.avg((-(1.0 + e) * F.col("n" + c) + (a - 1.0) * F.col("t" + c)) / mu).alias("j" + c) for c in AXES], F.count("*").alias("hits"))


def collided(nodes: DataFrame, impulses: DataFrame, mass: float = 1.0) -> DataFrame:
    """``nodes`` with their velocities after the mean ``impulses`` (pid, jx, jy, jz); without any a node keeps its own."""
    new = nodes.join(impulses.select("pid", *["j" + c for c in AXES]), "pid", "left")
    return new.withColumns({"v" + c: F.col("v" + c) - F.coalesce(F.col("j" + c), F.lit(0.0)) / mass for c in AXES}).drop(*["j" + c for c in AXES])


def ground_step(nodes: DataFrame, dt: float, elastic: float, friction: float, sign: float = 1.0) -> DataFrame:
    """Positions and velocities after a step with reflection on the plane z = 0, whose normal is (0, 0, sign)."""
    c = F.col
    elastic, friction = min(1.0, max(0.0, elastic)), min(2.0, max(0.0, friction))
    hit = ((c("z") + c("vz") * dt) * sign < 0) & (c("vz") * sign < -1e-4)
    vt = F.sqrt(c("vx") * c("vx") + c("vy") * c("vy"))
    a = F.greatest(F.lit(0.0), 1.0 - friction * (1.0 + elastic) * F.abs(c("vz")) / F.greatest(vt, F.lit(1e-6)))
    rows = nodes.withColumn("toi", F.when(hit, -c("z") / F.when(hit, c("vz"))).otherwise(0.0))
    new = {"wx": F.when(hit, a * c("vx")).otherwise(c("vx")), "wy": F.when(hit, a * c("vy")).otherwise(c("vy")), "wz": F.when(hit, -elastic * c("vz")).otherwise(c("vz"))}
    rows = rows.withColumns(new)
    return rows.select("pid", *[(c(x) + c("v" + x) * c("toi") + c("w" + x) * (dt - c("toi"))).alias(x) for x in AXES], *[c("w" + x).alias("v" + x) for x in AXES])


def stiffness(springs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(pid, stiffness): Frobenius norm of the sum of y / rest times the direction's outer square over a node's springs."""
    e = springs.join(nodes.select(F.col("pid").alias("src"), *[F.col(c).alias("a_" + c) for c in AXES]), "src").join(nodes.select(F.col("pid").alias("dst"), *[F.col(c).alias("b_" + c) for c in AXES]), "dst")
    d = [F.col("b_" + c) - F.col("a_" + c) for c in AXES]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) + 1e-8
    e = e.select("src", "dst", (F.exp("log_y") / F.col("rest")).alias("k"), *[(x / n).alias(c) for x, c in zip(d, AXES, strict=True)])
    six = {p + q: F.col("k") * F.col(p) * F.col(q) for p, q in ("xx", "xy", "xz", "yy", "yz", "zz")}
    ends = e.select(F.explode(F.array("src", "dst")).alias("pid"), *[x.alias(k) for k, x in six.items()]).groupBy("pid").agg(*[F.sum(k).alias(k) for k in six])
    sq = sum(((1.0 if k[0] == k[1] else 2.0) * F.col(k) * F.col(k) for k in six), F.lit(0.0))
    return ends.select("pid", F.sqrt(sq).alias("stiffness"))


def morphology(pixels: DataFrame, k: int, grow: bool) -> DataFrame:
    """Dilation (max) or erosion (min, with nothing outside) of a set of pixels (frame, u, v) by a k x k square; even squares reach one further
    to the negative side. A square is a row of rows, so the columns are done first and the rows after: k rows for a pixel in each pass, not k * k."""
    lo, hi = -(k // 2), (k - 1) // 2
    out = pixels.select("frame", "u", "v").distinct()
    for axis in "uv":
        reached = F.explode(F.sequence(F.col(axis) - hi, F.col(axis) - lo))
        per = out.withColumn(axis, reached).groupBy("frame", "u", "v").agg(F.count("*").alias("n"))
        out = per.where(F.lit(grow) | (F.col("n") == k)).select("frame", "u", "v")
    return out


def composite(order: Column, alpha: Column, colour: Column, skip: float = 1 / 255, most: float = 0.99, stop: float = 1e-4) -> Column:
    """(colour, left): front-to-back blend of a group's rows: alphas under ``skip`` are passed over and others held to ``most``; the row that would
    leave less than ``stop`` is not added and ends it."""
    rows = F.array_sort(F.collect_list(F.struct(order.alias("k"), alpha.alias("a"), colour.alias("c"))))
    start = F.struct(F.lit(0.0).alias("colour"), F.lit(1.0).alias("left"), F.lit(False).alias("done"))

    def add(acc: Column, x: Column) -> Column:
        a = F.least(F.lit(most), x["a"])
        left = acc["left"] * (1.0 - a)
        skipped = acc["done"] | (x["a"] < skip)
        ends = ~skipped & (left < stop)
        return F.struct(
            F.when(skipped | ends, acc["colour"]).otherwise(acc["colour"] + x["c"] * a * acc["left"]).alias("colour"), F.when(skipped | ends, acc["left"]).otherwise(left).alias("left"), (acc["done"] | ends).alias("done")
        )

    return F.aggregate(rows, start, add)


def ssim(images: DataFrame, height: int, width: int, group: Sequence[str] = ("frame",)) -> DataFrame:
    """Structural similarity of two images (u, v, a, b; missing pixels 0): 11 x 11 Gaussian window of deviation 1.5, zeros outside."""
    g = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    g /= g.sum()

    def blur(x: np.ndarray) -> np.ndarray:
        for axis in (0, 1):
            p = np.pad(x, [(5, 5) if i == axis else (0, 0) for i in (0, 1)])
            x = sum(g[i] * np.take(p, range(i, i + x.shape[axis]), axis) for i in range(11))
        return x

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = np.zeros((height, width)), np.zeros((height, width))
        a[pdf["v"], pdf["u"]], b[pdf["v"], pdf["u"]] = pdf["a"], pdf["b"]
        ma, mb = blur(a), blur(b)
        va, vb, ab = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
        s = ((2 * ma * mb + 0.01**2) * (2 * ab + 0.03**2)) / ((ma * ma + mb * mb + 0.01**2) * (va + vb + 0.03**2))
        return pdf[list(group)].head(1).assign(ssim=s.mean())

    kinds = dict(images.dtypes)
    return images.groupBy(*group).applyInPandas(one, ", ".join([f"{c} {kinds[c]}" for c in group] + ["ssim double"]))


def idw_weights(pairs: DataFrame, key: str = "a_pid") -> DataFrame:
    """Inverse-distance weights 1 / (d + 1e-6) of each row's neighbours, summing to 1."""
    w = F.lit(1.0) / (F.sqrt("dist") + 1e-6)
    return pairs.withColumn("__w", w).withColumn("weight", F.col("__w") / F.sum("__w").over(Window.partitionBy(key))).drop("__w")


def recall_auc(errors: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Area under the recall curve of ``err`` up to each threshold, over it (trapezoids; ties in any order)."""
    from .filters import number_rows

    n = errors.count()
    ranked = number_rows(errors.select("err", F.monotonically_increasing_id().alias("__tie")), ["err", "__tie"], "at").select("at", "err")
    pairs = ranked.join(ranked.select((F.col("at") + 1).alias("at"), F.col("err").alias("e0")), "at", "left")
    step = (F.col("err") - F.coalesce("e0", F.lit(0.0))) * (2 * F.col("at") + 1) / F.lit(2.0 * max(1, n))
    out = []
    for t in thresholds:
        inside = pairs.where(F.col("err") < t).agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("s"), F.coalesce(F.max("err"), F.lit(0.0)).alias("e"), F.count("*").alias("k"))
        out.append(inside.select(F.lit(float(t)).alias("threshold"), ((F.col("s") + (t - F.col("e")) * F.col("k") / float(max(1, n))) / t).alias("auc")))
    rows = out[0]
    for x in out[1:]:
        rows = rows.unionByName(x)
    return rows
