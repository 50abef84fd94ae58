"""Keypoints, masks, views, calibration, evaluation joins and unions of point sets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import filters, joins


def of_roles(pixels: DataFrame, roles: Sequence[str], column: str = "role") -> DataFrame:
    """Pixels of any of the ``roles``, each once."""
    return pixels.where(F.col(column).isin(*roles)).drop(column).distinct()


def in_mask(tracks: DataFrame, mask: DataFrame, key: Sequence[str] = ("frame", "u", "v")) -> DataFrame:
    """``tracks`` with ``in_mask``: whether the mask holds the pixel; one outside the image, or with a null, is in none."""
    return tracks.join(mask.select(*key).distinct().withColumn("__in", F.lit(True)), list(key), "left").withColumn("in_mask", F.coalesce("__in", F.lit(False))).drop("__in")


def first_frame_members(tracks: DataFrame, mask: DataFrame) -> DataFrame:
    """Tracks of the points that are visible in frame 0 and lie in its mask there."""
    first = in_mask(tracks.where((F.col("frame") == 0) & F.col("visible")), mask.where("frame = 0")).where("in_mask")
    return tracks.join(first.select("pid"), "pid", "left_semi")


def revalidate(tracks: DataFrame, mask: DataFrame) -> DataFrame:
    """``visible`` also asks that the frame's mask holds the pixel."""
    return in_mask(tracks, mask).withColumn("visible", F.col("visible") & F.col("in_mask")).drop("in_mask")


def always_visible(tracks: DataFrame) -> DataFrame:
    """Tracks of the points that are visible in every frame they have."""
    return tracks.join(filters.visible_every_frame(tracks).where("always").select("pid"), "pid", "left_semi")


def keypoints(scores: DataFrame, threshold: float, border: int, width: int, height: int) -> DataFrame:
    """Pixels with a score over ``threshold`` that keep ``border`` pixels to each side."""
    c = F.col
    return scores.where((c("score") > threshold) & (c("u") >= border) & (c("u") < width - border) & (c("v") >= border) & (c("v") < height - border))


def top_keypoints(scores: DataFrame, k: int, group: Sequence[str] = ("frame",)) -> DataFrame:
    """The ``k`` best of each group with ``nth`` from 1; ties by row and column. Each task keeps its best ``k`` first, so a large group isn't
    gathered in one."""
    order = [F.desc("score"), F.col("v"), F.col("u")]
    local = scores.withColumn("__salt", F.pmod(F.xxhash64("u", "v"), F.lit(32)))
    best = local.withColumn("nth", F.row_number().over(Window.partitionBy(*group, "__salt").orderBy(*order))).where(F.col("nth") <= k).drop("__salt")
    return best.withColumn("nth", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("nth") <= k)


def largest_around(image: DataFrame, value: str, reach: int, name: str) -> DataFrame:
    """``image`` (frame, u, v, every pixel) with the largest ``value`` in the square of ``reach`` pixels around each: first along columns, then rows."""
    column, row = Window.partitionBy("frame", "u").orderBy("v").rangeBetween(-reach, reach), Window.partitionBy("frame", "v").orderBy("u").rangeBetween(-reach, reach)
    return image.withColumn("__m", F.max(value).over(column)).withColumn(name, F.max("__m").over(row)).drop("__m")


def peaks(image: DataFrame, reach: int = 4, rounds: int = 2) -> DataFrame:
    """``image`` (frame, u, v, score; every pixel) with ``peak``: the largest in its square, and then, ``rounds`` times, the largest of what no
    peak's square covers."""
    out = largest_around(image, "score", reach, "__top").withColumn("peak", F.col("score") == F.col("__top"))
    for _ in range(rounds):
        out = largest_around(out.withColumn("__p", F.col("peak").cast("int")), "__p", reach, "__near").withColumn("__left", F.when(F.col("__near") > 0, F.lit(0.0)).otherwise(F.col("score")))
        out = largest_around(out, "__left", reach, "__top").withColumn("peak", F.col("peak") | ((F.col("__left") == F.col("__top")) & (F.col("__near") == 0)))
    return out.select(*image.columns, "peak")


def calibrated(corners: DataFrame, least: int = 11, most_error: float = 0.2) -> DataFrame:
    """(camera, n, error): cameras with at least ``least`` corners and a mean reprojection error (``err``) of at most ``most_error``."""
    return corners.groupBy("camera").agg(F.count("err").alias("n"), F.avg("err").alias("error")).where((F.col("n") >= least) & (F.col("error") <= most_error))


def not_white(r: Column, g: Column, b: Column, white: float = 255) -> Column:
    return ~((r == white) & (g == white) & (b == white))


def nearest_mask_pixel(points: DataFrame, mask: DataFrame, cloud: DataFrame, key: Sequence[str] = ("frame", "cam"), width: int = 1 << 16) -> DataFrame:
    """Each point (id, u, v) with the closest mask pixel (mu, mv; ties to the smaller row, then column) and what ``cloud`` (v, u, ...) has there."""
    m = mask.select(*key, "u", "v").distinct().withColumn("pix", F.col("v") * width + F.col("u"))
    near = joins.nearest_join(points, m, a_id="id", b_id="pix", axes=("u", "v"), by=key)
    found = near.select(*[F.col("a_" + k).alias(k) for k in key], F.col("a_id").alias("id"), F.col("b_u").alias("mu"), F.col("b_v").alias("mv"), "dist")
    rest = [x for x in cloud.columns if x not in (*key, "u", "v")]
    return found.join(cloud.select(*key, F.col("u").alias("mu"), F.col("v").alias("mv"), *rest), [*key, "mu", "mv"], "left")


def images_with_cameras(images: DataFrame, cameras: DataFrame, depths: DataFrame | None = None) -> DataFrame:
    """Images with their camera by ``camera_id`` and, by the name without its ending, their depth parameters; what is missing is null."""
    out = images.join(cameras, "camera_id", "left")
    if depths is None:
        return out
    stem = F.regexp_replace("name", r"\.[^./]*$", "")
    return out.withColumn("stem", stem).join(depths, "stem", "left")


def closest_pair(a: DataFrame, b: DataFrame, a_id: str = "pid", b_id: str = "pid") -> DataFrame:
    """The one row of the closest (a, b); ties to the smaller ids."""
    near = joins.nearest_join(a, b, a_id=a_id, b_id=b_id)
    return near.orderBy("dist", f"a_{a_id}", f"b_{b_id}").limit(1)


def evaluation_rows(outputs: DataFrame, truth: DataFrame, mask: DataFrame, key: Sequence[str]) -> DataFrame:
    """What all three tables have by ``key``."""
    return outputs.join(truth, list(key)).join(mask, list(key))


def total_loss(chamfer: DataFrame, track: DataFrame, acceleration: DataFrame) -> DataFrame:
    """(frame, loss): the sum of a frame's losses (frame, loss); what a frame lacks is 0."""
    rows = chamfer.select("frame", "loss").unionByName(track.select("frame", "loss")).unionByName(acceleration.select("frame", "loss"))
    return rows.groupBy("frame").agg(F.sum("loss").alias("loss"))


def epoch_loss(losses: DataFrame) -> DataFrame:
    """(loss,): the mean over the frames after the first."""
    return losses.where("frame > 0").agg(F.avg("loss").alias("loss"))


def densification(steps: DataFrame) -> DataFrame:
    """(gid, total, n, mean, radius): sum, number and mean (0 without any) of the gradient norms of the steps that saw a splat, and its largest radius."""
    seen = F.col("seen")
    g = steps.groupBy("gid").agg(F.coalesce(F.sum(F.when(seen, F.col("gradient"))), F.lit(0.0)).alias("total"), F.count_if(seen).alias("n"), F.coalesce(F.max(F.when(seen, F.col("radius"))), F.lit(0.0)).alias("radius"))
    return g.withColumn("mean", F.coalesce(F.try_divide("total", "n"), F.lit(0.0)))


def best_view(matches: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, view, n): the view with the most matches, the first on ties."""
    n = matches.groupBy(*group, "view").agg(F.count("*").alias("n"))
    best = n.groupBy(*group).agg(F.max(F.struct("n", (-F.col("view")).alias("w"))).alias("b"))
    return best.select(*group, (-F.col("b.w")).alias("view"), F.col("b.n").alias("n"))


def union_with_ids(parts: Sequence[DataFrame], order: Sequence[str], name: str = "id") -> DataFrame:
    """All rows, numbered by part and ``order`` from 0. Only the parts' sizes reach the driver."""
    out, before = None, 0
    for p in parts:
        numbered = filters.number_rows(p, order, name).withColumn(name, F.col(name) + F.lit(before))
        before += p.count()
        out = numbered if out is None else out.unionByName(numbered)
    return out


def any_mask(*masks: DataFrame) -> DataFrame:
    """Pixels that one of the masks holds."""
    out = masks[0]
    for m in masks[1:]:
        out = out.unionByName(m)
    return out.distinct()


def unit_scaled(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``value`` from 0 (the smallest) to 1 (the largest); null if all are equal."""
    ends = rows.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    return rows.crossJoin(F.broadcast(ends)).withColumn(name, F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo"))).drop("__lo", "__hi")  # one row of bounds


def mutual_nearest_vectors(a: DataFrame, b: DataFrame, threshold: float, a_block: int = 2048, b_block: int = 8192) -> DataFrame:
    """(i, j, score) where j (of ``b``: j, v) scores highest for i (of ``a``: i, u) by inner product and i for j, over ``threshold``; ties to the smaller id.

    Blocks of both sides meet as matrices; each gives the best of its rows and columns, of which the maxima over blocks count.
    """
    na, nb = max(1, -(-a.count() // a_block)), max(1, -(-b.count() // b_block))
    # a cogroup deals each side by its own types, and equal numbers of two types hash apart
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = a.withColumn("ab", own("i", na)).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(nb - 1))))
    right = b.withColumn("bb", own("j", nb)).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(na - 1))))

    def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"i": [], "j": [], "score": [], "row": []})
        if len(p) and len(q):
            p, q = p.sort_values("i"), q.sort_values("j")
            i, j = p["i"].to_numpy(), q["j"].to_numpy()
            # one term after another, as a sum in order gives them
            s = np.zeros((len(i), len(j)))
            for x, y in zip(np.array(p["u"].tolist(), float).T, np.array(q["v"].tolist(), float).T, strict=True):
                s += x[:, None] * y[None]
            r, k = s.argmax(1), s.argmax(0)
            out = pd.concat([pd.DataFrame({"i": i, "j": j[r], "score": s[np.arange(len(i)), r], "row": True}), pd.DataFrame({"i": i[k], "j": j, "score": s[k, np.arange(len(j))], "row": False})])
        return out.astype({"i": "int64", "j": "int64", "score": "float64", "row": "bool"})

    found = left.select("ab", "bb", "i", "u").groupBy("ab", "bb").cogroup(right.select("ab", "bb", "j", "v").groupBy("ab", "bb")).applyInPandas(meet, "i long, j long, score double, row boolean")
    rows = found.where("row").groupBy("i").agg(F.max(F.struct("score", (-F.col("j")).alias("n"))).alias("m")).select("i", (-F.col("m.n")).alias("j"), F.col("m.score").alias("score"))
    columns = found.where("not row").groupBy("j").agg(F.max(F.struct("score", (-F.col("i")).alias("n"))).alias("m")).select((-F.col("m.n")).alias("i"), "j")
    return rows.join(columns, ["i", "j"]).where(F.col("score") > threshold)


def moved_splats(splats: DataFrame, m: Sequence[float], q: Sequence[float], log_scale: float) -> DataFrame:
    """Splats (xyz, q0..q3, s0..s2 in logarithms) under a rotation ``m`` (9 numbers), its quaternion ``q`` on the left, and a change of scale."""
    from ..functions import geometry as G

    p = [F.col(x) for x in joins.AXES]
    new = {x: G.total(*[float(m[3 * i + j]) * p[j] for j in range(3)]) for i, x in enumerate(joins.AXES)}
    turned = G.quaternion_product([F.lit(float(x)) for x in q], [F.col(f"q{i}") for i in range(4)])
    return splats.withColumns(new | {f"q{i}": x for i, x in enumerate(turned)} | {f"s{i}": F.col(f"s{i}") + float(log_scale) for i in range(3)})


def control_substeps(controls: DataFrame, substeps: int) -> DataFrame:
    """(frame, step, pid, xyz): controllers on their way from each frame to the next, at (step + 1) / ``substeps``."""
    w = Window.partitionBy("pid").orderBy("frame")
    ahead = controls.select("frame", "pid", *joins.AXES, *[F.lead(a).over(w).alias("n" + a) for a in joins.AXES]).where("nx is not null")
    steps = ahead.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(substeps - 1))))
    t = (F.col("step") + 1) / F.lit(float(substeps))
    return steps.select("frame", "step", "pid", *[(F.col(a) + t * (F.col("n" + a) - F.col(a))).alias(a) for a in joins.AXES])


def normal_loss(predicted: Sequence[Column], truth: Sequence[Column], share: float = 0.1) -> Column:
    """Mean absolute difference of normals plus ``share`` of one minus their mean cosine (an aggregation)."""
    from ..functions import geometry as G

    each = [F.abs(p - t) for p, t in zip(predicted, truth, strict=True)]
    cosine = F.try_divide(G.dot(predicted, truth), G.norm(predicted) * G.norm(truth))
    return F.avg(G.total(*each)) / len(each) + share * (1.0 - F.avg(cosine))


def split_splats(splats: DataFrame, least_gradient: float, least_scale: float, n: int = 2, seed: int = 0) -> DataFrame:
    """Splats (gid, xyz, s0..s2, q0..q3, gradient) whose gradient is at least ``least_gradient`` and whose largest scale is over ``least_scale`` become
    ``n``, each at a normal draw along the splat's own axes and smaller by 0.8 n; ``copy`` counts them from 1, and is 0 for those that stay."""
    from ..functions import geometry as G

    big = (F.col("gradient") >= least_gradient) & (F.greatest("s0", "s1", "s2") > least_scale)
    r = G.quaternion_matrix([F.col(f"q{i}") for i in range(4)])
    drawn = splats.where(big).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumns({f"__d{i}": F.randn(seed + i) * F.col(f"s{i}") for i in range(3)})
    moved = {a: F.col(a) + G.total(*[r[3 * i + j] * F.col(f"__d{j}") for j in range(3)]) for i, a in enumerate(joins.AXES)}
    new = drawn.withColumns(moved).withColumns({f"s{i}": F.col(f"s{i}") / (0.8 * n) for i in range(3)}).drop("__d0", "__d1", "__d2")
    return splats.where(~big).withColumn("copy", F.lit(0)).unionByName(new.select(*splats.columns, "copy"))
