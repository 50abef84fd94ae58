"""Screen-space rasterisation of splats: preparation, tiles, depth order, blending."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import geometry as G
from . import joins


def prepared(splats: DataFrame, fx: float, fy: float, cx: float, cy: float, tan_x: float, tan_y: float, near: float = 0.2) -> DataFrame:
    """(gid, u, v, depth, radius, ca, cb, cc, opacity, colour) of splats in view space (gid, xyz, s0..s2, q0..q3, opacity, colour): pixel, radius and
    the inverse of the covariance on screen; those nearer than ``near`` and those without an area go."""
    p = tuple(F.col(a) for a in joins.AXES)
    cov = G.covariance([F.col(f"s{i}") for i in range(3)], G.quaternion_matrix([F.col(f"q{i}") for i in range(4)]))
    rows = splats.where(p[2] > near)
    a, b, c = G.screen_covariance(p, cov, fx, fy, tan_x, tan_y)
    rows = rows.select("gid", (fx * p[0] / p[2] + cx).alias("u"), (fy * p[1] / p[2] + cy).alias("v"), p[2].alias("depth"), a.alias("a"), b.alias("b"), c.alias("c"), "opacity", "colour")
    # written down: filters on what follows would be pushed down into copies of all this
    rows = scratch.store(rows, "splats")
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    rows = rows.withColumn("det", det).where("det > 0").withColumn("radius", G.screen_radius(F.col("a"), F.col("b"), F.col("c")))
    return rows.select("gid", "u", "v", "depth", "radius", (F.col("c") / F.col("det")).alias("ca"), (-F.col("b") / F.col("det")).alias("cb"), (F.col("a") / F.col("det")).alias("cc"), "opacity", "colour")


def blend(rows: pd.DataFrame, x0: int, y0: int, width: int, height: int, tile: int, background: float) -> pd.DataFrame:
    """Pixels (u, v, colour, left) of one tile from its splats in the order of depth; pixels that are full take no more."""
    x, y = np.meshgrid(np.arange(x0, min(x0 + tile, width)), np.arange(y0, min(y0 + tile, height)))
    colour, left, done = np.zeros(x.shape), np.ones(x.shape), np.zeros(x.shape, bool)
    for s in rows.itertuples():
        dx, dy = s.u - x, s.v - y
        power = -0.5 * (s.ca * dx * dx + s.cc * dy * dy) - s.cb * dx * dy
        alpha = np.minimum(0.99, s.opacity * np.exp(np.minimum(power, 0)))
        on = ~done & (power <= 0) & (alpha >= 1 / 255)
        after = left * (1 - alpha)
        ends = on & (after < 1e-4)
        on &= ~ends
        colour = np.where(on, colour + s.colour * alpha * left, colour)
        left = np.where(on, after, left)
        done |= ends
        if done.all():
            break
    return pd.DataFrame({"u": x.ravel(), "v": y.ravel(), "colour": (colour + left * background).ravel(), "left": left.ravel()})


def rasterise(prepared_splats: DataFrame, width: int, height: int, background: float = 0.0, tile: int = 16, by: Sequence[str] = ()) -> DataFrame:
    """(by, u, v, colour, left) of every pixel of each view: splats meet the tiles that they overlap, and a tile blends its own in the order of (depth, gid)."""
    across, kinds = -(-width // tile), dict(prepared_splats.dtypes)
    tiles = joins.tile_join(prepared_splats, width, height, tile)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(key[-1])
        out = blend(pdf.sort_values(["depth", "gid"]), at % across * tile, at // across * tile, width, height, tile, background)
        for name, value in zip(by, key, strict=False):
            out.insert(0, name, value)
        return out

    schema = ", ".join([*[f"{c} {kinds[c]}" for c in by], "u long, v long, colour double, left double"])
    drawn = tiles.groupBy(*by, "tile").applyInPandas(run, schema)
    spark = prepared_splats.sparkSession
    grid = spark.range(width * height).select((F.col("id") % width).alias("u"), F.floor(F.col("id") / width).alias("v"))
    views = prepared_splats.select(*by).distinct() if by else None
    every = grid if views is None else views.crossJoin(F.broadcast(grid))  # the pixels of an image, for each view
    empty: list[Column] = [F.coalesce("colour", F.lit(float(background))).alias("colour"), F.coalesce("left", F.lit(1.0)).alias("left")]
    return every.join(drawn, [*by, "u", "v"], "left").select(*by, "u", "v", *empty)
