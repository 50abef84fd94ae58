"""Masks, outlier removal, de-duplication and motion filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import AXES, radius_join


def radius_outliers(points: DataFrame, r: float, least: int, keep: bool = True) -> DataFrame:
    """Points with more than ``least`` points within ``r`` (itself counted), or the others; with ``n``."""
    n = radius_join(points.select("pid", *AXES), points.select("pid", *AXES), r).groupBy(F.col("a_pid").alias("pid")).agg(F.count("*").alias("n"))
    return points.join(n, "pid").where((F.col("n") > least) if keep else (F.col("n") <= least))


def drop_removed(pixels: DataFrame, removed: DataFrame, key: Sequence[str], compat: bool = False) -> DataFrame:
    """``pixels`` without the removed points. ``compat``: also without any pixel that shares one coordinate with a removed point."""
    if not compat:
        return pixels.join(removed.select(*key), list(key), "left_anti")
    for c in AXES:
        pixels = pixels.join(removed.select(c).distinct(), c, "left_anti")
    return pixels


def distinct_first(points: DataFrame, axes: Sequence[str] = AXES, order: str = "pid") -> DataFrame:
    """One row for each position, the first by ``order``; ``new_pid`` numbers them by position from 0.

    The number is a rank over all rows: per-prefix counts and ranks within a range of positions, so no task sorts everything.
    """
    first = points.withColumn("__n", F.row_number().over(Window.partitionBy(*axes).orderBy(order))).where("__n = 1").drop("__n")
    return number_rows(first, list(axes), "new_pid")


def number_rows(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their 0-based place by ``order`` (a total order): ranges are numbered each on its own, then shifted by the sizes before."""
    from .. import scratch

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.store(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__part"], r["n"]) for r in dealt.groupBy("__part").agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p, n in sizes:
        before.append((p, total))
        total += n
    shift = rows.sparkSession.createDataFrame(before, "__part int, __before long")
    w = Window.partitionBy("__part").orderBy(*order)
    return dealt.join(F.broadcast(shift), "__part").withColumn(name, F.col("__before") + F.row_number().over(w) - 1).drop("__part", "__before")


def in_ranges(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows``, written down in ranges by ``order``, with the number of the range as ``__part``: a key with very many rows lies in several."""
    from .. import scratch

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return scratch.store(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")


def carried(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, name: str, inclusive: bool = True) -> DataFrame:
    """``rows`` with the largest ``value`` of their key up to them by ``order`` (a total order within the key; nulls are passed over), or before
    them if not ``inclusive``. Ranges are judged apart; what a key's earlier ranges bring is added from one row for each range that it goes on from."""
    dealt = in_ranges(rows, [*key, *order])
    ends = dealt.groupBy(*key, "__part").agg(F.max(value).alias("__m"))
    span = ends.groupBy(*key).agg(F.count("*").alias("__n"), F.min("__part").alias("__first")).where("__n > 1")  # at most as many as ranges
    w = Window.partitionBy(*key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.join(F.broadcast(span.select(*key)), list(key), "left_semi").withColumn("__before", F.max("__m").over(w)).drop("__m")
    local = Window.partitionBy(*key, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = dealt.withColumn("__local", F.max(value).over(local)).join(F.broadcast(before), [*key, "__part"], "left")
    both = F.array_max(F.array("__local", "__before"))
    return out.withColumn(name, both).select(*rows.columns, name)


def quantile(rows: DataFrame, value: str, q: float = 0.5) -> float | None:
    """The exact quantile (between two values by linear interpolation), nulls left out; None without values. Values are ranked by ranges, and
    the two that stand around the quantile reach the driver."""
    ranked = number_rows(rows.where(F.col(value).isNotNull()).select(value, F.monotonically_increasing_id().alias("__tie")), [value, "__tie"], "at")
    n = ranked.count()
    if not n:
        return None
    at = q * (n - 1)
    lo = int(at)
    two = {r["at"]: float(r[value]) for r in ranked.where(F.col("at").isin(lo, min(lo + 1, n - 1))).select("at", value).collect()}
    return two[lo] + (at - lo) * (two[min(lo + 1, n - 1)] - two[lo])


def voxel_first(points: DataFrame, size: float, priority: str, order: Sequence[str]) -> DataFrame:
    """The first point by (priority, order) of each cube of side ``size``, counted from the smallest coordinates of all points."""
    low = points.agg(*[F.min(c).alias(c) for c in AXES])
    cells = points.crossJoin(F.broadcast(low.select(*[F.col(c).alias("__" + c) for c in AXES])))  # one row
    keys = [F.floor((F.col(c) - F.col("__" + c)) / size).alias("v" + c) for c in AXES]
    best = cells.select(*points.columns, *keys).withColumn("__n", F.row_number().over(Window.partitionBy("vx", "vy", "vz").orderBy(priority, *order)))
    return best.where("__n = 1").drop("__n")


def visible_every_frame(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("pid").agg(F.every("visible").alias("always"))


def forward_motion(tracks: DataFrame) -> DataFrame:
    """dx, dy, dz to the next frame (0 in the last) and motion_valid: visible here and there."""
    w = Window.partitionBy("pid").orderBy("frame")
    moved = [F.coalesce(F.lead(c).over(w) - F.col(c), F.lit(0.0)).alias("d" + c) for c in AXES]
    return tracks.select("*", *moved, (F.col("visible") & F.coalesce(F.lead("visible").over(w), F.lit(False))).alias("motion_valid"))


def motion_filter_snapshot(tracks: DataFrame, r: float, least: int = 5) -> DataFrame:
    """Tracks with ``consistent``: among the valid points within ``r`` in the frame (itself counted) there are at least ``least``, and at
    least half moved within ``r`` / 2 of it. All points are judged by the same state."""
    m = forward_motion(tracks).where("motion_valid").select("frame", "pid", *AXES, "dx", "dy", "dz")
    pairs = radius_join(m, m, r, by=["frame"])
    close = F.sqrt(sum(((F.col(f"a_d{c}") - F.col(f"b_d{c}")) * (F.col(f"a_d{c}") - F.col(f"b_d{c}")) for c in AXES), F.lit(0.0))) < r / 2
    votes = pairs.groupBy(F.col("a_frame").alias("frame"), F.col("a_pid").alias("pid")).agg(F.count("*").alias("n"), F.count_if(close).alias("near"))
    return votes.select("frame", "pid", "n", "near", ((F.col("n") >= least) & (2 * F.col("near") >= F.col("n"))).alias("consistent"))


def motion_filter_sequential(tracks: DataFrame, r: float, least: int = 5, sticky: bool = False, group: Sequence[str] = ("frame",)) -> DataFrame:
    """(frame, pid, consistent) where a point found inconsistent no longer counts for later ones (by pid). ``sticky``: nor in later frames;
    then ``group`` must keep a case's frames together. What isn't sticky is settled in rounds (see ``settled_in_rounds``), with no frame in one task."""
    if not sticky:
        valid = forward_motion(tracks).select("frame", "pid", *AXES, "dx", "dy", "dz", "motion_valid")
        ok = settled_in_rounds(valid.where("motion_valid").drop("motion_valid"), r, least)[0]
        return valid.select("frame", "pid").join(ok, ["frame", "pid"], "left").select("frame", "pid", F.coalesce("consistent", F.lit(False)).alias("consistent"))
    m = forward_motion(tracks).select(*dict.fromkeys([*group, "frame", "pid", *AXES, "dx", "dy", "dz", "motion_valid"]))

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        out, lost = [], set()
        for _, f in pdf.sort_values(["frame", "pid"]).groupby("frame", sort=True):
            p, d, ids = f[list(AXES)].to_numpy(), f[["dx", "dy", "dz"]].to_numpy(), f["pid"].to_numpy()
            ok = f["motion_valid"].to_numpy().copy()
            if sticky:
                ok &= ~np.isin(ids, list(lost))
            for i in np.flatnonzero(ok):
                near = ok & (((p - p[i]) ** 2).sum(1) <= r * r)
                agree = np.sqrt(((d[near] - d[i]) ** 2).sum(1)) < r / 2
                if near.sum() < least or 2 * agree.sum() < near.sum():
                    ok[i] = False
                    lost.add(ids[i])
            out.append(pd.DataFrame({"frame": f["frame"], "pid": ids, "consistent": ok}))
        return pd.concat(out)

    return m.groupBy(*group).applyInPandas(scan, "frame int, pid long, consistent boolean")


def settled_in_rounds(moves: DataFrame, r: float, least: int) -> tuple[DataFrame, int]:
    """(frame, pid, consistent) of points (frame, pid, xyz, dx, dy, dz) as a scan by pid gives it, and the number of rounds.

    Most points are settled by counts of whole blocks of points (see ``votes.sure``); pairs are made only of the others. Such a
    point counts its neighbours that come later, and those before it that were found consistent. It is settled as soon as the neighbours that aren't
    settled yet can't change its vote: if it holds though all of those that agree drop out, or fails though only those that disagree do. The first open point of
    any neighbourhood always is, so each round settles some; where ids are in no order of space, a few rounds settle all.
    """
    from .. import scratch
    from . import votes

    key = ["frame", "pid"]
    moves = scratch.store(moves.select(*key, *AXES, "dx", "dy", "dz"), "moves")
    held = votes.sure(moves, r, least)
    some = scratch.store(moves.join(held, key, "left_anti"), "open")
    agree = F.sqrt(sum(((F.col(f"a_d{c}") - F.col(f"b_d{c}")) * (F.col(f"a_d{c}") - F.col(f"b_d{c}")) for c in AXES), F.lit(0.0))) < r / 2
    # what comes later or is sure to hold counts at once, and what is open and comes before has to be waited for
    told = radius_join(some, moves, r, by=["frame"]).where("a_pid <> b_pid").groupBy(F.col("a_frame").alias("frame"), F.col("a_pid").alias("pid")).agg(F.count("*").alias("n"), F.count_if(agree).alias("a"))
    pairs = radius_join(some, some, r, by=["frame"]).where("b_pid < a_pid")
    edges = scratch.store(pairs.select(F.col("a_frame").alias("frame"), F.col("a_pid").alias("pid"), F.col("b_pid").alias("other"), agree.cast("int").alias("agree")), "votes")
    before = edges.groupBy(*key).agg(F.count("*").alias("bn"), F.sum("agree").alias("ba"))
    count = lambda x: F.coalesce(x, F.lit(0).cast("long"))
    nodes = some.select(*key).join(told, key, "left").join(before, key, "left").select(*key, (count("n") - count("bn") + 1).alias("n"), (count("a") - count("ba") + 1).alias("a"))
    nodes, done, rounds = scratch.store(nodes, "nodes"), [held.select(*key, F.lit(True).alias("consistent"))], 0
    while not nodes.isEmpty():
        rounds += 1
        waits = edges.groupBy(*key).agg(F.sum("agree").alias("ua"), (F.count("*") - F.sum("agree")).alias("ud"))
        zero = F.lit(0).cast("long")
        seen = nodes.join(waits, key, "left").withColumns({"ua": F.coalesce("ua", zero), "ud": F.coalesce("ud", zero)})
        holds = (F.col("n") >= least) & (2 * F.col("a") - F.col("n") - F.col("ud") >= 0)
        fails = (F.col("n") + F.col("ua") + F.col("ud") < least) | (2 * F.col("a") - F.col("n") + F.col("ua") < 0)
        judged = scratch.store(seen.withColumn("consistent", F.when(holds, True).when(fails, False)), "judged")
        new = judged.where(F.col("consistent").isNotNull()).select(*key, "consistent")
        done.append(new)
        left = judged.where(F.col("consistent").isNull()).select(*key, "n", "a")
        told = new.select("frame", F.col("pid").alias("other"), "consistent")
        edges = scratch.store(edges.join(left.select(*key), key, "left_semi").join(told, ["frame", "other"], "left"), "edges")
        gained = edges.where("consistent").groupBy(*key).agg(F.count("*").alias("gn"), F.sum("agree").alias("ga"))
        nodes = scratch.store(left.join(gained, key, "left").select(*key, (F.col("n") + F.coalesce("gn", zero)).alias("n"), (F.col("a") + F.coalesce("ga", zero)).alias("a")), "nodes")
        edges = edges.where(F.col("consistent").isNull()).drop("consistent")
    return reduce(DataFrame.unionByName, done), rounds


def all_views_mask(points: DataFrame, cameras: DataFrame, mask: DataFrame) -> DataFrame:
    """Points whose pixel lies in the mask (cam, u, v) in every view; cameras are joined by broadcast, a few fixed rows."""
    from ..functions import geometry as G

    seen = points.crossJoin(F.broadcast(cameras))
    local = G.inverse_rigid(tuple(F.col(c) for c in AXES), [F.col(f"m{i}") for i in range(12)])
    seen = seen.select("pid", "cam", *[c.alias("l" + n) for c, n in zip(local, AXES, strict=True)], "fx", "fy", "cx", "cy")
    u, v = G.project(tuple(F.col("l" + c) for c in AXES), F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"))
    hits = seen.select("pid", "cam", u.alias("u"), v.alias("v")).join(mask.select("cam", "u", "v", F.lit(True).alias("hit")).distinct(), ["cam", "u", "v"], "left")
    return hits.groupBy("pid").agg(F.count_if("hit").alias("hits"), F.count("*").alias("views"))


def one_object(labels: Column, controller: str = "hand") -> Column:
    """The only label that isn't the controller; an error if there are several."""
    names = F.filter(labels, lambda x: x != controller)
    return F.when(F.size(names) > 1, F.raise_error(F.lit("more than one object"))).otherwise(F.get(names, F.lit(0)))


def prune(splats: DataFrame, least_opacity: float, most_screen: float | None, most_world: float) -> DataFrame:
    """Splats that aren't faint, too big on screen or too big in the world."""
    bad = (F.col("opacity") < least_opacity) | (F.col("scale") > most_world)
    if most_screen is not None:
        bad = bad | (F.col("radius") > most_screen)
    return splats.where(~bad)


def farthest_points(points: DataFrame, k: int = 30, group: Sequence[str] = ()) -> DataFrame:
    """``k`` points of each group, each as far as possible from those before it; the first is the smallest id. At least ``k`` are needed."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < k:
            raise ValueError(f"{len(pdf)} points; {k} are needed")
        pdf = pdf.sort_values("pid").reset_index(drop=True)
        p = pdf[list(AXES)].to_numpy()
        chosen, d = [0], ((p - p[0]) ** 2).sum(1)
        while len(chosen) < k:
            chosen.append(int(d.argmax()))
            d = np.minimum(d, ((p - p[chosen[-1]]) ** 2).sum(1))
        return pdf.iloc[chosen].assign(nth=np.arange(k))

    keys = list(group)
    return points.select(*keys, "pid", *AXES).groupBy(*keys).applyInPandas(pick, ", ".join([f"{c} {t}" for c, t in points.select(*keys, "pid", *AXES).dtypes] + ["nth int"]))


def prefix_sum(rows: DataFrame, order: Sequence[str], value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` by ``order`` (a total order), over ranges that are summed apart and shifted by the sums before.
    Whole numbers are summed as such."""
    from .. import scratch

    whole = isinstance(rows.schema[value].dataType, T.IntegralType)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.store(rows.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()), "ranges")
    before, total = [], 0 if whole else 0.0
    for r in dealt.groupBy("__part").agg(F.sum(value).cast("long" if whole else "double").alias("s")).orderBy("__part").collect():
        before.append((r["__part"], total))
        total += r["s"] or 0
    shift = rows.sparkSession.createDataFrame(before, f"__part int, __before {'long' if whole else 'double'}")
    w = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(F.broadcast(shift), "__part").withColumn(name, (F.col("__before") + F.sum(value).over(w)).cast(rows.schema[value].dataType)).drop("__part", "__before")
