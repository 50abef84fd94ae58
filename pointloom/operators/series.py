"""Operators over time: gaps, smoothing, resampling, synchronisation, hold-out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from . import filters


def change_points(tracks: DataFrame, axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """(frame, moved, change): the summed displacement since the frame before; frame 0 always is a change."""
    w = Window.partitionBy("pid").orderBy("frame")
    d = [F.col(c) - F.lag(c).over(w) for c in axes]
    step = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    per = tracks.select("frame", step.alias("s")).groupBy("frame").agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("moved"))
    return per.select("frame", "moved", ((F.col("frame") == 0) | (F.col("moved") != 0)).alias("change"))


def lerp_fill(rows: DataFrame, key: Sequence[str], order: str, value: Sequence[str], known: Column) -> DataFrame:
    """``value`` between known rows by linear interpolation over ``order``; rows before the first and after the last known one stay. The known rows before
    and after are carried from range to range, so a key may have any number of rows."""
    held = lambda t: F.when(F.col("__k"), F.struct(t.alias("t"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(value)]))
    out = rows.withColumn("__k", F.coalesce(known, F.lit(False))).withColumn("__o", -F.col(order))
    out = filters.carried(out.withColumn("__v", held(F.col(order))), key, [order], "__v", "__b")
    out = filters.carried(out.withColumn("__w", held(F.col("__o"))), key, ["__o"], "__w", "__f")
    share = (F.col(order) - F.col("__b.t")) / (-F.col("__f.t") - F.col("__b.t"))
    between = ~F.col("__k") & F.col("__b").isNotNull() & F.col("__f").isNotNull()
    filled = [F.when(between, F.col(f"__b.v{i}") + F.when(between, share) * (F.col(f"__f.v{i}") - F.col(f"__b.v{i}"))).otherwise(F.col(c)).alias(c) for i, c in enumerate(value)]
    return out.select(*[c for c in rows.columns if c not in value], *filled)


def renormalised(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """``names`` divided by their common length, as quaternions are after interpolation; null where it is 0."""
    n = F.sqrt(sum((F.col(c) * F.col(c) for c in names), F.lit(0.0)))
    return rows.withColumn("__n", n).withColumns({c: F.try_divide(F.col(c), F.col("__n")) for c in names}).drop("__n")


def stage_report(rows: DataFrame, stage: str, order: Sequence[str], value: str, width: int = 10, every: int = 10) -> DataFrame:
    """(stage, nth, mean, share): the sliding mean of each stage at each ``every``-th row, and its part of all stages' means there."""
    means = sliding_mean(rows, [stage], order, value, width, every).select(stage, "nth", "mean")
    total = means.groupBy("nth").agg(F.sum("mean").alias("__total"))
    return means.join(total, "nth").select(stage, "nth", "mean", F.try_divide("mean", "__total").alias("share"))


def apply_frames(rows: DataFrame, transform, schema: str, key: Sequence[str] = ("frame",)) -> DataFrame:
    """A user's ``transform`` (a pandas frame to a pandas frame of ``schema``) of each frame."""
    return rows.groupBy(*key).applyInPandas(transform, schema)


def moving_average(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, alpha: float, start: float | None = 0.0) -> DataFrame:
    """(key, n, ema): the last value of alpha * x + (1 - alpha) * before, from ``start``, or from the first value if it is None.

    Series are cut to ranges; each range's part is a weighted sum of what differs from its first value, and the parts of a key, one for each range,
    are put together in order.
    """
    dealt = filters.in_ranges(rows.select(*key, *order, F.col(value).cast("double").alias("__x"), F.monotonically_increasing_id().alias("__tie")), [*key, *order, "__tie"])
    back = Window.partitionBy(*key, "__part").orderBy(*[F.desc(c) for c in (*order, "__tie")])
    own = Window.partitionBy(*key, "__part").orderBy(*order, "__tie")
    based = dealt.withColumn("__f", F.first("__x").over(own))
    weighted = based.withColumn("__w", F.pow(F.lit(1.0 - alpha), F.row_number().over(back) - 1) * alpha * (F.col("__x") - F.col("__f")))
    parts = weighted.groupBy(*key, "__part").agg(F.count("*").alias("n"), F.sum("__w").alias("v"), F.first("__f").alias("f"))
    series = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("__part", "n", "v", "f"))).alias("__ps"), F.sum("n").alias("n"))
    begin = F.lit(float(start)) if start is not None else F.col("__ps")[0]["f"]
    return series.select(*key, "n", F.aggregate("__ps", begin, lambda a, p: p["f"] + p["v"] + F.pow(F.lit(1.0 - alpha), p["n"]) * (a - p["f"])).alias("ema"))


def sliding_mean(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: str, width: int = 10, every: int = 10) -> DataFrame:
    """The mean of the last ``width`` rows, at each ``every``-th row of a key (``nth`` from 1): the row's columns with ``nth`` and ``mean``.

    Rows are numbered over ranges, and each goes to the few reports whose window it lies in, which are summed partially; so no task holds a key."""
    ranked = scratch.store(filters.number_rows(rows.drop("nth", "mean"), [*key, *order], "__rank"), "ranked")
    names = [c for c in ranked.columns if c != "__rank"]
    first = ranked.groupBy(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(key)]).agg(F.min("__rank").alias("__first"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(key)])
    at = ranked.join(first, same).withColumn("__nth", F.col("__rank") - F.col("__first") + 1)
    begin, end = F.ceil(F.col("__nth") / every) * every, F.col("__nth") + (width - 1)
    reports = F.when(begin <= end, F.sequence(begin, end, F.lit(every).cast("long"))).otherwise(F.array().cast("array<long>"))
    own = F.when(F.col("__nth") == F.col("__at"), F.struct(*names))
    means = at.withColumn("__at", F.explode(reports)).groupBy(*[f"__k{i}" for i in range(len(key))], "__at").agg(F.avg(value).alias("mean"), F.any_value(own, F.lit(True)).alias("__row"))
    return means.where(F.col("__row").isNotNull()).select("__row.*", F.col("__at").alias("nth"), "mean")


def resample(samples: DataFrame, key: Sequence[str], time: str, order: Sequence[str], dt: float, start: float = 0.0, eps: float = 1e-5) -> DataFrame:
    """Samples on a fixed grid, ``step`` from 0: step g holds the first sample whose own step is at least g, so gaps are filled by the later
    sample, of several in one step the first counts, and those before ``start`` are dropped.

    The first sample of each step is found by a partial aggregation; only these meet, in ranges, to learn the step before theirs.
    """
    rows = samples.withColumn("__g", F.floor((F.col(time) - start) / dt + eps)).where("__g >= 0")
    first = rows.groupBy(*key, "__g").agg(F.min(F.struct(time, *order, F.struct(*samples.columns).alias("__row"))).alias("__m")).select(*key, "__g", F.col("__m.__row").alias("__row"))
    met = filters.carried(first, key, ["__g"], "__g", "__p", inclusive=False).withColumn("__p", F.coalesce("__p", F.lit(-1).cast("long")))
    return met.select("__row.*", F.explode(F.sequence(F.col("__p") + 1, F.col("__g"))).alias("step"))


def align(samples: DataFrame, steps: DataFrame, key: Sequence[str], value: Sequence[str]) -> DataFrame:
    """Resampled rows (key, step, value) at the asked (key, step); steps after the last repeat it, surplus ones are left out."""
    packed = F.struct(F.col("step").alias("__s"), *value)
    both = steps.select(*key, "step", F.lit(True).alias("__asked")).join(samples.select(*key, "step", packed.alias("__v")), [*key, "step"], "full")
    held = filters.carried(both.distinct(), key, ["step"], "__v", "__last")
    return held.where("__asked").select(*key, "step", *[F.col(f"__last.{c}").alias(c) for c in value])


def last_k(samples: DataFrame, key: Sequence[str], time: str, tie: str, k: int, salts: int = 64) -> DataFrame:
    """The ``k`` newest of each key, ``nth`` from 1 for the newest. Parts of a key, by a hash, keep their ``k`` newest before these meet."""
    newest = [F.desc(time), F.desc(tie)]
    local = samples.withColumn("__salt", F.pmod(F.xxhash64(time, tie), F.lit(salts)))
    local = local.withColumn("nth", F.row_number().over(Window.partitionBy(*key, "__salt").orderBy(*newest))).where(F.col("nth") <= k).drop("__salt")
    return local.withColumn("nth", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where(F.col("nth") <= k)


def synchronise(samples: DataFrame, key: str, time: str, tie: str, k: int, tolerance: float) -> DataFrame:
    """For each key, of its ``k`` newest samples the one closest to the oldest of all keys' newest times (the earlier on ties); null values
    if none is within ``tolerance``."""
    recent = last_k(samples, [key], time, tie, k)
    target = recent.where("nth = 1").agg(F.min(time).alias("target"))
    near = recent.crossJoin(F.broadcast(target))  # one row
    gap = F.abs(F.col(time) - F.col("target"))
    best = near.groupBy(key).agg(F.min(F.struct(gap.alias("gap"), F.col(time).alias("t"), F.col(tie).alias("id"))).alias("b"), F.first("target").alias("target"))
    ok = F.col("b.gap") < tolerance
    return best.select(key, "target", F.when(ok, F.col("b.id")).alias(tie), F.when(ok, F.col("b.t")).alias(time))


def hold_out(rows: DataFrame, order: Sequence[str], every: int = 8) -> DataFrame:
    """``test``: each ``every``-th row by ``order``, from the first."""
    return filters.number_rows(rows, order, "nth").withColumn("test", F.col("nth") % every == 0)


def split(frames: DataFrame, share: float = 0.7) -> DataFrame:
    """(case, frame_len, train_lo, train_hi, test_lo, test_hi), half-open, from (case, frame)."""
    n = frames.groupBy("case").agg(F.count_distinct("frame").alias("frame_len"))
    cut = (F.col("frame_len") * share).cast("int").cast("long")
    return n.select("case", "frame_len", F.lit(0).cast("long").alias("train_lo"), cut.alias("train_hi"), cut.alias("test_lo"), F.col("frame_len").alias("test_hi"))


def sessions(events: DataFrame, key: Sequence[str], time: str, gap: str) -> DataFrame:
    """Spans of activity that pauses of ``gap`` end."""
    return events.groupBy(*key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n")).select(*key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
