"""Votes of many neighbours by counts of blocks: points whose motion is sure to hold against all neighbours that may drop out.

If the agreeing neighbours that come later or belong to a set of points are no fewer than ``least`` and than all disagreeing ones, for each point of the set, then all of
the set hold: by induction, as those of the set that come before do. The set begins with the points for which this follows from counts of blocks, or from
their own counts, and loses those that need too many points outside of it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from . import neighbours
from .joins import AXES, radius_join

#: Rings around the mean motion in which a block's points are counted, up to half the radius.
RINGS = 8
MOVES = ("dx", "dy", "dz")


def _total(parts: Sequence[np.ndarray]) -> np.ndarray:
    return parts[0] + parts[1] + parts[2]


class Counts:
    """For each row of a block of askers a number of agreeing neighbours (``a``) and of others (``d``), itself counted."""

    def __init__(self, rows: pa.StructArray, r: float):
        self.rows, self.r = rows, r
        self.at, self.moved = neighbours._places(rows, AXES), neighbours._places(rows, MOVES)
        self.lo, self.hi = self.at.min(1)[:, None], self.at.max(1)[:, None]
        self.a, self.d = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)

    def add(self, rows: pa.StructArray, at: np.ndarray, ids: np.ndarray, spans: Sequence[tuple[int, int]]) -> None:
        """All neighbours among ``rows``, one by one."""
        limit, moved = self.r * self.r, neighbours._places(rows, MOVES)
        gap = _total([np.maximum(0.0, np.maximum(self.lo[i] - at[i], at[i] - self.hi[i])) ** 2 for i in range(3)])
        index = np.flatnonzero(gap <= limit * (1 + 1e-9))
        step = max(1, neighbours.PAIRS // len(self.rows))
        for begin in range(0, len(index), step):
            some = index[begin : begin + step]
            e = [self.at[i][:, None] - at[i][some][None, :] for i in range(3)]
            near = _total([x * x for x in e]) <= limit
            e = [self.moved[i][:, None] - moved[i][some][None, :] for i in range(3)]
            agree = (np.sqrt(_total([x * x for x in e])) < self.r / 2) & near
            a = agree.sum(1)
            self.a += a
            self.d += near.sum(1) - a


class Bounds(Counts):
    """At least so many agreeing neighbours and at most so many others, by blocks (lo, hi, counts by ring): blocks that lie within the radius count for the ones, blocks
    that reach into it for the others."""

    def __init__(self, rows: pa.StructArray, r: float, mean: Sequence[float]):
        super().__init__(rows, r)
        away = np.sqrt(_total([(self.moved[i] - mean[i]) ** 2 for i in range(3)]))
        # what is in rings before this one is surely less than r / 2 apart
        self.ring = np.clip(np.ceil((r / 2 - away) / (r / 2) * RINGS * (1 - 1e-9)) - 1, 0, RINGS).astype(int)

    def add(self, rows: pa.StructArray, at: np.ndarray, ids: np.ndarray, spans: Sequence[tuple[int, int]]) -> None:
        field = lambda c: rows.field(c).to_numpy(zero_copy_only=False)
        lo, hi = (np.stack([field(f"{k}{i}") for i in range(3)]) for k in ("lo", "hi"))
        limit = self.r * self.r
        some = np.flatnonzero(_total([np.maximum(0.0, np.maximum(self.lo[i] - hi[i], lo[i] - self.hi[i])) ** 2 for i in range(3)]) <= limit * (1 + 1e-9))
        if not len(some):
            return
        low, high = ([self.at[i][:, None] - x[i][some][None, :] for i in range(3)] for x in (lo, hi))
        reaches = _total([np.maximum(0.0, np.maximum(-p, q)) ** 2 for p, q in zip(low, high, strict=True)]) <= limit * (1 + 1e-9)
        inside = _total([np.maximum(np.abs(p), np.abs(q)) ** 2 for p, q in zip(low, high, strict=True)]) <= limit * (1 - 1e-9)
        sure = np.stack([np.zeros(len(some)), *(field(f"r{i}")[some] for i in range(1, RINGS + 1))], 1).astype(float)
        each = np.arange(len(self.rows))
        self.a += (inside.astype(float) @ sure)[each, self.ring].astype(np.int64)
        self.d += (reaches.astype(float) @ (field("n")[some].astype(float)[:, None] - sure))[each, self.ring].astype(np.int64)


def counted(askers: DataFrame, points: DataFrame, r: float, b_id: str, begin) -> DataFrame:
    """(frame, pid, xyz, dx, dy, dz, a, d) of blocks of ``askers``, by the search ``begin`` over blocks of ``points``."""
    row, held = askers.schema["members"].dataType.elementType, neighbours.HELD
    schema = T.StructType([*row.fields, T.StructField("a", T.LongType()), T.StructField("d", T.LongType())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, now in neighbours.searched(batches, begin, AXES, b_id, held):
            yield pa.RecordBatch.from_arrays([*now.rows.flatten(), pa.array(now.a), pa.array(now.d)], schema.fieldNames())

    pairs = neighbours.unit_pairs(askers, points, ["__by0"], 3, r * r)
    return neighbours.in_units(askers, points, pairs, ["__by0"]).mapInArrow(search, schema)


def sure(moves: DataFrame, r: float, least: int) -> DataFrame:
    """(frame, pid) of points (frame, pid, xyz, dx, dy, dz) that a scan by pid is sure to find consistent; those that are not told of may be, too."""
    key, columns = ["frame", "pid"], ["frame", "pid", *AXES, *MOVES]
    box = neighbours.common_box(moves, moves, AXES)
    if box is None:
        return moves.select(*key).limit(0)
    blocks = neighbours.blocks(moves.select(*columns), "pid", AXES, ["frame"], box)
    mean = [x or 0.0 for x in moves.agg(*[F.avg(c) for c in MOVES]).first()]
    away = lambda m: F.sqrt(sum(((m[c] - x) * (m[c] - x) for c, x in zip(MOVES, mean, strict=True)), F.lit(0.0)))
    rings = [F.size(F.filter("members", lambda m, i=i: away(m) <= r / 2 / RINGS * i)).cast("long").alias(f"r{i}") for i in range(1, RINGS + 1)]
    boxes = [f"{k}{i}" for i in range(3) for k in ("lo", "hi")]
    middle = [((F.col(f"lo{i}") + F.col(f"hi{i}")) / 2).alias(c) for i, c in enumerate(AXES)]
    summary = blocks.select("__by0", "node", "n", *boxes, F.array(F.struct("node", *middle, *boxes, "n", *rings)).alias("members"))
    summary = scratch.store(summary, "summary")
    margin = F.least(F.col("a") - F.col("d"), F.col("a") - least)
    first = scratch.store(counted(blocks, summary, r, "node", lambda rows: Bounds(rows, r, mean)).select(*columns, margin.alias("margin")), "bounds")
    rest = neighbours.blocks(first.where("margin < 0").select(*columns), "pid", AXES, ["frame"], box)
    own = scratch.store(counted(rest, blocks, r, "pid", lambda rows: Counts(rows, r)).select(*columns, margin.alias("margin")), "counts")
    strong, weak = first.where("margin >= 0").unionByName(own.where("margin >= 0")), own.where("margin < 0").select(*columns)
    # what comes before and may drop out, as long as that takes more from the set
    agree = F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in MOVES), F.lit(0.0))) < r / 2
    while True:
        lost = radius_join(weak, strong, r, by=["frame"]).where((F.col("a_pid") < F.col("b_pid")) & agree).groupBy(*[F.col("b_" + c).alias(c) for c in (*columns, "margin")]).agg(F.count("*").alias("lost"))
        fallen = scratch.store(lost.where("lost > margin").select(*columns).join(weak.select(*key), key, "left_anti"), "fallen")
        if fallen.isEmpty():
            return strong.select(*key).join(weak.select(*key), key, "left_anti")
        weak = scratch.store(weak.unionByName(fallen), "weak")
