"""k-nearest neighbours over blocks of a space-filling curve.

Points are put in the order of a Hilbert curve, which makes no leaps, and cut into blocks of bounded size, so that a block is small in space where points are dense and large
where they are rare.
Over the blocks' boxes stands a tree of fixed fan-out. A block of askers is met with the few blocks around its place on the curve for its askers' k-th distances; with
that bound it goes down the tree. Blocks of askers that follow each other search in one task as a unit, so that a block which several of them ask is sent once, and of it
only the points in the box that they look at; a table that asks itself isn't sent to its own unit. Each asker's own k-th distance rejects the blocks, and points, beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import scratch
from . import filters

#: Points of a block, children of a node, bits of each axis of the code, blocks whose points are kept while a unit is searched, blocks of askers in a unit.
BLOCK, FAN, BITS, HELD, UNIT = 64, 32, 20, 1024, 64
#: Pairs of an asker and a point whose distances are held at once.
PAIRS = 1 << 18


def hilbert(cells: Sequence[np.ndarray], bits: int = BITS) -> np.ndarray:
    """The places of cells (whole numbers of ``bits`` bits, an array for each axis) on a Hilbert curve, on which those that follow each other touch (Skilling's transform)."""
    x = [np.array(c, np.int64) for c in cells]
    for bit in range(bits - 1, 0, -1):
        low = (1 << bit) - 1
        for i in range(len(x)):
            on = (x[i] >> bit) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[i] = x[i] ^ swap if i else x[i]
            x[0] = x[0] ^ np.where(on, low, swap)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= ((x[-1] >> bit) & 1) * ((1 << bit) - 1)
    out = np.zeros_like(turn)
    for bit in range(bits):
        for i, c in enumerate(x):
            out |= (((c ^ turn) >> bit) & 1) << (len(x) * bit + len(x) - 1 - i)
    return out


def blocks(points: DataFrame, id_column: str, axes: Sequence[str], by: Sequence[str], bounds: dict[str, tuple[float, float]], size: int = BLOCK) -> DataFrame:
    """(by, node, head, members, n, lo_*, hi_*): blocks of at most ``size`` points that follow each other on a Hilbert curve, from the place ``head`` on, and their boxes. A
    block holds points of one ``by`` group and of one range of the order. Points with a null or NaN coordinate, or a null in ``by``, are left out."""
    bits = min(BITS, 62 // len(axes))
    cell = lambda c: F.floor((F.col(c).cast("double") - bounds[c][0]) / ((bounds[c][1] - bounds[c][0]) or 1.0) * ((1 << bits) - 1)).cast("long")
    good = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in axes] + [F.col(c).isNotNull() for c in by])
    groups, head = [f"__by{i}" for i in range(len(by))], F.pandas_udf(lambda *x: pd.Series(hilbert(x, bits)), "long")
    rows = points.where(good).select(F.struct(*points.columns).alias("__row"), *[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], head(*[cell(c) for c in axes]).alias("head"))
    parts, order, axes = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*groups, "head", F.col("__row")[id_column]], list(axes)
    boxes = [f"{k}{i}" for i in range(len(axes)) for k in ("lo", "hi")]
    schema = T.StructType([*(rows.schema[g] for g in groups), T.StructField("__at", T.LongType()), rows.schema["head"], T.StructField("members", T.ArrayType(rows.schema["__row"].dataType)), T.StructField("n", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in boxes)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, at = None, 0

        def emit(t: pa.Table, starts: np.ndarray, end: int) -> pa.RecordBatch:
            nonlocal at
            t = t.slice(0, end).combine_chunks()
            members = t.column("__row").combine_chunks()
            members = members.chunk(0) if isinstance(members, pa.ChunkedArray) else members
            ends, first = np.append(starts[1:], end), t.take(pa.array(starts))
            box = [f.reduceat(x, starts) for x in _places(members, axes) for f in (np.minimum, np.maximum)]
            offsets, n = pa.array(np.append(starts, end), pa.int32()), len(starts)
            at += n
            columns = [*(first.column(g).combine_chunks() for g in groups), pa.array(np.arange(at - n, at)), first.column("head").combine_chunks(), pa.ListArray.from_arrays(offsets, members), pa.array(ends - starts), *map(pa.array, box)]
            return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns], schema.fieldNames())

        def starts_of(t: pa.Table) -> np.ndarray:
            """Where blocks begin."""
            new = np.zeros(len(t), bool)
            new[0] = True
            for g in groups:
                c = t.column(g).combine_chunks()
                new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
            of = np.flatnonzero(new)
            place = np.arange(len(t)) - np.repeat(of, np.diff(np.append(of, len(t))))
            return np.flatnonzero(place % size == 0)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not len(t):
                continue
            starts = starts_of(t)
            # the block that goes on in the next batch
            end = int(starts[-1])
            if end:
                yield emit(t, starts[:-1], end)
            rest = t.slice(end)
        if rest is not None and len(rest):
            yield emit(rest, np.array([0]), len(rest))

    made = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(cut, schema)
    made = scratch.store(made.withColumn("__part", F.spark_partition_id()), "blocks")
    before, total = [], 0
    for p, n in sorted((r["__part"], r["n"]) for r in made.groupBy("__part").agg(F.count("*").alias("n")).collect()):
        before.append((p, total))
        total += n
    shift = points.sparkSession.createDataFrame(before, "__part int, __before long")  # a row for each range
    return made.join(F.broadcast(shift), "__part").withColumn("node", F.col("__before") + F.col("__at")).drop("__part", "__before", "__at")


def levels(leaves: DataFrame, groups: Sequence[str], axes: int) -> list[DataFrame]:
    """The tree over blocks, leaves first, up to a level on which no group has more than ``FAN`` nodes."""
    box = [f(f"{k}{i}").alias(f"{k}{i}") for i in range(axes) for k, f in (("lo", F.min), ("hi", F.max))]
    out = [leaves.drop("members")]
    top = int(leaves.agg(F.coalesce(F.max("node"), F.lit(0)).alias("m")).first().m)
    while top >= FAN:
        top //= FAN
        out.append(scratch.store(out[-1].groupBy(*groups, F.floor(F.col("node") / FAN).alias("node")).agg(F.sum("n").alias("n"), *box), "level"))
    return out


def _gaps(axes: int, metric: str) -> tuple[Column, Column]:
    """The least and the largest distance (squared for l2) between points of the boxes a_* and b_*."""
    near, far = [], []
    for i in range(axes):
        alo, ahi, blo, bhi = (F.col(c) for c in (f"a_lo{i}", f"a_hi{i}", f"lo{i}", f"hi{i}"))
        near.append(F.greatest(F.lit(0.0), alo - bhi, blo - ahi))
        far.append(F.greatest(ahi - blo, bhi - alo))
    power = (lambda x: x) if metric == "l1" else (lambda x: x * x)
    return reduce(lambda x, y: x + y, map(power, near)), reduce(lambda x, y: x + y, map(power, far))


def block_pairs(askers: DataFrame, leaves: DataFrame, groups: Sequence[str], axes: int, need: int, metric: str = "l2", within: float = float("inf")) -> DataFrame:
    """(groups, asker, node, near, far): for each block of askers the blocks that may hold one of the ``need`` points nearest to one of its points, and no farther than
    ``within`` (squared for l2). Where ``askers`` has a ``bound``, it holds for all points of the block; where it has the box of all that its points look at (r_lo*, r_hi*),
    blocks outside of it are left out, and the result has it too.

    A level's pairs meet only the children of the nodes that they kept, so their number follows what is kept and not the product of the sides.
    """
    tree = levels(leaves, groups, axes)
    bounded, reach = "bound" in askers.columns, [c for c in askers.columns if c.startswith(("r_lo", "r_hi"))]
    side = askers.select(*groups, F.col("node").alias("asker"), *[F.col(f"{k}{i}").alias(f"a_{k}{i}") for i in range(axes) for k in ("lo", "hi")], *(["bound"] if bounded else []), *reach)
    boxes = [c for c in side.columns if c not in (*groups, "bound")]
    meets = reduce(lambda x, y: x & y, [(F.col(f"r_lo{i}") <= F.col(f"hi{i}")) & (F.col(f"r_hi{i}") >= F.col(f"lo{i}")) for i in range(axes)]) if reach else F.lit(True)
    near, far = _gaps(axes, metric)
    pairs = side.withColumn("up", F.lit(0).cast("long")).withColumn("bound", F.least("bound", F.lit(float(within))) if bounded else F.lit(float(within)))
    for depth in range(len(tree) - 1, -1, -1):
        nodes = tree[depth].select(*groups, "node", "n", *[f"{k}{i}" for i in range(axes) for k in ("lo", "hi")], (F.floor(F.col("node") / FAN) if depth < len(tree) - 1 else F.lit(0)).cast("long").alias("up"))
        met = pairs.join(nodes, [*groups, "up"]).withColumn("near", near).withColumn("far", F.when(F.col("n") >= need, far).otherwise(float("inf"))).where((F.col("near") <= F.col("bound") * (1 + 1e-9)) & meets)
        if not bounded:
            met = met.withColumn("bound", F.least("bound", F.min("far").over(Window.partitionBy(*groups, "asker")))).where(F.col("near") <= F.col("bound") * (1 + 1e-9))
        pairs = met.select(*groups, *boxes, F.col("node").alias("up"), "bound", "near", "far")
        if depth and not bounded:
            pairs = scratch.store(pairs, "pairs")
        pairs = pairs if depth == 0 else pairs.drop("near", "far")
    return pairs.select(*groups, "asker", F.col("up").alias("node"), "near", "far", *reach)


def _ids(column: pa.Array) -> np.ndarray:
    x = column.to_numpy(zero_copy_only=False)
    return x.astype(str) if x.dtype == object else x


def _places(rows: pa.StructArray, axes: Sequence[str]) -> np.ndarray:
    return np.stack([rows.field(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in axes])


class Search:
    """The ``k`` nearest of each row of one block of askers, over sets of points that come one after another."""

    def __init__(self, rows: pa.StructArray, k: int, axes: Sequence[str], metric: str, a_id: str, b_id: str, exclude_self: bool, within: float = np.inf):
        self.rows, self.k, self.axes, self.metric, self.b_id, self.exclude_self, self.within = rows, k, axes, metric, b_id, exclude_self, within
        self.at, self.ids = _places(rows, axes), _ids(rows.field(a_id))
        self.lo, self.hi = self.at.min(1)[:, None], self.at.max(1)[:, None]
        self.d, self.ref, self.b_ids, self.seen = np.full((len(rows), k), np.inf), np.full((len(rows), k), -1), None, None

    def apart(self, x: np.ndarray) -> np.ndarray:
        return np.abs(x) if self.metric == "l1" else x * x

    def bound(self) -> float:
        """No asker looks farther."""
        return float(min(self.d[:, -1].max(), self.within)) * (1 + 1e-9)

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """The box of all places that some asker looks at."""
        d = np.minimum(self.d[:, -1], self.within)
        r = (d if self.metric == "l1" else np.sqrt(d)) * (1 + 1e-9) + 1e-150  # more than what squares to zero
        lo, hi = self.at - r, self.at + r
        return np.where(np.isnan(lo), -np.inf, lo).min(1), np.where(np.isnan(hi), np.inf, hi).max(1)

    def nearest_first(self, at: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
        """The spans between ``ends`` by how near their boxes are."""
        lo, hi = (f.reduceat(at, ends[:-1], axis=1) for f in (np.minimum, np.maximum))
        gap = sum(self.apart(np.maximum(0.0, np.maximum(self.lo[i] - hi[i], lo[i] - self.hi[i]))) for i in range(len(at)))
        return [(int(ends[i]), int(ends[i + 1])) for i in np.argsort(gap, kind="stable")]

    def add(self, rows: pa.StructArray, at: np.ndarray, ids: np.ndarray, spans: Sequence[tuple[int, int]]) -> None:
        """``rows`` at the places ``at``, of which those in ``spans`` (nearest first) are tried."""
        base = 0 if self.seen is None else len(self.seen)
        if self.b_ids is None:
            self.b_ids = np.zeros(self.d.shape, ids.dtype)
        index = np.concatenate([np.arange(*s) for s in spans])
        step = max(1, PAIRS // len(self.rows))
        first = min(step, 4 * BLOCK)
        for begin, end in [(0, first), *((i, i + step) for i in range(first, len(index), step))]:
            self.meet(at, ids, index[begin:end], base)
        # rows that are somebody's best
        used = np.unique(self.ref[np.isfinite(self.d)])
        old, new = used[used < base], used[used >= base] - base
        kept = rows.take(pa.array(new))
        self.seen = kept if self.seen is None else pa.concat_arrays([self.seen.take(pa.array(old)), kept])
        self.ref = np.where(np.isfinite(self.d), np.searchsorted(used, self.ref), -1)

    def meet(self, at: np.ndarray, ids: np.ndarray, index: np.ndarray, base: int) -> None:
        here = at[:, index]
        gap = sum(self.apart(np.maximum(0.0, np.maximum(self.lo[i] - here[i], here[i] - self.hi[i]))) for i in range(len(at)))
        index = index[gap <= self.bound()]
        if not len(index):
            return
        d = sum(self.apart(self.at[i][:, None] - at[i][index][None, :]) for i in range(len(at)))
        if self.exclude_self:
            d[self.ids[:, None] == ids[index][None, :]] = np.inf
        limit = np.minimum(self.d[:, -1], self.within * (1 + 1e-9))
        if len(index) > self.k:
            limit = np.minimum(limit, np.partition(d, self.k - 1, 1)[:, self.k - 1])
        row, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        if not len(row):
            return
        old_row, old_rank = np.nonzero(np.isfinite(self.d))
        every_row, every = np.concatenate([old_row, row]), np.concatenate([self.d[old_row, old_rank], d[row, col]])
        names, refs = np.concatenate([self.b_ids[old_row, old_rank], ids[index[col]]]), np.concatenate([self.ref[old_row, old_rank], base + index[col]])
        order = np.lexsort((names, every, every_row))
        every_row = every_row[order]
        rank = np.arange(len(order)) - np.searchsorted(every_row, every_row)
        order, every_row, rank = order[rank < self.k], every_row[rank < self.k], rank[rank < self.k]
        if names.dtype != self.b_ids.dtype:  # longer names
            self.b_ids = self.b_ids.astype(names.dtype)
        self.d[every_row, rank], self.ref[every_row, rank], self.b_ids[every_row, rank] = every[order], refs[order], names[order]

    def found(self) -> tuple[pa.StructArray, pa.StructArray, np.ndarray, np.ndarray] | None:
        row, rank = np.nonzero(np.isfinite(self.d))
        if not len(row):
            return None
        return self.rows.take(pa.array(row)), self.seen.take(pa.array(self.ref[row, rank])), self.d[row, rank], (rank + 1).astype(np.int32)


def in_units(askers: DataFrame, points: DataFrame, pairs: DataFrame, groups: Sequence[str], axes: Sequence[str] = ()) -> DataFrame:
    """(groups, unit, node, asks, a, b) of ``pairs`` (groups, asker, node, near): units of blocks of askers (a), each of them followed by the blocks that some of
    them meet (b; asks: by whom, and how near), nearest first, in one task. Pairs that have a ``unit`` in place of the asker are met by all of it (asks is null).
    Of a block that the pairs meet in boxes (r_lo*, r_hi*, of ``axes``) only the points in the box around these are sent."""
    spark = askers.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    unit = lambda c: F.floor(F.col(c) / UNIT).alias("unit")
    members, reach = F.col("members"), [c for c in pairs.columns if c.startswith(("r_lo", "r_hi"))]
    if reach:
        inside = lambda m: reduce(lambda x, y: x & y, [m[c].cast("double").between(F.col(f"r_lo{i}"), F.col(f"r_hi{i}")) for i, c in enumerate(axes)])
        members = F.filter(members, inside)
    if "asker" in pairs.columns:
        met = pairs.groupBy(*groups, unit("asker"), "node").agg(F.min("near").alias("near"), F.collect_list(F.struct("asker", "near")).alias("asks"), *[(F.min if c.startswith("r_lo") else F.max)(c).alias(c) for c in reach])
    else:
        met = pairs.withColumn("asks", F.lit(None).cast("array<struct<asker:bigint,near:double>>"))
    met = met.join(points.select(*groups, "node", "members"), [*groups, "node"]).select(*groups, "unit", "near", "node", "asks", members.alias("b"))
    empty = lambda c, df: F.lit(None).cast(df.schema[c].dataType)
    every = askers.select(*groups, unit("node"), F.lit(-1.0).alias("near"), "node", empty("asks", met).alias("asks"), F.col("members").alias("a"), empty("members", points).alias("b"))
    every = every.unionByName(met.select(*groups, "unit", "near", "node", "asks", empty("members", askers).alias("a"), "b"))
    return every.repartition(parts, *groups, "unit").sortWithinPartitions(*groups, "unit", "near", "node").select(*groups, "unit", "node", "asks", "a", "b")


def unit_pairs(askers: DataFrame, leaves: DataFrame, groups: Sequence[str], axes: int, within: float) -> DataFrame:
    """(groups, unit, node, near): for each unit of blocks of askers the blocks that have a point no farther than ``within`` (squared) from its box."""
    box = [f(f"{k}{i}").alias(f"{k}{i}") for i in range(axes) for k, f in (("lo", F.min), ("hi", F.max))]
    units = askers.groupBy(*groups, F.floor(F.col("node") / UNIT).alias("node")).agg(*box).withColumn("bound", F.lit(float(within)))
    return block_pairs(units, leaves, groups, axes, 1).select(*groups, F.col("asker").alias("unit"), "node", "near")


def searched(batches: Iterator[pa.RecordBatch], begin, axes: Sequence[str], b_id: str, held: int, home: bool = False) -> Iterator[tuple[pa.RecordBatch, object]]:
    """Each row of a block of askers, and its search (``begin`` of the block's rows) when it has met all that it asks. At most ``held`` blocks are kept.
    ``home``: the askers of a unit are points too and meet each other before all else."""
    now, blocks, key = {}, [], None

    def meet_own() -> None:
        own = [row.column("a")[0].values for row, _ in now.values()]
        rows, ends = pa.concat_arrays(own), np.cumsum([0, *map(len, own)])
        at, ids = _places(rows, axes), _ids(rows.field(b_id))
        for _, search in now.values():
            search.add(rows, at, ids, search.nearest_first(at, ends))

    def meet() -> None:
        rows = pa.concat_arrays([b for b, _ in blocks])
        at, ids, ends = _places(rows, axes), _ids(rows.field(b_id)), np.cumsum([0, *(len(b) for b, _ in blocks)])
        asked = {}
        for i, (_, asks) in enumerate(blocks):
            for asker, near in zip(asks.field("asker").to_pylist(), asks.field("near").to_pylist(), strict=True) if asks is not None else ((n, 0.0) for n in now):
                asked.setdefault(asker, []).append((near, int(ends[i]), int(ends[i + 1])))
        for asker, spans in asked.items():
            now[asker][1].add(rows, at, ids, [s[1:] for s in sorted(spans)])
        blocks.clear()

    def done() -> Iterator[tuple[pa.RecordBatch, object]]:
        if home and asking and now:
            meet_own()
        if blocks:
            meet()
        yield from now.values()
        now.clear()

    asking = True
    for batch in batches:
        names = batch.schema.names
        keys = list(zip(*(batch.column(c).to_pylist() for c in names[: names.index("node")]), strict=True))
        nodes, xs, ys, asks = batch.column("node").to_pylist(), batch.column("a"), batch.column("b"), batch.column("asks")
        for i, node in enumerate(nodes):
            unit = tuple(None if x != x else x for x in keys[i])
            if unit != key:
                yield from done()
                key, asking = unit, True
            if xs[i].is_valid:  # a unit's blocks of askers come before all that they ask
                now[node] = batch.slice(i, 1), begin(xs[i].values)
            else:
                if home and asking:
                    meet_own()
                asking = False
                if len(ys[i].values):
                    blocks.append((ys[i].values, asks[i].values if asks[i].is_valid else None))
                if len(blocks) >= held:
                    meet()
    yield from done()


def around(askers: DataFrame, points: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, asker, node, near): the blocks of ``points`` before, at and after each block of askers on the curve."""
    if askers is points:
        at = askers.select(*groups, F.col("node").alias("asker"), F.col("node").alias("at"))
    else:
        first = points.groupBy(F.lit(0).alias("__g"), *groups).agg(F.min("node").alias("first"))
        heads = askers.select(*groups, "head", F.col("node").alias("asker"), F.lit(None).cast("long").alias("node")).unionByName(points.select(*groups, "head", F.lit(None).cast("long").alias("asker"), "node"))
        heads = filters.carried(heads.withColumn("__g", F.lit(0)), ["__g", *groups], ["head", "asker", "node"], "node", "at").where("asker is not null")
        at = heads.join(first, ["__g", *groups]).select(*groups, "asker", F.coalesce("at", "first").alias("at"))
    return at.select(*groups, "asker", F.explode(F.array(F.col("at"), F.col("at") - 1, F.col("at") + 1)).alias("node"), F.lit(0.0).alias("near"))


def common_box(a: DataFrame, b: DataFrame, axes: Sequence[str]) -> dict[str, tuple[float, float]] | None:
    """The least and the largest coordinates of both sides, nulls and NaN left out; None where a side has no point."""
    bounds = [f(F.col(c).cast("double")).alias(f"{n}{c}") for c in axes for n, f in (("lo", F.min), ("hi", F.max))]
    sa, sb = (df.where(reduce(lambda x, y: x & y, [~F.isnan(F.col(c).cast("double")) for c in axes])).agg(*bounds).first() for df in (a, b))
    if sa[f"lo{axes[0]}"] is None or sb[f"lo{axes[0]}"] is None:
        return None
    return {c: (min(sa[f"lo{c}"], sb[f"lo{c}"]), max(sa[f"hi{c}"], sb[f"hi{c}"])) for c in axes}


def turned(a: np.ndarray, b: np.ndarray, own: np.ndarray) -> pa.Array:
    """For each pair (a, b) whether (b, a) is one too; null where b isn't of ``own``, which has all a."""
    own = np.unique(own)
    n, i, j = len(own), np.searchsorted(own, a), np.minimum(np.searchsorted(own, b), len(own) - 1)
    here = own[j] == b
    return pa.array(np.isin(j * n + i, (i * n + j)[here]), mask=~here)


def knn_join(a: DataFrame, b: DataFrame, k: int, a_id: str, b_id: str, metric: str, exclude_self: bool, axes: Sequence[str], by: Sequence[str], within: float = np.inf, back: bool = False) -> DataFrame:
    """See ``joins.knn_join``. What is farther than ``within`` (squared for l2) is left out, but for rounding. ``back`` (a table that asks itself): a column that
    tells whether the pair is listed the other way round, too, as far as its unit knows; null where b isn't of a's unit."""
    schema = T.StructType([*(T.StructField("a_" + f.name, f.dataType) for f in a.schema), *(T.StructField("b_" + f.name, f.dataType) for f in b.schema), T.StructField("dist", T.DoubleType()), T.StructField("rank", T.IntegerType()), *([T.StructField("back", T.BooleanType())] if back else [])])
    box = common_box(a, b, axes)
    if box is None or k < 1:
        return a.sparkSession.createDataFrame([], schema)
    size, groups, axes, held = max(BLOCK, k + 1), [f"__by{i}" for i in range(len(by))], list(axes), HELD
    points = blocks(b, b_id, axes, by, box, size)
    askers = points if a is b and a_id == b_id else blocks(a, a_id, axes, by, box, size)
    begin = lambda rows: Search(rows, k, axes, metric, a_id, b_id, exclude_self, within)

    home, reach = askers is points, [f"r_{k}{i}" for k in ("lo", "hi") for i in range(len(axes))]

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, now in searched(batches, begin, axes, b_id, held, home):
            yield pa.RecordBatch.from_arrays([*(row.column(c) for c in (*groups, "node")), pa.array([now.bound()]), *(pa.array([x]) for side in now.reach() for x in side)], [*groups, "node", "bound", *reach])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, n = [], 0

        def flush() -> pa.RecordBatch:
            x, y = (pa.concat_arrays([d[i] for d in done]) for i in (0, 1))
            return pa.RecordBatch.from_arrays([*x.flatten(), *y.flatten(), *(pa.concat_arrays([pa.array(d[i]) for d in done]) for i in range(2, len(done[0])))], schema.fieldNames())

        for _, unit in groupby(searched(batches, begin, axes, b_id, held, home), key=lambda s: repr([s[0].column(c)[0].as_py() for c in (*groups, "unit")])):
            unit = [now for _, now in unit] if back else (now for _, now in unit)
            got = [g for now in unit if (g := now.found())] if back else (g for now in unit if (g := now.found()))
            if back and got:
                pairs = [np.concatenate([_ids(g[i].field(n)) for g in got]) for i, n in ((0, a_id), (1, b_id))]
                marks, ends = turned(*pairs, np.concatenate([now.ids for now in unit])), np.cumsum([0, *(len(g[2]) for g in got)])
                got = [(*g, marks[ends[i] : ends[i + 1]]) for i, g in enumerate(got)]
            for g in got:
                done.append(g)
                n += len(g[2])
                if n >= 16384:
                    yield flush()
                    done, n = [], 0
        if done:
            yield flush()

    told = T.StructType([*(askers.schema[c] for c in (*groups, "node")), *(T.StructField(c, T.DoubleType()) for c in ("bound", *reach))])
    away = lambda pairs: pairs.where(F.floor(F.col("asker") / UNIT) != F.floor(F.col("node") / UNIT)) if home else pairs
    ends = points.where((F.col("node") % UNIT).isin(0, UNIT - 1)) if home else points
    lean = lambda df, name: df.withColumn("members", F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in dict.fromkeys([name, *axes])])))
    first = in_units(lean(askers, a_id), lean(ends, b_id), away(around(askers, points, groups)), groups).mapInArrow(bound, told)
    asking = askers.drop("members").join(scratch.store(first, "bounds"), [*groups, "node"])
    pairs = away(block_pairs(asking, points, groups, len(axes), k + bool(exclude_self), metric, within))
    return in_units(askers, points, pairs, groups, axes).mapInArrow(search, schema)
