"""Streams with state of their own: key spans and grids by event-time timers, keys that expire by TTL, and event-time joins of two streams.

The processors keep value, list and map state in RocksDB (``use_rocksdb``); their rows are taken in the order of event time once the watermark has passed
them, so a result doesn't hang on how rows fall into triggers, and a run that goes on from a checkpoint equals an unbroken one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import filters, joins, series

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _ms(times: pd.Series) -> list[int]:
    return [int(t.value // 1_000_000) for t in times]


def _same(value, n: int) -> pd.Series:
    """A column of one value; texts stay plain objects, which the state server's Arrow writer takes."""
    return pd.Series([value] * n, dtype=object)


class KeySpans(StatefulProcessor):
    """Spans of one key: open ones in a map from their first press to their last and count, each with a timer just after its end."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "first long", "last long, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v for k, v in self.open.iterator()}
        before = dict(held)
        for t in sorted(t for pdf in rows for t in _ms(pdf["ts"])):
            near = [(a, *v) for a, v in held.items() if a - self.ttl <= t <= v[0] + self.ttl]
            for a, _, _ in near:
                del held[a]
            held[min([t, *(a for a, _, _ in near)])] = (max([t, *(z for _, z, _ in near)]), 1 + sum(n for _, _, n in near))
        for a, v in before.items():
            if held.get(a) != v:
                self.open.removeKey((a,))
                self.handle.deleteTimer(v[0] + self.ttl + 1)
        for a, v in held.items():
            if before.get(a) != v:
                self.open.updateValue((a,), v)
                self.handle.registerTimer(v[0] + self.ttl + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        done = [(k[0], v[0], v[1]) for k, v in self.open.iterator() if v[0] + self.ttl < end]
        for a, _, _ in done:
            self.open.removeKey((a,))
        if done:
            yield pd.DataFrame({"key": _same(key[0], len(done)), "start": pd.to_datetime([a for a, _, _ in done], unit="ms"), "end": pd.to_datetime([z + self.ttl for _, z, _ in done], unit="ms"), "n": [n for _, _, n in done]})

    def close(self) -> None:
        pass


def expiring_keys(presses: DataFrame, ttl_ms: int = 30, late: str = "1 second") -> DataFrame:
    """(key, start, end, n): spans in which a key is held, ended by a timer ``ttl_ms`` of event time after its last press (key, ts). A press that is late by less
    than ``late`` may join two spans; times count in milliseconds."""
    named = presses.select("key", "ts").withWatermark("ts", late)
    return named.groupBy("key").transformWithStateInPandas(KeySpans(ttl_ms), "key string, start timestamp, end timestamp, n long", "append", "eventTime")


class HeldKeys(StatefulProcessor):
    """Keys of a device that were pressed within the TTL of processing time; the state store lets them go."""

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.keys = handle.getMapState("keys", "key string", "n long", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for k in pdf["key"]:
                if isinstance(k, str):
                    self.keys.updateValue((k,), ((self.keys.getValue((k,)) or (0,))[0] + 1,))
        held = sorted((k[0], v[0]) for k, v in self.keys.iterator())
        if held:
            yield pd.DataFrame({"device": _same(key[0], len(held)), "key": pd.Series([k for k, _ in held], dtype=object), "n": [n for _, n in held]})

    def close(self) -> None:
        pass


def held_keys(presses: DataFrame, ttl_ms: int = 30) -> DataFrame:
    """(device, key, n) of the keys of a device that are held after each trigger that brought it rows (device, key): pressed, or pressed again, less than ``ttl_ms`` ago by
    the clock. A null key only asks. The store looks for expired keys in triggers without rows, too, so an ``availableNow`` query of this would not end."""
    return presses.select("device", "key").groupBy("device").transformWithStateInPandas(HeldKeys(ttl_ms), "device string, key string, n long", "update", "processingTime")


class Grid(StatefulProcessor):
    """A camera's grid: (begin, step, last) of the run, and the rows that the watermark hasn't passed."""

    def __init__(self, dt: float, idle: float, eps: float):
        self.dt, self.idle, self.eps = dt, idle, eps

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "begin long, step long, last long")
        self.waiting = handle.getListState("waiting", "ms long, value double")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        r = initialState.iloc[0]
        self.run.update((int(r["begin"].value // 1_000_000), int(r["step"]), int(r["last"].value // 1_000_000)))
        self.handle.registerTimer(self._ends(int(r["last"].value // 1_000_000)))

    def _ends(self, last: int) -> int:
        return last + math.floor(self.idle * 1000) + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [(t, float(v)) for pdf in rows for t, v in zip(_ms(pdf["ts"]), pdf["value"], strict=True)]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(max(t for t, _ in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ripe, rest = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        run, out = self.run.get() if self.run.exists() else None, []
        for t, v in ripe:
            if run is None or t - run[2] > self.idle * 1000:
                run = (t, 0, t)
            begin, step, _ = run
            g = math.floor((t - begin) / 1000 / self.dt + self.eps)
            out += [(begin, s, t, v) for s in range(step, g + 1)]
            run = (begin, max(step, g + 1), t)
        if ripe:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
            self.run.update(run)
            self.handle.registerTimer(self._ends(run[2]))
        elif run is not None and not rest and expiredTimerInfo.getExpiryTimeInMs() >= self._ends(run[2]):
            self.run.clear()  # silent for so long that the next row begins a run of its own
        if out:
            yield pd.DataFrame({"camera": _same(key[0], len(out)), "begin": pd.to_datetime([r[0] for r in out], unit="ms"), "step": [r[1] for r in out], "ts": pd.to_datetime([r[2] for r in out], unit="ms"), "value": [r[3] for r in out]})

    def close(self) -> None:
        pass


def resample_runs_stream(frames: DataFrame, dt: float, idle: float, late: str = "1 second", eps: float = 1e-5, initial: DataFrame | None = None) -> DataFrame:
    """(camera, begin, step, ts, value) of a stream (camera, ts, value): ``resample_runs`` with timers. ``initial`` (camera, begin, step, last): runs
    of an earlier stream that go on, with the next free step of each."""
    named = frames.select("camera", "ts", "value").withWatermark("ts", late)
    start = None if initial is None else initial.select("camera", "begin", "step", "last").groupBy("camera")
    return named.groupBy("camera").transformWithStateInPandas(Grid(dt, idle, eps), "camera string, begin timestamp, step long, ts timestamp, value double", "append", "eventTime", start)


def resample_runs(samples: DataFrame, key: Sequence[str], time: str, order: Sequence[str], dt: float, idle: float, eps: float = 1e-5) -> DataFrame:
    """Samples on a grid that begins anew, at the sample's own time, after a pause of more than ``idle``: their columns, ``begin`` and ``step``; gaps within a run are
    filled as ``series.resample`` does. ``time`` counts seconds. All steps run over ranges, so a key may have any number of rows."""
    before = filters.carried(samples, key, [time, *order], time, "__earlier", inclusive=False)
    opens = F.when(F.col("__earlier").isNull() | (F.col(time) - F.col("__earlier") > idle), F.col(time))
    runs = filters.carried(before.withColumn("__opens", opens), key, [time, *order], "__opens", "begin").withColumn("__t", F.col(time) - F.col("begin"))
    out = series.resample(runs.select(*samples.columns, "begin", "__t"), [*key, "begin"], "__t", order, dt, 0.0, eps)
    return out.select(*samples.columns, "begin", "step")


def closest_pairs(a: DataFrame, b: DataFrame, tolerance_ms: int, late: str = "1 second", on: Sequence[str] = ()) -> DataFrame:
    """(on, a_id, a_ts, b_id, b_ts): for each row of ``a`` (on, id, ts) the row of ``b`` (likewise) nearest in time, at most ``tolerance_ms`` away; ties go to the earlier, then to the smaller id.

    Of two streams this is a join within an interval of event time: rows of either side are kept until the other's watermark has passed what could meet them, and a pair is
    out when the window that it lies in is closed. Both sides are dealt by time buckets of the tolerance, so rows of one moment need not share a task with all others.
    Tables are met in one order of time instead (see ``nearest_rows``), so that no pair but the nearest is made.
    """
    if not (a.isStreaming or b.isStreaming):
        return nearest_rows(a, b, tolerance_ms, on)
    width = max(1, tolerance_ms)
    bucket = F.floor(F.unix_millis("ts") / width)
    left = a.select(*[F.col(c).alias(f"a_{c}") for c in on], F.col("id").alias("a_id"), "ts").withWatermark("ts", late)
    left = left.withColumn("bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1))).withColumnRenamed("ts", "a_ts")
    right = b.select(*[F.col(c).alias(f"b_{c}") for c in on], F.col("id").alias("b_id"), "ts").withWatermark("ts", late).withColumn("b_bucket", bucket).withColumnRenamed("ts", "b_ts")
    met = F.col("bucket") == F.col("b_bucket")
    for c in on:
        met = met & (F.col(f"a_{c}") == F.col(f"b_{c}"))
    reach = F.expr(f"INTERVAL {tolerance_ms} MILLISECONDS")
    pairs = left.join(right, met & (F.col("b_ts") >= F.col("a_ts") - reach) & (F.col("b_ts") <= F.col("a_ts") + reach))
    gap = F.abs(F.unix_micros("a_ts") - F.unix_micros("b_ts"))
    best = pairs.groupBy(*[F.col(f"a_{c}").alias(c) for c in on], "a_id", F.window("a_ts", f"{width} milliseconds")).agg(F.min(F.struct(gap.alias("gap"), F.col("b_ts"), F.col("b_id"), F.col("a_ts"))).alias("m"))
    return best.select(*on, "a_id", "m.a_ts", "m.b_id", "m.b_ts")


def nearest_rows(a: DataFrame, b: DataFrame, tolerance_ms: int, on: Sequence[str] = ()) -> DataFrame:
    """``closest_pairs`` of two tables, by as-of joins both ways: work and scratch follow the rows, however many lie within the tolerance. Equal rows of ``a``
    give one."""
    keys = list(on)
    timed = lambda df: df.where("ts is not null").dropna(subset=keys) if keys else df.where("ts is not null")  # noqa: E731  a null meets nothing
    left = timed(a).select(*keys, F.lit(0).alias("__all"), F.col("id").alias("a_id"), F.unix_micros("ts").alias("t")).distinct()
    right = timed(b).groupBy(*keys, F.lit(0).alias("__all"), F.unix_micros("ts").alias("t")).agg(F.min("id").alias("b_id"))
    met = joins.asof_join(left, right, "t", [*keys, "__all"], ["b_id"], "nearest", tolerance_ms * 1000).where("t_right is not null")
    kind = lambda df: df.schema["ts"].dataType
    at = lambda c, df: F.timestamp_micros(c).cast(kind(df))
    return met.select(*keys, "a_id", at("t", a).alias("a_ts"), "b_id", at("t_right", b).alias("b_ts"))
