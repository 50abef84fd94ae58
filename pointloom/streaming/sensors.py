"""Sensor streams: resampling, last-k buffers, synchronisation, recording, sessions, windows."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import series


def resample_stream(frames: DataFrame, dt: float, start: float = 0.0, eps: float = 1e-5) -> DataFrame:
    """(camera, step, t, value) from a stream (camera, t, value): as the batch ``resample``, with the next free step as a camera's state.

    Rows of a trigger are taken in order of t; one that comes after a later step was filled adds nothing. A row with ``reset`` true, if that
    column is there, restarts the grid at its own time.
    """
    resets = "reset" in frames.columns

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        step, begin = state.get if state.exists else (0, start)
        out = []
        for r in pd.concat(list(batches)).sort_values("t").itertuples():
            if resets and bool(r.reset):
                step, begin = 0, float(r.t)
                continue
            g = math.floor((r.t - begin) / dt + eps)
            out += [(key[0], s, float(r.t), float(r.value)) for s in range(step, g + 1)]
            step = max(step, g + 1)
        state.update((step, begin))
        yield pd.DataFrame(out, columns=["camera", "step", "t", "value"])

    return frames.groupBy("camera").applyInPandasWithState(run, "camera string, step long, t double, value double", "step long, begin double", "append", GroupStateTimeout.NoTimeout)


def capacity(frequency: float, budget: float, k: int, margin: float = 1.5) -> int:
    """Slots of a last-k buffer that is read within ``budget`` seconds."""
    return math.ceil(frequency * budget * margin) + k


def last_k_stream(frames: DataFrame, k: int, slots: int | None = None, budget: float = 0.0) -> DataFrame:
    """(camera, nth, t, value): the ``k`` newest of a camera after each trigger that brought it rows.

    With ``slots`` (see ``capacity``) it is an error to write so fast that a slot comes round again within ``budget`` seconds: a reader could not
    have finished with it.
    """
    held = max(k, slots or 0)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, v = state.get if state.exists else ([], [])
        rows = sorted([*zip(t, v, strict=True), *((float(r.t), float(r.value)) for b in batches for r in b.itertuples())])
        if slots and any(rows[i][0] - rows[i - slots][0] < budget for i in range(slots, len(rows))):
            raise TimeoutError(f"{key[0]}: {slots} slots are written within {budget} seconds")
        rows = rows[-held:]
        state.update(([x for x, _ in rows], [x for _, x in rows]))
        yield pd.DataFrame([(key[0], i + 1, *x) for i, x in enumerate(reversed(rows[-k:]))], columns=["camera", "nth", "t", "value"])

    return frames.groupBy("camera").applyInPandasWithState(run, "camera string, nth int, t double, value double", "t array<double>, v array<double>", "update", GroupStateTimeout.NoTimeout)


def received(frames: DataFrame, late: str = "10 seconds") -> DataFrame:
    """``frames`` in the order of ``receive_ts``, which is their event time; ``capture_ts`` is carried beside it, and ``lateness`` is the gap in seconds."""
    seconds = F.col("receive_ts").cast("double") - F.col("capture_ts").cast("double")
    return frames.withColumn("lateness", seconds).withWatermark("receive_ts", late)


def record(frames: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Each (camera, step_idx) once, by its first arrival within the watermark on ``ts``."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(["camera", "step_idx"])


def _versions(spark, path: str, before: int) -> DataFrame | None:
    """The newest stored rows of each bucket, of batches under ``before``; None without any."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p) or not any(s.getPath().getName().startswith("batch=") for s in fs.listStatus(p)):
        return None
    rows = spark.read.parquet(path).where(F.col("batch") < before)
    newest = rows.select("bucket", "batch").distinct().groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(newest), ["bucket", "batch"], "left_semi")  # one row for each bucket


def upsert_batch(path: str, key: Sequence[str] = ("camera", "step_idx"), order: Sequence[str] = ("ts",), buckets: int = 64):
    """A ``foreachBatch`` writer that keeps the last row of each key over all batches: read it with ``recorded``.

    Keys lie in buckets by hash; a batch merges the buckets that it touches with their newest version and writes them as its own, so a batch that
    is replayed replaces itself and other buckets stay as they are.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        old = _versions(spark, path, batch_id)
        if old is not None:
            touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # as many as buckets
            rows = rows.unionByName(old.where(F.col("bucket").isin(touched)).select(*rows.columns))
        series.upsert(rows, key, order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")

    return write


def recorded(spark, path: str) -> DataFrame:
    """The last row of each key that ``upsert_batch`` wrote."""
    rows = _versions(spark, path, 1 << 62)
    if rows is None:
        raise FileNotFoundError(f"nothing is recorded in {path}")
    return rows.drop("bucket", "batch")


def action_steps(actions: DataFrame, key: Sequence[str], time: str, order: Sequence[str], dt: float, start: float = 0.0, eps: float = 1e-5) -> DataFrame:
    """One batch of actions on the grid, ``step`` from its own first one on: within it gaps are filled as ``resample`` does."""
    first = actions.groupBy(*key).agg(F.greatest(F.lit(0).cast("long"), F.floor((F.min(time) - start) / dt + eps)).alias("__first"))
    return series.resample(actions, key, time, order, dt, start, eps).join(first, list(key)).where(F.col("step") >= F.col("__first")).drop("__first")


def accumulate_actions(path: str, dt: float, start: float = 0.0, key: Sequence[str] = ("camera",), buckets: int = 64):
    """A ``foreachBatch`` writer of actions (key, t, value): steps may be written again, the later batch wins; read it with ``recorded``."""
    upsert = upsert_batch(path, [*key, "step"], ["arrived"], buckets)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("__tie", F.monotonically_increasing_id())
        upsert(action_steps(rows, key, "t", ["__tie"], dt, start).drop("__tie").withColumn("arrived", F.lit(batch_id).cast("long")), batch_id)

    return write


def apply_commands(commands: DataFrame) -> DataFrame:
    """(camera, start_ts, options) after each command (camera, start_ts, option, value) of a stream: options as JSON, kept from trigger to trigger."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, out = json.loads(state.get[0]) if state.exists else {}, []
        for r in pd.concat(list(batches)).sort_values("start_ts").itertuples():
            held[str(r.option)] = float(r.value)
            out.append((key[0], float(r.start_ts), json.dumps(held, sort_keys=True)))
        state.update((json.dumps(held),))
        yield pd.DataFrame(out, columns=["camera", "start_ts", "options"])

    return commands.groupBy("camera").applyInPandasWithState(run, "camera string, start_ts double, options string", "options string", "append", GroupStateTimeout.NoTimeout)


def key_spans(presses: DataFrame, ttl: str = "30 milliseconds", late: str = "1 second") -> DataFrame:
    """Spans in which a key is held: repeats within ``ttl`` refresh it."""
    w = presses.withWatermark("ts", late).groupBy("key", F.session_window("ts", ttl).alias("w")).agg(F.count("*").alias("n"))
    return w.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def hopping(frames: DataFrame, size: str, hop: str, late: str = "1 minute") -> DataFrame:
    w = frames.withWatermark("ts", late).groupBy("camera", F.window("ts", size, hop).alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return w.select("camera", F.col("w.start").alias("start"), "n", "mean")


def drain(commands: DataFrame, most: int) -> DataFrame:
    """Commands of a queue in order, with an error where more than ``most`` wait in one trigger of a camera."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("start_ts")
        if len(rows) > most:
            raise OverflowError(f"{len(rows)} commands wait; the queue holds {most}")
        n = state.get[0] if state.exists else 0
        state.update((n + len(rows),))
        yield pd.DataFrame({"camera": key[0], "nth": range(n, n + len(rows)), "cmd": rows["cmd"], "value": rows["value"]})

    return commands.groupBy("camera").applyInPandasWithState(run, "camera string, nth long, cmd int, value double", "n long", "append", GroupStateTimeout.NoTimeout)


def synchronised_batch(path: str, key: str, k: int, tolerance: float, sink):
    """A ``foreachBatch`` step that keeps the ``k`` newest samples (key, t, step_idx) of each key over all batches in ``path`` and gives ``sink`` those
    closest to the oldest of the keys' newest times."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows, old = batch.withColumn("bucket", F.lit(0)), _versions(spark, path, batch_id)
        if old is not None:
            rows = rows.unionByName(old.select(*rows.columns))
        newest = series.last_k(rows.dropDuplicates([key, "t", "step_idx"]), [key], "t", "step_idx", k).drop("nth")
        newest.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")
        sink(series.synchronise(_versions(spark, path, batch_id + 1).drop("bucket", "batch"), key, "t", "step_idx", k, tolerance), batch_id)

    return step
