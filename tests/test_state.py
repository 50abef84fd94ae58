"""Timers, TTL, initial state, recovery, and joins of two streams."""

import datetime
import random
import shutil
import time

import pytest
from pyspark.sql import functions as F

from pointloom.operators import series
from pointloom.streaming import state

START = datetime.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    state.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def at(ms):
    return START + datetime.timedelta(milliseconds=ms)


def source(spark, path, parts, schema):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{path}")
        time.sleep(0.01)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}")


def run(df, out, checkpoint, mode="append"):
    """The rows that a run of ``df`` adds to the table ``out``, by way of Parquet in append mode."""
    q = df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"file://{checkpoint}").trigger(availableNow=True).start(f"file://{out}")
    q.awaitTermination()
    return q


def presses(seed=0):
    rng = random.Random(seed)
    rows = [("ab"[i % 2], at(t)) for i, t in enumerate(sorted(rng.randrange(0, 3000) for _ in range(80)))]
    late = [rows[i] for i in range(len(rows)) if i % 7]
    late[3], late[8] = late[8], late[3]  # within the watermark
    return [late[:20], late[20:45], late[45:], [("z", at(60_000))], [("z", at(120_000))]]


def test_keys_expire_by_timers(rocks, tmp_path):
    parts = presses()
    df = state.expiring_keys(source(rocks, tmp_path / "in", parts, "key string, ts timestamp"), 30)
    run(df, tmp_path / "out", tmp_path / "c")
    got = {(r.key, r.start, r.end, r.n) for r in rocks.read.parquet(f"file://{tmp_path}/out").collect()}
    batch = rocks.createDataFrame([r for p in parts for r in p], "key string, ts timestamp")
    want = {(r.key, r.start, r.end, r.n) for r in series.sessions(batch, ["key"], "ts", "30 milliseconds").where("start < '2024-01-01 00:01:30'").collect()}
    assert got == want and any(n > 1 for *_, n in got)


def test_recovery_equals_an_unbroken_run(rocks, tmp_path):
    """A second query goes on from the first one's checkpoint, with spans open between them."""
    parts = presses(1)
    schema = "key string, ts timestamp"
    run(state.expiring_keys(source(rocks, tmp_path / "all", parts, schema), 200), tmp_path / "o1", tmp_path / "c1")
    run(state.expiring_keys(source(rocks, tmp_path / "some", parts[:2], schema), 200), tmp_path / "o2", tmp_path / "c2")
    run(state.expiring_keys(source(rocks, tmp_path / "some", parts[2:], schema), 200), tmp_path / "o2", tmp_path / "c2")
    a, b = (sorted(map(tuple, rocks.read.parquet(f"file://{tmp_path}/{o}").collect())) for o in ("o1", "o2"))
    assert a == b and a
    shutil.rmtree(tmp_path / "c2" / "state")
    with pytest.raises(Exception, match="state|STATE|file"):
        run(state.expiring_keys(source(rocks, tmp_path / "some", [[("a", at(200_000))]], schema), 200), tmp_path / "o2", tmp_path / "c2")


def test_keys_are_let_go_by_ttl(rocks, tmp_path):
    schema = "device string, key string"
    df = state.held_keys(source(rocks, tmp_path / "in", [[("d", "up"), ("d", "up"), ("e", "left")]], schema), 1500)
    seen = []
    q = df.writeStream.outputMode("update").option("checkpointLocation", f"file://{tmp_path}/c").foreachBatch(lambda b, i: seen.append({(r.device, r.key, r.n) for r in b.collect()})).trigger(processingTime="100 milliseconds").start()

    def next_rows(n):
        until = time.time() + 60
        while time.time() < until and len([s for s in seen if s]) < n:
            time.sleep(0.1)
        return [s for s in seen if s]

    try:
        assert next_rows(1) == [{("d", "up", 2), ("e", "left", 1)}]
        time.sleep(2)
        source(rocks, tmp_path / "in", [[("d", "down"), ("e", None)]], schema)
        assert next_rows(2)[1:] == [{("d", "down", 1)}]
    finally:
        q.stop()


FRAMES = "camera string, ts timestamp, value double"


def frames():
    rng = random.Random(4)
    times = sorted({*rng.sample(range(0, 4000), 40), *rng.sample(range(9000, 12_000), 25), 15_500, 15_600})
    rows = [(c, at(t + 3 * k), float(t)) for t in times for k, c in enumerate("ab")]
    for i in range(0, len(rows) - 6, 6):
        rows[i], rows[i + 4] = rows[i + 4], rows[i]
    return [rows[:50], rows[50:90], rows[90:], [("z", at(100_000), 0.0)], [("z", at(200_000), 0.0)]]


def test_grids_restart_after_a_pause(rocks, tmp_path):
    parts = frames()
    run(state.resample_runs_stream(source(rocks, tmp_path / "in", parts, FRAMES), 0.1, 2.0), tmp_path / "out", tmp_path / "c")
    got = sorted((r.camera, r.begin, r.step, r.value) for r in rocks.read.parquet(f"file://{tmp_path}/out").where("camera <> 'z'").collect())
    rows = [(c, (t - START).total_seconds(), i, v) for i, (c, t, v) in enumerate(r for p in parts for r in p)]
    batch = state.resample_runs(rocks.createDataFrame(rows, "camera string, t double, id long, value double"), ["camera"], "t", ["id"], 0.1, 2.0)
    want = sorted((r.camera, at(round(r.begin * 1000)), r.step, r.value) for r in batch.where("camera <> 'z'").collect())
    assert got == want and len({g[:2] for g in got}) == 6


def test_a_grid_goes_on_from_initial_state(rocks, tmp_path):
    initial = rocks.createDataFrame([("a", at(0), 5, at(450)), ("b", at(0), 9, at(100))], "camera string, begin timestamp, step long, last timestamp")
    rows = [[("a", at(700), 1.0), ("b", at(9000), 2.0)], [("z", at(60_000), 0.0)], [("z", at(61_000), 0.0)]]
    run(state.resample_runs_stream(source(rocks, tmp_path / "in", rows, FRAMES), 0.1, 2.0, initial=initial), tmp_path / "out", tmp_path / "c")
    got = sorted((r.camera, r.begin, r.step) for r in rocks.read.parquet(f"file://{tmp_path}/out").where("camera <> 'z'").collect())
    assert got == [("a", at(0), 5), ("a", at(0), 6), ("a", at(0), 7), ("b", at(9000), 0)]


def test_two_cameras_meet_in_event_time(rocks, tmp_path):
    rng = random.Random(6)
    schema = "id long, ts timestamp"
    a = [[(i * 10 + k, at(i * 1000 + k * 33 + rng.randrange(9))) for k in range(20)] for i in range(12)]
    b = [[(i * 10 + k, at(i * 1000 + k * 33 + rng.randrange(30))) for k in range(20) if rng.random() < 0.7] for i in range(12)]
    end = [[(-1, at(90_000))], [(-2, at(95_000))], [(-3, at(99_000))]]
    left, right = (source(rocks, tmp_path / n, x + end, schema) for n, x in (("a", a), ("b", b)))
    q = run(state.closest_pairs(left, right, 12, "1 second"), tmp_path / "out", tmp_path / "c")
    kinds = "id long, ts timestamp"
    batch = state.closest_pairs(*(rocks.createDataFrame([r for p in x for r in p], kinds) for x in (a, b)), 12)
    want = sorted(map(tuple, batch.collect()))
    brute = []
    for i, t in (r for p in a for r in p):
        near = [(abs(t - u), u, j) for j, u in (r for p in b for r in p) if abs(t - u) <= datetime.timedelta(milliseconds=12)]
        brute += [(i, t, min(near)[2], min(near)[1])] if near else []
    assert want == sorted(brute) and want
    assert sorted(r for r in map(tuple, rocks.read.parquet(f"file://{tmp_path}/out").collect()) if r[0] >= 0) == want
    kept = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in q.recentProgress]
    assert max(kept) < 400 and kept[-1] < 30  # of 12 x 20 x 4 rows that went in, a few seconds' stay


def test_batch_runs_and_pairs_of_no_rows(rocks):
    none = rocks.createDataFrame([], "camera string, t double, id long, value double")
    assert state.resample_runs(none, ["camera"], "t", ["id"], 0.1, 2.0).count() == 0
    ids = rocks.createDataFrame([(1, at(0)), (2, at(5)), (2, at(5))], "id long, ts timestamp")
    assert state.closest_pairs(ids.limit(0), ids, 10).count() == 0
    got = {(r.a_id, r.b_id) for r in state.closest_pairs(ids, ids.where("id = 2").union(ids.where("id = 1").select(F.lit(0).cast("long"), "ts")), 10).collect()}
    assert got == {(1, 0), (2, 2)}
