import dataclasses
import datetime
import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.operators import series
from pointloom.sources import capture, colmap, ply, tables
from pointloom.streaming import sensors


def test_ply_round_trip(spark, tmp_path):
    rows = pd.DataFrame({"x": [1.0, 2.0], "y": [0.0, 1.0], "z": [5.0, 6.0], **{f"f_dc_{i}": [0.1 * i, 0.2] for i in range(3)}, **{f"f_rest_{i}": [float(i), float(-i)] for i in (9, 10, 1, 0)}, "opacity": [0.3, 0.4], "scale_0": [1.0, 2.0], **{f"rot_{i}": [1.0 * (i == 0), 0.5] for i in range(4)}})
    (tmp_path / "a.ply").write_bytes(ply.render(rows))
    got = ply.read_splats(spark, f"file://{tmp_path}/a.ply", rest=4).orderBy("gid").collect()
    assert [list(r.f_rest) for r in got] == [[0.0, 1.0, 9.0, 10.0], [0.0, -1.0, -9.0, -10.0]] and list(got[1].rot) == [0.5] * 4
    flat = ply.flatten_splats(ply.read_splats(spark, f"file://{tmp_path}/a.ply"), 3, 4, 1)
    assert flat.count() == 2 and "f_rest_3" in flat.columns
    with pytest.raises(Exception, match="f_rest"):
        ply.read_splats(spark, f"file://{tmp_path}/a.ply", rest=5).collect()
    cloud = pd.DataFrame({"x": [1.0], "y": [2.0], "z": [3.0], "red": np.array([255], np.uint8), "green": np.array([0], np.uint8), "blue": np.array([51], np.uint8)})
    (tmp_path / "c.ply").write_bytes(ply.render(cloud))
    (tmp_path / "d.ply").write_bytes(b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nproperty uchar green\nproperty uchar blue\nend_header\n1 2 3 255 0 51\n")
    for f in "cd":
        r = ply.read_cloud(spark, f"file://{tmp_path}/{f}.ply").first()
        assert (r.x, r.y, r.z, r.red, r.green) == (1, 2, 3, 1, 0) and abs(r.blue - 0.2) < 1e-9
    out = ply.files(ply.read_cloud(spark, f"file://{tmp_path}/c.ply").drop("path").withColumn("case", F.lit("k")), "case").first()
    assert len(ply.parse(bytes(out.content))) == 1


def test_colmap(spark, tmp_path):
    pts = [(7, 1.0, 2.0, 3.0, 10, 20, 30, 0.5, [{"image_id": 1, "point2d_idx": 0}, {"image_id": 2, "point2d_idx": 1}]), (8, 0.0, 0.0, 1.0, 1, 2, 3, 0.1, [])]
    b, t = tmp_path / "b", tmp_path / "t"
    b.mkdir()
    t.mkdir()
    (b / "points3D.bin").write_bytes(colmap.render_points(pts))
    (b / "cameras.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<iiQQ4d", 1, 1, 848, 480, 1, 2, 3, 4))
    (b / "images.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<i7di", 1, 1, 0, 0, 0, 5, 6, 7, 1) + b"a.png\0" + struct.pack("<Q", 2) + struct.pack("<ddq", 1.5, 2.5, 7) + struct.pack("<ddq", 3.5, 4.5, -1))
    (t / "points3D.txt").write_text("# c\n7 1 2 3 10 20 30 0.5 1 0 2 1\n\n8 0 0 1 1 2 3 0.1\n")
    (t / "cameras.txt").write_text("# c\n1 PINHOLE 848 480 1 2 3 4\n")
    (t / "images.txt").write_text("# c\n# d\n1 1 0 0 0 5 6 7 1 a.png\n1.5 2.5 7 3.5 4.5 -1\n2 1 0 0 0 5 6 7 1 b.png\n\n")
    for folder in (b, t):
        cams, images, points = colmap.read_model(spark, f"file://{folder}")
        assert cams.first().params == [1, 2, 3, 4] and cams.first().model == "PINHOLE"
        got = points.orderBy("id").collect()
        assert [(r.id, r.red, len(r.track)) for r in got] == [(7, 10, 2), (8, 1, 0)] and got[0].track[1].image_id == 2
        i = images.orderBy("id").first()
        assert i.name == "a.png" and i.point3d_ids == [7, -1] and i.xys[1].x == 3.5 and i.tvec == [5, 6, 7]
        assert [(r.id, r.u) for r in colmap.observations(images, points).collect()] == [(7, 1.5)]
    assert colmap.mean_observations(images).first().mean_observations == 1.0
    assert colmap.points_text(points.orderBy("id")).first().value.startswith("7 1.0 2.0 3.0 10 20 30 0.5 1 0 2 1")
    a = np.arange(12, dtype="<f4").reshape(3, 2, 2)
    data = b"2&3&2&" + np.transpose(a, (1, 0, 2)).tobytes(order="F")
    assert (colmap.parse_array(data) == a).all()
    with pytest.raises(FileNotFoundError):
        colmap.read_model(spark, f"file://{tmp_path}")


def test_tables(spark, tmp_path):
    (tmp_path / "cases.csv").write_text("a,cloth,True\nb,toy,false\n")
    assert [(r.case, r.shape_prior) for r in tables.read_cases(spark, f"file://{tmp_path}/cases.csv").collect()] == [("a", True), ("b", False)]
    d = tmp_path / "k"
    d.mkdir()
    (d / "metadata.json").write_text(json.dumps({"intrinsics": [[[1, 0, 0], [0, 1, 0], [0, 0, 1]]], "WH": [848, 480], "fps": 30, "serial_numbers": ["x"], "recording": {"0": {"1": 0.5, "2": 0.6}}}))
    m = tables.read_metadata(spark, f"file://{d}/metadata.json").first()
    assert m.case == "k" and m.frame_num == 2 and m.wh == [848, 480]
    (d / "split.json").write_text('{"frame_len": 10, "train": [0, 7], "test": [7, 10]}')
    assert tables.read_split(spark, f"file://{d}/split.json").first().train_hi == 7
    (d / "mask_info.json").write_text('{"0": "hand", "1": "sloth"}')
    assert {(r.obj_id, r.label) for r in tables.read_labels(spark, f"file://{d}/mask_info.json").collect()} == {("0", "hand"), ("1", "sloth")}
    np.savez(d / "0.npz", points=np.ones((1, 2, 2, 3)), colors=np.zeros((1, 2, 2, 3)), masks=np.array([[[True, False], [True, True]]]))
    assert tables.read_npz(spark, f"file://{d}/0.npz").where("depth_ok").count() == 3
    t = np.zeros((2, 3, 3))
    t[0, 1] = np.nan
    np.save(d / "gt.npy", t)
    assert tables.read_tracks(spark, f"file://{d}/gt.npy").where("x is null").count() == 1
    (d / "transforms.json").write_text(json.dumps({"camera_angle_x": 0.7, "frames": [{"file_path": "f", "transform_matrix": np.eye(4).tolist()}]}))
    r = tables.read_transforms(spark, f"file://{d}/transforms.json").first()
    assert np.allclose(r.r, np.diag([1, -1, -1])) and np.allclose(r.t, 0)
    v = spark.createDataFrame([(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2)], "part int, vid long").select("*", *[(F.col("vid") * (i + 1)).cast("double").alias(a) for i, a in enumerate("xyz")])
    f = spark.createDataFrame([(0, 0, 0, 1, 2), (1, 0, 0, 1, 2)], "part int, fid long, a long, b long, c long")
    vertices, faces = tables.merge_meshes(v, f)
    assert {(x.a, x.c) for x in faces.collect()} == {(0, 2), (3, 5)} and tables.sample_faces(vertices, faces, 5).count() == 10
    with pytest.raises(ValueError):
        tables.merge_meshes(v.limit(0), f)
    assert tables.random_cloud(spark, 100).where("abs(x) > 1.3").count() == 0
    losses = spark.createDataFrame([("a", e, x) for e, x in enumerate([3.0, 1.0, 1.0, 2.0])], "case string, epoch int, loss double")
    assert {(x.epoch, x.is_best) for x in tables.best_epoch(losses, 3).collect()} == {(0, False), (1, True), (3, False)}
    tables.write_metrics(losses, f"file://{tmp_path}/m.csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/m.csv").count() == 4
    assert tables.report(losses, {"case": 4, "loss": 6}).first().value == "a   3.0   "
    assert tables.scene_kind(["x", "sparse"]) == "colmap"


def test_override():
    @dataclasses.dataclass
    class C:
        damping: int = 100
        on: bool = False
        rate: float = 0.5

    assert tables.override(C(), {"damping": 3.7}).damping == 3.7 and tables.override(C(), {"damping": 3.7}, compat=True).damping == 3
    assert tables.override(C(), {"on": 1, "rate": "0.25"}) == C(100, True, 0.25)
    with pytest.raises(KeyError):
        tables.override(C(), {"none": 1})


# streams


def stream(spark, tmp_path, rows, schema):
    path = f"{tmp_path}/in"
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"file://{path}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{path}")


def drain(df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_resample_stream_equals_batch(spark, tmp_path):
    parts = [[("a", 0.2, 1.0), ("b", 1.4, 2.0)], [("a", 3.1, 3.0), ("a", 3.4, 4.0)], [("b", 5.0, 5.0)]]
    schema = "camera string, t double, value double"
    got = {(r.camera, r.step, r.value) for r in drain(sensors.resample_stream(stream(spark, tmp_path, parts, schema), 1.0), "res").collect()}
    batch = spark.createDataFrame([x for p in parts for x in p], schema).withColumn("id", F.monotonically_increasing_id())
    assert got == {(r.camera, r.step, r.value) for r in series.resample(batch, ["camera"], "t", ["id"], 1.0).collect()}


def test_last_k_and_queue_streams(spark, tmp_path):
    parts = [[("a", float(i), float(i))] for i in range(5)]
    out = drain(sensors.last_k_stream(stream(spark, tmp_path / "k", parts, "camera string, t double, value double"), 2), "lk", "update").collect()
    assert {(r.nth, r.t) for r in out if r.t >= 3} >= {(1, 4.0), (2, 3.0)}
    cmds = [[("a", 1, 0.5, 2.0), ("a", 2, 0.5, 1.0)], [("a", 3, 0.1, 3.0)]]
    q = drain(sensors.drain(stream(spark, tmp_path / "q", cmds, "camera string, cmd int, value double, start_ts double"), 5), "dq").orderBy("nth").collect()
    assert sorted(r.nth for r in q) == [0, 1, 2] and sensors.capacity(30, 0.5, 4) == 27


def test_watermarked_streams(spark, tmp_path):
    ts = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    parts = [[("a", 1, ts(0), 1.0), ("a", 1, ts(1), 2.0), ("a", 2, ts(2), 3.0)], [("a", 3, ts(100), 4.0)], [("a", 4, ts(500), 4.0)]]
    schema = "camera string, step_idx long, ts timestamp, value double"
    s = stream(spark, tmp_path, parts, schema)
    assert sorted(r.step_idx for r in drain(sensors.record(s), "rec").collect()) == [1, 2, 3, 4]
    hop = drain(sensors.hopping(s, "2 seconds", "1 second"), "hop").collect()
    assert sum(r.n for r in hop) >= 6
    keys = s.withColumnRenamed("camera", "key")
    spans = drain(sensors.key_spans(keys, "5 seconds"), "spans").orderBy("start").collect()
    assert spans[0].n == 3
    q = s.writeStream.foreachBatch(sensors.upsert_batch(f"file://{tmp_path}/up")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sensors.recorded(spark, f"file://{tmp_path}/up").where("step_idx = 1").count() == 1


def test_upserts_over_batches(spark, tmp_path):
    """A key that comes in several batches is there once, with its last row; a batch that is replayed replaces itself."""
    path, schema = f"file://{tmp_path}/u", "camera string, step_idx long, ts double, value double"
    write = sensors.upsert_batch(path, buckets=4)
    batches = [[("a", 1, 1.0, 1.0), ("a", 2, 1.0, 1.0), ("b", 1, 9.0, 9.0)], [("a", 1, 2.0, 2.0), ("c", 5, 1.0, 5.0)], [("b", 1, 3.0, 3.0), ("a", 2, 4.0, 4.0)]]
    for i in (0, 1, 1, 2, 2):
        write(spark.createDataFrame(batches[i], schema), i)
    assert {(r.camera, r.step_idx, r.value) for r in sensors.recorded(spark, path).collect()} == {("a", 1, 2.0), ("a", 2, 4.0), ("b", 1, 9.0), ("c", 5, 5.0)}
    with pytest.raises(FileNotFoundError):
        sensors.recorded(spark, f"file://{tmp_path}/none")


def test_actions_of_later_batches_win(spark, tmp_path):
    path, schema = f"file://{tmp_path}/a", "camera string, t double, value double"
    write = sensors.accumulate_actions(path, 1.0)
    for i, rows in enumerate([[("a", 0.2, 1.0), ("a", 3.1, 2.0)], [("a", 2.5, 7.0), ("a", 4.0, 8.0)]]):
        write(spark.createDataFrame(rows, schema), i)
    got = {(r.camera, r.step): r.value for r in sensors.recorded(spark, path).collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 2.0, ("a", 2): 7.0, ("a", 3): 8.0, ("a", 4): 8.0}


def test_synchronised_state(spark, tmp_path):
    """Samples of an earlier batch count as long as they are among the newest."""
    out, schema = [], "camera string, t double, step_idx long"
    step = sensors.synchronised_batch(f"file://{tmp_path}/s", "camera", 3, 10.0, lambda df, i: out.append({r.camera: r.t for r in df.collect()}))
    for i, rows in enumerate([[("a", 1.0, 1), ("b", 1.1, 1)], [("a", 2.0, 2), ("a", 3.0, 3)], [("b", 2.9, 2)]]):
        step(spark.createDataFrame(rows, schema), i)
    assert out == [{"a": 1.0, "b": 1.1}, {"a": 1.0, "b": 1.1}, {"a": 3.0, "b": 2.9}]


def test_options_lateness_and_slots(spark, tmp_path):
    cmds = [[("a", 1.0, "gain", 2.0), ("a", 2.0, "exposure", 5.0)], [("a", 3.0, "gain", 4.0)]]
    got = drain(sensors.apply_commands(stream(spark, tmp_path / "o", cmds, "camera string, start_ts double, option string, value double")), "opt").orderBy("start_ts").collect()
    assert json.loads(got[-1].options) == {"gain": 4.0, "exposure": 5.0}
    ts = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", ts + datetime.timedelta(seconds=2), ts)], "camera string, receive_ts timestamp, capture_ts timestamp")
    assert sensors.received(rows).first().lateness == 2.0
    fast = stream(spark, tmp_path / "f", [[("a", 0.01 * i, 1.0) for i in range(9)]], "camera string, t double, value double")
    with pytest.raises(Exception, match="slots are written"):
        drain(sensors.last_k_stream(fast, 2, slots=4, budget=1.0), "fast", "update").collect()


def test_captured_scene(spark, tmp_path):
    d = tmp_path / "scene"
    for n in ("color", "mask", "depth"):
        (d / n).mkdir(parents=True)
    (d / "color" / "0.png").write_bytes(b"x")
    grey = np.zeros((2, 3), np.uint8)
    grey[1, 2], grey[0, 0] = 255, 1
    (d / "mask" / "0.pgm").write_bytes(b"P5\n3 2\n255\n" + grey.tobytes())
    np.save(d / "mask" / "1.npy", grey)
    pose = np.eye(4)
    pose[:3, 3] = (1, 2, 3)
    (d / "camera_meta.json").write_text(json.dumps({"intrinsics": [[[10, 0, 3], [0, 12, 2], [0, 0, 1]]] * 2, "c2ws": [pose.tolist()] * 2, "WH": [6, 4]}))
    rows = capture.read_capture_scene(spark, f"file://{d}", 4).orderBy("cam").collect()
    assert [(r.fx, r.cy, r.width, r.t) for r in rows] == [(40.0, 8.0, 24, [-1.0, -2.0, -3.0])] * 2
    assert rows[0].image.endswith("color/0.png") and rows[1].image is None and rows[1].mask.endswith("1.npy") and rows[0].depth is None
    kind, cams = capture.read_scene(spark, f"file://{d}")
    assert kind == "capture" and cams.count() == 2
    assert sorted((r.path[-5], r.v, r.u) for r in capture.read_masks(spark, f"file://{d}/mask").collect()) == [("0", 0, 0), ("0", 1, 2), ("1", 0, 0), ("1", 1, 2)]
    files = capture.list_files(spark, f"file://{d}").where("folder = 'mask'").orderBy("name").collect()
    assert [(f.name, f.stem) for f in files] == [("0.pgm", "0"), ("1.npy", "1")]
    capture.copy_object(spark, f"file://{d}", "mask", f"file://{tmp_path}/copied")
    assert spark.read.parquet(f"file://{tmp_path}/copied").count() == 2


def test_case_archive_and_config(spark, tmp_path):
    pts = np.arange(18.0).reshape(2, 3, 3)
    pts[0, 1] = np.nan
    np.savez(tmp_path / "case.npz", object_points=pts, object_visibilities=np.array([[True, False, True]] * 2), object_motions_valid=np.array([[True, True, False]]), controller_points=np.zeros((2, 1, 3)))
    rows = capture.read_case_archives(spark, f"file://{tmp_path}/case.npz")
    assert rows.where("role = 'object' and visible").count() == 4 and rows.where("x is null").count() == 1 and rows.where("role = 'controller'").count() == 2
    assert rows.where("role = 'object' and motion_valid").count() == 2
    (tmp_path / "c.yaml").write_text("# settings\ndt: 5e-5\nsteps: 667  # each frame\nself_collision: False\nname: 'x'\nnone:\n")
    assert capture.read_config(spark, f"file://{tmp_path}/c.yaml") == {"dt": 5e-5, "steps": 667, "self_collision": False, "name": "x", "none": None}
    assert capture.merged_config({"a": None, "b": 2}, {"a": 1, "b": 1}) == {"a": 1, "b": 2}
    with pytest.raises(ValueError):
        capture.parse_config("  nested: 1")
    px = spark.createDataFrame([(255.0, 0.0, 0.0, 127.5)], "r double, g double, b double, a double")
    r = capture.opaque(px).first()
    assert (r.r, r.g) == (1.0, 0.5)
    body = np.arange(6, dtype="<f4").reshape(2, 3, 1, order="F").tobytes(order="F")
    (tmp_path / "m.bin").write_bytes(b"2&3&1&" + body)
    assert capture.read_arrays(spark, f"file://{tmp_path}/m.bin").where("v = 2 and u = 1").first().value == 5.0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("k", 0, 1), ("k", 1, 2)], "case string, frame int, pid int")
    capture.write_frames(rows, f"file://{tmp_path}/f")
    capture.write_frames(rows.where("frame = 1").withColumn("pid", F.lit(9)), f"file://{tmp_path}/f")
    assert {(r.frame, r.pid) for r in spark.read.parquet(f"file://{tmp_path}/f").collect()} == {(0, 1), (1, 9)}
    capture.write_artefacts(f"file://{tmp_path}/art", masks=rows, tracks=rows)
    capture.write_json(rows, f"file://{tmp_path}/j")
    assert spark.read.parquet(f"file://{tmp_path}/art/tracks").count() == 2 == spark.read.json(f"file://{tmp_path}/j").count()
    capture.append_metrics(spark, f"file://{tmp_path}/m", "r", 1, {"loss": 2.0})
    capture.append_metrics(spark, f"file://{tmp_path}/m", "r", 2, {"loss": 1.0, "psnr": 30.0})
    assert spark.read.parquet(f"file://{tmp_path}/m").count() == 3
    with pytest.raises(ZeroDivisionError):
        with capture.timed(spark, f"file://{tmp_path}/t", "k", "fit"):
            1 / 0
    with capture.timed(spark, f"file://{tmp_path}/t", "k", "fit"):
        pass
    assert sorted(r.ok for r in spark.read.parquet(f"file://{tmp_path}/t").collect()) == [False, True]
    cams = spark.createDataFrame([(1, "PINHOLE", 4, 3, [1.0, 2.0, 3.0, 4.0])], colmap.CAMERAS)
    images = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0], [0.5, 0.0, 1.0], 1, f"i{i}.png", [{"x": 1.5, "y": 2.0}] * i, [7] * i) for i in (1, 2)], colmap.IMAGES)
    points = spark.createDataFrame([(7, 1.0, 2.0, 3.0, 1, 2, 3, 0.5, [{"image_id": 1, "point2d_idx": 0}])], colmap.POINTS)
    colmap.write_model(cams, images, points, f"file://{tmp_path}/model")
    c, i, p = colmap.read_model(spark, f"file://{tmp_path}/model", ".txt")
    plain = lambda df: sorted(str(r.asDict(True)) for r in df.collect())
    assert plain(c) == plain(cams) and plain(i) == plain(images) and plain(p) == plain(points)
    asd = lambda df: [tuple(r.asDict(True).values()) for r in df.collect()]
    assert colmap.parse_cameras(colmap.render_cameras(asd(cams))) == asd(cams) and colmap.parse_images(colmap.render_images(asd(images))) == asd(images)


def test_samples_of_a_mesh(spark):
    """A cube: points over its faces by area, and inside it."""
    v = spark.createDataFrame([(i, float(i & 1), float(i >> 1 & 1), float(i >> 2 & 1)) for i in range(8)], "vid long, x double, y double, z double")
    quads = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]
    f = spark.createDataFrame([t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))], "a long, b long, c long")
    s = capture.sample_surface(v, f, 1200).toPandas()
    assert len(s) == 1200 and s.groupby(["a", "b", "c"]).size().between(99, 101).all()
    assert np.isclose(np.abs(s[["x", "y", "z"]] - 0.5).max(axis=1), 0.5).all()
    assert capture.sample_volume(spark, v, f, 500).count() == 500
    half = v.withColumn("z", F.when((F.col("vid") % 2 == 1) & (F.col("z") > 0), 0.0).otherwise(F.col("z")))
    got = capture.sample_volume(spark, half, f.where("true"), 2000).toPandas()
    assert 0.4 < len(got) / 2000 < 0.6 and (got["z"] <= 1 - got["x"] + 1e-9).all()
    assert capture.at_most(v, 3).count() == 3 and capture.at_most(v, 30).count() == 8
    order = capture.shuffled(v.select("vid"), ["vid"], 3).toPandas()
    assert all(sorted(g["vid"]) == list(range(8)) and sorted(g["nth"]) == list(range(8)) for _, g in order.groupby("round"))
