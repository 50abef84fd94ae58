"""Data sources: files cut at record offsets, filters pushed into the read, writers with commit and abort."""

import contextlib
import io
import os
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointloom.sources import colmap, formats, ply


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def cloud(n):
    rng = np.random.default_rng(0)
    return pd.DataFrame({**{c: rng.normal(size=n).astype("f4") for c in "xyz"}, **{c: rng.integers(0, 256, n).astype(np.uint8) for c in ("red", "green", "blue")}})


def test_ply_is_cut_at_records(known, tmp_path):
    v = cloud(5000)
    (tmp_path / "a.ply").write_bytes(ply.render(v))
    one = known.read.format("ply").load(f"{tmp_path}/a.ply")
    many = known.read.format("ply").option("partitionBytes", 15 * 625).load(f"file://{tmp_path}/a.ply")
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 8
    got = rows(many, "nth")
    assert got == rows(one, "nth") and len(got) == 5000 and [r[2] for r in got] == v["x"].tolist() and [r[5] for r in got] == v["red"].tolist()
    assert many.select("red", "path").where("red > 250").count() == int((v["red"] > 250).sum())


def test_filters_are_pushed(known, tmp_path):
    v = cloud(3000)
    v.loc[5, "x"] = np.nan
    (tmp_path / "a.ply").write_bytes(ply.render(v))
    load = lambda push: known.read.format("ply").option("partitionBytes", 1500).option("pushdown", push).load(f"{tmp_path}/a.ply")
    some = load("true").where("nth >= 100 and nth < 150 and x > float(0.5) and red in (1, 2, 3, 4, 5, 6, 7, 8, 9, 200)")
    assert ") Filter" not in plan(some) and "GreaterThan" in plan(some), plan(some)
    want = [i for i in range(100, 150) if v["x"][i] > 0.5 and v["red"][i] in (*range(1, 10), 200)]
    assert [r.nth for r in some.orderBy("nth").collect()] == want
    assert some.rdd.getNumPartitions() == 1  # 50 records are in one span of 100
    for text in ("x > float(0.1)", "x <= 0.1", "x = float('NaN')", "x < float('NaN')", "x >= float('NaN')", "x in (float('NaN'), float(1))", "x is not null", "nth in (5, 6)", "nth = -1", "not (x > 0)", "x > y", "path like '%a.ply'", f"path = '{tmp_path}/a.ply'", "path = 'b'"):
        plain = load("false").where(text).select("nth")
        assert ") Filter" in plan(plain)
        assert rows(load("true").where(text).select("nth"), "nth") == rows(plain, "nth"), text


FACES = b"element vertex 3\nproperty float x\nproperty double y\nelement face 2\nproperty list uchar int vertex_indices\nproperty uchar flag\nend_header\n"


def test_ply_lists_and_text(known, tmp_path):
    (tmp_path / "t.ply").write_bytes(b"ply\nformat ascii 1.0\ncomment c\n" + FACES + b"1 2\n3 4\n5 6.5\n3 0 1 2 7\n4 0 1 2 0 9\n")
    for order, name in (("<", "little"), (">", "big")):
        body = np.array([(1, 2), (3, 4), (5, 6.5)], [("x", order + "f4"), ("y", order + "f8")]).tobytes()
        body += b"".join(bytes([len(f)]) + np.array(f, order + "i4").tobytes() + bytes([x]) for f, x in (((0, 1, 2), 7), ((0, 1, 2, 0), 9)))
        (tmp_path / f"{name}.ply").write_bytes(f"ply\nformat binary_{name}_endian 1.0\n".encode() + FACES + body)
    for f in ("t", "little", "big"):
        read = known.read.format("ply").option("element", "face").load(f"{tmp_path}/{f}.ply")
        assert [(r.nth, list(r.vertex_indices), r.flag) for r in read.orderBy("nth").collect()] == [(0, [0, 1, 2], 7), (1, [0, 1, 2, 0], 9)]
        assert rows(known.read.format("ply").load(f"{tmp_path}/{f}.ply").select("x", "y"), "x") == [(1, 2), (3, 4), (5, 6.5)]
    assert known.read.format("ply").load(str(tmp_path)).groupBy("path").count().count() == 3
    (tmp_path / "short.ply").write_bytes((tmp_path / "little.ply").read_bytes()[:-3])
    with pytest.raises(Exception, match="ends early"):
        known.read.format("ply").option("element", "face").load(f"{tmp_path}/short.ply").collect()


def test_points_are_cut_at_records(known, tmp_path):
    rng = np.random.default_rng(1)
    pts = [(i, *rng.normal(size=3), *map(int, rng.integers(0, 256, 3)), float(rng.random()), [{"image_id": int(a), "point2d_idx": int(b)} for a, b in rng.integers(0, 99, (int(rng.integers(0, 9)), 2))]) for i in range(2000)]
    (tmp_path / "points3D.bin").write_bytes(colmap.render_points(pts))
    one, many = (known.read.format("points3d").option("partitionBytes", b).load(f"{tmp_path}/points3D.bin") for b in (1 << 20, 20_000))
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() > 7
    want = rows(colmap.read_points(known, f"file://{tmp_path}/points3D.bin"), "id")
    assert rows(one.drop("path"), "id") == want and rows(many.drop("path"), "id") == want
    some = known.read.format("points3d").option("pushdown", "true").load(str(tmp_path)).where("error < double(0.1) and id > 1000")
    assert "LessThan" in plan(some) and some.count() == sum(p[0] > 1000 and p[7] < 0.1 for p in pts)


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_npz_is_cut_at_rows(known, tmp_path, save):
    rng = np.random.default_rng(2)
    p, c, m = rng.normal(size=(2, 30, 40, 3)), rng.integers(0, 255, (2, 30, 40, 3)).astype("u1"), rng.random((2, 30, 40)) > 0.5
    save(tmp_path / "a.npz", points=p, colors=c, mask=m, other=np.arange(3))
    one, many = (known.read.format("npz").option("axes", 3).schema("nth long, i0 int, i1 int, i2 int, points array<double>, colors array<int>, mask boolean").option("partitionBytes", b).load(f"{tmp_path}/a.npz") for b in (1 << 20, 8400))
    assert one.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 8
    got = rows(many, "nth")
    assert got == rows(one, "nth")
    assert all(x[4] == p[x[1:4]].tolist() and x[5] == c[x[1:4]].tolist() and x[6] == m[x[1:4]] for x in got) and len(got) == 2400
    assert many.where("i0 = 1 and mask").count() == int(m[1].sum()) and many.count() == 2400
    with pytest.raises(Exception, match="different extents"):
        known.read.format("npz").load(f"{tmp_path}/a.npz").collect()
    auto = known.read.format("npz").option("axes", 3).load(f"{tmp_path}/a.npz")
    assert auto.columns == ["path", "nth", "i0", "i1", "i2", "points", "colors", "mask"]
    with zipfile.ZipFile(tmp_path / "bad.npz", "w") as z:
        b = io.BytesIO()
        np.save(b, np.array([{}], object), allow_pickle=True)
        z.writestr("x.npy", b.getvalue())
    with pytest.raises(Exception, match="plain values"):
        known.read.format("npz").load(f"{tmp_path}/bad.npz").collect()


def test_written_files_read_back(known, tmp_path):
    df = known.range(1000).repartition(5, "id").select(F.col("id").cast("double").alias("x"), (F.col("id") / 3).cast("float").alias("y"), (F.col("id") % 256).cast("int").alias("red"), F.when(F.col("id") > 2, F.col("id") * 1.5).alias("z"), (F.col("id") % 2 == 0).alias("on"))
    df.write.format("ply").option("single", "true").mode("append").save(f"{tmp_path}/one.ply")
    df.write.format("ply").mode("append").save(f"{tmp_path}/many")
    assert sorted(os.listdir(tmp_path)) == ["many", "one.ply"] and len(os.listdir(tmp_path / "many")) == 5
    want = rows(df.select("x", "y", "red", F.coalesce("z", F.lit(float("nan"))).alias("z"), F.col("on").cast("int")), "x")
    for p in ("one.ply", "many"):
        got = known.read.format("ply").option("partitionBytes", 4000).load(f"{tmp_path}/{p}").select("x", "y", "red", "z", "on")
        assert repr(rows(got, "x")) == repr(want)
    assert len(ply.parse((tmp_path / "one.ply").read_bytes())) == 1000
    with pytest.raises(Exception, match="one.ply"):
        df.write.format("ply").option("single", "true").mode("append").save(f"{tmp_path}/one.ply")
    df.limit(0).write.format("ply").option("single", "true").mode("overwrite").save(f"{tmp_path}/one.ply")
    assert known.read.format("ply").load(f"{tmp_path}/one.ply").count() == 0
    df.where("x < 10").coalesce(1).write.format("ply").mode("overwrite").save(f"{tmp_path}/many")
    assert known.read.format("ply").load(f"{tmp_path}/many").count() == 10


def test_points_written_by_several_tasks(known, tmp_path):
    pts = known.range(300).repartition(4).select("id", *[(F.col("id") * i).cast("double").alias(n) for i, n in enumerate("xyz")], *[(F.col("id") % (200 + i)).cast("int").alias(n) for i, n in enumerate(("red", "green", "blue"))], F.rand(1).alias("error"), F.when(F.col("id") % 3 > 0, F.transform(F.sequence(F.lit(1), (F.col("id") % 3).cast("int")), lambda i: F.struct(i.alias("image_id"), (i + 1).alias("point2d_idx")))).alias("track"))
    pts = known.createDataFrame(pts.collect(), pts.schema).repartition(4, "id")
    pts.write.format("points3d").option("single", "true").mode("append").save(f"{tmp_path}/points3D.bin")
    none = F.array().cast(formats.TRACK)
    assert rows(colmap.read_points(known, f"file://{tmp_path}/points3D.bin"), "id") == rows(pts.withColumn("track", F.coalesce("track", none)), "id")


def test_a_failed_task_leaves_nothing(known, tmp_path):
    bad = known.range(100).repartition(4).select(F.when(F.col("id") == 77, F.raise_error(F.lit("no"))).otherwise(F.col("id").cast("double")).alias("x"))
    for target, single in (("f.ply", "true"), ("d", "false")):
        with pytest.raises(Exception, match="no"):
            bad.write.format("ply").option("single", single).mode("append").save(f"{tmp_path}/{target}")
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="no property"):
        known.range(3).select(F.array("id").alias("x")).write.format("ply").mode("append").save(f"{tmp_path}/a.ply")
    with pytest.raises(Exception, match="red is null"):
        known.range(3).select(F.lit(None).cast("int").alias("red")).write.format("ply").mode("append").save(f"{tmp_path}/a.ply")
    assert os.listdir(tmp_path) == []


def test_a_stream_is_recorded_once(known, tmp_path):
    for i in range(3):
        known.range(i * 10, i * 10 + 10).select(F.col("id").cast("double").alias("x")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    source = known.readStream.schema("x double").option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")

    def run():
        q = source.writeStream.format("ply").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()

    run()
    assert rows(known.read.format("ply").load(f"{tmp_path}/out").select("x"), "x") == [(float(i),) for i in range(30)]
    os.remove(tmp_path / "c/commits/2")  # the last batch counts as not done, and runs again
    with contextlib.suppress(FileNotFoundError):
        os.remove(tmp_path / "c/commits/.2.crc")
    run()
    assert known.read.format("ply").load(f"{tmp_path}/out").count() == 30 and any(f.startswith("batch-000000002") for f in os.listdir(tmp_path / "out"))
