"""Case registries, metadata, array files, cameras of rendered scenes, meshes, and metric sinks."""

from __future__ import annotations

import io
import json
from dataclasses import fields, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """A registry without header: case, category, shape_prior."""
    return spark.read.schema("case string, category string, shape_prior string").csv(path).withColumn("shape_prior", F.lower(F.trim("shape_prior")) == "true")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    schema = "intrinsics array<array<array<double>>>, WH array<int>, frame_num int, fps int, serial_numbers array<string>, recording map<string,map<string,double>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("case", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))
    counted = F.array_max(F.transform(F.map_values("recording"), lambda m: F.size(m)))
    return raw.withColumnRenamed("WH", "wh").withColumn("frame_num", F.coalesce("frame_num", counted))


def read_split(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema("frame_len int, train array<int>, test array<int>").json(path, multiLine=True)
    return raw.select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1).alias("case"), "frame_len", *[F.col(n)[i].alias(f"{n}_{k}") for n in ("train", "test") for i, k in enumerate(("lo", "hi"))])


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(path, obj_id, label) of label files {"id": "label"}."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", "map<string,string>").alias("m"))
    return raw.select("path", F.explode("m").alias("obj_id", "label"))


def read_npz(spark: SparkSession, path: str) -> DataFrame:
    """(path, cam, v, u, x, y, z, r, g, b, depth_ok) of point-cloud archives with points, colors and masks; nothing in them is unpickled."""

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as z:
                    pts, col, ok = z["points"], z["colors"], z["masks"]
                cam, v, u = (a.ravel() for a in np.indices(pts.shape[:3]))
                yield pd.DataFrame({"path": p, "cam": cam, "v": v, "u": u, **{n: pts[..., i].ravel().astype(float) for i, n in enumerate("xyz")}, **{n: col[..., i].ravel().astype("f4") for i, n in enumerate("rgb")}, "depth_ok": ok.ravel().astype(bool)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, cam int, v int, u int, x double, y double, z double, r float, g float, b float, depth_ok boolean")


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """(path, frame, pid, x, y, z) of array files of shape (frames, points, 3); NaN is null."""

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                a = np.load(io.BytesIO(bytes(data)), allow_pickle=False)
                f, i = (x.ravel() for x in np.indices(a.shape[:2]))
                yield pd.DataFrame({"path": p, "frame": f, "pid": i, **{n: a[..., k].ravel().astype(float) for k, n in enumerate("xyz")}})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, frame int, pid long, x double, y double, z double")
    return rows.select("path", "frame", "pid", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in "xyz"])


def read_transforms(spark: SparkSession, path: str) -> DataFrame:
    """(file_path, fov_x, r, t) of rendered-scene cameras: the y and z axes are turned, then the camera-to-world matrix inverted."""
    raw = spark.read.schema("camera_angle_x double, frames array<struct<file_path:string,transform_matrix:array<array<double>>>>").json(path, multiLine=True)
    rows = raw.select("camera_angle_x", F.explode("frames").alias("f")).select("camera_angle_x", "f.file_path", "f.transform_matrix")
    m = F.col("transform_matrix")
    sign = (1.0, -1.0, -1.0)
    r = [[m[i][j] * sign[j] for j in range(3)] for i in range(3)]
    t = [-sum((r[i][j] * m[i][3] for i in range(3)), F.lit(0.0)) for j in range(3)]
    return rows.select("file_path", F.col("camera_angle_x").alias("fov_x"), F.array(*[F.array(*x) for x in r]).alias("r"), F.array(*t).alias("t"))


def merge_meshes(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts (part, vid, ...), (part, fid, a, b, c) as one mesh: ids go on from part to part. An empty scene is an error."""
    n = vertices.groupBy("part").agg((F.max("vid") + 1).alias("n")).orderBy("part").collect()
    if not n:
        raise ValueError("the scene has no mesh")
    shift, total = [], 0
    for r in n:
        shift.append((r["part"], total))
        total += r["n"]
    s = F.broadcast(vertices.sparkSession.createDataFrame(shift, f"part {dict(vertices.dtypes)['part']}, __s long"))
    v = vertices.join(s, "part").withColumn("vid", F.col("vid") + F.col("__s")).drop("__s", "part")
    return v, faces.join(s, "part").select(*[(F.col(x) + F.col("__s")).alias(x) for x in "abc"])


def sample_faces(vertices: DataFrame, faces: DataFrame, per_face: int, seed: int = 0) -> DataFrame:
    """``per_face`` points on each triangle, uniform over it."""
    e = faces
    for k in "abc":
        e = e.join(vertices.select(F.col("vid").alias(k), *[F.col(n).alias(k + n) for n in "xyz"]), k)
    e = e.withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(per_face)))).withColumn("__r", F.sqrt(F.rand(seed))).withColumn("__s", F.rand(seed + 1))
    w = {"a": 1 - F.col("__r"), "b": F.col("__r") * (1 - F.col("__s")), "c": F.col("__r") * F.col("__s")}
    return e.select("a", "b", "c", "nth", *[sum((w[k] * F.col(k + n) for k in "abc"), F.lit(0.0)).alias(n) for n in "xyz"])


def random_cloud(spark: SparkSession, n: int = 100_000, side: float = 1.3, seed: int = 0) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("pid"), *[((F.rand(seed + i) * 2 - 1) * side).alias(a) for i, a in enumerate("xyz")])


def override(config, values: dict, compat: bool = False):
    """A dataclass with ``values`` in place of its own, cast to the types these have; numbers keep fractions unless ``compat`` asks for the
    declared whole-number types. Unknown names are an error; values are data and never evaluated."""
    known = {f.name: getattr(config, f.name) for f in fields(config)}
    out = {}
    for k, v in values.items():
        if k not in known:
            raise KeyError(k)
        kind = type(known[k])
        out[k] = v if v is None or isinstance(known[k], (list, tuple, dict)) else kind(v) if compat or kind not in (int,) or isinstance(v, bool) else (float(v) if float(v) != int(v) else int(v))
    return replace(config, **out)


def write_metrics(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def report(rows: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Fixed-width lines."""
    return rows.select(F.concat(*[F.rpad(F.coalesce(F.col(c).cast("string"), F.lit("")), w, " ") for c, w in widths.items()]).alias("value"))


def best_epoch(losses: DataFrame, every: int) -> DataFrame:
    """Epochs to keep: each case's best, the earliest on ties, and every ``every``-th."""
    best = losses.groupBy("case").agg(F.min(F.struct("loss", "epoch")).alias("b")).select("case", F.col("b.epoch").alias("best"))
    return losses.join(best, "case").where((F.col("epoch") == F.col("best")) | (F.col("epoch") % every == 0)).select("case", "epoch", "loss", (F.col("epoch") == F.col("best")).alias("is_best"))


def scene_kind(names: list[str]) -> str:
    """Which reader a folder asks for, by the files it holds."""
    for marker, kind in (("sparse", "colmap"), ("transforms_train.json", "rendered"), ("camera_meta.json", "capture")):
        if marker in names:
            return kind
    raise ValueError("no known scene")


def parse_json(text: str) -> dict:
    return json.loads(text)
