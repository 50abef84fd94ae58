"""Folders of captured scenes: listings, masks, case archives, configurations, scene cameras, and the sinks of a run."""

from __future__ import annotations

import io
import re
import time
from collections.abc import Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import colmap, tables

# sources


def list_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, folder, name, stem, length, modified) of the files under ``path``; their contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", F.col("modificationTime").alias("modified"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return raw.select("path", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("folder"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "length", "modified")


def grey_image(data: bytes) -> np.ndarray:
    """A grey image of one of two formats that need no codec: a binary portable graymap, or an array file."""
    if data[:2] == b"P5":
        head = re.match(rb"P5\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
        w, h, top = (int(x) for x in head.groups())
        return np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h, head.end()).reshape(h, w)
    a = np.load(io.BytesIO(data), allow_pickle=False)
    return a if a.ndim == 2 else a[..., 0]


def read_masks(spark: SparkSession, path: str) -> DataFrame:
    """(path, v, u) of the pixels that are on, brighter than 0, in grey mask files."""

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                v, u = np.nonzero(grey_image(bytes(data)) > 0)
                yield pd.DataFrame({"path": p, "v": v.astype("int32"), "u": u.astype("int32")})

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content").mapInPandas(run, "path string, v int, u int")


def read_case_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, role, frame, pid, x, y, z, visible, motion_valid) of a case's array archives: ``object_points`` and ``controller_points`` of shape
    (frames, points, 3), with ``object_visibilities`` and ``object_motions_valid`` if there. Nothing in them is unpickled: other artefacts are
    to be converted where they are made. NaN is null."""

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                with np.load(io.BytesIO(bytes(data)), allow_pickle=False) as z:
                    for role in ("object", "controller"):
                        if f"{role}_points" not in z:
                            continue
                        a = z[f"{role}_points"]
                        f, i = (x.ravel() for x in np.indices(a.shape[:2]))
                        flag = lambda n, role=role, a=a, z=z: z[f"{role}_{n}"].ravel().astype(bool) if f"{role}_{n}" in z else np.ones(a.shape[:2], bool).ravel()
                        moved = np.pad(flag("motions_valid"), (0, max(0, a.shape[0] * a.shape[1] - len(flag("motions_valid")))))  # the last frame has no motion
                        yield pd.DataFrame({"path": p, "role": role, "frame": f, "pid": i, **{n: a[..., k].ravel().astype(float) for k, n in enumerate("xyz")}, "visible": flag("visibilities"), "motion_valid": moved})

    rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, role string, frame int, pid long, x double, y double, z double, visible boolean, motion_valid boolean")
    return rows.select("path", "role", "frame", "pid", *[F.when(~F.isnan(n), F.col(n)).alias(n) for n in "xyz"], "visible", "motion_valid")


def parse_config(text: str) -> dict:
    """Flat ``key: value`` settings; numbers, true, false and null are read as such, and nothing is evaluated."""
    out = {}
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*$", "", line).rstrip()
        if not line.strip():
            continue
        if line[0].isspace() or ":" not in line:
            raise ValueError(f"not a flat setting: {line!r}")
        key, _, value = line.partition(":")
        value = value.strip()
        low = value.lower()
        if low in ("true", "false"):
            out[key.strip()] = low == "true"
        elif low in ("", "null", "~"):
            out[key.strip()] = None
        elif re.fullmatch(r"[-+]?\d+", value):
            out[key.strip()] = int(value)
        elif re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", value):
            out[key.strip()] = float(value)
        else:
            out[key.strip()] = value.strip("'\"")
    return out


def read_config(spark: SparkSession, path: str) -> dict:
    """``parse_config`` of one file on any store."""
    return parse_config(spark.read.text(path, wholetext=True).first().value)


def merged_config(given: dict, stored: dict) -> dict:
    """What is given counts, unless it is None; values are data."""
    return stored | {k: v for k, v in given.items() if v is not None}


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(path, v, u, channel, value) of dense maps of a structure-from-motion model."""

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf["path"], pdf["content"], strict=True):
                a = colmap.parse_array(bytes(data))
                a = a[..., None] if a.ndim == 2 else a
                v, u, ch = (x.ravel() for x in np.indices(a.shape))
                yield pd.DataFrame({"path": p, "v": v.astype("int32"), "u": u.astype("int32"), "channel": ch.astype("int32"), "value": a.ravel().astype("f4")})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, v int, u int, channel int, value float")


def opaque(pixels: DataFrame, background: float = 1.0, scale: float = 255.0) -> DataFrame:
    """r, g, b of pixels (r, g, b, a; up to ``scale``) over a plain background, from 0 to 1."""
    a = F.col("a") / scale
    return pixels.withColumns({n: F.col(n) / scale * a + background * (1.0 - a) for n in "rgb"}).drop("a")


def read_capture_scene(spark: SparkSession, folder: str, upscale: int = 1) -> DataFrame:
    """(cam, fx, fy, cx, cy, width, height, fov_x, fov_y, r, t, image, mask, depth) of a captured scene: cameras of ``camera_meta.json`` (intrinsics,
    c2ws, WH) with the files of ``color``, ``mask`` and ``depth`` whose name is the camera's number, null where there is none. ``upscale`` 4 gives
    the intrinsics of images four times as large. r: rotation of camera-to-world; t: translation of world-to-camera."""
    raw = spark.read.schema("intrinsics array<array<array<double>>>, c2ws array<array<array<double>>>, WH array<int>").json(f"{folder}/camera_meta.json", multiLine=True)
    k = raw.select("WH", F.posexplode(F.arrays_zip("intrinsics", "c2ws")).alias("cam", "c"))
    m, i = F.col("c.c2ws"), F.col("c.intrinsics")
    w, h = F.col("WH")[0] * upscale, F.col("WH")[1] * upscale
    fx, fy = i[0][0] * upscale, i[1][1] * upscale
    t = [-sum((m[a][b] * m[a][3] for a in range(3)), F.lit(0.0)) for b in range(3)]
    cams = k.select(
        "cam", fx.alias("fx"), fy.alias("fy"), (i[0][2] * upscale).alias("cx"), (i[1][2] * upscale).alias("cy"), w.alias("width"), h.alias("height"), (2 * F.atan(w / (2 * fx))).alias("fov_x"), (2 * F.atan(h / (2 * fy))).alias("fov_y"),
        F.array(*[F.array(*[m[a][b] for b in range(3)]) for a in range(3)]).alias("r"), F.array(*t).alias("t"),
    )
    files = list_files(spark, folder).select("folder", "stem", "path")
    for name, kind in (("image", "color"), ("mask", "mask"), ("depth", "depth")):
        cams = cams.join(files.where(F.col("folder") == kind).groupBy(F.col("stem").cast("int").alias("cam")).agg(F.min("path").alias(name)), "cam", "left")
    return cams


def read_scene(spark: SparkSession, folder: str):
    """What the folder's marker file asks for: the three tables of a model, the cameras of a rendered scene, or those of a captured one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    kind = tables.scene_kind([s.getPath().getName() for s in fs.listStatus(p)])
    if kind == "colmap":
        return kind, colmap.read_model(spark, f"{folder}/sparse/0" if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/sparse/0")) else f"{folder}/sparse")
    return (kind, tables.read_transforms(spark, f"{folder}/transforms_train.json")) if kind == "rendered" else (kind, read_capture_scene(spark, folder))


# samples


def at_most(rows: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows drawn without replacement, or all if there are fewer."""
    return rows.orderBy(F.rand(seed)).limit(n)


def sample_surface(vertices: DataFrame, faces: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``n`` points, uniform over the surface: a face's share follows its area (rounded so that the sum is ``n``, by running sums)."""
    from ..operators import filters

    corner = faces
    for k in "abc":
        corner = corner.join(vertices.select(F.col("vid").alias(k), *[F.col(x).alias(k + x) for x in "xyz"]), k)
    p, q = ([F.col(k + x) - F.col("a" + x) for x in "xyz"] for k in "bc")
    normal = (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    area = F.sqrt(sum((x * x for x in normal), F.lit(0.0))) / 2
    sized = corner.withColumn("__area", area)
    total = sized.agg(F.sum("__area").alias("t")).first().t or 1.0
    upto = filters.prefix_sum(sized, ["a", "b", "c"], "__area", "__upto")
    share = F.round(F.col("__upto") / total * n).cast("long") - F.round((F.col("__upto") - F.col("__area")) / total * n).cast("long")
    rows = upto.withColumn("__n", share).where("__n > 0").withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__n")))).withColumn("__r", F.sqrt(F.rand(seed))).withColumn("__s", F.rand(seed + 1))
    w = {"a": 1 - F.col("__r"), "b": F.col("__r") * (1 - F.col("__s")), "c": F.col("__r") * F.col("__s")}
    return rows.select("a", "b", "c", "nth", *[sum((w[k] * F.col(k + x) for k in "abc"), F.lit(0.0)).alias(x) for x in "xyz"])


def sample_volume(spark: SparkSession, vertices: DataFrame, faces: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """Of ``n`` points drawn in the mesh's box those inside it, by the number of faces that a ray upwards cuts. Faces are dealt to the columns of a
    grid that they lie over, so a point meets few of them."""
    box = vertices.agg(*[f(x).alias(k + x) for x in "xyz" for k, f in (("lo", F.min), ("hi", F.max))]).first()
    side = {x: max(box["hi" + x] - box["lo" + x], 1e-12) for x in "xy"}
    cell = lambda value, x: F.floor((value - box["lo" + x]) / (side[x] / 16))
    points = spark.range(n).select(F.col("id").alias("pid"), *[(box["lo" + x] + F.rand(seed + i) * (box["hi" + x] - box["lo" + x])).alias(x) for i, x in enumerate("xyz")])
    points = points.withColumns({"__" + x: cell(F.col(x), x) for x in "xy"})
    corner = faces
    for k in "abc":
        corner = corner.join(vertices.select(F.col("vid").alias(k), *[F.col(x).alias(k + x) for x in "xyz"]), k)
    for x in "xy":
        ends = [F.col(k + x) for k in "abc"]
        corner = corner.withColumn("__" + x, F.explode(F.sequence(cell(F.least(*ends), x), cell(F.greatest(*ends), x))))
    met = points.join(corner, ["__x", "__y"])
    side_of = lambda p, q: (F.col(q + "x") - F.col(p + "x")) * (F.col("y") - F.col(p + "y")) - (F.col(q + "y") - F.col(p + "y")) * (F.col("x") - F.col(p + "x"))
    u, v, w = side_of("b", "c"), side_of("c", "a"), side_of("a", "b")
    inside = ((u >= 0) & (v >= 0) & (w >= 0)) | ((u <= 0) & (v <= 0) & (w <= 0))
    height = F.try_divide(u * F.col("az") + v * F.col("bz") + w * F.col("cz"), u + v + w)
    cuts = met.where(inside & (height > F.col("z"))).groupBy("pid").agg(F.count("*").alias("n"))
    return points.join(cuts.where("n % 2 = 1").select("pid"), "pid", "left_semi").select("pid", *"xyz")


def shuffled(rows: DataFrame, key: Sequence[str], rounds: int = 1, seed: int = 0) -> DataFrame:
    """``rows`` in an order drawn anew for each round, with ``round`` and ``nth``: each is taken once before any is taken again."""
    from pyspark.sql import Window

    drawn = rows.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("__r", F.xxhash64(*key, "round", F.lit(seed)))
    return drawn.withColumn("nth", F.row_number().over(Window.partitionBy("round").orderBy("__r", *key)) - 1).drop("__r")


# sinks


def write_frames(rows: DataFrame, path: str, by: Sequence[str] = ("case", "frame")) -> None:
    """One folder for each case and frame; what is there of these is replaced, other folders stay."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_artefacts(path: str, **tables_of: DataFrame) -> None:
    """Each table of a case as a folder of its own."""
    for name, rows in tables_of.items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def write_json(rows: DataFrame, path: str) -> None:
    """One small JSON file a folder: splits, cameras, exposures, depth parameters."""
    rows.coalesce(1).write.mode("overwrite").json(path)


def append_metrics(spark: SparkSession, path: str, run: str, step: int, values: dict[str, float]) -> None:
    """A tracker's table (run, step, name, value, at)."""
    spark.createDataFrame([(run, step, k, float(v), time.time()) for k, v in values.items()], "run string, step long, name string, value double, at double").coalesce(1).write.mode("append").parquet(path)


@contextmanager
def timed(spark: SparkSession, path: str, case: str, stage: str):
    """Appends (case, stage, seconds, ok) when the stage ends; an error goes on to the caller."""
    start, ok = time.time(), False
    try:
        yield
        ok = True
    finally:
        spark.createDataFrame([(case, stage, time.time() - start, ok)], "case string, stage string, seconds double, ok boolean").coalesce(1).write.mode("append").parquet(path)


def copy_object(spark: SparkSession, path: str, obj: Column | str, target: str) -> None:
    """The files of one object (their folder's name) with their contents, as a table (path, content)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    raw.where(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1) == obj).select("path", "content").write.mode("overwrite").parquet(target)

