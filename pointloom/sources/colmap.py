"""Structure-from-motion models, text and binary: cameras, images, points and dense arrays."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Camera models by number with how many parameters each has, fixed values.
MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8), 6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12)}
POINTS = "id long, x double, y double, z double, red int, green int, blue int, error double, track array<struct<image_id:int,point2d_idx:int>>"
IMAGES = "id int, qvec array<double>, tvec array<double>, camera_id int, name string, xys array<struct<x:double,y:double>>, point3d_ids array<long>"
CAMERAS = "id int, model string, width long, height long, params array<double>"


def parse_points(data: bytes) -> list[tuple]:
    (n,), at, out = struct.unpack_from("<Q", data), 8, []
    for _ in range(n):
        i, x, y, z, r, g, b, e, k = struct.unpack_from("<QdddBBBdQ", data, at)
        at += struct.calcsize("<QdddBBBdQ")
        t = struct.unpack_from(f"<{2 * k}i", data, at)
        at += 8 * k
        out.append((i, x, y, z, r, g, b, e, [{"image_id": t[2 * j], "point2d_idx": t[2 * j + 1]} for j in range(k)]))
    return out


def render_points(rows: list[tuple]) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for i, x, y, z, r, g, b, e, track in rows:
        out.append(struct.pack("<QdddBBBdQ", i, x, y, z, r, g, b, e, len(track)) + b"".join(struct.pack("<ii", t["image_id"], t["point2d_idx"]) for t in track))
    return b"".join(out)


def parse_cameras(data: bytes) -> list[tuple]:
    (n,), at, out = struct.unpack_from("<Q", data), 8, []
    for _ in range(n):
        i, model, w, h = struct.unpack_from("<iiQQ", data, at)
        name, k = MODELS[model]
        out.append((i, name, w, h, list(struct.unpack_from(f"<{k}d", data, at + 24))))
        at += 24 + 8 * k
    return out


def parse_images(data: bytes) -> list[tuple]:
    (n,), at, out = struct.unpack_from("<Q", data), 8, []
    for _ in range(n):
        head = struct.unpack_from("<i7di", data, at)
        at += struct.calcsize("<i7di")
        end = data.index(b"\0", at)
        name, at = data[at:end].decode("utf-8"), end + 1
        (k,) = struct.unpack_from("<Q", data, at)
        flat = struct.unpack_from("<" + "ddq" * k, data, at + 8)
        at += 8 + 24 * k
        out.append((head[0], list(head[1:5]), list(head[5:8]), head[8], name, [{"x": flat[3 * j], "y": flat[3 * j + 1]} for j in range(k)], list(flat[2::3])))
    return out


def parse_array(data: bytes) -> np.ndarray:
    """A dense map: ``width&height&channels&`` and column-major floats."""
    w, h, ch, body = data.split(b"&", 3)
    a = np.frombuffer(body, "<f4").reshape((int(w), int(h), int(ch)), order="F")
    return np.transpose(a, (1, 0, 2)).squeeze()


def _binary(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.replace("struct<image_id:int,point2d_idx:int>", "t").replace("struct<x:double,y:double>", "t").split(", ")]

    def run(batches):
        for pdf in batches:
            for data in pdf["content"]:
                yield pd.DataFrame(parse(bytes(data)), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, words) of the lines of a text model without comments, blank ones kept for records of two lines."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line"))
    return t.where(~F.col("line").startswith("#")).select("n", F.trim("line").alias("line"), F.split(F.trim("line"), r"\s+").alias("w"))


def read_points(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".bin"):
        return _binary(spark, path, parse_points, POINTS)
    w = F.col("w")
    track = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size("w") - 8) / 2) - 1).cast("int")), lambda i: F.struct(F.get(w, (8 + 2 * i).cast("int")).cast("int").alias("image_id"), F.get(w, (9 + 2 * i).cast("int")).cast("int").alias("point2d_idx")))
    rows = _lines(spark, path).where("line <> ''")
    return rows.select(w[0].cast("long").alias("id"), *[w[1 + i].cast("double").alias(n) for i, n in enumerate("xyz")], *[w[4 + i].cast("int").alias(n) for i, n in enumerate(("red", "green", "blue"))], w[7].cast("double").alias("error"), F.when(F.size("w") >= 10, track).otherwise(F.array()).cast("array<struct<image_id:int,point2d_idx:int>>").alias("track"))


def read_cameras(spark: SparkSession, path: str, pinhole: bool = True) -> DataFrame:
    """Cameras; in a text file only PINHOLE is taken unless ``pinhole`` is off."""
    if path.endswith(".bin"):
        return _binary(spark, path, parse_cameras, CAMERAS)
    w = F.col("w")
    model = F.when((w[1] == "PINHOLE") | F.lit(not pinhole), w[1]).otherwise(F.raise_error(F.lit("only PINHOLE cameras are read")))
    return _lines(spark, path).where("line <> ''").select(w[0].cast("int").alias("id"), model.alias("model"), w[2].cast("long").alias("width"), w[3].cast("long").alias("height"), F.transform(F.slice(w, 5, 64), lambda x: x.cast("double")).alias("params"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Images; in text each record has a line for the pose and one for the observations."""
    if path.endswith(".bin"):
        return _binary(spark, path, parse_images, IMAGES)
    lines = spark.read.text(path, wholetext=True).select(F.filter(F.split("value", "\n"), lambda x: ~x.startswith("#")).alias("l"))
    pairs = lines.select(F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.size("l") / 2) - 1).cast("int")), lambda i: F.struct(F.split(F.trim(F.get("l", (2 * i).cast("int"))), r"\s+").alias("w"), F.split(F.trim(F.get("l", (2 * i + 1).cast("int"))), r"\s+").alias("o")))).alias("p")).where(F.size("p.w") >= 10)
    w, o = F.col("p.w"), F.col("p.o")
    steps = F.when(F.size(o) >= 3, F.sequence(F.lit(0), (F.floor(F.size(o) / 3) - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return pairs.select(
        w[0].cast("int").alias("id"), F.transform(F.slice(w, 2, 4), lambda x: x.cast("double")).alias("qvec"), F.transform(F.slice(w, 6, 3), lambda x: x.cast("double")).alias("tvec"), w[8].cast("int").alias("camera_id"), w[9].alias("name"),
        F.transform(steps, lambda i: F.struct(F.get(o, 3 * i).cast("double").alias("x"), F.get(o, 3 * i + 1).cast("double").alias("y"))).alias("xys"), F.transform(steps, lambda i: F.get(o, 3 * i + 2).cast("long")).alias("point3d_ids"),
    )


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_model(spark: SparkSession, folder: str, ext: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cameras, images, points) of a folder; without ``ext`` binary files are looked for first."""
    if ext is None:
        ext = next((e for e in (".bin", ".txt") if all(_exists(spark, f"{folder}/{n}{e}") for n in ("cameras", "images", "points3D"))), None)
        if ext is None:
            raise FileNotFoundError(f"no model in {folder}")
    return read_cameras(spark, f"{folder}/cameras{ext}", False), read_images(spark, f"{folder}/images{ext}"), read_points(spark, f"{folder}/points3D{ext}")


def observations(images: DataFrame, points: DataFrame) -> DataFrame:
    """Image observations joined to their points; -1 and unknown ids meet none."""
    o = images.select(F.col("id").alias("image_id"), "name", F.arrays_zip("xys", "point3d_ids").alias("o")).select("image_id", "name", F.posexplode("o").alias("idx", "o"))
    return o.select("image_id", "name", "idx", F.col("o.xys.x").alias("u"), F.col("o.xys.y").alias("v"), F.col("o.point3d_ids").alias("id")).where("id >= 0").join(points.drop("track"), "id")


def mean_observations(images: DataFrame) -> DataFrame:
    return images.agg(F.count("*").alias("images"), F.avg(F.size("point3d_ids")).alias("mean_observations"))


def points_text(points: DataFrame) -> DataFrame:
    """Lines of a text point file, for ``write.text``."""
    track = F.array_join(F.transform("track", lambda t: F.concat_ws(" ", t["image_id"], t["point2d_idx"])), " ")
    return points.select(F.concat_ws(" ", "id", "x", "y", "z", "red", "green", "blue", "error", track).alias("value"))


def render_cameras(rows: list[tuple]) -> bytes:
    number = {name: i for i, (name, _) in MODELS.items()}
    return struct.pack("<Q", len(rows)) + b"".join(struct.pack("<iiQQ", i, number[m], w, h) + struct.pack(f"<{len(p)}d", *p) for i, m, w, h, p in rows)


def render_images(rows: list[tuple]) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for i, q, t, camera, name, xys, ids in rows:
        out.append(struct.pack("<i7di", i, *q, *t, camera) + name.encode("utf-8") + b"\0" + struct.pack("<Q", len(ids)) + b"".join(struct.pack("<ddq", p["x"], p["y"], j) for p, j in zip(xys, ids, strict=True)))
    return b"".join(out)


def cameras_text(cameras: DataFrame) -> DataFrame:
    """Lines of a text camera file, for ``write.text``."""
    return cameras.select(F.concat_ws(" ", "id", "model", "width", "height", F.array_join(F.transform("params", lambda p: p.cast("string")), " ")).alias("value"))


def images_text(images: DataFrame) -> DataFrame:
    """Lines of a text image file: two for each image, the pose and the observations; a heading with their mean number comes first."""
    pose = F.concat_ws(" ", "id", F.array_join(F.transform("qvec", lambda x: x.cast("string")), " "), F.array_join(F.transform("tvec", lambda x: x.cast("string")), " "), "camera_id", "name")
    seen = F.array_join(F.zip_with("xys", "point3d_ids", lambda p, i: F.concat_ws(" ", p["x"], p["y"], i)), " ")
    head = mean_observations(images).select(F.lit(-1).cast("int").alias("id"), F.concat(F.lit("# Number of images: "), F.col("images").cast("string"), F.lit(", mean observations per image: "), F.coalesce("mean_observations", F.lit(0.0)).cast("string")).alias("value"))
    rows = images.select("id", F.concat_ws("\n", pose, seen).alias("value"))
    return head.unionByName(rows).orderBy("id").select("value")


def write_model(cameras: DataFrame, images: DataFrame, points: DataFrame, folder: str) -> None:
    """A text model, each file a folder of parts; images stay in one part, as their records have two lines."""
    cameras_text(cameras).coalesce(1).write.mode("overwrite").text(f"{folder}/cameras.txt")
    images_text(images).coalesce(1).write.mode("overwrite").text(f"{folder}/images.txt")
    points_text(points).write.mode("overwrite").text(f"{folder}/points3D.txt")
