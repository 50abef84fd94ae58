"""Meshes of files: vertices and triangles of PLY and OBJ files, those of a folder as one scene.

Polygons are fanned from their first corner, and the ids of each file's vertices are shifted by the vertices of the files before it, in the order of their
paths. Files are cut for reading (PLY by the data source, OBJ at lines), and counts go through ranges, so no file is held by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import scratch
from ..operators import filters
from . import formats


def fanned(faces: DataFrame, corners: Column, keep: list[str]) -> DataFrame:
    """(keep, a, b, c, nth): the triangles of polygons, an array of vertex ids each; fewer than three corners make none."""
    polygons = faces.select(*keep, corners.alias("p")).where(F.size("p") >= 3)
    rows = polygons.select(*keep, "p", F.posexplode(F.slice("p", 2, F.size("p") - 2)).alias("nth", "b"))
    return rows.select(*keep, F.col("p")[0].alias("a"), "b", F.col("p")[F.col("nth") + 2].alias("c"), "nth")


def _checked(vertices: DataFrame, faces: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables, written down; an error if either is empty, or a face has a corner that isn't there."""
    vertices, faces = scratch.store(vertices, "vertices"), scratch.store(faces, "faces")
    n, ends = vertices.count(), faces.agg(F.count("*").alias("n"), F.min(F.least("a", "b", "c")).alias("lo"), F.max(F.greatest("a", "b", "c")).alias("hi")).first()
    if not n or not ends.n:
        raise ValueError(f"{path}: {n} vertices and {ends.n} triangles")
    if ends.lo < 0 or ends.hi >= n:
        raise ValueError(f"{path}: a corner {ends.lo if ends.lo < 0 else ends.hi} of {n} vertices")
    return vertices, faces


def read_ply(spark: SparkSession, path: str, partition_bytes: int = formats.PARTITION_BYTES) -> tuple[DataFrame, DataFrame]:
    """(vertices (vid, x, y, z), faces (fid, a, b, c)) of the PLY files of ``path`` as one scene."""
    formats.register(spark)
    load = lambda element: spark.read.format("ply").option("element", element).option("partitionBytes", partition_bytes).load(path)
    v = scratch.store(filters.number_rows(load("vertex").select("path", "nth", *[F.col(c).cast("double").alias(c) for c in "xyz"]), ["path", "nth"], "vid"), "numbered")
    base = v.groupBy("path").agg(F.min("vid").alias("base"), F.count("*").alias("count"))
    f = load("face")
    corners = next(c for c in f.columns if c in ("vertex_indices", "vertex_index"))
    own = F.transform(corners, lambda i: F.when((i >= 0) & (i < F.col("count")), i + F.col("base")).otherwise(F.lit(-1).cast("long")))
    triangles = fanned(f.join(base, "path").withColumn("p", own), F.col("p"), ["path", F.col("nth").alias("face")])
    faces = filters.number_rows(triangles, ["path", "face", "nth"], "fid").select("fid", "a", "b", "c")
    return _checked(v.select("vid", *"xyz"), faces, path)


def read_obj(spark: SparkSession, path: str, one: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices (vid, x, y, z), faces (fid, a, b, c)) of the OBJ files of ``path`` as one scene; ``one``: they are the parts of a single mesh, in order of their
    names. Corners may carry texture and normal numbers, which are left out, and negative ones count back from the face's line."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("line"))
    lines = lines.select("path", "at", "line", F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+").alias("w")).where(F.col("w")[0].isin("v", "f"))
    counted = scratch.store(filters.prefix_sum(lines.withColumn("is_v", (F.col("w")[0] == "v").cast("long")), ["path", "at", "line"], "is_v", "upto"), "lines")
    v = counted.where("is_v = 1").select("path", (F.col("upto") - 1).alias("vid"), *[F.col("w")[i + 1].cast("double").alias(c) for i, c in enumerate("xyz")])
    base = v.groupBy(F.lit("").alias("path") if one else F.col("path")).agg(F.min("vid").alias("base"))
    number = lambda s: F.split(s, "/")[0].cast("long")
    f = counted.where("is_v = 0").withColumn("file", F.lit("") if one else F.col("path")).join(base.withColumnRenamed("path", "file"), "file")
    corners = F.transform(F.slice("w", 2, 1 << 20), lambda s: F.when(number(s) > 0, F.col("base") + number(s) - 1).when(number(s) < 0, F.col("upto") + number(s)).otherwise(F.lit(-1).cast("long")))
    faces = filters.number_rows(fanned(f, corners, ["path", "at", "line"]), ["path", "at", "line", "nth"], "fid").select("fid", "a", "b", "c")
    return _checked(v.select("vid", *"xyz"), faces, path)


def write_obj(vertices: DataFrame, faces: DataFrame, path: str) -> None:
    """The parts of one mesh, in order: vertices (vid from 0 without gaps, x, y, z), then triangles (fid, a, b, c). Read them with ``read_obj(one=True)``."""
    text = lambda *c: F.concat_ws(" ", *[x if isinstance(x, Column) else F.col(x).cast("string") for x in c])
    rows = vertices.select(F.lit(0).alias("kind"), F.col("vid").alias("nth"), text(F.lit("v"), "x", "y", "z").alias("value"))
    rows = rows.unionByName(faces.select(F.lit(1).alias("kind"), F.col("fid").alias("nth"), text(F.lit("f"), *[(F.col(c) + 1).cast("string") for c in "abc"]).alias("value")))
    parts = int(vertices.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, "kind", "nth").sortWithinPartitions("kind", "nth").select("value").write.mode("overwrite").text(path)


def areas(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """(fid, area) of the triangles."""
    corner = faces
    for k in "abc":
        corner = corner.join(vertices.select(F.col("vid").alias(k), *[F.col(x).alias(k + x) for x in "xyz"]), k)
    p, q = ([F.col(k + x) - F.col("a" + x) for x in "xyz"] for k in "bc")
    normal = (p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])
    return corner.select("fid", (F.sqrt(sum((x * x for x in normal), F.lit(0.0))) / 2).alias("area"))
