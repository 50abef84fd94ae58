"""Entity views of the driver's tables, for Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAMES = 20
#: Three fixed cameras of 848 x 480 pixels: fx, fy, cx, cy and a rigid camera-to-world matrix, row by row.
CAMERAS = (
    (0, 425.1, 424.3, 421.7, 243.2, (1.0, 0.0, 0.0, 0.113, 0.0, 1.0, 0.0, -0.217, 0.0, 0.0, 1.0, 0.331)),
    (1, 431.9, 430.7, 418.3, 238.9, (0.8, 0.0, 0.6, -0.419, 0.0, 1.0, 0.0, 0.127, -0.6, 0.0, 0.8, 0.223)),
    (2, 428.3, 427.1, 425.9, 241.1, (0.8, -0.6, 0.0, 0.311, 0.6, 0.8, 0.0, 0.173, 0.0, 0.0, 1.0, -0.129)),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pid"), F.col("label").alias("part"), *[e[i].cast("double").alias(c) for i, c in enumerate("xyz")])


def trk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding", F.explode(F.sequence(F.lit(0), F.lit(FRAMES - 1))).alias("frame"))
    e, f = F.col("embedding"), F.col("frame")
    xyz = [(e[i].cast("double") + 0.05 * F.get(e, 3 + 3 * f + i).cast("double")).alias(c) for i, c in enumerate("xyz")]
    return rows.select("frame", F.col("vec_id").alias("pid"), F.col("label").alias("part"), *xyz, ((F.col("vec_id") * 31 + f * 17) % 10 != 0).alias("visible"), (0.02 * F.get(e, (f + 7) % 64).cast("double")).alias("shift"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trk(spark, sf_dir).select("frame", "pid", "part", *[(F.col(c) + F.col("shift")).alias(c) for c in "xyz"])


def smp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples: camera, event, seconds since 2024-01-01, value."""
    start = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    secs = (F.unix_micros(F.col("ts").cast("timestamp")) - start) / 1e6
    return table(spark, sf_dir, "events").select(F.concat(F.lit("cam"), (F.col("user_id") % 3).cast("string")).alias("cam"), "event_id", secs.alias("t"), "value")


def pix(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        (c("l_orderkey") % 8).alias("frame"), (c("l_suppkey") % 3).alias("cam"), (c("l_partkey") % 848).alias("u"), ((c("l_partkey") * 7 + c("l_linenumber") * 13) % 480).alias("v"),
        (F.floor("l_extendedprice") % 2000).alias("depth_mm"), F.when(c("l_linestatus") == "O", "object").otherwise("controller").alias("role"),
    )


def cams(spark: SparkSession) -> DataFrame:
    names = ["cam", "fx", "fy", "cx", "cy", *[f"m{i}" for i in range(12)]]
    return spark.createDataFrame([(i, fx, fy, cx, cy, *m) for i, fx, fy, cx, cy, m in CAMERAS], "cam long, " + ", ".join(f"{n} double" for n in names[1:]))


def img(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two grey images for each frame, in [0, 1]; one value for a pixel."""
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select((c("l_orderkey") % 8).alias("frame"), (c("l_partkey") % 64).alias("u"), ((c("l_partkey") * 7 + c("l_linenumber") * 13) % 64).alias("v"), "l_quantity", "l_discount")
    return rows.groupBy("frame", "u", "v").agg(F.min(c("l_quantity") / 50.0 * 0.7071067811865476).alias("a"), F.max(c("l_discount") * 7.0710678118654755).alias("b"))



def blob(spark, sf_dir) -> DataFrame:
    """A mask of each frame: pixels that order lines fall on, coarsened to squares of 8."""
    p = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 20).cast("int").alias("frame"), (F.col("l_partkey") % 80 * 8).alias("u0"), ((F.col("l_partkey") * 7 + F.col("l_linenumber") * 13) % 60 * 8).alias("v0")).distinct()
    d = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("k")
    return p.select("frame", "u0", "v0", d).select("frame", (F.col("u0") + F.col("k") % 8).alias("u"), (F.col("v0") + F.floor(F.col("k") / 8)).alias("v"))


_E = "CAST(embedding[{}] AS DOUBLE)"
PTS = f"pts AS (SELECT vec_id AS pid, label AS part, {_E.format(1)} AS x, {_E.format(2)} AS y, {_E.format(3)} AS z FROM embeddings)"
TRK = (
    f"trk AS (SELECT CAST(f AS INTEGER) AS frame, vec_id AS pid, label AS part, {_E.format(1)} + 0.05::DOUBLE * {_E.format('4 + 3 * f')} AS x, {_E.format(2)} + 0.05::DOUBLE * {_E.format('5 + 3 * f')} AS y, "
    f"{_E.format(3)} + 0.05::DOUBLE * {_E.format('6 + 3 * f')} AS z, (vec_id * 31 + f * 17) % 10 <> 0 AS visible, 0.02::DOUBLE * {_E.format('(f + 7) % 64 + 1')} AS shift FROM embeddings, range(0, {FRAMES}) r(f))"
)
PRED = f"{TRK}, pred AS (SELECT frame, pid, part, x + shift AS x, y + shift AS y, z + shift AS z FROM trk)"
SMP = "smp AS (SELECT concat('cam', CAST(user_id % 3 AS VARCHAR)) AS cam, event_id, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00')) / 1e6::DOUBLE AS t, value FROM events)"
PIX = (
    "pix AS (SELECT l_orderkey % 8 AS frame, l_suppkey % 3 AS cam, l_partkey % 848 AS u, (l_partkey * 7 + l_linenumber * 13) % 480 AS v, CAST(floor(l_extendedprice) AS BIGINT) % 2000 AS depth_mm, "
    "CASE WHEN l_linestatus = 'O' THEN 'object' ELSE 'controller' END AS role FROM lineitem)"
)
CAMS = "cams AS (SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {', '.join(f'{x}::DOUBLE' for x in (fx, fy, cx, cy, *m))})" for i, fx, fy, cx, cy, m in CAMERAS) + ") t(cam, fx, fy, cx, cy, " + ", ".join(f"m{i}" for i in range(12)) + "))"
IMG = "img AS (SELECT l_orderkey % 8 AS frame, l_partkey % 64 AS u, (l_partkey * 7 + l_linenumber * 13) % 64 AS v, min(l_quantity / 50.0 * 0.7071067811865476::DOUBLE) AS a, max(l_discount * 7.0710678118654755::DOUBLE) AS b FROM lineitem GROUP BY ALL)"
BLOB = "blob AS (SELECT frame, u0 + k % 8 AS u, v0 + k // 8 AS v FROM (SELECT DISTINCT CAST(l_orderkey % 20 AS INTEGER) AS frame, l_partkey % 80 * 8 AS u0, (l_partkey * 7 + l_linenumber * 13) % 60 * 8 AS v0 FROM lineitem), range(0, 64) r(k))"
