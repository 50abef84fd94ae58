"""Queries that go through files of the binary formats and meshes, and event-time pairs and runs of the samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..sources import formats, meshes
from ..streaming import state
from . import views as V
from .catalog import c, query, r6, xyz


@query(f"WITH {V.PTS} SELECT pid, part, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts WHERE x > 0")
def ply_records(spark, sf_dir):
    """The points as one PLY file that several tasks write, read again by many tasks with the filter in the read."""
    formats.register(spark)
    where = scratch.path(spark, "points") + "/points.ply"
    V.pts(spark, sf_dir).repartition(4, "pid").write.format("ply").option("single", "true").mode("overwrite").save(where)
    rows = spark.read.format("ply").option("partitionBytes", 1 << 16).option("pushdown", "true").load(where).where(c("x") > F.lit(0.0))
    return rows.select(c("pid").cast("long").alias("pid"), c("part").cast("int").alias("part"), *xyz())


@query(f"""WITH {V.PTS} SELECT p.pid AS id, p.part AS red, count(DISTINCT q.part) AS parts, count(*) AS n FROM pts p JOIN pts q ON q.pid // 8 = p.pid // 8 GROUP BY ALL""")
def model_points(spark, sf_dir):
    """Points of a model with their observations, written by several tasks as one binary file and read again in parts."""
    formats.register(spark)
    p = V.pts(spark, sf_dir)
    tracks = p.groupBy(F.floor(c("pid") / 8).alias("block")).agg(F.collect_list(F.struct(c("part").cast("int").alias("image_id"), c("pid").cast("int").alias("point2d_idx"))).alias("track"))  # eight points at most
    rows = p.withColumn("block", F.floor(c("pid") / 8)).join(tracks, "block").select(c("pid").alias("id"), "x", "y", "z", c("part").cast("int").alias("red"), F.lit(0).alias("green"), F.lit(0).alias("blue"), F.lit(0.5).alias("error"), "track")
    where = scratch.path(spark, "model") + "/points3D.bin"
    rows.repartition(4, "id").write.format("points3d").option("single", "true").mode("overwrite").save(where)
    got = spark.read.format("points3d").option("partitionBytes", 1 << 16).load(where)
    return got.select("id", "red", F.size(F.array_distinct(c("track.image_id"))).cast("long").alias("parts"), F.size("track").cast("long").alias("n"))


_CORNER = "c{0} AS (SELECT row_number() OVER (ORDER BY pid) - 1 AS vid, x AS {0}x, y AS {0}y, z AS {0}z FROM pts)"


@query(f"""WITH {V.PTS}, {', '.join(_CORNER.format(k) for k in 'abc')}, f AS (SELECT vid AS fid, * FROM ca JOIN (SELECT vid - 1 AS vid, bx, by_, bz FROM (SELECT vid, bx, "by" AS by_, bz FROM cb)) USING (vid) JOIN (SELECT vid - 2 AS vid, cx, cy, cz FROM cc) USING (vid))
SELECT fid, round(sqrt(pow((by_ - ay) * (cz - az) - (bz - az) * (cy - ay), 2) + pow((bz - az) * (cx - ax) - (bx - ax) * (cz - az), 2) + pow((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax), 2)) / 2, 6) AS area FROM f""")
def mesh_areas(spark, sf_dir):
    """A strip of triangles over the points, written as the parts of a mesh file and read again."""
    from ..operators import filters

    v = filters.number_rows(V.pts(spark, sf_dir).select("pid", "x", "y", "z"), ["pid"], "vid").select("vid", "x", "y", "z")
    n = v.count()
    faces = v.where(c("vid") < n - 2).select(c("vid").alias("fid"), c("vid").alias("a"), (c("vid") + 1).alias("b"), (c("vid") + 2).alias("c"))
    where = scratch.path(spark, "mesh")
    meshes.write_obj(v, faces, where)
    return meshes.areas(*meshes.read_obj(spark, where, one=True)).select("fid", r6("area").alias("area"))


@query(f"""WITH {V.SMP}, d AS (SELECT *, lag(t) OVER (PARTITION BY cam ORDER BY t, event_id) AS p FROM smp), r AS (SELECT *, max(CASE WHEN p IS NULL OR t - p > 5400 THEN t END) OVER (PARTITION BY cam ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS b FROM d),
g AS (SELECT *, CAST(floor((t - b) / 600.0::DOUBLE + 1e-5) AS BIGINT) AS g FROM r), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY cam, b, g ORDER BY t, event_id) = 1), q AS (SELECT *, coalesce(lag(g) OVER (PARTITION BY cam, b ORDER BY g), -1) AS before FROM f)
SELECT cam, event_id, round(b, 3) AS "begin", unnest(range(before + 1, g + 1)) AS step FROM q""")
def resample_runs(spark, sf_dir):
    """Samples of each camera every ten minutes, on grids that begin anew after pauses of an hour and a half."""
    return state.resample_runs(V.smp(spark, sf_dir), ["cam"], "t", ["event_id"], 600.0, 5400.0).select("cam", "event_id", F.round("begin", 3).alias("begin"), "step")


@query("""WITH e AS (SELECT event_id, user_id % 3 AS cam, ts FROM events), p AS (SELECT a.event_id AS a, b.event_id AS b, epoch_us(b.ts) - epoch_us(a.ts) AS gap_us, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(epoch_us(b.ts) - epoch_us(a.ts)), b.ts, b.event_id) AS rn
FROM e a JOIN e b ON a.cam = 0 AND b.cam > 0 AND b.ts BETWEEN a.ts - INTERVAL 600 SECOND AND a.ts + INTERVAL 600 SECOND) SELECT a, b, CAST(gap_us AS BIGINT) AS gap_us FROM p WHERE rn = 1""")
def camera_pairs(spark, sf_dir):
    """For each frame of the first camera the frame of the others nearest in time, ten minutes away at most."""
    e = V.table(spark, sf_dir, "events").select(c("event_id").alias("id"), (c("user_id") % 3).alias("cam"), c("ts").cast("timestamp").alias("ts"))
    out = state.closest_pairs(e.where("cam = 0"), e.where("cam > 0"), 600_000)
    gap = F.unix_micros("b_ts") - F.unix_micros("a_ts")
    one = out.groupBy("a_id").agg(F.min(F.struct(F.abs(gap).alias("far"), "b_ts", "b_id", gap.alias("gap"))).alias("m"))  # a frame that stands at several times
    return one.select(c("a_id").alias("a"), c("m.b_id").alias("b"), c("m.gap").alias("gap_us"))


def _sql_cross(p: str, q: str) -> tuple[str, str, str]:
    return tuple(f"({p}{i} * {q}{j} - {p}{j} * {q}{i})" for i, j in (("y", "z"), ("z", "x"), ("x", "y")))


_H, _Q = _sql_cross("d", "f"), _sql_cross("s", "e")


@query(f"""WITH {V.PTS}, {V.CAMS}, v AS (SELECT row_number() OVER (ORDER BY pid) - 1 AS vid, x, y, z FROM pts),
f AS (SELECT a.vid AS fid, a.x AS ax, a.y AS ay, a.z AS az, b.x - a.x AS ex, b.y - a.y AS ey, b.z - a.z AS ez, c.x - a.x AS fx_, c.y - a.y AS fy_, c.z - a.z AS fz_ FROM v a JOIN v b ON b.vid = a.vid + 1 JOIN v c ON c.vid = a.vid + 2),
r AS (SELECT cam, vid, m3 AS ox, m7 AS oy, m11 AS oz, (x - m3) / far AS dx, (y - m7) / far AS dy, (z - m11) / far AS dz, far FROM (SELECT cam, m3, m7, m11, vid, x, y, z, sqrt((x - m3) * (x - m3) + (y - m7) * (y - m7) + (z - m11) * (z - m11)) AS far FROM v, cams)),
g AS (SELECT cam, vid, far, fid, dx, dy, dz, ex, ey, ez, fx_ AS fx, fy_ AS fy, fz_ AS fz, ox - ax AS sx, oy - ay AS sy, oz - az AS sz FROM r, f),
h AS (SELECT *, ex * {_H[0]} + ey * {_H[1]} + ez * {_H[2]} AS det, sx * {_H[0]} + sy * {_H[1]} + sz * {_H[2]} AS u, dx * {_Q[0]} + dy * {_Q[1]} + dz * {_Q[2]} AS w, fx * {_Q[0]} + fy * {_Q[1]} + fz * {_Q[2]} AS t FROM g),
k AS (SELECT cam, vid, min(t / det) AS t FROM h WHERE abs(det) > 1e-12 AND u / det >= 0 AND w / det >= 0 AND u / det + w / det <= 1 AND t / det > 1e-9 AND t / det < far - 1e-4 GROUP BY ALL)
SELECT r.cam, r.vid, k.t IS NULL AS visible FROM r LEFT JOIN k USING (cam, vid)""")
def mesh_visibility(spark, sf_dir):
    """Which points each camera sees past the strip of triangles over all points."""
    from ..operators import filters, rays

    v = scratch.store(filters.number_rows(V.pts(spark, sf_dir).select("pid", "x", "y", "z"), ["pid"], "vid").select("vid", "x", "y", "z"), "vertices")
    n = v.count()
    faces = v.where(c("vid") < n - 2).select(c("vid").alias("fid"), c("vid").alias("a"), (c("vid") + 1).alias("b"), (c("vid") + 2).alias("c"))
    eyes = V.cams(spark).select(c("cam").alias("eye"), c("m3").alias("x"), c("m7").alias("y"), c("m11").alias("z"))
    return rays.visible_from(v, faces, eyes).select(c("eye").alias("cam"), "vid", "visible")
