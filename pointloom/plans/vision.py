"""Registered queries on cameras, keypoints, masks, evaluation joins and unions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import cameras as C
from ..functions import geometry as G
from ..operators import filters, joins, measures, scene, series, simulate, vision
from ..streaming import sensors
from . import views as V
from .catalog import _D2, AXES, c, query, r6, xyz
from .physics import SPLATS, _ROT, _rotated, splats

SIDE = 64


def _d(x: float) -> str:
    return f"({float(x)!r})::DOUBLE"


# views


def trk_pixels(spark, sf_dir) -> DataFrame:
    """Tracks with the pixel that they fall on in an image of 640 x 480."""
    t = V.trk(spark, sf_dir)
    return t.withColumn("u", F.bround(320.0 + 400.0 * c("x")).cast("long")).withColumn("v", F.bround(240.0 + 300.0 * c("y")).cast("long"))


TRKP = f"{V.TRK}, trkp AS (SELECT *, CAST(round_even(320.0::DOUBLE + 400.0::DOUBLE * x, 0) AS BIGINT) AS u, CAST(round_even(240.0::DOUBLE + 300.0::DOUBLE * y, 0) AS BIGINT) AS v FROM trk)"


def heat(spark, sf_dir) -> DataFrame:
    """A score for every pixel of eight frames of 64 x 64."""
    grid = spark.range(8 * SIDE * SIDE).select((c("id") % 8).alias("frame"), (F.floor(c("id") / 8) % SIDE).alias("u"), F.floor(c("id") / (8 * SIDE)).alias("v"))
    rows = V.table(spark, sf_dir, "lineitem").select((c("l_orderkey") % 8).alias("frame"), (c("l_partkey") % SIDE).alias("u"), ((c("l_partkey") * 7 + c("l_linenumber") * 13) % SIDE).alias("v"), (c("l_extendedprice") * 1e-5 * 0.7071067811865476).alias("s"))
    return grid.join(rows.groupBy("frame", "u", "v").agg(F.max("s").alias("s")), ["frame", "u", "v"], "left").select("frame", "u", "v", F.coalesce("s", F.lit(0.0)).alias("score"))


HEAT = f"""hits AS (SELECT l_orderkey % 8 AS frame, l_partkey % {SIDE} AS u, (l_partkey * 7 + l_linenumber * 13) % {SIDE} AS v, max(l_extendedprice * 1e-5::DOUBLE * 0.7071067811865476::DOUBLE) AS s FROM lineitem GROUP BY ALL),
heat AS (SELECT f AS frame, a AS u, b AS v, coalesce(s, 0.0) AS score FROM range(0, 8) x(f), range(0, {SIDE}) y(a), range(0, {SIDE}) z(b) LEFT JOIN hits ON frame = f AND u = a AND v = b)"""


# masks and tracks


@query(f"WITH {V.PIX} SELECT frame, cam, count(DISTINCT (u, v)) AS n FROM pix WHERE role IN ('object', 'controller') GROUP BY ALL")
def roles_or(spark, sf_dir):
    return vision.of_roles(V.pix(spark, sf_dir).drop("depth_mm"), ["object", "controller"]).groupBy("frame", "cam").agg(F.count("*").alias("n"))


@query(f"WITH {TRKP}, {V.BLOB}, f AS (SELECT DISTINCT t.pid FROM trkp t JOIN blob b USING (frame, u, v) WHERE t.frame = 0 AND t.visible) SELECT frame, pid, visible FROM trkp SEMI JOIN f USING (pid)")
def first_frame_members(spark, sf_dir):
    return vision.first_frame_members(trk_pixels(spark, sf_dir), V.blob(spark, sf_dir)).select("frame", "pid", "visible")


@query(f"WITH {TRKP}, {V.BLOB}, m AS (SELECT DISTINCT frame, u, v FROM blob) SELECT t.frame, pid, visible AND m.u IS NOT NULL AS visible FROM trkp t LEFT JOIN m ON m.frame = t.frame AND m.u = t.u AND m.v = t.v")
def revalidate(spark, sf_dir):
    return vision.revalidate(trk_pixels(spark, sf_dir), V.blob(spark, sf_dir)).select("frame", "pid", "visible")


@query(f"WITH {V.TRK}, w AS (SELECT *, visible OR pid % 3 = 0 AS seen FROM trk), k AS (SELECT pid FROM w GROUP BY 1 HAVING bool_and(seen)) SELECT frame, count(*) AS n, round(sum(x), 6) AS x FROM w SEMI JOIN k USING (pid) GROUP BY 1")
def always_visible(spark, sf_dir):
    t = V.trk(spark, sf_dir).withColumn("visible", c("visible") | (c("pid") % 3 == 0))
    return vision.always_visible(t).groupBy("frame").agg(F.count("*").alias("n"), r6(F.sum("x")).alias("x"))


@query(f"WITH {V.PIX}, gone AS (SELECT DISTINCT frame, cam, u, v FROM pix WHERE depth_mm < 300) SELECT frame, cam, count(*) AS n FROM pix ANTI JOIN gone USING (frame, cam, u, v) GROUP BY ALL")
def drop_removed(spark, sf_dir):
    p = V.pix(spark, sf_dir)
    return filters.drop_removed(p, p.where("depth_mm < 300"), ["frame", "cam", "u", "v"]).groupBy("frame", "cam").agg(F.count("*").alias("n"))


@query(f"WITH {V.PTS} SELECT pid FROM pts a WHERE part < 5 AND EXISTS (SELECT 1 FROM pts b WHERE b.part >= 5 AND {_D2} <= 0.11::DOUBLE * 0.11::DOUBLE)")
def near_mesh(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return joins.radius_join(p.where("part < 5"), p.where("part >= 5"), 0.11, how="left_semi").select("pid")


@query("SELECT l_orderkey % 8 AS frame, count(*) AS n FROM lineitem WHERE NOT (l_linenumber = 1 AND l_quantity >= 25 AND l_suppkey % 3 = 0) GROUP BY 1")
def non_white(spark, sf_dir):
    p = V.table(spark, sf_dir, "lineitem").select((c("l_orderkey") % 8).alias("frame"), *[F.when(x, 255).otherwise(7).alias(n) for n, x in (("r", c("l_linenumber") == 1), ("g", c("l_quantity") >= 25), ("b", c("l_suppkey") % 3 == 0))])
    return p.where(vision.not_white(c("r"), c("g"), c("b"))).groupBy("frame").agg(F.count("*").alias("n"))


@query(f"""WITH {V.PIX}, p AS (SELECT DISTINCT frame, cam, u, v FROM pix WHERE role = 'controller'), m AS (SELECT DISTINCT frame, cam, u, v FROM pix WHERE role = 'object'),
k AS (SELECT frame, cam, p.v * 65536 + p.u AS id, m.u AS mu, m.v AS mv, (p.u - m.u) * (p.u - m.u) + (p.v - m.v) * (p.v - m.v) AS d, row_number() OVER (PARTITION BY frame, cam, p.u, p.v ORDER BY (p.u - m.u) * (p.u - m.u) + (p.v - m.v) * (p.v - m.v), m.v, m.u) AS rn FROM p JOIN m USING (frame, cam)),
z AS (SELECT frame, cam, u AS mu, v AS mv, min(depth_mm) AS depth FROM pix GROUP BY ALL) SELECT frame, cam, id, mu, mv, CAST(d AS BIGINT) AS dist, depth FROM k LEFT JOIN z USING (frame, cam, mu, mv) WHERE rn = 1""")
def nearest_mask_pixel(spark, sf_dir):
    p = V.pix(spark, sf_dir)
    points = p.where("role = 'controller'").select("frame", "cam", "u", "v").distinct().withColumn("id", c("v") * 65536 + c("u"))
    cloud = p.groupBy("frame", "cam", "u", "v").agg(F.min("depth_mm").alias("depth"))
    out = vision.nearest_mask_pixel(points, p.where("role = 'object'"), cloud)
    return out.select("frame", "cam", "id", "mu", "mv", c("dist").cast("long").alias("dist"), "depth")


# keypoints


def _window(value: str, by: str, order: str, reach: int = 4) -> str:
    return f"max({value}) OVER (PARTITION BY frame, {by} ORDER BY {order} RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING)"


def _largest(source: str, value: str, name: str) -> str:
    """Common table expressions of the largest value in the 9 x 9 square around each pixel."""
    return f"{name}_c AS (SELECT *, {_window(value, 'u', 'v')} AS colmax FROM {source}), {name} AS (SELECT * EXCLUDE (colmax), {_window('colmax', 'v', 'u')} AS {name} FROM {name}_c)"


_PEAKS = f"{HEAT}, {_largest('heat', 'score', 'top0')}, pk0 AS (SELECT frame, u, v, score, CAST(score = top0 AS INTEGER) AS peak FROM top0)" + "".join(
    f", {_largest(f'pk{i}', 'peak', f'near{i}')}, left{i} AS (SELECT *, CASE WHEN near{i} > 0 THEN 0.0 ELSE score END AS rest FROM near{i}), {_largest(f'left{i}', 'rest', f'top{i + 1}')}, pk{i + 1} AS (SELECT frame, u, v, score, CAST(peak = 1 OR (rest = top{i + 1} AND near{i} = 0) AS INTEGER) AS peak FROM top{i + 1})"
    for i in range(2)
)


@query(f"WITH {_PEAKS} SELECT frame, u, v, round(score, 6) AS score FROM pk2 WHERE peak = 1 AND score > 0")
def peaks(spark, sf_dir):
    return vision.peaks(heat(spark, sf_dir)).where("peak and score > 0").select("frame", "u", "v", r6("score").alias("score"))


@query(f"WITH {HEAT} SELECT frame, u, v, round(score, 6) AS score FROM heat WHERE score > 0.3 AND u >= 4 AND u < 60 AND v >= 4 AND v < 60")
def keypoints(spark, sf_dir):
    return vision.keypoints(heat(spark, sf_dir), 0.3, 4, SIDE, SIDE).select("frame", "u", "v", r6("score").alias("score"))


@query(f"WITH {HEAT}, k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, v, u) AS nth FROM heat) SELECT frame, u, v, CAST(nth AS INTEGER) AS nth FROM k WHERE nth <= 50")
def top_keypoints(spark, sf_dir):
    return vision.top_keypoints(heat(spark, sf_dir), 50).select("frame", "u", "v", "nth")


@query("""WITH e AS (SELECT user_id % 50 AS camera, value * 0.004::DOUBLE AS err FROM events) SELECT camera, count(*) AS n, round(avg(err), 6) AS error FROM e GROUP BY 1 HAVING count(*) >= 11 AND avg(err) <= 0.2""")
def calibrated(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select((c("user_id") % 50).alias("camera"), (c("value") * 0.004).alias("err"))
    return vision.calibrated(e).select("camera", "n", r6("error").alias("error"))


# joins and unions


@query("""WITH i AS (SELECT o_orderkey AS image_id, o_custkey % 200 AS camera_id, concat('view.', CAST(o_orderkey AS VARCHAR), '.png') AS name FROM orders), m AS (SELECT c_custkey AS camera_id, c_acctbal AS focal FROM customer WHERE c_custkey % 3 <> 0), z AS (SELECT concat('view.', CAST(o_orderkey AS VARCHAR)) AS stem, o_totalprice AS scale FROM orders WHERE o_orderkey % 2 = 0)
SELECT image_id, stem, focal, scale FROM (SELECT i.*, regexp_replace(name, '\\.[^./]*$', '') AS stem FROM i) LEFT JOIN m USING (camera_id) LEFT JOIN z USING (stem)""")
def images_with_cameras(spark, sf_dir):
    o, k = V.table(spark, sf_dir, "orders"), V.table(spark, sf_dir, "customer")
    images = o.select(c("o_orderkey").alias("image_id"), (c("o_custkey") % 200).alias("camera_id"), F.concat(F.lit("view."), c("o_orderkey").cast("string"), F.lit(".png")).alias("name"))
    depths = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("view."), c("o_orderkey").cast("string")).alias("stem"), c("o_totalprice").alias("scale"))
    return vision.images_with_cameras(images, k.where("c_custkey % 3 <> 0").select(c("c_custkey").alias("camera_id"), c("c_acctbal").alias("focal")), depths).select("image_id", "stem", "focal", "scale")


@query(f"WITH {V.PTS} SELECT a.pid AS a, b.pid AS b, round({_D2}, 9) AS d2 FROM pts a, pts b WHERE a.part < 5 AND b.part >= 5 ORDER BY {_D2}, a.pid, b.pid LIMIT 1")
def closest_pair(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return vision.closest_pair(p.where("part < 5"), p.where("part >= 5")).select(c("a_pid").alias("a"), c("b_pid").alias("b"), F.round("dist", 9).alias("d2"))


@query(f"""WITH {V.IMG}, m AS (SELECT DISTINCT l_orderkey % 8 AS frame, l_partkey % 64 AS u, (l_partkey * 7 + l_linenumber * 13) % 64 AS v FROM lineitem WHERE l_linestatus = 'O'), t AS (SELECT frame, u, v, b FROM img WHERE b > 0.05)
SELECT frame, count(*) AS n, round(avg(abs(img.a - t.b)), 6) AS l1 FROM img JOIN t USING (frame, u, v) JOIN m USING (frame, u, v) GROUP BY 1""")
def evaluation_rows(spark, sf_dir):
    i = V.img(spark, sf_dir)
    m = V.table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select((c("l_orderkey") % 8).alias("frame"), (c("l_partkey") % 64).alias("u"), ((c("l_partkey") * 7 + c("l_linenumber") * 13) % 64).alias("v")).distinct()
    rows = vision.evaluation_rows(i.select("frame", "u", "v", "a"), i.where("b > 0.05").select("frame", "u", "v", "b"), m, ["frame", "u", "v"])
    return rows.groupBy("frame").agg(F.count("*").alias("n"), r6(F.avg(F.abs(c("a") - c("b")))).alias("l1"))


@query(f"WITH {V.PTS} SELECT CAST(row_number() OVER (ORDER BY CASE WHEN part < 3 THEN 0 WHEN part < 6 THEN 1 ELSE 2 END, pid) - 1 AS BIGINT) AS id, pid FROM pts")
def union_with_ids(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return vision.union_with_ids([p.where("part < 3"), p.where("part >= 3 and part < 6"), p.where("part >= 6")], ["pid"]).select("id", "pid")


@query(f"WITH {V.PIX} SELECT frame, count(*) AS n FROM (SELECT frame, u, v FROM pix WHERE cam = 0 UNION SELECT frame, u, v FROM pix WHERE cam = 1 UNION SELECT frame, u, v FROM pix WHERE depth_mm < 100) GROUP BY 1")
def any_mask(spark, sf_dir):
    p = V.pix(spark, sf_dir)
    return vision.any_mask(*[p.where(x).select("frame", "u", "v") for x in ("cam = 0", "cam = 1", "depth_mm < 100")]).groupBy("frame").agg(F.count("*").alias("n"))


@query(f"WITH {V.PTS}, o AS (SELECT pid AS vid, round(x, 1) AS x, round(y, 1) AS y, round(z, 1) AS z FROM pts), r AS (SELECT min(vid) AS new_vid, x, y, z FROM o GROUP BY x, y, z) SELECT vid, new_vid FROM o JOIN r ON o.x = r.x AND o.y = r.y AND o.z = r.z")
def same_vertices(spark, sf_dir):
    o = V.pts(spark, sf_dir).select(c("pid").alias("vid"), *[(F.round(n, 1) + 0.0).alias(n) for n in AXES])
    return scene.same_vertices(o, o.groupBy(*AXES).agg(F.min("vid").alias("vid")))


_GRID = "g AS (SELECT *, CAST(floor(t / 3600.0::DOUBLE + 1e-5) AS BIGINT) AS g FROM smp), p AS (SELECT *, coalesce(greatest(max(g) OVER (PARTITION BY cam ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) AS before FROM g), rs AS (SELECT cam, unnest(range(before + 1, g + 1)) AS step, event_id, value FROM p WHERE g > before)"


@query(f"""WITH {V.SMP}, {_GRID}, q AS (SELECT cam, s AS step FROM (SELECT DISTINCT cam FROM smp), range(5, 900, 7) r(s)), b AS (SELECT cam, max(step) AS most FROM rs GROUP BY 1)
SELECT q.cam, q.step, rs.event_id, round(rs.value, 6) AS value FROM q JOIN b USING (cam) JOIN rs ON rs.cam = q.cam AND rs.step = least(q.step, most)""")
def align_steps(spark, sf_dir):
    s = V.smp(spark, sf_dir)
    steps = s.select("cam").distinct().withColumn("step", F.explode(F.sequence(F.lit(5), F.lit(899), F.lit(7)).cast("array<long>")))
    return series.align(series.resample(s, ["cam"], "t", ["event_id"], 3600.0), steps, ["cam"], ["event_id", "value"]).select("cam", "step", "event_id", r6("value").alias("value"))


@query("""WITH o AS (SELECT vec_id AS image_id, unnest(range(1, 65)) AS k, unnest(embedding) AS e FROM embeddings), r AS (SELECT image_id, k, CASE WHEN k % 5 = 0 THEN -1 ELSE (image_id * 7 + k * 3) % 900 END AS point FROM o)
SELECT image_id, count(*) AS n, CAST(sum(point) AS BIGINT) AS ids FROM r JOIN embeddings p ON p.vec_id = r.point GROUP BY 1""")
def observed_points(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    o = e.select(c("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "e")).select("image_id", F.when((c("k") + 1) % 5 == 0, F.lit(-1)).otherwise((c("image_id") * 7 + (c("k") + 1) * 3) % 900).alias("point"))
    return o.join(e.select(c("vec_id").alias("point")), "point").groupBy("image_id").agg(F.count("*").alias("n"), F.sum("point").alias("ids"))


@query("""WITH a AS (SELECT i, j, pi() * (i + 0.5::DOUBLE) / 6 - pi() / 2 AS el, 2 * pi() * j / 8 AS az FROM range(0, 6) x(i), range(0, 8) y(j)), u AS (SELECT * FROM (VALUES (0, 0, 0, 1), (1, 0, 1, 0), (2, 0, 0, -1), (3, 0, -1, 0)) t(k, ux, uy, uz))
SELECT CAST(i AS INTEGER) AS elevation, CAST(j AS INTEGER) AS azimuth, CAST(k AS INTEGER) AS up, round(2 * cos(el) * cos(az), 6) AS x, round(2 * cos(el) * sin(az), 6) AS y, round(2 * sin(el), 6) AS z, CAST(ux AS DOUBLE) AS ux, CAST(uy AS DOUBLE) AS uy, CAST(uz AS DOUBLE) AS uz FROM a, u""")
def view_poses(spark, sf_dir):
    return scene.view_poses(spark, 6, 8, 2.0).select("elevation", "azimuth", "up", *xyz(), "ux", "uy", "uz")


@query("""WITH e AS (SELECT vec_id AS i, embedding AS u FROM embeddings WHERE vec_id % 2 = 0), f AS (SELECT vec_id AS j, embedding AS v FROM embeddings WHERE vec_id % 2 = 1), s AS (SELECT i, j, list_sum(list_transform(range(1, 65), lambda k: CAST(u[k] AS DOUBLE) * CAST(v[k] AS DOUBLE))) AS score FROM e, f),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, j) AS ri, row_number() OVER (PARTITION BY j ORDER BY score DESC, i) AS rj FROM s) SELECT i, j, round(score, 6) AS score FROM r WHERE ri = 1 AND rj = 1 AND score > 0.2""")
def mutual_nn(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings")
    a, b = e.where("vec_id % 2 = 0").select(c("vec_id").alias("i"), c("embedding").cast("array<double>").alias("u")), e.where("vec_id % 2 = 1").select(c("vec_id").alias("j"), c("embedding").cast("array<double>").alias("v"))
    return vision.mutual_nearest_vectors(a, b, 0.2).select("i", "j", r6("score").alias("score"))


# aggregates


@query(f"""WITH {V.TRK} SELECT pid AS gid, round(coalesce(sum(abs(shift)) FILTER (WHERE visible AND frame < pid % 3 * 10), 0), 6) AS total, count_if(visible AND frame < pid % 3 * 10) AS n, round(coalesce(max(x) FILTER (WHERE visible AND frame < pid % 3 * 10), 0), 6) AS radius,
round(coalesce(avg(abs(shift)) FILTER (WHERE visible AND frame < pid % 3 * 10), 0), 6) AS mean FROM trk GROUP BY 1""")
def densification(spark, sf_dir):
    t = V.trk(spark, sf_dir).select(c("pid").alias("gid"), F.abs("shift").alias("gradient"), c("x").alias("radius"), (c("visible") & (c("frame") < c("pid") % 3 * 10)).alias("seen"))
    return vision.densification(t).select("gid", r6("total").alias("total"), "n", r6("radius").alias("radius"), r6("mean").alias("mean"))


@query("""WITH n AS (SELECT l_partkey AS part, l_suppkey % 12 AS view, count(*) AS n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, view) AS rn FROM n) SELECT part, view, n FROM r WHERE rn = 1""")
def best_view(spark, sf_dir):
    return vision.best_view(V.table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("part"), (c("l_suppkey") % 12).alias("view")), ["part"])


@query(f"""WITH {V.PRED}, {V.CAMS}, w AS (SELECT t.frame, cam, fx, fy, cx, cy, t.x - m3 AS ax, t.y - m7 AS ay, t.z - m11 + 3 AS az, p.x - m3 AS bx, p.y - m7 AS by_, p.z - m11 + 3 AS bz FROM trk t JOIN pred p USING (frame, pid), cams)
SELECT frame, cam, round(avg(sqrt(pow(fx * ax / az - fx * bx / bz, 2) + pow(fy * ay / az - fy * by_ / bz, 2))), 5) AS error FROM w WHERE az > 0.5 AND bz > 0.5 GROUP BY ALL""")
def reprojection_error(spark, sf_dir):
    t = V.trk(spark, sf_dir).select("frame", "pid", *AXES).join(V.pred(spark, sf_dir).select("frame", "pid", *[c(n).alias("p" + n) for n in AXES]), ["frame", "pid"]).crossJoin(F.broadcast(V.cams(spark)))  # three cameras
    a, b = ([c(p + n) - c(f"m{4 * i + 3}") + (3.0 if n == "z" else 0.0) for i, n in enumerate(AXES)] for p in ("", "p"))
    t = t.where((a[2] > 0.5) & (b[2] > 0.5))
    e = measures.pixel_error(*[(c("fx") * p[0] / p[2] + c("cx"), c("fy") * p[1] / p[2] + c("cy")) for p in (a, b)])
    return t.groupBy("frame", "cam").agg(F.round(F.avg(e), 5).alias("error"))


_HUBER = " + ".join(f"CASE WHEN abs(m.{n} - p.{n}) < 1 THEN 0.5 * (m.{n} - p.{n}) * (m.{n} - p.{n}) ELSE abs(m.{n} - p.{n}) - 0.5 END" for n in AXES)


@query(f"""WITH {V.PRED}, ch AS (SELECT t.frame AS frame, t.pid AS pid, min((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y) + (t.z - p.z) * (t.z - p.z)) AS d FROM trk t JOIN pred p ON p.frame = t.frame WHERE t.visible GROUP BY ALL), l1 AS (SELECT frame, avg(d) AS loss FROM ch GROUP BY 1),
m AS (SELECT *, lag(visible AND nxt) OVER (PARTITION BY pid ORDER BY frame) AS ok FROM (SELECT *, coalesce(lead(visible) OVER (PARTITION BY pid ORDER BY frame), false) AS nxt FROM trk)),
l2 AS (SELECT m.frame AS frame, sum({_HUBER}) / (3 * count(*)) AS loss FROM m JOIN pred p USING (frame, pid) WHERE ok GROUP BY 1),
vel AS (SELECT frame, pid, x - lag(x) OVER w AS vx, y - lag(y) OVER w AS vy, z - lag(z) OVER w AS vz FROM pred WINDOW w AS (PARTITION BY pid ORDER BY frame)),
acc AS (SELECT frame, vx - lag(vx) OVER w AS x, vy - lag(vy) OVER w AS y, vz - lag(vz) OVER w AS z FROM vel WINDOW w AS (PARTITION BY pid ORDER BY frame)),
l3 AS (SELECT m.frame AS frame, 0.01::DOUBLE * sum({_HUBER}) / (3 * count(*)) AS loss FROM acc m, (SELECT 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 0.0::DOUBLE AS z) p WHERE m.x IS NOT NULL GROUP BY 1),
s AS (SELECT frame, sum(loss) AS loss FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) GROUP BY 1)
SELECT frame, round(loss * 1e3, 6) AS loss FROM s UNION ALL SELECT -1, round(avg(loss) * 1e3, 6) FROM s WHERE frame > 0""")
def epoch_loss(spark, sf_dir):
    """Each frame's total loss (chamfer, tracks whose motion from the frame before is valid, acceleration of the predicted points), and as frame -1 the epoch's."""
    w = Window.partitionBy("pid").orderBy("frame")
    t, p = V.trk(spark, sf_dir), V.pred(spark, sf_dir)
    chamfer = measures.chamfer(t.where("visible").select("frame", "pid", *AXES), p.select("frame", "pid", *AXES), "l2", by=["frame"]).groupBy(c("a_frame").alias("frame")).agg(F.avg("dist").alias("loss"))
    mean = lambda names: F.sum(G.total(*[measures.smooth_l1(x) for x in names])) / (3 * F.count("*"))
    moved = filters.forward_motion(t).withColumn("ok", F.lag("motion_valid").over(w)).where("ok").select("frame", "pid", *AXES)
    track = moved.join(p.select("frame", "pid", *[c(n).alias("p" + n) for n in AXES]), ["frame", "pid"]).groupBy("frame").agg(mean([c(n) - c("p" + n) for n in AXES]).alias("loss"))
    velocity = p.select("frame", "pid", *[(c(n) - F.lag(n).over(w)).alias(n) for n in AXES])
    acceleration = velocity.select("frame", *[(c(n) - F.lag(n).over(w)).alias(n) for n in AXES]).where("x is not null").groupBy("frame").agg((0.01 * mean([c(n) for n in AXES])).alias("loss"))
    losses = scratch.store(vision.total_loss(chamfer, track, acceleration), "losses")  # a row for each frame, read twice
    return losses.select("frame", r6(c("loss") * 1e3).alias("loss")).unionByName(vision.epoch_loss(losses).select(F.lit(-1).alias("frame"), r6(c("loss") * 1e3).alias("loss")))


@query("""WITH e AS (SELECT event_id, value * 0.7071067811865476::DOUBLE AS err FROM events), r AS (SELECT err, row_number() OVER (ORDER BY err, event_id) AS n, count(*) OVER () AS total, coalesce(lag(err) OVER (ORDER BY err, event_id), 0) AS e0 FROM e),
t AS (SELECT unnest([5.0::DOUBLE, 10.0::DOUBLE, 20.0::DOUBLE]) AS threshold), i AS (SELECT threshold, sum((err - e0) * (2 * n - 1) / (2.0::DOUBLE * total)) AS s, max(err) AS e, count(*) AS k, any_value(total) AS total FROM t JOIN r ON err < threshold GROUP BY 1)
SELECT threshold, round((s + (threshold - e) * k / total) / threshold, 6) AS auc FROM i""")
def recall_auc(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select((c("value") * 0.7071067811865476).alias("err"))
    return measures.recall_auc(e, [5.0, 10.0, 20.0]).select("threshold", r6("auc").alias("auc"))


@query("SELECT round(avg(n), 6) AS mean FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def mean_observations(spark, sf_dir):
    tracks = V.table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("track"))
    return V.table(spark, sf_dir, "orders").select("o_orderkey").join(tracks, "o_orderkey", "left").agg(r6(F.avg(F.coalesce(F.size("track"), F.lit(0)))).alias("mean"))


# projections


@query(f"WITH {V.PTS}, o AS (SELECT min(x) AS lo, max(x) AS hi FROM pts) SELECT pid, round((x - lo) / nullif(hi - lo, 0), 6) AS shade FROM pts, o")
def unit_scaled(spark, sf_dir):
    return vision.unit_scaled(V.pts(spark, sf_dir), "x", "shade").select("pid", r6("shade").alias("shade"))


_FOV = 1.1


@query(f"""WITH {V.PTS}, w AS (SELECT pid, 0.8::DOUBLE * x - 0.6::DOUBLE * z + 0.1::DOUBLE AS x, y - 0.2::DOUBLE AS y, 0.6::DOUBLE * x + 0.8::DOUBLE * z + 3.0::DOUBLE AS z FROM pts)
SELECT pid, round(x / tan({_FOV}::DOUBLE / 2) / z, 6) AS cx, round(y / tan(0.8::DOUBLE / 2) / z, 6) AS cy, round((100.0::DOUBLE / (100.0::DOUBLE - 0.01::DOUBLE) * z - 100.0::DOUBLE * 0.01::DOUBLE / (100.0::DOUBLE - 0.01::DOUBLE)) / z, 6) AS cz FROM w""")
def clip_space(spark, sf_dir):
    to_world = np.array([[0.8, 0.0, -0.6], [0.0, 1.0, 0.0], [0.6, 0.0, 0.8]]).T
    m = C.perspective(0.01, 100.0, _FOV, 0.8) @ C.world_to_view(to_world, [0.1, -0.2, 3.0])
    h = C.apply(m, [c(n) for n in AXES])
    return V.pts(spark, sf_dir).select("pid", *[r6(h[i] / h[3]).alias("c" + n) for i, n in enumerate(AXES)])


_LEN = "sqrt(x * x + y * y + z * z)"


@query(f"""WITH {V.PTS}, d AS (SELECT pid, x / {_LEN} AS x, y / {_LEN} AS y, z / {_LEN} AS z FROM pts), k AS (SELECT pid, x, y, z, -y / sqrt(x * x + y * y) AS kx, x / sqrt(x * x + y * y) AS ky, sqrt(x * x + y * y) AS s FROM d)
SELECT pid, round(z + kx * kx * (1 - z), 6) AS r0, round(kx * ky * (1 - z), 6) AS r1, round(ky * s, 6) AS r2, round(kx * ky * (1 - z), 6) AS r3, round(z + ky * ky * (1 - z), 6) AS r4, round(-kx * s, 6) AS r5, round(-ky * s, 6) AS r6, round(kx * s, 6) AS r7, round(z, 6) AS r8 FROM k""")
def align_axis(spark, sf_dir):
    r = C.align_axis([c(n) for n in AXES])
    return V.pts(spark, sf_dir).select("pid", *[r6(x).alias(f"r{i}") for i, x in enumerate(r)])


@query(f"""WITH {SPLATS}, {_ROT}, t AS (SELECT gid, s0, s1, s2, (0.8::DOUBLE * r0 + 0.6::DOUBLE * r2 + r4 - 0.6::DOUBLE * r6 + 0.8::DOUBLE * r8 - 1) / 2 AS cosine, (s0 * 0.3::DOUBLE + s1 * 0.5::DOUBLE + s2 * 0.2::DOUBLE) / (sqrt(s0 * s0 + s1 * s1 + s2 * s2) * sqrt(0.38::DOUBLE)) AS along FROM r)
SELECT gid, round(degrees(acos(greatest(-1, least(1, cosine)))), 4) AS turn, round(least(degrees(acos(greatest(-1, least(1, along)))), 180 - degrees(acos(greatest(-1, least(1, along))))), 4) AS shift FROM t""")
def pose_errors(spark, sf_dir):
    r = _rotated(spark, sf_dir)
    base = [F.lit(x) for x in (0.8, 0.0, 0.6, 0.0, 1.0, 0.0, -0.6, 0.0, 0.8)]
    turn = C.rotation_error([c(f"r{i}") for i in range(9)], base)
    shift = C.direction_error([c(f"s{i}") for i in range(3)], [F.lit(x) for x in (0.3, 0.5, 0.2)])
    return r.select("gid", F.round(turn, 4).alias("turn"), F.round(shift, 4).alias("shift"))


_ESS = ((0.0, -0.3, 0.5), (0.3, 0.0, -0.2), (-0.5, 0.25, 0.1))


def _row(i: int, a: str, b: str) -> str:
    return f"({_d(_ESS[i][0])} * {a} + {_d(_ESS[i][1])} * {b} + {_d(_ESS[i][2])})"


def _col(j: int, a: str, b: str) -> str:
    return f"({_d(_ESS[0][j])} * {a} + {_d(_ESS[1][j])} * {b} + {_d(_ESS[2][j])})"


@query(f"""WITH {V.PRED}, k AS (SELECT t.frame AS frame, t.pid AS pid, t.x AS a, t.y AS b, p.x AS c, p.y AS d FROM trk t JOIN pred p USING (frame, pid)), e AS (SELECT frame, pid, c * {_row(0, 'a', 'b')} + d * {_row(1, 'a', 'b')} + {_row(2, 'a', 'b')} AS s, pow({_row(0, 'a', 'b')}, 2) + pow({_row(1, 'a', 'b')}, 2) AS n0, pow({_col(0, 'c', 'd')}, 2) + pow({_col(1, 'c', 'd')}, 2) AS n1 FROM k)
SELECT frame, pid, round(s * s * (1 / n0 + 1 / n1), 6) AS error FROM e""")
def epipolar_error(spark, sf_dir):
    t = V.trk(spark, sf_dir).select("frame", "pid", "x", "y").join(V.pred(spark, sf_dir).select("frame", "pid", c("x").alias("px"), c("y").alias("py")), ["frame", "pid"])
    return t.select("frame", "pid", r6(C.epipolar_error([c("x"), c("y")], [c("px"), c("py")], np.array(_ESS))).alias("error"))


@query(f"WITH {V.PIX}, {V.CAMS}, k AS (SELECT cam, fy / 2 AS fx, fx / 2 AS fy, cy / 2 AS cx, 424 - 1 - cx / 2 AS cy FROM cams) SELECT cam, count(*) AS n, round(avg((v / 2 - cx) / fx), 6) AS x, round(avg((424 - 1 - u / 2 - cy) / fy), 6) AS y FROM pix JOIN k USING (cam) GROUP BY 1")
def turned_intrinsics(spark, sf_dir):
    """Rays of an image of half the size that was turned by a quarter."""
    k = V.cams(spark)
    s = C.scale_intrinsics(c("fx"), c("fy"), c("cx"), c("cy"), 2.0, 2.0)
    k = k.select("cam", *[x.alias(n) for n, x in zip(("fx", "fy", "cx", "cy"), C.rotate_intrinsics(*s, 424, 240, 1), strict=True)])
    p = V.pix(spark, sf_dir).join(F.broadcast(k), "cam")
    return p.groupBy("cam").agg(F.count("*").alias("n"), r6(F.avg((c("v") / 2 - c("cx")) / c("fx"))).alias("x"), r6(F.avg((423 - c("u") / 2 - c("cy")) / c("fy"))).alias("y"))


@query(f"""WITH {SPLATS}, {_ROT}, a AS (SELECT r.gid AS gid, r.s0 AS px, r.s1 AS py, r.s2 AS pz, list_position([r.s0, r.s1, r.s2], list_min([r.s0, r.s1, r.s2])) AS k, r.* EXCLUDE (gid, s0, s1, s2) FROM r),
ax AS (SELECT gid, px, py, pz, [r0, r1, r2][k] AS x, [r3, r4, r5][k] AS y, [r6, r7, r8][k] AS z FROM a), f AS (SELECT *, CASE WHEN x * (0.1::DOUBLE - px) + y * (0.2::DOUBLE - py) + z * (0.4::DOUBLE - pz) < 0 THEN -1 ELSE 1 END AS s FROM ax)
SELECT gid, round(s * x, 6) AS x, round(s * y, 6) AS y, round(s * z, 6) AS z FROM f""")
def splat_normals(spark, sf_dir):
    r = _rotated(spark, sf_dir)
    s = [c(f"s{i}") for i in range(3)]
    n = C.normal(s, [c(f"r{i}") for i in range(9)], s, (0.1, 0.2, 0.4))
    return r.select("gid", *[r6(x).alias(a) for a, x in zip(AXES, n, strict=True)])


@query(f"""WITH {SPLATS} SELECT gid, round(0.8::DOUBLE * u - 0.6::DOUBLE * v, 4) AS x, round(0.6::DOUBLE * u + 0.8::DOUBLE * v, 4) AS y, round(depth, 6) AS z, round(0.8::DOUBLE * q0 - 0.6::DOUBLE * q3, 6) AS q0, round(0.8::DOUBLE * q1 - 0.6::DOUBLE * q2, 6) AS q1, round(0.8::DOUBLE * q2 + 0.6::DOUBLE * q1, 6) AS q2,
round(0.8::DOUBLE * q3 + 0.6::DOUBLE * q0, 6) AS q3, round(s0 + 0.25::DOUBLE, 6) AS s0 FROM splats""")
def moved_splats(spark, sf_dir):
    s = splats(spark, sf_dir).withColumnsRenamed({"u": "x", "v": "y", "depth": "z"})
    m = vision.moved_splats(s, (0.8, -0.6, 0, 0.6, 0.8, 0, 0, 0, 1), (0.8, 0, 0, 0.6), 0.25)
    return m.select("gid", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), r6("z").alias("z"), *[r6(f"q{i}").alias(f"q{i}") for i in range(4)], r6("s0").alias("s0"))


@query(f"""WITH {V.PIX} SELECT frame, count(*) AS n, round(avg(-(u - 424.0::DOUBLE) * d / 400.0::DOUBLE), 6) AS x, round(avg(-(v - 240.0::DOUBLE) * d / 400.0::DOUBLE), 6) AS y FROM (SELECT *, (depth_mm - 500) * 0.7071067811865476::DOUBLE AS d FROM pix) WHERE d > 0 GROUP BY 1""")
def pixel_lookup(spark, sf_dir):
    p = V.pix(spark, sf_dir).withColumn("d", (c("depth_mm") - 500) * 0.7071067811865476)
    x, y, z = G.pixel_lookup(c("u"), c("v"), c("d"), 400.0, 424.0, 240.0)
    return p.where(z > 0).groupBy("frame").agg(F.count("*").alias("n"), r6(F.avg(x)).alias("x"), r6(F.avg(y)).alias("y"))


@query("""WITH p AS (SELECT u, v, (u + 0.5::DOUBLE - 20.3::DOUBLE) / 33.0::DOUBLE AS x, (v + 0.5::DOUBLE - 14.7::DOUBLE) / 31.0::DOUBLE AS y FROM range(0, 40) a(u), range(0, 30) b(v)) SELECT u, v, round(x / sqrt(x * x + y * y + 1), 6) AS x, round(y / sqrt(x * x + y * y + 1), 6) AS y, round(1 / sqrt(x * x + y * y + 1), 6) AS z FROM p""")
def pixel_rays(spark, sf_dir):
    p = spark.range(40 * 30).select((c("id") % 40).alias("u"), F.floor(c("id") / 40).alias("v"))
    return p.select("u", "v", *[r6(x).alias(n) for n, x in zip(AXES, G.ray(c("u"), c("v"), 33.0, 31.0, 20.3, 14.7), strict=True)])


@query("SELECT event_id, round((value - 2.0::DOUBLE) / (9.5::DOUBLE - 2.0::DOUBLE), 6) AS unit, round((value - 2.0::DOUBLE) / (9.5::DOUBLE - 2.0::DOUBLE) * 30.0::DOUBLE + 10.0::DOUBLE, 5) AS back FROM (SELECT event_id, value * 0.7071067811865476::DOUBLE AS value FROM events)")
def unit_range(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_id", G.unit_range(c("value") * 0.7071067811865476, 2.0, 9.5).alias("unit"))
    return e.select("event_id", r6("unit").alias("unit"), F.round(G.from_unit_range(c("unit"), 10.0, 40.0), 5).alias("back"))


@query("WITH n AS (SELECT vec_id, embedding AS e, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n FROM embeddings) SELECT vec_id, round(CAST(e[1] AS DOUBLE) / n, 6) AS first, round(list_sum(list_transform(e, lambda x: abs(CAST(x AS DOUBLE)) / n)), 6) AS l1 FROM n")
def normalised(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", G.normalise(c("embedding").cast("array<double>")).alias("e"))
    return e.select("vec_id", r6(c("e")[0]).alias("first"), r6(F.aggregate("e", F.lit(0.0), lambda a, x: a + F.abs(x))).alias("l1"))


@query(f"""WITH {SPLATS}, {_ROT}, {V.CAMS}, p AS (SELECT r.gid AS gid, (r.u0 - 0.5) AS x, r.v0 AS y, r.z0 AS z, r.* EXCLUDE (gid, u0, v0, z0) FROM (SELECT r.*, q.u / 640 AS u0, q.v / 480 AS v0, q.depth AS z0 FROM r JOIN splats q USING (gid)) r),
k AS (SELECT gid, z, greatest(-0.65::DOUBLE, least(0.65::DOUBLE, x / z)) * z AS x, greatest(-0.52::DOUBLE, least(0.52::DOUBLE, y / z)) * z AS y, r0 * r0 * s0 * s0 + r1 * r1 * s1 * s1 + r2 * r2 * s2 * s2 AS xx, r0 * r3 * s0 * s0 + r1 * r4 * s1 * s1 + r2 * r5 * s2 * s2 AS xy, r0 * r6 * s0 * s0 + r1 * r7 * s1 * s1 + r2 * r8 * s2 * s2 AS xz,
r3 * r3 * s0 * s0 + r4 * r4 * s1 * s1 + r5 * r5 * s2 * s2 AS yy, r3 * r6 * s0 * s0 + r4 * r7 * s1 * s1 + r5 * r8 * s2 * s2 AS yz, r6 * r6 * s0 * s0 + r7 * r7 * s1 * s1 + r8 * r8 * s2 * s2 AS zz FROM p),
j AS (SELECT *, 500 / z AS a, -500 * x / (z * z) AS b, 480 / z AS c, -480 * y / (z * z) AS d FROM k), s AS (SELECT gid, a * a * xx + 2 * a * b * xz + b * b * zz + 0.3::DOUBLE AS ca, a * c * xy + a * d * xz + b * c * yz + b * d * zz AS cb, c * c * yy + 2 * c * d * yz + d * d * zz + 0.3::DOUBLE AS cc FROM j)
SELECT gid, round(ca, 4) AS a, round(cb, 4) AS b, round(cc, 4) AS c FROM s""")
def screen_covariance(spark, sf_dir):
    r = _rotated(spark, sf_dir).join(splats(spark, sf_dir).select("gid", (c("u") / 640 - 0.5).alias("px"), (c("v") / 480).alias("py"), c("depth").alias("pz")), "gid")
    cov = G.covariance([c(f"s{i}") for i in range(3)], [c(f"r{i}") for i in range(9)])
    s = G.screen_covariance((c("px"), c("py"), c("pz")), cov, 500.0, 480.0, 0.5, 0.4)
    return r.select("gid", *[F.round(x, 4).alias(n) for n, x in zip("abc", s, strict=True)])


@query(f"""WITH {V.PTS}, s AS (SELECT pid, 0.3::DOUBLE + 5.0::DOUBLE / (5.0::DOUBLE - z) * (x - 0.3::DOUBLE) AS sx, -0.2::DOUBLE + 5.0::DOUBLE / (5.0::DOUBLE - z) * (y + 0.2::DOUBLE) AS sy FROM pts), p AS (SELECT DISTINCT CAST(floor(40 * sx) AS BIGINT) AS u, CAST(floor(40 * sy) AS BIGINT) AS v FROM s),
d AS (SELECT DISTINCT u + i AS u, v + j AS v FROM p, range(-1, 2) a(i), range(-1, 2) b(j)), e AS (SELECT u, v FROM (SELECT u + i AS u, v + j AS v FROM d, range(-1, 2) a(i), range(-1, 2) b(j)) GROUP BY ALL HAVING count(*) = 9) SELECT u, v FROM e""")
def shadow(spark, sf_dir):
    """Pixels of the points' shadow, dilated and then eroded."""
    sx, sy = G.shadow((c("x"), c("y"), c("z")), (0.3, -0.2, 5.0))
    p = V.pts(spark, sf_dir).select(F.lit(0).alias("frame"), F.floor(40 * sx).alias("u"), F.floor(40 * sy).alias("v"))
    return measures.morphology(measures.morphology(p, 3, True), 3, False).select("u", "v")


@query(f"WITH {V.IMG} SELECT frame, round(avg(a * b + (1 - a) * (u / 64.0::DOUBLE)), 6) AS mean FROM img GROUP BY 1")
def over(spark, sf_dir):
    return V.img(spark, sf_dir).groupBy("frame").agg(r6(F.avg(G.over(c("a"), c("b"), c("u") / 64.0))).alias("mean"))


def _rate_sql() -> str:
    t = "greatest(0.0, least(1.0, s / 1000.0::DOUBLE))"
    return f"SELECT s AS step, CASE WHEN s < 0 THEN 0.0 ELSE round((0.1::DOUBLE + 0.9::DOUBLE * sin(0.5::DOUBLE * pi() * greatest(0.0, least(1.0, s / 100.0::DOUBLE)))) * exp((1 - {t}) * ln(0.01::DOUBLE) + {t} * ln(0.0001::DOUBLE)), 9) END AS rate FROM range(-5, 1200) r(s)"


@query(_rate_sql())
def learning_rate(spark, sf_dir):
    return spark.range(-5, 1200).select(c("id").alias("step"), F.round(G.rate(c("id"), 0.01, 0.0001, 100, 0.1, 1000), 9).alias("rate"))


_Q = "sign(q0) * {} / sqrt(q0 * q0 + q1 * q1 + q2 * q2 + q3 * q3)"
_QSQL = f"WITH {SPLATS} SELECT gid, " + ", ".join(f"round({_Q.format(f'q{i}')}, 5) AS q{i}" for i in range(4)) + " FROM splats"


@query(_QSQL)
def matrix_quaternion(spark, sf_dir):
    q = G.matrix_quaternion([c(f"r{i}") for i in range(9)])
    rows = _rotated(spark, sf_dir).select("gid", *[x.alias(f"q{i}") for i, x in enumerate(q)])
    return rows.select("gid", *[F.round(F.when(c("q0") < 0, -c(f"q{i}")).otherwise(c(f"q{i}")), 5).alias(f"q{i}") for i in range(4)])


@query(_QSQL)
def dominant_quaternion(spark, sf_dir):
    rows = _rotated(spark, sf_dir).select("gid", scene.dominant_quaternion(F.array(*[f"r{i}" for i in range(9)])).alias("q"))
    return rows.select("gid", *[F.round(c("q")[i], 5).alias(f"q{i}") for i in range(4)])


# similarity and transport, as SQL too


def _gauss() -> list[float]:
    g = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    return (g / g.sum()).tolist()


def _ssim_sql() -> str:
    w = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({i - 5}, {_d(x)})" for i, x in enumerate(_gauss())) + ") t(o, w))"
    names = ("a", "b", "aa", "bb", "ab")
    row = ", ".join(f"sum(w * {n}) AS {n}" for n in names)
    return f"""WITH {V.IMG}, {w}, grid AS (SELECT f AS frame, p AS u, q AS v, coalesce(a, 0.0) AS a, coalesce(b, 0.0) AS b FROM (SELECT DISTINCT frame AS f FROM img), range(0, 64) x(p), range(0, 64) y(q) LEFT JOIN img ON frame = f AND u = p AND v = q),
g AS (SELECT frame, u, v, a, b, a * a AS aa, b * b AS bb, a * b AS ab FROM grid), h AS (SELECT frame, u + o AS u, v, {row} FROM g, w WHERE u + o BETWEEN 0 AND 63 GROUP BY ALL), k AS (SELECT frame, u, v + o AS v, {row} FROM h, w WHERE v + o BETWEEN 0 AND 63 GROUP BY ALL)
SELECT frame, round(avg((2 * a * b + 0.0001::DOUBLE) * (2 * (ab - a * b) + 0.0009::DOUBLE) / ((a * a + b * b + 0.0001::DOUBLE) * (aa - a * a + bb - b * b + 0.0009::DOUBLE))), 6) AS ssim FROM k GROUP BY 1"""


@query(_ssim_sql())
def ssim(spark, sf_dir):
    return measures.ssim(V.img(spark, sf_dir), 64, 64).select("frame", r6("ssim").alias("ssim"))


def _sinkhorn_sql(iterations: int = 20) -> str:
    base = """e AS (SELECT vec_id, embedding AS v, vec_id // 100 AS image FROM embeddings), a AS (SELECT image, vec_id AS i, v FROM e WHERE vec_id % 2 = 0), b AS (SELECT image, vec_id AS j, v FROM e WHERE vec_id % 2 = 1),
k AS (SELECT image, m, n, -ln(m + n) AS norm FROM (SELECT image, count(*) AS m FROM a GROUP BY 1) JOIN (SELECT image, count(*) AS n FROM b GROUP BY 1) USING (image)),
ai AS (SELECT image, i, norm AS mu FROM a JOIN k USING (image) UNION ALL SELECT image, -1, ln(n) + norm FROM k), bj AS (SELECT image, j, norm AS nu FROM b JOIN k USING (image) UNION ALL SELECT image, -1, ln(m) + norm FROM k),
z AS MATERIALIZED (SELECT image, ai.i, bj.j, CASE WHEN ai.i < 0 OR bj.j < 0 THEN 1.0::DOUBLE ELSE list_sum(list_transform(range(1, 65), lambda x: CAST(a.v[x] AS DOUBLE) * CAST(b.v[x] AS DOUBLE))) END AS z, mu, nu FROM ai JOIN bj USING (image) LEFT JOIN a ON a.image = ai.image AND a.i = ai.i LEFT JOIN b ON b.image = bj.image AND b.j = bj.j),
v0 AS (SELECT image, j, 0.0::DOUBLE AS v FROM bj)"""
    rounds = "".join(
        f""", u{t} AS MATERIALIZED (SELECT image, i, any_value(mu) - ln(sum(exp(z + v))) AS u FROM z JOIN v{t - 1} USING (image, j) GROUP BY 1, 2), v{t} AS MATERIALIZED (SELECT image, j, any_value(nu) - ln(sum(exp(z + u))) AS v FROM z JOIN u{t} USING (image, i) GROUP BY 1, 2)"""
        for t in range(1, iterations + 1)
    )
    return f"WITH {base}{rounds} SELECT CAST(image AS BIGINT) AS image, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(exp(z + u + v - norm), 5) AS p FROM z JOIN u{iterations} USING (image, i) JOIN v{iterations} USING (image, j) JOIN k USING (image)"


@query(_sinkhorn_sql())
def sinkhorn(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.floor(c("vec_id") / 100).alias("image"))
    a, b = e.where("vec_id % 2 = 0").select(c("vec_id").alias("i"), c("embedding").alias("u"), "image"), e.where("vec_id % 2 = 1").select(c("vec_id").alias("j"), c("embedding").alias("v"), "image")
    score = F.aggregate(F.zip_with("u", "v", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return simulate.sinkhorn(a.join(b, "image").select("image", "i", "j", score.alias("score")), "image").select("image", "i", "j", F.round("p", 5).alias("p"))


# gaps, stages, matrices and controls


_KNOWN = "frame IN (0, 4, 9, 17)"
_FILLED = ("x", "y", "z", "red", "opacity", "qa", "qb")
_ENDS = ", ".join(f"last_value(CASE WHEN {_KNOWN} THEN {n} END IGNORE NULLS) OVER p AS a_{n}, first_value(CASE WHEN {_KNOWN} THEN {n} END IGNORE NULLS) OVER q AS b_{n}" for n in ("frame", *_FILLED))


@query(f"""WITH {V.TRK}, s AS (SELECT frame, pid, x, y, z, shift AS red, x * y AS opacity, x + 2 AS qa, z AS qb FROM trk), e AS (SELECT *, {_ENDS} FROM s
  WINDOW p AS (PARTITION BY pid ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY pid ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT frame, pid, {', '.join(f"CASE WHEN NOT {_KNOWN} AND b_frame IS NOT NULL THEN a_{n} + (frame - a_frame) / (b_frame - a_frame)::DOUBLE * (b_{n} - a_{n}) ELSE {n} END AS {n}" for n in _FILLED)} FROM e)
SELECT frame, pid, round(x, 6) AS x, round(z, 6) AS z, round(red, 6) AS red, round(opacity, 6) AS opacity, round(qa / sqrt(qa * qa + qb * qb), 6) AS qa, round(qb / sqrt(qa * qa + qb * qb), 6) AS qb FROM f""")
def lerp_splats(spark, sf_dir):
    """Positions, colours, opacities and rotations between change points."""
    t = V.trk(spark, sf_dir).select("frame", "pid", *AXES, c("shift").alias("red"), (c("x") * c("y")).alias("opacity"), (c("x") + 2).alias("qa"), c("z").alias("qb"))
    filled = series.renormalised(series.lerp_fill(t, ["pid"], "frame", _FILLED, c("frame").isin(0, 4, 9, 17)), ["qa", "qb"])
    return filled.select("frame", "pid", *[r6(n).alias(n) for n in ("x", "z", "red", "opacity", "qa", "qb")])


@query("""WITH s AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean FROM events)
SELECT event_type, nth, round(mean, 6) AS mean, round(mean / sum(mean) OVER (PARTITION BY nth), 6) AS share FROM s WHERE nth % 10 = 0""")
def stage_report(spark, sf_dir):
    return series.stage_report(V.table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value").select("event_type", "nth", r6("mean").alias("mean"), r6("share").alias("share"))


@query(f"""WITH {V.PRED}, k AS (SELECT t.frame AS frame, t.x AS x, t.y AS y, t.z AS z, p.x AS a, p.y AS b, p.z AS c FROM trk t JOIN pred p USING (frame, pid))
SELECT frame, round(avg(abs(x - a) + abs(y - b) + abs(z - c)) / 3 + 0.1::DOUBLE * (1 - avg((x * a + y * b + z * c) / (sqrt(x * x + y * y + z * z) * sqrt(a * a + b * b + c * c)))), 6) AS loss FROM k GROUP BY 1""")
def normal_loss(spark, sf_dir):
    t = V.trk(spark, sf_dir).select("frame", "pid", *AXES).join(V.pred(spark, sf_dir).select("frame", "pid", *[c(n).alias("p" + n) for n in AXES]), ["frame", "pid"])
    return t.groupBy("frame").agg(r6(vision.normal_loss([c("p" + n) for n in AXES], [c(n) for n in AXES])).alias("loss"))


_M = [f"CAST(embedding[{i}] AS DOUBLE)" for i in range(1, 10)]
_ADJ = ((4, 8, 5, 7), (2, 7, 1, 8), (1, 5, 2, 4), (5, 6, 3, 8), (0, 8, 2, 6), (2, 3, 0, 5), (3, 7, 4, 6), (1, 6, 0, 7), (0, 4, 1, 3))


@query(f"""WITH m AS (SELECT vec_id, {', '.join(f'{x} AS m{i}' for i, x in enumerate(_M))} FROM embeddings), d AS (SELECT *, m0 * (m4 * m8 - m5 * m7) - m1 * (m3 * m8 - m5 * m6) + m2 * (m3 * m7 - m4 * m6) AS det FROM m)
SELECT vec_id, {', '.join(f'round((m{a} * m{b} - m{e} * m{f}) / det * 1e-3, 4) AS i{k}' for k, (a, b, e, f) in enumerate(_ADJ))}, CAST(3 AS INTEGER) AS rank FROM d""")
def matrix_inverse(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", *[c("embedding")[i].cast("double").alias(f"m{i}") for i in range(9)])
    m = [c(f"m{i}") for i in range(9)]
    return e.select("vec_id", *[F.round(x * 1e-3, 4).alias(f"i{k}") for k, x in enumerate(C.inverse(m))], C.rank(m).alias("rank"))


@query(f"""WITH {V.TRK}, k AS (SELECT frame, pid, x, y, z, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(z) OVER w AS nz FROM trk WINDOW w AS (PARTITION BY pid ORDER BY frame))
SELECT frame, CAST(s AS INTEGER) AS step, pid, round(x + (s + 1) / 5.0::DOUBLE * (nx - x), 6) AS x, round(y + (s + 1) / 5.0::DOUBLE * (ny - y), 6) AS y, round(z + (s + 1) / 5.0::DOUBLE * (nz - z), 6) AS z FROM k, range(0, 5) r(s) WHERE nx IS NOT NULL""")
def control_substeps(spark, sf_dir):
    return vision.control_substeps(V.trk(spark, sf_dir), 5).select("frame", "step", "pid", *xyz())


@query(f"""WITH {V.SMP}, b AS (SELECT *, CAST(floor(t / 864000.0::DOUBLE) AS BIGINT) AS batch, CAST(floor(t / 3600.0::DOUBLE + 1e-5) AS BIGINT) AS g FROM smp), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY cam, batch, g ORDER BY t, event_id) = 1),
p AS (SELECT *, coalesce(lag(g) OVER (PARTITION BY cam, batch ORDER BY g), g - 1) AS before FROM f), s AS (SELECT cam, batch, event_id, unnest(range(before + 1, g + 1)) AS step FROM p)
SELECT cam, step, event_id FROM s QUALIFY row_number() OVER (PARTITION BY cam, step ORDER BY batch DESC) = 1""")
def action_steps(spark, sf_dir):
    """Actions that come in batches of ten days; a later batch wins a step."""
    s = V.smp(spark, sf_dir).withColumn("batch", F.floor(c("t") / 864000.0))
    steps = sensors.action_steps(s, ["cam", "batch"], "t", ["event_id"], 3600.0)
    return series.upsert(steps, ["cam", "step"], ["batch"]).select("cam", "step", "event_id")


@query("WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN NULL ELSE CAST(embedding[1] AS DOUBLE) END AS x FROM embeddings) SELECT vec_id, round(x, 6) AS x, x IS NOT NULL AS ok FROM e")
def nan_to_null(spark, sf_dir):
    e = V.table(spark, sf_dir, "embeddings").select("vec_id", F.when(c("vec_id") % 7 == 0, F.lit(float("nan"))).otherwise(c("embedding")[0].cast("double")).alias("x"))
    x = F.when(~F.isnan("x"), c("x"))
    return e.select("vec_id", r6(x).alias("x"), x.isNotNull().alias("ok"))


@query()
def split_splats(spark, sf_dir):
    s = splats(spark, sf_dir).select("gid", (c("u") / 320 - 1).alias("x"), (c("v") / 240 - 1).alias("y"), c("depth").alias("z"), *[f"s{i}" for i in range(3)], *[f"q{i}" for i in range(4)], c("opacity").alias("gradient"))
    return vision.split_splats(s, 0.3, 0.05)
