"""Registered queries: each operator bound to the driver's tables, with DuckDB SQL for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import filters, joins, lines, measures, series
from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
c = F.col
AXES = ("x", "y", "z")


def wrapped(sql: str, name: str, around: str) -> str:
    """``sql`` with every call of the function ``name`` put into ``around``."""
    out, at = [], 0
    for m in re.finditer(rf"\b{name}\(", sql):
        if m.start() < at:
            continue
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[i], 0)
            i += 1
        out += [sql[at : m.start()], around.format(sql[m.start() : i])]
        at = i
    return "".join([*out, sql[at:]])


def query(sql: str | None = None):
    """Register a query. In its SQL no rounded number is a negative zero, and counts are BIGINT, as in Spark."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = wrapped(wrapped(sql, "round", "({} + 0.0)"), "count_if", "CAST({} AS BIGINT)")
        return f

    return add


def r6(x: Column | str) -> Column:
    return F.round(x, 6)


def xyz(*names: str) -> list[Column]:
    return [r6(n).alias(n) for n in names or AXES]


# errors and metrics


@query(f"""WITH {V.PTS}, d AS (SELECT a.pid, a.part, min(abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z)) AS d FROM pts a, pts b WHERE a.part < 5 AND b.part >= 5 GROUP BY ALL)
SELECT part, round(avg(d), 6) AS chamfer, count(*) AS n FROM d GROUP BY part""")
def chamfer_l1(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    d = measures.chamfer(p.where("part < 5"), p.where("part >= 5"), "l1")
    return d.groupBy(c("a_part").alias("part")).agg(r6(F.avg("dist")).alias("chamfer"), F.count("*").alias("n"))


@query(f"""WITH {V.PTS}, d AS (SELECT a.pid, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d FROM pts a, pts b WHERE a.part < 5 AND b.part >= 5 GROUP BY ALL)
SELECT round(sum(d) / count(*), 6) AS loss, count(*) AS n FROM d""")
def chamfer_l2_loss(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    d = measures.chamfer(p.where("part < 5"), p.where("part >= 5"), "l2")
    return d.agg(r6(F.sum("dist") / F.count("*")).alias("loss"), F.count("*").alias("n"))


@query(f"""WITH {V.PRED}, e AS (SELECT t.frame, avg(sqrt((t.x - p.x) * (t.x - p.x) + (t.y - p.y) * (t.y - p.y) + (t.z - p.z) * (t.z - p.z))) AS e FROM trk t JOIN pred p USING (frame, pid) WHERE t.visible AND t.frame <> 5 GROUP BY 1)
SELECT CAST(f AS INTEGER) AS frame, round(coalesce(e, 0.0), 6) AS error FROM range(0, {V.FRAMES}) s(f) LEFT JOIN e ON e.frame = f""")
def track_error(spark, sf_dir):
    truth = V.trk(spark, sf_dir).where("visible and frame <> 5").select("frame", "pid", *AXES)
    spine = spark.range(V.FRAMES).select(c("id").cast("int").alias("frame"))
    return measures.track_error(truth, V.pred(spark, sf_dir).select("frame", "pid", *AXES), spine).select("frame", r6("error").alias("error"))


@query(f"""WITH {V.IMG} SELECT frame, round(avg((a - b) * (a - b)), 6) AS mse, round(-10 * log10(avg((a - b) * (a - b))), 6) AS psnr FROM img GROUP BY frame""")
def psnr(spark, sf_dir):
    mse = F.avg((c("a") - c("b")) * (c("a") - c("b")))
    return V.img(spark, sf_dir).groupBy("frame").agg(mse.alias("m")).select("frame", r6("m").alias("mse"), r6(measures.psnr(c("m"))).alias("psnr"))


@query(f"""WITH {V.IMG} SELECT frame, round(CASE WHEN count_if(a > 0.2 OR b > 0.35) = 0 THEN 1.0 ELSE count_if(a > 0.2 AND b > 0.35) / count_if(a > 0.2 OR b > 0.35)::DOUBLE END, 6) AS iou FROM img GROUP BY frame""")
def iou(spark, sf_dir):
    return V.img(spark, sf_dir).groupBy("frame").agg(r6(measures.iou(c("a") > 0.2, c("b") > 0.35)).alias("iou"))


@query(f"""WITH {V.IMG} SELECT frame, round(avg(abs(a - b)), 6) AS l1, round(avg((a - b) * (a - b)), 6) AS l2, round(sum(CASE WHEN a > 0.1 THEN abs(a - b) ELSE 0 END) / greatest(count_if(a > 0.1), 1), 6) AS masked_l1, round(avg(greatest(a / (b + 0.1), 1.3::DOUBLE) - 1.3::DOUBLE), 6) AS anisotropy FROM img GROUP BY frame""")
def image_losses(spark, sf_dir):
    d = c("a") - c("b")
    return V.img(spark, sf_dir).groupBy("frame").agg(
        r6(F.avg(F.abs(d))).alias("l1"), r6(F.avg(d * d)).alias("l2"), r6(F.sum(F.when(c("a") > 0.1, F.abs(d)).otherwise(0.0)) / F.greatest(F.count_if(c("a") > 0.1), F.lit(1))).alias("masked_l1"),
        r6(F.avg(F.greatest(c("a") / (c("b") + 0.1), F.lit(1.3)) - 1.3)).alias("anisotropy"),
    )


@query("""SELECT coalesce(event_type, 'OVERALL') AS scene, CASE WHEN user_id % 10 < 7 THEN 'train' ELSE 'test' END AS split, round(avg(value), 6) AS mean, count(*) AS n, CAST(grouping(event_type) AS INTEGER) AS overall
FROM events GROUP BY GROUPING SETS ((event_type, CASE WHEN user_id % 10 < 7 THEN 'train' ELSE 'test' END), (CASE WHEN user_id % 10 < 7 THEN 'train' ELSE 'test' END))""")
def grouping_sets(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("event_type", F.when(c("user_id") % 10 < 7, "train").otherwise("test").alias("split"), "value")
    g = e.groupingSets([[c("event_type"), c("split")], [c("split")]], c("event_type"), c("split")).agg(r6(F.avg("value")).alias("mean"), F.count("*").alias("n"), F.grouping("event_type").cast("int").alias("overall"))
    return g.select(F.coalesce("event_type", F.lit("OVERALL")).alias("scene"), "split", "mean", "n", "overall")


@query("""SELECT event_type, round(avg(m), 6) AS macro, count(*) AS n_groups FROM (SELECT event_type, user_id, avg(value) AS m FROM events GROUP BY ALL) GROUP BY 1""")
def two_level_mean(spark, sf_dir):
    m = measures.two_level_mean(V.table(spark, sf_dir, "events"), ["user_id"], ["event_type"], "value", "macro")
    return m.select("event_type", r6("macro").alias("macro"), "n_groups")


# neighbour joins

_D2 = "((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"


@query(f"WITH {V.PTS}, n AS (SELECT a.pid, count(*) AS n FROM pts a, pts b WHERE {_D2} <= 0.1::DOUBLE * 0.1::DOUBLE GROUP BY 1) SELECT pid, n FROM n WHERE n > 8")
def radius_outlier(spark, sf_dir):
    return filters.radius_outliers(V.pts(spark, sf_dir), 0.1, 8).select("pid", "n")


@query(f"WITH {V.PTS} SELECT a.pid AS a, count(*) AS n, round(sum(sqrt({_D2})), 6) AS total FROM pts a, pts b WHERE a.part = b.part AND {_D2} < 0.2::DOUBLE * 0.2::DOUBLE GROUP BY 1")
def radius_join_by_part(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return joins.radius_join(p, p, 0.2, strict=True, by=["part"]).groupBy(c("a_pid").alias("a")).agg(F.count("*").alias("n"), r6(F.sum(F.sqrt("dist"))).alias("total"))


def _edges_sql(r: float, k: int, by: str = "") -> str:
    return f"""h AS (SELECT a.pid AS i, b.pid AS j, a.part AS part, sqrt({_D2}) AS rest, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS rn FROM pts a, pts b WHERE {_D2} <= {r}::DOUBLE * {r}::DOUBLE {by}),
e AS (SELECT least(i, j) AS lo, greatest(i, j) AS hi, max(CASE WHEN i < j THEN 1 ELSE 0 END) AS up, min(rest) AS rest FROM h WHERE rn <= {k} AND i <> j AND rest > 1e-4 GROUP BY 1, 2),
s AS (SELECT CASE WHEN up = 1 THEN lo ELSE hi END AS src, CASE WHEN up = 1 THEN hi ELSE lo END AS dst, rest FROM e)"""


@query(f"WITH {V.PTS}, {_edges_sql(0.1, 6)} SELECT src, dst, round(rest, 6) AS rest FROM s")
def hybrid_springs(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return joins.undirected_edges(joins.hybrid_join(p, p, 0.1, 6)).select("src", "dst", r6("rest").alias("rest"))


@query(f"WITH {V.PTS}, {_edges_sql(0.15, 8)} SELECT pid, count(*) AS degree FROM (SELECT src AS pid FROM s UNION ALL SELECT dst FROM s) GROUP BY 1")
def spring_dedup(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    e = joins.undirected_edges(joins.hybrid_join(p, p, 0.15, 8))
    return e.select(F.explode(F.array("src", "dst")).alias("pid")).groupBy("pid").agg(F.count("*").alias("degree"))


@query(f"""WITH {V.PTS}, h AS (SELECT a.pid AS controller, b.pid AS object, sqrt({_D2}) AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {_D2}, b.pid) AS rn FROM pts a, pts b WHERE a.part >= 8 AND b.part < 8 AND {_D2} <= 0.12::DOUBLE * 0.12::DOUBLE)
SELECT controller, object, round(d, 6) AS rest, CAST(rn AS INTEGER) AS rank FROM h WHERE rn <= 5""")
def controller_springs(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    h = joins.hybrid_join(p.where("part >= 8"), p.where("part < 8"), 0.12, 5)
    return h.select(c("a_pid").alias("controller"), c("b_pid").alias("object"), r6(F.sqrt("dist")).alias("rest"), c("rank").cast("int").alias("rank"))


@query(f"""WITH {V.PTS}, {_edges_sql(0.2, 6, 'AND a.part = b.part')}, n AS (SELECT part, count(*) AS n FROM pts GROUP BY 1), o AS (SELECT part, n, CAST(sum(n) OVER (ORDER BY part) - n AS BIGINT) AS first_id FROM n),
k AS (SELECT part, count(*) AS springs FROM s JOIN pts ON pid = src GROUP BY 1) SELECT part, n, first_id, coalesce(springs, 0) AS springs FROM o LEFT JOIN k USING (part)""")
def springs_by_mask(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    e = joins.undirected_edges(joins.hybrid_join(p, p, 0.2, 6, by=["part"]), by=["part"])
    k = e.groupBy("part").agg(F.count("*").alias("springs"))
    n = filters.prefix_sum(p.groupBy("part").agg(F.count("*").alias("n")), ["part"], "n", "upto")
    return n.join(k, "part", "left").select("part", "n", (c("upto") - c("n")).alias("first_id"), F.coalesce("springs", F.lit(0)).alias("springs"))


def _knn_sql(k: int, where: str, metric: str = _D2) -> str:
    return f"k AS (SELECT a.pid AS a, b.pid AS b, {metric} AS d, row_number() OVER (PARTITION BY a.pid ORDER BY {metric}, b.pid) AS rn FROM pts a, pts b WHERE {where} QUALIFY rn <= {k})"


@query(f"WITH {V.PTS}, {_knn_sql(4, 'a.pid <> b.pid')} SELECT a, b, CAST(rn AS INTEGER) AS rank, round(d, 6) AS d2 FROM k")
def knn_self(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return joins.knn_join(p, p, 4, exclude_self=True).select(c("a_pid").alias("a"), c("b_pid").alias("b"), c("rank").cast("int").alias("rank"), r6("dist").alias("d2"))


@query(f"WITH {V.PTS}, {_knn_sql(16, 'a.part < 7 AND b.part >= 7')} SELECT a, b, CAST(rn AS INTEGER) AS rank, round(d, 6) AS d2 FROM k")
def knn_cross(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return joins.knn_join(p.where("part < 7"), p.where("part >= 7"), 16).select(c("a_pid").alias("a"), c("b_pid").alias("b"), c("rank").cast("int").alias("rank"), r6("dist").alias("d2"))


@query(f"WITH {V.PTS}, {_knn_sql(3, 'a.pid <> b.pid')} SELECT a AS pid, round(avg(d), 6) AS mean_d2 FROM k GROUP BY 1")
def knn3_mean(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return joins.knn_join(p, p, 3, exclude_self=True).groupBy(c("a_pid").alias("pid")).agg(r6(F.avg("dist")).alias("mean_d2"))


@query(f"WITH {V.PTS}, {_knn_sql(1, 'a.part < 5 AND b.part >= 5')} SELECT a, b, round(sqrt(d), 6) AS d FROM k")
def nearest_l2(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return joins.nearest_join(p.where("part < 5"), p.where("part >= 5")).select(c("a_pid").alias("a"), c("b_pid").alias("b"), r6(F.sqrt("dist")).alias("d"))


@query(f"WITH {V.PTS}, {_knn_sql(1, 'a.part % 2 = 1 AND b.part % 2 = 0', 'abs(a.x - b.x) + abs(a.y - b.y) + abs(a.z - b.z)')} SELECT a, b, round(d, 6) AS d FROM k")
def nearest_l1(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return joins.nearest_join(p.where("part % 2 = 1"), p.where("part % 2 = 0"), metric="l1").select(c("a_pid").alias("a"), c("b_pid").alias("b"), r6("dist").alias("d"))


@query(f"WITH {V.PTS}, {_knn_sql(4, 'a.pid <> b.pid')}, w AS (SELECT a, b, 1.0::DOUBLE / (sqrt(d) + 1e-6::DOUBLE) AS w FROM k) SELECT a, b, round(w / sum(w) OVER (PARTITION BY a), 6) AS weight FROM w")
def idw_weights(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return measures.idw_weights(joins.knn_join(p, p, 4, exclude_self=True)).select(c("a_pid").alias("a"), c("b_pid").alias("b"), r6("weight").alias("weight"))


@query(f"""WITH {V.PTS}, h AS (SELECT a.pid AS a, b.pid AS b, sqrt(pow(b.y * a.z - b.z * a.y, 2) + pow(b.z * a.x - b.x * a.z, 2) + pow(b.x * a.y - b.y * a.x, 2)) / sqrt(a.x * a.x + a.y * a.y + a.z * a.z) AS d FROM pts a, pts b WHERE a.part < 3 AND b.part >= 3 AND {_D2} <= 0.2::DOUBLE * 0.2::DOUBLE)
SELECT a, min_by(b, (d, b)) AS b, round(min(d), 6) AS d FROM h GROUP BY 1""")
def ray_closest(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    return lines.nearest_to_lines(p.where("part < 3"), p.where("part >= 3"), 0.2).select("a", "b", r6("d").alias("d"))


@query(f"""WITH {V.PTS}, u AS (SELECT pid % 50 AS slot, 0 AS priority, pid, z FROM pts WHERE part < 2 UNION ALL SELECT pid % 50, 1, pid, z FROM pts WHERE part BETWEEN 2 AND 4 UNION ALL SELECT pid % 50, 2, pid, z FROM pts WHERE part > 4)
SELECT slot, priority, pid, round(least(z, 0.0), 6) AS z FROM (SELECT *, row_number() OVER (PARTITION BY slot ORDER BY priority, pid) AS rn FROM u) WHERE rn = 1""")
def precedence_union(spark, sf_dir):
    p = V.pts(spark, sf_dir).withColumn("slot", c("pid") % 50)
    u = p.where("part < 2").withColumn("priority", F.lit(0)).unionByName(p.where("part between 2 and 4").withColumn("priority", F.lit(1))).unionByName(p.where("part > 4").withColumn("priority", F.lit(2)))
    w = Window.partitionBy("slot").orderBy("priority", "pid")
    return u.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("slot", "priority", "pid", r6(F.least("z", F.lit(0.0))).alias("z"))


@query(f"WITH {V.PTS} SELECT a.pid AS a, count(*) AS n, min(b.pid) AS first FROM pts a, pts b WHERE a.part <> b.part AND {_D2} < 0.08::DOUBLE * 0.08::DOUBLE GROUP BY 1")
def collision_candidates(spark, sf_dir):
    p = V.pts(spark, sf_dir)
    near = joins.radius_join(p, p, 0.08, strict=True).where("a_part <> b_part")
    return near.groupBy(c("a_pid").alias("a")).agg(F.count("*").alias("n"), F.min("b_pid").alias("first"))


# pixels and projections


@query(f"""WITH {V.PIX}, {V.CAMS} SELECT frame, cam, role, count(*) AS n, round(sum((u - cx) * (depth_mm / 1000.0::DOUBLE) / fx), 4) AS sx, round(sum((v - cy) * (depth_mm / 1000.0::DOUBLE) / fy), 4) AS sy, round(sum(depth_mm / 1000.0::DOUBLE), 4) AS sz
FROM pix JOIN cams USING (cam) WHERE depth_mm / 1000.0::DOUBLE > 0.2 AND depth_mm / 1000.0::DOUBLE < 1.5 GROUP BY ALL""")
def deproject(spark, sf_dir):
    p = V.pix(spark, sf_dir).withColumn("d", c("depth_mm") / 1000.0).where("d > 0.2 and d < 1.5").join(F.broadcast(V.cams(spark)), "cam")
    x, y, z = G.deproject(c("u"), c("v"), c("d"), c("fx"), c("fy"), c("cx"), c("cy"))
    return p.groupBy("frame", "cam", "role").agg(F.count("*").alias("n"), F.round(F.sum(x), 4).alias("sx"), F.round(F.sum(y), 4).alias("sy"), F.round(F.sum(z), 4).alias("sz"))


_CAM = f"""{V.PIX}, {V.CAMS}, q AS (SELECT *, (u - cx) * (depth_mm / 1000.0::DOUBLE) / fx AS px, (v - cy) * (depth_mm / 1000.0::DOUBLE) / fy AS py, depth_mm / 1000.0::DOUBLE AS pz FROM pix JOIN cams USING (cam) WHERE depth_mm > 200 AND depth_mm < 1500),
world AS (SELECT frame, cam, u, v, role, m0 * px + m1 * py + m2 * pz + m3 AS x, m4 * px + m5 * py + m6 * pz + m7 AS y, m8 * px + m9 * py + m10 * pz + m11 AS z FROM q)"""


def _world(spark, sf_dir) -> DataFrame:
    p = V.pix(spark, sf_dir).where("depth_mm > 200 and depth_mm < 1500").withColumn("d", c("depth_mm") / 1000.0).join(F.broadcast(V.cams(spark)), "cam")
    local = G.deproject(c("u"), c("v"), c("d"), c("fx"), c("fy"), c("cx"), c("cy"))
    p = p.withColumns({"p" + n: x for n, x in zip(AXES, local, strict=True)})
    out = G.transform(tuple(c("p" + n) for n in AXES), [c(f"m{i}") for i in range(12)])
    return p.select("frame", "cam", "u", "v", "role", *[x.alias(n) for n, x in zip(AXES, out, strict=True)])


@query(f"WITH {_CAM} SELECT frame, cam, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, round(min(z), 6) AS lowest FROM world GROUP BY ALL")
def deproject_world(spark, sf_dir):
    return _world(spark, sf_dir).groupBy("frame", "cam").agg(F.count("*").alias("n"), *[r6(F.avg(n)).alias(n) for n in AXES], r6(F.min("z")).alias("lowest"))


_PROJ = """proj AS (SELECT pid, cam, fx * (m0 * (x - m3) + m4 * (y - m7) + m8 * (z - m11)) / l + cx AS pu, fy * (m1 * (x - m3) + m5 * (y - m7) + m9 * (z - m11)) / l + cy AS pv, l FROM (SELECT *, m2 * (x - m3) + m6 * (y - m7) + m10 * (z - m11) AS l FROM pts, cams) WHERE l <> 0)"""


def _projected(spark, sf_dir) -> DataFrame:
    p = V.pts(spark, sf_dir).crossJoin(F.broadcast(V.cams(spark)))  # three fixed cameras
    local = G.inverse_rigid(tuple(c(n) for n in AXES), [c(f"m{i}") for i in range(12)])
    p = p.select("pid", "cam", "fx", "fy", "cx", "cy", *[x.alias("l" + n) for n, x in zip(AXES, local, strict=True)]).where("lz <> 0")
    u, v = G.project((c("lx"), c("ly"), c("lz")), c("fx"), c("fy"), c("cx"), c("cy"))
    return p.select("pid", "cam", u.alias("u"), v.alias("v"), "lz")


@query(f"WITH {V.PTS}, {V.CAMS}, {_PROJ} SELECT pid, cam, CAST(round_even(pu, 0) AS BIGINT) AS u, CAST(round_even(pv, 0) AS BIGINT) AS v, l > 0 AND round_even(pu, 0) BETWEEN 0 AND 847 AND round_even(pv, 0) BETWEEN 0 AND 479 AS inside FROM proj")
def project_pixels(spark, sf_dir):
    return _projected(spark, sf_dir).select("pid", "cam", "u", "v", ((c("lz") > 0) & c("u").between(0, 847) & c("v").between(0, 479)).alias("inside"))


@query(f"""WITH {V.PTS}, {V.CAMS}, {_PROJ}, px AS (SELECT pid, cam, CAST(round_even(pu, 0) AS BIGINT) AS u FROM proj) SELECT pid, count_if(u % 4 <> 0) AS hits, count(*) AS views, count_if(u % 4 <> 0) = count(*) AS kept FROM px GROUP BY 1""")
def all_views_mask(spark, sf_dir):
    p = _projected(spark, sf_dir)
    mask = p.where("u % 4 <> 0").select("cam", "u", "v")
    return filters.all_views_mask(V.pts(spark, sf_dir), V.cams(spark), mask).select("pid", "hits", "views", (c("hits") == c("views")).alias("kept"))


@query(f"WITH {V.PIX} SELECT frame, cam, count(DISTINCT (u, v)) AS n FROM pix p WHERE depth_mm > 200 AND depth_mm < 1500 AND EXISTS (SELECT 1 FROM pix m WHERE m.frame = 0 AND m.role = 'controller' AND m.cam = p.cam AND m.u = p.u AND m.v = p.v) GROUP BY ALL")
def mask_semi(spark, sf_dir):
    p = V.pix(spark, sf_dir)
    mask = p.where("frame = 0 and role = 'controller'").select("cam", "u", "v")
    return p.where("depth_mm > 200 and depth_mm < 1500").join(mask, ["cam", "u", "v"], "left_semi").groupBy("frame", "cam").agg(F.count_distinct("u", "v").alias("n"))


@query(f"""WITH {V.PIX}, cloud AS (SELECT frame, cam, u, v, min(depth_mm) AS depth_mm FROM pix GROUP BY ALL), t AS (SELECT l_orderkey % 8 AS frame, l_suppkey % 3 AS cam, l_partkey % 848 + l_discount * 3.3 AS col, (l_partkey * 7 + l_linenumber * 13) % 480 + l_tax * 3.3 AS row FROM lineitem)
SELECT t.frame, t.cam, count(*) AS n, CAST(sum(depth_mm) AS BIGINT) AS depth FROM t JOIN cloud k ON k.frame = t.frame AND k.cam = t.cam AND k.u = CAST(round_even(col, 0) AS BIGINT) AND k.v = CAST(round_even(row, 0) AS BIGINT) GROUP BY ALL""")
def track_lookup(spark, sf_dir):
    cloud = V.pix(spark, sf_dir).groupBy("frame", "cam", "u", "v").agg(F.min("depth_mm").alias("depth_mm"))
    li = V.table(spark, sf_dir, "lineitem")
    t = li.select((c("l_orderkey") % 8).alias("frame"), (c("l_suppkey") % 3).alias("cam"), (c("l_partkey") % 848 + c("l_discount") * 3.3).alias("col"), ((c("l_partkey") * 7 + c("l_linenumber") * 13) % 480 + c("l_tax") * 3.3).alias("row"))
    return joins.pixel_join(t, cloud).groupBy("frame", "cam").agg(F.count("*").alias("n"), F.sum("depth_mm").alias("depth"))


def _morph(grow: bool) -> str:
    having = "" if grow else "HAVING count(*) = 9"
    return f"WITH {V.BLOB}, b AS (SELECT DISTINCT frame, u, v FROM blob), o AS (SELECT frame, u - i AS u, v - j AS v FROM b, range(-1, 2) a(i), range(-1, 2) k(j)), g AS (SELECT frame, u, v FROM o GROUP BY ALL {having}) SELECT frame, count(*) AS n, CAST(sum(u * 1000 + v) AS BIGINT) AS checksum FROM g GROUP BY 1"


@query(_morph(True))
def dilate3(spark, sf_dir):
    return measures.morphology(V.blob(spark, sf_dir), 3, True).groupBy("frame").agg(F.count("*").alias("n"), F.sum(c("u") * 1000 + c("v")).alias("checksum"))


@query(_morph(False))
def erode3(spark, sf_dir):
    return measures.morphology(V.blob(spark, sf_dir), 3, False).groupBy("frame").agg(F.count("*").alias("n"), F.sum(c("u") * 1000 + c("v")).alias("checksum"))


@query(f"""WITH {V.PIX}, b AS (SELECT frame, cam, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM pix WHERE role = 'object' GROUP BY ALL), s AS (SELECT *, greatest(u1 - u0, v1 - v0) * 1.2::DOUBLE AS side FROM b)
SELECT frame, cam, CAST(greatest(0.0, floor((u0 + u1) / 2.0 - side / 2)) AS BIGINT) AS left_u, CAST(least(847.0, floor((u0 + u1) / 2.0 + side / 2)) AS BIGINT) AS right_u, CAST(greatest(0.0, floor((v0 + v1) / 2.0 - side / 2)) AS BIGINT) AS top_v, CAST(least(479.0, floor((v0 + v1) / 2.0 + side / 2)) AS BIGINT) AS bottom_v FROM s""")
def bbox_square(spark, sf_dir):
    b = V.pix(spark, sf_dir).where("role = 'object'").groupBy("frame", "cam").agg(*[f(n).alias(n + i) for n in "uv" for i, f in (("0", F.min), ("1", F.max))])
    side = F.greatest(c("u1") - c("u0"), c("v1") - c("v0")) * 1.2
    edge = lambda n, sign: F.floor((c(n + "0") + c(n + "1")) / 2.0 + sign * side / 2)
    return b.select("frame", "cam", F.greatest(F.lit(0), edge("u", -1)).alias("left_u"), F.least(F.lit(847), edge("u", 1)).alias("right_u"), F.greatest(F.lit(0), edge("v", -1)).alias("top_v"), F.least(F.lit(479), edge("v", 1)).alias("bottom_v"))


@query(f"""WITH {V.PIX}, s AS (SELECT frame, u % 60 AS u, v % 60 AS v, max(depth_mm) AS score FROM pix GROUP BY ALL), p AS (SELECT a.frame, a.u, a.v, a.score, max(b.score) AS top FROM s a JOIN s b ON a.frame = b.frame AND b.u BETWEEN a.u - 2 AND a.u + 2 AND b.v BETWEEN a.v - 2 AND a.v + 2 GROUP BY ALL)
SELECT frame, u, v, score FROM p WHERE score = top""")
def nms(spark, sf_dir):
    s = V.pix(spark, sf_dir).groupBy("frame", (c("u") % 60).alias("u"), (c("v") % 60).alias("v")).agg(F.max("depth_mm").alias("score"))
    near = s.select("frame", F.explode(F.expr("sequence(u - 2, u + 2)")).alias("u"), "v", "score").select("frame", "u", F.explode(F.expr("sequence(v - 2, v + 2)")).alias("v"), "score")
    top = near.groupBy("frame", "u", "v").agg(F.max("score").alias("top"))
    return s.join(top, ["frame", "u", "v"]).where("score = top").select("frame", "u", "v", "score")


# sets, distinct, windows


@query(f"WITH {V.PTS}, g AS (SELECT pid, part, round(x, 1) AS x, round(y, 1) AS y, round(z, 1) AS z FROM pts), f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY x, y, z ORDER BY pid) = 1) SELECT pid, x, y, z, row_number() OVER (ORDER BY x, y, z) - 1 AS new_pid FROM f")
def distinct_first(spark, sf_dir):
    g = V.pts(spark, sf_dir).select("pid", *[(F.round(n, 1) + 0.0).alias(n) for n in AXES])
    return filters.distinct_first(g).select("pid", *AXES, c("new_pid").cast("long").alias("new_pid"))


@query(f"""WITH {V.PTS}, o AS (SELECT min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM pts), g AS (SELECT pid, part, CAST(floor((x - x0) / 0.1::DOUBLE) AS BIGINT) AS vx, CAST(floor((y - y0) / 0.1::DOUBLE) AS BIGINT) AS vy, CAST(floor((z - z0) / 0.1::DOUBLE) AS BIGINT) AS vz FROM pts, o)
SELECT pid, part, vx, vy, vz FROM g QUALIFY row_number() OVER (PARTITION BY vx, vy, vz ORDER BY part, pid) = 1""")
def voxel_first(spark, sf_dir):
    return filters.voxel_first(V.pts(spark, sf_dir), 0.1, "part", ["pid"]).select("pid", "part", "vx", "vy", "vz")


@query(f"WITH {V.TRK} SELECT pid, bool_and(visible OR pid % 3 = 0) AS always, round(min(least(z, 0.0)), 6) AS lowest FROM trk GROUP BY 1")
def visible_every_frame(spark, sf_dir):
    t = V.trk(spark, sf_dir).withColumn("visible", c("visible") | (c("pid") % 3 == 0))
    return filters.visible_every_frame(t).join(t.groupBy("pid").agg(r6(F.min(F.least("z", F.lit(0.0)))).alias("lowest")), "pid")


@query(f"WITH {V.TRK} SELECT frame, count(*) AS n, count_if(z > 0) AS above, round(sum(least(z, 0.0)), 4) AS total FROM trk GROUP BY 1")
def ground_clamp(spark, sf_dir):
    return V.trk(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"), F.count_if(c("z") > 0).alias("above"), F.round(F.sum(F.least("z", F.lit(0.0))), 4).alias("total"))


@query(f"WITH {V.TRK}, m AS (SELECT *, visible AND coalesce(lead(visible) OVER (PARTITION BY pid ORDER BY frame), false) AS ok FROM trk) SELECT frame, count_if(visible) AS n_visible, count_if(ok) AS n_motion FROM m GROUP BY 1")
def motion_valid(spark, sf_dir):
    return filters.forward_motion(V.trk(spark, sf_dir)).groupBy("frame").agg(F.count_if("visible").alias("n_visible"), F.count_if("motion_valid").alias("n_motion"))


_MOVE = f"""{V.TRK}, m AS (SELECT frame, pid, x, y, z, coalesce(lead(x) OVER w - x, 0.0) AS dx, coalesce(lead(y) OVER w - y, 0.0) AS dy, coalesce(lead(z) OVER w - z, 0.0) AS dz, visible AND coalesce(lead(visible) OVER w, false) AS ok FROM trk WINDOW w AS (PARTITION BY pid ORDER BY frame))"""


@query(f"WITH {_MOVE} SELECT frame, pid, round(dx, 6) AS dx, round(dy, 6) AS dy, round(dz, 6) AS dz, ok AS motion_valid FROM m")
def forward_diff(spark, sf_dir):
    return filters.forward_motion(V.trk(spark, sf_dir)).select("frame", "pid", *xyz("dx", "dy", "dz"), "motion_valid")


@query(f"""WITH {_MOVE}, v AS (SELECT a.frame, a.pid, count(*) AS n, count_if(sqrt((a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy) + (a.dz - b.dz) * (a.dz - b.dz)) < 0.05) AS near FROM m a JOIN m b ON a.frame = b.frame AND a.ok AND b.ok AND {_D2} <= 0.1::DOUBLE * 0.1::DOUBLE GROUP BY ALL)
SELECT frame, pid, n, near, n >= 5 AND 2 * near >= n AS consistent FROM v""")
def motion_filter_snapshot(spark, sf_dir):
    return filters.motion_filter_snapshot(V.trk(spark, sf_dir), 0.1)


@query(f"""WITH {V.TRK}, t AS (SELECT frame, pid, last_value(CASE WHEN frame % 3 = 0 THEN x END IGNORE NULLS) OVER w AS x, last_value(CASE WHEN frame % 3 = 0 THEN y END IGNORE NULLS) OVER w AS y, last_value(CASE WHEN frame % 3 = 0 THEN z END IGNORE NULLS) OVER w AS z FROM trk WINDOW w AS (PARTITION BY pid ORDER BY frame)),
d AS (SELECT frame, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)) AS s FROM t WINDOW w AS (PARTITION BY pid ORDER BY frame)) SELECT frame, round(coalesce(sum(s), 0.0), 4) AS moved, frame = 0 OR coalesce(sum(s), 0) <> 0 AS change FROM d GROUP BY frame""")
def change_points(spark, sf_dir):
    w = Window.partitionBy("pid").orderBy("frame")
    held = V.trk(spark, sf_dir).select("frame", "pid", *[F.last(F.when(c("frame") % 3 == 0, c(n)), True).over(w).alias(n) for n in AXES])
    return series.change_points(held).select("frame", F.round("moved", 4).alias("moved"), "change")


@query(f"""WITH {V.TRK}, k AS (SELECT frame, pid, x, frame IN (0, 3, 7, 15) AS k, last_value(CASE WHEN frame IN (0, 3, 7, 15) THEN frame END IGNORE NULLS) OVER p AS t0, last_value(CASE WHEN frame IN (0, 3, 7, 15) THEN x END IGNORE NULLS) OVER p AS x0,
first_value(CASE WHEN frame IN (0, 3, 7, 15) THEN frame END IGNORE NULLS) OVER n AS t1, first_value(CASE WHEN frame IN (0, 3, 7, 15) THEN x END IGNORE NULLS) OVER n AS x1 FROM trk WINDOW p AS (PARTITION BY pid ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY pid ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT frame, pid, round(CASE WHEN NOT k AND t1 IS NOT NULL THEN x0 + (frame - t0) / (t1 - t0)::DOUBLE * (x1 - x0) ELSE x END, 6) AS x FROM k""")
def lerp_fill(spark, sf_dir):
    t = V.trk(spark, sf_dir).select("frame", "pid", "x")
    return series.lerp_fill(t, ["pid"], "frame", ["x"], c("frame").isin(0, 3, 7, 15)).select("frame", "pid", r6("x").alias("x"))


@query(f"""WITH {V.TRK}, s AS (SELECT pid, list(x ORDER BY frame) AS xs FROM trk GROUP BY 1) SELECT pid, len(xs) AS n, round(list_reduce(list_prepend(0.0::DOUBLE, xs), lambda a, x: 0.4::DOUBLE * x + 0.6::DOUBLE * a), 6) AS ema, round(list_reduce(xs, lambda a, x: 0.3::DOUBLE * x + 0.7::DOUBLE * a), 6) AS timer FROM s""")
def ema(spark, sf_dir):
    t = V.trk(spark, sf_dir).select("pid", "frame", "x")
    a, b = series.moving_average(t, ["pid"], ["frame"], "x", 0.4), series.moving_average(t, ["pid"], ["frame"], "x", 0.3, None)
    return a.join(b.select("pid", c("ema").alias("timer")), "pid").select("pid", "n", r6("ema").alias("ema"), r6("timer").alias("timer"))


@query("""WITH s AS (SELECT user_id, event_id, value, row_number() OVER w AS nth, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS mean FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, nth, round(mean, 6) AS mean FROM s WHERE nth % 10 = 0""")
def sliding10(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    return series.sliding_mean(e, ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "nth", r6("mean").alias("mean"))


@query("SELECT o_orderkey, CAST(sum(o_custkey % 7) OVER (ORDER BY o_orderkey) AS BIGINT) AS upto FROM orders")
def prefix_sum(spark, sf_dir):
    o = V.table(spark, sf_dir, "orders").select("o_orderkey", (c("o_custkey") % 7).alias("n"))
    return filters.prefix_sum(o, ["o_orderkey"], "n", "upto").select("o_orderkey", "upto")


@query("WITH s AS (SELECT l_suppkey AS tile, row_number() OVER (ORDER BY l_suppkey, l_orderkey, l_linenumber) - 1 AS nth FROM lineitem) SELECT tile, min(nth) AS first, max(nth) + 1 AS last FROM s GROUP BY 1")
def run_bounds(spark, sf_dir):
    n = V.table(spark, sf_dir, "lineitem").groupBy(c("l_suppkey").alias("tile")).agg(F.count("*").alias("n"))
    return filters.prefix_sum(n, ["tile"], "n", "last").select("tile", (c("last") - c("n")).alias("first"), "last")


@query("WITH s AS (SELECT c_name, row_number() OVER (ORDER BY c_name) - 1 AS nth FROM customer) SELECT c_name, nth, nth % 8 = 0 AS test FROM s")
def holdout8(spark, sf_dir):
    return series.hold_out(V.table(spark, sf_dir, "customer").select("c_name"), ["c_name"]).select("c_name", c("nth").cast("long").alias("nth"), "test")


@query("SELECT user_id AS case, count(DISTINCT event_id) AS frame_len, CAST(0 AS BIGINT) AS train_lo, CAST(floor(count(DISTINCT event_id) * 0.7::DOUBLE) AS BIGINT) AS train_hi, CAST(floor(count(DISTINCT event_id) * 0.7::DOUBLE) AS BIGINT) AS test_lo, count(DISTINCT event_id) AS test_hi FROM events GROUP BY 1")
def split70(spark, sf_dir):
    return series.split(V.table(spark, sf_dir, "events").select(c("user_id").alias("case"), c("event_id").alias("frame")))


# samples over time


@query(f"""WITH {V.SMP}, g AS (SELECT *, CAST(floor((t - 0.0) / 3600.0::DOUBLE + 1e-5::DOUBLE) AS BIGINT) AS g FROM smp), p AS (SELECT *, greatest(coalesce(max(g) OVER (PARTITION BY cam ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1), -1) AS p FROM g)
SELECT cam, unnest(range(p + 1, g + 1)) AS step, event_id, value FROM p WHERE g > p""")
def resample(spark, sf_dir):
    return series.resample(V.smp(spark, sf_dir), ["cam"], "t", ["event_id"], 3600.0).select("cam", "step", "event_id", "value")


@query(f"WITH {V.SMP} SELECT cam, event_id, CAST(row_number() OVER (PARTITION BY cam ORDER BY t DESC, event_id DESC) AS INTEGER) AS nth FROM smp QUALIFY nth <= 4")
def last_k(spark, sf_dir):
    return series.last_k(V.smp(spark, sf_dir), ["cam"], "t", "event_id", 4).select("cam", "event_id", c("nth").cast("int").alias("nth"))


@query(f"""WITH {V.SMP}, l AS (SELECT *, row_number() OVER (PARTITION BY cam ORDER BY t DESC, event_id DESC) AS nth FROM smp QUALIFY nth <= 4), g AS (SELECT min(t) AS target FROM l WHERE nth = 1)
SELECT cam, event_id, round(t, 6) AS t, round(target, 6) AS target FROM l, g QUALIFY row_number() OVER (PARTITION BY cam ORDER BY abs(t - target), t, event_id) = 1""")
def sync(spark, sf_dir):
    return series.synchronise(V.smp(spark, sf_dir), "cam", "t", "event_id", 4, 1e9).select("cam", "event_id", r6("t").alias("t"), r6("target").alias("target"))


@query(f"""WITH {V.SMP}, q AS (SELECT cam, s * 7200.0::DOUBLE AS t FROM (SELECT DISTINCT cam FROM smp), (SELECT unnest(range(0, CAST(floor(max(t) / 7200.0::DOUBLE) AS BIGINT) + 2)) AS s FROM smp)) SELECT q.cam, round(q.t, 3) AS t, max_by(s.event_id, (s.t, s.event_id)) AS event_id FROM q LEFT JOIN smp s ON s.cam = q.cam AND s.t <= q.t GROUP BY ALL""")
def asof(spark, sf_dir):
    s = V.smp(spark, sf_dir)
    last = s.groupBy("cam", "t").agg(F.max("event_id").alias("event_id"))
    grid = s.agg((F.floor(F.max("t") / 7200.0) + 1).alias("last")).select(F.explode(F.sequence(F.lit(0).cast("long"), c("last"))).alias("i"))
    q = s.select("cam").distinct().crossJoin(F.broadcast(grid)).select("cam", (c("i") * 7200.0).alias("t"))  # the steps of the time span, for each camera
    return joins.asof_join(q, last, "t", ["cam"], ["event_id"]).select("cam", F.round("t", 3).alias("t"), "event_id")


@query("SELECT user_id, event_type, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS n FROM events GROUP BY ALL")
def upsert_latest(spark, sf_dir):
    e = V.table(spark, sf_dir, "events")
    last = series.upsert(e, ["user_id", "event_type"], ["ts", "event_id"])
    return last.select("user_id", "event_type", "event_id").join(e.groupBy("user_id", "event_type").agg(F.count("*").alias("n")), ["user_id", "event_type"])


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 1 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 3600000000 AS last_us, count(*) AS n FROM g GROUP BY user_id, k""")
def key_sessions(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").select("user_id", c("ts").cast("timestamp").alias("ts"))
    return series.sessions(e, ["user_id"], "ts", "1 hour").select("user_id", F.unix_micros("start").alias("first_us"), F.unix_micros("end").alias("last_us"), "n")


_KEYS = ("click", 0, 0.005), ("view", 0, -0.005), ("purchase", 1, 0.005), ("error", 1, -0.005)


@query(f"""WITH m(event_type, part, delta) AS (VALUES {', '.join(f"('{k}', {p}, {d}::DOUBLE)" for k, p, d in _KEYS)}), s AS (SELECT CAST(dayofmonth(ts) AS INTEGER) AS frame, CAST(part AS INTEGER) AS part, sum(delta) AS d FROM events JOIN m USING (event_type) GROUP BY ALL)
SELECT frame, part, round(d, 6) AS step, round(sum(d) OVER (PARTITION BY part ORDER BY frame), 6) AS target FROM s""")
def key_fold(spark, sf_dir):
    m = spark.createDataFrame(list(_KEYS), "event_type string, part int, delta double")
    s = V.table(spark, sf_dir, "events").join(F.broadcast(m), "event_type").groupBy(F.dayofmonth("ts").alias("frame"), "part").agg(F.sum("delta").alias("d"))
    return s.select("frame", "part", r6("d").alias("step"), r6(F.sum("d").over(Window.partitionBy("part").orderBy("frame"))).alias("target"))


@query("""SELECT event_type, h * 3600 AS start_s, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([epoch_us(ts) // 3600000000, epoch_us(ts) // 3600000000 - 1]) AS h FROM events) GROUP BY ALL""")
def hop_window(spark, sf_dir):
    e = V.table(spark, sf_dir, "events").withColumn("ts", c("ts").cast("timestamp"))
    w = e.groupBy("event_type", F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select("event_type", F.unix_seconds("w.start").alias("start_s"), "n", "total")


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_k(spark, sf_dir):
    k = F.from_json("props", "k long")["k"]
    return V.table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("k"), F.count("*").alias("n"))


@query("""SELECT user_id, max(CASE WHEN event_type <> 'error' THEN event_type END) AS last_label, count(DISTINCT event_type) AS labels FROM events WHERE event_type IN ('error', 'click') GROUP BY 1""")
def json_mask_info(spark, sf_dir):
    m = V.table(spark, sf_dir, "events").where(c("event_type").isin("error", "click")).groupBy("user_id").agg(F.to_json(F.map_from_entries(F.transform(F.sort_array(F.collect_set("event_type")), lambda x: F.struct(x, x)))).alias("j"))
    labels = F.map_values(F.from_json("j", "map<string,string>"))
    return m.select("user_id", filters.one_object(labels, "error").alias("last_label"), F.size(labels).cast("long").alias("labels"))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def registry_semi(spark, sf_dir):
    done = V.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(c("o_custkey").alias("c_custkey"))
    return V.table(spark, sf_dir, "customer").join(done, "c_custkey", "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_mktsegment, max(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS INTEGER)) AS latest, count(*) AS n FROM customer WHERE regexp_matches(c_name, '[0-9]+$') GROUP BY 1")
def latest_iteration(spark, sf_dir):
    p = V.table(spark, sf_dir, "customer").where(c("c_name").rlike("[0-9]+$"))
    return p.groupBy("c_mktsegment").agg(F.max(F.regexp_extract("c_name", "([0-9]+)$", 1).cast("int")).alias("latest"), F.count("*").alias("n"))
