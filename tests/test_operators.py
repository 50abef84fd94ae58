import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.functions import geometry as G
from pointloom.operators import filters, joins, measures, series, simulate


def cloud(spark, xyz, part=None):
    rows = [(i, int(part[i]) if part is not None else 0, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(xyz)]
    return spark.createDataFrame(rows, "pid long, part int, x double, y double, z double")


def cube(spark):
    return cloud(spark, list(itertools.product((0, 1), repeat=3)))


@pytest.mark.parametrize("r,n", [(1.0, 4), (math.sqrt(2) + 1e-9, 7), (math.sqrt(3) + 1e-9, 8)])
def test_radius_join_on_a_cube(spark, r, n):
    c = cube(spark)
    assert {x["count"] for x in joins.radius_join(c, c, r).groupBy("a_pid").count().collect()} == {n}
    assert joins.radius_join(c, c, 1.0, strict=True).count() == 8
    assert joins.radius_join(c, c.where("pid = 0"), 1.0, how="left_semi").count() == 4


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_knn_matches_brute_force(spark, metric):
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.normal(0, 1, (60, 3)), rng.normal(40, 0.01, (6, 3)), [[500, 500, 500]]])
    c = cloud(spark, p)
    got = {}
    for x in joins.knn_join(c, c, 3, metric=metric, exclude_self=True).collect():
        got.setdefault(x.a_pid, []).append((x["rank"], x.b_pid))
    for i in range(len(p)):
        d = np.abs(p - p[i]).sum(1) if metric == "l1" else ((p - p[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [b for _, b in sorted(got[i])] == list(np.argsort(d, kind="stable")[:3])
    assert joins.knn_join(c, c.limit(0), 2).count() == 0 and joins.knn_join(c.where("pid < 2"), c.where("pid < 2"), 5).count() == 4


def test_edges_match_the_scan(spark):
    for seed in range(4):
        p = np.random.default_rng(seed).uniform(0, 1, (40, 3))
        c = cloud(spark, p)
        near = {}
        for i in range(len(p)):
            d = np.sqrt(((p - p[i]) ** 2).sum(1))
            near[i] = [j for j in np.argsort(d, kind="stable")[:5] if d[j] <= 0.4]
        seen, want = set(), set()
        for i in range(len(p)):
            for j in near[i]:
                if i != j and (i, j) not in seen and (j, i) not in seen:
                    seen.add((i, j))
                    want.add((i, j))
        assert {(r.src, r.dst) for r in joins.undirected_edges(joins.hybrid_join(c, c, 0.4, 5)).collect()} == want


def test_chamfer_of_a_shift(spark):
    p = np.random.default_rng(0).uniform(0, 100, (20, 3))
    d = measures.chamfer(cloud(spark, p), cloud(spark, p + [0.1, -0.2, 0.3]), "l1")
    assert all(abs(r["dist"] - 0.6) < 1e-9 for r in d.collect())


def test_track_error_of_a_frame_without_points(spark):
    t = spark.createDataFrame([(0, 1, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0)], "frame int, pid long, x double, y double, z double")
    p = spark.createDataFrame([(f, 1, 3.0, 4.0, 0.0) for f in range(3)], "frame int, pid long, x double, y double, z double")
    spine = spark.range(3).select(F.col("id").cast("int").alias("frame"))
    assert {(r.frame, r.error) for r in measures.track_error(t, p, spine).collect()} == {(0, 5.0), (1, 0.0), (2, 5.0)}


def test_psnr_and_iou_edges(spark):
    r = spark.range(1).select(measures.psnr(F.lit(0.0)).alias("p"), measures.psnr(F.lit(0.01)).alias("q")).first()
    assert math.isinf(r.p) and abs(r.q - 20) < 1e-9
    assert spark.range(3).agg(measures.iou(F.lit(False), F.lit(False)).alias("i")).first().i == 1.0


def test_voxel_first_matches_the_scan(spark):
    rng = np.random.default_rng(3)
    p, part = rng.uniform(0, 1, (80, 3)), rng.integers(0, 3, 80)
    seen, want, low = set(), set(), p.min(0)
    for i in sorted(range(80), key=lambda i: (part[i], i)):
        v = tuple(np.floor((p[i] - low) / 0.3))
        if v not in seen:
            seen.add(v)
            want.add(i)
    assert {r.pid for r in filters.voxel_first(cloud(spark, p, part), 0.3, "part", ["pid"]).collect()} == want


def test_distinct_first(spark):
    c = cloud(spark, [(1, 0, 0), (0, 0, 0), (1, 0, 0), (0, 5, 0), (0, 0, 0), (0, 0, 0)])
    assert [(r.pid, r.new_pid) for r in filters.distinct_first(c).orderBy("new_pid").collect()] == [(1, 0), (3, 1), (0, 2)]


def test_prefix_sum_and_numbers(spark):
    r = spark.createDataFrame([(i, i % 3) for i in random.Random(0).sample(range(100), 100)], "id long, n long")
    got = filters.prefix_sum(r, ["id"], "n", "upto").orderBy("id").collect()
    assert [x.upto for x in got] == list(np.cumsum([i % 3 for i in range(100)]))
    assert [x.k for x in filters.number_rows(r, ["id"], "k").orderBy("id").collect()] == list(range(100))


def test_drop_removed(spark):
    p = cloud(spark, [(0, 0, 0), (0, 1, 1), (2, 2, 2)])
    gone = p.where("pid = 0")
    assert {r.pid for r in filters.drop_removed(p, gone, ["pid"]).collect()} == {1, 2}
    assert {r.pid for r in filters.drop_removed(p, gone, ["pid"], compat=True).collect()} == {2}


def tracks(spark, n=40, frames=3, seed=0):
    rng = np.random.default_rng(seed)
    p0 = rng.uniform(0, 0.3, (n, 3))
    rows = []
    for f in range(frames):
        for i in range(n):
            x = p0[i] + f * (0.01 if i % 5 else 0.2)
            rows.append((f, i, *map(float, x), bool((i + f) % 9)))
    return spark.createDataFrame(rows, "frame int, pid long, x double, y double, z double, visible boolean")


def test_motion_filters(spark):
    t = tracks(spark)
    seq = {(r.frame, r.pid): r.consistent for r in filters.motion_filter_sequential(t, 0.1).collect()}
    pdf = t.toPandas().sort_values(["frame", "pid"])
    for f in (0, 1, 2):
        a = pdf[pdf.frame == f].reset_index(drop=True)
        b = pdf[pdf.frame == f + 1].reset_index(drop=True)
        ok = list(a.visible & b.visible) if len(b) else [False] * len(a)
        d = b[["x", "y", "z"]].to_numpy() - a[["x", "y", "z"]].to_numpy() if len(b) else np.zeros((len(a), 3))
        p = a[["x", "y", "z"]].to_numpy()
        for i in range(len(a)):
            if ok[i]:
                near = [j for j in range(len(a)) if ok[j] and np.linalg.norm(p[j] - p[i]) <= 0.1]
                agree = [j for j in near if np.linalg.norm(d[j] - d[i]) < 0.05]
                ok[i] = not (len(near) < 5 or 2 * len(agree) < len(near))
        assert [seq[f, i] for i in range(len(a))] == ok
    snap = filters.motion_filter_snapshot(t, 0.1)
    assert snap.count() == filters.forward_motion(t).where("motion_valid").count()


def test_farthest_points(spark):
    c = cloud(spark, np.random.default_rng(0).uniform(0, 1, (50, 3)))
    got = filters.farthest_points(c, 10).orderBy("nth").collect()
    assert got[0].pid == 0 and len({r.pid for r in got}) == 10
    with pytest.raises(Exception, match="50 points; 60 are needed"):
        filters.farthest_points(c, 60).collect()


def test_composite(spark):
    rows = [(1, 0.5, 1.0), (2, 0.5, 1.0), (3, 0.001, 1.0), (4, 0.99, 1.0), (5, 0.99, 1.0), (6, 0.9, 7.0)]
    out = spark.createDataFrame(rows, "k int, a double, c double").agg(measures.composite(F.col("k"), F.col("a"), F.col("c")).alias("s")).first().s
    left, colour, done = 1.0, 0.0, False
    for _, a, c in rows:
        if done or a < 1 / 255:
            continue
        a = min(a, 0.99)
        if left * (1 - a) < 1e-4:
            done = True
            continue
        colour, left = colour + c * a * left, left * (1 - a)
    assert abs(out.colour - colour) < 1e-12 and abs(out.left - left) < 1e-12 and out.done == done


def test_ssim_of_equal_images(spark):
    a = np.random.default_rng(0).uniform(0, 1, (12, 14))
    rows = [(0, u, v, float(a[v, u]), float(a[v, u])) for v in range(12) for u in range(14)] + [(1, u, v, float(a[v, u]), 0.5) for v in range(12) for u in range(14)]
    got = {r.frame: r.ssim for r in measures.ssim(spark.createDataFrame(rows, "frame int, u int, v int, a double, b double"), 12, 14).collect()}
    assert abs(got[0] - 1) < 1e-9 and got[1] < 0.9


def test_morphology(spark):
    b = spark.createDataFrame([(0, u, v) for u in range(3) for v in range(3)], "frame int, u int, v int")
    assert measures.morphology(b, 3, True).count() == 25
    assert [(r.u, r.v) for r in measures.morphology(b, 3, False).collect()] == [(1, 1)]


def test_recall_auc(spark):
    e = spark.createDataFrame([(0.5,), (1.5,), (9.0,), (2.5,)], "err double")
    got = {r.threshold: r.auc for r in measures.recall_auc(e, [1.0, 5.0]).collect()}
    err, rec = np.array([0, 0.5, 1.5, 2.5, 9.0]), np.arange(5) / 4
    for t, a in got.items():
        k = np.searchsorted(err, t)
        x, y = np.append(err[:k], t), np.append(rec[:k], rec[k - 1])
        assert abs(a - ((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum() / t) < 1e-9


# series


def test_resample_matches_the_loop(spark):
    r = random.Random(4)
    for _ in range(3):
        ts = sorted(r.uniform(-2, 20) for _ in range(12))
        want, nxt = [], 0
        for i, t in enumerate(ts):
            g = math.floor(t / 1.0 + 1e-5)
            while nxt <= g:
                want.append((nxt, i))
                nxt += 1
        rows = spark.createDataFrame([("c", i, t) for i, t in enumerate(ts)], "cam string, event_id long, t double")
        assert sorted((x.step, x.event_id) for x in series.resample(rows, ["cam"], "t", ["event_id"], 1.0).collect()) == want


def test_lerp_fill(spark):
    rows = spark.createDataFrame([(1, f, float(v)) for f, v in enumerate([0, 9, 9, 3, 9, 9, 9, 7, 5])], "pid int, frame int, x double")
    got = [r.x for r in series.lerp_fill(rows, ["pid"], "frame", ["x"], F.col("frame").isin(0, 3, 7)).orderBy("frame").collect()]
    assert np.allclose(got, [0, 1, 2, 3, 4, 5, 6, 7, 5])


def test_moving_average(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(6)] + [(2, 0, 3.0)], "k int, t int, x double")
    a = b = 0.0
    for i in range(6):
        a, b = 0.4 * i + 0.6 * a, 0.3 * i + 0.7 * b if i else float(i)
    one = {r.k: r.ema for r in series.moving_average(rows, ["k"], ["t"], "x", 0.4).collect()}
    two = {r.k: r.ema for r in series.moving_average(rows, ["k"], ["t"], "x", 0.3, None).collect()}
    assert abs(one[1] - a) < 1e-12 and abs(two[1] - b) < 1e-12 and two[2] == 3.0


def test_sync_asof_align(spark):
    rows = [("a", 1, 1.0), ("a", 2, 5.0), ("b", 3, 4.0), ("b", 4, 8.0), ("c", 5, 100.0)]
    s = spark.createDataFrame(rows, "cam string, id long, t double")
    got = {r.cam: r.id for r in series.synchronise(s, "cam", "t", "id", 4, 10.0).collect()}
    assert got == {"a": 2, "b": 3, "c": None}
    q = spark.createDataFrame([("a", 0.0), ("a", 2.0), ("a", 6.0)], "cam string, t double")
    want = {"backward": [None, 1, 2], "forward": [1, 2, None], "nearest": [1, 1, 2]}
    for d, ids in want.items():
        assert [r.id for r in joins.asof_join(q, s, "t", ["cam"], ["id"], d).orderBy("t").collect()] == ids
    assert [r.id for r in joins.asof_join(q, s, "t", ["cam"], ["id"], "nearest", 0.5).orderBy("t").collect()] == [None, None, None]
    steps = spark.createDataFrame([("a", i) for i in range(5)], "cam string, step long")
    some = spark.createDataFrame([("a", i, i * 10) for i in range(3)] + [("a", 9, 9)], "cam string, step long, v int")
    assert [r.v for r in series.align(some, steps, ["cam"], ["v"]).orderBy("step").collect()] == [0, 10, 20, 20, 20]


# physics


def test_internal_forces_cancel(spark):
    rng = np.random.default_rng(0)
    n = spark.createDataFrame([(i, *map(float, rng.normal(0, 1, 6))) for i in range(6)], "pid long, x double, y double, z double, vx double, vy double, vz double")
    s = spark.createDataFrame([(i, j, 0.7, 3.0) for i in range(6) for j in range(i)], "src long, dst long, rest double, log_y double")
    f = measures.spring_force(s, n, 0.5, 1.0, 50.0)
    assert all(abs(x) < 1e-9 for x in f.agg(F.sum("fx"), F.sum("fy"), F.sum("fz")).first())
    p, e = n.toPandas().sort_values("pid"), s.toPandas()
    k = simulate.spring_forces(p[["x", "y", "z"]].to_numpy(), p[["vx", "vy", "vz"]].to_numpy(), e.src.to_numpy(), e.dst.to_numpy(), e.rest.to_numpy(), np.exp(e.log_y.to_numpy()), simulate.Physics(damping=0.5, stiff_min=1.0, stiff_max=50.0))
    assert np.allclose(f.toPandas().sort_values("pid")[["fx", "fy", "fz"]], k)


def test_ground_matches_the_kernel(spark):
    rng = np.random.default_rng(2)
    x, v = rng.uniform(0, 0.01, (20, 3)), rng.normal(0, 1, (20, 3))
    n = spark.createDataFrame([(i, *map(float, x[i]), *map(float, v[i])) for i in range(20)], "pid long, x double, y double, z double, vx double, vy double, vz double")
    got = measures.ground_step(n, 0.01, 0.7, 0.3).toPandas().sort_values("pid")
    gx, gv = simulate.ground(x, v, simulate.Physics(dt=0.01, elastic=0.7, friction=0.3))
    assert np.allclose(got[["x", "y", "z"]], gx) and np.allclose(got[["vx", "vy", "vz"]], gv)


def test_rollout_falls_and_stays_above_ground(spark):
    n = spark.createDataFrame([(0, i, float(i), 0.0, 0.3) for i in range(3)], "case long, pid long, x double, y double, z double")
    s = spark.createDataFrame([(0, 0, 1, 1.0, 3.0), (0, 1, 2, 1.0, 3.0)], "case long, src long, dst long, rest double, log_y double")
    out = simulate.rollout(n, s, 8, simulate.Physics(dt=1e-3, substeps=40, damping=1.0)).toPandas()
    assert len(out) == 24 and out.z.min() > -1e-3 and out[out.frame == 2].z.max() < 0.3
    assert simulate.rollout(n, s.limit(0), 2, simulate.Physics(substeps=3)).count() == 6


def test_evolution_finds_a_minimum():
    best, loss = simulate.evolve(lambda x: ((x - 0.3) ** 2).sum(1), 4, generations=40)
    assert loss < 1e-2 and np.abs(best - 0.3).max() < 0.1


def test_skinning_of_a_rigid_motion(spark):
    p = np.random.default_rng(1).uniform(0, 1, (25, 3))
    a = 0.4
    rot = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    q = p @ rot.T + [1, 2, 3]
    rest, moved = cloud(spark, p).drop("part"), cloud(spark, q).drop("part")
    near = joins.knn_join(rest, rest, 6, exclude_self=True)
    r = simulate.bone_rotations(rest, moved, near)
    for x in r.collect():
        assert np.allclose(np.array(x.r).reshape(3, 3), rot, atol=1e-8)
    bones = rest.join(moved.select("pid", *[F.col(c).alias("m" + c) for c in "xyz"]), "pid").select("pid", *"xyz", *[(F.col("m" + c) - F.col(c)).alias("d" + c) for c in "xyz"])
    w = measures.idw_weights(near)
    assert abs(w.groupBy("a_pid").agg(F.sum("weight").alias("s")).agg(F.max("s")).first()[0] - 1) < 1e-9
    assert np.allclose(simulate.skin(rest, w, bones, r).toPandas().sort_values("pid")[["x", "y", "z"]], q, atol=1e-6)


def test_sinkhorn_marginals(spark):
    s = spark.createDataFrame([("g", i, j, float((i * 7 + j * 3) % 5)) for i in range(4) for j in range(3)], "g string, i long, j long, score double")
    p = simulate.sinkhorn(s, "g", iterations=200).toPandas()
    assert np.allclose(p[p.i >= 0].groupby("i").p.sum(), 1, atol=1e-3) and np.allclose(p[p.j >= 0].groupby("j").p.sum(), 1, atol=1e-3)


def test_two_parts(spark):
    p = np.concatenate([np.random.default_rng(0).normal(m, 0.1, (10, 3)) for m in (5, 0)])
    got = {r["pid"]: r["part"] for r in simulate.two_parts(cloud(spark, p).withColumnRenamed("part", "g"), "g").collect()}
    assert all(got[i] == 1 for i in range(10)) and all(got[i] == 0 for i in range(10, 20))


# geometry


def test_project_inverts_deproject(spark):
    rows = spark.createDataFrame([(10, 20, 1.5), (300, 200, 0.7)], "u long, v long, d double")
    p = G.deproject(F.col("u"), F.col("v"), F.col("d"), 425.0, 424.0, 320.0, 240.0)
    u, v = G.project(p, 425.0, 424.0, 320.0, 240.0)
    assert all((r.u, r.v) == (r.uu, r.vv) for r in rows.select("u", "v", u.alias("uu"), v.alias("vv")).collect())


def test_quaternions_round_trip(spark):
    rng = np.random.default_rng(0)
    q = rng.normal(0, 1, (30, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    df = spark.createDataFrame([tuple(map(float, x)) for x in q], "a double, b double, c double, d double")
    m = df.select("a", "b", "c", "d", *[x.alias(f"r{i}") for i, x in enumerate(G.quaternion_matrix([F.col(x) for x in "abcd"]))])
    back = m.select("a", "b", "c", "d", *[x.alias(f"q{i}") for i, x in enumerate(G.matrix_quaternion([F.col(f"r{i}") for i in range(9)]))]).toPandas().to_numpy()
    assert np.allclose(np.abs((back[:, :4] * back[:, 4:]).sum(1)), 1)


def test_morton_and_schedule(spark):
    r = spark.range(1).select(G.morton(F.lit(3), F.lit(0), F.lit(1)).alias("m"), G.rate(F.lit(-1), 1e-2, 1e-4, 0, 1.0, 100).alias("a"), G.rate(F.lit(0), 1e-2, 1e-4, 0, 1.0, 100).alias("b"), G.rate(F.lit(100), 1e-2, 1e-4, 0, 1.0, 100).alias("c")).first()
    assert r.m == 0b001101 and r.a == 0 and abs(r.b - 1e-2) < 1e-12 and abs(r.c - 1e-4) < 1e-12
    with pytest.raises(ValueError):
        G.unit_range(F.lit(1), 2, 2)


def test_tiles_cover_the_square(spark):
    s = spark.createDataFrame([(1, 8.0, 8.0, 20.0), (2, -50.0, 5.0, 10.0)], "gid int, u double, v double, radius double")
    assert sorted(r.tile for r in joins.tile_join(s, 64, 48).collect()) == [0, 1, 4, 5]


def test_one_object(spark):
    ok = spark.createDataFrame([(["hand", "sloth"],)], "l array<string>").select(filters.one_object(F.col("l")).alias("o")).first()
    assert ok.o == "sloth"
    with pytest.raises(Exception, match="more than one object"):
        spark.createDataFrame([(["a", "b"],)], "l array<string>").select(filters.one_object(F.col("l"))).collect()


def test_param_sweep_has_every_case(spark):
    from pointloom.plans import physics

    d = "/root/testdata/sf0.001"
    cases = {r.case for r in physics._case(spark, d)[0].select("case").distinct().collect()}
    got = [(r.candidate, r.case) for r in physics.param_sweep(spark, d).collect()]
    assert len(cases) > 3 and sorted(got) == sorted((i, k) for i in range(4) for k in cases)
