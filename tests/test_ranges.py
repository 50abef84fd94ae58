"""Running maxima, quantiles and what is built on them, where a key goes over many ranges."""

import random

import numpy as np
import pandas as pd
import pytest

from pointloom.operators import filters, joins, series


@pytest.fixture
def many_parts(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(n=400, keys=2, seed=0):
    r = random.Random(seed)
    return [(r.randrange(keys), i, r.choice([None, *map(float, range(50))])) for i in range(n)]


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_maximum(spark, many_parts, inclusive):
    data = rows()
    got = {(r.k, r.t): r.m for r in filters.carried(spark.createDataFrame(data, "k int, t int, v double"), ["k"], ["t"], "v", "m", inclusive).collect()}
    for k in (0, 1):
        best = None
        for _, t, v in sorted(x for x in data if x[0] == k):
            if not inclusive:
                assert got[k, t] == best
            best = v if best is None else best if v is None else max(best, v)
            if inclusive:
                assert got[k, t] == best
    assert filters.carried(spark.createDataFrame([], "k int, t int, v double"), ["k"], ["t"], "v", "m").count() == 0


@pytest.mark.parametrize("n,q", [(1, 0.5), (2, 0.5), (101, 0.5), (100, 0.5), (100, 0.1)])
def test_quantile(spark, many_parts, n, q):
    r = random.Random(n)
    data = [(r.choice([1.0, 2.0, r.random()]),) for _ in range(n)] + [(None,)]
    assert abs(filters.quantile(spark.createDataFrame(data, "x double"), "x", q) - np.quantile([x for (x,) in data if x is not None], q)) < 1e-12
    assert filters.quantile(spark.createDataFrame([(None,)], "x double"), "x", q) is None


def test_average_over_ranges(spark, many_parts):
    data = [(k, t, float(v or 0)) for k, t, v in rows(500, 1)]
    a, b = 0.0, data[0][2]
    for _, _, x in data:
        a, b = 0.3 * x + 0.7 * a, 0.3 * x + 0.7 * b
    df = spark.createDataFrame(data, "k int, t int, x double")
    assert abs(series.moving_average(df, ["k"], ["t"], "x", 0.3).first().ema - a) < 1e-9
    assert abs(series.moving_average(df, ["k"], ["t"], "x", 0.3, None).first().ema - b) < 1e-9


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
def test_asof_over_ranges(spark, many_parts, direction):
    r = random.Random(2)
    right = [(0, round(x * 0.5, 1), i) for i, x in enumerate(sorted(r.sample(range(1000), 200)))]
    left = [(0, float(x)) for x in r.sample(range(520), 150)]
    got = joins.asof_join(spark.createDataFrame(left, "k int, t double"), spark.createDataFrame(right, "k int, t double, v int"), "t", ["k"], ["v"], direction)
    want = pd.merge_asof(pd.DataFrame(left, columns=["k", "t"]).sort_values("t"), pd.DataFrame(right, columns=["k", "t", "v"]), on="t", by="k", direction=direction)
    found = {x.t: x.v for x in got.collect()}
    assert found == {a.t: None if a.v != a.v else int(a.v) for a in want.itertuples()}


def test_newest_of_a_hot_key(spark):
    data = [(0, float(i % 97), i) for i in range(1000)]
    got = {(x.nth, x.i) for x in series.last_k(spark.createDataFrame(data, "k int, t double, i int"), ["k"], "t", "i", 5).collect()}
    assert got == {(n + 1, x[2]) for n, x in enumerate(sorted(data, key=lambda x: (-x[1], -x[2]))[:5])}


def test_split_splats_and_affine_inverse(spark):
    from pyspark.sql import functions as F

    from pointloom.functions import cameras
    from pointloom.operators import vision

    q = np.array([0.8, 0.0, 0.0, 0.6])
    df = spark.createDataFrame([(i, 1.0, 2.0, 3.0, 2.0, 0.01, 0.01, *map(float, q), 1.0 if i % 2 else 0.1) for i in range(400)], "gid int, x double, y double, z double, s0 double, s1 double, s2 double, q0 double, q1 double, q2 double, q3 double, gradient double")
    got = vision.split_splats(df, 0.5, 1.0, n=2, seed=3).toPandas()
    kept, new = got[got["copy"] == 0], got[got["copy"] > 0]
    assert len(kept) == 200 and len(new) == 400 and (kept["gid"] % 2 == 0).all() and np.allclose(new["s0"], 2.0 / 1.6)
    d = new[["x", "y"]].to_numpy() - [1.0, 2.0]
    axis = np.array([0.28, 0.96])  # the turned x axis
    along = d @ axis
    assert 1.7 < along.std() < 2.3 and np.abs(d - along[:, None] * axis).max() < 0.1
    m = np.array([[2.0, 0.3, 0.1, 5.0], [0.2, 1.5, 0.0, -1.0], [0.0, 0.4, 3.0, 2.0]])
    row = spark.range(1).select(F.array(*cameras.inverse_affine([F.lit(float(x)) for x in m.ravel()])).alias("i")).first().i
    full = np.linalg.inv(np.vstack([m, [0, 0, 0, 1]]))[:3]
    assert np.allclose(np.array(row).reshape(3, 4), full)
    ranks = [np.zeros((3, 3)), np.outer([1.0, 2, 3], [1.0, 0, 2]), np.diag([1.0, 2.0, 0.0]), np.eye(3)]
    assert [spark.range(1).select(cameras.rank([F.lit(float(x)) for x in a.ravel()]).alias("r")).first().r for a in ranks] == [0, 1, 2, 3]


def test_frame_hook(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "frame int, x double")
    got = series.apply_frames(df, lambda p: p.assign(x=p["x"] - p["x"].mean()), "frame int, x double").collect()
    assert sorted((r.frame, r.x) for r in got) == [(0, -1.0), (0, 1.0), (1, 0.0)]
