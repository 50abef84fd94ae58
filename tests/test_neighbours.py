"""k-nearest neighbours by blocks of a space-filling curve, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom.operators import joins, neighbours

AXES = ("x", "y", "z")


def brute(a, b, k, metric, exclude_self, axes=AXES, by=()):
    """a, b: lists of dicts."""
    out = set()
    for p in a:
        near = []
        for q in b:
            if any(p[c] is None or q[c] is None or p[c] != p[c] or q[c] != q[c] for c in axes) or any(p[c] != q[c] for c in by) or exclude_self and p["pid"] == q["pid"]:
                continue
            d = [p[c] - q[c] for c in axes]
            near.append((sum(abs(x) for x in d) if metric == "l1" else sum(x * x for x in d), q["pid"]))
        out |= {(p["pid"], r + 1, i, round(d, 9)) for r, (d, i) in enumerate(sorted(near)[:k])}
    return out


def got(df):
    return {(r.a_pid, r["rank"], r.b_pid, round(r.dist, 9)) for r in df.collect()}


def points(n, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    p = np.concatenate([rng.normal(0, spread, (n // 2, 3)), rng.normal(50, 1e-3, (n // 3, 3)), rng.integers(0, 3, (n - n // 2 - n // 3, 3)).astype(float)])  # a dense spot, and many ties
    return [{"pid": i, "frame": int(rng.integers(0, 3)), **dict(zip(AXES, map(float, x), strict=True))} for i, x in enumerate(p)]


SCHEMA = "pid long, frame int, x double, y double, z double"


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_two_sides_with_groups_nulls_and_ties(spark, metric, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 5)
    monkeypatch.setattr(neighbours, "FAN", 3)
    monkeypatch.setattr(neighbours, "HELD", 2)
    a, b = points(70, 1), points(150, 2)
    a[3]["x"], b[4]["y"], b[5]["z"] = None, None, float("nan")
    da, db = spark.createDataFrame(a, SCHEMA).repartition(3), spark.createDataFrame(b, SCHEMA).repartition(3)
    assert got(joins.knn_join(da, db, 4, metric=metric, by=["frame"])) == brute(a, b, 4, metric, False, by=["frame"])
    assert got(joins.knn_join(db, db, 6, metric=metric, exclude_self=True)) == brute(b, b, 6, metric, True)
    assert got(joins.knn_join(da.limit(9), db, 200, metric=metric, axes=("x", "y"))) == brute([r.asDict() for r in da.limit(9).collect()], b, 200, metric, False, ("x", "y"))


def test_ids_that_are_texts_and_other_columns(spark):
    rows = [{"pid": f"p{i}", "x": float(i // 2), "y": 0.0, "z": 0.0, "tag": "t" * i} for i in range(12)]
    df = spark.createDataFrame(rows, "pid string, x double, y double, z double, tag string")
    out = joins.knn_join(df, df, 2, exclude_self=True)
    assert got(out) == brute(rows, rows, 2, "l2", True) and all(r.b_tag == "t" * int(r.b_pid[1:]) for r in out.collect())
    assert joins.knn_join(df, df.where("x > 99"), 2).count() == 0


def test_equal_points_are_many(spark):
    rows = [{"pid": i, "frame": 0, "x": 1.0, "y": 2.0, "z": 3.0} for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = got(joins.knn_join(df, df, 3, exclude_self=True))
    assert out == brute(rows, rows, 3, "l2", True)


def test_a_gap_in_density_costs_no_more(spark):
    """Half of the points a thousand times denser: as many pairs of blocks as for even points, at most twice."""
    rng = np.random.default_rng(3)
    even = rng.uniform(0, 1, (6000, 3))
    gap = np.concatenate([rng.uniform(0, 1, (3000, 3)), rng.uniform(0, 1e-3, (3000, 3)) + 0.5])
    counts = []
    for p in (even, gap):
        df = spark.createDataFrame([(i, 0, *map(float, x)) for i, x in enumerate(p)], SCHEMA)
        cut = neighbours.blocks(df, "pid", AXES, (), {c: (0.0, 1.0) for c in AXES})
        assert cut.agg(F.max("n")).first()[0] <= neighbours.BLOCK
        counts.append(neighbours.block_pairs(cut, cut, [], 3, 5).count())
    assert counts[1] <= 2 * counts[0] and counts[0] < 94 * 94  # of all pairs of the 94 blocks
