"""Springs of many points: what is shuffled for them, and that the results stay those of brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import registry
from pointloom.operators import joins, measures, neighbours

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def sent(monkeypatch):
    """What the searches send, as they are called."""
    out, plain = [], neighbours.in_units
    monkeypatch.setattr(neighbours, "in_units", lambda *args: out.append(plain(*args)) or out[-1])
    return out


def brute(p, part, k, r):
    """The listing of the k nearest within r, of one part each: {(i, j)}."""
    out = set()
    for i, x in enumerate(p):
        d = ((p - x) ** 2).sum(1)
        near = sorted((d[j], j) for j in np.flatnonzero((d <= r * r) & (part == part[i])))
        out |= {(i, int(j)) for _, j in near[:k]}
    return out


def test_a_unit_is_sent_only_the_points_in_reach(spark, sent, monkeypatch):
    """Blocks that meet at home aren't sent, and of others no points but those in reach. The pairs are those of brute force."""
    monkeypatch.setattr(neighbours, "UNIT", 8)
    rng = np.random.default_rng(8)
    p, part = np.concatenate([rng.uniform(0, 1, (2000, 3)), np.round(rng.uniform(0, 1, (400, 3)), 1)]), rng.integers(0, 2, 2400)
    df = spark.createDataFrame([(i, int(g), *map(float, x)) for i, (g, x) in enumerate(zip(part, p, strict=True))], "pid long, part int, x double, y double, z double")
    out = joins.hybrid_join(df, df, 0.2, 5, by=["part"])
    assert {(r.a_pid, r.b_pid) for r in out.collect()} == brute(p, part, 5, 0.2)
    assert 0 < sent[-1].agg(F.sum(F.size("b"))).first()[0] < 2 * len(p)
    assert sent[-1].where("b is not null and unit = floor(node / 8)").count() == 0
    assert sent[0].where("b is not null and unit = floor(node / 8)").count() == 0


@pytest.mark.parametrize("metric", ["l1", "l2"])
def test_groups_that_share_a_unit_stay_apart(spark, metric):
    """Groups of a few points each, all of one unit; a group named NaN is one of them, and single points find only themselves."""
    rng = np.random.default_rng(9)
    p, part = rng.normal(size=(90, 3)), rng.integers(0, 30, 90)
    df = spark.createDataFrame([(i, float(g), *map(float, x)) for i, (g, x) in enumerate(zip(part, p, strict=True))] + [(90, float("inf"), 0.0, 0.0, 0.0)], "pid long, part double, x double, y double, z double")
    got = {(r.a_pid, r.b_pid) for r in joins.knn_join(df, df, 3, metric=metric, by=["part"]).collect()}
    want = {(90, 90)}
    for i, x in enumerate(p):
        d = np.abs(p - x).sum(1) if metric == "l1" else ((p - x) ** 2).sum(1)
        want |= {(i, j) for _, j in sorted((d[j], int(j)) for j in np.flatnonzero(part == part[i]))[:3]}
    assert got == want


def test_springs_by_mask_keeps_the_part_of_its_pairs(spark):
    """the part comes with the edges, which meet no table for it."""
    rng = np.random.default_rng(10)
    p, part = rng.uniform(0, 1, (200, 3)), rng.integers(0, 3, 200)
    df = spark.createDataFrame([(i, int(g), *map(float, x)) for i, (g, x) in enumerate(zip(part, p, strict=True))], "pid long, part int, x double, y double, z double")
    e = joins.undirected_edges(joins.hybrid_join(df, df, 0.3, 4, by=["part"]), by=["part"])
    listed = brute(p, part, 4, 0.3)
    want = {(i, j, int(part[i])) for i, j in listed if i < j or i > j and (j, i) not in listed}
    got = [(r.src, r.dst, r.part) for r in e.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = registry.queries()["springs_by_mask"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "(src#" not in plan.split("MapInArrow")[0]


def test_a_force_makes_its_joins_once(spark):
    """each spring meets its two ends once, and pulls both."""
    nodes = spark.createDataFrame([(i, float(i), 0.0, 0.0, 0.0, 0.1 * i, 0.0) for i in range(4)], "pid long, x double, y double, z double, vx double, vy double, vz double")
    springs = spark.createDataFrame([(0, 1, 0.5, 1.0), (2, 1, 0.8, 1.0), (2, 3, 0.9, 2.0)], "src long, dst long, rest double, log_y double")
    out = measures.spring_force(springs, nodes, 0.5, 1.0, 50.0)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 2
    rows = {r.pid: r for r in out.collect()}
    assert sorted(rows) == [0, 1, 2, 3]
    assert all(abs(sum(r[f] for r in rows.values())) < 1e-12 for f in ("fx", "fy", "fz"))
    assert rows[0].fx == pytest.approx(np.e) and rows[3].fx == pytest.approx(-np.exp(2.0) * (1 / 0.9 - 1))


def test_velocities_need_the_search_once(spark):
    """one search and three joins by id."""
    plan = registry.queries()["velocity_step"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_a_controller_force_searches_places_only(spark, sent):
    """no column but the places and the id goes through the search."""
    registry.queries()["controller_force"](spark, DATA).collect()
    assert sent[-1].schema["b"].dataType.elementType.names == ["pid", "x", "y", "z"]
