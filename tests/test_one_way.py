"""Springs whose ends are told where they are found: the same edges and forces as by shuffles of all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointloom import registry
from pointloom.operators import joins, measures, neighbours

DATA = "/root/testdata/sf0.001"


@pytest.fixture
def nodes(spark, monkeypatch):
    """Points at random, on a grid and twice in one place, in many units; some have no velocity."""
    monkeypatch.setattr(neighbours, "UNIT", 8)
    rng = np.random.default_rng(11)
    p = np.concatenate([rng.uniform(0, 1, (1500, 3)), np.round(rng.uniform(0, 1, (400, 3)), 1)])
    rows = [(i, *map(float, x), *(None if i % 50 == 7 else float(v) for v in rng.normal(size=3))) for i, x in enumerate(p[rng.permutation(len(p))])]
    return spark.createDataFrame(rows, "pid long, x double, y double, z double, vx double, vy double, vz double")


@pytest.mark.parametrize("axes, bits", [(1, 5), (2, 4), (3, 3)])
def test_places_that_follow_each_other_touch(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    at = neighbours.hilbert(list(cells.T), bits)
    assert sorted(at) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(at)], axis=0)).sum(1) == 1).all()


def test_ways_back_are_known_within_a_unit(nodes):
    """Pairs of one unit are told both ways, and few are left; with them the edges are those of the listing."""
    listed = joins.hybrid_join(nodes, nodes, 0.12, 6, back=True)
    rows = listed.where("a_pid <> b_pid").collect()
    pairs = {(r.a_pid, r.b_pid) for r in rows}
    assert all(r.back == ((r.b_pid, r.a_pid) in pairs) for r in rows if r.back is not None)
    assert {True, False} < {r.back for r in rows} and sum(r.back is None for r in rows) < 0.6 * len(rows)
    edges = joins.one_way(listed).select("src", "dst", "rest", "sure").collect()
    sent = {(r.src, r.dst) for r in edges}
    got = sorted((r.src, r.dst, r.rest) for r in edges if r.sure or r.src < r.dst or (r.dst, r.src) not in sent)
    assert got == sorted((r.src, r.dst, r.rest) for r in joins.undirected_edges(listed).collect())


@pytest.mark.parametrize("least", [0.0, 9.0])
def test_forces_of_one_way_edges(nodes, least):
    """The sums are those of springs joined by ids, also where some springs are too soft to count."""
    near = joins.hybrid_join(nodes, nodes, 0.12, 6, back=True)
    made = lambda e: e.withColumns({"rest": F.col("rest") * 0.9, "log_y": 2.0 + (F.col("src") % 5) * 0.3})
    got = {r.pid: r for r in measures.one_way_force(made(joins.one_way(near)), 0.5, least, 50.0).collect()}
    want = {r.pid: r for r in measures.spring_force(made(joins.undirected_edges(near)), nodes, 0.5, least, 50.0).collect()}
    assert sorted(got) == sorted(want) and len(got) > 1000
    for pid, r in want.items():
        assert list(got[pid][1:]) == [None if x is None else pytest.approx(x, rel=1e-9, abs=1e-9) for x in r[1:]]


def test_velocities_meet_no_springs_by_id(spark):
    """the nodes are joined with their forces only; ends of springs are sent once, to their node."""
    plan = registry.queries()["velocity_step"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("MapInArrow")[0].count("Join") == 1


def test_units_are_sent_few_points(spark, monkeypatch):
    """of blocks that follow a curve without leaps, a unit looks at few others."""
    out, plain = [], neighbours.in_units
    monkeypatch.setattr(neighbours, "in_units", lambda *args: out.append(plain(*args)) or out[-1])
    p = np.random.default_rng(12).normal(0, 0.12, (40000, 3))
    df = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(p)], "pid long, x double, y double, z double")
    joins.hybrid_join(df, df, 0.1, 6)
    assert out[-1].agg(F.sum(F.size("b"))).first()[0] < 3 * len(p)  # 4 on a Z-curve


def test_forces_of_sides(nodes):
    """Velocities that meet nodes give the sums of velocities that meet springs."""
    n = nodes.where("vx is not null")
    near = joins.hybrid_join(n.select("pid", *joins.AXES), n.select("pid", *joins.AXES), 0.12, 6, back=True)
    made = lambda e: e.withColumns({"rest": F.col("rest") * 0.9, "log_y": 2.0 + (F.col("src") % 5) * 0.3})
    got = {r.side: r for r in measures.side_forces(made(joins.one_way(near)), n, lambda src: (src % 3).cast("int"), (0, 1, 2, 3), 0.5, 1.0, 50.0).collect()}
    e = made(joins.undirected_edges(near))
    for end, as_ in (("src", "a_"), ("dst", "b_")):
        e = e.join(n.select(F.col("pid").alias(end), *[F.col(x).alias(as_ + x) for x in n.columns[1:]]), end)
    pulls = measures.pulls(e, 0.5, 1.0, 50.0, *["b_" + x for x in joins.AXES]).groupBy((F.col("src") % 3).cast("int").alias("side"))
    want = pulls.agg(*[(-F.sum("f" + x)).alias("f" + x) for x in joins.AXES], *[F.avg("b_" + x).alias("c" + x) for x in joins.AXES]).collect()
    assert sorted(got) == [0, 1, 2] == sorted(r.side for r in want)
    for r in want:
        assert list(got[r.side]) == pytest.approx(list(r), rel=1e-9, abs=1e-9)


def test_a_controller_force_meets_no_springs_by_id(spark):
    """velocities meet a row of each node; springs aren't joined."""
    plan = registry.queries()["controller_force"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("MapInArrow")[0].count("Join") == 1


@pytest.mark.parametrize("odd", ["null", "null_vector"])
def test_a_controller_force_without_some_velocities_is_that_of_the_sql(spark, tmp_path, odd):
    """Springs at a node without a velocity count in the mean place, and not in the force; a vector that is null isn't there."""
    import duckdb

    e, gone = F.col("embedding"), F.col("vec_id") % 40 == 7
    less = F.transform(e, lambda x, i: F.when(i != 4, x)) if odd == "null" else F.lit(None).cast("array<float>")
    spark.read.parquet(f"{DATA}/embeddings.parquet").withColumn("embedding", F.when(gone, less).otherwise(e)).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(duck.sql(registry.oracle_sql()["controller_force"]).fetchall())
    got = sorted(tuple(r) for r in registry.queries()["controller_force"](spark, str(tmp_path)).select("part", "fx", "fy", "fz", "cx", "cy", "cz").collect())
    assert len(got) == 2 and got == [pytest.approx(r, abs=1e-9) for r in want]
