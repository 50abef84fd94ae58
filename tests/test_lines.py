"""The point nearest to a line within a reach, against all pairs."""

import numpy as np
import pytest

from pointloom import registry
from pointloom.operators import lines, neighbours

SCHEMA = "pid long, x double, y double, z double"


def brute(a, b, r):
    out = {}
    for i, *p in a:
        p = np.array(p, float)
        best = None
        for j, *q in b:
            q = np.array(q, float)
            if ((p - q) ** 2).sum() <= r * r:
                d = np.sqrt((np.cross(q, p) ** 2).sum()) / np.sqrt((p * p).sum()) if p.any() else 0.0
                best = min(best, (d, j)) if best else (d, j)
        if best:
            out[i] = best[1], round(best[0], 9) if p.any() else None
    return out


@pytest.mark.parametrize("block", [5, 64])
def test_equals_all_pairs(spark, monkeypatch, block):
    """Dense and sparse places, points at and around the origin, copies, outliers, nulls and NaN."""
    monkeypatch.setattr(neighbours, "FAN", 3)
    monkeypatch.setattr(neighbours, "HELD", 3)
    cut = neighbours.blocks
    monkeypatch.setattr(neighbours, "blocks", lambda *args: cut(*args, block))
    rng = np.random.default_rng(5)
    some = lambda n: np.concatenate([rng.normal(0, 0.12, (n, 3)), rng.normal(1, 0.01, (n // 2, 3)), rng.normal(0, 0.005, (n // 4, 3)), rng.uniform(-3, 3, (n // 4, 3)), np.round(rng.normal(0, 0.2, (n // 2, 3)), 1)])
    a = [(i, *map(float, x)) for i, x in enumerate(some(120))] + [(5000, 0.0, 0.0, 0.0)]
    b = [(10_000 - i, *map(float, x)) for i, x in enumerate(some(200))]
    b += [(20_000 + i, *x) for i, (_, *x) in enumerate(b[:50])]
    odd = [(7000, None, 0.0, 0.0), (7001, float("nan"), 0.0, 0.0)]
    out = lines.nearest_to_lines(spark.createDataFrame(a + odd, SCHEMA).repartition(3), spark.createDataFrame(odd + b, SCHEMA).repartition(3), 0.2)
    got = {r.a: (r.b, None if r.d is None else round(r.d, 9)) for r in out.collect()}
    want = brute(a, b, 0.2)
    assert got.keys() == want.keys() and all(abs((x[1] or 0) - (want[i][1] or 0)) < 1e-8 and (x[1] is None) == (want[i][1] is None) for i, x in got.items())
    assert sum(x[0] != want[i][0] for i, x in got.items()) == 0
    assert lines.nearest_to_lines(spark.createDataFrame(odd, SCHEMA), spark.createDataFrame(b, SCHEMA), 0.2).count() == 0


def test_ray_closest_makes_no_pairs_within_the_radius(spark):
    """The plan has no join on the coordinates' cells."""
    plan = registry.queries()["ray_closest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "__x" not in plan
