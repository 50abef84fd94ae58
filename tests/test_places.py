"""Nearest rows within a task against all pairs, and the work of a sweep over one large case."""

import numpy as np
import pytest

from pointloom.operators import places, simulate

R = np.random.default_rng(7)
SETS = {
    "normal": R.normal(size=(900, 3)), "copies": R.integers(0, 4, (900, 3)).astype(float), "grid": R.integers(0, 10, (900, 3)).astype(float), "one place": np.ones((400, 3)),
    "outliers": np.concatenate([R.normal(size=(600, 3)), R.normal(size=(20, 3)) * 1e9, R.normal(size=(3, 3)) * 1e200]), "line": np.c_[R.uniform(size=700), np.zeros((700, 2))],
    "nulls": np.where(R.uniform(size=(400, 3)) < 0.02, np.nan, R.normal(size=(400, 3))), "few": R.normal(size=(3, 3)), "none": np.zeros((0, 3)),
}


@pytest.mark.parametrize("name", SETS)
@pytest.mark.parametrize("k,r", [(1, 1e9), (6, 0.3), (6, 3.0), (50, 1.0)])
def test_nearest_equals_all_pairs(name, k, r):
    """Ties go to the smaller place; distances are the same to the last bit."""
    b = SETS[name]
    for a in (b, SETS["normal"][:200], SETS["grid"][:200]):
        with np.errstate(all="ignore"):
            d = ((a[:, None] - b[None]) ** 2).sum(2)
        order = np.argsort(d, 1, kind="stable")[:, :k]
        near = np.take_along_axis(d, order, 1)
        i, rank = np.nonzero(near <= r * r)
        for got, want in zip(places.nearest(a, b, k, r * r), (i, order[i, rank], near[i, rank], rank), strict=True):
            assert np.array_equal(got, want)


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_nearest_squares_of_what_is_not_finite():
    odd = np.array([[np.inf, 0, 0], [-np.inf, 0, 0], [0, 0, 1.0], [1e200, 0, 0]])
    for b in (odd, odd[1:], odd[2:], np.concatenate([odd, [[np.nan, 0, 0]]]), odd[:2]):
        for a in (odd, np.array([[0, np.nan, 0], [0.5, 0, 0]])):
            want = ((a[:, None] - b[None]) ** 2).sum(2).min(1)
            for at in range(len(b)):
                assert np.array_equal(simulate.nearest_squares(a, b, np.full(len(a), at)), want, equal_nan=True)


def test_springs_and_losses_of_a_large_case_meet_few_pairs(monkeypatch):
    """both were made of all pairs of a case."""
    n, met, squares = 20000, [0], places.squares

    def counted(a, b):
        met[0] += len(a) * len(b)
        return squares(a, b)

    monkeypatch.setattr(places, "squares", counted)
    x = R.normal(size=(n, 3)) * 0.12
    src, dst, rest, _ = simulate.build_springs(x, x[:5] + 0.01, None, simulate.Rig(0.2, 6, 0.05, 4))
    assert len(src) > 2 * n and 0 < met[0] < n * n / 10
    met[0] = 0
    truth = {f: (np.arange(n), x + R.normal(size=x.shape) * 0.003) for f in (1, 2)}
    assert simulate.frame_losses([x, x, x], truth) > 0 and 0 < met[0] < 2 * n * n / 10


def test_deals_of_candidates_have_the_losses_of_each(spark):
    """Candidates of unlike rigs share a listing of neighbours; more of them than deals, and a case that the truth alone has."""
    x = {case: R.normal(size=(60, 3)) * 0.1 + [0, 0, 0.6] for case in (1, 2, 3)}
    nodes = spark.createDataFrame([(c, i, *map(float, p), i % 2) for c, q in x.items() for i, p in enumerate(q)], "case long, pid long, x double, y double, z double, mask long")
    truth = {c: {f: (np.arange(0, 60, 2), q[::2] + 0.01 * f) for f in range(4)} for c, q in x.items()}
    seen = spark.createDataFrame([(c, f, int(i), *map(float, p)) for c, t in truth.items() for f, (at, q) in t.items() for i, p in zip(at, q)] + [(9, 1, 0, 0.0, 0.0, 0.0)], "case long, frame int, pid long, x double, y double, z double")
    cand = [(100 + i, 0.05 + 0.02 * (i % 5), float(2 + i % 7), 1.0 + i) for i in range(11)]
    p = simulate.Physics(dt=1e-3, substeps=5, damping=1.0)
    got = {(r.candidate, r.case): r.loss for r in simulate.sweep(nodes, seen, spark.createDataFrame(cand, "candidate long, radius double, neighbours double, drag double"), 3, p, simulate.Rig()).collect()}
    assert len(got) == 33
    for n, radius, k, drag in cand:
        for c, q in x.items():
            mask = np.arange(60) % 2
            springs = simulate.build_springs(q, np.zeros((0, 3)), mask, simulate.Rig(radius, k))
            found = list(simulate.frames_of(q, springs, 3, simulate.replace(p, drag=drag), np.ones(60), mask, {}))
            assert got[n, c] == simulate.frame_losses(found, truth[c])
