"""The simulator against a plain loop over points, springs and pairs."""

import math

import numpy as np
import pandas as pd
import pytest

from pointloom.operators import simulate


def loop(x, springs, frames, p, mass, mask, path):
    """One point, spring and pair after another."""
    x, v, n = [np.array(a, float) for a in x], [np.zeros(3) for _ in x], len(x)
    at = path.get(0, np.zeros((0, 3)))
    out = [np.array(x)]
    clip = lambda a, lo, hi: min(hi, max(lo, a))
    for f in range(1, frames):
        after = path.get(f, at)
        near = [(i, k) for i in range(n) for k in range(n) if i != k and mask[i] != mask[k] and np.linalg.norm(x[k] - x[i]) < p.collide]
        for step in range(p.substeps):
            c = at + (step + 1) / p.substeps * (after - at)
            force = [np.zeros(3) for _ in range(n)]
            place, speed = lambda q: x[q] if q < n else c[q - n], lambda q: v[q] if q < n else np.zeros(3)
            for a, b, rest, y in springs:
                d = place(b) - place(a)
                size = np.linalg.norm(d)
                u = d / max(size, 1e-6)
                pull = (clip(y, p.stiff_min, p.stiff_max) * (size / rest - 1) + p.damping * ((speed(b) - speed(a)) @ u)) * u
                if a < n:
                    force[a] += pull
                if b < n:
                    force[b] -= pull
            u = [(v[i] + (force[i] / mass[i] + np.array([0, 0, p.gravity])) * p.dt) * math.exp(-p.dt * p.drag) for i in range(n)]
            w = [a.copy() for a in u]
            for i in range(n):
                total, hits = np.zeros(3), 0
                for a, k in near:
                    d, r = x[k] - x[i], u[k] - u[i]
                    if a != i or np.linalg.norm(d) >= p.collide or d @ r >= -1e-4:
                        continue
                    nn = d / max(np.linalg.norm(d), 1e-6)
                    vn = (r @ nn) * nn
                    vt = r - vn
                    e, fr = clip(p.object_elastic, 0, 1), clip(p.object_friction, 0, 2)
                    s = max(0, 1 - fr * (1 + e) * np.linalg.norm(vn) / max(np.linalg.norm(vt), 1e-6))
                    total += (-(1 + e) * vn + (s - 1) * vt) / (1 / mass[i] + 1 / mass[k])
                    hits += 1
                if hits:
                    w[i] = u[i] - total / hits / mass[i]
            for i in range(n):
                e, fr, a, toi = clip(p.elastic, 0, 1), clip(p.friction, 0, 2), w[i].copy(), 0.0
                if x[i][2] + w[i][2] * p.dt < 0 and w[i][2] < -1e-4:
                    a = np.array([*(max(0, 1 - fr * (1 + e) * abs(w[i][2]) / max(math.hypot(*w[i][:2]), 1e-6)) * w[i][:2]), -e * w[i][2]])
                    toi = -x[i][2] / w[i][2]
                x[i], v[i] = x[i] + w[i] * toi + a * (p.dt - toi), a
        at = after
        out.append(np.array(x))
    return out


def scene(seed=0):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.uniform(0, 0.2, (9, 3)) + [0, 0, 0.02], r.uniform(0, 0.2, (9, 3)) + [0.05, 0, 0.15]])
    mask, mass = np.repeat([1, 2], 9), r.uniform(0.5, 2, 18)
    path = {f: np.array([[0.1, 0.1, 0.35 - 0.03 * f], [0.0, 0.1, 0.3]]) for f in range(3)}
    return x, mask, mass, path


@pytest.mark.parametrize("elastic", [0.4, 3.0])
def test_three_frames_equal_the_loop(spark, elastic):
    """Springs, masses, controllers, collisions of two masks, clamps and ground."""
    x, mask, mass, path = scene()
    p = simulate.Physics(dt=2e-3, substeps=25, damping=2.0, drag=1.0, collide=0.08, elastic=elastic, friction=elastic, object_elastic=elastic, object_friction=0.2)
    src, dst, rest, y = simulate.build_springs(x, path[0], mask, simulate.Rig(0.15, 5, 0.2, 4, 80.0))
    assert (src >= 18).any() and len(simulate.close_pairs(x, 0.08)[0])
    want = loop(x, list(zip(src, dst, rest, y)), 3, p, mass, mask, path)
    assert np.abs(want[2] - loop(x, list(zip(src, dst, rest, y)), 3, simulate.replace(p, collide=0.0), mass, mask, path)[2]).max() > 1e-4
    nodes = spark.createDataFrame([(1, i, *map(float, a), float(m), int(k)) for i, (a, m, k) in enumerate(zip(x, mass, mask))], "case long, pid long, x double, y double, z double, mass double, mask long")
    springs = spark.createDataFrame([(1, int(a), int(b), float(c), math.log(d)) for a, b, c, d in zip(src, dst, rest, y)], "case long, src long, dst long, rest double, log_y double")
    control = spark.createDataFrame([(1, f, 18 + i, *map(float, a)) for f, c in path.items() for i, a in enumerate(c)], "case long, frame int, pid long, x double, y double, z double")
    got = simulate.rollout(nodes, springs, 3, p, control).toPandas().sort_values(["frame", "pid"])
    assert np.allclose(got[["x", "y", "z"]].to_numpy().reshape(3, 18, 3), want, atol=1e-9)


def test_built_springs_are_those_of_the_joins(spark):
    from pointloom.operators import joins

    x, mask, _, path = scene(3)
    src, dst, rest, _ = simulate.build_springs(x, path[0], mask, simulate.Rig(0.15, 4, 0.25, 3))
    p = spark.createDataFrame([(i, int(m), *map(float, a)) for i, (a, m) in enumerate(zip(x, mask))], "pid long, part long, x double, y double, z double")
    want = {(min(r.src, r.dst), max(r.src, r.dst), round(r.rest, 9)) for r in joins.undirected_edges(joins.hybrid_join(p, p, 0.15, 4, by=["part"])).collect()}
    c = spark.createDataFrame([(18 + i, *map(float, a)) for i, a in enumerate(path[0])], "pid long, x double, y double, z double")
    want |= {(r.b_pid, r.a_pid, round(r.dist**0.5, 9)) for r in joins.hybrid_join(c, p.drop("part"), 0.25, 3).collect()}
    assert {(int(min(a, b)), int(max(a, b)), round(float(d), 9)) for a, b, d in zip(src, dst, rest)} == want


def sweep_inputs(spark):
    x, mask, _, path = scene(5)
    p, rig = simulate.Physics(dt=2e-3, substeps=10, damping=2.0, drag=1.0), simulate.Rig(0.15, 5, 0.2, 4, 80.0)
    nodes = spark.createDataFrame([(c, i, *map(float, a), int(k)) for c in (1, 2) for i, (a, k) in enumerate(zip(x + 0.01 * c, mask))], "case long, pid long, x double, y double, z double, mask long")
    control = spark.createDataFrame([(c, f, 18 + i, *map(float, a)) for c in (1, 2) for f, q in path.items() for i, a in enumerate(q)], "case long, frame int, pid long, x double, y double, z double")
    rows = []
    for c in (1, 2):
        moved = {f: q for f, q in path.items()}
        for f, q in enumerate(simulate.frames_of(x + 0.01 * c, simulate.build_springs(x + 0.01 * c, path[0], mask, rig), 3, p, np.ones(18), mask, moved)):
            rows += [(c, f, i, *map(float, a)) for i, a in enumerate(q) if (i + f) % 3]
    return nodes, control, spark.createDataFrame(rows, "case long, frame int, pid long, x double, y double, z double"), p, rig


def test_sweep_builds_springs_and_sums_losses(spark):
    nodes, control, truth, p, rig = sweep_inputs(spark)
    cand = spark.createDataFrame([(0, 80.0, 0.15, 5.0, 1.0), (1, 20.0, 0.15, 5.0, 1.0), (2, 80.0, 0.1, 2.0, 1.0)], "candidate long, stiffness double, radius double, neighbours double, drag double")
    got = {(r.candidate, r.case): r.loss for r in simulate.sweep(nodes, truth, cand, 3, p, rig, controllers=control).collect()}
    assert len(got) == 6 and all(got[0, c] < got[1, c] and got[0, c] < got[2, c] for c in (1, 2))
    # one loss, term by term
    n = nodes.where("case = 1").orderBy("pid").toPandas()
    x, mask = n[["x", "y", "z"]].to_numpy(), n["mask"].to_numpy()
    path = {f: g[["x", "y", "z"]].to_numpy() for f, g in control.where("case = 1").orderBy("frame", "pid").toPandas().groupby("frame")}
    found = list(simulate.frames_of(x, simulate.build_springs(x, path[0], mask, simulate.replace(rig, stiffness=20.0)), 3, p, np.ones(18), mask, path))
    t, total, h = truth.where("case = 1").toPandas(), 0.0, lambda u: 0.5 * u * u if abs(u) < 1 else abs(u) - 0.5
    for f in (1, 2):
        seen = t[t["frame"] == f]
        w = seen[["x", "y", "z"]].to_numpy()
        total += np.mean([min(((a - b) ** 2).sum() for b in found[f]) for a in w])
        total += sum(h(u) for a, i in zip(w, seen["pid"]) for u in found[f][i] - a) / (3 * len(w))
    total += 0.01 * sum(h(u) for u in (found[2] - 2 * found[1] + found[0]).ravel()) / (3 * 18)
    assert abs(got[1, 1] - total / 2) < 1e-9
    with pytest.raises(ValueError):
        simulate.sweep(nodes, truth, cand.withColumn("colour", cand.drag), 3, p, rig)


def test_fits_go_through_spark(spark):
    nodes, control, truth, p, rig = sweep_inputs(spark)
    box = (("stiffness", 10.0, 150.0), ("drag", 0.0, 5.0))
    score = simulate.scorer(nodes, truth, 3, p, rig, control, box)
    start = np.array([0.1, 0.8])
    first = float(score(start[None])[0])
    x, loss = simulate.descend(score, start, steps=4, rate=0.1)
    assert loss < first and (0 <= x).all() and (x <= 1).all()
    _, loss = simulate.evolve(score, 2, generations=2, size=6)
    assert loss < first
    assert simulate.parameters(np.array([0.5] * 12))[2] == 30.0
    quick, _ = simulate.descend(lambda y: ((y - 0.3) ** 2).sum(1), np.full(3, 0.9), steps=200, rate=0.05)
    assert np.allclose(quick, 0.3, atol=0.02)


def test_rotations_of_bones_on_a_line():
    axis = np.array([1.0, 2.0, 2.0]) / 3
    rows = pd.DataFrame([np.outer(axis, axis).ravel(), np.zeros(9), np.outer([1.0, 0, 0], [1.0, 0, 0]).ravel(), np.diag([3.0, 2.0, 1e-3]).ravel()])
    r = np.array(simulate.rotations(rows).tolist()).reshape(-1, 3, 3)
    assert all(np.allclose(a @ a.T, np.eye(3)) and np.linalg.det(a) > 0.99 for a in r)
    assert np.allclose(r[1], np.eye(3)) and np.allclose(r[2], np.eye(3)) and np.allclose(r[3], np.eye(3))
    lead = r[0] @ [1.0, 0, 0]
    assert np.allclose(np.abs(lead @ axis), 1.0)


def test_rolled_splats_follow_a_rigid_motion(spark):
    r = np.random.default_rng(2)
    x, bones = r.uniform(-1, 1, (30, 3)), r.uniform(-1, 1, (40, 3))
    turn = lambda a: np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]])
    splats = spark.createDataFrame([(i, *map(float, a), 1.0, 0.0, 0.0, 0.0) for i, a in enumerate(x)], "pid long, x double, y double, z double, q0 double, q1 double, q2 double, q3 double")
    rows = [(f, i, *map(float, turn(0.2 * f) @ b + [0.1 * f, 0, 0])) for f in range(3) for i, b in enumerate(bones)]
    got = simulate.roll_splats(splats, spark.createDataFrame(rows, "frame int, pid long, x double, y double, z double"), 3, k=8).toPandas().sort_values(["frame", "pid"])
    for f in range(3):
        g = got[got["frame"] == f]
        assert np.allclose(g[["x", "y", "z"]], x @ turn(0.2 * f).T + [0.1 * f, 0, 0], atol=1e-6)
        assert np.allclose(np.abs(g[["q0", "q3"]]), np.abs([[math.cos(0.1 * f), math.sin(0.1 * f)]] * 30), atol=1e-6)
