"""Spring-mass simulation, parameter sweeps, skinning and other kernels over groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import places

XYZ = ["x", "y", "z"]


@dataclass(frozen=True)
class Physics:
    """Parameters of a simulation; times in seconds. ``collide``: the distance below which points of different masks push each other, 0: never."""

    dt: float = 5e-5
    substeps: int = 667
    damping: float = 100.0
    drag: float = 3.0
    stiff_min: float = 0.0
    stiff_max: float = 1e5
    elastic: float = 0.7
    friction: float = 0.3
    sign: float = 1.0
    gravity: float = -9.8
    collide: float = 0.0
    object_elastic: float = 0.7
    object_friction: float = 0.3


@dataclass(frozen=True)
class Rig:
    """What a candidate builds springs from: radius and most neighbours (itself counted) of points and of controllers, and a stiffness."""

    radius: float = 0.02
    neighbours: int = 30
    controller_radius: float = 0.04
    controller_neighbours: int = 50
    stiffness: float = 3e3


#: The box that a fit maps from [0, 1], fixed values: name, least, most.
BOX = (
    ("stiffness", 1e3, 1e5), ("radius", 0.01, 0.05), ("neighbours", 10, 50), ("controller_radius", 0.01, 0.08), ("controller_neighbours", 10, 80), ("elastic", 0.0, 1.0),
    ("friction", 0.0, 2.0), ("object_elastic", 0.0, 1.0), ("object_friction", 0.0, 2.0), ("collide", 0.01, 0.05), ("drag", 0.0, 20.0), ("damping", 0.0, 200.0),
)


def spring_forces(x: np.ndarray, v: np.ndarray, src: np.ndarray, dst: np.ndarray, rest: np.ndarray, y: np.ndarray, p: Physics) -> np.ndarray:
    d = x[dst] - x[src]
    n = np.linalg.norm(d, axis=1)
    u = d / np.maximum(n, 1e-6)[:, None]
    size = np.clip(y, p.stiff_min, p.stiff_max) * (n / rest - 1) + p.damping * ((v[dst] - v[src]) * u).sum(1)
    f = np.where((y > p.stiff_min)[:, None], size[:, None] * u, 0)
    ends = np.concatenate([src, dst])
    return np.stack([np.bincount(ends, np.concatenate([g, -g]), len(x)) for g in f.T], 1)


def ground(x: np.ndarray, v: np.ndarray, p: Physics) -> tuple[np.ndarray, np.ndarray]:
    hit = ((x[:, 2] + v[:, 2] * p.dt) * p.sign < 0) & (v[:, 2] * p.sign < -1e-4)
    e, f = min(1.0, max(0.0, p.elastic)), min(2.0, max(0.0, p.friction))
    a = np.maximum(0, 1 - f * (1 + e) * np.abs(v[:, 2]) / np.maximum(np.hypot(v[:, 0], v[:, 1]), 1e-6))
    w = v.copy()
    w[hit, :2] *= a[hit, None]
    w[hit, 2] *= -e
    toi = np.where(hit, -x[:, 2] / np.where(hit, v[:, 2], 1), 0)[:, None]
    return x + v * toi + w * (p.dt - toi), w


def close_pairs(x: np.ndarray, r: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, k) of different points nearer than ``r``, both ways, by cells of side r."""
    cell = np.floor(x / r).astype(np.int64)
    cell -= cell.min(0) - 1 if len(cell) else 0
    span = cell.max(0) + 2 if len(cell) else np.ones(3, np.int64)
    key = (cell[:, 0] * span[1] + cell[:, 1]) * span[2] + cell[:, 2]
    order = np.argsort(key, kind="stable")
    ranked, out = key[order], []
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            want = key + (dx * span[1] + dy) * span[2]
            lo, hi = np.searchsorted(ranked, want - 1), np.searchsorted(ranked, want + 1, "right")  # three cells in a row
            n = hi - lo
            i = np.repeat(np.arange(len(x)), n)
            k = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            near = (i != k) & (((x[i] - x[k]) ** 2).sum(1) < r * r)
            out.append((i[near], k[near]))
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def collided(x: np.ndarray, v: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], mass: np.ndarray, p: Physics) -> np.ndarray:
    """Velocities after the mean impulse of the candidates ``pairs`` that are near and approach each other."""
    i, k = pairs
    d, w = x[k] - x[i], v[k] - v[i]
    n = np.linalg.norm(d, axis=1)
    on = (n < p.collide) & ((d * w).sum(1) < -1e-4)
    i, k, d, w, n = i[on], k[on], d[on], w[on], n[on]
    if not len(i):
        return v
    e, f = min(1.0, max(0.0, p.object_elastic)), min(2.0, max(0.0, p.object_friction))
    u = d / np.maximum(n, 1e-6)[:, None]
    vn = (w * u).sum(1)[:, None] * u
    vt = w - vn
    a = np.maximum(0, 1 - f * (1 + e) * np.linalg.norm(vn, axis=1) / np.maximum(np.linalg.norm(vt, axis=1), 1e-6))[:, None]
    j = (-(1 + e) * vn + (a - 1) * vt) / (1 / mass[i] + 1 / mass[k])[:, None]
    total, hits = np.zeros_like(v), np.bincount(i, minlength=len(v))
    np.add.at(total, i, j)
    return v - total / np.maximum(hits, 1)[:, None] / mass[:, None]


def simulate_frame(x: np.ndarray, v: np.ndarray, springs: tuple[np.ndarray, ...], p: Physics, start: np.ndarray | None = None, end: np.ndarray | None = None, free: int | None = None, mass: np.ndarray | None = None, mask: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """One frame of substeps: springs, velocity, collision, ground. Nodes from ``free`` on are controlled: they move from ``start`` to ``end`` and
    have no velocity of their own. Points of different ``mask`` collide; their candidates are those near each other as the frame starts."""
    free = len(x) if free is None else free
    x, v = x.copy(), v.copy()
    mass = np.ones(free) if mass is None else mass
    pairs = None
    if p.collide > 0 and mask is not None and len(np.unique(mask)) > 1:
        i, k = close_pairs(x[:free], p.collide)
        pairs = i[mask[i] != mask[k]], k[mask[i] != mask[k]]
    for step in range(p.substeps):
        if start is not None and end is not None:
            t = (step + 1) / p.substeps
            x[free:] = start + t * (end - start)
        force = spring_forces(x, v, *springs, p)[:free]
        u = (v[:free] + (force / mass[:, None] + np.array([0, 0, p.gravity * p.sign])) * p.dt) * np.exp(-p.dt * p.drag)
        if pairs is not None:
            u = collided(x[:free], u, pairs, mass, p)
        x[:free], v[:free] = ground(x[:free], u, p)
    return x, v


def nearest_within(a: np.ndarray, b: np.ndarray, r: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, distance) of the ``k`` nearest rows of ``b`` within ``r`` of each row of ``a``; ties to the smaller place."""
    i, j, d, _ = places.nearest(a, b, k, r * r)
    return i, j, np.sqrt(d)


def listings(x: np.ndarray, controllers: np.ndarray, mask: np.ndarray | None, rigs: Sequence[Rig]) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """(i, j, squared distance, rank) of points within a mask, and of controllers and points, as far and as many as any of the ``rigs`` asks for."""
    groups = [np.arange(len(x))] if mask is None else [np.flatnonzero(mask == m) for m in np.unique(mask)]
    most = lambda values: max((v for v in values if v == v), default=0)
    k, r = int(most(rig.neighbours for rig in rigs)), most(rig.radius * rig.radius for rig in rigs)
    own = [(g[i], g[j], d, rank) for g in groups for i, j, d, rank in [places.nearest(x[g], x[g], k, r)]]
    k, r = int(most(rig.controller_neighbours for rig in rigs)), most(rig.controller_radius * rig.controller_radius for rig in rigs)
    return tuple(np.concatenate(c) for c in zip(*own, strict=True)), places.nearest(controllers, x, k, r)


def build_springs(x: np.ndarray, controllers: np.ndarray, mask: np.ndarray | None, rig: Rig, shortest: float = 1e-4, near: tuple | None = None) -> tuple[np.ndarray, ...]:
    """(src, dst, rest, y): each unordered pair of neighbours within a mask once, and controllers (numbered after the points) with theirs. ``near``: listings that
    hold those of ``rig``."""
    own, held = near or listings(x, controllers, mask, [rig])

    def within(listing: tuple, r: float, k: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j, d, rank = listing
        on = (d <= r * r) & (rank < int(k)) & (np.sqrt(d) > shortest)
        return i[on], j[on], np.sqrt(d[on])

    i, j, rest = within(own, rig.radius, rig.neighbours)
    apart = i != j
    i, j, rest = i[apart], j[apart], rest[apart]
    src, dst = np.minimum(i, j), np.maximum(i, j)
    first = np.sort(np.unique(src * len(x) + dst, return_index=True)[1])
    i, j, far = within(held, rig.controller_radius, rig.controller_neighbours)
    src, dst, rest = np.concatenate([src[first], len(x) + i]), np.concatenate([dst[first], j]), np.concatenate([rest[first], far])
    return src, dst, rest, np.full(len(rest), float(rig.stiffness))


def _states(n: pd.DataFrame):
    """(points, masses, masks, controllers by frame) of a case's rows; rows with a ``frame`` are controllers."""
    points = n[n["frame"].isna()].sort_values("pid").reset_index(drop=True)
    control = n[n["frame"].notna()].sort_values(["frame", "pid"])
    path = {int(f): g[XYZ].to_numpy(float) for f, g in control.groupby("frame")}
    ids = control[control["frame"] == control["frame"].min()]["pid"].tolist() if len(control) else []
    return points, points["mass"].fillna(1.0).to_numpy(float), points["mask"].fillna(0).to_numpy(int), path, ids


def frames_of(x: np.ndarray, springs: tuple[np.ndarray, ...], frames: int, p: Physics, mass: np.ndarray, mask: np.ndarray, path: dict[int, np.ndarray]):
    """Positions of the points in each frame; controllers follow ``path`` and stay where it ends."""
    free, v = len(x), np.zeros((len(x), 3))
    at = path.get(0, next(iter(path.values()), np.zeros((0, 3))))
    full, vel = np.concatenate([x, at]), np.concatenate([v, np.zeros_like(at)])
    yield x
    for f in range(1, frames):
        after = path.get(f, at)
        full, vel = simulate_frame(full, vel, springs, p, at, after, free, mass, mask)
        at = after
        yield full[:free]


_ROWS = "case long, frame int, pid long, x double, y double, z double, mass double, mask long"


def with_controllers(nodes: DataFrame, controllers: DataFrame | None) -> DataFrame:
    """Points (frame null) and controllers (case, frame, pid, xyz) in one table; a point without ``mass`` has 1, without ``mask`` 0."""
    has = lambda c, kind, d: (F.col(c).cast(kind) if c in nodes.columns else F.lit(d).cast(kind)).alias(c)
    out = nodes.select(F.col("case").cast("long").alias("case"), F.lit(None).cast("int").alias("frame"), F.col("pid").cast("long").alias("pid"), *XYZ, has("mass", "double", 1.0), has("mask", "long", 0))
    if controllers is None:
        return out
    c = controllers.select(F.col("case").cast("long").alias("case"), F.col("frame").cast("int").alias("frame"), F.col("pid").cast("long").alias("pid"), *XYZ, F.lit(None).cast("double").alias("mass"), F.lit(None).cast("long").alias("mask"))
    return out.unionByName(c)


def rollout(nodes: DataFrame, springs: DataFrame, frames: int, physics: Physics, controllers: DataFrame | None = None) -> DataFrame:
    """(case, frame, pid, x, y, z) for ``frames`` frames of each case, one task a case; nodes (case, pid, xyz, and mass and mask if there), springs
    (case, src, dst, rest, log_y) between nodes or with controllers (case, frame, pid, xyz), whose ids are none of the nodes'."""

    def run(n: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        points, mass, mask, path, ids = _states(n)
        out = [pd.DataFrame({"case": [], "frame": [], "pid": [], "x": [], "y": [], "z": []})]
        if len(points):
            at = {p: i for i, p in enumerate([*points["pid"], *ids])}
            ends = (s["src"].map(at).to_numpy(int), s["dst"].map(at).to_numpy(int), s["rest"].to_numpy(float), np.exp(s["log_y"].to_numpy(float))) if len(s) else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
            for f, x in enumerate(frames_of(points[XYZ].to_numpy(float), ends, frames, physics, mass, mask, path)):
                out.append(pd.DataFrame({"case": points["case"], "frame": f, "pid": points["pid"], "x": x[:, 0], "y": x[:, 1], "z": x[:, 2]}))
        return pd.concat(out[1:] or out).astype({"case": "int64", "frame": "int32", "pid": "int64"})

    return with_controllers(nodes, controllers).groupBy("case").cogroup(springs.groupBy("case")).applyInPandas(run, "case long, frame int, pid long, x double, y double, z double")


def smooth(u: np.ndarray) -> np.ndarray:
    return np.where(np.abs(u) < 1, 0.5 * u * u, np.abs(u) - 0.5)


def nearest_squares(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The squared distance of each row of ``a`` to the nearest of ``b``, no farther than its row ``at``; NaN where a difference to some row of ``b`` is."""
    out = np.full(len(a), np.inf)
    with np.errstate(over="ignore", invalid="ignore"):
        x, y, z = ((a - b[at]) ** 2).T
        limit = x + y + z
    i, _, d, _ = places.nearest(a, b, 1, np.where(np.isnan(limit), np.inf, limit))
    out[i] = d
    out[np.isnan(a).any(1) | np.isnan(b).any() | (np.isinf(a) & ((a > 0) & (b == np.inf).any(0) | (a < 0) & (b == -np.inf).any(0))).any(1)] = np.nan
    return out


def frame_losses(found: list[np.ndarray], truth: dict[int, tuple[np.ndarray, np.ndarray]], weights=(1.0, 1.0, 0.01)) -> float:
    """The mean over the frames after the first of chamfer, track and acceleration losses; truth: (places, positions) of the points seen in a frame."""
    total = 0.0
    for f in range(1, len(found)):
        at, want = truth.get(f, (np.zeros(0, int), np.zeros((0, 3))))
        if len(at):
            total += weights[0] * nearest_squares(want, found[f], at).mean() + weights[1] * smooth(found[f][at] - want).sum() / (3 * len(at))
        if f > 1:
            total += weights[2] * smooth(found[f] - 2 * found[f - 1] + found[f - 2]).sum() / (3 * len(found[f]))
    return total / max(1, len(found) - 1)


def sweep(nodes: DataFrame, truth: DataFrame, candidates: DataFrame, frames: int, base: Physics, rig: Rig | None = None, springs: DataFrame | None = None, controllers: DataFrame | None = None) -> DataFrame:
    """(candidate, case, loss) of each candidate in each case; truth (case, frame, pid, xyz) holds what was seen.

    ``candidates``: a few rows of the driver, ``candidate`` and any fields of ``Physics`` and ``Rig``. A case is sent once for each deal of candidates, of which
    there are so many that all cores have tasks. Springs are built anew by each candidate's ``Rig``, from one listing of neighbours; where ``springs`` are
    given and ``rig`` isn't, all candidates share these. Loss: see ``frame_losses``.
    """
    own = [c for c in candidates.columns if c != "candidate"]
    physics_of, rig_of = [c for c in own if c in Physics.__dataclass_fields__], [c for c in own if c in Rig.__dataclass_fields__]
    if set(own) - {*physics_of, *rig_of}:
        raise ValueError(f"no parameters: {sorted(set(own) - {*physics_of, *rig_of})}")
    value = lambda v: np.nan if v is None else float(v)
    asked = [(int(r["candidate"]), replace(base, **{c: value(r[c]) for c in physics_of}), replace(rig or Rig(), **{c: value(r[c]) for c in rig_of})) for r in candidates.collect()]
    if not asked:
        return candidates.sparkSession.createDataFrame([], "candidate long, case long, loss double")
    cases, cores = max(1, nodes.select("case").distinct().count()), nodes.sparkSession.sparkContext.defaultParallelism
    deals = min(len(asked), -(-cores // cases))
    empty = lambda c, kind: F.lit(None).cast(kind).alias(c)
    t = truth.where(F.col("frame").between(1, frames - 1))  # the frames that a loss looks at
    t = t.select(F.col("case").cast("long").alias("case"), F.col("frame").cast("int").alias("frame"), F.col("pid").cast("long").alias("pid"), *XYZ, empty("mass", "double"), empty("mask", "long"), F.lit("truth").alias("kind"))
    rows = with_controllers(nodes, controllers).withColumn("kind", F.lit("node")).unionByName(t)
    if springs is not None and rig is None:
        rows = rows.unionByName(springs.select(F.col("case").cast("long").alias("case"), empty("frame", "int"), F.col("src").cast("long").alias("pid"), F.col("rest").alias("x"), F.col("log_y").alias("y"), F.lit(0.0).alias("z"), empty("mass", "double"), F.col("dst").cast("long").alias("mask"), F.lit("spring").alias("kind")))
    dealt = rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        hand = asked[int(key[0]) :: deals]
        points, mass, mask, path, ids = _states(pdf[pdf["kind"] == "node"])
        if not len(points):
            return pd.DataFrame({"candidate": [], "case": [], "loss": []}).astype({"candidate": "int64", "case": "int64"})
        x, at = points[XYZ].to_numpy(float), {q: i for i, q in enumerate([*points["pid"], *ids])}
        s = pdf[pdf["kind"] == "spring"]
        if len(s):
            ends = s["pid"].map(at).to_numpy(int), s["mask"].map(at).to_numpy(int), s["x"].to_numpy(float), np.exp(s["y"].to_numpy(float))
        else:
            held = path.get(0, np.zeros((0, 3)))
            near = listings(x, held, mask, [r for _, _, r in hand])
        seen = pdf[(pdf["kind"] == "truth") & pdf["pid"].isin(list(at))]
        want = {int(f): (g["pid"].map(at).to_numpy(int), g[XYZ].to_numpy(float)) for f, g in seen.groupby("frame")}
        loss = [frame_losses(list(frames_of(x, ends if len(s) else build_springs(x, held, mask, r, near=near), frames, p, mass, mask, path)), want) for _, p, r in hand]
        return pd.DataFrame({"candidate": [n for n, _, _ in hand], "case": int(key[1]), "loss": loss})

    # in many parts, as a few keys would meet in few
    return dealt.repartition(min(8 * cases * deals, 4096), "deal", "case").groupBy("deal", "case").applyInPandas(run, "candidate long, case long, loss double")


def parameters(unit: np.ndarray, box=BOX) -> list[float]:
    """Values of the box at a point of [0, 1]^n; numbers of neighbours are whole."""
    return [float(int(lo + u * (hi - lo))) if "neighbours" in name else float(lo + u * (hi - lo)) for u, (name, lo, hi) in zip(unit, box, strict=True)]


def scorer(nodes: DataFrame, truth: DataFrame, frames: int, base: Physics, rig: Rig, controllers: DataFrame | None = None, box=BOX):
    """A function from points of [0, 1]^n to losses, the mean over cases: one Spark job for all points of a generation."""
    spark = nodes.sparkSession

    def score(x: np.ndarray) -> np.ndarray:
        cand = spark.createDataFrame([(i, *parameters(u, box)) for i, u in enumerate(x)], "candidate long, " + ", ".join(f"{n} double" for n, _, _ in box))
        got = {r.candidate: r.loss for r in sweep(nodes, truth, cand, frames, base, rig, controllers=controllers).groupBy("candidate").agg(F.avg("loss").alias("loss")).collect()}
        return np.array([got.get(i, np.inf) for i in range(len(x))])

    return score


def descend(score, start: np.ndarray, steps: int = 20, rate: float = 0.02, width: float = 1e-3) -> tuple[np.ndarray, float]:
    """First-order fit in [0, 1]^n: Adam (0.9, 0.99) on central differences; the 2 n points of a step, and the place itself, are one generation."""
    x, m, v, best, loss = np.asarray(start, float).copy(), 0.0, 0.0, np.asarray(start, float).copy(), np.inf
    for t in range(1, steps + 1):
        around = np.concatenate([[x], *[[np.clip(x + w * e, 0, 1) for w in (width, -width)] for e in np.eye(len(x))]])
        got = np.asarray(score(around), float)
        if got[0] < loss:
            best, loss = x.copy(), float(got[0])
        span = np.array([np.abs(around[1 + 2 * i] - around[2 + 2 * i]).max() for i in range(len(x))])
        g = (got[1::2] - got[2::2]) / np.maximum(span, 1e-12)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x = np.clip(x - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-12), 0, 1)
    last = float(np.asarray(score(x[None]), float)[0])
    return (x, last) if last < loss else (best, loss)


def evolve(score, dims: int, generations: int = 20, size: int = 12, sigma: float = 1 / 6, seed: int = 42) -> tuple[np.ndarray, float]:
    """Covariance-adapting evolution in [0, 1]^dims. ``score`` maps a (size, dims) array to losses and may run a Spark job for a generation."""
    rng = np.random.default_rng(seed)
    mean, cov = np.full(dims, 0.5), np.eye(dims)
    weights = np.log(size / 2 + 0.5) - np.log(np.arange(1, size // 2 + 1))
    weights /= weights.sum()
    best, loss = mean.copy(), np.inf
    for _ in range(generations):
        x = np.clip(rng.multivariate_normal(mean, sigma**2 * cov, size), 0, 1)
        got = np.asarray(score(x), float)
        order = np.argsort(got, kind="stable")
        if got[order[0]] < loss:
            best, loss = x[order[0]].copy(), float(got[order[0]])
        top = x[order[: size // 2]]
        step = (top - mean) / sigma
        mean = weights @ top
        cov = 0.8 * cov + 0.2 * (step.T * weights) @ step + 1e-8 * np.eye(dims)
        sigma *= 0.95
    return best, loss


def bone_rotations(rest: DataFrame, moved: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(pid, r): each bone's rotation, 9 numbers, by SVD of the sum over its neighbours of (new offset) x (old offset); the sums are a
    join and an aggregation, and only the 3 x 3 factorisation runs in NumPy. Bones are judged each on its own: where all offsets lie on one
    line, the x axis is turned onto it about their common normal; without any the rotation is the identity."""
    o, m = rest.select(F.col("pid"), *[F.col(c).alias("o" + c) for c in XYZ]), moved.select(F.col("pid"), *[F.col(c).alias("m" + c) for c in XYZ])
    both = o.join(m, "pid")
    e = neighbours.select(F.col("a_pid").alias("a"), F.col("b_pid").alias("b"))
    e = e.join(both.select(F.col("pid").alias("a"), *[F.col(p + c).alias("a" + p + c) for p in "om" for c in XYZ]), "a").join(both.select(F.col("pid").alias("b"), *[F.col(p + c).alias("b" + p + c) for p in "om" for c in XYZ]), "b")
    sums = [F.sum((F.col("bm" + i) - F.col("am" + i)) * (F.col("bo" + j) - F.col("ao" + j))).alias(f"s{i}{j}") for i in XYZ for j in XYZ]
    cov = e.groupBy(F.col("a").alias("pid")).agg(*sums)

    return cov.select("pid", F.pandas_udf(rotations, "array<double>")(F.struct(*[f"s{i}{j}" for i in XYZ for j in XYZ])).alias("r"))


def rotations(s: pd.DataFrame) -> pd.Series:
    """The rotation nearest to each row's 3 x 3 sum."""
    f = s.to_numpy(float).reshape(-1, 3, 3)
    u, size, vt = np.linalg.svd(f)
    flip = np.ones((len(f), 3))
    flip[:, 2] = np.where(np.linalg.det(u @ vt) < 0, -1, 1)
    r = u * flip[:, None, :] @ vt
    rank = (size > np.maximum(size[:, :1], 1e-300) * 1e-9).sum(1)
    for i in np.flatnonzero(rank < 2):
        axis, x = u[i, :, 0], np.array([1.0, 0.0, 0.0])
        common = np.cross(axis, x)
        r[i] = np.eye(3)
        if rank[i] == 1 and np.linalg.norm(common) >= 1e-6:
            common /= np.linalg.norm(common)
            r[i] = np.stack([axis, common, np.cross(axis, common)], 1) @ np.stack([x, common, np.cross(x, common)], 1).T
    return pd.Series(list(r.reshape(-1, 9)))


def skin(points: DataFrame, weights: DataFrame, bones: DataFrame, rotations: DataFrame) -> DataFrame:
    """(pid, x, y, z): points moved by the weighted mean of their bones' motions; weights (a_pid, b_pid, weight), bones (pid, xyz, dx, dy, dz)."""
    b = bones.join(rotations, "pid").select(F.col("pid").alias("b_pid"), *[F.col(c).alias("b" + c) for c in XYZ], *["d" + c for c in XYZ], "r")
    e = weights.select("a_pid", "b_pid", "weight").join(b, "b_pid").join(points.select(F.col("pid").alias("a_pid"), *XYZ), "a_pid")
    d = [F.col(c) - F.col("b" + c) for c in XYZ]
    new = [F.col("weight") * (sum((F.col("r")[3 * i + j] * d[j] for j in range(3)), F.lit(0.0)) + F.col("b" + c) + F.col("d" + c)) for i, c in enumerate(XYZ)]
    return e.groupBy(F.col("a_pid").alias("pid")).agg(*[F.sum(x).alias(c) for x, c in zip(new, XYZ, strict=True)])


def turned(quaternions: DataFrame, weights: DataFrame, rotations: DataFrame) -> DataFrame:
    """(pid, q0..q3): quaternions (pid, q0..q3) turned by the normalised weighted mean of their bones' rotations, composed on the left."""
    from ..functions import geometry as G

    q = G.matrix_quaternion([F.col("r")[i] for i in range(9)])
    b = rotations.select(F.col("pid").alias("b_pid"), *[x.alias(f"b{i}") for i, x in enumerate(q)])
    mean = weights.join(b, "b_pid").groupBy(F.col("a_pid").alias("pid")).agg(*[F.sum(F.col("weight") * F.col(f"b{i}")).alias(f"b{i}") for i in range(4)])
    n = G.norm([F.col(f"b{i}") for i in range(4)])
    new = G.quaternion_product([F.col(f"b{i}") / n for i in range(4)], [F.col(f"q{i}") for i in range(4)])
    return quaternions.join(mean, "pid").select("pid", *[x.alias(f"q{i}") for i, x in enumerate(new)])


def roll_splats(splats: DataFrame, bones: DataFrame, frames: int, k: int = 16) -> DataFrame:
    """(frame, pid, xyz, q0..q3) of splats (pid, xyz, q0..q3) that follow bones (frame, pid, xyz).

    A bone's neighbours are those of frame 0; a splat's bones are looked up anew in each frame. Each frame is written to the shared folder,
    so that lineage doesn't grow with frames.
    """
    from .. import scratch
    from . import joins, measures

    columns = ["pid", *XYZ, *[f"q{i}" for i in range(4)]]
    now = scratch.store(splats.select(*columns), "splats")
    first = bones.where("frame = 0").select("pid", *XYZ)
    near = scratch.store(joins.knn_join(first, first, k).select("a_pid", "b_pid"), "relations")
    out = now.select(F.lit(0).alias("frame"), *columns)
    for f in range(1, frames):
        before, after = (bones.where(F.col("frame") == i).select("pid", *XYZ) for i in (f - 1, f))
        r = scratch.store(bone_rotations(before, after, near), "rotations")
        shift = before.join(after.select("pid", *[F.col(c).alias("m" + c) for c in XYZ]), "pid").select("pid", *XYZ, *[(F.col("m" + c) - F.col(c)).alias("d" + c) for c in XYZ])
        w = scratch.store(measures.idw_weights(joins.knn_join(now.select("pid", *XYZ), before, k)).select("a_pid", "b_pid", "weight"), "weights")
        moved = skin(now.select("pid", *XYZ), w, shift, r).join(turned(now.select("pid", *columns[4:]), w, r), "pid")
        now = scratch.store(moved.select(*columns), "splats")
        out = out.unionByName(now.select(F.lit(f).alias("frame"), *columns))
    return out


def sinkhorn(scores: DataFrame, group: str, bin_score: float = 1.0, iterations: int = 20) -> DataFrame:
    """(group, i, j, p): log-space Sinkhorn normalisation of score matrices with a dustbin row and column (i or j = -1)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = np.unique(pdf["i"]), np.unique(pdf["j"])
        z = np.full((len(i) + 1, len(j) + 1), bin_score)
        z[np.searchsorted(i, pdf["i"]), np.searchsorted(j, pdf["j"])] = pdf["score"]
        m, n = len(i), len(j)
        norm = -np.log(m + n)
        mu, nu = np.append(np.full(m, norm), np.log(n) + norm), np.append(np.full(n, norm), np.log(m) + norm)
        u, v = np.zeros(m + 1), np.zeros(n + 1)

        def lse(x: np.ndarray, axis: int) -> np.ndarray:
            top = x.max(axis, keepdims=True)
            return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

        for _ in range(iterations):
            u = mu - lse(z + v[None], 1)
            v = nu - lse(z + u[:, None], 0)
        p = np.exp(z + u[:, None] + v[None] - norm)
        gi, gj = np.meshgrid(np.append(i, -1), np.append(j, -1), indexing="ij")
        return pd.DataFrame({group: pdf[group].iloc[0], "i": gi.ravel(), "j": gj.ravel(), "p": p.ravel()})

    return scores.groupBy(group).applyInPandas(run, f"{group} {dict(scores.dtypes)[group]}, i long, j long, p double")


def two_parts(points: DataFrame, group: str, restarts: int = 10, seed: int = 0) -> DataFrame:
    """(group, pid, part): K-means into two parts, the best of several starts; part 0 has the smaller centre in x."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid")
        x, rng, best = pdf[XYZ].to_numpy(float), np.random.default_rng(seed), None
        for _ in range(restarts):
            c = x[rng.choice(len(x), min(2, len(x)), replace=False)]
            for _ in range(100):
                label = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
                new = np.array([x[label == k].mean(0) if (label == k).any() else c[k] for k in range(len(c))])
                if np.allclose(new, c):
                    break
                c = new
            loss = ((x - c[label]) ** 2).sum()
            if best is None or loss < best[0]:
                best = loss, label, c
        part = best[1] if len(best[2]) < 2 or best[2][0, 0] <= best[2][1, 0] else 1 - best[1]
        return pd.DataFrame({group: pdf[group], "pid": pdf["pid"], "part": part.astype("int32")})

    return points.select(group, "pid", *XYZ).groupBy(group).applyInPandas(run, f"{group} {dict(points.dtypes)[group]}, pid long, part int")
