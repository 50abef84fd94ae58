"""The sequential motion filter in rounds, against the scan."""

import numpy as np
import pandas as pd
import pytest

from pointloom.operators import filters, votes

SCHEMA = "frame int, pid long, x double, y double, z double, visible boolean"


def tracks(n, frames, seed, order):
    rng = np.random.default_rng(seed)
    p = rng.uniform(0, 1, (n, 3))
    if order:  # ids along a line, so that each waits for the one before
        p = p[np.argsort(p[:, 0])]
    rows = []
    for f in range(frames):
        rows += [(f, i, *map(float, x), bool(rng.random() < 0.9)) for i, x in enumerate(p)]
        p = p + np.where(rng.random((n, 1)) < 0.6, 0.05, rng.normal(0, 0.2, (n, 3)))
    return rows


def scan(rows, r, least):
    f = pd.DataFrame(rows, columns=["frame", "pid", "x", "y", "z", "visible"]).sort_values(["pid", "frame"])
    g = f.groupby("pid")
    for c in "xyz":
        f["d" + c] = (g[c].shift(-1) - f[c]).fillna(0.0)
    f["ok"] = f["visible"] & g["visible"].shift(-1).fillna(False).astype(bool)
    out = set()
    for frame, h in f.sort_values(["frame", "pid"]).groupby("frame"):
        p, d, ok, ids = h[["x", "y", "z"]].to_numpy(), h[["dx", "dy", "dz"]].to_numpy(), h["ok"].to_numpy().copy(), h["pid"].to_numpy()
        for i in np.flatnonzero(ok):
            near = ok & (((p - p[i]) ** 2).sum(1) <= r * r)
            if near.sum() < least or 2 * (np.sqrt(((d[near] - d[i]) ** 2).sum(1)) < r / 2).sum() < near.sum():
                ok[i] = False
        out |= {(int(frame), int(i), bool(k)) for i, k in zip(ids, ok, strict=True)}
    return out


@pytest.mark.parametrize("order", [False, True])
def test_rounds_equal_the_scan(spark, order):
    rows = tracks(90, 4, 3, order)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in filters.motion_filter_sequential(df, 0.3, 4).select("frame", "pid", "consistent").collect()}
    want = scan(rows, 0.3, 4)
    assert got == want and {k for *_, k in want} == {True, False}
    moves = filters.forward_motion(df).where("motion_valid").select("frame", "pid", "x", "y", "z", "dx", "dy", "dz")
    settled, rounds = filters.settled_in_rounds(moves, 0.3, 4)
    assert settled.count() == moves.count() and 1 < rounds < 40
    assert filters.motion_filter_sequential(df.limit(0), 0.3).count() == 0


@pytest.mark.parametrize("least", [4, 60])
def test_dense_points_hold_by_counts_of_blocks(spark, least):
    """A dense cloud of which nearly all move alike, and points around it: what is sure to hold does, no pairs are made of it, and the rest is settled as by the scan."""
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.normal(0, 0.1, (900, 3)), rng.uniform(-1, 1, (80, 3))])[rng.permutation(980)]
    moved = p + np.where(rng.random((980, 1)) < 0.9, rng.normal(0.05, 0.01, (980, 3)), rng.normal(0, 0.4, (980, 3)))
    rows = [(f, i, *map(float, x), bool((7 * i + f) % 40)) for f, q in enumerate((p, moved)) for i, x in enumerate(q)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = scan(rows, 0.3, least)
    moves = filters.forward_motion(df).where("motion_valid").select("frame", "pid", "x", "y", "z", "dx", "dy", "dz")
    sure = {(r.frame, r.pid) for r in votes.sure(moves, 0.3, least).collect()}
    assert sure <= {(f, i) for f, i, k in want if k} and len(sure) > 500
    assert {tuple(r) for r in filters.motion_filter_sequential(df, 0.3, least).select("frame", "pid", "consistent").collect()} == want
