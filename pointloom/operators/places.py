"""Nearest rows of arrays that one task holds, by halves of halves of the places and a tree of their boxes."""

from __future__ import annotations

import numpy as np

#: Places of a block, children of a node, blocks of askers that go down the tree at once, pairs of places whose distances are held at once.
BLOCK, FAN, AT_ONCE, PAIRS = 64, 8, 128, 1 << 20


def halves(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows and the ends of its blocks of at most ``size``, a power of two of them: medians along a block's widest axis, so that outliers, dense and rare places cost alike."""
    order, ends = np.arange(len(x)), np.array([0, len(x)])
    while np.diff(ends).max() > size:
        n, here = np.diff(ends), x[order]
        axis = (np.maximum.reduceat(here, ends[:-1]) / 2 - np.minimum.reduceat(here, ends[:-1]) / 2).argmax(1)
        of = np.repeat(np.arange(len(n)), n)
        order = order[np.lexsort((here[np.arange(len(here)), axis[of]], of))]
        ends = np.sort(np.concatenate([ends, ends[:-1] + n // 2]))
    return order, ends


def copies(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row the number of its place, its rank among the rows there, and of each place its first row."""
    order = np.lexsort((*x.T[::-1],))
    here = x[order]
    new = np.ones(len(x), bool)
    new[1:] = (here[1:] != here[:-1]).any(1)
    start, of = np.flatnonzero(new), np.cumsum(new) - 1
    number, rank = np.empty(len(x), int), np.empty(len(x), int)
    number[order], rank[order] = of, np.arange(len(x)) - start[of]
    return number, rank, order[start]


def gap(lo: np.ndarray, hi: np.ndarray, to_lo: np.ndarray, to_hi: np.ndarray) -> np.ndarray:
    """The least squared distance of boxes; in the same order of operations as that of two places, so that rounding keeps it the least."""
    g = np.maximum(0.0, np.maximum(lo - to_hi, to_lo - hi)) ** 2
    return g[..., 0] + g[..., 1] + g[..., 2]


def apart(lo: np.ndarray, hi: np.ndarray, to_lo: np.ndarray, to_hi: np.ndarray) -> np.ndarray:
    """The largest squared distance of places of two boxes."""
    g = np.maximum(hi - to_lo, to_hi - lo) ** 2
    return g[..., 0] + g[..., 1] + g[..., 2]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a[:, None, i] - b[None, :, i] for i in range(3))
    x, y, z = (e * e for e in d)
    return x + y + z


def nearest(a: np.ndarray, b: np.ndarray, k: int, within: float | np.ndarray = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, squared distance, rank from 0) of the ``k`` nearest rows of ``b``, no farther than ``within`` (squared), of each row of ``a``; ties to the smaller
    place in ``b``. In the order of i and rank; rows that aren't finite meet nothing. Rows at one place ask once, and of those asked only the first ``k`` count.
    Each row may have a ``within`` of its own where ``k`` is 1 and some row of ``b`` lies as near: that makes the search shorter."""
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    ask, met = np.flatnonzero(np.isfinite(a).all(1)), np.flatnonzero(np.isfinite(b).all(1))
    if k < 1 or not len(ask) or not len(met):
        return none
    with np.errstate(over="ignore"):
        number, _, first = copies(a[ask])
        met = met[copies(b[met])[1] < k]
        limit = np.full(len(first), np.inf)
        np.minimum.at(limit, number, np.broadcast_to(within, len(a))[ask])
        i, j, d, rank = _search(a[ask[first]], b[met], k, limit)
    # the answers of a place for each row there
    n = np.bincount(i, minlength=len(first))
    start = np.cumsum(n) - n
    of = np.repeat(np.arange(len(ask)), n[number])
    at = start[number][of] + np.arange(len(of)) - np.searchsorted(of, of)
    return ask[of], met[j[at]], d[at], rank[at]


def _search(a: np.ndarray, b: np.ndarray, k: int, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    order, ends = halves(b, max(BLOCK, 2 * k + 2))
    places, n = b[order], np.diff(ends)
    tree = [(np.minimum.reduceat(places, ends[:-1]), np.maximum.reduceat(places, ends[:-1]), n)]
    while len(tree[-1][0]) > FAN:
        lo, hi, n = tree[-1]
        up = np.arange(0, len(lo), FAN)
        tree.append((np.minimum.reduceat(lo, up), np.maximum.reduceat(hi, up), np.add.reduceat(n, up)))
    a_order, a_ends = halves(a, BLOCK)
    out = []
    for begin in range(0, len(a_ends) - 1, AT_ONCE):
        stop = min(begin + AT_ONCE, len(a_ends) - 1)
        of = a_order[a_ends[begin] : a_ends[stop]]
        here, limit = a[of], within[of]
        cut = a_ends[begin : stop + 1] - a_ends[begin]
        lo, hi = np.minimum.reduceat(here, cut[:-1]), np.maximum.reduceat(here, cut[:-1])
        asker, node, near = _down(lo, hi, tree, k, np.maximum.reduceat(limit, cut[:-1]))
        spans = np.searchsorted(asker, np.arange(stop - begin + 1))
        for block in range(stop - begin):
            s = slice(spans[block], spans[block + 1])
            if s.start == s.stop:
                continue
            own = slice(cut[block], cut[block + 1])
            row, col, d, rank = _meet(here[own], lo[block], hi[block], node[s], near[s], places, order, ends, k, limit[own])
            out.append((a_order[a_ends[begin + block] + row], col, d, rank))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    i, j, d, rank = (np.concatenate(c) for c in zip(*out, strict=True))
    sort = np.lexsort((rank, i))
    return i[sort], j[sort], d[sort], rank[sort]


def _down(lo: np.ndarray, hi: np.ndarray, tree: list, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(asker, block, least distance), by asker and distance: the blocks that may hold one of the ``k`` nearest, within ``bound``, of some place in the box of an asker."""
    asker = np.repeat(np.arange(len(lo)), len(tree[-1][0]))
    node = np.tile(np.arange(len(tree[-1][0])), len(lo))
    for depth in range(len(tree) - 1, -1, -1):
        to_lo, to_hi, n = tree[depth]
        near = gap(lo[asker], hi[asker], to_lo[node], to_hi[node])
        enough = n[node] >= k
        np.minimum.at(bound, asker[enough], apart(lo[asker[enough]], hi[asker[enough]], to_lo[node[enough]], to_hi[node[enough]]))
        keep = near <= bound[asker]
        asker, node, near = asker[keep], node[keep], near[keep]
        if depth:
            below = len(tree[depth - 1][0])
            child = node[:, None] * FAN + np.arange(FAN)
            asker, node = np.repeat(asker, FAN)[(child < below).ravel()], child[child < below]
    sort = np.lexsort((near, asker))
    return asker[sort], node[sort], near[sort]


def _rows(ends: np.ndarray, node: np.ndarray) -> np.ndarray:
    n = ends[node + 1] - ends[node]
    return np.repeat(ends[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())


def _meet(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, node: np.ndarray, near: np.ndarray, places: np.ndarray, order: np.ndarray, ends: np.ndarray, k: int, within: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of x, row asked, squared distance, rank) of one block of askers; its nearest blocks bound what it meets of the others."""
    first = squares(x, places[_rows(ends, node[:2])])
    best = within
    if first.shape[1] >= k:
        best = np.minimum(best, first.min(1) if k == 1 else np.partition(first, k - 1, 1)[:, k - 1])
    best = best.max()
    at = _rows(ends, node[near <= best])
    at = at[gap(lo, hi, places[at], places[at]) <= best]
    at = at[np.argsort(order[at])]
    step, found = max(1, PAIRS // len(x)), None
    for begin in range(0, len(at), step):
        some = at[begin : begin + step]
        d = squares(x, places[some])
        limit = np.minimum(within, np.partition(d, k - 1, 1)[:, k - 1]) if len(some) > k else within
        row, col = np.nonzero((d <= limit[:, None]) & np.isfinite(d))
        new = row, order[some[col]], d[row, col]
        row, j, d = new if found is None else (np.concatenate(c) for c in zip(found, new, strict=True))
        sort = np.lexsort((j, d, row))
        row, j, d = row[sort], j[sort], d[sort]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank < k
        found, rank = (row[keep], j[keep], d[keep]), rank[keep]
    if found is None:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)
    return (*found, rank)
