"""Delaunay triangles around single points, from the points near them: whole batches of points turn together in numpy."""

from __future__ import annotations

import numpy as np

#: Neighbours that a star is first sought among, and how many more each further attempt takes.
NEAR, MORE = 32, 4
#: Points whose stars are sought at once.
CHUNK = 256
#: Directions within this angle are one line; heights within this share of a circle are on it.
LINE, ON = 1e-10, 1e-9


def turn(v: np.ndarray, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triangles (row, q, r, centre x, centre y, radius), open): around the origin of each row, counter-clockwise from its nearest neighbour.

    v: (rows, k, 2) neighbours, nearest first; inf where there are none. The triangle on the left of an edge has the lowest centre.
    Points on one circle are a fan around the smallest id, so every point sees the same triangles.
    """
    size = np.hypot(v[:, :, 0], v[:, :, 1])
    rows, q, swept = np.arange(len(v)), np.zeros(len(v), int), np.zeros(len(v))
    found, stuck = [], np.zeros(len(v), bool)
    while len(rows):
        w, length = v[rows, q], size[rows, q]
        with np.errstate(all="ignore"):
            along = (w[:, None, 0] * v[rows, :, 0] + w[:, None, 1] * v[rows, :, 1]) / length[:, None]
            up = (w[:, None, 0] * v[rows, :, 1] - w[:, None, 1] * v[rows, :, 0]) / length[:, None]
            left = up > LINE * size[rows]
            s = np.where(left, (size[rows] ** 2 - length[:, None] * along) / (2 * up), np.inf)
        s[~left | ~np.isfinite(s)] = np.inf
        low = s.min(1)
        some = np.isfinite(low)
        stuck[rows[~some]] = True
        rows, q, w, length, low = rows[some], q[some], w[some], length[some], low[some]
        if not len(rows):
            break
        along, up, s = along[some], up[some], s[some]
        tie = s <= (low + ON * (length + np.abs(low)))[:, None]
        angle = np.arctan2(up, along)
        named = np.where(tie, ids[rows], np.iinfo(np.int64).max)
        least = named.argmin(1)
        first = np.where(tie, angle, np.inf).argmin(1)
        last = np.where(tie, angle, -np.inf).argmax(1)
        me, its, other = own[rows], ids[rows, q], named.min(1)
        r = np.where((me < its) & (me < other), first, np.where(its < other, last, least))
        n = np.column_stack([-w[:, 1], w[:, 0]]) / length[:, None]
        centre = w / 2 + low[:, None] * n
        swept[rows] += angle[np.arange(len(rows)), r]
        found.append(np.column_stack([rows, q, r, centre, np.hypot(length / 2, low)]))
        going = (r != 0) & (swept[rows] < 2 * np.pi)
        rows, q = rows[going], r[going]
    return (np.vstack(found) if found else np.zeros((0, 6))), stuck


def around(p: np.ndarray, ids: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(triangles (i, q, r, centre x, centre y, radius), open) of the Delaunay triangulation of p, around each of the wanted places.

    i, q and r are places in p, in counter-clockwise order. open: whether a star ends at the hull. No two of p are equal.
    """
    all_found, is_open = [], np.zeros(len(p), bool)
    for start in range(0, len(want), CHUNK):
        left, k = want[start : start + CHUNK], NEAR
        while len(left) and len(p) > 1:
            k = min(k, len(p) - 1)
            d = ((p[left][:, None] - p[None]) ** 2).sum(2)
            d[np.arange(len(left)), left] = np.inf
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1), 1)
            reach = np.sqrt(np.take_along_axis(d, near[:, -1:], 1)[:, 0]) if k < len(p) - 1 else np.full(len(left), np.inf)
            v = p[near] - p[left][:, None]
            t, stuck = turn(v, ids[near], ids[left])
            if stuck.any():
                at = np.flatnonzero(stuck)
                back, _ = turn(v[at] * [-1, 1], ids[near[at]], ids[left[at]])
                back = back[:, [0, 2, 1, 3, 4, 5]] * [1, 1, 1, -1, 1, 1]
                back[:, 0] = at[back[:, 0].astype(int)]
                t = np.vstack([t, back])
            row = t[:, 0].astype(int)
            wide = np.zeros(len(left))
            np.maximum.at(wide, row, t[:, 5])
            done = (2 * wide * (1 + 1e-6) < reach) & (~stuck | np.isinf(reach))
            t = t[done[row]]
            row = t[:, 0].astype(int)
            out = np.column_stack([left[row], near[row, t[:, 1].astype(int)], near[row, t[:, 2].astype(int)], t[:, 3:5] + p[left[row]], t[:, 5]])
            all_found.append(out)
            is_open[left[done & stuck]] = True
            left, k = left[~done], k * MORE
    return (np.vstack(all_found) if all_found else np.zeros((0, 6))), is_open[want]
