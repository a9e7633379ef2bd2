"""A smooth surface over triangles: the grid places in them, and the cubic of a triangle in three parts (Clough and Tocher)."""

from __future__ import annotations

import numpy as np

#: How far beyond a side a place counts as on it, in grid steps.
EDGE = 1e-9


def covered(q: np.ndarray, grid: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(triangle, barycentric coordinates, gx, gy) of the grid places within triangles q (n, 3, 2) in grid steps: row by row, between where the sides cross it."""
    lo = np.maximum(np.ceil(q[:, :, 1].min(1) - EDGE), 0).astype(int)
    hi = np.minimum(np.floor(q[:, :, 1].max(1) + EDGE), grid - 1).astype(int)
    n = np.maximum(hi - lo + 1, 0)
    t = np.repeat(np.arange(len(q)), n)
    y = lo[t] + np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
    left, right = np.full(len(t), np.inf), np.full(len(t), -np.inf)
    for a, b in ((0, 1), (1, 2), (2, 0)):
        (xa, ya), (xb, yb) = q[t, a].T, q[t, b].T
        meets = (np.minimum(ya, yb) - EDGE <= y) & (y <= np.maximum(ya, yb) + EDGE)
        level = np.abs(yb - ya) <= EDGE
        at = xa + np.clip((y - ya) / np.where(level, 1, yb - ya), 0, 1) * (xb - xa)
        left = np.minimum(left, np.where(meets, np.where(level, np.minimum(xa, xb), at), np.inf))
        right = np.maximum(right, np.where(meets, np.where(level, np.maximum(xa, xb), at), -np.inf))
    x0, x1 = np.maximum(np.ceil(left - EDGE), 0), np.minimum(np.floor(right + EDGE), grid - 1)
    m = np.where(x1 >= x0, x1 - x0 + 1, 0).astype(int)
    at = np.repeat(np.arange(len(t)), m)
    gx = np.where(np.isfinite(x0), x0, 0).astype(int)[at] + np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m)
    t, gy = t[at], y[at]
    a, b, c = q[t, 0], q[t, 1], q[t, 2]
    area = (b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])
    ok = np.abs(area) > 1e-12
    t, gx, gy, a, b, c, area = t[ok], gx[ok], gy[ok], a[ok], b[ok], c[ok], area[ok]
    u = ((b[:, 0] - gx) * (c[:, 1] - gy) - (b[:, 1] - gy) * (c[:, 0] - gx)) / area
    v = ((c[:, 0] - gx) * (a[:, 1] - gy) - (c[:, 1] - gy) * (a[:, 0] - gx)) / area
    return t, np.column_stack([u, v, 1 - u - v]), gx, gy


def cubic(p: np.ndarray, f: np.ndarray, g: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Values at barycentric u (n, 3) of triangles p (n, 3, 2) with corner values f (n, 3) and slopes g (n, 3, 2).

    Each third has a cubic in Bezier form; slopes across an outer side change linearly along it, so neighbours meet smoothly.
    """
    middle = p.mean(1)
    dot = lambda a, b: (a * b).sum(1)
    toward = [f[:, i] + dot(g[:, i], middle - p[:, i]) / 3 for i in range(3)]
    sides, inner = {}, {}
    for i, j in ((0, 1), (1, 2), (2, 0)):
        e = p[:, j] - p[:, i]
        ij, ji = f[:, i] + dot(g[:, i], e) / 3, f[:, j] - dot(g[:, j], e) / 3
        share = dot(middle - p[:, i], e) / dot(e, e)
        n = middle - p[:, i] - share[:, None] * e
        inner[i, j] = (dot(g[:, i], n) + dot(g[:, j], n)) / 6 + (1 - share) * ij + share * ji
        sides[i, j] = ij, ji
    low = [(toward[i] + sum(c for ends, c in inner.items() if i in ends)) / 3 for i in range(3)]
    centre = (low[0] + low[1] + low[2]) / 3
    k = u.argmin(1)
    out = np.zeros(len(u))
    for (i, j), c in inner.items():
        m = 3 - i - j
        r = k == m
        a, b, s = u[r, i] - u[r, m], u[r, j] - u[r, m], 3 * u[r, m]
        ij, ji = (x[r] for x in sides[i, j])
        out[r] = a**3 * f[r, i] + 3 * a * a * b * ij + 3 * a * b * b * ji + b**3 * f[r, j]
        out[r] += 3 * s * (a * a * toward[i][r] + 2 * a * b * c[r] + b * b * toward[j][r]) + 3 * s * s * (a * low[i][r] + b * low[j][r]) + s**3 * centre[r]
    return out
