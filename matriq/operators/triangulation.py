"""Delaunay triangles of cells, section by section, in tiles that settle what they can and leave the rest to wider ones.

A tile sees its own points and a rim around them. A triangle is certain if its circumcircle lies within what the tile sees; a
point is settled once all triangles around it are certain. A triangle not yet known has three unsettled corners, so the next round
takes the unsettled points alone, in tiles that are wider for there being fewer of them. Of their triangles those in the gaps
that certain triangles leave at a corner are triangles of all points; the others lie over what is known.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matriq.functions.stars import around
from matriq.lineage import cut, drop
from matriq.operators.geometry import convex_hull

#: Points of a tile without its rim; a round that settles less than half of them doubles it for the next.
POINTS = 2048
#: Strips of a tile across; its rim is one strip of its neighbour's.
STRIPS = 4
#: Columns of a section and rows of a column at most; beyond them tiles have more points.
MAX_LINES = 512
#: Tiles of a task, about, and tasks of a round at most.
TILES, MAX_TASKS = 4, 20_000
#: Corners of hulls that travel with a round; with more of them points at the border wait until a tile is a section.
MAX_CORNERS = 50_000

FOUND = "s string, a long, b long, c long, ax double, ay double, bx double, by double, cx double, cy double"


def triangles(points: DataFrame, section: str | None = None) -> DataFrame:
    """(section, a, b, c, and coordinates ax to cy) of the Delaunay triangulation of each section, a < b < c.

    points: (cell_id, x, y[, section]). Cells without an id or a finite place have no part; of cells at one place the smallest id
    stands for all. Points on one circle are joined to the smallest id among them. Points on one line give no triangle. Cells
    whose section is null are one section. All triangles around a point are one task's work.
    """
    limit = F.lit(float("inf"))
    s = F.coalesce(F.col(section).cast("string"), F.lit("")) if section else F.lit("")
    p = points.select(s.alias("s"), F.col("cell_id").cast("long").alias("id"), (F.col("x").cast("double") + 0.0).alias("x"), (F.col("y").cast("double") + 0.0).alias("y"))
    p = p.where(F.col("id").isNotNull() & (F.abs("x") < limit) & (F.abs("y") < limit)).groupBy("s", "x", "y").agg(F.min("id").alias("id"))
    rest = cut(p.select("s", "id", "x", "y", F.array().cast("array<double>").alias("known")))
    parts, size, left = [], POINTS, rest.count()
    while left:
        corners = _corners(rest)
        columns, lines = _cuts(rest, size)
        placed = rest.mapInPandas(_place(columns, lines), "s string, tile long, own boolean, id long, x double, y double, known array<double>")
        placed = placed.repartition(min(math.ceil(left / (TILES * size)), MAX_TASKS), "s", "tile")  # small rows, long work: tasks by tiles, not by bytes
        got = cut(placed.groupBy("s", "tile").applyInPandas(_settle(columns, lines, corners), FOUND))
        drop(rest)
        parts.append(got.where("b IS NOT NULL"))
        waiting = cut(got.where("b IS NULL").select("s", F.col("a").alias("id"), F.col("ax").alias("x"), F.col("ay").alias("y")))
        before, left = left, waiting.count()
        size = size * 2 if left > before / 2 else size
        rest = cut(_with_known(waiting, parts)) if left else waiting
        if left:
            drop(waiting)
    out = parts[0] if parts else rest.sparkSession.createDataFrame([], FOUND)
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.dropDuplicates(["a", "b", "c"]).withColumnRenamed("s", "section")


def edges(t: DataFrame) -> DataFrame:
    """(src, dst, d), both ways, of triangles."""
    sides = [F.struct(F.col(p).alias("src"), F.col(q).alias("dst"), F.hypot(F.col(f"{p}x") - F.col(f"{q}x"), F.col(f"{p}y") - F.col(f"{q}y")).alias("d")) for p, q in ("ab", "bc", "ac", "ba", "cb", "ca")]
    return t.select(F.inline(F.array(*sides))).dropDuplicates(["src", "dst"])


def _corners(p: DataFrame) -> dict[str, np.ndarray] | None:
    """Corners of each section's hull, among them those of its partitions' hulls; None if there are too many to travel."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, list[tuple[float, float]]] = {}
        for b in batches:
            for s, g in b.groupby("s"):
                kept[s] = convex_hull(kept.get(s, []) + list(zip(g["x"].tolist(), g["y"].tolist(), strict=True)))
        yield pd.DataFrame([(s, *c) for s, k in kept.items() for c in k], columns=["s", "x", "y"])

    few = cut(p.select("s", "x", "y").mapInPandas(run, "s string, x double, y double"))
    n = few.count()
    rows = few.toPandas() if n <= MAX_CORNERS else None
    drop(few)
    return None if rows is None else {s: g[["x", "y"]].to_numpy() for s, g in rows.groupby("s")}


def _cuts(p: DataFrame, size: int) -> tuple[dict, dict]:
    """({section: x where its strips part}, {(section, column): y where the column's strips part}); a section of one tile has none.

    Four numbers a tile, by quantiles, which need not be exact: any cuts give the same triangles.
    """
    counts = {r["s"]: r["n"] for r in p.groupBy("s").agg(F.count("*").alias("n")).collect()}  # one row a section
    wide = {s: min(_power(math.sqrt(n / size)), MAX_LINES) for s, n in counts.items() if n > size}
    if not wide:
        return {}, {}
    big = p.where(F.col("s").isin(list(wide)))
    columns = _quantiles(big, ["s"], "x", {(s,): w for s, w in wide.items()})
    columns = {s: c for (s,), c in columns.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, g in b.groupby("s"):
                yield pd.DataFrame({"s": s, "column": np.searchsorted(columns[s], g["x"].to_numpy(), "right") // STRIPS, "y": g["y"].to_numpy()})

    tall = big.select("s", "x", "y").mapInPandas(run, "s string, column long, y double")
    n = {(r["s"], r["column"]): min(_power(r["n"] / size), MAX_LINES) for r in tall.groupBy("s", "column").agg(F.count("*").alias("n")).collect()}  # MAX_LINES a section
    return columns, _quantiles(tall, ["s", "column"], "y", n)


def _power(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(n, 1))))


def _quantiles(p: DataFrame, by: list[str], column: str, tiles: dict[tuple, int]) -> dict[tuple, np.ndarray]:
    """STRIPS * tiles - 1 cuts of each group, every so many of those that the most finely cut one needs."""
    most = STRIPS * max(tiles.values())
    if most == STRIPS and by == ["s", "column"]:
        return {k: np.zeros(0) for k in tiles}
    q = p.groupBy(*by).agg(F.percentile_approx(column, [i / most for i in range(1, most)], 10 * most).alias("q"))
    every = {tuple(r[c] for c in by): np.array(r["q"]) for r in q.collect()}
    return {k: every[k][most // (STRIPS * n) - 1 :: most // (STRIPS * n)] if n > 1 else np.zeros(0) for k, n in tiles.items()}


def _seen(at: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(rows, tile, own) of values: the tile that a value is in, and the next one where it is in that one's rim."""
    strip = np.searchsorted(cuts, at, "right")
    tile, place, last = strip // STRIPS, strip % STRIPS, len(cuts) // STRIPS
    every = np.arange(len(at))
    yield every, tile, True
    low, high = (place == 0) & (tile > 0), (place == STRIPS - 1) & (tile < last)
    yield every[low], tile[low] - 1, False
    yield every[high], tile[high] + 1, False


def _span(tile: int, cuts: np.ndarray) -> tuple[float, float]:
    """What a tile and its rim see; the first and the last see to the end."""
    low, high = STRIPS * tile - 2, STRIPS * (tile + 1)
    return (cuts[low] if low >= 0 and len(cuts) else -np.inf), (cuts[high] if high < len(cuts) else np.inf)


def _place(columns: dict, lines: dict) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each point once for the tile it is in and once for each whose rim it is in."""
    none = np.zeros(0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s, g in b.groupby("s"):
                for rows, column, own in _seen(g["x"].to_numpy(), columns.get(s, none)):
                    for c in np.unique(column):
                        part = g.iloc[rows[column == c]]
                        for at, line, inside in _seen(part["y"].to_numpy(), lines.get((s, int(c)), none)):
                            if len(at):
                                yield part.iloc[at].assign(tile=(int(c) << 32) + line, own=own and inside)[["s", "tile", "own", "id", "x", "y", "known"]]

    return run


def _settle(columns: dict, lines: dict, corners: dict[str, np.ndarray] | None) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """The certain triangles around a tile's own points, and its points that are not settled (b is null)."""
    none, names = np.zeros(0), FOUND.replace(" string", "").replace(" long", "").replace(" double", "").split(", ")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        s, tile = key
        x0, x1 = _span(int(tile) >> 32, columns.get(s, none))
        y0, y1 = _span(int(tile) & 0xFFFFFFFF, lines.get((s, int(tile) >> 32), none))
        whole = np.isinf([x0, x1, y0, y1]).all()
        p, ids = g[["x", "y"]].to_numpy(), g["id"].to_numpy(np.int64)
        t, is_open = around(p - p.mean(0), ids, np.arange(len(p)) if whole else np.flatnonzero(g["own"].to_numpy(bool)))
        own = np.flatnonzero(g["own"].to_numpy(bool))
        i, q, r = t[:, 0].astype(int), t[:, 1].astype(int), t[:, 2].astype(int)
        (cx, cy), far = (t[:, 3:5] + p.mean(0)).T, t[:, 5] * (1 + 1e-9)
        sure = (cx - far >= x0) & (cx + far < x1) & (cy - far >= y0) & (cy + far < y1)
        settled = np.zeros(len(p), bool)
        settled[own] = True
        settled[i[~sure]] = False
        if not whole:
            border = own[is_open]
            settled[border] &= _at_hull(p, border, i, q, r, None if corners is None else corners.get(s))
            alone = np.ones(len(p), bool)
            alone[i] = False
            settled[alone] = False
        known = g["known"].to_numpy()
        if any(len(k) for k in known):
            sure &= ~_is_known(p, i, q, r, known)
        trio = np.unique(np.sort(np.column_stack([i, q, r])[sure], axis=1), axis=0).astype(int)
        trio = np.take_along_axis(trio, ids[trio].argsort(1), 1)
        out = pd.DataFrame(np.hstack([p[trio[:, k]] for k in range(3)]) if len(trio) else np.zeros((0, 6)), columns=names[4:])
        for k, name in enumerate("abc"):
            out[name] = pd.array(ids[trio[:, k]], "Int64")
        rest = own[~settled[own]] if not whole else own[:0]
        waiting = pd.DataFrame({"a": pd.array(ids[rest], "Int64"), "b": pd.array([None] * len(rest), "Int64"), "c": pd.array([None] * len(rest), "Int64"), "ax": p[rest, 0], "ay": p[rest, 1]})
        return pd.concat([out, waiting]).assign(s=s).reindex(columns=names)

    return run


def _at_hull(p: np.ndarray, border: np.ndarray, i: np.ndarray, q: np.ndarray, r: np.ndarray, corners: np.ndarray | None) -> np.ndarray:
    """Whether both outer edges of an open star lie on the hull of the section, so that nothing can be beyond them."""
    out = np.zeros(len(border), bool)
    if corners is None:
        return out
    span = np.ptp(corners, axis=0).max(initial=0)
    by = np.argsort(i, kind="stable")
    start, end = np.searchsorted(i[by], border), np.searchsorted(i[by], border, "right")
    for k, at in enumerate(border):
        mine = by[start[k] : end[k]]
        ends = [(at, v) for v in np.setdiff1d(q[mine], r[mine])] + [(v, at) for v in np.setdiff1d(r[mine], q[mine])]
        good = len(ends) == 2
        for a, b in ends:
            e, f = p[b] - p[a], corners - p[a]
            good &= bool((e[0] * f[:, 1] - e[1] * f[:, 0] >= -1e-10 * math.hypot(*e) * span).all())
        out[k] = good
    return out


def _is_known(p: np.ndarray, i: np.ndarray, q: np.ndarray, r: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether a triangle lies over known ones: its middle direction at i is within one of them."""
    a = np.arctan2(*(p[q] - p[i]).T[::-1])
    middle = a + np.mod(np.arctan2(*(p[r] - p[i]).T[::-1]) - a, 2 * np.pi) / 2
    out = np.zeros(len(i), bool)
    for k, at in enumerate(i):
        w = np.asarray(known[at], float).reshape(-1, 2)
        out[k] = (np.mod(middle[k] - w[:, 0], 2 * np.pi) < w[:, 1]).any()
    return out


def _with_known(waiting: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Unsettled points with the angles that certain triangles take at them: where each begins, and how wide it is."""
    corner = []
    for t in parts:
        for p, q, r in ("abc", "bca", "cab"):
            at = [F.atan2(F.col(f"{o}y") - F.col(f"{p}y"), F.col(f"{o}x") - F.col(f"{p}x")) for o in (q, r)]
            corner.append(t.select("s", F.col(p).alias("id"), at[0].alias("u"), at[1].alias("v")))
    every = corner[0]
    for c in corner[1:]:
        every = every.union(c)
    turned = F.pmod(F.col("v") - F.col("u"), F.lit(2 * math.pi))
    wedge = F.when(turned < math.pi, F.array("u", turned)).otherwise(F.array("v", 2 * math.pi - turned))
    few = every.join(waiting.select("s", "id"), ["s", "id"], "left_semi").distinct()
    known = few.groupBy("s", "id").agg(F.flatten(F.collect_list(wedge)).alias("known"))
    return waiting.join(known, ["s", "id"], "left").select("s", "id", "x", "y", F.coalesce("known", F.array().cast("array<double>")).alias("known"))
