"""Lines, projections, transforms, hulls and heatmaps."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matriq.operators.order import positions


def project_on_line(points: DataFrame, line: list[tuple[float, float]]) -> DataFrame:
    """(cell_id, position, distance): place along a polyline as a fraction of its length, and distance from it.

    The nearest segment counts, the first of several; a line of fewer than two points gives 0 and NaN. Segments are an array
    literal folded within each row, so points are neither joined nor shuffled.
    """
    if len(line) < 2:
        return points.select("cell_id", F.lit(0.0).alias("position"), F.lit(float("nan")).alias("distance"))
    sizes = [math.dist(a, b) for a, b in zip(line, line[1:], strict=False)]
    total = sum(sizes)
    segs, cum = [], 0.0
    for (x1, y1), (x2, y2), size in zip(line, line[1:], sizes, strict=False):
        segs.append(F.struct(*(F.lit(float(v)).alias(n) for v, n in ((x1, "x"), (y1, "y"), (x2 - x1, "dx"), (y2 - y1, "dy"), (size, "len"), (cum, "cum")))))
        cum += size

    def near(s: Column) -> Column:
        square = s["dx"] * s["dx"] + s["dy"] * s["dy"]
        t = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - s["x"]) * s["dx"] + (F.col("y") - s["y"]) * s["dy"]) / square))).otherwise(F.lit(0.0))
        ex, ey = F.col("x") - (s["x"] + t * s["dx"]), F.col("y") - (s["y"] + t * s["dy"])
        return F.struct(F.sqrt(ex * ex + ey * ey).alias("d"), (s["cum"] + t * s["len"]).alias("at"))

    all_ = F.transform(F.array(*segs), near)
    best = F.aggregate(F.slice("_a", 2, max(len(segs) - 1, 1)) if len(segs) > 1 else F.slice("_a", 1, 1), F.element_at("_a", 1), lambda a, b: F.when(b["d"] < a["d"], b).otherwise(a))
    out = points.withColumn("_a", all_).withColumn("_b", best)
    position = F.col("_b.at") / total if total > 0 else F.lit(0.0)
    return out.select("cell_id", position.alias("position"), F.col("_b.d").alias("distance"))


def project_on_lines(points: DataFrame, lines: dict[str, list[tuple[float, float]]]) -> DataFrame:
    """(line, cell_id, position, distance) for each of the named lines."""
    return reduce(DataFrame.unionAll, [project_on_line(points, p).select(F.lit(n).alias("line"), "cell_id", "position", "distance") for n, p in lines.items()])


def projection_embedding(projected: DataFrame) -> DataFrame:
    """(cell_id, v) of position and distance rescaled to 0..1."""
    r = F.broadcast(projected.agg(F.min("distance").alias("_lo"), F.max("distance").alias("_hi")))  # one row
    d = F.when(F.col("_hi") > F.col("_lo"), (F.col("distance") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(0.0))
    return projected.crossJoin(r).select("cell_id", F.array("position", d).alias("v"))


def smooth_line(points: DataFrame, half: int = 2, rounds: int = 1) -> DataFrame:
    """(line, seq, x, y): moving averages over seq - half .. seq + half within each line, ends cut short."""
    w = Window.partitionBy("line").orderBy("seq").rowsBetween(-half, half)
    for _ in range(rounds):
        points = points.select("line", "seq", F.avg("x").over(w).alias("x"), F.avg("y").over(w).alias("y"))
    return points


def spline_line(points: DataFrame, steps: int = 20) -> DataFrame:
    """(line, seq, step, x, y): Catmull-Rom between neighbouring points, ends doubled."""
    w = Window.partitionBy("line").orderBy("seq")
    p = points
    for c in ("x", "y"):
        p = p.withColumn(f"{c}0", F.coalesce(F.lag(c).over(w), F.col(c))).withColumn(f"{c}2", F.lead(c).over(w)).withColumn(f"{c}3", F.coalesce(F.lead(c, 2).over(w), F.lead(c).over(w)))
    p = p.where("x2 IS NOT NULL").withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("t", F.col("step") / steps)
    t = F.col("t")

    def curve(c: str) -> Column:
        p0, p1, p2, p3 = (F.col(k) for k in (f"{c}0", c, f"{c}2", f"{c}3"))
        return 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t)

    return p.select("line", "seq", "step", curve("x").alias("x"), curve("y").alias("y"))


def transform_points(m: DataFrame, operation: str, amount: float = 0.0, dx: float = 0.0, dy: float = 0.0, dims: tuple[int, int] = (0, 1), subset: DataFrame | None = None) -> DataFrame:
    """An obsm table reflected (reflect_x, reflect_y), rotated counter-clockwise by degrees, or translated, about the centroid.

    With a subset only its cells move, about their own centroid. The table before is what undoes it.
    """
    i, j = dims
    on = F.lit(True)
    if subset is not None:
        m = m.join(subset.select("cell_id").distinct().withColumn("_on", F.lit(True)), "cell_id", "left")
        on = F.coalesce("_on", F.lit(False))
    x, y = F.col("v")[i], F.col("v")[j]
    centre = F.broadcast(m.agg(F.avg(F.when(on, x)).alias("_cx"), F.avg(F.when(on, y)).alias("_cy")))  # one row
    cx, cy = F.col("_cx"), F.col("_cy")
    a = math.radians(amount)
    new = {
        "reflect_x": lambda: (2 * cx - x, y),
        "reflect_y": lambda: (x, 2 * cy - y),
        "rotate": lambda: (cx + (x - cx) * math.cos(a) - (y - cy) * math.sin(a), cy + (x - cx) * math.sin(a) + (y - cy) * math.cos(a)),
        "translate": lambda: (x + dx, y + dy),
    }
    if operation not in new:
        raise ValueError(f"operation {operation!r}")
    nx, ny = new[operation]()
    moved = F.transform("v", lambda e, k: F.when(k == i, nx).when(k == j, ny).otherwise(e))
    return m.crossJoin(centre).select("cell_id", F.when(on, moved).otherwise(F.col("v")).alias("v"))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners, counter-clockwise (monotone chain)."""
    p = sorted(set(points))
    if len(p) < 3:
        return p

    def half(seq: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for c in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (c[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (c[0] - out[-2][0]):
                out.pop()
            out.append(c)
        return out[:-1]

    return half(p) + half(p[::-1])


def hull_corners(points: DataFrame, groups: int = 16) -> list[tuple[float, float]]:
    """Corners of the convex hull, exactly: hulls of partitions, of `groups` groups of their corners, and of those.

    Only corners travel. Points without a finite coordinate do not count.
    """

    def corners(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[tuple[float, float]] = []
        for b in batches:
            kept = convex_hull(kept + list(zip(b["x"].tolist(), b["y"].tolist(), strict=True)))
        yield pd.DataFrame(kept, columns=["x", "y"], dtype=float)

    limit = F.lit(float("inf"))
    p = points.select(*(F.col(c).cast("double").alias(c) for c in ("x", "y"))).where((F.abs("x") < limit) & (F.abs("y") < limit))
    few = p.mapInPandas(corners, "x double, y double").repartition(groups, "x", "y").mapInPandas(corners, "x double, y double")
    return convex_hull([(r["x"], r["y"]) for r in few.collect()])


def shape_follows(shape: list[tuple[float, float]], hull: list[tuple[float, float]]) -> bool:
    """A drawn shape moves with a selection if its centroid, or half its points, lie in the selection's hull."""
    if len(hull) < 3 or not shape:
        return False

    def inside(x: float, y: float) -> bool:
        odd = False
        for (xi, yi), (xj, yj) in zip(hull, [hull[-1], *hull[:-1]], strict=True):
            odd ^= (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi
        return odd

    centre = tuple(sum(p[k] for p in shape) / len(shape) for k in (0, 1))
    return inside(*centre) or 2 * sum(inside(*p) for p in shape) >= len(shape)


def heatmap(x: DataFrame, cells: DataFrame, genes: list[int], n_bins: int = 50, scale: bool = True, places: int = 4) -> DataFrame:
    """(gene_id, bin, value, peak): mean of each gene in equal runs of ordered cells.

    cells: (cell_id, ord), in which order they stand. Cell k of n belongs to the bin whose whole-number edges of an even division
    hold it. Means count zeros by the cells of a bin; scale rescales each gene to 0..1; peak is the gene's largest bin.
    """
    ranked = positions(cells, "ord", "cell_id")
    n = F.broadcast(cells.agg(F.count("*").alias("_n")))  # one row
    b = F.least(F.lit(n_bins), F.col("_n"))
    placed = ranked.crossJoin(n).select("cell_id", F.floor(((F.col("_k") + 1) * b - 1) / F.col("_n")).cast("int").alias("bin"))
    sizes = F.broadcast(placed.groupBy("bin").agg(F.count("*").alias("_m")))  # n_bins rows
    ids = F.array(*(F.lit(g) for g in genes))
    sums = x.where(F.col("gene_id").isin(genes)).join(placed, "cell_id").groupBy("gene_id", "bin").agg(F.sum("value").alias("_s"))
    grid = sizes.select("bin", "_m", F.explode(ids).alias("gene_id"))
    g = grid.join(sums, ["gene_id", "bin"], "left").select("gene_id", "bin", (F.coalesce("_s", F.lit(0.0)) / F.col("_m")).alias("value"))
    w = Window.partitionBy("gene_id")
    if scale:
        lo, hi = F.min("value").over(w), F.max("value").over(w)
        g = g.withColumn("value", F.when(hi > lo, (F.col("value") - lo) / (hi - lo)).otherwise(F.lit(0.0)))
    top = g.groupBy("gene_id").agg(F.max_by("bin", F.struct("value", -F.col("bin"))).alias("peak"))
    g = g.join(F.broadcast(top), "gene_id")
    return g.select("gene_id", "bin", F.round("value", places).alias("value"), "peak")
