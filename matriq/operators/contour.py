"""Contour bands of expression over tissue, and tissue calls from several of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matriq.functions.surface import covered, cubic
from matriq.lineage import cut
from matriq.operators.graph import median_nearest
from matriq.operators.score import aggregate_genes
from matriq.operators.triangulation import triangles
from matriq.zeros import dense


def raw_field(x: DataFrame, obs: DataFrame, genes: list[int], log: bool = True, clip: tuple[float, float] = (1, 99)) -> DataFrame:
    """(cell_id, value): mean over genes of expression cut at percentiles and rescaled to 0..1, over all cells."""
    d = dense(x, obs, genes)
    if log:
        d = d.withColumn("value", F.log1p("value"))
    q = d.groupBy("gene_id").agg(F.percentile("value", clip[0] / 100).alias("a"), F.percentile("value", clip[1] / 100).alias("b"))
    v = F.least(F.greatest("value", "a"), F.col("b"))
    return aggregate_genes(d.join(F.broadcast(q), "gene_id").select("cell_id", "gene_id", F.when(F.col("b") > F.col("a"), (v - F.col("a")) / (F.col("b") - F.col("a"))).otherwise(F.lit(0.0)).alias("value")))


def smooth_field(field: DataFrame, points: DataFrame, section: str | None = None, sigma: float = 2.0, grid: int = 200) -> DataFrame:
    """(cell_id, value): the field on a grid of each section, blurred, and read back at the nearest grid place.

    Grid places take the cubic of the triangle they lie in, others are zero, but for those that cells are nearest to: they take
    the value of the smallest cell. Sections of fewer than four points, or of points on a line, keep their values.
    Triangles, places and their blur are rows, so no task holds a section.
    """
    s = F.coalesce(F.col(section).cast("string"), F.lit("")) if section else F.lit("")
    inner = points.select("cell_id", "x", "y", s.alias("s")).join(field.select("cell_id", F.col("value").cast("double").alias("v")), "cell_id")
    p = placed(cut(inner), grid)
    t = cut(triangles(p, "s"))
    whole = t.select(F.col("section").alias("s")).distinct().join(p.groupBy("s").agg(F.count("*").alias("n")).where("n >= 4").select("s"), "s").withColumn("_ok", F.lit(True))
    z = surface(t, p, grid)
    own = p.groupBy("s", "gx", "gy").agg(F.min_by("v", "cell_id").alias("z"))
    z = z.unionByName(own.join(z.select("s", "gx", "gy"), ["s", "gx", "gy"], "left_anti"))
    out = p.join(blurred(z, grid, sigma), ["s", "gx", "gy"], "left").join(whole, "s", "left")
    return out.select("cell_id", F.when(F.col("_ok"), F.col("z")).otherwise(F.col("v")).alias("value"))


def placed(points: DataFrame, grid: int) -> DataFrame:
    """points (s, x, y) with their nearest place (gx, gy) on a grid over each section, and its frame (x0, y0, wx, wy). One row a section is joined."""
    f = points.groupBy("s").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") - F.min("x")).alias("wx"), (F.max("y") - F.min("y")).alias("wy"))
    f = f.withColumn("wx", F.greatest("wx", F.lit(1e-12))).withColumn("wy", F.greatest("wy", F.lit(1e-12)))
    at = [F.rint((F.col(c) - F.col(f"{c}0")) / F.col(f"w{c}") * (grid - 1)).cast("int").alias(f"g{c}") for c in "xy"]
    return points.join(f, "s").select(*points.columns, *at, "x0", "y0", "wx", "wy")


def surface(t: DataFrame, p: DataFrame, grid: int) -> DataFrame:
    """(s, gx, gy, z): grid places within triangles, by the cubic that meets values and slopes at corners and is smooth across sides.

    Slopes are least squares over a point's neighbours by triangle, nearer ones counting more (1 / d^2).
    """
    both = [F.struct(F.col(a).alias("i"), F.col(b).alias("j"), (F.col(f"{b}x") - F.col(f"{a}x")).alias("dx"), (F.col(f"{b}y") - F.col(f"{a}y")).alias("dy")) for a, b in ("ab", "bc", "ca", "ba", "cb", "ac")]
    e = t.select(F.inline(F.array(*both))).dropDuplicates(["i", "j"])
    v = p.select(F.col("cell_id").alias("i"), "v")
    e = e.join(v.select(F.col("i").alias("j"), F.col("v").alias("w")), "j").join(v, "i")
    d = [F.col("dx"), F.col("dy")]
    near = d[0] * d[0] + d[1] * d[1]
    sums = [F.sum(a * b / near) for a, b in ((d[0], d[0]), (d[0], d[1]), (d[1], d[1]), (d[0], F.col("w") - F.col("v")), (d[1], F.col("w") - F.col("v")))]
    g = e.groupBy("i", "v").agg(*(x.alias(n) for x, n in zip(sums, ("xx", "xy", "yy", "xv", "yv"), strict=True)))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    flat = det <= 1e-12 * F.col("xx") * F.col("yy")
    slope = [F.when(flat, 0.0).otherwise(n / det) for n in (F.col("xv") * F.col("yy") - F.col("yv") * F.col("xy"), F.col("yv") * F.col("xx") - F.col("xv") * F.col("xy"))]
    g = cut(g.select("i", "v", slope[0].alias("p"), slope[1].alias("q")))
    for c in "abc":
        t = t.join(g.select(F.col("i").alias(c), F.col("v").alias(f"{c}v"), F.col("p").alias(f"{c}p"), F.col("q").alias(f"{c}q")), c)
    t = t.withColumnRenamed("section", "s").join(p.groupBy("s").agg(*(F.first(c).alias(c) for c in ("x0", "y0", "wx", "wy"))), "s")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for start in range(0, len(b), 64):
                part = b.iloc[start : start + 64]
                v, xy, slopes = (part[[f"{c}{k}" for c in "abc" for k in ks]].to_numpy(float).reshape(len(part), 3, -1) for ks in ("v", "xy", "pq"))
                at, u, gx, gy = covered((xy - part[["x0", "y0"]].to_numpy()[:, None]) / part[["wx", "wy"]].to_numpy()[:, None] * (grid - 1), grid)
                yield pd.DataFrame({"s": part["s"].to_numpy()[at], "gx": gx, "gy": gy, "z": cubic(xy[at], v[at, :, 0], slopes[at], u)})

    found = t.mapInPandas(run, "s string, gx int, gy int, z double")
    return cut(found.groupBy("s", "gx", "gy").agg(F.avg("z").alias("z")))  # a place on a side is in two triangles, of one value


def blurred(z: DataFrame, grid: int, sigma: float) -> DataFrame:
    """(s, gx, gy, z) after a Gaussian blur of a grid that is zero elsewhere and goes on beyond its edges as it is there: one sum by rows, one by columns."""
    if sigma <= 0:
        return z
    r = int(4 * sigma + 0.5)
    k = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    k /= k.sum()
    inner, edge = (F.array(*(F.lit(float(w)) for w in ws)) for ws in (k[r:], [k[: r + 1 - i].sum() for i in range(r + 1)]))
    for c in ("gx", "gy"):
        to = F.explode(F.sequence(F.greatest(F.col(c) - r, F.lit(0)), F.least(F.col(c) + r, F.lit(grid - 1))))
        far = F.abs(F.col("_to") - F.col(c))
        weight = F.when(F.col(c).isin(0, grid - 1), F.get(edge, far)).otherwise(F.get(inner, far))
        z = z.withColumn("_to", to).withColumn("z", F.col("z") * weight).withColumn(c, F.col("_to")).groupBy("s", "gx", "gy").agg(F.sum("z").alias("z"))
    return z


def bands(field: DataFrame, levels: int = 6) -> DataFrame:
    """(cell_id, value, band): the number of thresholds, evenly between 0 and the largest value, that the value reaches."""
    top = F.broadcast(field.agg(F.max("value").alias("_m")))  # one row
    cuts = F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda i: F.col("_m") * i / (levels + 1))
    return field.crossJoin(top).select("cell_id", "value", F.size(F.filter(cuts, lambda t: (F.col("value") >= t) & (F.col("_m") > 0))).alias("band"))


def suggest_contour(points: DataFrame) -> DataFrame:
    """(grid, sigma): grid from the number of cells, sigma two cell distances in grid places, within 1..6."""
    s = points.agg(F.count("*").alias("n"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    s = s.crossJoin(median_nearest(points))  # two single rows
    grid = F.greatest(F.lit(50), F.least(F.lit(600), F.round(F.sqrt("n")).cast("int")))
    pixel = F.col("span") / grid
    sigma = F.when(pixel > 0, F.greatest(F.lit(1.0), F.least(F.lit(6.0), 2 * F.col("d") / pixel))).otherwise(F.lit(2.0))
    return s.select(grid.alias("grid"), sigma.alias("sigma"))


def multi_bands(fields: dict[str, DataFrame], levels: int = 6) -> DataFrame:
    """(cell_id, module, band) of several modules."""
    out = None
    for name, f in fields.items():
        one = bands(f, levels).select("cell_id", F.lit(name).alias("module"), "band")
        out = one if out is None else out.union(one)
    return out


def band_histogram(banded: DataFrame) -> DataFrame:
    return banded.groupBy("module", "band").agg(F.count("*").alias("n"))


def assign_modules(banded: DataFrame, cutoffs: dict[str, int], edges: DataFrame, profile: DataFrame, k: int = 5, obs: DataFrame | None = None, section: str | None = None) -> DataFrame:
    """(cell_id, label, n_high): a cell high in one module gets it; in several, its neighbours of one module alone vote.

    Voters are neighbours in `edges` (of the same section if named), the k nearest by profile (cell_id, v); the module with
    most votes wins if no other has as many, else the cell is unassigned.
    """
    least = F.coalesce(*(F.when(F.col("module") == m, F.lit(c)) for m, c in cutoffs.items()))
    high = banded.where(F.col("band") >= least).select("cell_id", "module")
    n = high.groupBy("cell_id").agg(F.count("*").alias("n_high"), F.min("module").alias("one"))
    single, torn = n.where("n_high = 1").select("cell_id", F.col("one").alias("vote")), n.where("n_high > 1").select("cell_id")
    e = edges.select("src", "dst").distinct()
    if section:
        s = obs.select("cell_id", F.col(section).alias("_s"))
        e = e.join(s.select(F.col("cell_id").alias("src"), F.col("_s").alias("_a")), "src").join(s.select(F.col("cell_id").alias("dst"), F.col("_s").alias("_b")), "dst").where("_a = _b").select("src", "dst")
    v = torn.join(e, F.col("cell_id") == F.col("src")).select("src", "dst").join(single.withColumnRenamed("cell_id", "dst"), "dst")
    v = v.join(profile.select(F.col("cell_id").alias("src"), F.col("v").alias("_p")), "src").join(profile.select(F.col("cell_id").alias("dst"), F.col("v").alias("_q")), "dst")
    d = F.aggregate(F.zip_with("_p", "_q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b)
    rank = F.row_number().over(Window.partitionBy("src").orderBy(d, "dst"))
    votes = v.withColumn("_r", rank).where(F.col("_r") <= k)
    allowed = votes.join(high.select(F.col("cell_id").alias("src"), F.col("module").alias("vote")), ["src", "vote"], "left_semi")
    count = allowed.groupBy("src", "vote").agg(F.count("*").alias("c"))
    win = count.groupBy("src").agg(F.max("c").alias("top"), F.max_by("vote", "c").alias("vote"), F.collect_list("c").alias("cs"))
    win = win.where(F.size(F.filter("cs", lambda c: c == F.col("top"))) == 1).select(F.col("src").alias("cell_id"), F.col("vote").alias("_won"))
    cells = banded.select("cell_id").distinct()
    out = cells.join(n, "cell_id", "left").join(win, "cell_id", "left")
    label = F.when(F.col("n_high") == 1, F.col("one")).when(F.col("_won").isNotNull(), F.col("_won")).otherwise(F.lit("unassigned"))
    return out.select("cell_id", label.alias("label"), F.coalesce("n_high", F.lit(0).cast("long")).alias("n_high"))


