"""Filters, masks and selections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matriq.operators.order import kth


def _bounds(stats: DataFrame, bounds: list[tuple[str, float | None, float | None]]) -> Column:
    """All given bounds at once; none given keeps everything."""
    tests = [F.col(c) >= lo for c, lo, _ in bounds if lo is not None] + [F.col(c) <= hi for c, _, hi in bounds if hi is not None]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def cell_totals(x: DataFrame, obs: DataFrame) -> DataFrame:
    """(cell_id, total, n_genes) of every cell of obs; those without values have zeros."""
    t = x.where("value > 0").groupBy("cell_id").agg(F.sum("value").alias("total"), F.count("*").alias("n_genes"))
    return obs.select("cell_id").join(t, "cell_id", "left").select("cell_id", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n_genes", F.lit(0).cast("long")).alias("n_genes"))


def gene_totals(x: DataFrame, var: DataFrame) -> DataFrame:
    t = x.where("value > 0").groupBy("gene_id").agg(F.sum("value").alias("total"), F.count("*").alias("n_cells"))
    return F.broadcast(t).join(var.select("gene_id"), "gene_id", "right").select("gene_id", F.coalesce("total", F.lit(0.0)).alias("total"), F.coalesce("n_cells", F.lit(0).cast("long")).alias("n_cells"))


def filter_cells(x: DataFrame, obs: DataFrame, min_counts=None, max_counts=None, min_genes=None, max_genes=None, active: DataFrame | None = None) -> DataFrame:
    """Cells within all bounds; with `active` only its cells can fail."""
    stats = cell_totals(x, obs)
    ok = _bounds(stats, [("total", min_counts, max_counts), ("n_genes", min_genes, max_genes)])
    if active is not None:
        stats = stats.join(active.select("cell_id").distinct().withColumn("_on", F.lit(True)), "cell_id", "left")
        ok = ok | F.col("_on").isNull()
    return stats.where(ok).select("cell_id", "total", "n_genes")


def filter_genes(x: DataFrame, var: DataFrame, min_counts=None, max_counts=None, min_cells=None, max_cells=None, active: DataFrame | None = None) -> DataFrame:
    """Genes within all bounds, counted over the active cells."""
    x = x if active is None else x.join(active.select("cell_id"), "cell_id", "left_semi")
    return gene_totals(x, var).where(_bounds(None, [("total", min_counts, max_counts), ("n_cells", min_cells, max_cells)]))


def exclude_genes(var: DataFrame, names: list[str] = (), patterns: list[str] = ()) -> DataFrame:
    """Genes but those named, and those whose name begins with a match of a pattern."""
    gone = F.col("gene_name").isin(list(names)) if names else F.lit(False)
    for p in patterns:
        gone = gone | F.col("gene_name").rlike(f"^(?:{p})")
    return var.where(~gone)


def delete_cells(obs: DataFrame, cells: DataFrame) -> DataFrame:
    return obs.join(cells.select("cell_id"), "cell_id", "left_anti")


def active_cells(obs: DataFrame, cells: DataFrame | None) -> DataFrame | None:
    """None if no subset is meant (nothing given, or every cell); an empty subset is an error."""
    if cells is None:
        return None
    inside = obs.join(cells.select("cell_id"), "cell_id", "left_semi")
    n, total = inside.count(), obs.count()
    if n == 0:
        raise ValueError("no cells in the subset")
    return None if n == total else inside.select("cell_id")


def cell_context(obs: DataFrame, cells: DataFrame | None = None, column: str | None = None, values: list[str] = ()) -> DataFrame:
    """All cells, a selection, or the cells with given values of an annotation."""
    if column is not None:
        return obs.where(F.col(column).isin(list(values))).select("cell_id")
    return obs.select("cell_id") if cells is None else obs.join(cells, "cell_id", "left_semi").select("cell_id")


def mask_genes(var: DataFrame, keep: list[str] = (), hide: list[str] = (), operation: str = "or") -> DataFrame:
    """var with `visible`: kept by any (or all) keep columns and by no hide column."""
    flag = lambda c: F.coalesce(F.col(c).cast("int") == 1, F.lit(False))
    join = (lambda a, b: a & b) if operation == "and" else (lambda a, b: a | b)
    kept = reduce(join, [flag(c) for c in keep]) if keep else F.lit(True)
    gone = reduce(lambda a, b: a | b, [flag(c) for c in hide]) if hide else F.lit(False)
    return var.withColumn("visible", kept & ~gone)


def checked_mask(masked: DataFrame) -> DataFrame:
    if masked.where("visible").isEmpty():
        raise ValueError("the mask hides every gene")
    return masked


def subset_genes(var: DataFrame, subset=None) -> DataFrame:
    """None: all genes. A boolean column. A list of names; one of columns alone: their intersection. {columns, operation}."""
    if subset is None:
        return var
    flag = lambda c: F.coalesce(F.col(c).cast("int") == 1, F.lit(False))
    if isinstance(subset, str):
        return var.where(flag(subset))
    if isinstance(subset, dict):
        flags, op = [flag(c) for c in subset["columns"]], subset.get("operation", "intersection")
        return var.where(reduce((lambda a, b: a | b) if op == "union" else (lambda a, b: a & b), flags))
    names = list(subset)
    if names and all(n in var.columns for n in names) and var.where(F.col("gene_name").isin(names)).isEmpty():
        return var.where(reduce(lambda a, b: a & b, [flag(n) for n in names]))
    return var.where(F.col("gene_name").isin(names))


def match_names(var: DataFrame, pattern: str, mode: str = "prefix") -> DataFrame:
    """Genes whose name starts with the pattern, or in which the regular expression is found anywhere."""
    return var.where(F.col("gene_name").startswith(pattern) if mode == "prefix" else F.col("gene_name").rlike(pattern))


def split_present(var: DataFrame, names: list[str]) -> DataFrame:
    """(pos, gene_name, gene_id, present) of a request list, in its order."""
    asked = var.sparkSession.createDataFrame(list(enumerate(names)), "pos int, gene_name string")
    return F.broadcast(asked).join(var.select("gene_name", "gene_id"), "gene_name", "left").select("pos", "gene_name", "gene_id", F.col("gene_id").isNotNull().alias("present")).orderBy("pos")


def lookup_genes(var: DataFrame, names: list[str]) -> DataFrame:
    """(asked, gene_id): exact name, else the first gene of the same name in upper case."""
    asked = F.broadcast(var.sparkSession.createDataFrame([(n,) for n in names], "asked string"))
    exact = asked.join(var, F.col("asked") == F.col("gene_name")).select("asked", F.col("gene_id").alias("_exact"))
    loose = asked.withColumn("_u", F.upper("asked")).join(var.withColumn("_u", F.upper("gene_name")), "_u").groupBy("asked").agg(F.min("gene_id").alias("_loose"))
    return asked.join(exact, "asked", "left").join(loose, "asked", "left").select("asked", F.coalesce("_exact", "_loose").alias("gene_id"))


def threshold(values: DataFrame, mode: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """Cells with value >= lo (above), <= hi (below), or both inclusive (between); null never matches."""
    v = F.col("value")
    test = {"above": lambda: v >= lo, "below": lambda: v <= hi, "between": lambda: (v >= lo) & (v <= hi)}
    if mode not in test:
        raise ValueError(f"mode {mode!r}")
    return values.where(test[mode]()).select("cell_id")


def default_thresholds(values: DataFrame) -> DataFrame:
    """(above, lo, hi), one row: the middle one (index n // 2) of positive values, else the lower quarter, else the midpoint; both quarters."""
    v = values.where(F.col("value").isNotNull() & ~F.isnan("value")).select(F.col("value").cast("double").alias("value"))
    n, p, low, high = v.agg(F.count("*"), F.count_if(F.col("value") > 0), F.min("value"), F.max("value")).first()
    spark, schema = values.sparkSession, "above double, lo double, hi double"
    if not n:
        return spark.createDataFrame([], schema)
    q1, q3 = kth(v, "value", [int(n * 0.25), int(n * 0.75)], n)
    if p:
        above = kth(v.where("value > 0"), "value", [p // 2], p)[0]
    else:
        above = q1 if q1 > low else (low + high) / 2
    return spark.createDataFrame([(above, q1, q3)], schema)


#: Modes of combining a current selection with a new one, by whether a cell is in either. Null ids are not told apart, so none is removed.
MODES = {"replace": "new", "add": "current OR new", "intersect": "current AND new", "remove": "current AND (NOT new OR cell_id IS NULL)"}


def combined(marked: DataFrame, modes: list[str]) -> DataFrame:
    """(mode, cell_id) of each mode, from cells marked as in the selections (cell_id, current, new): one pass and one sum a cell for all modes.

    A join for each mode would put the sorts and sums of all of them into one task.
    """
    cells = marked.groupBy("cell_id").agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("current", "new")))
    found = F.array_compact(F.array(*(F.when(F.expr(MODES[m]), F.lit(m)) for m in modes)))
    return cells.select(F.explode(found).alias("mode"), "cell_id")


def combine_selections(current: DataFrame, new: DataFrame, mode: str) -> DataFrame:
    """replace, add, remove or intersect, of tables of cell_id."""
    mark = lambda df, a: df.select("cell_id", F.lit(a).alias("current"), F.lit(not a).alias("new"))
    return combined(mark(current, True).union(mark(new, False)), [mode]).select("cell_id")


def label_high_low(context: DataFrame, selected: DataFrame, high: str = "high", low: str = "low") -> DataFrame:
    return context.join(selected.select("cell_id").distinct().withColumn("_s", F.lit(True)), "cell_id", "left").select("cell_id", F.when(F.col("_s"), high).otherwise(low).alias("label"))


def inside_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Ray casting with half-open edges; fewer than three corners hold nothing. Corners are part of the expression."""
    if len(polygon) < 3:
        return F.lit(False)
    odd = F.lit(0)
    for (xi, yi), (xj, yj) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
        if yi == yj:
            continue
        crosses = (F.lit(yi) > y) != (F.lit(yj) > y)
        odd = odd + F.when(crosses & (x < F.lit(xj - xi) * (y - F.lit(yi)) / F.lit(yj - yi) + F.lit(xi)), 1).otherwise(0)
    return odd % 2 == 1


def polygon_select(points: DataFrame, polygon: list[tuple[float, float]]) -> DataFrame:
    """Cells of (cell_id, x, y) inside the polygon."""
    return points.where(inside_polygon(F.col("x"), F.col("y"), polygon)).select("cell_id")


def lasso_3d(points: DataFrame, polygon: list[tuple[float, float]], matrix: list[list[float]]) -> DataFrame:
    """Cells of (cell_id, x, y, z) whose projection by a 4 x 4 matrix lies inside the polygon; those behind the eye don't."""
    row = lambda r: r[0] * F.col("x") + r[1] * F.col("y") + r[2] * F.col("z") + r[3]
    w = row(matrix[3])
    return points.withColumn("_w", w).where("_w > 0").where(inside_polygon(row(matrix[0]) / F.col("_w"), row(matrix[1]) / F.col("_w"), polygon)).select("cell_id")
