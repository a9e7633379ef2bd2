"""Ligand-receptor signalling scores and their significance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matriq.lineage import cut
from matriq.operators.graph import Gaussian, median_nearest, row_normalized
from matriq.operators.order import running
from matriq.operators.stats import adjust_bh_spread, permuted


def suggest(points: DataFrame) -> DataFrame:
    """(radius, n_perm, min_cells): three median neighbour distances; 1e5 / N within 20..200; half a percent of cells, 3 at least."""
    s = points.agg(F.count("*").alias("n")).crossJoin(median_nearest(points))  # two single rows
    return s.select(
        (3 * F.col("d")).alias("radius"), F.greatest(F.lit(20), F.least(F.lit(200), F.round(1e5 / F.col("n")))).cast("int").alias("n_perm"), F.greatest(F.lit(3), F.floor(0.005 * F.col("n"))).cast("int").alias("min_cells")
    )


def resolve_pairs(pairs: DataFrame, var: DataFrame, x: DataFrame | None = None, min_cells: int = 0, limit: int | None = None) -> DataFrame:
    """(interaction, side, gene_id) of pairs (interaction, ligand, receptor: arrays of names) of which every subunit is present.

    Names match exactly, else the first gene of the same upper-case name. With x, subunits express in min_cells cells at
    least, and the `limit` pairs with most expressing cells in all stay.
    """
    parts = [pairs.select("interaction", F.lit(s).alias("side"), F.explode(s).alias("name"), F.size(s).alias("need")) for s in ("ligand", "receptor")]
    e = parts[0].union(parts[1])
    exact = var.select(F.col("gene_name").alias("name"), F.col("gene_id").alias("_e"))
    loose = var.groupBy(F.upper("gene_name").alias("_u")).agg(F.min("gene_id").alias("_l"))
    e = e.join(exact, "name", "left").withColumn("_u", F.upper("name")).join(loose, "_u", "left").withColumn("gene_id", F.coalesce("_e", "_l")).where("gene_id IS NOT NULL")
    if x is not None:
        n = x.where("value > 0").groupBy("gene_id").agg(F.count("*").alias("n_cells"))
        e = e.join(F.broadcast(n), "gene_id", "left").na.fill(0, ["n_cells"]).where(F.col("n_cells") >= min_cells)
    else:
        e = e.withColumn("n_cells", F.lit(0).cast("long"))
    side = e.groupBy("interaction", "side", "need").agg(F.count("*").alias("k"), F.sum("n_cells").alias("n_cells")).where("k = need")
    whole = side.groupBy("interaction").agg(F.count("*").alias("k"), F.sum("n_cells").alias("n_cells")).where("k = 2")
    if limit is not None:
        whole = whole.orderBy(F.col("n_cells").desc(), "interaction").limit(limit)
    return e.join(F.broadcast(whole.select("interaction")), "interaction", "left_semi").select("interaction", "side", "gene_id")


def log_rate(x: DataFrame) -> DataFrame:
    """log1p of counts in ten thousand of a cell's total; an empty cell stays empty."""
    t = x.groupBy("cell_id").agg(F.sum("value").alias("_t")).where("_t > 0")
    return x.join(t, "cell_id").select("cell_id", "gene_id", F.log1p(F.col("value") / F.col("_t") * 1e4).alias("value"))


def _spread(edges: DataFrame | Gaussian, v: DataFrame, keys: list[str]) -> DataFrame:
    """Sum of w v over a cell's edges."""
    if isinstance(edges, Gaussian):
        return edges.spread(v, keys)
    return edges.select("src", "dst", "w").join(v.withColumnRenamed("cell_id", "dst"), "dst").groupBy(F.col("src").alias("cell_id"), *keys).agg(F.sum(F.col("w") * F.col("value")).alias("value"))


def _smooth(edges: DataFrame | Gaussian, v: DataFrame, keys: list[str], cells: DataFrame) -> DataFrame:
    """v after one step along the edges and a loop of weight 1 a cell, rows summing to 1."""
    if not isinstance(edges, Gaussian):
        loops = cells.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(1.0).alias("w"))
        return _spread(row_normalized(edges.select("src", "dst", "w").union(loops).groupBy("src", "dst").agg(F.sum("w").alias("w"))), v, keys)
    v = cut(v)
    rows = edges.points.select("cell_id").unionAll(cells.select("cell_id")).groupBy("cell_id").agg(F.count("*").alias("_t"))  # rows of the Gaussian sum to 1
    both = edges.spread(v, keys).unionByName(v.select("cell_id", *keys, "value").join(cells.select("cell_id"), "cell_id", "left_semi"))
    return both.groupBy("cell_id", *keys).agg(F.sum("value").alias("value")).join(rows, "cell_id").select("cell_id", *keys, (F.col("value") / F.col("_t")).alias("value"))


def _sides(x: DataFrame, genes: DataFrame) -> list[DataFrame]:
    """(interaction, cell_id, value) of ligands and of receptors, subunits summed. Only genes of some pair go into the edge joins."""
    used = log_rate(x).join(F.broadcast(genes.select("gene_id").distinct()), "gene_id", "left_semi")
    return [used.join(F.broadcast(genes.where(F.col("side") == side)), "gene_id").groupBy("interaction", "cell_id").agg(F.sum("value").alias("value")) for side in ("ligand", "receptor")]


def _products(lig: DataFrame, rec: DataFrame, near: DataFrame | Gaussian, mean: DataFrame, keys: list[str]) -> DataFrame:
    """(cell_id, keys, value): ligands spread by `near`, both sides averaged by `mean`, multiplied. `keys`: those of lig, interaction first."""
    left = _spread(mean, _spread(near, lig, keys), keys).withColumnRenamed("value", "l")
    right = _spread(mean, rec, ["interaction"]).withColumnRenamed("value", "r")
    return left.join(right, ["interaction", "cell_id"]).select("cell_id", *keys, (F.col("l") * F.col("r")).alias("value"))


def lr_scores(x: DataFrame, genes: DataFrame, near: DataFrame | Gaussian, mean: DataFrame) -> DataFrame:
    """(interaction, cell_id, score): ligand spread by `near` (edges, or a Gaussian without them), both sides averaged by `mean`, subunits summed, sides multiplied."""
    return _products(*_sides(x, genes), near, mean, ["interaction"]).select("interaction", "cell_id", F.col("value").alias("score"))


def lr_significance(x: DataFrame, genes: DataFrame, near: DataFrame | Gaussian, mean: DataFrame, cells: DataFrame, n_perm: int = 20, seed: int = 0, section: str | None = None, level: float = 0.05) -> DataFrame:
    """(interaction, cell_id, score, p, padj, significant): each score among those of permuted ligands, pooled over permutations.

    The permutation is a column, not a loop: ligand values are joined once with (perm, cell, other) and every later
    step has perm as one more key. Permutation 0 leaves cells where they are, so real scores take the same steps. A pair's
    null scores are counted by value and cut into ranges before they are ranked.
    """
    lig, rec = _sides(x, genes)
    lig = cut(lig)
    swap = permuted(cells, seed, section, n_perm)
    moved = lig.join(swap, "cell_id").select(F.col("other").alias("cell_id"), "interaction", "perm", "value")
    moved = moved.unionByName(lig.withColumn("perm", F.lit(0)))
    found = cut(_smooth(near, _products(moved, rec, near, mean, ["interaction", "perm"]), ["interaction", "perm"], cells))
    real = found.where("perm = 0").select("interaction", "cell_id", F.col("value").alias("score"))
    null = found.where("perm > 0")
    total = cells.agg((F.count("*") * n_perm).alias("m"))
    steps = null.groupBy("interaction", F.col("value").alias("score")).agg(F.count("*").alias("n"))
    # Real scores go among them with a count of 0, after equal null scores, so nothing is joined by a sum of floats.
    both = real.select("interaction", "score", F.lit(0).cast("long").alias("n"), "cell_id").unionByName(steps, allowMissingColumns=True)
    ranked = running(both, "score", "n", ["interaction"], "ge", descending=True)
    p = ranked.where("cell_id IS NOT NULL").select("interaction", "cell_id", "score", "ge").crossJoin(F.broadcast(total)).withColumn("p", (F.col("ge") + 1) / (F.col("m") + 1))  # total is one row
    p = adjust_bh_spread(cut(p), "interaction")
    return p.select("interaction", "cell_id", "score", "p", "padj", ((F.col("padj") < level) & (F.col("score") > 0)).alias("significant"))


def lr_summary(tested: DataFrame) -> DataFrame:
    return tested.groupBy("interaction").agg(F.count_if("significant").alias("n_significant"), F.avg("score").alias("mean_score")).orderBy(F.col("n_significant").desc(), F.col("mean_score").desc(), "interaction")


def finalize(obs: DataFrame, tested: DataFrame, interaction: str, ligand: str, receptor: str) -> DataFrame:
    """obs with the pair's score and whether it is significant."""
    name = f"LR_{ligand}_to_{receptor}"
    one = tested.where(F.col("interaction") == interaction).select("cell_id", F.col("score").alias(name), F.col("significant").alias(f"{name}_sig"))
    return obs.join(one, "cell_id", "left").na.fill(0.0, [name]).na.fill(False, [f"{name}_sig"])


def combine_sections(parts: list[tuple[str, DataFrame, DataFrame, DataFrame]], gap: float = 0.05) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(obs, x, points) of several (label, obs, x, points): shared genes alone, sections side by side, labels made unique.

    x moves by the widths before it and a gap of a share of the mean width; cell ids become (sample, cell_id).
    """
    seen: dict[str, int] = {}
    names = []
    for label, *_ in parts:
        seen[label] = seen.get(label, 0) + 1
        names.append(label if seen[label] == 1 else f"{label}_{seen[label]}")
    genes = reduce(DataFrame.intersect, [p[2].select("gene_id").distinct() for p in parts])
    if genes.isEmpty():
        raise ValueError("the sections share no genes")
    tag = lambda df, i: df.withColumn("sample", F.lit(names[i])).withColumn("_i", F.lit(i))
    obs = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [tag(p[1], i) for i, p in enumerate(parts)]).drop("_i")
    x = reduce(DataFrame.unionByName, [tag(p[2], i) for i, p in enumerate(parts)]).join(F.broadcast(genes), "gene_id", "left_semi").drop("_i")
    pts = reduce(DataFrame.unionByName, [tag(p[3], i) for i, p in enumerate(parts)])
    size = pts.groupBy("_i").agg(F.min("x").alias("lo"), (F.max("x") - F.min("x")).alias("width"))
    order = Window.orderBy("_i")  # one row a section
    size = size.withColumn("at", F.coalesce(F.sum("width").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) + F.col("_i") * gap * F.avg("width").over(Window.partitionBy()))
    pts = pts.join(F.broadcast(size), "_i").select("sample", "cell_id", (F.col("x") - F.col("lo") + F.col("at")).alias("x"), "y")
    return obs, x, pts
