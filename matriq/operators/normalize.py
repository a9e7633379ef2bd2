"""Quality metrics, normalisation and variable genes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matriq.lineage import cut
from matriq.zeros import moments


def qc_cells(x: DataFrame, obs: DataFrame, var: DataFrame, flags: list[str] = (), tops: list[int] = ()) -> DataFrame:
    """Per cell: genes, total, log1p of both, share of the top N genes, total and share of flagged genes."""
    x = x.where("value <> 0")
    if flags:
        x = x.join(F.broadcast(var.select("gene_id", *flags)), "gene_id")
    if tops:
        x = x.withColumn("_k", F.row_number().over(Window.partitionBy("cell_id").orderBy(F.col("value").desc(), "gene_id")))
    v = F.col("value")
    t = x.groupBy("cell_id").agg(
        F.count("*").alias("n_genes_by_counts"), F.sum(v).alias("total_counts"),
        *(F.sum(F.when(F.col(f), v).otherwise(0.0)).alias(f"total_counts_{f}") for f in flags),
        *(F.sum(F.when(F.col("_k") <= n, v).otherwise(0.0)).alias(f"_top{n}") for n in tops),
    )
    t = obs.select("cell_id").join(t, "cell_id", "left").na.fill(0)
    total = F.col("total_counts")
    share = lambda c: F.when(total > 0, 100 * F.col(c) / total)
    return t.select(
        "cell_id", "n_genes_by_counts", "total_counts", F.log1p("n_genes_by_counts").alias("log1p_n_genes_by_counts"), F.log1p("total_counts").alias("log1p_total_counts"),
        *(share(f"_top{n}").alias(f"pct_counts_in_top_{n}_genes") for n in tops),
        *(c for f in flags for c in (F.col(f"total_counts_{f}"), share(f"total_counts_{f}").alias(f"pct_counts_{f}"))),
    )


def qc_genes(x: DataFrame, var: DataFrame, n_cells: int) -> DataFrame:
    t = x.where("value <> 0").groupBy("gene_id").agg(F.count("*").alias("n"), F.sum("value").alias("t"))
    t = var.select("gene_id").join(F.broadcast(t), "gene_id", "left").na.fill(0)
    return t.select(
        "gene_id", F.col("n").alias("n_cells_by_counts"), (F.col("t") / n_cells).alias("mean_counts"), F.log1p(F.col("t") / n_cells).alias("log1p_mean_counts"),
        (100 * (1 - F.col("n") / n_cells)).alias("pct_dropout_by_counts"), F.col("t").alias("total_counts"), F.log1p("t").alias("log1p_total_counts"),
    )


def are_counts(x: DataFrame) -> DataFrame:
    """(is_counts, n): whether every value is a non-negative whole number; all values are read."""
    v = F.col("value")
    return x.agg(F.coalesce(F.bool_and((v >= 0) & (v == F.floor(v))), F.lit(True)).alias("is_counts"), F.count("*").alias("n"))


def normalize_total(x: DataFrame, target: float | None = None, cells: DataFrame | None = None) -> DataFrame:
    """Each cell scaled to the target, by default the median of positive totals; with `cells` only those are scaled."""
    part = x if cells is None else x.join(cells.select("cell_id"), "cell_id", "left_semi")
    totals = part.groupBy("cell_id").agg(F.sum("value").alias("_t")).where("_t > 0")
    if target is None:
        goal = F.broadcast(totals.agg(F.median("_t").alias("_goal")))  # one row
        totals = totals.crossJoin(goal)
    else:
        totals = totals.withColumn("_goal", F.lit(float(target)))
    out = x.join(totals, "cell_id", "left")
    return out.select("cell_id", "gene_id", F.when(F.col("_t").isNull(), F.col("value")).otherwise(F.col("value") / F.col("_t") * F.col("_goal")).alias("value"))


def log1p(x: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    if cells is None:
        return x.select("cell_id", "gene_id", F.log1p("value").alias("value"))
    hit = cells.select("cell_id").distinct().withColumn("_on", F.lit(True))
    return x.join(hit, "cell_id", "left").select("cell_id", "gene_id", F.when(F.col("_on"), F.log1p("value")).otherwise(F.col("value")).alias("value"))


def log_normalized(x: DataFrame, target: float | None = None, once: bool = False) -> DataFrame:
    """The view that scores and displays read: totals normalised, then log1p. once: x, which totals, their median and rows read, is computed and written once."""
    return log1p(normalize_total(cut(x) if once else x, target))


def clip(values: DataFrame, percent: float) -> DataFrame:
    """(cell_id, value) cut off at the given percentile and its mirror; 0 or less cuts nothing."""
    if percent <= 0:
        return values
    q = F.broadcast(values.agg(F.percentile("value", percent / 100).alias("_a"), F.percentile("value", 1 - percent / 100).alias("_b")))  # one row
    return values.crossJoin(q).select("cell_id", F.least(F.greatest("value", "_a"), F.col("_b")).alias("value"))


def highly_variable(
    x: DataFrame, var: DataFrame, n_cells: int, flavor: str = "seurat", n_top: int | None = None, min_mean: float = 0.0125, max_mean: float = 3.0, min_disp: float = 0.5, n_bins: int = 20
) -> DataFrame:
    """(gene_id, means, dispersions, dispersions_norm, highly_variable) of log values.

    Moments count zeros in closed form. seurat bins log1p means at equal widths and normalises log dispersions by mean and
    deviation of their bin; cell_ranger bins at percentiles 10, 15, ... 100 and normalises by median and MAD.
    Everything after the moments is one row a gene, written once: sums of floats depend on the order in which parts meet, and a
    gene whose mean is itself a percentile has to be compared with that very number.
    """
    y = x.select("cell_id", "gene_id", F.expm1("value").alias("value"))
    m = moments(y, n_cells).select("gene_id", F.col("mean").alias("_mean"), (F.col("var") * n_cells / (n_cells - 1)).alias("_var"))
    g = var.select("gene_id").join(F.broadcast(m), "gene_id", "left").na.fill(0.0)
    mean = F.when(F.col("_mean") == 0, F.lit(1e-12)).otherwise(F.col("_mean"))
    g = cut(g.withColumn("_d", F.col("_var") / mean))
    one = Window.partitionBy()
    if flavor == "seurat":
        g = g.select("gene_id", F.log1p(mean).alias("means"), F.when(F.col("_d") > 0, F.log(F.col("_d"))).alias("dispersions"))
        lo, hi = F.min("means").over(one), F.max("means").over(one)
        width = (hi - lo) / n_bins
        g = g.withColumn("_bin", F.greatest(F.lit(1), F.least(F.lit(n_bins), F.ceil((F.col("means") - lo) / width))))
        bins = g.groupBy("_bin").agg(F.avg("dispersions").alias("_m"), F.stddev_samp("dispersions").alias("_s"))
        g = g.join(F.broadcast(bins), "_bin")
        alone = F.col("_s").isNull()
        norm = (F.col("dispersions") - F.when(alone, F.lit(0.0)).otherwise(F.col("_m"))) / F.when(alone, F.col("_m")).otherwise(F.col("_s"))
        g = g.withColumn("dispersions_norm", norm)
        rule = (F.col("means") > min_mean) & (F.col("means") < max_mean) & (F.col("dispersions_norm") > min_disp)
    elif flavor == "cell_ranger":
        g = g.select("gene_id", mean.alias("means"), F.col("_d").alias("dispersions"))
        cuts = g.agg(F.percentile("means", F.array(*(F.lit(p / 100) for p in range(10, 105, 5)))).alias("_q"))
        g = g.crossJoin(F.broadcast(cuts))  # one row
        g = g.withColumn("_bin", F.size(F.filter("_q", lambda q: q < F.col("means"))))
        med = g.groupBy("_bin").agg(F.median("dispersions").alias("_m"))
        g = g.join(F.broadcast(med), "_bin")
        mad = g.groupBy("_bin").agg((F.median(F.abs(F.col("dispersions") - F.col("_m"))) * 1.482602218505602).alias("_s"))
        g = g.join(F.broadcast(mad), "_bin").withColumn("dispersions_norm", F.when(F.col("_s") > 0, (F.col("dispersions") - F.col("_m")) / F.col("_s")))
        rule = (F.col("means") > min_mean) & (F.col("means") < max_mean) & (F.col("dispersions_norm") > min_disp)
    else:
        raise ValueError(f"flavor {flavor!r}")
    if n_top is not None:
        g = g.withColumn("_k", F.row_number().over(Window.orderBy(F.col("dispersions_norm").desc_nulls_last(), "gene_id")))  # one row a gene
        rule = (F.col("_k") <= n_top) & F.col("dispersions_norm").isNotNull()
    return g.select("gene_id", "means", "dispersions", "dispersions_norm", F.coalesce(rule, F.lit(False)).alias("highly_variable"))


def binned(values: DataFrame, column: str = "value", n: int = 60) -> DataFrame:
    """(bin, n): equal bins from least to largest value, the last closed; nulls skipped; one bin if all are equal."""
    v = values.where(F.col(column).isNotNull() & ~F.isnan(column)).select(F.col(column).alias("v"))
    r = F.broadcast(v.agg(F.min("v").alias("lo"), F.max("v").alias("hi")))  # one row
    place: Column = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.lit(n - 1), F.floor((F.col("v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / n))))
    return v.crossJoin(r).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def local_quadratic(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Locally weighted quadratic fit of y at each x (tricube weights over the nearest share of points)."""
    k = max(3, int(np.ceil(span * len(x))))
    out = np.empty(len(x))
    for i, c in enumerate(x):
        d = np.abs(x - c)
        near = np.argpartition(d, min(k, len(x)) - 1)[:k]
        w = np.sqrt((1 - np.minimum(d[near] / max(d[near].max(), 1e-12), 1) ** 3) ** 3 + 1e-12)
        z = np.vander(x[near] - c, 3, increasing=True)
        out[i] = np.linalg.lstsq(z * w[:, None], y[near] * w, rcond=None)[0][0]
    return out


def highly_variable_v3(x: DataFrame, var: DataFrame, n_cells: int, n_top: int = 2000, span: float = 0.3) -> DataFrame:
    """(gene_id, means, variances, variances_norm, highly_variable) of counts: variance of values scaled by the deviation that the
    mean predicts, cut at the root of the number of cells. The fit reads one row a gene; the scaled sums are Spark's.
    """
    m = moments(x, n_cells).select("gene_id", "mean", (F.col("var") * n_cells / (n_cells - 1)).alias("var"))
    g = var.select("gene_id").join(F.broadcast(m), "gene_id", "left").na.fill(0.0).orderBy("gene_id").toPandas()
    ok = (g["var"] > 0).to_numpy()
    reg = np.zeros(len(g))
    if ok.any():
        reg[ok] = np.sqrt(10 ** local_quadratic(np.log10(g["mean"][ok].to_numpy()), np.log10(g["var"][ok].to_numpy()), span))
    table = x.sparkSession.createDataFrame([(int(i), float(a), float(v), float(r)) for i, a, v, r in zip(g["gene_id"], g["mean"], g["var"], reg, strict=True)], "gene_id int, means double, variances double, _r double")
    cut = F.least("value", F.col("means") + n_cells**0.5 * F.col("_r"))
    sums = x.join(F.broadcast(table), "gene_id").groupBy("gene_id").agg(F.sum(cut).alias("_s"), F.sum(cut * cut).alias("_q"))
    j = table.join(F.broadcast(sums), "gene_id", "left").na.fill(0.0)
    norm = (n_cells * F.col("means") * F.col("means") + F.col("_q") - 2 * F.col("means") * F.col("_s")) / ((n_cells - 1) * F.col("_r") * F.col("_r"))
    j = j.withColumn("variances_norm", F.when(F.col("_r") > 0, norm).otherwise(F.lit(0.0)))
    k = F.row_number().over(Window.orderBy(F.col("variances_norm").desc(), "gene_id"))  # one row a gene
    return j.select("gene_id", "means", "variances", "variances_norm", ((k <= n_top) & (F.col("_r") > 0)).alias("highly_variable"))
