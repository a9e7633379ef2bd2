"""Zeros that a table of non-zeros leaves out: made explicit for few genes, or added in closed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matriq.lineage import cut
from matriq.operators.order import running

#: Genes that dense() takes at most; every cell gets a row for each.
MAX_DENSE = 2000


def dense(x: DataFrame, cells: DataFrame, genes: list[int]) -> DataFrame:
    """(cell_id, gene_id, value) with a row for each cell and listed gene. The gene list travels with the plan."""
    if len(genes) > MAX_DENSE:
        raise ValueError(f"{len(genes)} genes; dense() is for {MAX_DENSE} at most")
    ids = F.array(*(F.lit(g) for g in genes)) if genes else F.array().cast("array<int>")
    wide = cells.select("cell_id", F.explode(ids).alias("gene_id"))
    few = x.where(F.col("gene_id").isin(genes)).select("cell_id", "gene_id", "value")
    return wide.join(few, ["cell_id", "gene_id"], "left").select("cell_id", "gene_id", F.coalesce("value", F.lit(0.0)).alias("value"))


def moments(x: DataFrame, n: int | Column, by: str = "gene_id") -> DataFrame:
    """mean and population variance over n values of each group, absent ones being zero."""
    n = F.lit(n) if isinstance(n, int) else n
    g = x.groupBy(by).agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.count("*").alias("nnz"))
    mean = F.col("s1") / n
    return g.select(by, "nnz", mean.alias("mean"), (F.col("s2") / n - mean * mean).alias("var"))


def counted(x: DataFrame, n: int) -> DataFrame:
    """(gene_id, value, m): how often a gene with any value has each of its values among n cells; what the table leaves out counts as zeros."""
    steps = x.groupBy("gene_id", "value").agg(F.count("*").alias("m"))
    zero = steps.groupBy("gene_id").agg((F.lit(n) - F.sum(F.when(F.col("value") != 0, F.col("m")).otherwise(0))).alias("m"))
    return steps.where("value <> 0").union(zero.where("m > 0").select("gene_id", F.lit(0.0), "m"))


def average_rank(x: DataFrame, by: str, n: Column, descending: bool = False, small: bool = False) -> DataFrame:
    """x with column rank, the average rank among n non-negative values of which the rest are zeros.

    A zero's rank is (z + 1) / 2 ascending, nnz + (z + 1) / 2 descending, where z = n - nnz.
    Equal values of a group are counted first, so windows run over distinct values; a group's distinct values are cut into
    ranges, so no task has to hold them all. small: groups are many and each fits in a task, as the genes of a cell do.
    """
    if not small:
        x = cut(x)  # values meet their ranks by equality: both must see the same
    # Equal values share one row: groups with few distinct values stay small.
    steps = x.groupBy(by, "value").agg(F.count("*").alias("_m"))
    if small:
        w = Window.partitionBy(by).orderBy(F.col("value").desc() if descending else F.col("value").asc())
        steps = steps.withColumn("_upto", F.sum("_m").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_nnz", F.sum("_m").over(Window.partitionBy(by)))
    else:
        steps = running(steps, "value", "_m", [by], "_upto", descending, total="_nnz")
    steps = steps.withColumn("_r", F.col("_upto") - F.col("_m") + (F.col("_m") + 1) / 2).drop("_upto")
    shift = F.lit(0) if descending else n - F.col("_nnz")
    return x.join(steps.drop("_m"), [by, "value"]).withColumn("rank", F.col("_r") + shift).drop("_r", "_nnz")
