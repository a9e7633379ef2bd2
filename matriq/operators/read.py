"""Projections, reads and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matriq.dataset import Dataset


def embedding_view(m: DataFrame, dim_x: int = 0, dim_y: int = 1, dim_z: int | None = None) -> DataFrame:
    """(cell_id, x, y[, z]) of an obsm table; an index out of range falls back to 0, 1 and 0."""
    size = F.size("v")
    pick = lambda d, other: F.element_at("v", F.when((F.lit(d) >= 0) & (F.lit(d) < size), F.lit(d)).otherwise(F.lit(other)) + 1)
    cols = [pick(dim_x, 0).alias("x"), pick(dim_y, 1).alias("y")]
    if dim_z is not None:
        cols.append(pick(dim_z, 0).alias("z"))
    return m.select("cell_id", *cols)


def embedding_from_obs(obs: DataFrame, col_x: str, col_y: str, log_axes: str = "none") -> DataFrame:
    """(cell_id, v) of two numeric columns, log1p of the axes named in log_axes ('none', 'x', 'y', 'both').

    A negative value on a log axis is an error, found before the table is made.
    """
    if log_axes not in ("none", "x", "y", "both"):
        raise ValueError(f"log_axes {log_axes!r}")
    kinds = {f.name: f.dataType for f in obs.schema.fields}
    for c in (col_x, col_y):
        if c not in kinds or not isinstance(kinds[c], T.NumericType | T.BooleanType):
            raise ValueError(f"{c!r} is no numeric column")
    logs = [c for c, a in ((col_x, "x"), (col_y, "y")) if log_axes in (a, "both")]
    if logs:
        low = obs.agg(*(F.min(c).alias(f"m{i}") for i, c in enumerate(logs))).first()
        if any(v is not None and v < 0 for v in low):
            raise ValueError("negative values on a log axis")
    axis = lambda c: (F.log1p(c) if c in logs else F.col(c).cast("double"))
    return obs.select("cell_id", F.array(axis(col_x), axis(col_y)).alias("v"))


def category_codes(obs: DataFrame, column: str, categories: list[str]) -> DataFrame:
    """(cell_id, label, code): the place in the category list, -1 for null or unlisted."""
    code = F.coalesce(F.array_position(F.array(*(F.lit(c) for c in categories)), F.col(column)), F.lit(0)) - 1
    return obs.select("cell_id", F.col(column).cast("string").alias("label"), code.cast("int").alias("code"))


def summarize_category(obs: DataFrame, column: str, categories: list[str] | None = None) -> DataFrame:
    """(label, n) by falling count, then label; with a category list also those that nothing has."""
    n = obs.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    if categories is not None:
        every = obs.sparkSession.createDataFrame([(c,) for c in categories], "label string")
        n = F.broadcast(every).join(n, "label", "left").select("label", F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    return n.orderBy(F.col("n").desc(), "label")


def summarize_numeric(obs: DataFrame, column: str) -> DataFrame:
    c = F.col(column).cast("double")
    return obs.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.count_if(c.isNull() | F.isnan(c)).alias("n_missing"))


def summarize_strings(obs: DataFrame, column: str, top: int = 50) -> DataFrame:
    return obs.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "label").limit(top)


def obsm_column(m: DataFrame, names: list[str], which: str) -> DataFrame:
    """One column of an obsm table, by registered name, else by number."""
    k = names.index(which) if which in names else int(which)
    return m.select("cell_id", F.element_at("v", k + 1).alias("value"))


def browse_genes(var: DataFrame, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of genes in case-insensitive order."""
    return var.orderBy(F.lower("gene_name"), "gene_id").offset(offset).limit(limit).select("gene_id", "gene_name")


def search_genes(var: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Case-insensitive prefix matches first, then other matches, each in gene order."""
    name, q = F.lower("gene_name"), query.lower()
    rank = F.when(name.startswith(q), 0).when(name.contains(q), 1)
    return var.withColumn("rank", rank).where("rank IS NOT NULL").orderBy("rank", "gene_id").limit(limit).select("gene_id", "gene_name", "rank")


def list_layers(ds: Dataset) -> DataFrame:
    """(layer, nnz, density) of each layer."""
    size = ds.obs.agg(F.count("*").alias("cells")).crossJoin(ds.var.agg(F.count("*").alias("genes")))  # two single rows
    out = None
    for name, x in ds.layers.items():
        one = x.where("value <> 0").agg(F.count("*").alias("nnz")).crossJoin(size)
        one = one.select(F.lit(name).alias("layer"), "cells", "genes", "nnz", (F.col("nnz") / (F.col("cells") * F.col("genes"))).alias("density"))
        out = one if out is None else out.union(one)
    return out


def list_graphs(ds: Dataset) -> DataFrame:
    """(graph, edges) of stored connectivities, in order of name."""
    out = None
    for name in sorted(n for n in ds.obsp if n == "connectivities" or n.endswith("_connectivities")):
        one = ds.obsp[name].agg(F.count("*").alias("edges")).select(F.lit(name).alias("graph"), "edges")
        out = one if out is None else out.union(one)
    return out if out is not None else ds.obs.sparkSession.createDataFrame([], "graph string, edges long")


def boolean_columns(var: DataFrame) -> DataFrame:
    """(column, n_true) of columns that are boolean, or numeric with no values but 0 and 1. One pass over var."""
    flags = [f.name for f in var.schema.fields if isinstance(f.dataType, T.BooleanType)]
    numbers = [f.name for f in var.schema.fields if isinstance(f.dataType, T.NumericType) and f.name != "gene_id"]
    stats = [F.struct(F.lit(c).alias("column"), F.sum(F.coalesce(F.col(c).cast("int"), F.lit(0))).cast("long").alias("n_true"), F.lit(True).alias("ok")) for c in flags]
    stats += [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c) == 1).alias("n_true"), F.coalesce(F.bool_and(F.col(c).isin(0, 1)), F.lit(False)).alias("ok")) for c in numbers]
    if not stats:
        return var.sparkSession.createDataFrame([], "column string, n_true long")
    return var.agg(F.array(*stats).alias("a")).select(F.inline("a")).where("ok").select("column", "n_true")


def column_to_genes(var: DataFrame, column: str) -> DataFrame:
    return var.where(F.col(column).cast("int") == 1).orderBy("gene_id").select("gene_id", "gene_name")


def identifier_columns(var: DataFrame, least: float = 0.9) -> DataFrame:
    """(column, n_unique) of string columns of which more than `least` of the rows are distinct."""
    text = [f.name for f in var.schema.fields if isinstance(f.dataType, T.StringType)]
    stats = [F.struct(F.lit(c).alias("column"), F.countDistinct(c).alias("n_unique"), F.count("*").alias("n")) for c in text]
    return var.agg(F.array(*stats).alias("a")).select(F.inline("a")).where(F.col("n_unique") > F.col("n") * least).select("column", "n_unique")


def swap_index(var: DataFrame, column: str, old: str = "previous_name") -> DataFrame:
    """The column becomes gene_name, the old name stays as `old`; repeated names get -1, -2, ... in gene order."""
    k = F.row_number().over(Window.partitionBy(column).orderBy("gene_id")) - 1
    new = F.when(k == 0, F.col(column).cast("string")).otherwise(F.concat_ws("-", F.col(column).cast("string"), k.cast("string")))
    rest = [c for c in var.columns if c not in ("gene_id", "gene_name", column)]
    return var.select("gene_id", new.alias("gene_name"), F.col("gene_name").alias(old), *rest)


def label_positions(m: DataFrame, obs: DataFrame, column: str) -> DataFrame:
    """(label, x, y, n): median place of each category; unassigned and null labels are left out."""
    xy = embedding_view(m).where(~F.isnan("x") & ~F.isnan("y"))
    named = obs.where(F.col(column).isNotNull() & (F.col(column) != "unassigned")).select("cell_id", F.col(column).alias("label"))
    return xy.join(named, "cell_id").groupBy("label").agg(F.median("x").alias("x"), F.median("y").alias("y"), F.count("*").alias("n"))
