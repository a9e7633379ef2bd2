"""Matrix Market folders, prefixed trios and fine-grid slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matriq.dataset import Dataset
from matriq.lineage import cut
from matriq.operators.order import numbered


def read_trio(spark: SparkSession, matrix: str, barcodes: str, features: str) -> Dataset:
    """Counts in Matrix Market form, genes by cells, 1-based; gzip or plain. Repeated gene names get -1, -2, ...

    Each may be several files, which follow each other by name.
    """
    lines = spark.read.text(matrix).select(F.trim("value").alias("v"), F.col("_metadata.file_name").alias("f")).where(~F.col("v").startswith("%"))
    part = F.split("v", r"\s+")
    # The first line that is no remark gives the sizes. It goes once; an entry that happens to look like it stays.
    top = lines.agg(F.min("f")).first()[0]
    head = lines.where(F.col("f") == top).first()[0]
    lines = lines.select("v")
    again = lines.where(F.col("v") == head).count() - 1
    x = lines.where(F.col("v") != head).unionAll(spark.createDataFrame([(head,)] * again, "v string")).where(F.size(part) >= 3)
    x = x.select((part[1].cast("long") - 1).alias("cell_id"), (part[0].cast("int") - 1).alias("gene_id"), part[2].cast("double").alias("value")).where("value <> 0")
    obs = _numbered(spark, barcodes).select(F.col("n").alias("cell_id"), F.split("value", "\t")[0].alias("cell_name"))
    f = F.split("value", "\t")
    var = _numbered(spark, features).select(F.col("n").cast("int").alias("gene_id"), f[0].alias("gene_key"), F.when(F.size(f) > 1, f[1]).otherwise(f[0]).alias("_name"))
    k = F.row_number().over(Window.partitionBy("_name").orderBy("gene_id")) - 1
    var = var.select("gene_id", F.when(k == 0, F.col("_name")).otherwise(F.concat_ws("-", "_name", k.cast("string"))).alias("gene_name"), "gene_key")
    return Dataset(obs, var, {"X": x})


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their number, over files by name: read in parts, numbered within them, plus the lines of the parts before. Empty lines count and go."""
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", "\r$", "").alias("value"), F.col("_metadata.file_name").alias("_f"), F.col("_metadata.file_block_start").alias("_s"), F.monotonically_increasing_id().alias("_r"))
    return numbered(cut(lines), ["_f", "_s"], "_r", "n").where("rtrim(value) <> ''").select("n", "value")


def rebin(bins: DataFrame, factor: int, mask: DataFrame | None = None, size: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """((row, col, gene_id, value), (row, col, x, y)): fine-grid counts summed over squares of factor by factor.

    mask: (row, col) of coarse squares that are tissue; others go. x grows with the column, y falls with the row.
    """
    b = bins.groupBy(F.floor(F.col("row") / factor).cast("int").alias("row"), F.floor(F.col("col") / factor).cast("int").alias("col"), "gene_id").agg(F.sum("value").alias("value"))
    if mask is not None:
        b = b.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")
    cells = (mask.select("row", "col").distinct() if mask is not None else b.select("row", "col").distinct()).withColumn("x", F.col("col") * size).withColumn("y", -F.col("row") * size)
    return b, cells


def with_clusters(cells: DataFrame, clusters: DataFrame) -> DataFrame:
    """Cells with cluster labels; those without get NA."""
    return cells.join(clusters, ["row", "col"], "left").withColumn("cluster", F.coalesce(F.col("cluster").cast("string"), F.lit("NA")))
