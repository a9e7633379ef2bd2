"""A Dataset as a folder of Parquet tables, and exports of its parts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.dataset import Dataset

PARTS = ("layers", "obsm", "varm", "obsp", "varp")


def save(ds: Dataset, path: str) -> None:
    """Layers are laid out by gene, so that reading a few genes skips the rest; the list of parts is a one-row table."""
    ds.obs.write.mode("overwrite").parquet(f"{path}/obs")
    ds.var.write.mode("overwrite").parquet(f"{path}/var")
    for part in PARTS:
        for name, df in getattr(ds, part).items():
            if part == "layers":
                df = df.repartitionByRange("gene_id").sortWithinPartitions("gene_id", "cell_id")
            df.write.mode("overwrite").parquet(f"{path}/{part}/{name}")
    index = json.dumps({"parts": {p: sorted(getattr(ds, p)) for p in PARTS}, "uns": dict(ds.uns), "history": list(ds.history)})
    ds.obs.sparkSession.createDataFrame([(index,)], "index string").write.mode("overwrite").parquet(f"{path}/index")


def load(spark: SparkSession, path: str) -> Dataset:
    index = json.loads(spark.read.parquet(f"{path}/index").first()[0])
    parts = {p: {n: spark.read.parquet(f"{path}/{p}/{n}") for n in names} for p, names in index["parts"].items()}
    return Dataset(spark.read.parquet(f"{path}/obs"), spark.read.parquet(f"{path}/var"), parts["layers"], parts["obsm"], parts["varm"], parts["obsp"], parts["varp"], index["uns"], tuple(index["history"]))


def cached(spark: SparkSession, path: str, build) -> Dataset:
    """The Dataset stored at path, built and stored first if there is none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/index/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        save(build(), path)
    return load(spark, path)


def open_any(spark: SparkSession, path: str, form: str = "parquet") -> Dataset:
    """parquet: a stored Dataset; mtx: a folder with matrix.mtx, barcodes.tsv and features.tsv (gz or not)."""
    from matriq.sources.tenx import read_trio

    if form == "parquet":
        return load(spark, path)
    if form == "mtx":
        return read_trio(spark, *(f"{path}/{n}*" for n in ("matrix.mtx", "barcodes.tsv", "features.tsv")))
    raise ValueError(f"format {form!r}: parquet or mtx; convert other files to one of these first")


def with_counts(ds: Dataset) -> Dataset:
    """The layer counts, an alias of X, if X is all whole and non-negative and there is none yet."""
    v = F.col("value")
    whole = ds.x.agg(F.coalesce(F.bool_and((v >= 0) & (v == F.floor(v))), F.lit(True))).first()[0]
    return ds.with_part("layers", "counts", ds.x) if whole and "counts" not in ds.layers else ds


def export_annotations(obs: DataFrame, path: str, columns: list[str] | None = None) -> None:
    obs.select("cell_id", *(columns or [c for c in obs.columns if c != "cell_id"])).write.mode("overwrite").csv(path, sep="\t", header=True)


def with_lines(ds: Dataset, lines: dict[str, list[tuple[float, float]]], points: DataFrame) -> Dataset:
    """Lines in uns, and X_<line>_projection [position, distance] in obsm, as an export holds them."""
    from matriq.operators.geometry import project_on_line

    for name, line in lines.items():
        ds = ds.with_part("obsm", f"X_{name}_projection", project_on_line(points, line).select("cell_id", F.array("position", "distance").alias("v")))
    return ds.with_part("uns", "lines", {k: [list(p) for p in v] for k, v in lines.items()})
