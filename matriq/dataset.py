"""An annotated matrix as DataFrames. Immutable: every with_*() returns a new Dataset."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from types import MappingProxyType
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _empty() -> Mapping:
    return MappingProxyType({})


@dataclass(frozen=True)
class Dataset:
    """obs (cell_id, ...), var (gene_id, gene_name, ...) and non-zeros (cell_id, gene_id, value) of each layer.

    obsm: (cell_id, v array<double>); varm: (gene_id, v); obsp: (src, dst, w); varp: (gsrc, gdst, w). uns is
    plain metadata. Layers share nothing but keys, so a snapshot of one is an alias, never a copy.
    """

    obs: DataFrame
    var: DataFrame
    layers: Mapping[str, DataFrame]
    obsm: Mapping[str, DataFrame] = field(default_factory=_empty)
    varm: Mapping[str, DataFrame] = field(default_factory=_empty)
    obsp: Mapping[str, DataFrame] = field(default_factory=_empty)
    varp: Mapping[str, DataFrame] = field(default_factory=_empty)
    uns: Mapping[str, Any] = field(default_factory=_empty)
    history: tuple[str, ...] = ()

    @property
    def x(self) -> DataFrame:
        return self.layers["X"]

    def layer(self, name: str | None = None) -> DataFrame:
        if name is None:
            return self.x
        if name not in self.layers:
            raise KeyError(f"no layer {name!r}; there are {sorted(self.layers)}")
        return self.layers[name]

    def with_part(self, part: str, name: str, value: Any) -> Dataset:
        """A new Dataset in which `name` of layers, obsm, varm, obsp, varp or uns is value."""
        return replace(self, **{part: MappingProxyType({**getattr(self, part), name: value})})

    def without_part(self, part: str, name: str) -> Dataset:
        if name not in getattr(self, part):
            raise KeyError(f"no {part} {name!r}")
        return replace(self, **{part: MappingProxyType({k: v for k, v in getattr(self, part).items() if k != name})})

    def with_obs(self, obs: DataFrame) -> Dataset:
        return replace(self, obs=obs)

    def with_var(self, var: DataFrame) -> Dataset:
        return replace(self, var=var)

    def logged(self, action: str) -> Dataset:
        return replace(self, history=(*self.history, action))

    def select_cells(self, cells: DataFrame) -> Dataset:
        """Only cells whose cell_id is in `cells`, in every part that has cells."""
        keep = cells.select("cell_id").distinct()
        ends = [keep.withColumnRenamed("cell_id", c) for c in ("src", "dst")]
        cut = lambda d: d.join(keep, "cell_id", "left_semi")
        return replace(
            self,
            obs=cut(self.obs),
            layers=MappingProxyType({k: cut(v) for k, v in self.layers.items()}),
            obsm=MappingProxyType({k: cut(v) for k, v in self.obsm.items()}),
            obsp=MappingProxyType({k: v.join(ends[0], "src", "left_semi").join(ends[1], "dst", "left_semi").select("src", "dst", "w") for k, v in self.obsp.items()}),
        )

    def select_genes(self, genes: DataFrame) -> Dataset:
        """Only genes whose gene_id is in `genes`, in every part that has genes."""
        keep = genes.select("gene_id").distinct()
        ends = [keep.withColumnRenamed("gene_id", c) for c in ("gsrc", "gdst")]
        cut = lambda d: d.join(keep, "gene_id", "left_semi")
        return replace(
            self,
            var=cut(self.var),
            layers=MappingProxyType({k: cut(v) for k, v in self.layers.items()}),
            varm=MappingProxyType({k: cut(v) for k, v in self.varm.items()}),
            varp=MappingProxyType({k: v.join(ends[0], "gsrc", "left_semi").join(ends[1], "gdst", "left_semi").select("gsrc", "gdst", "w") for k, v in self.varp.items()}),
        )


class Registry:
    """Named datasets of a session, and temporary views of their parts for SQL."""

    def __init__(self) -> None:
        self._slots: dict[str, Dataset] = {}

    def load(self, dataset: Dataset, slot: str = "primary", views: bool = True) -> Dataset:
        self._slots[slot] = dataset
        if views:
            dataset.obs.createOrReplaceTempView(f"{slot}_obs")
            dataset.var.createOrReplaceTempView(f"{slot}_var")
            for name, df in dataset.layers.items():
                df.createOrReplaceTempView(f"{slot}_{name.lower()}")
        return dataset

    def get(self, slot: str = "primary") -> Dataset:
        if slot not in self._slots:
            raise KeyError(f"no dataset in slot {slot!r}")
        return self._slots[slot]

    def names(self) -> list[str]:
        return sorted(self._slots)

    def unload(self, slot: str) -> None:
        self.get(slot)
        del self._slots[slot]


def schema(ds: Dataset) -> DataFrame:
    """One row for each part: part, name, rows, columns."""
    rows = [("obs", "obs", ds.obs), ("var", "var", ds.var)]
    rows += [(part, k, v) for part in ("layers", "obsm", "varm", "obsp", "varp") for k, v in getattr(ds, part).items()]
    out = None
    for part, name, df in rows:
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(part).alias("part"), F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"))
        out = one if out is None else out.union(one)
    return out


#: What must be there before an action: parts of the dataset by name.
NEEDS = {
    "neighbors": [("obsm", "X_pca")],
    "umap": [("obsp", "connectivities")],
    "leiden": [("obsp", "connectivities")],
    "pca_loadings": [("obsm", "X_pca"), ("varm", "PCs")],
    "find_similar_genes": [("varp", "gene_connectivities")],
    "cluster_genes": [("varp", "gene_connectivities")],
    "spatial_neighbors": [("obsm", "spatial")],
    "spatial_autocorr": [("obsp", "spatial_connectivities")],
    "contourize": [("obsm", "spatial")],
    "multicontour": [("obsm", "spatial")],
}


def missing(ds: Dataset, action: str) -> list[str]:
    """Names of parts that an action needs and the dataset lacks."""
    return [name for part, name in NEEDS.get(action, []) if name not in getattr(ds, part) and not (name == "spatial" and "X_spatial" in ds.obsm)]


def spatial_key(ds: Dataset) -> str | None:
    return next((k for k in ("spatial", "X_spatial") if k in ds.obsm), None)
