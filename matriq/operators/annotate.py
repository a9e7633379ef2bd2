"""Annotations, gene names, species, and gene sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNASSIGNED = "unassigned"


def create_annotation(obs: DataFrame, name: str, value: str = UNASSIGNED) -> DataFrame:
    if name in obs.columns:
        raise ValueError(f"{name!r} exists")
    return obs.withColumn(name, F.lit(value))


def label_cells(obs: DataFrame, name: str, label: str, cells: DataFrame) -> DataFrame:
    """obs in which the column has `label` for the given cells."""
    hit = cells.select("cell_id").distinct().withColumn("_hit", F.lit(True))
    return obs.join(hit, "cell_id", "left").withColumn(name, F.when(F.col("_hit"), F.lit(label)).otherwise(F.col(name))).drop("_hit")


def add_label(categories: list[str], label: str) -> list[str]:
    """Category lists live on the driver, since a category without cells is legal."""
    return categories if label in categories else [*categories, label]


def delete_annotation(obs: DataFrame, name: str) -> DataFrame:
    if name not in obs.columns:
        raise ValueError(f"no column {name!r}")
    return obs.drop(name)


def rename_label(obs: DataFrame, column: str, old: str, new: str, categories: list[str] | None = None) -> DataFrame:
    new = new.strip()
    if not new or (categories is not None and new != old and new in categories):
        raise ValueError(f"label {new!r} is empty or taken")
    c = F.col(column).cast("string")
    return obs.withColumn(column, F.when(c == old, F.lit(new)).otherwise(c))


def merge_labels(obs: DataFrame, column: str, labels: list[str], new: str) -> DataFrame:
    if len(set(labels)) < 2:
        raise ValueError("at least two labels are merged")
    c = F.col(column).cast("string")
    return obs.withColumn(column, F.when(c.isin(labels), F.lit(new)).otherwise(c))


def merged_categories(categories: list[str], labels: list[str], new: str) -> list[str]:
    """The merged label takes the place of the first of those merged."""
    gone = set(labels)
    at = next(i for i, c in enumerate(categories) if c in gone)
    return [new if i == at else c for i, c in enumerate(categories) if i == at or (c not in gone and c != new)]


def transfer_labels(obs: DataFrame, parent: str, source: str, mode: str = "replace", prefix: str = "", target: str | None = None) -> DataFrame:
    """The source label over the parent's, unless null or unassigned; as it is, behind the parent's, or behind a prefix."""
    p, s = F.col(parent).cast("string"), F.col(source).cast("string")
    new = {"replace": lambda: s, "parent_prefix": lambda: F.concat(p, F.lit("_"), s), "custom_prefix": lambda: F.concat(F.lit(prefix), s)}[mode]()
    return obs.withColumn(target or parent, F.when(s.isNull() | (s == UNASSIGNED), p).otherwise(new))


def case_convention(name: Column, convention: str) -> Column:
    """human: upper case; mouse: first letter upper, the rest lower."""
    if convention == "human":
        return F.upper(name)
    return F.concat(F.upper(F.left(name, F.lit(1))), F.lower(name.substr(F.lit(2), F.length(name))))


def gene_set_algebra(sets: DataFrame, operation: str) -> DataFrame:
    """sets: (set_no, pos, gene). union, intersection, difference (first less the others), symmetric (in an odd number); by first place."""
    n = sets.agg(F.countDistinct("set_no").alias("n"), F.min("set_no").alias("first"))
    g = sets.groupBy("gene").agg(F.min(F.struct("set_no", "pos")).alias("at"), F.countDistinct("set_no").alias("k"), F.min("set_no").alias("low"))
    g = g.crossJoin(F.broadcast(n))  # n is one row
    test = {"union": F.lit(True), "intersection": F.col("k") == F.col("n"), "difference": (F.col("k") == 1) & (F.col("low") == F.col("first")), "symmetric": F.col("k") % 2 == 1}[operation]
    return g.where(test).select("gene", F.col("at.set_no").alias("set_no"), F.col("at.pos").alias("pos"))


def flag_genes(var: DataFrame, name: str, pattern: str, mode: str = "prefix") -> DataFrame:
    c = F.col("gene_name")
    out = var.withColumn(name, c.startswith(pattern) if mode == "prefix" else c.rlike(pattern))
    if out.where(F.col(name)).isEmpty():
        raise ValueError("no gene matches")
    return out


def sum_pattern(x: DataFrame, obs: DataFrame, var: DataFrame, pattern: str, mode: str = "prefix") -> DataFrame:
    """(cell_id, total) of the genes whose name matches, zero where a cell has none."""
    c = F.col("gene_name")
    genes = var.where(c.startswith(pattern) if mode == "prefix" else c.rlike(pattern)).select("gene_id")
    t = x.join(F.broadcast(genes), "gene_id", "left_semi").groupBy("cell_id").agg(F.sum("value").alias("total"))
    return obs.select("cell_id").join(t, "cell_id", "left").select("cell_id", F.coalesce("total", F.lit(0.0)).alias("total"))


PREFIX = r"^(.+?_+)(?=.)"


def species_prefixes(var: DataFrame, min_fraction: float = 0.01) -> DataFrame:
    """(prefix, n): name prefixes up to an underscore that max(2, ceil(f G)) genes or more share; falling n, then prefix."""
    total = var.agg(F.count("*").alias("g"))
    p = var.select(F.regexp_extract("gene_name", PREFIX, 1).alias("prefix")).where("prefix <> ''").groupBy("prefix").agg(F.count("*").alias("n"))
    p = p.crossJoin(F.broadcast(total)).where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("g") * min_fraction)))  # total is one row
    return p.orderBy(F.col("n").desc(), "prefix").select("prefix", "n")


def species_column(var: DataFrame, prefixes: dict[str, str], name: str = "species", unknown: str = "unknown", overwrite: bool = True) -> DataFrame:
    """The label of the longest prefix that the gene name has. Prefixes are few, so they are part of the expression."""
    label = F.lit(unknown)
    for p, v in sorted(prefixes.items(), key=lambda kv: len(kv[0])):
        label = F.when(F.col("gene_name").startswith(p), F.lit(v)).otherwise(label)
    if name in var.columns and not overwrite:
        label = F.coalesce(F.col(name), label)
    return var.withColumn(name, label)


def species_counts(x: DataFrame, obs: DataFrame, var: DataFrame, labels: list[str], column: str = "species") -> DataFrame:
    """(cell_id, <label>_counts, ...): one conditional sum for each label."""
    t = x.join(F.broadcast(var.select("gene_id", column)), "gene_id").groupBy("cell_id")
    t = t.agg(*(F.sum(F.when(F.col(column) == s, F.col("value")).otherwise(0.0)).alias(f"{s}_counts") for s in labels))
    return obs.select("cell_id").join(t, "cell_id", "left").na.fill(0.0)


def assign_species(counts: DataFrame, labels: list[str], threshold: float = 0.9) -> DataFrame:
    """(cell_id, species, fraction): the first largest share, mixed below the threshold, unassigned without counts."""
    c = F.array(*(F.col(f"{s}_counts") for s in labels))
    total = reduce(lambda a, b: a + b, [F.col(f"{s}_counts") for s in labels])
    top = F.array_max(c)
    name = F.element_at(F.array(*(F.lit(s) for s in labels)), F.array_position(c, top).cast("int"))
    share = F.when(total > 0, top / total)
    return counts.select("cell_id", F.when(total <= 0, UNASSIGNED).when(share >= threshold, name).otherwise("mixed").alias("species"), share.alias("fraction"))


def rename_genes(var: DataFrame, pattern: str, to: str = "", regex: bool = True, make_unique: bool = False) -> DataFrame:
    """Names with the pattern replaced; blanks and repeats are errors, or get -1, -2, ... with make_unique. The old name stays."""
    name = F.regexp_replace("gene_name", pattern, to) if regex else F.replace(F.col("gene_name"), F.lit(pattern), F.lit(to))
    out = var.withColumn("_new", name)
    bad = out.groupBy("_new").agg(F.count("*").alias("n")).agg(F.count_if(F.trim("_new") == "").alias("blank"), F.count_if(F.col("n") > 1).alias("twice")).first()
    if bad["blank"] or (bad["twice"] and not make_unique):
        raise ValueError("renaming makes blank or repeated names")
    if make_unique:
        k = F.row_number().over(Window.partitionBy("_new").orderBy("gene_id")) - 1
        out = out.withColumn("_new", F.when(k == 0, F.col("_new")).otherwise(F.concat_ws("-", "_new", k.cast("string"))))
    old = [] if "original_name" in var.columns else [F.col("gene_name").alias("original_name")]
    return out.select("gene_id", F.col("_new").alias("gene_name"), *old, *(c for c in var.columns if c not in ("gene_id", "gene_name")))
