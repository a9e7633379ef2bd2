"""Gene sets and ligand-receptor pairs from and to files."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UP, DOWN = ("up", "positive"), ("down", "negative")


def read_library(spark: SparkSession, folder: str) -> DataFrame:
    """(bundle, set_name, direction, pos, gene) of every JSON file in a folder: an array of sets, or {"sets": [...]}.

    A set has a name and genes, or up and down lists (also positive, negative). Files that don't parse are left out.
    """

    def sets(name: str, text: str) -> list[tuple]:
        try:
            data = json.loads(text)
        except ValueError:
            return []
        rows = []
        for s in (data.get("sets", []) if isinstance(data, dict) else data):
            if not isinstance(s, dict) or not s.get("name"):
                continue
            lists = [("up", next((s[k] for k in ("genes", *UP) if s.get(k)), [])), ("down", next((s[k] for k in DOWN if s.get(k)), []))]
            rows += [(name, s["name"], d, i, g) for d, genes in lists for i, g in enumerate(genes)]
        return rows

    files = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("f"), "value")
    parse = F.udf(lambda f, v: sets(f.removesuffix(".json"), v), "array<struct<bundle:string,set_name:string,direction:string,pos:int,gene:string>>")
    return files.select(F.inline(parse("f", "value")))  # one call a file, not a row


def _directed(rows: DataFrame) -> DataFrame:
    """A name that ends in - or + gives the direction and loses the mark."""
    n = F.col("set_name")
    d = F.when(n.endswith("-"), "down").otherwise("up")
    return rows.withColumn("direction", d).withColumn("set_name", F.when(n.rlike("[+-]$"), F.trim(n.substr(F.lit(1), F.length(n) - 1))).otherwise(n))


def read_gmt(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, direction, pos, gene); lines of fewer than three fields are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(f) >= 3).select(F.trim(f[0]).alias("set_name"), F.posexplode(F.slice(f, F.lit(3), F.size(f) - 2)).alias("pos", "gene")).where(F.trim("gene") != "")
    return _directed(rows).select("set_name", "direction", "pos", F.trim("gene").alias("gene"))


def read_columns(spark: SparkSession, path: str, sep: str = ",", header: bool = True, name: str = "genes") -> DataFrame:
    """One list a column: (set_name, direction, pos, gene)."""
    df = spark.read.csv(path, sep=sep, header=header)
    names = df.columns if header else ([name] if len(df.columns) == 1 else [f"{name}_{i + 1}" for i in range(len(df.columns))])
    each = F.array(*(F.struct(F.lit(n).alias("set_name"), F.trim(F.col(f"`{c}`")).alias("gene")) for n, c in zip(names, df.columns, strict=True)))
    rows = df.select(F.monotonically_increasing_id().alias("pos"), F.inline(each)).where("gene IS NOT NULL AND gene <> ''")
    return _directed(rows).select("set_name", "direction", "pos", "gene")


def gmt_lines(sets: DataFrame) -> DataFrame:
    """(value): a line a set, name, direction, genes in order. Empty sets have no rows, so no line."""
    g = sets.groupBy("set_name", "direction").agg(F.array_sort(F.collect_list(F.struct("pos", "gene"))).alias("g"))
    return g.select(F.concat_ws("\t", F.col("set_name"), F.col("direction"), F.concat_ws("\t", F.col("g.gene"))).alias("value"))


def write_gmt(sets: DataFrame, path: str) -> None:
    gmt_lines(sets).write.mode("overwrite").text(path)


def write_long(sets: DataFrame, path: str) -> None:
    sets.write.mode("overwrite").csv(path, header=True, escape='"')


def sets_json(sets: Iterable[tuple[str, str, int, str]]) -> str:
    """JSON of (set_name, direction, pos, gene) rows; gene sets are what a person has made, so a driver's list."""
    out: dict[str, dict] = {}
    for name, direction, _, gene in sorted(sets):
        out.setdefault(name, {"name": name, "up": [], "down": []})[direction].append(gene)
    return json.dumps({"sets": list(out.values())})


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(interaction, ligand, receptor, type, classification): subunits joined by _ are parted; no type means diffusion."""
    df = spark.read.csv(path, header=True)
    has = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in df.columns else F.lit(other)
    name = F.col("interaction") if "interaction" in df.columns else F.concat_ws("_to_", "ligand", "receptor")
    return df.select(name.alias("interaction"), F.split("ligand", "_").alias("ligand"), F.split("receptor", "_").alias("receptor"), has("type", "diffusion").alias("type"), has("classification", "").alias("classification"))


class GeneSetStore:
    """Named text blobs for as long as the process lives."""

    def __init__(self) -> None:
        self._blobs: dict[str, str] = {}

    def get(self, name: str, other: str = "{}") -> str:
        return self._blobs.get(name, other)

    def put(self, name: str, blob: str) -> None:
        self._blobs[name] = blob
