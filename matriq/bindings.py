"""The test tables seen as annotated matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.dataset import Dataset


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _obs(spark: SparkSession, sf_dir: str, cells: DataFrame) -> DataFrame:
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    out = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    out = out.select(
        F.col("c_custkey").alias("cell_id"), F.col("c_name").alias("cell_name"), F.col("c_mktsegment").alias("segment"),
        F.col("c_acctbal").alias("acctbal"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"),
    )
    return out.join(cells, "cell_id", "left_semi")


def counts(spark: SparkSession, sf_dir: str, typed: bool = False) -> Dataset:
    """Customers by brands, values the quantity bought. typed: genes are type and brand, named type_brand."""
    part, lines, orders = (table(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    number = F.substring("p_brand", 7, 9).cast("int")
    kinds = F.array(*(F.lit(k) for k in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")))
    gene = (F.array_position(kinds, F.col("p_type")).cast("int") * 100 + number) if typed else number
    name = F.concat_ws("_", "p_type", "p_brand") if typed else F.col("p_brand")
    part = part.select("p_partkey", gene.cast("int").alias("gene_id"), name.alias("gene_name"))
    x = lines.select("l_orderkey", "l_partkey", "l_quantity").join(part.select("p_partkey", "gene_id"), F.col("l_partkey") == F.col("p_partkey"))
    x = x.join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.groupBy(F.col("o_custkey").alias("cell_id"), "gene_id").agg(F.sum("l_quantity").alias("value"))
    var = part.select("gene_id", "gene_name").distinct()
    cells = orders.select(F.col("o_custkey").alias("cell_id")).distinct()
    return Dataset(_obs(spark, sf_dir, cells), var, {"X": x})


def vectors(spark: SparkSession, sf_dir: str) -> Dataset:
    """Embedding vectors as cells, their elements as genes; the first two elements are coordinates, label % 3 the section."""
    e = table(spark, sf_dir, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    obs = e.select(F.col("vec_id").alias("cell_id"), F.col("label").cast("string").alias("label"), F.concat(F.lit("s"), F.col("label") % 3).alias("section"))
    x = e.select(F.col("vec_id").alias("cell_id"), F.posexplode("v").alias("gene_id", "value"))
    var = spark.range(64).select(F.col("id").cast("int").alias("gene_id"), F.concat(F.lit("e"), "id").alias("gene_name"))
    pca = e.select(F.col("vec_id").alias("cell_id"), "v")
    spatial = pca.select("cell_id", F.slice("v", 1, 2).alias("v"))
    return Dataset(obs, var, {"X": x}, {"X_vec": pca, "spatial": spatial})


def tokens(spark: SparkSession, sf_dir: str) -> Dataset:
    """Documents by lower-cased words; labels of some documents."""
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.col("doc_id").alias("cell_id"), F.explode(F.split(F.lower("text"), r"\W+")).alias("gene_name")).where("gene_name <> ''")
    n = words.groupBy("cell_id", "gene_name").agg(F.count("*").cast("double").alias("value"))
    # A hash names a gene without a global numbering, which would put all names in one task.
    x = n.select("cell_id", F.xxhash64("gene_name").alias("gene_id"), "value")
    var = n.select(F.xxhash64("gene_name").alias("gene_id"), "gene_name").distinct()
    obs = docs.select(F.col("doc_id").alias("cell_id"), "lang", "source").join(table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "cell_id"), "cell_id", "left")
    return Dataset(obs, var, {"X": x})


def activity(spark: SparkSession, sf_dir: str) -> Dataset:
    """Users by event types, values the number of events."""
    e = table(spark, sf_dir, "events")
    kinds = F.array(*(F.lit(k) for k in ("click", "error", "purchase", "signup", "view")))
    x = e.groupBy(F.col("user_id").alias("cell_id"), F.array_position(kinds, F.col("event_type")).cast("int").alias("gene_id")).agg(F.count("*").cast("double").alias("value"))
    return Dataset(e.select(F.col("user_id").alias("cell_id")).distinct(), e.select(F.array_position(kinds, F.col("event_type")).cast("int").alias("gene_id"), F.col("event_type").alias("gene_name")).distinct(), {"X": x})
