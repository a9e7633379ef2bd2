"""Communities, layouts and gene-set clustering over graphs and profiles held in DataFrames."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matriq.functions import cluster as local
from matriq.lineage import cut, drop
from matriq.operators.communities import leiden, ranked
from matriq.operators.linear import MAX_GENES, gram
from matriq.operators.order import medians, running
from matriq.zeros import counted

#: Edges of a graph that the driver lays out; larger ones are contracted first.
MAX_EDGES = 1_000_000
#: Rounds that move the nodes of a contracted graph, nodes drawn for a round's repulsion, about, and how far apart contracted nodes start.
ROUNDS, DRAWN, JITTER = 16, 256, 0.5


def communities(edges: DataFrame, nodes: DataFrame, resolution: float = 1.0, seed: int = 0) -> DataFrame:
    """(cell_id, cluster): modularity communities (Leiden) as rounds of joins, numbered as text; the largest is 0."""
    return ranked(leiden(edges, nodes, resolution, seed))


def propagate(edges: DataFrame, nodes: DataFrame, rounds: int = 10) -> DataFrame:
    """(cell_id, cluster): each node takes the heaviest label of its neighbours and its own, the smallest of equals."""
    labels = nodes.select("cell_id", F.col("cell_id").alias("c"))
    loops = nodes.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(0.5).alias("w"))
    e = edges.select("src", "dst", "w").union(loops)
    for k in range(rounds):
        votes = e.join(labels, F.col("dst") == F.col("cell_id")).groupBy("src", "c").agg(F.sum("w").alias("w"))
        labels = votes.groupBy(F.col("src").alias("cell_id")).agg(F.max_by("c", F.struct("w", -F.col("c"))).alias("c"))
        if k % 3 == 2:
            labels = cut(labels)
    return labels.select("cell_id", F.col("c").cast("string").alias("cluster"))


def layout(edges: DataFrame, nodes: DataFrame, dims: int = 2, min_dist: float = 0.5, seed: int = 0) -> DataFrame:
    """(cell_id, v): a layout of the graph of edges (src, dst, w).

    A graph of more than MAX_EDGES edges is contracted until it has no more; that one is laid out on the driver. Then nodes start at the
    place of what they were contracted into, and attraction along edges and repulsion from a drawn sample move them, as rounds of joins.
    Nodes without edges are placed by a hash.
    """
    e = cut(edges.select("src", "dst", F.col("w").cast("double").alias("w")))
    levels: list[tuple[DataFrame, DataFrame]] = []
    while e.limit(MAX_EDGES + 1).count() > MAX_EDGES:
        into = cut(_leaders(e, seed, len(levels)))
        levels.append((e, into))
        ends = [into.select(F.col("u").alias(c), F.col("to").alias(f"_{c}")) for c in ("src", "dst")]
        e = cut(e.join(ends[0], "src").join(ends[1], "dst").where("_src <> _dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("w").alias("w")))
    names = [f"y{k}" for k in range(dims)]
    by = e.toPandas().sort_values(["src", "dst"])  # MAX_EDGES rows at most
    ids = np.union1d(by["src"], by["dst"]).astype(np.int64)
    places = local.layout(np.searchsorted(ids, by["src"]), np.searchsorted(ids, by["dst"]), by["w"].to_numpy(float), len(ids), dims, min_dist=min_dist, seed=seed) if len(ids) else np.zeros((0, dims))
    y = e.sparkSession.createDataFrame(pd.DataFrame({"u": ids} | {c: places[:, k] for k, c in enumerate(names)}), ", ".join(["u long", *(f"{c} double" for c in names)]))
    for k, (e_k, into) in reversed(list(enumerate(levels))):
        start = into.join(y.withColumnRenamed("u", "to"), "to", "left")
        start = cut(start.select("u", *((F.coalesce(c, _placed(c, seed, 20.0, "to")) + _placed(c, seed, JITTER)).alias(c) for c in names)))
        drop(y)
        y = _relaxed(e_k, start, names, 1.0 + 0.3 * (1 - min_dist), seed, k)
        drop(e_k, into)
    out = nodes.select(F.col("cell_id").cast("long").alias("cell_id")).join(y.withColumnRenamed("u", "cell_id"), "cell_id", "left")
    return out.select("cell_id", F.array(*(F.coalesce(c, _placed(c, seed, 20.0, "cell_id")) for c in names)).alias("v"))


def _placed(name: str, seed: int, width: float, of: str = "u") -> Column:
    """A number between -width / 2 and width / 2 by a hash of a node."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), of), F.lit(1 << 30)) / float(1 << 30) - 0.5) * width


def _leaders(e: DataFrame, seed: int, level: int) -> DataFrame:
    """(u, to): every node of the edges and the leader that it is contracted into.

    Leaders are one node in eight and those of higher hash than all they are linked to; others join the leader that they are linked
    to most, or stay alone without one.
    """
    high = lambda c: F.xxhash64(F.lit(seed), F.lit(f"leader {level}"), c)
    around = e.groupBy(F.col("src").alias("u")).agg(F.max(high("dst")).alias("_top"))
    every = e.select(F.explode(F.array("src", "dst")).alias("u")).distinct().join(around, "u", "left")
    lead = (F.pmod(high("u"), F.lit(8)) == 0) | F.col("_top").isNull() | (high("u") > F.col("_top"))
    every = cut(every.select("u", lead.alias("lead")))
    best = e.join(every.where("lead").select(F.col("u").alias("dst")), "dst").groupBy(F.col("src").alias("u")).agg(F.max_by("dst", F.struct("w", "dst")).alias("_to"))
    return every.join(best, "u", "left").select("u", F.when(F.col("lead"), F.col("u")).otherwise(F.coalesce("_to", "u")).alias("to"))


def _relaxed(e: DataFrame, y: DataFrame, names: list[str], b: float, seed: int, level: int) -> DataFrame:
    """y (u, coordinates) after ROUNDS rounds. A node goes by the mean pull of its edges, by weight, and the mean push of the drawn nodes."""
    n = y.count()
    pairs = [(F.col(f"_i{c}"), F.col(f"_j{c}")) for c in names]
    q = reduce(lambda a, c: a + c, [(i - j) * (i - j) for i, j in pairs])
    pull = -2 * b * F.pow(F.greatest(q, F.lit(1e-9)), F.lit(b - 1)) / (1 + F.pow(q, F.lit(b)))
    for r in range(ROUNDS):
        drawn = y.where(F.pmod(F.xxhash64(F.lit(seed), F.lit(f"drawn {level} {r}"), "u"), F.lit(-(-n // DRAWN))) == 0).limit(4 * DRAWN).toPandas()
        others, rate = drawn[names].to_numpy(float), 1.0 - r / ROUNDS
        ends = [y.select(F.col("u").alias(c), *(F.col(k).alias(f"_{i}{k}") for k in names)) for c, i in (("src", "i"), ("dst", "j"))]
        forces = [(F.sum(F.col("w") * pull * (i - j)) / F.sum("w")).alias(f"_f{c}") for (i, j), c in zip(pairs, names, strict=True)]
        pulled = e.join(ends[0], "src").join(ends[1], "dst").groupBy(F.col("src").alias("u")).agg(*forces)

        def move(batches: Iterator[pd.DataFrame], others: np.ndarray = others, rate: float = rate) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                at = pdf[names].to_numpy(float)
                push = np.zeros_like(at)
                for first in range(0, len(at) if len(others) else 0, 1024):
                    d = at[first : first + 1024, None] - others
                    q = (d * d).sum(2)[:, :, None]
                    push[first : first + 1024] = np.clip(2 * b / ((0.001 + q) * (1 + q**b)) * d, -4, 4).mean(1)
                at += rate * (pdf[[f"_f{c}" for c in names]].fillna(0.0).to_numpy(float) + push)
                yield pd.DataFrame({"u": pdf["u"]} | {c: at[:, k] for k, c in enumerate(names)})

        after = cut(y.join(pulled, "u", "left").mapInPandas(move, y.schema))
        drop(y)
        y = after
    return y


def gene_clusters(varp: DataFrame, var: DataFrame, resolution: float = 0.5, seed: int = 0) -> DataFrame:
    """(gene_id, cluster): communities of the symmetrised gene graph; genes without edges are unclustered."""
    half = cut(varp.select(F.col("gsrc").alias("src"), F.col("gdst").alias("dst"), (F.col("w") / 2).alias("w")))  # read four times, made once
    e = half.union(half.select("dst", "src", "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    nodes = e.select(F.col("src").alias("cell_id")).distinct()
    c = communities(e, nodes, resolution, seed).select(F.col("cell_id").cast("int").alias("gene_id"), "cluster")
    return var.select("gene_id").join(c, "gene_id", "left").select("gene_id", F.coalesce("cluster", F.lit("unclustered")).alias("cluster"))


def gene_modules(clusters: DataFrame) -> DataFrame:
    return clusters.where("cluster <> 'unclustered'").groupBy("cluster").agg(F.array_sort(F.collect_list("gene_id")).alias("genes"))


def kmeans(m: DataFrame, k: int, tries: int = 10, seed: int = 0) -> DataFrame:
    """(cell_id, cluster): the cheapest of several k-means runs; clusters numbered by their smallest cell."""
    data = m.select("cell_id", array_to_vector("v").alias("features"))
    models = [KMeans(k=k, seed=seed + i).fit(data) for i in range(tries)]
    best = min(models, key=lambda x: x.summary.trainingCost)
    out = best.transform(data).select("cell_id", F.col("prediction").alias("p"))
    first = sorted((r["f"], r["p"]) for r in out.groupBy("p").agg(F.min("cell_id").alias("f")).collect())  # k rows
    rank = m.sparkSession.createDataFrame([(p, i) for i, (_, p) in enumerate(first)], "p int, cluster int")
    return out.join(F.broadcast(rank), "p").select("cell_id", "cluster")


def gene_correlations(x: DataFrame, obs: DataFrame, genes: list[int], how: str = "pearson") -> np.ndarray:
    """Correlations of the listed genes (MAX_GENES at most) over all cells of obs, zeros included: pearson, spearman or bicor. Genes that don't vary have zeros.

    A transform of the values that is 0 for a zero keeps the matrix sparse, so products are summed over non-zeros: ranks, or
    biweighted deviations, less what a zero gets. Ranks, medians and deviations are running sums over distinct values, among which
    a gene's zeros are one. Medians and deviations are one row a gene.
    """
    n = obs.count()
    x = x.join(obs.select("cell_id"), "cell_id", "left_semi").where(F.col("gene_id").isin(genes)).select("cell_id", "gene_id", "value")
    base = np.zeros(len(genes))
    if how == "spearman":
        x = cut(x)  # values meet their ranks by equality: both must see the same
        r = running(counted(x, n), "value", "m", ["gene_id"], "_u").withColumn("rank", F.col("_u") - F.col("m") + (F.col("m") + 1) / 2)
        r = cut(r.select("gene_id", "value", "rank"))
        zero = r.where("value = 0").select("gene_id", F.col("rank").alias("_zero"))  # one row a gene; a gene without zeros loses nothing
        x = x.where("value <> 0").join(r, ["gene_id", "value"]).join(zero, "gene_id", "left").select("cell_id", "gene_id", (F.col("rank") - F.coalesce("_zero", F.lit(0.0))).alias("value"))
    elif how == "bicor":
        steps = cut(counted(x, n))
        mid = cut(medians(steps, ["gene_id"]).withColumnRenamed("median", "a"))
        off = steps.join(mid, "gene_id").groupBy("gene_id", F.abs(F.col("value") - F.col("a")).alias("value")).agg(F.sum("m").alias("m"))
        mean = steps.groupBy("gene_id").agg((F.sum(F.col("value") * F.col("m")) / n).alias("mean"))
        stats = medians(off, ["gene_id"]).join(mid, "gene_id").join(mean, "gene_id").toPandas().set_index("gene_id").reindex(genes).fillna(0.0)  # one row a gene; others are zero
        m, d, a = (stats[c].to_numpy(float) for c in ("a", "median", "mean"))
        u = -m / (9 * np.where(d > 0, d, 1))
        base = np.where(d > 0, np.where(np.abs(u) < 1, -m * (1 - u * u) ** 2, 0), -a)
        given = x.sparkSession.createDataFrame([(int(g), *map(float, r)) for g, r in zip(genes, zip(m, d, a, base, strict=True), strict=True)], "gene_id int, m double, d double, a double, b double")
        dev = F.col("value") - F.col("m")
        v = dev / (9 * F.col("d"))
        z = F.when(F.col("d") > 0, F.when(F.abs(v) < 1, dev * (1 - v * v) * (1 - v * v)).otherwise(0.0)).otherwise(F.col("value") - F.col("a"))
        x = x.join(F.broadcast(given), "gene_id").select("cell_id", "gene_id", (z - F.col("b")).alias("value"))
    elif how != "pearson":
        raise ValueError(f"correlation {how!r}")
    g, s = gram(x, genes)
    if how == "bicor":  # about the weighted deviations themselves, not their mean
        c = g + np.outer(base, s) + np.outer(s, base) + n * np.outer(base, base)
    else:
        c = g - np.outer(s, s) / max(n, 1)
    size = np.sqrt(np.maximum(np.diag(c), 0))
    varies = size > 1e-9 * max(size.max(initial=0), 1e-300)
    return np.where(np.outer(varies, varies), np.clip(c / np.outer(np.where(varies, size, 1), np.where(varies, size, 1)), -1, 1), 0.0)


def cluster_gene_set(x: DataFrame, obs: DataFrame, genes: list[int], method: str = "hierarchical", k: int = 3, eps: float = 0.5, corr: str | None = None, min_points: int = 3) -> DataFrame:
    """(gene_id, cluster) of a gene set of at most MAX_GENES, -1 for noise or none: hierarchical (Ward), kmeans, dbscan, or auto modules.

    Correlations are over all cells: those named, else bicor for auto and pearson for the others. kmeans runs on points whose
    inner products are the correlations, which are the standardised profiles but for a rotation.
    """
    if len(genes) > MAX_GENES:
        raise ValueError(f"more than {MAX_GENES} genes")
    spark = x.sparkSession
    c = gene_correlations(x, obs, genes, corr or ("bicor" if method == "auto" else "pearson"))
    d = np.maximum(1 - c, 0)
    if method == "hierarchical":
        label = local.cut(local.linkage(d, "ward"), len(d), k=k)
    elif method == "dbscan":
        label = local.dbscan(d, eps, min_points)
    elif method == "auto":
        plain = c if corr == "pearson" else gene_correlations(x, obs, genes)
        label = local.modules(c, local.coordinates(plain))
    elif method == "kmeans":
        m = spark.createDataFrame([(int(g), [float(q) for q in r]) for g, r in zip(genes, local.coordinates(c), strict=True)], "cell_id long, v array<double>")
        return kmeans(m, k).select(F.col("cell_id").cast("int").alias("gene_id"), F.col("cluster").cast("int").alias("cluster"))
    else:
        raise ValueError(f"method {method!r}")
    return spark.createDataFrame([(int(g), int(v)) for g, v in zip(genes, label, strict=True)], "gene_id int, cluster int")
