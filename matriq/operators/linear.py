"""Principal components, correlations and gene graphs. Sums over cells are Spark's; what is genes by genes is numpy's."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matriq.lineage import cut

#: Genes whose products meet in one matrix on the driver: 4000 x 4000 doubles are 128 MB.
MAX_GENES = 4000
#: Genes of a block and cells of a chunk in products(): a dense chunk by two blocks is at most about 32 MB.
GENE_BLOCK, CELL_CHUNK = 512, 4096
#: Numbers of a thin matrix of the driver (400 MB), non-zeros that a task multiplies at once, and columns of a basis beyond 2 k.
MAX_THIN, NON_ZEROS, MAX_BASIS = 50_000_000, 1 << 16, 400
#: Residual of an eigenvector, by the largest eigenvalue.
TOLERANCE = 1e-9


def gram(x: DataFrame, genes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """sum_c x_ci x_cj and sum_c x_ci over all cells, for the genes in order. Zeros add nothing, so non-zeros suffice.

    A cell's row is gathered (a row of at most len(genes) values) and products of a batch of rows are one matrix product;
    batches of a task add up before anything is sent.
    """
    if len(genes) > MAX_GENES:
        raise ValueError(f"{len(genes)} genes; at most {MAX_GENES}")
    order = np.argsort(genes, kind="stable")
    known, p = np.asarray(genes)[order], len(genes)
    rows = x.where(F.col("gene_id").isin(genes)).groupBy("cell_id").agg(F.collect_list(F.struct("gene_id", F.col("value").cast("double").alias("value"))).alias("r"))

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, s = np.zeros((p, p)), np.zeros(p)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                part = pdf.iloc[at : at + 512]
                z = np.zeros((len(part), p))
                row = np.repeat(np.arange(len(part)), part["g"].map(len).to_numpy())
                z[row, order[np.searchsorted(known, np.concatenate(part["g"].to_list()))]] = np.concatenate(part["v"].to_list())
                g += z.T @ z
                s += z.sum(0)
        yield pd.DataFrame({"i": np.arange(p), "row": list(g), "s": s})

    parts = rows.select(F.col("r.gene_id").alias("g"), F.col("r.value").alias("v")).mapInPandas(add, "i int, row array<double>, s double")
    total = parts.groupBy("i").agg(F.array(*(F.sum(F.col("row")[j]) for j in range(p))).alias("row"), F.sum("s").alias("s")) if p <= 128 else None
    if total is None:
        flat = parts.select("i", "s", F.posexplode("row").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("s").alias("s"))
        got = flat.toPandas()
        g = np.zeros((p, p))
        g[got["i"], got["j"]] = got["v"]
        s = np.zeros(p)
        s[got["i"]] = got["s"]
        return g, s
    g, s = np.zeros((p, p)), np.zeros(p)
    for r in total.collect():  # one row a gene
        g[r["i"]], s[r["i"]] = r["row"], r["s"]
    return g, s


def signed(v: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    top = np.abs(v).argmax(0)
    return v * np.where(v[top, np.arange(v.shape[1])] < 0, -1.0, 1.0)


def cell_rows(x: DataFrame, genes: list[int]) -> DataFrame:
    """(cell_id, g, v), written once: of each cell with non-zeros of the genes, their places in the list and their values."""
    index = x.sparkSession.createDataFrame(pd.DataFrame({"gene_id": np.asarray(genes, np.int64), "_g": np.arange(len(genes), dtype=np.int32)}))
    few = x.join(F.broadcast(index), "gene_id").where("value <> 0")  # one row a gene, MAX_THIN numbers at most
    rows = few.groupBy("cell_id").agg(F.collect_list(F.struct(F.col("_g").cast("int").alias("g"), F.col("value").cast("double").alias("v"))).alias("r"))
    return cut(rows.select("cell_id", F.col("r.g").alias("g"), F.col("r.v").alias("v")))


def covariance_times(rows: DataFrame, mean: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    """The covariance of all genes, over n cells, times a thin matrix w (genes by few), in one pass over the rows of cells.

    A task multiplies its cells' non-zeros with w, centres, and multiplies back: what leaves it is one thin matrix. As centred columns
    sum to 0, cells without non-zeros add nothing.
    """
    p, m = w.shape
    sent = rows.sparkSession.sparkContext.broadcast((w, mean @ w))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, shift = sent.value
        z = np.zeros((p, m))
        for batch in batches:
            size = np.diff(batch.column(0).offsets.to_numpy())
            g, v = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in (0, 1))
            ends = np.cumsum(size)
            first = 0
            while first < len(size):
                start = int(ends[first] - size[first])
                last = max(first + 1, int(np.searchsorted(ends, start + NON_ZEROS, "right")))
                part = slice(start, int(ends[last - 1]))
                row = np.repeat(np.arange(last - first), size[first:last])
                y = np.add.reduceat(v[part, None] * w[g[part]], ends[first:last] - size[first:last] - start) - shift
                order = np.argsort(g[part], kind="stable")
                gene = g[part][order]
                begin = np.flatnonzero(np.diff(gene, prepend=-1))
                z[gene[begin]] += np.add.reduceat((v[part, None] * y[row])[order], begin)
                first = last
        some = np.flatnonzero(z.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.ListArray.from_arrays(np.arange(len(some) + 1, dtype=np.int32) * m, z[some].ravel())], names=["i", "z"])

    parts = rows.select("g", "v").mapInArrow(add, "i int, z array<double>")
    got = parts.groupBy("i").agg(F.array(*(F.sum(F.col("z")[j]) for j in range(m))).alias("z")).toPandas()  # one row a gene
    out = np.zeros((p, m))
    if len(got):
        out[got["i"]] = np.stack(got["z"])
    return out / (n - 1)


def block_lanczos(times: Callable[[np.ndarray], np.ndarray], p: int, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues of a symmetric p by p matrix, falling, and their vectors, from products with thin matrices alone.

    A block Krylov space of random start grows until the residuals of k Ritz pairs are below TOLERANCE of the largest
    value, or it is invariant, or has MAX_BASIS columns more than 2 k; it is kept orthogonal in full.
    """
    width = min(p, k + 8)
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(p, width)))
    basis, image = np.zeros((p, 0)), np.zeros((p, 0))
    while True:
        z = times(q)
        basis, image = np.hstack([basis, q]), np.hstack([image, z])
        t = basis.T @ image
        values, s = np.linalg.eigh((t + t.T) / 2)
        values, s = values[::-1][:k], s[:, ::-1][:, :k]
        error = np.linalg.norm(image @ s - basis @ s * values, axis=0).max(initial=0)
        rest = z
        for _ in range(2):
            rest = rest - basis @ (basis.T @ rest)
        u, size, _ = np.linalg.svd(rest, full_matrices=False)
        q = u[:, size > 1e-12 * max(np.abs(values).max(initial=0), 1e-300)][:, : p - basis.shape[1]]
        q, _ = np.linalg.qr(q - basis @ (basis.T @ q))
        if error <= TOLERANCE * max(values.max(initial=0), 1e-300) and basis.shape[1] >= k or not q.shape[1] or basis.shape[1] >= 2 * k + MAX_BASIS:
            return np.maximum(values, 0), basis @ s


def pca(x: DataFrame, cells: DataFrame, genes: list[int], n_comps: int = 50) -> tuple[DataFrame, DataFrame, np.ndarray, np.ndarray]:
    """(scores (cell_id, v), loadings (gene_id, v), variance, ratio): centred, not scaled, for any number of genes.

    Components are the eigenvectors of the genes' covariance by block Lanczos: each step is one pass over the cells' non-zeros, and
    no genes-by-genes matrix is made; the driver holds genes by a few hundred columns. Scores are one pass more: a sum over a
    cell's non-zeros less the mean's part, so cells are never made dense.
    """
    n, p = cells.count(), len(genes)
    k = min(n_comps, min(n, p) - 1)
    if p * (3 * n_comps + MAX_BASIS) > MAX_THIN:
        raise ValueError(f"{p} genes by {n_comps} components; products of thin matrices are for {MAX_THIN} numbers at most")
    rows = cell_rows(x.join(cells.select("cell_id"), "cell_id", "left_semi"), genes)
    flat = rows.select(F.explode(F.arrays_zip("g", "v")).alias("e")).groupBy("e.g").agg(F.sum("e.v").alias("s"), F.sum(F.col("e.v") * F.col("e.v")).alias("q")).toPandas()  # one row a gene
    mean, square = np.zeros(p), np.zeros(p)
    mean[flat["g"]], square[flat["g"]] = flat["s"] / n, flat["q"]
    total = (square - n * mean * mean).sum() / max(n - 1, 1)
    values, vectors = block_lanczos(lambda w: covariance_times(rows, mean, n, w), p, k)
    vectors = signed(vectors)
    spark = x.sparkSession
    load = spark.createDataFrame([(int(gene), [float(c) for c in row]) for gene, row in zip(genes, vectors, strict=True)], "gene_id int, v array<double>")
    shift = vectors.T @ mean
    part = x.join(F.broadcast(load), "gene_id").groupBy("cell_id").agg(*(F.sum(F.col("value") * F.col("v")[i]).alias(f"_{i}") for i in range(k)))
    v = F.array(*(F.coalesce(F.col(f"_{i}"), F.lit(0.0)) - float(shift[i]) for i in range(k)))
    scores = cells.select("cell_id").join(part, "cell_id", "left").select("cell_id", v.alias("v"))
    return scores, load, values, values / max(total, 1e-300)


def top_loadings(load: DataFrame, top_n: int = 10) -> DataFrame:
    """(pc, side, k, gene_id, loading): the top genes of each component at both ends."""
    e = load.select("gene_id", F.posexplode("v").alias("pc", "loading")).where(~F.isnan("loading"))
    out = None
    for side, order in (("positive", F.col("loading").desc()), ("negative", F.col("loading").asc())):
        k = F.row_number().over(Window.partitionBy("pc").orderBy(order, "gene_id"))
        one = e.withColumn("k", k).where(F.col("k") <= top_n).select((F.col("pc") + 1).alias("pc"), F.lit(side).alias("side"), "k", "gene_id", "loading")
        out = one if out is None else out.union(one)
    return out


def drop_components(scores: DataFrame, drop: list[int]) -> DataFrame:
    """Scores without the components numbered (from 1) in drop."""
    return scores.select("cell_id", F.filter("v", lambda e, i: ~(i + 1).isin(drop)).alias("v"))


def subset_name(drop: list[int]) -> str:
    return "X_pca_noPC" + "_".join(map(str, sorted(drop)))


def elbow(ratio: np.ndarray, sensitivity: float = 1.0) -> int:
    """Index of the knee of a falling, convex curve, by Kneedle (Satopaa et al., 2011).

    Curve and index are scaled to 0..1; the gap between the flipped curve and the diagonal is greatest at a knee. A local
    maximum of the gap is one if, before the next, the gap falls by `sensitivity` mean steps of the index. The first counts,
    else the largest gap. Curves of fewer than three points, or flat ones, have their knee at the end.
    """
    y = np.asarray(ratio, float)
    n = len(y)
    if n < 3 or np.ptp(y) == 0:
        return max(n - 1, 0)
    x = np.linspace(0, 1, n)
    gap = (y.max() - y) / np.ptp(y) - x
    tops = [i for i in range(1, n - 1) if gap[i] > gap[i - 1] and gap[i] >= gap[i + 1]]
    for i, upto in zip(tops, [*tops[1:], n], strict=True):
        if gap[i:upto].min() < gap[i] - sensitivity * np.diff(x).mean():
            return i
    return int(gap.argmax())


def variance_table(ratio: np.ndarray) -> list[dict]:
    """Per component: number, share of variance, running sum, and whether it is the elbow."""
    e = elbow(ratio)
    return [{"pc": i + 1, "ratio": float(v), "cumulative": float(c), "elbow": i == e} for i, (v, c) in enumerate(zip(ratio, np.cumsum(ratio), strict=True))]


def products(x: DataFrame, n_genes: int, n_cells: int) -> DataFrame:
    """(a, b, xy): sum_c x_ca x_cb of gene pairs a < b that share a cell, as matrix products of blocks of genes over chunks of cells.

    A non-zero goes to every pair of blocks that its gene's block is in, so n_genes / GENE_BLOCK copies meet in place of a row for
    each pair of genes of a cell. A group is at most CELL_CHUNK cells, give or take, by two blocks; its sums leave it, one row a pair.
    """
    blocks, chunks = max(1, math.ceil(n_genes / GENE_BLOCK)), max(1, math.ceil(n_cells / CELL_CHUNK))
    mine = F.pmod(F.xxhash64("gene_id"), F.lit(blocks)).cast("int")
    chunk = F.pmod(F.xxhash64(F.col("cell_id"), F.lit("chunk")), F.lit(chunks)).cast("int")
    rows = x.select("cell_id", "gene_id", F.col("value").cast("double").alias("value"), mine.alias("blk"), chunk.alias("chunk"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumn("i", F.least("blk", "other")).withColumn("j", F.greatest("blk", "other")).drop("other")
    kind = dict(x.dtypes)["gene_id"]

    def multiply(group: pa.Table) -> pa.Table:
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        blk, value = group["blk"].to_numpy(), group["value"].to_numpy()
        cell, row = np.unique(group["cell_id"].to_numpy(), return_inverse=True)
        gene, col = np.unique(group["gene_id"].to_numpy(), return_inverse=True)
        side = np.zeros(len(gene), blk.dtype)
        side[col] = blk
        z = np.zeros((len(cell), len(gene)))
        np.add.at(z, (row, col), value)
        left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
        g = z[:, left].T @ z[:, right]
        u, v = np.nonzero(g)
        a, b, xy = gene[left[u]], gene[right[v]], g[u, v]
        keep = a < b if i == j else np.ones(len(a), bool)
        a, b, xy = a[keep], b[keep], xy[keep]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "xy": xy})

    parts = rows.groupBy("i", "j", "chunk").applyInArrow(multiply, f"a {kind}, b {kind}, xy double")
    return parts.groupBy("a", "b").agg(F.sum("xy").alias("xy"))


def correlation(x: DataFrame, n_cells: int, genes: DataFrame | None = None) -> DataFrame:
    """(a, b, r) Pearson of gene pairs, a < b. Products of non-zeros are block products; zeros come in through the means."""
    if genes is not None:
        x = x.join(F.broadcast(genes.select("gene_id")), "gene_id", "left_semi")
    s = F.broadcast(x.groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss")))
    xy = products(x, x.select("gene_id").distinct().count(), n_cells)
    every = s.select(F.col("gene_id").alias("a"), F.col("s").alias("sa"), F.col("ss").alias("ssa")).join(s.select(F.col("gene_id").alias("b"), F.col("s").alias("sb"), F.col("ss").alias("ssb")), F.col("a") < F.col("b"))
    j = every.join(xy, ["a", "b"], "left")
    top = F.coalesce("xy", F.lit(0.0)) - F.col("sa") * F.col("sb") / n_cells
    var = lambda q, t: F.col(q) - F.col(t) * F.col(t) / n_cells
    return j.select("a", "b", F.when((var("ssa", "sa") > 0) & (var("ssb", "sb") > 0), top / F.sqrt(var("ssa", "sa") * var("ssb", "sb"))).alias("r"))


def gene_neighbors(x: DataFrame, n_cells: int, k: int = 10, metric: str = "pearson") -> DataFrame:
    """(gsrc, gdst, d, w): each gene's k nearest by 1 - r, cosine or Euclidean distance over cells; w = 1 / (1 + d)."""
    if metric == "pearson":
        e = correlation(x, n_cells).select("a", "b", (1 - F.coalesce("r", F.lit(0.0))).alias("d"))
    else:
        s = F.broadcast(x.groupBy("gene_id").agg(F.sum(F.col("value") * F.col("value")).alias("ss")))
        xy = products(x, x.select("gene_id").distinct().count(), n_cells)
        j = s.select(F.col("gene_id").alias("a"), F.col("ss").alias("qa")).join(s.select(F.col("gene_id").alias("b"), F.col("ss").alias("qb")), F.col("a") < F.col("b")).join(xy, ["a", "b"], "left")
        dot = F.coalesce("xy", F.lit(0.0))
        d = 1 - dot / F.sqrt(F.col("qa") * F.col("qb")) if metric == "cosine" else F.sqrt(F.greatest(F.col("qa") + F.col("qb") - 2 * dot, F.lit(0.0)))
        e = j.select("a", "b", d.alias("d"))
    both = e.select(F.col("a").alias("gsrc"), F.col("b").alias("gdst"), "d").union(e.select("b", "a", "d"))
    r = F.row_number().over(Window.partitionBy("gsrc").orderBy("d", "gdst"))
    return both.withColumn("_r", r).where(F.col("_r") <= k).select("gsrc", "gdst", "d", (1 / (1 + F.col("d"))).alias("w"))


def gene_pca(x: DataFrame, n_cells: int, genes: list[int], n_comps: int = 20, scale: bool = True, auto: bool = False) -> tuple[DataFrame, np.ndarray]:
    """((gene_id, v), ratio): genes as rows. scale standardises each cell over the genes; auto keeps components to the elbow, 5 at least."""
    p = len(genes)
    x = x.where(F.col("gene_id").isin(genes))
    t = x.groupBy("cell_id").agg((F.sum("value") / p).alias("_m"), (F.sum(F.col("value") * F.col("value")) / p).alias("_q"))
    sd = F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)))
    if scale:
        # (x - m) / sd: products of centred columns follow from those of x / sd, so zeros stay left out.
        x = x.join(t, "cell_id").select("cell_id", "gene_id", F.when(sd > 0, F.col("value") / sd).otherwise(F.lit(0.0)).alias("value"))
    g, _ = gram(x, genes)
    centre = np.eye(p) - 1 / p
    k = centre @ g @ centre
    values, vectors = np.linalg.eigh(k)
    values, vectors = np.maximum(values[::-1], 0), signed(vectors[:, ::-1])
    ratio = values / max(values.sum(), 1e-300)
    m = min(n_comps, p - 1)
    if auto:
        m = min(m, max(5, elbow(ratio[:m]) + 1))
    v = vectors[:, :m] * np.sqrt(values[:m])
    rows = [(int(gene), [float(c) for c in r]) for gene, r in zip(genes, v, strict=True)]
    return x.sparkSession.createDataFrame(rows, "gene_id int, v array<double>"), ratio[:m]
