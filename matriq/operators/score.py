"""Expression, gene-set scores and rank-based scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matriq.operators.normalize import clip
from matriq.zeros import average_rank, dense

MAD_SCALE = 1.4826


def expression(x: DataFrame, obs: DataFrame, gene_id: int, clip_percent: float = 0.0) -> DataFrame:
    """(cell_id, value) of one gene for every cell, zeros included, optionally cut off at both percentiles."""
    v = obs.select("cell_id").join(x.where(F.col("gene_id") == gene_id).select("cell_id", "value"), "cell_id", "left")
    return clip(v.select("cell_id", F.coalesce("value", F.lit(0.0)).alias("value")), clip_percent)


def normalize_genes(d: DataFrame, how: str = "zscore_mad", clip_percent: float = 0.0) -> DataFrame:
    """d: (cell_id, gene_id, value), zeros included. Value per gene: none, zscore_mad, zscore_sd, minmax or rank.

    zscore_mad centres on the mean and scales by the MAD about the median, or the deviation where that is 0, or to 0.
    Statistics are one row a gene and go back by broadcast; d holds few genes.
    """
    v = F.col("value")
    if how == "none":
        return d.select("cell_id", "gene_id", "value")
    if how == "rank":
        n = d.groupBy("gene_id").agg(F.count("*").alias("_n"))
        return average_rank(d.join(F.broadcast(n), "gene_id"), "gene_id", F.col("_nnz")).select("cell_id", "gene_id", (F.col("rank") / F.col("_n")).alias("value"))
    if how == "minmax":
        q = [F.percentile(v, clip_percent / 100), F.percentile(v, 1 - clip_percent / 100)] if clip_percent > 0 else [F.min(v), F.max(v)]
        s = d.groupBy("gene_id").agg(q[0].alias("_a"), q[1].alias("_b"))
        held = F.least(F.greatest(v, F.col("_a")), F.col("_b"))
        out = F.when(F.col("_b") > F.col("_a"), (held - F.col("_a")) / (F.col("_b") - F.col("_a"))).otherwise(F.lit(0.0))
        return d.join(F.broadcast(s), "gene_id").select("cell_id", "gene_id", out.alias("value"))
    s = d.groupBy("gene_id").agg(F.avg(v).alias("_m"), F.stddev_pop(v).alias("_sd"), F.median(v).alias("_med"))
    if how == "zscore_sd":
        out = F.when(F.col("_sd") > 0, (v - F.col("_m")) / F.col("_sd")).otherwise(F.lit(0.0))
        return d.join(F.broadcast(s), "gene_id").select("cell_id", "gene_id", out.alias("value"))
    if how != "zscore_mad":
        raise ValueError(f"normalisation {how!r}")
    centred = d.join(F.broadcast(s), "gene_id")
    mad = centred.groupBy("gene_id").agg((F.median(F.abs(v - F.col("_med"))) * MAD_SCALE).alias("_mad"))
    scale = F.when(F.col("_mad") > 0, F.col("_mad")).when(F.col("_sd") > 0, F.col("_sd"))
    return centred.join(F.broadcast(mad), "gene_id").select("cell_id", "gene_id", F.coalesce((v - F.col("_m")) / scale, F.lit(0.0)).alias("value"))


def aggregate_genes(d: DataFrame, how: str = "mean") -> DataFrame:
    f = {"mean": F.avg, "median": F.median, "sum": F.sum, "max": F.max}[how]
    return d.groupBy("cell_id").agg(f(F.when(~F.isnan("value"), F.col("value"))).alias("value"))


def gene_set_score(x: DataFrame, obs: DataFrame, genes: list[int], norm: str = "zscore_mad", gene_clip: float = 0.0, aggregation: str = "mean", cell_clip: float = 0.0) -> DataFrame:
    """(cell_id, value): per-gene normalisation, then aggregation over the genes, then a cut at percentiles. No gene: zeros."""
    if not genes:
        return obs.select("cell_id", F.lit(0.0).alias("value"))
    d = normalize_genes(dense(x, obs, genes), norm, gene_clip)
    return clip(aggregate_genes(d, aggregation), cell_clip)


def bivariate(a: DataFrame, b: DataFrame, clip_percent: float = 1.0) -> DataFrame:
    """(cell_id, a, b): two scores, each cut off and rescaled to 0..1; a constant or null one is 0.5."""

    def unit(s: DataFrame, name: str) -> DataFrame:
        s = clip(s, clip_percent)
        r = F.broadcast(s.agg(F.min("value").alias("_lo"), F.max("value").alias("_hi")))  # one row
        v = F.when(F.col("_hi") > F.col("_lo"), (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
        return s.crossJoin(r).select("cell_id", F.coalesce(v, F.lit(0.5)).alias(name))

    return unit(a, "a").join(unit(b, "b"), "cell_id")


def score_matrix(x: DataFrame, obs: DataFrame, sets: dict[str, list[int]], norm: str = "zscore_mad", aggregation: str = "mean") -> tuple[DataFrame, list[str], list[str]]:
    """(cell_id, v) with an element for each set that has genes, the sets' names in order, and those skipped.

    All sets' genes are normalised once, in one pass; an element is an aggregate over its set's genes.
    """
    used = {k: v for k, v in sets.items() if v}
    if not used:
        raise ValueError("no set has genes")
    genes = sorted({g for v in used.values() for g in v})
    d = normalize_genes(dense(x, obs, genes), norm)
    f = {"mean": F.avg, "median": F.median, "sum": F.sum, "max": F.max}[aggregation]
    cols = [f(F.when(F.col("gene_id").isin(g), F.col("value"))).alias(f"_{i}") for i, g in enumerate(used.values())]
    out = d.groupBy("cell_id").agg(*cols).select("cell_id", F.array(*(F.col(f"_{i}") for i in range(len(used)))).alias("v"))
    return out, list(used), [k for k, v in sets.items() if not v]


def ucell(x: DataFrame, obs: DataFrame, n_genes: int, up: list[int], down: list[int] = (), max_rank: int = 1500, weight: float = 1.0) -> DataFrame:
    """(cell_id, value): max(U+ - weight U-, 0), U = 1 - (R - n(n+1)/2) / (n m - n(n+1)/2), R the sum of ranks cut at m.

    Ranks fall with the value within a cell, ties averaged; genes without a value share the rank of zeros.
    """
    if not up:
        return obs.select("cell_id", F.lit(0.0).alias("value"))
    m = min(max(max_rank, len(up), len(down), 1), n_genes)
    ranked = average_rank(x.where("value > 0").select("cell_id", "gene_id", "value"), "cell_id", F.lit(n_genes), descending=True, small=True)
    held = F.least(F.col("rank"), F.lit(float(m)))
    cols = [F.count("*").alias("_nnz")]
    for name, g in (("up", up), ("down", down)):
        mine = F.col("gene_id").isin(list(g))
        cols += [F.sum(F.when(mine, held).otherwise(0.0)).alias(f"_r_{name}"), F.count_if(mine).alias(f"_n_{name}")]
    t = obs.select("cell_id").join(ranked.groupBy("cell_id").agg(*cols), "cell_id", "left").na.fill(0)
    zero = F.least(F.col("_nnz") + (n_genes - F.col("_nnz") + 1) / 2, F.lit(float(m)))

    def u(name: str, n: int):
        low = n * (n + 1) / 2
        room = n * m - low
        r = F.col(f"_r_{name}") + (n - F.col(f"_n_{name}")) * zero
        return F.lit(1.0) if room <= 0 else 1 - (r - low) / room

    score = u("up", len(up)) - (weight * u("down", len(down)) if down else F.lit(0.0))
    return t.select("cell_id", F.greatest(score, F.lit(0.0)).alias("value"))
