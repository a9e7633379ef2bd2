"""Tests between groups, corrections, association with a line, and spatial autocorrelation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matriq.functions.special import f_tail, normal_two_sided, spline_basis, t_two_sided
from matriq.lineage import cut, drop
from matriq.operators.order import positions, running
from matriq.zeros import average_rank


@F.pandas_udf(T.DoubleType())
def normal_p(z: pd.Series) -> pd.Series:
    return pd.Series(normal_two_sided(z.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def t_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(a, b) if a == a and b == b else math.nan for a, b in zip(t, df, strict=True)])


@F.pandas_udf(T.DoubleType())
def f_p(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(a, b, c) if a == a else math.nan for a, b, c in zip(f, d1, d2, strict=True)])


def rank_sums(x: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene_id, group, rank_sum, n_group, n, ties) with zeros in closed form; one shuffle by gene serves every group.

    groups: (cell_id, label). x: non-negative non-zeros. Ranks are among all cells of groups.
    """
    sizes = groups.groupBy(F.col("label").alias("group")).agg(F.count("*").alias("n_group"))
    total = F.broadcast(groups.agg(F.count("*").alias("n")))  # one row
    inside = x.where("value > 0").join(groups, "cell_id").select("gene_id", "value", F.col("label").alias("group"))
    ranked = average_rank(inside.crossJoin(total), "gene_id", F.col("n"))
    per = ranked.groupBy("gene_id", "group").agg(F.sum("rank").alias("r"), F.count("*").alias("k"))
    nnz = inside.groupBy("gene_id").agg(F.count("*").alias("nnz"))
    every = F.broadcast(sizes).crossJoin(nnz).crossJoin(total)  # groups are the categories of one annotation
    zeros = F.col("n") - F.col("nnz")
    k = F.coalesce("k", F.lit(0))
    rank_sum = F.coalesce("r", F.lit(0.0)) + (F.col("n_group") - k) * (zeros + 1) / 2
    return every.join(per, ["gene_id", "group"], "left").select("gene_id", "group", rank_sum.alias("rank_sum"), "n_group", "n", k.alias("n_expressing"))


def wilcoxon(x: DataFrame, groups: DataFrame) -> DataFrame:
    """One against the rest, for every group: rank_sums with u and z (normal, no correction for ties)."""
    n1, n2 = F.col("n_group"), F.col("n") - F.col("n_group")
    u = F.col("rank_sum") - n1 * (n1 + 1) / 2
    z = (F.col("rank_sum") - n1 * (F.col("n") + 1) / 2) / F.sqrt(n1 * n2 * (F.col("n") + 1) / 12)
    return rank_sums(x, groups).withColumn("u", u).withColumn("z", F.when(n2 > 0, z))


def group_moments(x: DataFrame, groups: DataFrame) -> DataFrame:
    """(gene_id, group, n_group, mean, var, fraction): sample variance over all cells of a group, zeros included."""
    sizes = F.broadcast(groups.groupBy(F.col("label").alias("group")).agg(F.count("*").alias("n_group")))
    g = x.join(groups, "cell_id").groupBy("gene_id", F.col("label").alias("group")).agg(F.sum("value").alias("s1"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.count_if(F.col("value") > 0).alias("k"))
    every = x.select("gene_id").distinct().crossJoin(sizes)  # categories of one annotation
    g = every.join(g, ["gene_id", "group"], "left").na.fill(0)
    n, mean = F.col("n_group"), F.col("s1") / F.col("n_group")
    return g.select("gene_id", "group", "n_group", mean.alias("mean"), F.when(n > 1, (F.col("s2") - n * mean * mean) / (n - 1)).alias("var"), (F.col("k") / n).alias("fraction"))


def t_test(x: DataFrame, groups: DataFrame, group1: str, group2: str, overestimate: bool = False) -> DataFrame:
    """(gene_id, t, df, log2fc): Welch's test; overestimate takes the first group's size for both."""
    m = group_moments(x, groups.where(F.col("label").isin(group1, group2)))
    a = m.where(F.col("group") == group1).select("gene_id", F.col("mean").alias("m1"), F.col("var").alias("v1"), F.col("n_group").alias("n1"))
    b = m.where(F.col("group") == group2).select("gene_id", F.col("mean").alias("m2"), F.col("var").alias("v2"), F.col("n_group").alias("n2"))
    j = a.join(b, "gene_id")
    n2 = F.col("n1") if overestimate else F.col("n2")
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / n2
    t = F.when(s1 + s2 > 0, (F.col("m1") - F.col("m2")) / F.sqrt(s1 + s2))
    df = (s1 + s2) * (s1 + s2) / (s1 * s1 / (F.col("n1") - 1) + s2 * s2 / (n2 - 1))
    return j.select("gene_id", t.alias("t"), F.when(s1 + s2 > 0, df).alias("df"), log2fc(F.col("m1"), F.col("m2")).alias("log2fc"))


def logistic_scores(x: DataFrame, groups: DataFrame, group1: str, group2: str, strength: float = 1.0) -> DataFrame:
    """(gene_id, score): weights of a logistic regression of group1 against group2 on all genes at once, positive where group1 has more.

    The loss is the sum over cells plus half the squared weights over `strength`; the intercept is free. Gradients are sums over
    sparse rows of cells, the driver holds a few vectors of one number a gene. Genes without a value in either group have no row.
    """
    cells = groups.where(F.col("label").isin(group1, group2)).select("cell_id", (F.col("label") == group1).cast("double").alias("y"))
    few = x.where("value <> 0").join(cells.select("cell_id"), "cell_id", "left_semi")
    genes = sorted(r[0] for r in few.select("gene_id").distinct().collect())  # one row a gene
    place = few.sparkSession.createDataFrame([(g, i) for i, g in enumerate(genes)], "gene_id long, _i int")
    rows = few.join(place, "gene_id").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("_i", F.col("value").cast("double").alias("_v")))).alias("r"))
    size = len(genes)
    packed = F.udf(lambda i, v: Vectors.sparse(size, i or [], v or []), VectorUDT())
    data = cut(cells.join(rows, "cell_id", "left").select("y", packed("r._i", "r._v").alias("features")))
    n = data.count()
    if not size or data.select("y").distinct().count() < 2:
        return few.select("gene_id", F.lit(0.0).alias("score")).distinct()
    fit = LogisticRegression(labelCol="y", maxIter=1000, tol=1e-13, regParam=1 / (strength * n), standardization=False).fit(data)
    drop(data)
    return place.join(few.sparkSession.createDataFrame([(i, float(w)) for i, w in enumerate(fit.coefficients.toArray())], "_i int, score double"), "_i").select(F.col("gene_id").cast(x.schema["gene_id"].dataType), "score")


def log2fc(m1: Column, m2: Column) -> Column:
    """Fold change of log1p means."""
    return F.log2((F.expm1(m1) + 1e-9) / (F.expm1(m2) + 1e-9))


def adjust_bh(p: DataFrame, by: str | None = None, column: str = "p") -> DataFrame:
    """p with padj, Benjamini-Hochberg within each `by`: n p / rank, running minimum from the largest. One row a gene."""
    part = Window.partitionBy(by) if by else Window.partitionBy()
    k = F.row_number().over(part.orderBy(column))
    raw = p.withColumn("_q", F.col(column) * F.count("*").over(part) / k)
    low = F.min("_q").over(part.orderBy(F.col(column).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return raw.withColumn("padj", F.least(F.greatest(low, F.lit(0.0)), F.lit(1.0))).drop("_q")


def adjust_bh_spread(p: DataFrame, by: str, column: str = "p") -> DataFrame:
    """As adjust_bh, for groups of any size: equal p share a row, and running sums and minima are cut into ranges. Null p stay null and do not count."""
    steps = p.where(F.col(column).isNotNull()).groupBy(by, column).agg(F.count("*").alias("_m"))
    steps = running(steps, column, "_m", [by], "_k", total="_n").select(by, column, (F.col(column) * F.col("_n") / F.col("_k")).alias("_q"))
    low = running(steps, column, "_q", [by], "_low", descending=True, least=True)
    low = low.select(by, column, F.least(F.greatest("_low", F.lit(0.0)), F.lit(1.0)).alias("padj"))
    return p.join(low, [by, column], "left")


def adjust_bonferroni(p: DataFrame, column: str = "p") -> DataFrame:
    n = F.broadcast(p.agg(F.count("*").alias("_n")))  # one row
    return p.crossJoin(n).withColumn("padj", F.least(F.col(column) * F.col("_n"), F.lit(1.0))).drop("_n")


def differential(x: DataFrame, groups: DataFrame, group1: str, group2: str, method: str = "wilcoxon", correction: str = "benjamini-hochberg", top_n: int = 10, min_fold: float = 0.0, min_in: float = 0.0, max_out: float = 1.0, max_padj: float = 1.0) -> DataFrame:
    """Top genes up and down: gene_id, score, p, padj, log2fc, in_fraction, out_fraction, direction. logreg has scores alone; its p and padj are null."""
    # Both are read several times below, and what they come from is computed once.
    x, pair = cut(x.select("cell_id", "gene_id", "value")), cut(groups.where(F.col("label").isin(group1, group2)).select("cell_id", "label"))
    m = group_moments(x, pair)
    a = m.where(F.col("group") == group1).select("gene_id", F.col("mean").alias("m1"), F.col("fraction").alias("in_fraction"))
    b = m.where(F.col("group") == group2).select("gene_id", F.col("mean").alias("m2"), F.col("fraction").alias("out_fraction"))
    if method == "wilcoxon":
        s = wilcoxon(x, pair).where(F.col("group") == group1).select("gene_id", F.col("z").alias("score"), normal_p("z").alias("p"))
    elif method in ("t-test", "t-test_overestim_var"):
        s = t_test(x, pair, group1, group2, method.endswith("var")).select("gene_id", F.col("t").alias("score"), t_p("t", "df").alias("p"))
    elif method == "logreg":
        s = logistic_scores(x, pair, group1, group2).withColumn("p", F.lit(None).cast("double")).withColumn("padj", F.col("p"))
    else:
        raise ValueError(f"method {method!r}")
    if method != "logreg":
        s = s.where(F.col("p").isNotNull() & ~F.isnan("p"))
        s = adjust_bh(s) if correction == "benjamini-hochberg" else adjust_bonferroni(s)
    r = s.join(a, "gene_id").join(b, "gene_id").withColumn("log2fc", log2fc(F.col("m1"), F.col("m2"))).drop("m1", "m2")
    r = r.where((F.abs("log2fc") >= math.log2(min_fold) if min_fold > 0 else F.lit(True)) & (F.col("in_fraction") >= min_in) & (F.col("out_fraction") <= max_out) & (F.coalesce("padj", F.lit(0.0)) <= max_padj))
    up = r.where("log2fc > 0").orderBy(F.col("score").desc(), "gene_id").limit(top_n).withColumn("direction", F.lit("up"))
    return up.unionByName(r.where("log2fc < 0").orderBy("score", "gene_id").limit(top_n).withColumn("direction", F.lit("down")))


def markers(x: DataFrame, groups: DataFrame, top_n: int = 25, max_padj: float = 1.0, min_in: float = 0.0) -> DataFrame:
    """Top genes of each group against the rest: (group, k, gene_id, z, p, padj)."""
    w = wilcoxon(x, groups).where("z IS NOT NULL").withColumn("p", normal_p("z"))
    w = adjust_bh(w, "group").where((F.col("padj") <= max_padj) & (F.col("n_expressing") / F.col("n_group") >= min_in))
    k = F.row_number().over(Window.partitionBy("group").orderBy(F.col("z").desc(), "gene_id"))
    return w.withColumn("k", k).where(F.col("k") <= top_n).select("group", "k", "gene_id", "z", "p", "padj")


def spline_association(x: DataFrame, positions: DataFrame, n_knots: int = 5, top_n: int | None = None) -> DataFrame:
    """(gene_id, n, f, r2, p, padj, amplitude, direction): cubic B-spline of the position against a constant, for each gene.

    positions: (cell_id, t in 0..1), which may hold a cell more than once. The basis is computed where the rows are;
    X'X (b by b), X'y and y'y are sums; only these, b numbers a gene, are solved on workers by gene.
    """
    q = [i / (n_knots + 1) for i in range(1, n_knots + 1)]
    knots = positions.agg(F.percentile("t", F.array(*(F.lit(v) for v in q)))).first()[0]
    b = n_knots + 4

    def basis(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "t": pdf["t"], "z": list(spline_basis(pdf["t"].to_numpy(), np.array(knots)))})

    rows = positions.select("cell_id", "t").mapInPandas(basis, "cell_id long, t double, z array<double>")
    z = [F.col("z")[i] for i in range(b)]
    gram = rows.agg(F.count("*").alias("n"), *(F.sum(z[i] * z[j]).alias(f"g{i}_{j}") for i in range(b) for j in range(i, b)), F.sum("t").alias("st"), F.sum(F.col("t") * F.col("t")).alias("stt"), *(F.sum(F.col("t") * z[i]).alias(f"tz{i}") for i in range(b)), *(F.sum(z[i]).alias(f"sz{i}") for i in range(b))).first()
    n = gram["n"]
    g = np.array([[gram[f"g{min(i, j)}_{max(i, j)}"] for j in range(b)] for i in range(b)], float)
    inverse = np.linalg.pinv(g)
    tz, sz, st, stt = np.array([gram[f"tz{i}"] for i in range(b)], float), np.array([gram[f"sz{i}"] for i in range(b)], float), gram["st"], gram["stt"]
    grid = spline_basis(np.linspace(0, 1, 50), np.array(knots))
    per = x.join(rows, "cell_id").groupBy("gene_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.array(*(F.sum(F.col("value") * z[i]) for i in range(b))).alias("xy"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            xy = np.stack(pdf["xy"]) if len(pdf) else np.zeros((0, b))
            beta = xy @ inverse
            s, ss = pdf["s"].to_numpy(float), pdf["ss"].to_numpy(float)
            rss1, rss0 = np.maximum(ss - (beta * xy).sum(1), 0), ss - s * s / n
            d1, d2 = b - 1, n - b
            with np.errstate(divide="ignore", invalid="ignore"):
                f = (rss0 - rss1) / d1 / (rss1 / d2)
                fit = beta @ grid.T
                cov = beta @ tz - st * (beta @ sz) / n
                var = np.einsum("gi,ij,gj->g", beta, g, beta) - (beta @ sz) ** 2 / n
                direction = cov / np.sqrt((stt - st * st / n) * var)
                r2 = 1 - rss1 / rss0
            yield pd.DataFrame({"gene_id": pdf["gene_id"], "n": n, "f": f, "r2": r2, "d1": float(d1), "d2": float(d2), "amplitude": fit.max(1) - fit.min(1), "direction": direction, "profile": list(fit)})

    out = per.mapInPandas(solve, "gene_id int, n long, f double, r2 double, d1 double, d2 double, amplitude double, direction double, profile array<double>")
    out = adjust_bh(out.withColumn("p", f_p("f", "d1", "d2"))).drop("d1", "d2")
    out = out.withColumn("score", -F.log10(F.col("padj") + 1e-300) * F.col("amplitude"))
    return out if top_n is None else out.orderBy(F.col("score").desc(), "gene_id").limit(top_n)


def rising_and_falling(associated: DataFrame, level: float = 0.05, top_n: int = 50) -> DataFrame:
    """Significant genes of spline_association, the best by score of each direction: side is positive or negative."""
    ok = associated.where((F.col("padj") < level) & (F.col("direction") != 0)).withColumn("side", F.when(F.col("direction") > 0, "positive").otherwise("negative"))
    k = F.row_number().over(Window.partitionBy("side").orderBy(F.col("score").desc(), "gene_id"))  # one row a gene
    return ok.withColumn("k", k).where(F.col("k") <= top_n).drop("profile")


def pooled_positions(parts: list[tuple[DataFrame, bool]]) -> DataFrame:
    """(cell_id, t) of several lines, some reversed; a cell counts once for each line that it is on."""
    out = None
    for p, back in parts:
        one = p.select("cell_id", (1 - F.col("t") if back else F.col("t")).alias("t"))
        out = one if out is None else out.unionAll(one)
    return out


def varies(total: str, mean_part: Column) -> Column:
    """total - mean_part, a divisor; null where nothing but rounding is left."""
    return F.when(F.col(total) - mean_part > 1e-12 * F.col(total), F.col(total) - mean_part)


def edge_products(x: DataFrame, edges: DataFrame) -> DataFrame:
    """(gene_id, xx): sum of w xi xj over edges. Neighbours' values are summed a cell and gene first, so the second join is of non-zeros, not of edges times non-zeros."""
    near = edges.select("src", "dst", "w").join(x.select(F.col("cell_id").alias("dst"), "gene_id", "value"), "dst")
    near = near.groupBy(F.col("src").alias("cell_id"), "gene_id").agg(F.sum(F.col("w") * F.col("value")).alias("_lag"))
    return x.select("cell_id", "gene_id", "value").join(near, ["cell_id", "gene_id"]).groupBy("gene_id").agg(F.sum(F.col("value") * F.col("_lag")).alias("xx"))


def morans_i(x: DataFrame, edges: DataFrame, n_cells: int) -> DataFrame:
    """(gene_id, i) over weighted edges; zeros come in through the mean alone, so only non-zeros are joined.

    sum w zi zj = sum w xi xj - m (sum out_i xi + sum in_j xj) + m^2 W.
    """
    w = F.broadcast(edges.agg(F.sum("w").alias("ws")))  # one row
    out_w, in_w = edges.groupBy(F.col("src").alias("cell_id")).agg(F.sum("w").alias("ow")), edges.groupBy(F.col("dst").alias("cell_id")).agg(F.sum("w").alias("iw"))
    a = x.join(out_w, "cell_id", "left").join(in_w, "cell_id", "left").na.fill(0.0, ["ow", "iw"])
    side = a.groupBy("gene_id").agg((F.sum("value") / n_cells).alias("m"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.sum(F.col("value") * (F.col("ow") + F.col("iw"))).alias("lin"))
    prod = edge_products(x, edges)
    j = side.join(prod, "gene_id", "left").crossJoin(w)
    m = F.col("m")
    top = F.coalesce("xx", F.lit(0.0)) - m * F.col("lin") + m * m * F.col("ws")
    return j.select("gene_id", (n_cells / varies("ws", F.lit(0.0)) * top / varies("s2", n_cells * m * m)).alias("i"))


def gearys_c(x: DataFrame, edges: DataFrame, n_cells: int) -> DataFrame:
    """(gene_id, c): (N - 1) sum w (xi - xj)^2 / (2 W sum z^2), squares expanded so that zeros need no rows."""
    w = F.broadcast(edges.agg(F.sum("w").alias("ws")))  # one row
    degree = edges.select(F.col("src").alias("cell_id"), "w").union(edges.select("dst", "w")).groupBy("cell_id").agg(F.sum("w").alias("deg"))
    side = x.join(degree, "cell_id", "left").na.fill(0.0, ["deg"]).groupBy("gene_id").agg((F.sum("value") / n_cells).alias("m"), F.sum(F.col("value") * F.col("value")).alias("s2"), F.sum(F.col("value") * F.col("value") * F.col("deg")).alias("sq"))
    prod = edge_products(x, edges)
    top = F.col("sq") - 2 * F.coalesce("xx", F.lit(0.0))
    return side.join(prod, "gene_id", "left").crossJoin(w).select("gene_id", ((n_cells - 1) * top / (2 * varies("ws", F.lit(0.0)) * varies("s2", n_cells * F.col("m") * F.col("m")))).alias("c"))


def permuted(cells: DataFrame, seed: int, within: str | None = None, n: int = 1) -> DataFrame:
    """(perm, cell_id, other): n permutations of cells, within each value of a column if given, by hashes of (id, number, seed).

    The number of the permutation is a column, so that any number of them is one plan.
    """
    by = ["perm", *([within] if within else [])]
    many = cells.select("cell_id", *by[1:]).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(n))))
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("cell_id").cast("string"), F.col("perm").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
    a = positions(many, "cell_id", "cell_id", by)
    hashed = cut(many.select(F.col("cell_id").alias("other"), *by, digest.alias("_h")))  # else each cut between ranges takes the digest anew
    b = positions(hashed, "_h", "other", by)
    return a.join(b, [*by, "_k"]).select("perm", "cell_id", "other")


def edge_moments(edges: DataFrame) -> DataFrame:
    """One row (s0, s1, s2): sums of weights, of squares of both directions' weights together (half), and of squares of nodes' weights in and out."""
    e = edges.select("src", "dst", "w")
    both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg(F.sum("w").alias("w"))
    nodes = both.groupBy("src").agg(F.sum("w").alias("_n"), F.sum(F.col("w") * F.col("w")).alias("_q"))
    return nodes.agg((F.sum("_n") / 2).alias("s0"), (F.sum("_q") / 2).alias("s1"), F.sum(F.col("_n") * F.col("_n")).alias("s2"))


def autocorrelation_analytic(x: DataFrame, edges: DataFrame, n_cells: int, randomised: bool = True) -> DataFrame:
    """(gene_id, i, c, i_z, c_z, i_p, c_p): Moran's I and Geary's C with z and one-sided p, towards the side that z is on.

    Moments are Cliff and Ord's: under random placement of the values at hand, with their kurtosis, or for normal values. They
    need three sums over edges and a gene's first four moments, zeros included in closed form. Four cells at least; null
    where a gene does not vary.
    """
    n = float(n_cells)
    power = [F.sum(F.pow("value", F.lit(k))).alias(f"_p{k}") for k in (1, 2, 3, 4)]
    g = x.groupBy("gene_id").agg(*power)
    m = F.col("_p1") / n
    fourth = F.col("_p4") - 4 * m * F.col("_p3") + 6 * m * m * F.col("_p2") - 3 * n * m * m * m * m
    second = varies("_p2", n * m * m)
    g = g.select("gene_id", (n * fourth / (second * second)).alias("_b"))
    j = morans_i(x, edges, n_cells).join(gearys_c(x, edges, n_cells), "gene_id").join(g, "gene_id").crossJoin(F.broadcast(edge_moments(edges)))  # one row
    s0, s1, s2, b = (F.col(c) for c in ("s0", "s1", "s2", "_b"))
    mean = -1 / (n - 1)
    if randomised:
        square = (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0)
        c_var = (n - 1) * s1 * (n * n - 3 * n + 3 - (n - 1) * b) - (n - 1) * s2 * (n * n + 3 * n - 6 - (n * n - n + 2) * b) / 4 + s0 * s0 * (n * n - 3 - (n - 1) ** 2 * b)
        c_var = c_var / (n * (n - 2) * (n - 3) * s0 * s0)
    else:
        square = (n * n * s1 - n * s2 + 3 * s0 * s0) / ((n * n - 1) * s0 * s0)
        c_var = ((2 * s1 + s2) * (n - 1) - 4 * s0 * s0) / (2 * (n + 1) * s0 * s0)
    i_var = square - mean * mean
    j = j.select("gene_id", "i", "c", (F.when(i_var > 0, (F.col("i") - mean) / F.sqrt(i_var))).alias("i_z"), F.when(c_var > 0, (F.col("c") - 1) / F.sqrt(c_var)).alias("c_z"))
    return j.select("*", (normal_p("i_z") / 2).alias("i_p"), (normal_p("c_z") / 2).alias("c_p"))


def autocorrelation_test(x: DataFrame, edges: DataFrame, cells: DataFrame, n_cells: int, n_perms: int = 20, seed: int = 0, statistic: str = "i") -> DataFrame:
    """(gene_id, i or c, p, padj, spatially_variable): Moran's I, or Geary's C, and the share of permutations that reach it; null where a gene does not vary."""
    of, s = {"i": morans_i, "c": gearys_c}[statistic], F.col(statistic)
    real = of(x, edges, n_cells)
    moved = x.join(permuted(cells.select("cell_id"), seed, n=n_perms), "cell_id").select(F.col("other").alias("cell_id"), F.struct("gene_id", "perm").alias("gene_id"), "value")
    null = of(moved, edges, n_cells).select(F.col("gene_id.gene_id").alias("gene_id"), s.alias("_null"))
    reach = F.col("_null") >= s if statistic == "i" else F.col("_null") <= s
    out = real.join(null, "gene_id").groupBy("gene_id", statistic).agg(F.count_if(reach).alias("_c"))
    out = out.select("gene_id", statistic, F.when(s.isNotNull() & ~F.isnan(s), (F.col("_c") + 1) / (n_perms + 1)).alias("p"))
    fixed = out.where("p IS NULL").withColumn("padj", F.lit(None).cast("double"))
    side = s > 0 if statistic == "i" else s < 1
    return adjust_bh(out.where("p IS NOT NULL")).unionByName(fixed).withColumn("spatially_variable", (F.col("p") < 0.05) & side)


def spatially_variable(tested: DataFrame, statistic: str = "i", top_n: int = 50, level: float = 0.05) -> DataFrame:
    """Genes below the level, strongest first: largest Moran's I above 0, or smallest Geary's C below 1."""
    c = F.col(statistic)
    ok = c > 0 if statistic == "i" else c < 1
    return tested.where((F.col("p") < level) & ok).orderBy(c.desc() if statistic == "i" else c, "gene_id").limit(top_n)


def line_modules(associated: DataFrame, limit: int = 300) -> DataFrame:
    """(gene_id, shape, module) of at most `limit` best genes of spline_association, whose profiles are 50 numbers each."""
    from matriq.functions import profiles

    top = associated.orderBy(F.col("score").desc(), "gene_id").limit(limit).select("gene_id", "profile").toPandas()
    p = profiles.unit(np.stack(top["profile"])) if len(top) else np.zeros((0, 50))
    rows = [(int(g), s, int(m)) for g, s, m in zip(top["gene_id"], profiles.shapes(p) if len(p) else [], profiles.modules(p), strict=True)]
    return associated.sparkSession.createDataFrame(rows, "gene_id int, shape string, module int")
