"""Tests, corrections, markers, components and modules."""

from __future__ import annotations

from pyspark.sql import functions as F

from matriq import bindings
from matriq.operators import cluster, linear, normalize, stats
from matriq.plans.base import NORM, A, B, q6, query, r6
from matriq.plans.matrix import rounded

A_ = "WITH " + A
RANKS = f"""{A_}, n AS (SELECT count(*) AS n FROM obs), z AS (SELECT o.cell_id, o.segment, g.gene_id, coalesce(x.value, 0) AS v FROM obs o CROSS JOIN var g LEFT JOIN x ON x.cell_id = o.cell_id AND x.gene_id = g.gene_id),
r AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY v) + (count(*) OVER (PARTITION BY gene_id, v) - 1) / 2 AS r FROM z),
s AS (SELECT gene_id, segment AS "group", sum(r) AS rank_sum, count(*) AS n1, any_value(n) AS n, count(*) FILTER (v > 0) AS k FROM r, n GROUP BY 1, 2),
w AS (SELECT *, (rank_sum - n1 * (n + 1) / 2) / sqrt(n1 * (n - n1) * (n + 1) / 12) AS z FROM s)"""


def _groups(ds):
    return ds.obs.select("cell_id", F.col("segment").alias("label"))


@query("wilcoxon_rank_sum", f"{RANKS} SELECT gene_id, \"group\", {q6('rank_sum')} AS rank_sum, n1 AS n_group, {q6('rank_sum - n1 * (n1 + 1) / 2')} AS u, {q6('z')} AS z FROM w")
def wilcoxon_rank_sum(spark, d):
    ds = bindings.counts(spark, d)
    return stats.wilcoxon(ds.x, _groups(ds)).select("gene_id", "group", r6("rank_sum").alias("rank_sum"), "n_group", r6("u").alias("u"), r6("z").alias("z"))


@query("markers_one_vs_rest", f"{RANKS} SELECT \"group\", k, gene_id, {q6('z')} AS z FROM (SELECT \"group\", gene_id, z, row_number() OVER (PARTITION BY \"group\" ORDER BY round(z, 9) DESC, gene_id) AS k FROM w) WHERE k <= 5")
def markers_one_vs_rest(spark, d):
    ds = bindings.counts(spark, d)
    return stats.markers(ds.x, _groups(ds), 5).select("group", F.col("k").cast("long").alias("k"), "gene_id", r6("z").alias("z"))


GM = f"""{A_}, {NORM}, z AS (SELECT o.cell_id, o.segment, g.gene_id, coalesce(lx.value, 0) AS v FROM obs o CROSS JOIN var g LEFT JOIN lx ON lx.cell_id = o.cell_id AND lx.gene_id = g.gene_id),
m AS (SELECT gene_id, segment, avg(v) AS m, var_samp(v) AS v, count(*) AS n, avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS f FROM z GROUP BY 1, 2)"""


@query("group_moments", f"{GM} SELECT gene_id, segment AS \"group\", {q6('m')} AS mean, {q6('v')} AS var, {q6('f')} AS fraction FROM m")
def group_moments(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(stats.group_moments(normalize.log_normalized(ds.x), _groups(ds)).drop("n_group"), "gene_id", "group")


@query("ttest", f"{GM} SELECT a.gene_id, {q6('(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)')} AS t, {q6('log2((exp(a.m) - 1 + 1e-9) / (exp(b.m) - 1 + 1e-9))')} AS log2fc FROM m a JOIN m b USING (gene_id) WHERE a.segment = 'BUILDING' AND b.segment = 'MACHINERY'")
def ttest(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(stats.t_test(normalize.log_normalized(ds.x), _groups(ds), "BUILDING", "MACHINERY").drop("df"), "gene_id")


#: Two groups of log values by rank or by moments. Error function and incomplete beta as their series of positive terms.
PAIR = f"""{A_}, {NORM}, pr AS (SELECT * FROM obs WHERE segment IN ('BUILDING', 'MACHINERY')), n AS (SELECT count(*) AS n FROM pr),
z AS (SELECT o.cell_id, o.segment, g.gene_id, coalesce(lx.value, 0) AS v FROM pr o CROSS JOIN var g LEFT JOIN lx ON lx.cell_id = o.cell_id AND lx.gene_id = g.gene_id),
m AS (SELECT gene_id, segment, avg(v) AS m, var_samp(v) AS v, count(*) AS n, avg(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS f FROM z GROUP BY 1, 2),
ab AS (SELECT a.gene_id, log2((exp(a.m) - 1 + 1e-9) / (exp(b.m) - 1 + 1e-9)) AS fold, a.f AS i, b.f AS o, a.v / a.n AS s1, b.v / b.n AS s2, a.m - b.m AS gap, a.n AS n1, b.n AS n2
       FROM m a JOIN m b USING (gene_id) WHERE a.segment = 'BUILDING' AND b.segment = 'MACHINERY')"""
NORMAL_P = "CASE WHEN score = 0 THEN 1 WHEN abs(score) > 9 THEN 0 ELSE 1 - list_sum(list_transform(range(0, 200), lambda k: exp(-score * score / 2 + (2 * k + 1) * ln(abs(score) / sqrt(2)) - lgamma(k + 1.5)))) END"
T_P = "CASE WHEN y = 0 THEN 1 ELSE 1 - list_sum(list_transform(range(0, 400), lambda k: exp(lgamma(0.5 + h + k) - lgamma(1.5 + k) - lgamma(h) + (k + 0.5) * ln(y) + h * ln(1 - y)))) END"
ENDS = f"""e AS (SELECT q.*, fold, i, o FROM q JOIN ab USING (gene_id)),
k AS (SELECT *, 'up' AS direction, row_number() OVER (ORDER BY round(score, 9) DESC, gene_id) AS k FROM e WHERE fold > 0
      UNION ALL SELECT *, 'down', row_number() OVER (ORDER BY round(score, 9), gene_id) FROM e WHERE fold < 0)
SELECT gene_id, direction, {q6('score')} AS score, {q6('p')} AS p, {q6('padj')} AS padj, {q6('fold')} AS log2fc, {q6('i')} AS in_fraction, {q6('o')} AS out_fraction FROM k WHERE k <= 10"""


@query("diffexp", f"""{PAIR}, r AS (SELECT *, rank() OVER (PARTITION BY gene_id ORDER BY v) + (count(*) OVER (PARTITION BY gene_id, v) - 1) / 2 AS r FROM z),
w AS (SELECT gene_id, sum(r) AS rs, count(*) AS n1, any_value(n) AS n FROM r, n WHERE segment = 'BUILDING' GROUP BY 1),
s AS (SELECT gene_id, (rs - n1 * (n + 1) / 2) / sqrt(n1 * (n - n1) * (n + 1) / 12) AS score FROM w), p AS (SELECT *, {NORMAL_P} AS p FROM s),
b AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS bh FROM p), q AS (SELECT gene_id, score, p, least(1, greatest(0, min(bh) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING))) AS padj FROM b), {ENDS}""")
def diffexp(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(stats.differential(normalize.log_normalized(ds.x, once=True), _groups(ds), "BUILDING", "MACHINERY"), "gene_id", "direction")


@query("diffexp_scores", f"""{RANKS.replace("FROM obs)", "FROM obs WHERE segment IN ('BUILDING', 'MACHINERY'))").replace("FROM obs o", "FROM (SELECT * FROM obs WHERE segment IN ('BUILDING', 'MACHINERY')) o")},
f AS (SELECT gene_id, avg(CASE WHEN segment = 'BUILDING' THEN ln(1 + v) END) AS m1, avg(CASE WHEN segment = 'MACHINERY' THEN ln(1 + v) END) AS m2,
      avg(CASE WHEN segment = 'BUILDING' THEN CAST(v > 0 AS INT) END) AS i, avg(CASE WHEN segment = 'MACHINERY' THEN CAST(v > 0 AS INT) END) AS o FROM z GROUP BY 1),
j AS (SELECT gene_id, z AS score, log2((exp(m1) - 1 + 1e-9) / (exp(m2) - 1 + 1e-9)) AS fold, i, o FROM w JOIN f USING (gene_id) WHERE "group" = 'BUILDING'),
k AS (SELECT *, 'up' AS direction, row_number() OVER (ORDER BY round(score, 9) DESC, gene_id) AS k FROM j WHERE fold > 0
      UNION ALL SELECT *, 'down', row_number() OVER (ORDER BY round(score, 9), gene_id) FROM j WHERE fold < 0)
SELECT gene_id, direction, {q6('score')} AS score, {q6('fold')} AS log2fc, {q6('i')} AS in_fraction, {q6('o')} AS out_fraction FROM k WHERE k <= 10""")
def diffexp_scores(spark, d):
    """Differential expression of small counts, with what SQL has no error function for left out."""
    ds = bindings.counts(spark, d)
    x = ds.x.select("cell_id", "gene_id", F.log1p("value").alias("value"))
    out = stats.differential(x, _groups(ds), "BUILDING", "MACHINERY").drop("p", "padj")
    return rounded(out, "gene_id", "direction")


@query("diffexp_ttest", f"""{PAIR}, s AS (SELECT gene_id, gap / sqrt(s1 + s2) AS score, (s1 + s2) ** 2 / (s1 * s1 / (n1 - 1) + s2 * s2 / (n2 - 1)) AS df FROM ab WHERE s1 + s2 > 0),
p AS (SELECT *, {T_P} AS p FROM (SELECT *, score * score / (df + score * score) AS y, df / 2 AS h FROM s)), q AS (SELECT gene_id, score, p, least(1, p * count(*) OVER ()) AS padj FROM p), {ENDS}""")
def diffexp_ttest(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(stats.differential(normalize.log_normalized(ds.x, once=True), _groups(ds), "BUILDING", "MACHINERY", "t-test", "bonferroni"), "gene_id", "direction")


@query("diffexp_logreg")
def diffexp_logreg(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(stats.differential(normalize.log_normalized(ds.x, once=True), _groups(ds), "BUILDING", "MACHINERY", "logreg").drop("p", "padj"), "gene_id", "direction")


@query("bh_adjust", f"{A_}, p AS (SELECT cell_id, region, (abs(hash_p) % 1000 + 1) / 1001 AS p FROM (SELECT cell_id, region, (cell_id * 7919 + 13) % 100003 AS hash_p FROM obs)), k AS (SELECT *, p * count(*) OVER (PARTITION BY region) / row_number() OVER (PARTITION BY region ORDER BY p) AS q FROM p) SELECT cell_id, {q6('least(1, min(q) OVER (PARTITION BY region ORDER BY p DESC RANGE UNBOUNDED PRECEDING))')} AS padj FROM k")
def bh_adjust(spark, d):
    obs = bindings.counts(spark, d).obs
    p = obs.select("cell_id", "region", (((F.col("cell_id") * 7919 + 13) % 100003 % 1000 + 1) / 1001).alias("p"))
    return stats.adjust_bh(p, "region").select("cell_id", r6("padj").alias("padj"))


CORR = f"""{A_}, n AS (SELECT count(*) AS n FROM obs), s AS (SELECT gene_id, sum(value) AS s, sum(value * value) AS q FROM x GROUP BY 1),
p AS (SELECT a.gene_id AS a, b.gene_id AS b, sum(a.value * b.value) AS xy FROM x a JOIN x b ON a.cell_id = b.cell_id AND a.gene_id < b.gene_id GROUP BY 1, 2),
c AS (SELECT s.gene_id AS a, t.gene_id AS b, (coalesce(xy, 0) - s.s * t.s / n) / sqrt((s.q - s.s * s.s / n) * (t.q - t.s * t.s / n)) AS r FROM s JOIN s t ON s.gene_id < t.gene_id LEFT JOIN p ON p.a = s.gene_id AND p.b = t.gene_id, n),
e AS (SELECT a AS gsrc, b AS gdst, 1 - r AS d FROM c UNION ALL SELECT b, a, 1 - r FROM c), k AS (SELECT *, row_number() OVER (PARTITION BY gsrc ORDER BY d, gdst) AS k FROM e)"""


@query("gene_correlation", f"{CORR} SELECT a, b, {q6('r')} AS r FROM c")
def gene_correlation(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(linear.correlation(ds.x, ds.obs.count()), "a", "b")


@query("gene_knn", f"{CORR} SELECT gsrc, gdst, {q6('d')} AS d, {q6('1 / (1 + d)')} AS w FROM k WHERE k <= 4")
def gene_knn(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(linear.gene_neighbors(ds.x, ds.obs.count(), 4), "gsrc", "gdst")


@query("similar_genes", f"{CORR} SELECT gdst AS gene_id, {q6('1 / (1 + d)')} AS w FROM k WHERE gsrc = 7 AND k <= 3")
def similar_genes(spark, d):
    from matriq.operators.graph import similar_genes as similar

    ds = bindings.counts(spark, d)
    return rounded(similar(linear.gene_neighbors(ds.x, ds.obs.count(), 4), 7, 3), "gene_id")


def _pca(spark, d, k=5):
    ds = bindings.vectors(spark, d)
    return linear.pca(ds.x, ds.obs, list(range(64)), k)


@query("pca_variance")
def pca_variance(spark, d):
    _, _, _, ratio = _pca(spark, d)
    return spark.createDataFrame(linear.variance_table(ratio), "pc int, ratio double, cumulative double, elbow boolean").withColumn("ratio", r6("ratio")).withColumn("cumulative", r6("cumulative"))


@query("pca_scores")
def pca_scores(spark, d):
    s, _, _, _ = _pca(spark, d, 3)
    return s.select("cell_id", *(r6(F.col("v")[i]).alias(f"pc{i + 1}") for i in range(3)))


@query("pca_loadings_topk")
def pca_loadings_topk(spark, d):
    _, load, _, _ = _pca(spark, d, 3)
    return linear.top_loadings(load, 5).withColumn("loading", r6("loading"))


@query("pca_subset", f"WITH {B} SELECT cell_id, v[1] AS a, v[3] AS b, len(v)::INT - 2 AS n FROM e")
def pca_subset(spark, d):
    m = linear.drop_components(bindings.vectors(spark, d).obsm["X_vec"], [2, 5])
    return m.select("cell_id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.size("v").alias("n"))


@query("gene_pca")
def gene_pca(spark, d):
    ds = bindings.counts(spark, d)
    m, _ = linear.gene_pca(ds.x, ds.obs.count(), list(range(1, 26)), 5)
    return m.select("gene_id", *(r6(F.col("v")[i]).alias(f"pc{i + 1}") for i in range(5)))


@query("gene_set_correlation", f"""WITH {B}, v AS (SELECT cell_id, gene_id, value, rank() OVER (PARTITION BY gene_id ORDER BY value) + (count(*) OVER (PARTITION BY gene_id, value) - 1) / 2 AS r FROM x WHERE gene_id < 8)
SELECT a.gene_id AS a, b.gene_id AS b, {q6('corr(a.value, b.value)')} AS pearson, {q6('corr(a.r, b.r)')} AS spearman FROM v a JOIN v b USING (cell_id) GROUP BY 1, 2""")
def gene_set_correlation(spark, d):
    """Correlations of a gene set over all cells, by value and by rank."""
    ds, genes = bindings.vectors(spark, d), list(range(8))
    p, s = (cluster.gene_correlations(ds.x, ds.obs, genes, how) for how in ("pearson", "spearman"))
    rows = [(i, j, float(p[i, j]), float(s[i, j])) for i in genes for j in genes]
    return rounded(spark.createDataFrame(rows, "a int, b int, pearson double, spearman double"), "a", "b")


@query("gene_set_bicor", f"""{A_}, z AS (SELECT o.cell_id, g.gene_id, coalesce(x.value, 0) AS v FROM obs o CROSS JOIN var g LEFT JOIN x ON x.cell_id = o.cell_id AND x.gene_id = g.gene_id),
m AS (SELECT gene_id, median(v) AS m, avg(v) AS a FROM z GROUP BY 1), d AS (SELECT gene_id, median(abs(v - m)) AS d FROM z JOIN m USING (gene_id) GROUP BY 1),
w AS (SELECT cell_id, gene_id, CASE WHEN d = 0 THEN v - a WHEN abs(v - m) < 9 * d THEN (v - m) * (1 - ((v - m) / (9 * d)) ** 2) ** 2 ELSE 0 END AS w FROM z JOIN m USING (gene_id) JOIN d USING (gene_id)),
s AS (SELECT gene_id, sqrt(sum(w * w)) AS s FROM w GROUP BY 1), t AS (SELECT p.gene_id AS a, q.gene_id AS b, sum(p.w * q.w) AS t FROM w p JOIN w q USING (cell_id) GROUP BY 1, 2)
SELECT t.a, t.b, {q6('t / (p.s * q.s)')} AS bicor FROM t JOIN s p ON p.gene_id = t.a JOIN s q ON q.gene_id = t.b""")
def gene_set_bicor(spark, d):
    """Biweight midcorrelations of all genes over all cells, zeros included."""
    ds = bindings.counts(spark, d)
    genes = sorted(r["gene_id"] for r in ds.var.collect())  # one row a gene
    c = cluster.gene_correlations(ds.x, ds.obs, genes, "bicor")
    return rounded(spark.createDataFrame([(g, h, float(c[i, j])) for i, g in enumerate(genes) for j, h in enumerate(genes)], "a int, b int, bicor double"), "a", "b")


@query("gene_clusters")
def gene_clusters(spark, d):
    ds = bindings.counts(spark, d)
    return cluster.gene_clusters(linear.gene_neighbors(ds.x, ds.obs.count(), 4), ds.var)


@query("kmeans")
def kmeans(spark, d):
    return cluster.kmeans(bindings.vectors(spark, d).obsm["X_vec"], 5, tries=3)


for _m in ("hierarchical", "kmeans", "dbscan", "auto"):

    @query(f"gene_set_{_m}")
    def gene_set(spark, d, method=_m):
        ds = bindings.vectors(spark, d)
        return cluster.cluster_gene_set(ds.x, ds.obs, list(range(24)), method, k=4, eps=0.9)


@query("spline_f")
def spline_f(spark, d):
    from matriq.operators.geometry import project_on_line
    from matriq.operators.read import embedding_view
    from matriq.plans.spatial import LINE

    ds = bindings.vectors(spark, d)
    t = project_on_line(embedding_view(ds.obsm["spatial"]), LINE).select("cell_id", F.col("position").alias("t"))
    out = stats.spline_association(ds.x, t, 3)
    return rounded(out.select("gene_id", "f", "r2", "p", "padj", "amplitude", "direction"), "gene_id")


@query("line_modules")
def line_modules(spark, d):
    from matriq.operators.geometry import project_on_line
    from matriq.operators.read import embedding_view
    from matriq.plans.spatial import LINE

    ds = bindings.vectors(spark, d)
    t = project_on_line(embedding_view(ds.obsm["spatial"]), LINE).select("cell_id", F.col("position").alias("t"))
    return stats.line_modules(stats.spline_association(ds.x, t, 3), 40)


@query("hvg_v3", f"""{A_}, n AS (SELECT count(*) AS n FROM obs), mo AS (SELECT gene_id, m, (s2 - n * m * m) / (n - 1) AS v FROM (SELECT var.gene_id, coalesce(sum(value), 0) / any_value(n) AS m, coalesce(sum(value * value), 0) AS s2, any_value(n) AS n FROM var LEFT JOIN x USING (gene_id), n GROUP BY 1)),
pt AS (SELECT gene_id, log10(m) AS lx, log10(v) AS ly FROM mo WHERE v > 0), k AS (SELECT CAST(greatest(3, ceil(0.6 * count(*))) AS INT) AS k FROM pt),
nb AS (SELECT a.gene_id, b.lx - a.lx AS dx, b.ly, row_number() OVER (PARTITION BY a.gene_id ORDER BY abs(b.lx - a.lx), b.gene_id) AS r FROM pt a, pt b),
nw AS (SELECT gene_id, dx / h AS u, ly, (1 - least(abs(dx) / h, 1) ** 3) ** 3 + 1e-12 AS w FROM (SELECT *, greatest(max(abs(dx)) OVER (PARTITION BY gene_id), 1e-12) AS h FROM nb, k WHERE r <= k)),
s AS (SELECT gene_id, sum(w) AS a, sum(w * u) AS b, sum(w * u ** 2) AS c, sum(w * u ** 3) AS d, sum(w * u ** 4) AS e, sum(w * ly) AS p, sum(w * u * ly) AS q, sum(w * u * u * ly) AS r FROM nw GROUP BY 1),
rg AS (SELECT mo.gene_id, m, v, coalesce(sqrt(10 ** ((p * (c * e - d * d) - b * (q * e - d * r) + c * (q * d - c * r)) / (a * (c * e - d * d) - b * (b * e - d * c) + c * (b * d - c * c)))), 0) AS g FROM mo LEFT JOIN s USING (gene_id)),
cl AS (SELECT gene_id, sum(y) AS s1, sum(y * y) AS s2 FROM (SELECT gene_id, least(value, m + sqrt(n) * g) AS y FROM x JOIN rg USING (gene_id), n) GROUP BY 1)
SELECT gene_id, {q6('m')} AS means, {q6('v')} AS variances, {q6('CASE WHEN g > 0 THEN (n * m * m + coalesce(s2, 0) - 2 * m * coalesce(s1, 0)) / ((n - 1) * g * g) ELSE 0 END')} AS variances_norm FROM rg LEFT JOIN cl USING (gene_id), n""")
def hvg_v3(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(normalize.highly_variable_v3(ds.x, ds.var, ds.obs.count(), 8, 0.6).drop("highly_variable"), "gene_id")
