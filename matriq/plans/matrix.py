"""Quality, normalisation and scores over customers by brands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matriq import bindings
from matriq.operators import normalize, score
from matriq.plans.base import NORM, A, q6, query, r6

A_ = "WITH " + A
GENES = [3, 11, 20]
G = "(3, 11, 20)"


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """All but the keys rounded."""
    return df.select(*keys, *(r6(c).alias(c) for c in df.columns if c not in keys))


@query(
    "qc_cells",
    f"""{A_}, r AS (SELECT x.*, gene_id % 2 = 0 AS even, row_number() OVER (PARTITION BY cell_id ORDER BY value DESC, gene_id) AS k FROM x WHERE value <> 0),
t AS (SELECT obs.cell_id, count(value) AS n, coalesce(sum(value), 0) AS t, coalesce(sum(value) FILTER (k <= 5), 0) AS t5, coalesce(sum(value) FILTER (even), 0) AS e FROM obs LEFT JOIN r USING (cell_id) GROUP BY 1)
SELECT cell_id, {q6('n')} AS n_genes_by_counts, {q6('t')} AS total_counts, {q6('ln(1 + n)')} AS log1p_n_genes_by_counts, {q6('ln(1 + t)')} AS log1p_total_counts,
{q6('CASE WHEN t > 0 THEN 100 * t5 / t END')} AS pct_counts_in_top_5_genes, {q6('e')} AS total_counts_even, {q6('CASE WHEN t > 0 THEN 100 * e / t END')} AS pct_counts_even FROM t""",
)
def qc_cells(spark, d):
    ds = bindings.counts(spark, d)
    var = ds.var.withColumn("even", F.col("gene_id") % 2 == 0)
    return rounded(normalize.qc_cells(ds.x, ds.obs, var, ["even"], [5]), "cell_id")


@query(
    "qc_genes",
    f"""{A_}, c AS (SELECT count(*) AS m FROM obs), t AS (SELECT var.gene_id, count(value) AS n, coalesce(sum(value), 0) AS t FROM var LEFT JOIN x USING (gene_id) GROUP BY 1)
SELECT gene_id, {q6('n')} AS n_cells_by_counts, {q6('t / m')} AS mean_counts, {q6('ln(1 + t / m)')} AS log1p_mean_counts, {q6('100 * (1 - n / m)')} AS pct_dropout_by_counts, {q6('t')} AS total_counts, {q6('ln(1 + t)')} AS log1p_total_counts FROM t, c""",
)
def qc_genes(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(normalize.qc_genes(ds.x, ds.var, ds.obs.count()), "gene_id")


@query("counts_check", f"{A_} SELECT bool_and(value >= 0 AND value = floor(value)) AS is_counts, count(*) AS n FROM x")
def counts_check(spark, d):
    return normalize.are_counts(bindings.counts(spark, d).x)


@query("normalize_total", f"{A_}, {NORM} SELECT cell_id, gene_id, {q6('value')} AS value FROM nx")
def normalize_total(spark, d):
    return rounded(normalize.normalize_total(bindings.counts(spark, d).x), "cell_id", "gene_id")


@query("normalize_total_subset", f"{A_}, a AS (SELECT cell_id FROM obs WHERE region = 'ASIA'), t AS (SELECT cell_id, sum(value) AS t FROM x WHERE cell_id IN (SELECT cell_id FROM a) GROUP BY 1) SELECT cell_id, gene_id, {q6('CASE WHEN t IS NULL THEN value ELSE value / t * 10000 END')} AS value FROM x LEFT JOIN t USING (cell_id)")
def normalize_total_subset(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(normalize.normalize_total(ds.x, 10000, ds.obs.where("region = 'ASIA'")), "cell_id", "gene_id")


@query("log1p", f"{A_}, {NORM} SELECT cell_id, gene_id, {q6('value')} AS value FROM lx")
def log1p(spark, d):
    return rounded(normalize.log_normalized(bindings.counts(spark, d).x), "cell_id", "gene_id")


@query("log1p_subset", f"{A_} SELECT cell_id, gene_id, {q6('CASE WHEN cell_id IN (SELECT cell_id FROM obs WHERE region = $$ASIA$$) THEN ln(1 + value) ELSE value END')} AS value FROM x")
def log1p_subset(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(normalize.log1p(ds.x, ds.obs.where("region = 'ASIA'")), "cell_id", "gene_id")


MOMENTS = f"""{A_}, {NORM}, c AS (SELECT count(*) AS m FROM obs),
mo AS (SELECT var.gene_id, coalesce(sum(exp(value) - 1), 0) / any_value(m) AS mean, coalesce(sum((exp(value) - 1) * (exp(value) - 1)), 0) / any_value(m) AS sq, any_value(m) AS m FROM var LEFT JOIN lx USING (gene_id), c GROUP BY 1),
dd AS (SELECT gene_id, CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS mean, (sq - mean * mean) * m / (m - 1) / CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS d FROM mo)"""


@query(
    "hvg_seurat",
    f"""{MOMENTS}, g AS (SELECT gene_id, ln(1 + mean) AS means, CASE WHEN d > 0 THEN ln(d) END AS dispersions FROM dd),
r AS (SELECT min(means) AS lo, max(means) AS hi FROM g), b AS (SELECT g.*, greatest(1, least(20, ceil((means - lo) / ((hi - lo) / 20)))) AS bin FROM g, r),
s AS (SELECT bin, avg(dispersions) AS m, stddev_samp(dispersions) AS s FROM b GROUP BY 1),
n AS (SELECT b.*, (dispersions - CASE WHEN s.s IS NULL THEN 0 ELSE s.m END) / CASE WHEN s.s IS NULL THEN s.m ELSE s.s END AS dispersions_norm FROM b JOIN s USING (bin))
SELECT gene_id, {q6('means')} AS means, {q6('dispersions')} AS dispersions, {q6('dispersions_norm')} AS dispersions_norm, coalesce(means > 0.0125 AND means < 5 AND dispersions_norm > 0.5, false) AS highly_variable FROM n""",
)
def hvg_seurat(spark, d):
    ds = bindings.counts(spark, d)
    out = normalize.highly_variable(normalize.log_normalized(ds.x), ds.var, ds.obs.count(), max_mean=5)
    return rounded(out.drop("highly_variable"), "gene_id").join(out.select("gene_id", "highly_variable"), "gene_id")


@query(
    "hvg_cell_ranger",
    f"""{MOMENTS}, q AS (SELECT quantile_cont(mean, {[round(p / 100, 2) for p in range(10, 105, 5)]}) AS q FROM dd),
b AS (SELECT gene_id, mean, d, len([c for c in q if c < mean]) AS bin FROM dd, q), m AS (SELECT bin, median(d) AS m FROM b GROUP BY 1),
s AS (SELECT bin, median(abs(d - m)) * 1.482602218505602 AS s FROM b JOIN m USING (bin) GROUP BY 1),
n AS (SELECT b.*, CASE WHEN s > 0 THEN (d - m) / s END AS z FROM b JOIN m USING (bin) JOIN s USING (bin)), k AS (SELECT * FROM n)
SELECT gene_id, {q6('mean')} AS means, {q6('d')} AS dispersions, {q6('z')} AS dispersions_norm, coalesce(mean > 0.0125 AND z > 0.5, false) AS highly_variable FROM k""",
)
def hvg_cell_ranger(spark, d):
    ds = bindings.counts(spark, d)
    out = normalize.highly_variable(normalize.log_normalized(ds.x), ds.var, ds.obs.count(), flavor="cell_ranger", max_mean=1e9)
    return rounded(out.drop("highly_variable"), "gene_id").join(out.select("gene_id", "highly_variable"), "gene_id")


@query("expression_clip", f"{A_}, v AS (SELECT cell_id, coalesce(value, 0) AS v FROM obs LEFT JOIN (SELECT cell_id, value FROM x WHERE gene_id = 7) USING (cell_id)), q AS (SELECT quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM v) SELECT cell_id, {q6('least(greatest(v, a), b)')} AS value FROM v, q")
def expression_clip(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(score.expression(ds.x, ds.obs, 7, 5), "cell_id")


DENSE = f"{A_}, d AS (SELECT o.cell_id, g.gene_id, coalesce(x.value, 0) AS v FROM obs o CROSS JOIN (SELECT gene_id FROM var WHERE gene_id IN {G}) g LEFT JOIN x ON x.cell_id = o.cell_id AND x.gene_id = g.gene_id)"
MAD = """s AS (SELECT gene_id, avg(v) AS m, stddev_pop(v) AS sd, median(v) AS med FROM d GROUP BY 1),
a AS (SELECT gene_id, median(abs(v - med)) * 1.4826 AS mad FROM d JOIN s USING (gene_id) GROUP BY 1),
z AS (SELECT cell_id, gene_id, CASE WHEN mad > 0 THEN (v - m) / mad WHEN sd > 0 THEN (v - m) / sd ELSE 0 END AS value FROM d JOIN s USING (gene_id) JOIN a USING (gene_id))"""
NORMS = {
    "zscore_mad": f"{DENSE}, {MAD}",
    "zscore_sd": f"{DENSE}, s AS (SELECT gene_id, avg(v) AS m, stddev_pop(v) AS sd FROM d GROUP BY 1), z AS (SELECT cell_id, gene_id, CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0 END AS value FROM d JOIN s USING (gene_id))",
    "minmax": f"{DENSE}, s AS (SELECT gene_id, quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM d GROUP BY 1), z AS (SELECT cell_id, gene_id, CASE WHEN b > a THEN (least(greatest(v, a), b) - a) / (b - a) ELSE 0 END AS value FROM d JOIN s USING (gene_id))",
    "rank": f"{DENSE}, z AS (SELECT cell_id, gene_id, (rank() OVER (PARTITION BY gene_id ORDER BY v) + (count(*) OVER (PARTITION BY gene_id, v) - 1) / 2) / count(*) OVER (PARTITION BY gene_id) AS value FROM d)",
}
for _n, _s in NORMS.items():

    @query(f"norm_{_n}", f"{_s} SELECT cell_id, gene_id, {q6('value')} AS value FROM z")
    def norm(spark, d, how=_n):
        ds = bindings.counts(spark, d)
        return rounded(score.normalize_genes(score.dense(ds.x, ds.obs, GENES), how, 2 if how == "minmax" else 0), "cell_id", "gene_id")


for _a, _f in (("mean", "avg"), ("median", "median"), ("sum", "sum"), ("max", "max")):

    @query(f"score_{_a}", f"{DENSE}, {MAD} SELECT cell_id, {q6(f'{_f}(value)')} AS value FROM z GROUP BY 1")
    def score_(spark, d, how=_a):
        ds = bindings.counts(spark, d)
        return rounded(score.gene_set_score(ds.x, ds.obs, GENES, aggregation=how), "cell_id")


@query("score_clipped", f"{DENSE}, {MAD}, w AS (SELECT cell_id, avg(value) AS v FROM z GROUP BY 1), q AS (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM w) SELECT cell_id, {q6('least(greatest(v, a), b)')} AS value FROM w, q")
def score_clipped(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(score.gene_set_score(ds.x, ds.obs, GENES, cell_clip=1), "cell_id")


@query(
    "bivariate",
    f"""{A_}, w AS (SELECT cell_id, coalesce(sum(value) FILTER (gene_id IN (1, 2)), 0) / 2 AS a, coalesce(sum(value) FILTER (gene_id IN (5, 6)), 0) / 2 AS b FROM obs LEFT JOIN x USING (cell_id) GROUP BY 1),
q AS (SELECT quantile_cont(a, 0.01) AS a1, quantile_cont(a, 0.99) AS a2, quantile_cont(b, 0.01) AS b1, quantile_cont(b, 0.99) AS b2 FROM w), c AS (SELECT cell_id, least(greatest(a, a1), a2) AS a, least(greatest(b, b1), b2) AS b FROM w, q),
r AS (SELECT min(a) AS al, max(a) AS ah, min(b) AS bl, max(b) AS bh FROM c)
SELECT cell_id, {q6('coalesce(CASE WHEN ah > al THEN (a - al) / (ah - al) END, 0.5)')} AS a, {q6('coalesce(CASE WHEN bh > bl THEN (b - bl) / (bh - bl) END, 0.5)')} AS b FROM c, r""",
)
def bivariate(spark, d):
    ds = bindings.counts(spark, d)
    a, b = (score.gene_set_score(ds.x, ds.obs, g, "none") for g in ([1, 2], [5, 6]))
    return rounded(score.bivariate(a, b), "cell_id")


@query("score_matrix", f"{A_} SELECT cell_id, {q6('coalesce(sum(value) FILTER (gene_id IN (1, 2)), 0) / 2')} AS first, {q6('coalesce(sum(value) FILTER (gene_id IN (2, 5, 6)), 0) / 3')} AS second FROM obs LEFT JOIN x USING (cell_id) GROUP BY 1")
def score_matrix(spark, d):
    ds = bindings.counts(spark, d)
    m, _, _ = score.score_matrix(ds.x, ds.obs, {"first": [1, 2], "none": [], "second": [2, 5, 6]}, "none")
    return m.select("cell_id", r6(F.col("v")[0]).alias("first"), r6(F.col("v")[1]).alias("second"))


@query(
    "ucell",
    f"""{A_}, gn AS (SELECT count(*) AS g FROM var), r AS (SELECT cell_id, gene_id, rank() OVER (PARTITION BY cell_id ORDER BY value DESC) + (count(*) OVER (PARTITION BY cell_id, value) - 1) / 2 AS r FROM x WHERE value > 0),
c AS (SELECT obs.cell_id, count(r) AS nnz, coalesce(sum(least(r, 20)) FILTER (gene_id IN (1, 2, 3)), 0) AS ru, count(*) FILTER (gene_id IN (1, 2, 3)) AS nu, coalesce(sum(least(r, 20)) FILTER (gene_id IN (8, 9)), 0) AS rd, count(*) FILTER (gene_id IN (8, 9)) AS nd FROM obs LEFT JOIN r USING (cell_id) GROUP BY 1),
z AS (SELECT c.*, least(nnz + (g - nnz + 1) / 2, 20) AS z FROM c, gn)
SELECT cell_id, {q6('greatest(1 - (ru + (3 - nu) * z - 6) / (3 * 20 - 6) - (1 - (rd + (2 - nd) * z - 3) / (2 * 20 - 3)), 0)')} AS value FROM z""",
)
def ucell(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(score.ucell(ds.x, ds.obs, ds.var.count(), [1, 2, 3], [8, 9], max_rank=20), "cell_id")


@query("histogram", f"{A_}, r AS (SELECT min(acctbal) AS lo, max(acctbal) AS hi FROM obs) SELECT CAST(least(59, floor((acctbal - lo) / ((hi - lo) / 60))) AS INT) AS bin, count(*) AS n FROM obs, r GROUP BY 1")
def histogram(spark, d):
    return normalize.binned(bindings.counts(spark, d).obs, "acctbal")


@query("tokens_top_genes", "WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9_]+')) AS t FROM documents), n AS (SELECT doc_id, t, count(*) AS c FROM w WHERE t <> '' GROUP BY 1, 2) SELECT t AS gene_name, count(*) AS n_cells, sum(c)::DOUBLE AS total FROM n GROUP BY 1 ORDER BY n_cells DESC, gene_name LIMIT 50")
def tokens_top_genes(spark, d):
    docs = bindings.table(spark, d, "documents")
    words = docs.select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9_]+")).alias("gene_name")).where("gene_name <> ''")
    n = words.groupBy("doc_id", "gene_name").agg(F.count("*").cast("double").alias("value"))
    return n.groupBy("gene_name").agg(F.count("*").alias("n_cells"), F.sum("value").alias("total")).orderBy(F.col("n_cells").desc(), "gene_name").limit(50)


@query("activity_qc", "SELECT user_id AS cell_id, count(*)::DOUBLE AS total, count(DISTINCT event_type) AS n_genes FROM events GROUP BY 1")
def activity_qc(spark, d):
    from matriq.operators.select import cell_totals

    ds = bindings.activity(spark, d)
    return cell_totals(ds.x, ds.obs)
