"""Graphs, geometry, contours and signalling over embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from matriq import bindings
from matriq.operators import cluster, contour, geometry, graph, linear, read, signal, stats
from matriq.operators.communities import modularity as measure
from matriq.operators.order import cell_order
from matriq.plans.base import A, B, q6, query, r6
from matriq.plans.matrix import rounded
from matriq.sources import tenx

A_ = "WITH " + A
B_ = "WITH " + B
LINE = [(-0.2, -0.15), (-0.05, 0.02), (0.06, -0.04), (0.18, 0.2)]


def _points(ds):
    return read.embedding_view(ds.obsm["spatial"]).join(ds.obs.select("cell_id", "section"), "cell_id")


KNN = f"""{B_}, k AS (SELECT a.cell_id AS src, b.cell_id AS dst, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.cell_id ORDER BY list_distance(a.v, b.v), b.cell_id) AS rank FROM e a JOIN e b ON a.cell_id <> b.cell_id)"""
KNN2 = f"""{B_}, k AS (SELECT a.cell_id AS src, b.cell_id AS dst, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d, row_number() OVER (PARTITION BY a.cell_id ORDER BY (a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.cell_id) AS rank FROM pts a JOIN pts b ON a.cell_id <> b.cell_id)"""


@query("knn", f"{KNN} SELECT src, dst, {q6('d')} AS d, rank FROM k WHERE rank <= 5")
def knn(spark, d):
    out = graph.nearest(bindings.vectors(spark, d).obsm["X_vec"], 5)
    return out.select("src", "dst", r6("d").alias("d"), F.col("rank").cast("long").alias("rank"))


@query("epsilon_graph", f"{B_} SELECT a.cell_id AS src, b.cell_id AS dst, {q6('sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)')} AS d FROM pts a JOIN pts b ON a.cell_id <> b.cell_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02")
def epsilon_graph(spark, d):
    return rounded(graph.within(_points(bindings.vectors(spark, d)), 0.02), "src", "dst")


NB = f"{KNN2}, h AS (SELECT src, dst FROM k WHERE rank <= 6), g AS (SELECT src, dst FROM h UNION SELECT dst, src FROM h)"


@query("spatial_sections", f"{NB} SELECT g.src, g.dst, 1.0::DOUBLE AS w FROM g JOIN pts a ON a.cell_id = src JOIN pts b ON b.cell_id = dst WHERE a.section = b.section")
def spatial_sections(spark, d):
    ds = bindings.vectors(spark, d)
    return graph.spatial_neighbors(_points(ds), ds.obs, section="section")


@query("spatial_radius", f"{B_} SELECT a.cell_id AS src, b.cell_id AS dst, 1.0::DOUBLE AS w FROM pts a JOIN pts b ON a.cell_id <> b.cell_id AND a.section = b.section WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.03")
def spatial_radius(spark, d):
    ds = bindings.vectors(spark, d)
    return graph.spatial_neighbors(_points(ds), ds.obs, radius=0.03, section="section")


GRID = f"{KNN2}, k6 AS (SELECT * FROM k WHERE rank <= 6), h AS (SELECT src, dst FROM k6 WHERE d <= 1.3 * (SELECT quantile_disc(d, 0.5) FROM k6)), g AS (SELECT src, dst FROM h UNION SELECT dst, src FROM h)"


@query("spatial_rings", f"{GRID}, g2 AS (SELECT a.src, b.dst FROM g a JOIN g b ON a.dst = b.src WHERE a.src <> b.dst EXCEPT SELECT * FROM g) SELECT src, dst, 1 AS ring FROM g UNION ALL SELECT src, dst, 2 FROM g2")
def spatial_rings(spark, d):
    return graph.rings(graph.lattice(_points(bindings.vectors(spark, d))), 2)


@query("spatial_grid", f"{GRID}, g2 AS (SELECT src, dst FROM g UNION SELECT a.src, b.dst FROM g a JOIN g b ON a.dst = b.src WHERE a.src <> b.dst) SELECT g2.src, g2.dst, 1.0::DOUBLE AS w FROM g2 JOIN pts a ON a.cell_id = src JOIN pts b ON b.cell_id = dst WHERE a.section = b.section")
def spatial_grid(spark, d):
    ds = bindings.vectors(spark, d)
    return graph.spatial_neighbors(_points(ds), ds.obs, section="section", kind="grid", n_rings=2)


def _graph(ds):
    return graph.spatial_neighbors(_points(ds))


@query("list_graphs", f"{NB} SELECT 'connectivities' AS graph, count(*) AS edges FROM g")
def list_graphs(spark, d):
    ds = bindings.vectors(spark, d)
    return read.list_graphs(ds.with_part("obsp", "connectivities", _graph(ds)))


@query("knn_connectivities", f"""{KNN.replace('WITH ', 'WITH RECURSIVE ', 1)}, q AS (SELECT src, list(d ORDER BY rank) AS ds, coalesce(min(d) FILTER (d > 0), 0) AS rho, avg(d) AS m FROM k WHERE rank <= 10 GROUP BY 1),
it AS (SELECT src, ds, rho, 0::DOUBLE AS lo, 'inf'::DOUBLE AS hi, 1::DOUBLE AS sigma, 0 AS step FROM q
       UNION ALL SELECT src, ds, rho, CASE WHEN t > log2(10) THEN lo ELSE sigma END, CASE WHEN t > log2(10) THEN sigma ELSE hi END, CASE WHEN t > log2(10) THEN (lo + sigma) / 2 WHEN hi = 'inf' THEN sigma * 2 ELSE (sigma + hi) / 2 END, step + 1
       FROM (SELECT *, list_sum(list_transform(ds, lambda z: exp(-greatest(z - rho, 0) / sigma))) AS t FROM it) WHERE step < 64 AND abs(t - log2(10)) >= 1e-5),
sg AS (SELECT src, arg_max(sigma, step) AS sigma FROM it GROUP BY 1), a AS (SELECT src, dst, exp(-greatest(d - rho, 0) / greatest(sigma, 1e-3 * m)) AS a FROM k JOIN q USING (src) JOIN sg USING (src) WHERE rank <= 10)
SELECT src, dst, {q6('CASE WHEN count(*) > 1 THEN sum(a) - product(a) ELSE sum(a) END')} AS w FROM (SELECT * FROM a UNION ALL SELECT dst, src, a FROM a) GROUP BY 1, 2""")
def knn_connectivities(spark, d):
    out = graph.fuzzy_connectivities(graph.nearest(bindings.vectors(spark, d).obsm["X_vec"], 10), 10)
    return rounded(out, "src", "dst")


EPS = "ep AS (SELECT a.cell_id AS src, b.cell_id AS dst, 1 - sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS w FROM pts a JOIN pts b ON a.cell_id <> b.cell_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02)"


@query("combine_graphs", f"{NB}, {EPS}, u AS (SELECT src, dst, 0.25 / 2 AS w FROM g UNION ALL SELECT src, dst, 0.75 * w / (SELECT max(w) FROM ep) / 2 FROM ep), v AS (SELECT src, dst, w FROM u UNION ALL SELECT dst, src, w FROM u) SELECT src, dst, {q6('sum(w)')} AS w FROM v GROUP BY 1, 2")
def combine_graphs(spark, d):
    ds = bindings.vectors(spark, d)
    near = graph.Within(_points(ds), 0.02, lambda d: 1 - d)
    return rounded(graph.combine_graphs([(_graph(ds), 1.0), (near, 3.0)]), "src", "dst")


@query("smooth", f"{NB}, w AS (SELECT src, dst, 1.0 AS w FROM g UNION ALL SELECT cell_id, cell_id, 1.0 FROM pts), n AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM w), s1 AS (SELECT src AS cell_id, gene_id, sum(w * value) AS value FROM n JOIN x ON dst = cell_id WHERE gene_id < 4 GROUP BY 1, 2), s2 AS (SELECT src AS cell_id, gene_id, sum(w * value) AS value FROM n JOIN s1 ON dst = cell_id GROUP BY 1, 2) SELECT cell_id, gene_id, {q6('value')} AS value FROM s2")
def smooth(spark, d):
    ds = bindings.vectors(spark, d)
    return rounded(graph.smooth(ds.x.where("gene_id < 4"), _graph(ds), ds.obs, 2), "cell_id", "gene_id")


MORAN = f"{NB}, n AS (SELECT count(*) AS n FROM pts), z AS (SELECT cell_id, gene_id, value - avg(value) OVER (PARTITION BY gene_id) AS z FROM x)"


@query("moran", f"{MORAN}, t AS (SELECT a.gene_id, sum(a.z * b.z) AS t, count(*) AS w FROM g JOIN z a ON a.cell_id = src JOIN z b ON b.cell_id = dst AND a.gene_id = b.gene_id GROUP BY 1), q AS (SELECT gene_id, sum(z * z) AS q FROM z GROUP BY 1) SELECT gene_id, {q6('n / w * t / q')} AS i FROM t JOIN q USING (gene_id), n")
def moran(spark, d):
    ds = bindings.vectors(spark, d)
    return rounded(stats.morans_i(ds.x, _graph(ds), ds.obs.count()), "gene_id")


@query("geary", f"{MORAN}, t AS (SELECT a.gene_id, sum((a.z - b.z) ** 2) AS t, count(*) AS w FROM g JOIN z a ON a.cell_id = src JOIN z b ON b.cell_id = dst AND a.gene_id = b.gene_id GROUP BY 1), q AS (SELECT gene_id, sum(z * z) AS q FROM z GROUP BY 1) SELECT gene_id, {q6('(n - 1) * t / (2 * w * q)')} AS c FROM t JOIN q USING (gene_id), n")
def geary(spark, d):
    ds = bindings.vectors(spark, d)
    return rounded(stats.gearys_c(ds.x, _graph(ds), ds.obs.count()), "gene_id")


@query("autocorrelation_analytic", f"""{MORAN}, t AS (SELECT a.gene_id, sum(a.z * b.z) AS t, sum((a.z - b.z) ** 2) AS u, count(*)::DOUBLE AS w FROM g JOIN z a ON a.cell_id = src JOIN z b ON b.cell_id = dst AND a.gene_id = b.gene_id GROUP BY 1),
q AS (SELECT gene_id, sum(z * z) AS q, count(*) * sum(z ** 4) / sum(z * z) ** 2 AS b FROM z GROUP BY 1), dg AS (SELECT src, count(*)::DOUBLE AS d FROM g GROUP BY 1),
em AS (SELECT sum(d) AS s0, 2 * sum(d) AS s1, sum(4 * d * d) AS s2 FROM dg), nn AS (SELECT n::DOUBLE AS n FROM n),
v AS (SELECT gene_id, n, n / w * t / q AS i, (n - 1) * u / (2 * w * q) AS c,
(n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - 1 / ((n - 1) * (n - 1)) AS vi,
((n - 1) * s1 * (n * n - 3 * n + 3 - (n - 1) * b) - 0.25 * (n - 1) * s2 * (n * n + 3 * n - 6 - (n * n - n + 2) * b) + s0 * s0 * (n * n - 3 - (n - 1) * (n - 1) * b)) / (n * (n - 2) * (n - 3) * s0 * s0) AS vc
FROM t JOIN q USING (gene_id), em, nn)
SELECT gene_id, {q6('i')} AS i, {q6('c')} AS c, {q6('(i + 1 / (n - 1)) / sqrt(vi)')} AS i_z, {q6('(c - 1) / sqrt(vc)')} AS c_z FROM v""")
def autocorrelation_analytic(spark, d):
    """All genes; the graph has each edge both ways, once."""
    ds = bindings.vectors(spark, d)
    return rounded(stats.autocorrelation_analytic(ds.x, _graph(ds), ds.obs.count()).drop("i_p", "c_p"), "gene_id")


PERM = """pn AS (SELECT unnest(range(1, 6)) AS perm), pa AS (SELECT perm, cell_id, row_number() OVER (PARTITION BY perm ORDER BY cell_id) AS k FROM pts, pn),
pb AS (SELECT perm, other, row_number() OVER (PARTITION BY perm ORDER BY h, other) AS k FROM (SELECT perm, cell_id AS other, ('0x' || substr(md5(cell_id || '|' || perm || '|0'), 1, 15))::BIGINT AS h FROM pts, pn)),
sw AS (SELECT perm, cell_id, other FROM pa JOIN pb USING (perm, k))"""


@query("autocorrelation_test", f"""{MORAN}, {PERM}, z6 AS (SELECT * FROM z WHERE gene_id < 6), zm AS (SELECT perm, other AS cell_id, gene_id, z FROM z6 JOIN sw USING (cell_id)),
t AS (SELECT a.gene_id, sum(a.z * b.z) AS t, count(*) AS w FROM g JOIN z6 a ON a.cell_id = src JOIN z6 b ON b.cell_id = dst AND a.gene_id = b.gene_id GROUP BY 1), q AS (SELECT gene_id, sum(z * z) AS q FROM z6 GROUP BY 1),
tn AS (SELECT a.gene_id, a.perm, sum(a.z * b.z) AS tn FROM g JOIN zm a ON a.cell_id = src JOIN zm b ON b.cell_id = dst AND a.gene_id = b.gene_id AND a.perm = b.perm GROUP BY 1, 2),
p AS (SELECT gene_id, n / w * t / q AS i, (SELECT count(*) FROM tn WHERE tn.gene_id = t.gene_id AND tn >= t.t) AS c FROM t JOIN q USING (gene_id), n),
b AS (SELECT gene_id, i, (c + 1) / 6 AS p, (c + 1) / 6 * count(*) OVER () / row_number() OVER (ORDER BY c) AS q FROM p)
SELECT gene_id, {q6('i')} AS i, {q6('p')} AS p, {q6('least(1, min(q) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING))')} AS padj FROM b""")
def autocorrelation_test(spark, d):
    ds = bindings.vectors(spark, d)
    return rounded(stats.autocorrelation_test(ds.x.where("gene_id < 6"), _graph(ds), ds.obs, ds.obs.count(), 5).drop("spatially_variable"), "gene_id")


_SEGS = ", ".join(f"({k}, {float(x1)}::DOUBLE, {float(y1)}::DOUBLE, {float(x2)}::DOUBLE, {float(y2)}::DOUBLE)" for k, ((x1, y1), (x2, y2)) in enumerate(zip(LINE, LINE[1:], strict=False)))
PROJ = f"""{B_}, sg0(k, x1, y1, x2, y2) AS (VALUES {_SEGS}), sg AS (SELECT *, sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) AS len FROM sg0), sc AS (SELECT *, coalesce(sum(len) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cum, sum(len) OVER () AS total FROM sg),
tt AS (SELECT cell_id, x, y, sc.*, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (len * len))) AS t FROM pts, sc),
pd AS (SELECT cell_id, k, (cum + t * len) / total AS position, sqrt((x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2) AS distance FROM tt),
pj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY distance, k) AS r FROM pd) WHERE r = 1)"""


@query("line_projection", f"{PROJ} SELECT cell_id, {q6('position')} AS position, {q6('distance')} AS distance FROM pj")
def line_projection(spark, d):
    return rounded(geometry.project_on_line(read.embedding_view(bindings.vectors(spark, d).obsm["spatial"]), LINE), "cell_id")


@query("projection_embedding", f"{PROJ}, r AS (SELECT min(distance) AS lo, max(distance) AS hi FROM pj) SELECT cell_id, {q6('position')} AS x, {q6('(distance - lo) / (hi - lo)')} AS y FROM pj, r")
def projection_embedding(spark, d):
    m = geometry.projection_embedding(geometry.project_on_line(read.embedding_view(bindings.vectors(spark, d).obsm["spatial"]), LINE))
    return m.select("cell_id", r6(F.col("v")[0]).alias("x"), r6(F.col("v")[1]).alias("y"))


@query("multi_line_pool", f"{PROJ} SELECT cell_id, {q6('position')} AS t FROM pj WHERE cell_id % 2 = 0 UNION ALL SELECT cell_id, {q6('1 - position')} FROM pj WHERE cell_id % 3 = 0")
def multi_line_pool(spark, d):
    p = geometry.project_on_line(read.embedding_view(bindings.vectors(spark, d).obsm["spatial"]), LINE).select("cell_id", F.col("position").alias("t"))
    return rounded(stats.pooled_positions([(p.where("cell_id % 2 = 0"), False), (p.where("cell_id % 3 = 0"), True)]), "cell_id")




def _drawn(spark, d):
    ds = bindings.vectors(spark, d)
    return read.embedding_view(ds.obsm["spatial"]).join(ds.obs, "cell_id").select(F.col("label").alias("line"), F.col("cell_id").alias("seq"), "x", "y")


_AVG = "avg(x) OVER w AS x, avg(y) OVER w AS y"
_W = "WINDOW w AS (PARTITION BY line ORDER BY seq ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query("line_smoothing", f"WITH {B.replace('AS x, v[2] AS y, section FROM e)', 'AS x, v[2] AS y, section, label FROM e)')}, ln AS (SELECT label AS line, cell_id AS seq, x, y FROM pts), s1 AS (SELECT line, seq, {_AVG} FROM ln {_W}), s2 AS (SELECT line, seq, {_AVG} FROM s1 {_W}) SELECT line, seq, {q6('x')} AS x, {q6('y')} AS y FROM s2")
def line_smoothing(spark, d):
    return rounded(geometry.smooth_line(_drawn(spark, d), 2, 2), "line", "seq")


def _curve(c: str) -> str:
    return f"0.5 * (2 * {c} + ({c}2 - {c}0) * t + (2 * {c}0 - 5 * {c} + 4 * {c}2 - {c}3) * t * t + (3 * {c} - {c}0 - 3 * {c}2 + {c}3) * t * t * t)"


@query("line_spline", f"WITH {B.replace('AS x, v[2] AS y, section FROM e)', 'AS x, v[2] AS y, section, label FROM e)')}, ln AS (SELECT label AS line, cell_id AS seq, x, y FROM pts), n AS (SELECT *, coalesce(lag(x) OVER w, x) AS x0, coalesce(lag(y) OVER w, y) AS y0, lead(x) OVER w AS x2, lead(y) OVER w AS y2, coalesce(lead(x, 2) OVER w, lead(x) OVER w) AS x3, coalesce(lead(y, 2) OVER w, lead(y) OVER w) AS y3 FROM ln WINDOW w AS (PARTITION BY line ORDER BY seq)), s AS (SELECT *, step / 4 AS t FROM (SELECT *, unnest(range(0, 5))::INT AS step FROM n WHERE x2 IS NOT NULL)) SELECT line, seq, step, {q6(_curve('x'))} AS x, {q6(_curve('y'))} AS y FROM s")
def line_spline(spark, d):
    return rounded(geometry.spline_line(_drawn(spark, d), 4), "line", "seq", "step")


@query("transform_embedding", f"{B_}, c AS (SELECT avg(v[1]) AS cx, avg(v[2]) AS cy FROM e WHERE section = 's1') SELECT cell_id, {q6('CASE WHEN section = $$s1$$ THEN cx + (v[1] - cx) * cos(radians(30)) - (v[2] - cy) * sin(radians(30)) ELSE v[1] END')} AS x, {q6('CASE WHEN section = $$s1$$ THEN cy + (v[1] - cx) * sin(radians(30)) + (v[2] - cy) * cos(radians(30)) ELSE v[2] END')} AS y FROM e, c")
def transform_embedding(spark, d):
    ds = bindings.vectors(spark, d)
    m = geometry.transform_points(ds.obsm["spatial"], "rotate", 30, subset=ds.obs.where("section = 's1'"))
    return m.select("cell_id", r6(F.col("v")[0]).alias("x"), r6(F.col("v")[1]).alias("y"))


@query("reflect_embedding", f"{B_}, c AS (SELECT avg(v[1]) AS cx FROM e) SELECT cell_id, {q6('2 * cx - v[1]')} AS x, {q6('v[2]')} AS y FROM e, c")
def reflect_embedding(spark, d):
    m = geometry.transform_points(bindings.vectors(spark, d).obsm["spatial"], "reflect_x")
    return m.select("cell_id", r6(F.col("v")[0]).alias("x"), r6(F.col("v")[1]).alias("y"))


@query(
    "heatmap_bins",
    f"""{A_}, o AS (SELECT cell_id, row_number() OVER (ORDER BY acctbal, cell_id) - 1 AS k, count(*) OVER () AS n FROM obs), b AS (SELECT cell_id, CAST(floor(((k + 1) * 20 - 1) / n) AS INT) AS bin FROM o),
m AS (SELECT b.bin, g.gene_id, avg(coalesce(x.value, 0)) AS v FROM b CROSS JOIN (SELECT gene_id FROM var WHERE gene_id <= 6) g LEFT JOIN x ON x.cell_id = b.cell_id AND x.gene_id = g.gene_id GROUP BY 1, 2),
s AS (SELECT gene_id, bin, (v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) AS value FROM m WINDOW w AS (PARTITION BY gene_id)) SELECT gene_id, bin, round(value, 4) + 0.0 AS value, (arg_max(bin, value) OVER (PARTITION BY gene_id))::INT AS peak FROM s""",
)
def heatmap_bins(spark, d):
    ds = bindings.counts(spark, d)
    return geometry.heatmap(ds.x, ds.obs.select("cell_id", F.col("acctbal").alias("ord")), list(range(1, 7)), 20)


@query(
    "heatmap_by_category",
    f"""{A_}, c AS (SELECT cell_id, acctbal, list_position(['BUILDING', 'MACHINERY'], segment) AS k FROM obs), v AS (SELECT cell_id, CASE WHEN k IS NULL OR k = 0 THEN 2.0 ELSE k - 1 END * 2 AS ord FROM c),
o AS (SELECT cell_id, row_number() OVER (ORDER BY ord, cell_id) - 1 AS k, count(*) OVER () AS n FROM v), b AS (SELECT cell_id, CAST(floor(((k + 1) * 12 - 1) / n) AS INT) AS bin FROM o),
m AS (SELECT b.bin, g.gene_id, avg(coalesce(x.value, 0)) AS v FROM b CROSS JOIN (SELECT gene_id FROM var WHERE gene_id <= 3) g LEFT JOIN x ON x.cell_id = b.cell_id AND x.gene_id = g.gene_id GROUP BY 1, 2)
SELECT gene_id, bin, round(v, 4) + 0.0 AS value, (arg_max(bin, v) OVER (PARTITION BY gene_id))::INT AS peak FROM m""",
)
def heatmap_by_category(spark, d):
    ds = bindings.counts(spark, d)
    return geometry.heatmap(ds.x, cell_order(ds.obs, "segment", ["BUILDING", "MACHINERY"]), [1, 2, 3], 12, scale=False)


def _field(ds):
    return ds.x.where("gene_id = 3").select("cell_id", (F.col("value") + 1).alias("value"))


@query("contour_bands", f"{B_}, f AS (SELECT cell_id, v[4] + 1 AS value FROM e), m AS (SELECT max(value) AS m FROM f) SELECT cell_id, {q6('value')} AS value, len([i for i in range(1, 7) if value >= m * i / 7])::INT AS band FROM f, m")
def contour_bands(spark, d):
    return contour.bands(_field(bindings.vectors(spark, d))).select("cell_id", r6("value").alias("value"), "band")


@query("contour_field", f"{A_}, d AS (SELECT o.cell_id, g.gene_id, ln(1 + coalesce(x.value, 0)) AS v FROM obs o CROSS JOIN (SELECT gene_id FROM var WHERE gene_id IN (2, 9)) g LEFT JOIN x ON x.cell_id = o.cell_id AND x.gene_id = g.gene_id), q AS (SELECT gene_id, quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.99) AS b FROM d GROUP BY 1) SELECT cell_id, {q6('avg(CASE WHEN b > a THEN (least(greatest(v, a), b) - a) / (b - a) ELSE 0 END)')} AS value FROM d JOIN q USING (gene_id) GROUP BY 1")
def contour_field(spark, d):
    ds = bindings.counts(spark, d)
    return rounded(contour.raw_field(ds.x, ds.obs, [2, 9]), "cell_id")


@query("contour_smooth")
def contour_smooth(spark, d):
    ds = bindings.vectors(spark, d)
    return rounded(contour.smooth_field(_field(ds), _points(ds), "section", 2.0, 40), "cell_id")


K5 = "(1 + 2 * list_sum(list_transform(range(1, 9), lambda u: exp(-u * u / 8.0))))"


@query("contour_blur", f"""{B_}, f AS (SELECT section, min(x) AS x0, min(y) AS y0, max(x) - min(x) AS wx, max(y) - min(y) AS wy FROM pts GROUP BY 1),
pl AS (SELECT cell_id, section AS s, CAST(round_even((x - x0) / wx * 39, 0) AS INT) AS gx, CAST(round_even((y - y0) / wy * 39, 0) AS INT) AS gy, e.v[4] + 1 AS v FROM pts JOIN f USING (section) JOIN e USING (cell_id, section)),
z AS (SELECT s, gx, gy, avg(v) AS z FROM pl GROUP BY 1, 2, 3), k AS (SELECT unnest(range(-8, 9)) AS k),
bx AS (SELECT q.s, q.gx, z.gy, sum(z.z * exp(-k * k / 8.0) / {K5}) AS z FROM (SELECT DISTINCT s, gx FROM pl) q CROSS JOIN k JOIN z ON z.s = q.s AND z.gx = least(39, greatest(0, q.gx + k)) GROUP BY 1, 2, 3),
bl AS (SELECT q.s, q.gx, q.gy, sum(b.z * exp(-k * k / 8.0) / {K5}) AS z FROM (SELECT DISTINCT s, gx, gy FROM pl) q CROSS JOIN k JOIN bx b ON b.s = q.s AND b.gx = q.gx AND b.gy = least(39, greatest(0, q.gy + k)) GROUP BY 1, 2, 3)
SELECT cell_id, pl.gx, pl.gy, {q6('bl.z')} AS value FROM pl JOIN bl ON bl.s = pl.s AND bl.gx = pl.gx AND bl.gy = pl.gy""")
def contour_blur(spark, d):
    """Cells' values on a grid of each section (a place has their mean), blurred and read back."""
    ds = bindings.vectors(spark, d)
    p = contour.placed(_points(ds).withColumnRenamed("section", "s").join(_field(ds), "cell_id"), 40)
    z = p.groupBy("s", "gx", "gy").agg(F.avg("value").alias("z"))
    out = p.join(contour.blurred(z, 40, 2.0), ["s", "gx", "gy"])
    return rounded(out.select("cell_id", "gx", "gy", F.col("z").alias("value")), "cell_id", "gx", "gy")


@query("contour_suggestion", f"{KNN2}, n AS (SELECT median(d) AS d FROM k WHERE rank = 1), s AS (SELECT count(*) AS n, greatest(max(x) - min(x), max(y) - min(y)) AS span FROM pts), g AS (SELECT CAST(greatest(50, least(600, round(sqrt(n)))) AS INT) AS grid, span FROM s) SELECT grid, {q6('greatest(1, least(6, 2 * d / (span / grid)))')} AS sigma FROM g, n")
def contour_suggestion(spark, d):
    return rounded(contour.suggest_contour(_points(bindings.vectors(spark, d))), "grid")


BANDED = "fa AS (SELECT cell_id, v[4] + 1 AS value FROM e), fb AS (SELECT cell_id, v[7] + 1 AS value FROM e), bd AS (SELECT cell_id, 'A' AS module, len([i for i in range(1, 7) if value >= m * i / 7])::INT AS band FROM fa, (SELECT max(value) AS m FROM fa) UNION ALL SELECT cell_id, 'B', len([i for i in range(1, 7) if value >= m * i / 7])::INT FROM fb, (SELECT max(value) AS m FROM fb))"


def _banded(ds):
    f = {m: ds.x.where(F.col("gene_id") == g).select("cell_id", (F.col("value") + 1).alias("value")) for m, g in (("A", 3), ("B", 6))}
    return contour.multi_bands(f)


@query("multicontour_histogram", f"{B_}, {BANDED} SELECT module, band, count(*) AS n FROM bd GROUP BY 1, 2")
def multicontour_histogram(spark, d):
    return contour.band_histogram(_banded(bindings.vectors(spark, d)))


@query(
    "multicontour_vote",
    f"""{NB}, {BANDED}, hi AS (SELECT cell_id, module FROM bd WHERE band >= 5), nh AS (SELECT cell_id, count(*) AS n, min(module) AS one FROM hi GROUP BY 1),
ed AS (SELECT g.src, g.dst FROM g JOIN pts a ON a.cell_id = src JOIN pts b ON b.cell_id = dst WHERE a.section = b.section),
vt AS (SELECT src, dst, s.one AS vote, row_number() OVER (PARTITION BY src ORDER BY list_distance(p.v, q.v), dst) AS r FROM ed JOIN nh t ON t.cell_id = src AND t.n > 1 JOIN nh s ON s.cell_id = dst AND s.n = 1 JOIN e p ON p.cell_id = src JOIN e q ON q.cell_id = dst),
ct AS (SELECT src, vote, count(*) AS c FROM vt WHERE r <= 3 GROUP BY 1, 2), wn AS (SELECT src, max(c) AS top, arg_max(vote, c) AS vote FROM ct GROUP BY 1), ok AS (SELECT wn.src, wn.vote FROM wn JOIN ct ON ct.src = wn.src AND ct.c = wn.top GROUP BY 1, 2 HAVING count(*) = 1)
SELECT e.cell_id, CASE WHEN n = 1 THEN one WHEN ok.vote IS NOT NULL THEN ok.vote ELSE 'unassigned' END AS label, coalesce(n, 0) AS n_high FROM e LEFT JOIN nh USING (cell_id) LEFT JOIN ok ON ok.src = e.cell_id""",
)
def multicontour_vote(spark, d):
    ds = bindings.vectors(spark, d)
    return contour.assign_modules(_banded(ds), {"A": 5, "B": 5}, _graph(ds), ds.obsm["X_vec"], 3, ds.obs, "section")


@query("rebin_mask", "WITH b AS (SELECT l_orderkey % 60 AS r, l_partkey % 48 AS c, l_suppkey % 5 AS gene_id, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2, 3) SELECT CAST(r // 4 AS INT) AS row, CAST(c // 4 AS INT) AS col, gene_id, sum(value) AS value FROM b WHERE (r // 4 + c // 4) % 2 = 0 GROUP BY 1, 2, 3")
def rebin_mask(spark, d):
    li = bindings.table(spark, d, "lineitem")
    fine = li.groupBy((F.col("l_orderkey") % 60).alias("row"), (F.col("l_partkey") % 48).alias("col"), (F.col("l_suppkey") % 5).alias("gene_id")).agg(F.sum("l_quantity").alias("value"))
    mask = spark.range(15).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("col")).where("(row + col) % 2 = 0")
    return tenx.rebin(fine, 4, mask)[0]


@query("section_clusters", "SELECT * FROM (SELECT r AS row, c AS col, c * 2.0 AS x, -r * 2.0 AS y, CASE WHEN r = c THEN 'C' || r ELSE 'NA' END AS cluster FROM (SELECT unnest(range(0, 4))::INT AS r), (SELECT unnest(range(0, 4))::INT AS c))")
def section_clusters(spark, d):
    mask = spark.range(4).select(F.col("id").cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("col"))
    cells = mask.withColumn("x", F.col("col") * 2.0).withColumn("y", -F.col("row") * 2.0)
    return tenx.with_clusters(cells, spark.range(4).select(F.col("id").cast("int").alias("row"), F.col("id").cast("int").alias("col"), F.concat(F.lit("C"), "id").alias("cluster")))


@query(
    "combine_sections",
    f"""{B_}, s AS (SELECT section, row_number() OVER (ORDER BY section) - 1 AS i, min(x) AS lo, max(x) - min(x) AS width FROM pts GROUP BY 1), o AS (SELECT *, coalesce(sum(width) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + i * 0.05 * avg(width) OVER () AS off FROM s)
SELECT CASE i WHEN 0 THEN 'slide' WHEN 1 THEN 'slide_2' ELSE 'other' END AS sample, cell_id, {q6('x - lo + off')} AS x, {q6('y')} AS y FROM pts JOIN o USING (section)""",
)
def combine_sections(spark, d):
    ds = bindings.vectors(spark, d)
    pts = _points(ds)
    parts = []
    for label, s in (("slide", "s0"), ("slide", "s1"), ("other", "s2")):
        part = ds.select_cells(ds.obs.where(F.col("section") == s))
        parts.append((label, part.obs, part.x, pts.where(F.col("section") == s).select("cell_id", "x", "y")))
    return rounded(signal.combine_sections(parts)[2], "sample", "cell_id")


@query("lr_suggestion", f"{KNN2}, n AS (SELECT median(d) AS d FROM k WHERE rank = 1), s AS (SELECT count(*) AS n FROM pts) SELECT {q6('3 * d')} AS radius, CAST(greatest(20, least(200, round(1e5 / n))) AS INT) AS n_perm, CAST(greatest(3, floor(0.005 * n)) AS INT) AS min_cells FROM n, s")
def lr_suggestion(spark, d):
    out = signal.suggest(_points(bindings.vectors(spark, d)))
    return out.select(r6("radius").alias("radius"), "n_perm", "min_cells")


PAIRS = [("p1", ["Brand#1"], ["Brand#2", "BRAND#3"]), ("p2", ["Brand#4", "nothing"], ["Brand#5"]), ("p3", ["Brand#6"], ["Brand#7"]), ("p4", ["Brand#8"], ["Brand#9", "Brand#10"])]


def _pairs(spark):
    return spark.createDataFrame(PAIRS, "interaction string, ligand array<string>, receptor array<string>")


@query("lr_pairs", "SELECT * FROM (VALUES ('p1', 'ligand', 1), ('p1', 'receptor', 2), ('p1', 'receptor', 3), ('p3', 'ligand', 6), ('p3', 'receptor', 7), ('p4', 'ligand', 8), ('p4', 'receptor', 9), ('p4', 'receptor', 10)) t(interaction, side, gene_id)")
def lr_pairs(spark, d):
    ds = bindings.counts(spark, d)
    return signal.resolve_pairs(_pairs(spark), ds.var)


def _lr(spark, d):
    """Values made positive counts, so that rates exist."""
    ds = bindings.vectors(spark, d)
    x = ds.x.where("gene_id < 12").select("cell_id", "gene_id", F.round(F.abs(F.col("value")) * 100).alias("value")).where("value > 0")
    genes = spark.createDataFrame([("p1", "ligand", 1), ("p1", "receptor", 2), ("p1", "receptor", 3), ("p2", "ligand", 4), ("p2", "receptor", 5)], "interaction string, side string, gene_id int")
    pts = _points(ds)
    near = graph.Gaussian(pts, 0.03)
    loops = pts.select(F.col("cell_id").alias("src"), F.col("cell_id").alias("dst"), F.lit(1.0).alias("w"))
    return x, genes, near, graph.row_normalized(_graph(ds)).union(loops), ds


LR = f"""{NB}, xx AS (SELECT cell_id, gene_id, round(abs(value) * 100) AS value FROM x WHERE gene_id < 12 AND round(abs(value) * 100) > 0), tt AS (SELECT cell_id, sum(value) AS t FROM xx GROUP BY 1), lr AS (SELECT cell_id, gene_id, ln(1 + value / t * 1e4) AS value FROM xx JOIN tt USING (cell_id)),
gs(interaction, side, gene_id) AS (VALUES ('p1', 'ligand', 1), ('p1', 'receptor', 2), ('p1', 'receptor', 3), ('p2', 'ligand', 4), ('p2', 'receptor', 5)),
gd AS (SELECT a.cell_id AS src, b.cell_id AS dst, CASE WHEN a.cell_id = b.cell_id THEN 5.0 ELSE exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (2 * (0.03 / sqrt(-2 * ln(0.001))) ** 2)) END AS w FROM pts a JOIN pts b ON sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.03),
nw AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM gd), mw AS (SELECT src, dst, 1 / count(*) OVER (PARTITION BY src) AS w FROM g UNION ALL SELECT cell_id, cell_id, 1.0 FROM pts),
sd AS (SELECT interaction, side, cell_id, sum(value) AS v FROM lr JOIN gs USING (gene_id) GROUP BY 1, 2, 3),
l1 AS (SELECT interaction, src AS cell_id, sum(w * v) AS v FROM nw JOIN sd ON dst = cell_id WHERE side = 'ligand' GROUP BY 1, 2), l2 AS (SELECT interaction, src AS cell_id, sum(w * v) AS v FROM mw JOIN l1 ON dst = cell_id GROUP BY 1, 2),
r2 AS (SELECT interaction, src AS cell_id, sum(w * v) AS v FROM mw JOIN sd ON dst = cell_id WHERE side = 'receptor' GROUP BY 1, 2)"""


@query("lr_score", f"{LR} SELECT interaction, cell_id, {q6('l2.v * r2.v')} AS score FROM l2 JOIN r2 USING (interaction, cell_id)")
def lr_score(spark, d):
    x, genes, near, mean, _ = _lr(spark, d)
    return rounded(signal.lr_scores(x, genes, near, mean), "interaction", "cell_id")


@query("lr_null", f"""{LR}, {PERM}, wn AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS w FROM (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, w FROM nw UNION ALL SELECT cell_id, cell_id, 1.0 FROM pts) GROUP BY 1, 2)),
r0 AS (SELECT interaction, cell_id, l2.v * r2.v AS v FROM l2 JOIN r2 USING (interaction, cell_id)), rs AS (SELECT interaction, src AS cell_id, sum(w * v) AS score FROM wn JOIN r0 ON dst = cell_id GROUP BY 1, 2),
m0 AS (SELECT interaction, perm, other AS cell_id, v FROM sd JOIN sw USING (cell_id) WHERE side = 'ligand'),
m1 AS (SELECT interaction, perm, src AS cell_id, sum(w * v) AS v FROM nw JOIN m0 ON dst = cell_id GROUP BY 1, 2, 3), m2 AS (SELECT interaction, perm, src AS cell_id, sum(w * v) AS v FROM mw JOIN m1 ON dst = cell_id GROUP BY 1, 2, 3),
m3 AS (SELECT interaction, perm, cell_id, m2.v * r2.v AS v FROM m2 JOIN r2 USING (interaction, cell_id)), ns AS (SELECT interaction, src AS cell_id, sum(w * v) AS v FROM wn JOIN m3 ON dst = cell_id GROUP BY interaction, perm, src),
c AS (SELECT interaction, rs.cell_id, score, count(ns.v) AS c FROM rs LEFT JOIN ns USING (interaction) WHERE ns.v >= score OR ns.v IS NULL GROUP BY 1, 2, 3),
p AS (SELECT interaction, cell_id, score, (coalesce(c, 0) + 1) / ((SELECT count(*) FROM pts) * 5 + 1) AS p FROM rs LEFT JOIN c USING (interaction, cell_id, score)),
b AS (SELECT *, p * count(*) OVER (PARTITION BY interaction) / row_number() OVER (PARTITION BY interaction ORDER BY p) AS q FROM p),
a AS (SELECT interaction, score, least(1, min(q) OVER (PARTITION BY interaction ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS padj FROM b)
SELECT interaction, {q6("count(*) FILTER (padj < 0.05 AND score > 0)")} AS n_significant, {q6('avg(score)')} AS mean_score FROM a GROUP BY 1""")
def lr_null(spark, d):
    x, genes, near, mean, ds = _lr(spark, d)
    return rounded(signal.lr_summary(signal.lr_significance(x, genes, near, mean, ds.obs, 5)), "interaction")


@query("gaussian_graph", f"{LR} SELECT src, dst, {q6('w')} AS w FROM nw")
def gaussian_graph(spark, d):
    return rounded(graph.gaussian_weights(_points(bindings.vectors(spark, d)), 0.03), "src", "dst")


@query("delaunay", f"""{B_}, pr AS (SELECT a.cell_id AS src, b.cell_id AS dst, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, a.section, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM pts a JOIN pts b ON a.section = b.section AND a.cell_id < b.cell_id WHERE sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.1),
th AS (SELECT src, dst, d, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) AS side, (x - x1) * (x - x2) + (y - y1) * (y - y2) AS dot FROM pr JOIN pts r ON r.section = pr.section AND r.cell_id <> src AND r.cell_id <> dst),
ok AS (SELECT src, dst, any_value(d) AS d FROM th GROUP BY 1, 2 HAVING coalesce(max(dot / side) FILTER (side < 0), '-inf'::DOUBLE) <= coalesce(min(dot / side) FILTER (side > 0), 'inf'::DOUBLE))
SELECT src, dst, {q6('d')} AS d FROM ok UNION ALL SELECT dst, src, {q6('d')} FROM ok""")
def delaunay(spark, d):
    return rounded(graph.delaunay_edges(_points(bindings.vectors(spark, d)), 0.1, "section"), "src", "dst")


@query("leiden")
def leiden(spark, d):
    ds = bindings.vectors(spark, d)
    return cluster.communities(graph.fuzzy_connectivities(graph.nearest(ds.obsm["X_vec"], 10), 10), ds.obs)


@query("modularity", f"""{NB}, d AS (SELECT src AS cell_id, count(*)::DOUBLE AS k FROM g GROUP BY 1), m AS (SELECT sum(k) AS m FROM d), s AS (SELECT section, sum(k) AS s FROM d JOIN pts USING (cell_id) GROUP BY 1),
i AS (SELECT count(*) AS i FROM g JOIN pts a ON a.cell_id = src JOIN pts b ON b.cell_id = dst WHERE a.section = b.section) SELECT {q6('i / m - 0.8 * (SELECT sum(s * s) FROM s) / (m * m)')} AS q FROM i, m""")
def modularity(spark, d):
    """Of sections, on the spatial graph."""
    ds = bindings.vectors(spark, d)
    q = measure(_graph(ds), ds.obs.select("cell_id", F.col("section").alias("cluster")), 0.8)
    return spark.createDataFrame([(q,)], "q double").select(r6("q").alias("q"))


_ROUNDS = ", ".join(f"l{k} AS (SELECT src AS cell_id, c FROM (SELECT src, c, row_number() OVER (PARTITION BY src ORDER BY sum(w) DESC, c) AS r FROM lg JOIN l{k - 1} ON dst = cell_id GROUP BY src, c) WHERE r = 1)" for k in range(1, 5))


@query("label_propagation", f"{NB}, lg AS (SELECT src, dst, 1.0 AS w FROM g UNION ALL SELECT cell_id, cell_id, 0.5 FROM pts), l0 AS (SELECT cell_id, cell_id AS c FROM pts), {_ROUNDS} SELECT cell_id, CAST(c AS VARCHAR) AS cluster FROM l4")
def label_propagation(spark, d):
    ds = bindings.vectors(spark, d)
    return cluster.propagate(_graph(ds), ds.obs, 4)


@query("umap")
def umap(spark, d):
    ds = bindings.vectors(spark, d)
    return cluster.layout(graph.fuzzy_connectivities(graph.nearest(ds.obsm["X_vec"], 10), 10), ds.obs)


@query("cell_pca_neighbors")
def cell_pca_neighbors(spark, d):
    ds = bindings.vectors(spark, d)
    scores, _, _, _ = linear.pca(ds.x, ds.obs, list(range(64)), 10)
    return rounded(graph.nearest(scores, 5), "src", "dst")
