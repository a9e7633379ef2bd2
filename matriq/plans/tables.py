"""Reads, filters, annotations and gene names over customers by brands."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq import bindings, dataset
from matriq.operators import annotate, read, select
from matriq.plans.base import A, B, T, q6, query, r6
from matriq.sources import gene_sets as gs

A_ = "WITH " + A
T_ = "WITH " + T
B_ = "WITH " + B


def _coo(spark: SparkSession, d: str) -> DataFrame:
    return bindings.counts(spark, d).x


@query("schema_counts", f"{A_} SELECT 'obs' AS part, 'obs' AS name, (SELECT count(*) FROM obs) AS n_rows, 6 AS n_columns UNION ALL SELECT 'var', 'var', (SELECT count(*) FROM var), 2 UNION ALL SELECT 'layers', 'X', (SELECT count(*) FROM x), 3")
def schema_counts(spark, d):
    return dataset.schema(bindings.counts(spark, d))


@query("embedding_view", f"{B_} SELECT cell_id, v[3] AS x, v[6] AS y, v[1] AS z FROM e")
def embedding_view(spark, d):
    return read.embedding_view(bindings.vectors(spark, d).obsm["X_vec"], 2, 5, 999)


@query("obs_embedding_log", f"{A_}, t AS (SELECT cell_id, sum(value) AS total, count(*) AS n FROM x WHERE value > 0 GROUP BY 1) SELECT cell_id, {q6('ln(1 + coalesce(total, 0))')} AS x, {q6('coalesce(n, 0)')} AS y FROM obs LEFT JOIN t USING (cell_id)")
def obs_embedding_log(spark, d):
    ds = bindings.counts(spark, d)
    m = read.embedding_from_obs(select.cell_totals(ds.x, ds.obs), "total", "n_genes", "x")
    return m.select("cell_id", r6(F.col("v")[0]).alias("x"), r6(F.col("v")[1]).alias("y"))


@query("obs_column_codes", f"{A_} SELECT cell_id, segment AS label, CASE segment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 WHEN 'MACHINERY' THEN 3 ELSE -1 END AS code FROM obs")
def obs_column_codes(spark, d):
    return read.category_codes(bindings.counts(spark, d).obs, "segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY"])


@query("obs_summary_category", f"{A_} SELECT label, coalesce(n, 0) AS n FROM (SELECT segment AS label, count(*) AS n FROM obs GROUP BY 1) FULL JOIN (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY', 'EMPTY']) AS label) USING (label)")
def obs_summary_category(spark, d):
    return read.summarize_category(bindings.counts(spark, d).obs, "segment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "EMPTY"])


@query("obs_summary_numeric", f"{A_} SELECT min(acctbal) AS min, max(acctbal) AS max, {q6('avg(acctbal)')} AS mean, 0::BIGINT AS n_missing FROM obs")
def obs_summary_numeric(spark, d):
    return read.summarize_numeric(bindings.counts(spark, d).obs, "acctbal").withColumn("mean", r6("mean"))


@query("obs_summary_string", f"{A_} SELECT nation AS label, count(*) AS n FROM obs GROUP BY 1 ORDER BY n DESC, label LIMIT 10")
def obs_summary_string(spark, d):
    return read.summarize_strings(bindings.counts(spark, d).obs, "nation", 10)


@query("obsm_column", f"{B_} SELECT cell_id, v[5] AS value FROM e")
def obsm_column(spark, d):
    return read.obsm_column(bindings.vectors(spark, d).obsm["X_vec"], ["a", "b"], "4")


@query("gene_browse", f"{T_} SELECT gene_id, gene_name FROM var ORDER BY lower(gene_name), gene_id LIMIT 20 OFFSET 15")
def gene_browse(spark, d):
    return read.browse_genes(bindings.counts(spark, d, True).var, 15, 20)


@query("gene_search", f"{T_} SELECT gene_id, gene_name, CASE WHEN starts_with(lower(gene_name), 's') THEN 0 ELSE 1 END AS rank FROM var WHERE contains(lower(gene_name), 's') ORDER BY rank, gene_id LIMIT 60")
def gene_search(spark, d):
    return read.search_genes(bindings.counts(spark, d, True).var, "S", 60)


@query("list_layers", f"{A_} SELECT 'X' AS layer, (SELECT count(*) FROM obs) AS cells, (SELECT count(*) FROM var) AS genes, (SELECT count(*) FROM x WHERE value <> 0) AS nnz, {q6('(SELECT count(*) FROM x WHERE value <> 0) / ((SELECT count(*) FROM obs) * (SELECT count(*) FROM var))')} AS density")
def list_layers(spark, d):
    return read.list_layers(bindings.counts(spark, d)).withColumn("density", r6("density"))


def _flagged(spark, d):
    var = bindings.counts(spark, d).var
    return var.withColumn("even", F.col("gene_id") % 2 == 0).withColumn("small", (F.col("gene_id") <= 10).cast("int")).withColumn("number", F.col("gene_id") * 3).withColumn("key", F.concat(F.lit("k"), "gene_id")).withColumn("kind", F.when(F.col("gene_id") < 9, "a").otherwise("b"))


FLAGS = "f AS (SELECT *, gene_id % 2 = 0 AS even, gene_id <= 10 AS small FROM var)"


@query("boolean_columns", f"{A_}, {FLAGS} SELECT 'even' AS \"column\", count(*) FILTER (even) AS n_true FROM f UNION ALL SELECT 'small', count(*) FILTER (small) FROM f")
def boolean_columns(spark, d):
    return read.boolean_columns(_flagged(spark, d))


@query("column_to_genes", f"{A_} SELECT gene_id, gene_name FROM var WHERE gene_id <= 10")
def column_to_genes(spark, d):
    return read.column_to_genes(_flagged(spark, d), "small")


@query("identifier_columns", f"{A_} SELECT 'gene_name' AS \"column\", count(DISTINCT gene_name) AS n_unique FROM var UNION ALL SELECT 'key', count(DISTINCT gene_id) FROM var")
def identifier_columns(spark, d):
    return read.identifier_columns(_flagged(spark, d))


@query("swap_index", f"{A_} SELECT gene_id, CASE WHEN gene_id < 9 THEN 'a' ELSE 'b' END || CASE WHEN k = 0 THEN '' ELSE '-' || k END AS gene_name, gene_name AS previous_name FROM (SELECT *, row_number() OVER (PARTITION BY gene_id < 9 ORDER BY gene_id) - 1 AS k FROM var)")
def swap_index(spark, d):
    return read.swap_index(_flagged(spark, d).select("gene_id", "gene_name", "kind"), "kind")


@query("median_label_position", f"{B_} SELECT label, {q6('median(v[1])')} AS x, {q6('median(v[2])')} AS y, count(*) AS n FROM e GROUP BY 1")
def median_label_position(spark, d):
    ds = bindings.vectors(spark, d)
    return read.label_positions(ds.obsm["spatial"], ds.obs, "label").select("label", r6("x").alias("x"), r6("y").alias("y"), "n")


TOTALS = "t AS (SELECT obs.cell_id, coalesce(sum(value) FILTER (value > 0), 0) AS total, count(value) FILTER (value > 0) AS n_genes FROM obs LEFT JOIN x USING (cell_id) GROUP BY 1)"


@query("filter_cells", f"{A_}, {TOTALS} SELECT * FROM t WHERE total >= 300 AND total <= 1500 AND n_genes >= 12")
def filter_cells(spark, d):
    ds = bindings.counts(spark, d)
    return select.filter_cells(ds.x, ds.obs, min_counts=300, max_counts=1500, min_genes=12)


@query("filter_cells_active", f"{A_}, {TOTALS} SELECT t.* FROM t JOIN obs USING (cell_id) WHERE total >= 900 OR segment <> 'BUILDING'")
def filter_cells_active(spark, d):
    ds = bindings.counts(spark, d)
    return select.filter_cells(ds.x, ds.obs, min_counts=900, active=ds.obs.where("segment = 'BUILDING'"))


@query("filter_genes", f"{A_}, t AS (SELECT gene_id, sum(value) AS total, count(*) AS n_cells FROM x WHERE cell_id IN (SELECT cell_id FROM obs WHERE region = 'ASIA') AND value > 0 GROUP BY 1), g AS (SELECT gene_id, coalesce(total, 0) AS total, coalesce(n_cells, 0) AS n_cells FROM var LEFT JOIN t USING (gene_id)) SELECT * FROM g WHERE n_cells >= (SELECT 0.15 * count(*) FROM obs)")
def filter_genes(spark, d):
    ds = bindings.counts(spark, d)
    return select.filter_genes(ds.x, ds.var, min_cells=0.15 * ds.obs.count(), active=ds.obs.where("region = 'ASIA'"))


@query("exclude_genes", f"{A_} SELECT gene_id, gene_name FROM var WHERE gene_name NOT IN ('Brand#3', 'Brand#5') AND NOT regexp_matches(gene_name, '^(?:Brand#1[0-4])') AND NOT regexp_matches(gene_name, '^(?:#2)')")
def exclude_genes(spark, d):
    return select.exclude_genes(bindings.counts(spark, d).var, ["Brand#3", "Brand#5"], ["Brand#1[0-4]", "#2"])


@query("delete_cells", f"{A_} SELECT cell_id, segment FROM obs WHERE region <> 'EUROPE'")
def delete_cells(spark, d):
    obs = bindings.counts(spark, d).obs
    return select.delete_cells(obs, obs.where("region = 'EUROPE'").select("cell_id")).select("cell_id", "segment")


@query("cell_context", f"{A_} SELECT cell_id FROM obs WHERE segment IN ('BUILDING', 'MACHINERY')")
def cell_context(spark, d):
    return select.cell_context(bindings.counts(spark, d).obs, column="segment", values=["BUILDING", "MACHINERY"])


@query("gene_mask", f"{A_}, {FLAGS} SELECT gene_id, (even OR small) AND NOT gene_id < 9 AS visible FROM f")
def gene_mask(spark, d):
    var = _flagged(spark, d).withColumn("first", F.col("gene_id") < 9)
    return select.mask_genes(var, ["even", "small"], ["first"]).select("gene_id", "visible")


@query("gene_subset_combine", f"{A_}, {FLAGS} SELECT gene_id FROM f WHERE even AND small UNION ALL SELECT gene_id + 1000 FROM f WHERE even OR small")
def gene_subset_combine(spark, d):
    var = _flagged(spark, d)
    both = select.subset_genes(var, ["even", "small"]).select("gene_id")
    return both.union(select.subset_genes(var, {"columns": ["even", "small"], "operation": "union"}).select(F.col("gene_id") + 1000))


@query("match_names", f"{A_} SELECT gene_id, gene_name FROM var WHERE regexp_matches(gene_name, '#.*[13579]$')")
def match_names(spark, d):
    return select.match_names(bindings.counts(spark, d).var, "#.*[13579]$", "regex")


@query("split_present", "SELECT * FROM (VALUES (0, 'Brand#4', 4, true), (1, 'nothing', NULL, false), (2, 'Brand#25', 25, true)) t(pos, gene_name, gene_id, present)")
def split_present(spark, d):
    return select.split_present(bindings.counts(spark, d).var, ["Brand#4", "nothing", "Brand#25"])


@query("lookup_fallback", "SELECT * FROM (VALUES ('Brand#4', 4), ('BRAND#7', 7), ('none', NULL)) t(asked, gene_id)")
def lookup_fallback(spark, d):
    return select.lookup_genes(bindings.counts(spark, d).var, ["Brand#4", "BRAND#7", "none"])


def _value(spark, d):
    return bindings.counts(spark, d).obs.select("cell_id", F.col("acctbal").alias("value"))


for _mode, _lo, _hi, _test in (("above", 2500.0, None, "acctbal >= 2500"), ("below", None, 100.0, "acctbal <= 100"), ("between", 0.0, 5000.0, "acctbal BETWEEN 0 AND 5000")):

    @query(f"threshold_{_mode}", f"{A_} SELECT cell_id FROM obs WHERE {_test}")
    def threshold(spark, d, mode=_mode, lo=_lo, hi=_hi):
        return select.threshold(_value(spark, d), mode, lo, hi)


@query("default_threshold", f"{A_}, o AS (SELECT acctbal AS v, row_number() OVER (ORDER BY acctbal) - 1 AS k, count(*) OVER () AS n FROM obs), p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS k, count(*) OVER () AS n FROM o WHERE v > 0) SELECT (SELECT v FROM p WHERE k = n // 2) AS above, (SELECT v FROM o WHERE k = CAST(floor(n * 0.25) AS BIGINT)) AS lo, (SELECT v FROM o WHERE k = CAST(floor(n * 0.75) AS BIGINT)) AS hi")
def default_threshold(spark, d):
    return select.default_thresholds(_value(spark, d))


@query("selection_algebra", f"{A_} SELECT 'add' AS mode, cell_id FROM obs WHERE segment = 'BUILDING' OR region = 'ASIA' UNION ALL SELECT 'intersect', cell_id FROM obs WHERE segment = 'BUILDING' AND region = 'ASIA' UNION ALL SELECT 'remove', cell_id FROM obs WHERE segment = 'BUILDING' AND region <> 'ASIA' UNION ALL SELECT 'replace', cell_id FROM obs WHERE region = 'ASIA'")
def selection_algebra(spark, d):
    obs = bindings.counts(spark, d).obs
    marked = obs.select("cell_id", (F.col("segment") == "BUILDING").alias("current"), (F.col("region") == "ASIA").alias("new"))
    return select.combined(marked, ["add", "intersect", "remove", "replace"])


@query("label_high_low", f"{A_} SELECT cell_id, CASE WHEN acctbal >= 5000 THEN 'high' ELSE 'low' END AS label FROM obs WHERE region = 'ASIA'")
def label_high_low(spark, d):
    obs = bindings.counts(spark, d).obs
    return select.label_high_low(obs.where("region = 'ASIA'").select("cell_id"), select.threshold(_value(spark, d), "above", 5000.0))


POLYGON = [(-0.15, -0.12), (0.1, -0.2), (0.2, 0.05), (0.02, 0.01), (-0.05, 0.18)]
_EDGES = ", ".join(f"({xi}, {yi}, {xj}, {yj})" for (xi, yi), (xj, yj) in zip(POLYGON, [POLYGON[-1], *POLYGON[:-1]], strict=True))


@query("polygon_select", f"{B_}, ed(xi, yi, xj, yj) AS (VALUES {_EDGES}) SELECT cell_id FROM pts, ed GROUP BY cell_id HAVING count(*) FILTER ((CAST(yi AS DOUBLE) > y) <> (CAST(yj AS DOUBLE) > y) AND x < CAST(xj - xi AS DOUBLE) * (y - CAST(yi AS DOUBLE)) / CAST(yj - yi AS DOUBLE) + CAST(xi AS DOUBLE)) % 2 = 1")
def polygon_select(spark, d):
    return select.polygon_select(read.embedding_view(bindings.vectors(spark, d).obsm["spatial"]), POLYGON)


@query("label_cells", f"{A_} SELECT cell_id, CASE WHEN region = 'ASIA' THEN 'east' ELSE 'unassigned' END AS mine FROM obs")
def label_cells(spark, d):
    obs = bindings.counts(spark, d).obs
    return annotate.label_cells(annotate.create_annotation(obs, "mine"), "mine", "east", obs.where("region = 'ASIA'")).select("cell_id", "mine")


@query("rename_label", f"{A_} SELECT cell_id, CASE WHEN segment = 'BUILDING' THEN 'House' ELSE segment END AS segment FROM obs")
def rename_label(spark, d):
    return annotate.rename_label(bindings.counts(spark, d).obs, "segment", "BUILDING", " House ").select("cell_id", "segment")


@query("merge_labels", f"{A_} SELECT CASE WHEN segment IN ('BUILDING', 'FURNITURE') THEN 'home' ELSE segment END AS segment, count(*) AS n FROM obs GROUP BY 1")
def merge_labels(spark, d):
    return annotate.merge_labels(bindings.counts(spark, d).obs, "segment", ["BUILDING", "FURNITURE"], "home").groupBy("segment").agg(F.count("*").alias("n"))


@query("transfer_labels", "SELECT doc_id AS cell_id, CASE WHEN s IS NULL OR s = 'unassigned' THEN lang ELSE lang || '_' || s END AS lang FROM (SELECT doc_id, lang, CASE WHEN quality = 0 THEN 'unassigned' ELSE 'q' || quality END AS s FROM documents LEFT JOIN labels USING (doc_id))")
def transfer_labels(spark, d):
    docs = bindings.table(spark, d, "documents").join(bindings.table(spark, d, "labels"), "doc_id", "left")
    obs = docs.select(F.col("doc_id").alias("cell_id"), "lang", F.when(F.col("quality") == 0, "unassigned").otherwise(F.concat(F.lit("q"), "quality")).alias("s"))
    return annotate.transfer_labels(obs, "lang", "s", "parent_prefix").select("cell_id", "lang")


@query("gene_set_algebra", f"{A_}, s AS (SELECT 0 AS set_no, gene_id AS pos, gene_name AS gene FROM var WHERE gene_id <= 10 UNION ALL SELECT 1, 100 - gene_id, gene_name FROM var WHERE gene_id BETWEEN 6 AND 15), g AS (SELECT gene, arg_min(set_no, set_no * 1000 + pos) AS set_no, arg_min(pos, set_no * 1000 + pos) AS pos, count(*) AS k, min(set_no) AS low FROM s GROUP BY 1) SELECT 'union' AS op, gene, set_no, pos FROM g UNION ALL SELECT 'intersection', gene, set_no, pos FROM g WHERE k = 2 UNION ALL SELECT 'difference', gene, set_no, pos FROM g WHERE k = 1 AND low = 0 UNION ALL SELECT 'symmetric', gene, set_no, pos FROM g WHERE k = 1")
def gene_set_algebra(spark, d):
    var = bindings.counts(spark, d).var
    s = var.where("gene_id <= 10").select(F.lit(0).alias("set_no"), F.col("gene_id").alias("pos"), F.col("gene_name").alias("gene"))
    s = s.union(var.where("gene_id BETWEEN 6 AND 15").select(F.lit(1), 100 - F.col("gene_id"), "gene_name"))
    out = None
    for op in ("union", "intersection", "difference", "symmetric"):
        one = annotate.gene_set_algebra(s, op).select(F.lit(op).alias("op"), "gene", "set_no", "pos")
        out = one if out is None else out.union(one)
    return out


@query("case_convention", f"{T_} SELECT gene_id, upper(gene_name) AS human, upper(left(gene_name, 1)) || lower(substr(gene_name, 2)) AS mouse FROM var")
def case_convention(spark, d):
    n = F.col("gene_name")
    return bindings.counts(spark, d, True).var.select("gene_id", annotate.case_convention(n, "human").alias("human"), annotate.case_convention(n, "mouse").alias("mouse"))


@query("pattern_flag", f"{A_} SELECT gene_id, starts_with(gene_name, 'Brand#2') AS two FROM var")
def pattern_flag(spark, d):
    return annotate.flag_genes(bindings.counts(spark, d).var, "two", "Brand#2").select("gene_id", "two")


@query("pattern_sum", f"{A_} SELECT cell_id, coalesce(sum(value) FILTER (starts_with(gene_name, 'Brand#2')), 0) AS total FROM obs LEFT JOIN x USING (cell_id) LEFT JOIN var USING (gene_id) GROUP BY 1")
def pattern_sum(spark, d):
    ds = bindings.counts(spark, d)
    return annotate.sum_pattern(ds.x, ds.obs, ds.var, "Brand#2")


@query("species_prefixes", f"{T_} SELECT prefix, count(*) AS n FROM (SELECT regexp_extract(gene_name, '^(.+?_+).', 1) AS prefix FROM var) WHERE prefix <> '' GROUP BY 1 HAVING count(*) >= greatest(2, ceil(0.1 * (SELECT count(*) FROM var)))")
def species_prefixes(spark, d):
    return annotate.species_prefixes(bindings.counts(spark, d, True).var, 0.1)


PREFIXES = {"S": "other", "SMALL_": "small", "STANDARD_": "standard", "STAN": "wrong", "PROMO_": "promo"}
_SPECIES = "CASE WHEN starts_with(gene_name, 'STANDARD_') THEN 'standard' WHEN starts_with(gene_name, 'SMALL_') THEN 'small' WHEN starts_with(gene_name, 'PROMO_') THEN 'promo' WHEN starts_with(gene_name, 'STAN') THEN 'wrong' WHEN starts_with(gene_name, 'S') THEN 'other' ELSE 'unknown' END"


@query("species_column", f"{T_} SELECT gene_id, {_SPECIES} AS species FROM var")
def species_column(spark, d):
    return annotate.species_column(bindings.counts(spark, d, True).var, PREFIXES).select("gene_id", "species")


_SC = f"sc AS (SELECT cell_id, coalesce(sum(value) FILTER (s = 'small'), 0) AS small_counts, coalesce(sum(value) FILTER (s = 'standard'), 0) AS standard_counts FROM obs LEFT JOIN x USING (cell_id) LEFT JOIN (SELECT gene_id, {_SPECIES} AS s FROM var) USING (gene_id) GROUP BY 1)"


def _species(spark, d):
    ds = bindings.counts(spark, d, True)
    return annotate.species_counts(ds.x, ds.obs, annotate.species_column(ds.var, PREFIXES), ["small", "standard"])


@query("species_counts", f"{T_}, {_SC} SELECT * FROM sc")
def species_counts(spark, d):
    return _species(spark, d)


@query("assign_species", f"{T_}, {_SC} SELECT cell_id, CASE WHEN small_counts + standard_counts <= 0 THEN 'unassigned' WHEN greatest(small_counts, standard_counts) / (small_counts + standard_counts) >= 0.6 THEN CASE WHEN small_counts >= standard_counts THEN 'small' ELSE 'standard' END ELSE 'mixed' END AS species, round(CASE WHEN small_counts + standard_counts > 0 THEN greatest(small_counts, standard_counts) / (small_counts + standard_counts) END, 6) + 0.0 AS fraction FROM sc")
def assign_species(spark, d):
    return annotate.assign_species(_species(spark, d), ["small", "standard"], 0.6).withColumn("fraction", r6("fraction"))


@query("rename_genes", f"{A_} SELECT gene_id, regexp_replace(gene_name, '^Brand#([0-9]+)$', 'g\\1') AS gene_name, gene_name AS original_name FROM var")
def rename_genes(spark, d):
    return annotate.rename_genes(bindings.counts(spark, d).var, "^Brand#([0-9]+)$", "g$1")


@query("rename_genes_unique", f"{T_} SELECT gene_id, n || CASE WHEN k = 0 THEN '' ELSE '-' || k END AS gene_name, gene_name AS original_name FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY gene_id) - 1 AS k FROM (SELECT *, regexp_replace(gene_name, '^[A-Z]+_', '') AS n FROM var))")
def rename_genes_unique(spark, d):
    return annotate.rename_genes(bindings.counts(spark, d, True).var, "^[A-Z]+_", "", make_unique=True)


@query("gmt_export", f"{A_} SELECT 'set' || (gene_id % 3) || chr(9) || 'up' || chr(9) || string_agg(gene_name, chr(9) ORDER BY gene_id) AS value FROM var GROUP BY gene_id % 3")
def gmt_export(spark, d):
    var = bindings.counts(spark, d).var
    return gs.gmt_lines(var.select(F.concat(F.lit("set"), F.col("gene_id") % 3).alias("set_name"), F.lit("up").alias("direction"), F.col("gene_id").alias("pos"), F.col("gene_name").alias("gene")))


@query("draw_order", f"{A_} SELECT cell_id, value, weight, row_number() OVER (ORDER BY weight, value, cell_id) AS place FROM (SELECT cell_id, coalesce(value, 0) AS value, CASE WHEN segment = 'BUILDING' THEN 1 ELSE 0 END AS weight FROM obs LEFT JOIN (SELECT cell_id, value FROM x WHERE gene_id = 7) USING (cell_id))")
def draw_order(spark, d):
    from matriq.operators import order
    from matriq.operators.score import expression

    ds = bindings.counts(spark, d)
    weight = ds.obs.select("cell_id", F.when(F.col("segment") == "BUILDING", 1).otherwise(0).alias("weight"))
    return order.draw_order(expression(ds.x, ds.obs, 7).join(weight, "cell_id"))
