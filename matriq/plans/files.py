"""Files and streams: what is written is read back and compared, over customers by brands and over events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from matriq import bindings, dataset
from matriq.lineage import cut
from matriq.operators import normalize, select
from matriq.operators.order import positions
from matriq.plans.base import NORM, A, B, q6, query, r6
from matriq.sources import gene_sets as gs
from matriq.sources import store, tenx
from matriq.streaming import counts as streaming

A_ = "WITH " + A


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; in a temporary one only where that is unset and all runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="matriq-")
    return f"{found.rstrip('/')}/files-{uuid.uuid4().hex}"


@query("mtx_round_trip", f"{A_} SELECT cell_name, gene_name, CAST(value AS DOUBLE) AS value FROM x JOIN obs USING (cell_id) JOIN var USING (gene_id)")
def mtx_round_trip(spark, d):
    """A Matrix Market folder, written in parts with numbers by name, the sizes in the first, and opened again."""
    ds, path = bindings.counts(spark, d), scratch(spark)
    x = cut(ds.x.join(ds.obs.select("cell_id", "cell_name"), "cell_id").join(F.broadcast(ds.var), "gene_id").select("cell_name", "gene_name", "value"))
    cells, genes = (positions(x.select(c).distinct(), c, c, name=f"{c}_n") for c in ("cell_name", "gene_name"))
    x = x.join(cells, "cell_name").join(F.broadcast(genes), "gene_name")
    lines = x.select(F.concat_ws(" ", F.col("gene_name_n") + 1, F.col("cell_name_n") + 1, "value").alias("value"))
    head = spark.createDataFrame([(f"%%MatrixMarket matrix coordinate real general\n{genes.count()} {cells.count()} {x.count()}",)], "value string").coalesce(1)
    head.unionAll(lines).write.text(f"{path}/matrix.mtx")
    for c, name in (("cell_name", "barcodes.tsv"), ("gene_name", "features.tsv")):
        (cells if c == "cell_name" else genes).orderBy(f"{c}_n").select(c).write.text(f"{path}/{name}")
    got = tenx.read_trio(spark, *(f"{path}/{n}/part*" for n in ("matrix.mtx", "barcodes.tsv", "features.tsv")))
    return got.x.join(got.obs, "cell_id").join(got.var, "gene_id").select("cell_name", "gene_name", "value")


@query("stored_round_trip", f"{A_} SELECT cell_id, gene_id, CAST(value AS DOUBLE) AS value FROM x")
def stored_round_trip(spark, d):
    ds, path = bindings.counts(spark, d), scratch(spark)
    store.save(ds.logged("saved"), path)
    return store.open_any(spark, path).x.select("cell_id", "gene_id", "value")


@query("cached_dataset", f"{A_} SELECT gene_id, gene_name FROM var")
def cached_dataset(spark, d):
    """Built once, stored, and opened the second time without building."""
    path = scratch(spark)
    store.cached(spark, path, lambda: bindings.counts(spark, d))
    return store.cached(spark, path, lambda: 1 / 0).var.select("gene_id", "gene_name")


@query("export_annotations", f"{A_} SELECT CAST(cell_id AS VARCHAR) AS cell_id, segment, region FROM obs")
def export_annotations(spark, d):
    path = scratch(spark)
    store.export_annotations(bindings.counts(spark, d).obs, path, ["segment", "region"])
    return spark.read.csv(path, sep="\t", header=True)


@query("loaded_slots", f"{A_} SELECT 'primary' AS slot, (SELECT count(*) FROM obs) AS n UNION ALL SELECT 'second', (SELECT count(*) FROM obs WHERE segment = 'BUILDING')")
def loaded_slots(spark, d):
    """Two datasets in slots, a third one unloaded."""
    slots, ds = dataset.Registry(), bindings.counts(spark, d)
    slots.load(ds, views=False)
    slots.load(ds.select_cells(ds.obs.where("segment = 'BUILDING'")), "second", views=False)
    slots.load(ds, "third", views=False)
    slots.unload("third")
    parts = [slots.get(n).obs.agg(F.count("*").alias("n")).select(F.lit(n).alias("slot"), "n") for n in slots.names()]
    return parts[0].union(parts[1])


@query("gene_list_import", f"{A_} SELECT 'set' || (gene_id % 3) AS set_name, 'up' AS direction, row_number() OVER (PARTITION BY gene_id % 3 ORDER BY gene_id) - 1 AS pos, gene_name AS gene FROM var")
def gene_list_import(spark, d):
    """Sets written as GMT lines and read again."""
    path, var = scratch(spark), bindings.counts(spark, d).var
    sets = var.select(F.concat(F.lit("set"), F.col("gene_id") % 3).alias("set_name"), F.lit("up").alias("direction"), F.col("gene_id").alias("pos"), F.col("gene_name").alias("gene"))
    gs.write_gmt(sets, path)
    return gs.read_gmt(spark, path).select("set_name", "direction", F.col("pos").cast("long").alias("pos"), "gene")


@query("gene_set_library", "SELECT * FROM (VALUES ('a', 'T', 'up', 0, 'Brand#11'), ('a', 'T', 'up', 1, 'Brand#12'), ('a', 'U', 'up', 0, 'Brand#13'), ('a', 'U', 'down', 0, 'Brand#14')) v(bundle, set_name, direction, pos, gene)")
def gene_set_library(spark, d):
    """A folder of JSON bundles, one of which does not parse."""
    path = scratch(spark)
    text = '{"sets": [{"name": "T", "genes": ["Brand#11", "Brand#12"]}, {"name": "U", "positive": ["Brand#13"], "negative": ["Brand#14"]}, {"genes": ["x"]}]}'
    for name, value in (("a", text), ("b", "not json")):
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}.json")
        out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
        out.write(bytearray(value.encode()))
        out.close()
    return gs.read_library(spark, path)


@query("cell_and_gene_names", f"{A_} SELECT 'cell' AS kind, cell_id AS id, cell_name AS name FROM obs UNION ALL SELECT 'gene', gene_id, gene_name FROM var")
def cell_and_gene_names(spark, d):
    ds = bindings.counts(spark, d)
    cells = ds.obs.select(F.lit("cell").alias("kind"), F.col("cell_id").alias("id"), F.col("cell_name").alias("name"))
    return cells.union(ds.var.select(F.lit("gene"), F.col("gene_id").cast("long"), "gene_name"))


@query("normalized_view", f"{A_}, {NORM} SELECT cell_id, gene_id, {q6('value')} AS value FROM lx")
def normalized_view(spark, d):
    return normalize.log_normalized(bindings.counts(spark, d).x).select("cell_id", "gene_id", r6("value").alias("value"))


@query("active_subset", f"{A_} SELECT cell_id FROM obs WHERE region = 'ASIA'")
def active_subset(spark, d):
    """Cells given that are there; others are left out."""
    obs = bindings.counts(spark, d).obs
    return select.active_cells(obs, obs.where("region = 'ASIA'").select("cell_id").union(spark.range(-5, 0).toDF("cell_id")))


@query("prerequisites", "SELECT * FROM (VALUES ('neighbors', 'X_pca'), ('umap', 'connectivities'), ('pca_loadings', 'X_pca'), ('pca_loadings', 'PCs')) v(action, needs)")
def prerequisites(spark, d):
    """What actions lack on vectors with coordinates: contours lack nothing."""
    ds = bindings.vectors(spark, d)
    return spark.createDataFrame([(a, n) for a in ("neighbors", "umap", "pca_loadings", "contourize") for n in dataset.missing(ds, a)], "action string, needs string")


@query("spatial_coordinates", f"WITH {B} SELECT cell_id, x, y FROM pts")
def spatial_coordinates(spark, d):
    """The coordinates found under whichever of the usual names they have."""
    ds = bindings.vectors(spark, d)
    m = ds.obsm[dataset.spatial_key(ds)]
    return m.select("cell_id", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


@query("hourly_stream", """WITH e AS (SELECT CAST(ts AS TIMESTAMP) AS ts, user_id, event_type FROM events)
SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS start, user_id AS cell_id, event_type AS gene, CAST(count(*) AS DOUBLE) AS value FROM e
GROUP BY 1, 2, 3 HAVING epoch(time_bucket(INTERVAL 1 HOUR, any_value(ts))) + 3600 <= (SELECT epoch(max(ts)) - 600 FROM e)""")
def hourly_stream(spark, d):
    """Events as a stream: windows that the watermark has passed, each written once."""
    path, source = scratch(spark), f"{d}/events.parquet"
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{d}/event[s].parquet")
    streaming.write_deltas(streaming.windowed_counts(stream, "user_id", "event_type", "ts"), f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out").select(F.unix_timestamp("start").alias("start"), "cell_id", "gene", "value")
