"""Mixing sources to target weights by Efraimidis-Spirakis sampling: whole epochs first, then a weighted draw without return.

A document's key is -ln(u) / quality, u being a hash of the document: the order of the keys within a source is a draw in which
better documents tend to come first. A source takes all its documents as often as its target holds them, then documents by
key until the target's words are spent; the one at the edge gives the words that still fit.
No source is ever sorted whole: sums over ranges of keys find the range with the edge, which is cut again until it is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matriq.llm.common import attach, broadcast_if_small, discard, materialize, read
from matriq.operators.order import positions

GAP = r"\x20\x09-\x0D"
#: Ranges that a source's keys are cut into in a round, and the rows at the edge that one task sorts.
RANGES, EDGE_ROWS = 1024, 2000
#: A document's quality weight by its label; documents without one are between.
GOOD, UNKNOWN, POOR = 2.0, 1.0, 0.5


def n_words(text: Column) -> Column:
    """Words parted by ASCII white space; 0 for null. Every word, with the space before it, becomes one letter."""
    ends = F.rtrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.length(F.regexp_replace(ends, f"[{GAP}]*[^{GAP}]+", "x")).cast("long")


def uniform(row_id: Column, text: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on id, text and seed alone."""
    name = F.concat_ws(":", F.lit(seed), row_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with its place, from 0, in order of a column of distinct values of any type: sorted by ranges, counted by partition."""
    parts = materialize(df.orderBy(column).withColumn("_part", F.spark_partition_id()).withColumn(name, F.monotonically_increasing_id()))
    ends = parts.groupBy("_part").agg(F.count("*").alias("_c"))
    ends = ends.select("_part", (F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).alias("_before"))
    place = F.col(name).bitwiseAND((1 << 33) - 1) + F.col("_before")
    return parts.join(F.broadcast(ends), "_part").withColumn(name, place).drop("_part", "_before")


def targets(sources: DataFrame, weights: Sequence[int], ratio: tuple[int, int], most: int) -> DataFrame:
    """sources (sk, source_size) with column target: shares by weight of ratio * all sizes, none above most times its size.

    What is above a source's bound is shared out again among the others, by weight, in rounds of one aggregate each, until no
    source is above; weights repeat over the sources in order of sk.
    """
    num, den = ratio
    n = F.pmod(F.col("_n"), F.lit(len(weights)))
    s = materialize(numbered(sources, "sk", "_n").withColumn("_w", F.element_at(F.array(*(F.lit(w) for w in weights)), n.cast("int") + 1)).drop("_n"))
    all_size, all_w = s.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
    big = lambda x: F.lit(Decimal(x)).cast("decimal(19,0)")
    left, w = num * all_size, all_w
    while True:
        above = big(left) * F.col("_w") > big(den * most) * F.col("source_size") * big(w)
        size, gone = s.where(above).agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("_w"), F.lit(0))).first()
        after = (num * all_size - den * most * size, all_w - gone)
        if after in ((left, w), (after[0], 0)):
            break
        left, w = after
    share = F.lit(float(left)) * F.col("_w") / F.lit(float(max(den * w, 1)))
    return s.withColumn("target", F.when(above, F.col("source_size").cast("double") * most).otherwise(share)).drop("_w")


def _edges(keyed: DataFrame, cut: DataFrame) -> DataFrame:
    """cut (sk, before, part, lo, hi, n): for each source the range of keys [lo, hi] with the edge, and the size before it.

    Ranges of more than EDGE_ROWS rows are cut in RANGES, by sums of size for each; no round sees rows outside of them.
    """
    done = None
    while True:
        wide = (F.col("n") > EDGE_ROWS) & (F.col("lo") < F.col("hi"))
        few = cut.where(~wide)
        done = few if done is None else done.unionByName(few)
        cut = materialize(cut.where(wide))
        if cut.isEmpty():
            return materialize(done)
        within = attach(keyed, cut, "sk", ["part", "before", "lo", "hi"], "key").where(F.col("key").between(F.col("lo"), F.col("hi")))
        place = F.least(F.floor((F.col("key") - F.col("lo")) / (F.col("hi") - F.col("lo")) * RANGES), F.lit(RANGES - 1))
        sums = within.groupBy("sk", place.alias("_b")).agg(
            F.sum("size").alias("_s"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi"), F.first("before").alias("before"), F.first("part").alias("part")
        )
        up_to = F.sum("_s").over(Window.partitionBy("sk").orderBy("_b"))
        sums = sums.withColumn("before", F.col("before") + up_to - F.col("_s")).where(F.col("before") <= F.col("part"))
        cut = materialize(sums.groupBy("sk").agg(F.max_by(F.struct("part", "before", "lo", "hi", "n"), "_b").alias("_e")).select("sk", "_e.*"))


def mix(
    docs: DataFrame,
    quality: DataFrame | None = None,
    weights: Sequence[int] = (3, 1, 2),
    ratio: tuple[int, int] = (3, 2),
    most: int = 2,
    seed: str = "mix",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per row of docs: id, source, size (words), source_size, target (words of its source), taken (words of it, repeats counted).

    quality: (id_col, weight), positive, at most one row an id; others weigh 1. weights: of the sources in order of code point,
    null last, repeating. ratio: the mix's words by all words. most: times that a source may be taken at most.
    A source's taken words are its target rounded, exactly. Null and empty texts have size 0 and give nothing. Keys depend on
    id, text and seed, so reruns agree; equal rows share a key, and which of them gives words makes no difference. Null
    ids are rows like others; no rows give none; other columns are ignored.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.when(F.col(source_col).isNull(), "t").otherwise(F.concat(F.lit("s"), source_col)).alias("sk"),
        n_words(F.col(text_col)).alias("size"),
        uniform(F.col(id_col), F.col(text_col), seed).alias("u"),
    )
    weight = F.lit(1.0)
    if quality is not None:
        q = broadcast_if_small(quality.select(F.col(id_col).alias("_q"), F.col("weight").alias("_w")))
        rows, weight = rows.join(q, rows["id"] == q["_q"], "left"), F.coalesce("_w", F.lit(1.0))
    keyed = materialize(rows.select("id", "sk", "size", (-F.log("u") / weight).alias("key")))
    sources = materialize(keyed.groupBy("sk").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")))
    t = materialize(targets(sources, weights, ratio, most))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.round("target") / F.col("source_size"))).otherwise(0).cast("long")
    t = materialize(t.withColumn("epochs", epochs).withColumn("part", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")))
    edges = _edges(keyed, t.select("sk", "part", F.lit(0).cast("long").alias("before"), "lo", "hi", "n"))
    goal = t.select("sk", "source_size", "target", "epochs").join(edges.select("sk", "part", "before", "lo", "hi", "n"), "sk")
    add = ["source_size", "target", "epochs", "part", "before", "lo", "hi", "n"]
    goal = materialize(goal)
    out = materialize(attach(keyed, goal, "sk", add, "key"))
    discard(keyed, sources, t, edges)
    inside = F.col("key").between(F.col("lo"), F.col("hi"))
    same = inside & (F.col("lo") == F.col("hi")) & (F.col("n") > EDGE_ROWS)
    outer = out.where(~inside).withColumn("_part", F.when(F.col("key") < F.col("lo"), F.col("size")).otherwise(0))
    turn = Window.partitionBy("sk").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spare = F.col("part") - F.col("before")
    edge = out.where(inside & ~same).withColumn("_part", spare - (F.sum("size").over(turn) - F.col("size")))
    parts = outer.unionByName(edge)
    alike = out.where(same)
    if not alike.isEmpty():  # rows that are all equal: numbered by ranges, the first give their words
        place = positions(alike.withColumn("_row", F.monotonically_increasing_id()), "_row", "_row", ["sk"])
        parts = parts.unionByName(place.withColumn("_part", spare - F.col("_k") * F.col("size")).drop("_k", "_row"))
    some = F.greatest(F.lit(0), F.least("_part", "size"))
    source = F.when(F.col("sk") != "t", F.substring("sk", 2, 1 << 30))
    return parts.select(F.col("id").alias(id_col), source.alias(source_col), "size", "source_size", "target", (F.col("epochs") * F.col("size") + some).cast("long").alias("taken"))


def label_quality(labels: DataFrame) -> DataFrame:
    """(doc_id, weight): of a document's quality labels the mean decides; null labels and ids say nothing."""
    mean = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.avg("quality").alias("_m"))
    return mean.select("doc_id", F.when(F.col("_m") > 0.5, GOOD).when(F.col("_m") < 0.5, POOR).otherwise(UNKNOWN).alias("weight"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with weights 3, 1, 2 to 150 percent of their words; nulls as in mix()."""
    return mix(read(spark, sf_dir, "documents"), label_quality(read(spark, sf_dir, "labels")))


SQL = """
WITH q AS (SELECT doc_id, CASE WHEN avg(quality) > 0.5 THEN 2.0 WHEN avg(quality) < 0.5 THEN 0.5 ELSE 1.0 END::DOUBLE AS w
           FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
k AS (SELECT d.doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
      -ln((('0x' || substr(md5(concat_ws(':', 'mix', d.doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / coalesce(q.w, 1.0) AS key
      FROM documents d LEFT JOIN q ON q.doc_id = d.doc_id),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY (source IS NULL)::INT, encode(source)) AS n FROM k GROUP BY source),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS w FROM s),
r AS (SELECT *, row_number() OVER o AS r,
      (3 * (sum(source_size) OVER ()) - 4 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
      (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest_w
      FROM w WINDOW o AS (ORDER BY source_size / w, n)),
f AS (SELECT rest, rest_w FROM r WHERE NOT rest::HUGEINT * w > 4 * source_size::HUGEINT * rest_w ORDER BY r LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN f.rest::HUGEINT * w > 4 * source_size::HUGEINT * f.rest_w THEN 2.0 * source_size ELSE f.rest::DOUBLE * w / (2 * f.rest_w) END AS target
      FROM r, f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(round(target) / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
x AS (SELECT doc_id, k.source, size, source_size, target, epochs, round(target)::BIGINT - epochs * source_size AS part,
      coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, (epochs * size + greatest(0, least(size, part - before)))::BIGINT AS taken FROM x
"""
