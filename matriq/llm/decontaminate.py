"""Benchmark decontamination by winnowing. DataFrame functions only.

The smallest k-gram hash of every w neighbouring k-grams is a fingerprint, so a text and an item that
share k + w - 1 words share a fingerprint. Documents that share one are read again, and their
hits are extended to whole windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.llm.common import ascii_lower, broadcast_if_small, materialize, read

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, KGRAM = 10, 5


def words_of(text: Column) -> Column:
    """ASCII-lower-cased words, split at ASCII characters other than letters and digits; none if null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), GAPS), "")


def grams(hashes: Column, n: int) -> Column:
    """Hash of each n neighbouring elements, first to last; none if there are fewer."""
    return F.when(
        F.size(hashes) >= n,
        F.transform(F.sequence(F.lit(0), F.size(hashes) - n), lambda i: F.xxhash64(*(hashes[i + k] for k in range(n)))),
    ).otherwise(F.array().cast("array<bigint>"))


def winnow(kgrams: Column, w: int) -> Column:
    """Distinct minima of each w neighbouring k-gram hashes."""
    return F.when(
        F.size(kgrams) >= w,
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(kgrams) - (w - 1)), lambda i: F.array_min(F.slice(kgrams, i, w)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _hashed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """_id, _words and _h, their hashes; a column each, so that neither is worked out twice."""
    words = df.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("_words"))
    return words.withColumn("_h", F.transform("_words", lambda x: F.xxhash64(x)))


# Generators here are the outer ones: for others Spark adds a filter on the generated array and moves
# it below the projections, which puts the hashes' definition inside the lambda that reads them.
def _fingerprints(hashed: DataFrame, window: int, k: int, short: list[int]) -> DataFrame:
    """hashed with _prints: winnowed k-grams, then all grams as long as a short item."""
    out = hashed.withColumn("_grams", grams(F.col("_h"), k)).withColumn("_prints", winnow(F.col("_grams"), window - k + 1))
    if short:
        out = out.withColumn("_prints", F.concat("_prints", *(grams(F.col("_h"), n) for n in short)))
    return out.drop("_grams")


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = KGRAM,
) -> DataFrame:
    """One row per input row: id, n_words, n_hit, n_items, items (sorted item ids as strings), contaminated.

    A word is hit if it lies in an occurrence of `window` neighbouring words of an item; an item with
    fewer words counts whole, one with none never. Windows are compared by two independent hashes of their words.
    Null or empty texts have no words and no hits. Rows that repeat an id are taken as the same
    document (hits of either count for both); null ids are an id like others. Empty tables: no rows,
    or no hits. Extra columns are ignored.
    """
    if not 0 < k <= window:
        raise ValueError("k must be between 1 and window")
    item = materialize(_hashed(items, item_id_col, item_text_col).where(F.size("_words") > 0).withColumn("_n", F.least(F.size("_words"), F.lit(window))))
    short = sorted(r[0] for r in item.where(F.col("_n") < window).select("_n").distinct().collect())  # fewer than `window` numbers
    prints = _fingerprints(item, window, k, []).select(
        F.explode_outer(F.when(F.col("_n") < window, F.array(F.element_at(_any_gram("_h", short), 1))).otherwise(F.col("_prints"))).alias("_print")
    )
    prints = broadcast_if_small(prints.distinct())
    marked = _fingerprints(_hashed(docs, id_col, text_col), window, k, short)
    found = marked.select("_id", F.explode_outer("_prints").alias("_print")).where("_print IS NOT NULL").join(prints, "_print", "left_semi").select("_id").distinct()
    found = materialize(found)

    spans = materialize(_windows(item, window, short).select("_a", "_b", "_n", F.col("_id").alias("_item")).distinct())
    again = docs.join(broadcast_if_small(found), docs[id_col].eqNullSafe(found["_id"]), "left_semi")
    # A window counts once however many items have it; the items come in by the windows that a document has.
    distinct = broadcast_if_small(materialize(spans.select("_a", "_b", "_n").distinct()))
    hits = materialize(_windows(_hashed(again, id_col, text_col), window, short).join(distinct, ["_a", "_b", "_n"], "left_semi"))
    ends = F.array_sort(F.collect_set(F.struct("_at", (F.col("_at") + F.col("_n")).alias("_end"))))  # no more than the document has words
    none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        "_spans", none, lambda x, s: F.struct((x["n"] + F.greatest(s["_end"] - F.greatest(x["end"], s["_at"]), F.lit(0))).alias("n"), F.greatest(x["end"], s["_end"]).alias("end")), lambda x: x["n"].cast("long")
    )
    n_hit = hits.groupBy("_id").agg(ends.alias("_spans")).select("_id", covered.alias("n_hit"))
    by_item = hits.select("_id", "_a", "_b", "_n").distinct().join(broadcast_if_small(spans), ["_a", "_b", "_n"]).select("_id", F.col("_item").cast("string").alias("_item")).distinct()
    named = by_item.groupBy("_id").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list("_item")).alias("items"))
    hit = n_hit.join(named, n_hit["_id"].eqNullSafe(named["_id"])).select(n_hit["_id"].alias("_hit_id"), "n_hit", "n_items", "items")
    counts = docs.select(F.col(id_col).alias("_id"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
    out = counts.join(hit, counts["_id"].eqNullSafe(hit["_hit_id"]), "left")
    return out.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def _any_gram(h: str, short: list[int]) -> Column:
    """The hash of all words of an item whose length is in `short`, as an array of one."""
    c = F.col(h)
    out = F.array().cast("array<bigint>")
    for n in short:
        out = F.when(F.size(c) == n, grams(c, n)).otherwise(out)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.lit(0).cast("bigint")))


def _windows(hashed: DataFrame, window: int, short: list[int]) -> DataFrame:
    """_id, _at, _n and two hashes of each window; an item (has column _n) shorter than a window gives itself alone."""
    two = hashed.withColumn("_g", F.transform("_words", lambda x: F.xxhash64(x, F.lit("second"))))
    out = None
    for n in [window, *short]:
        one = two.where(F.size("_h") >= n)
        if "_n" in hashed.columns:
            one = one.where(F.col("_n") == n)
        one = one.select("_id", F.inline_outer(_pairs(F.col("_h"), F.col("_g"), n))).withColumn("_n", F.lit(n))
        out = one if out is None else out.union(one)
    return out


def _pairs(h: Column, g: Column, n: int) -> Column:
    def pair(i: Column) -> Column:
        return F.struct(F.xxhash64(*(h[i + j] for j in range(n))).alias("_a"), F.xxhash64(*(g[i + j] for j in range(n))).alias("_b"), i.alias("_at"))

    return F.transform(F.sequence(F.lit(0), F.size(h) - n), pair)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    ids = F.sha2(F.array_join("items", ","), 256)
    return out.select("doc_id", "n_words", "n_hit", "n_items", ids.alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM bn)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, ns WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, item_id, s, n FROM dw JOIN bw USING (n, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
