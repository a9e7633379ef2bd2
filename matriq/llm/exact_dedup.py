"""Exact dedup by progressive refinement: length, then prefix hash, then full hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.llm.common import ATTACH_ROWS, attach, materialize, read, small

SPACES = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 64


def normal(c: Column) -> Column:
    """Null counts as empty; each run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACES, " ")


def _keys(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """_id, _len, _key (a hash of length and prefix hash), and of the text _t and its digest _full those asked for."""
    t = docs.select(F.col(id_col).alias("_id"), normal(F.col(text_col)).alias("_t"))
    size, head = F.octet_length("_t"), F.xxhash64(F.substring("_t", 1, PREFIX_CHARS))
    return t.select("_id", size.alias("_len"), F.xxhash64(size, head).alias("_key"), *({"_t": F.col("_t"), "_full": _full()}[c].alias(c) for c in more))


def _full() -> Column:
    return F.unhex(F.sha2("_t", 256))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """One row per input row: id, keep_id (smallest id of the group), group_size, kept, digest (binary SHA-256).

    Rows refine by length of the normalised text, then by hash of its prefix, and only groups of two
    or more go on; the full digest is read for those alone, unless digest_all asks for it everywhere
    (else it is null for rows that no other row resembles). Null text equals empty text. Rows that
    repeat an id are rows of their own and all count in group_size; null ids sort first, so a group
    with one has keep_id null and keeps that row. An empty table gives an empty result; extra columns
    are ignored, whatever their names.
    """
    keys = materialize(_keys(docs, id_col, text_col, *(["_full"] if digest_all else [])))
    heads = keys.groupBy("_len", "_key").agg(F.count("*").alias("_n"))
    by_length = heads.groupBy("_len").agg(F.sum("_n").alias("_m")).where("_m > 1").select("_len")
    alike = materialize(heads.where("_n > 1").join(by_length, "_len", "left_semi").select("_key", "_n", F.lit(True).alias("_alike")))

    def among(df: DataFrame) -> DataFrame:
        return attach(df, alike, "_key", ["_alike"], "_id", "_n")

    if digest_all:
        full = among(keys).where("_alike")
        rows = keys
    else:
        # Few groups are broadcast, so the digest can wait for that join; else it goes through the shuffle in place of the text.
        again = among(_keys(docs, id_col, text_col, "_t")) if small(alike, ATTACH_ROWS) else among(_keys(docs, id_col, text_col, "_full"))
        full = materialize(again.where("_alike").select("_id", "_full" if "_full" in again.columns else _full().alias("_full")))
        rows = full.unionByName(among(keys).where("_alike IS NULL").select("_id"), allowMissingColumns=True)
    groups = full.groupBy("_full").agg(
        F.count("*").alias("group_size"), F.min("_id").alias("_low"), F.bool_or(F.col("_id").isNull()).alias("_any_null")
    )
    groups = groups.where("group_size > 1").select("_full", "group_size", F.when(~F.col("_any_null"), F.col("_low")).alias("keep_id"), F.lit(True).alias("_many"))
    out = attach(rows, materialize(groups), "_full", ["group_size", "keep_id", "_many"], "_id", "group_size")
    many = F.coalesce("_many", F.lit(False))
    keep = F.when(many, F.col("keep_id")).otherwise(F.col("_id"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        keep.eqNullSafe(F.col("_id")).alias("kept"),
        F.col("_full").alias("digest"),
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with its digest, which the result asks of all rows; groups still refine by length and prefix first."""
    out = exact_dedup(read(spark, sf_dir, "documents"), digest_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
