"""A training-text pipeline of five of the operators: STAGES, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matriq.llm import language
from matriq.llm.common import broadcast_if_small, materialize, read
from matriq.llm.decontaminate import decontaminate
from matriq.llm.exact_dedup import exact_dedup
from matriq.llm.ngram_join import jaccard_components
from matriq.llm.pieces import default_model, encode_pieces


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but those whose doc_id is in gone (column gone_id); their texts stay where they are unless gone is large.

    By doc_id alone: where an id repeats with different texts, all of its rows go; rows of null id stay.
    """
    gone = broadcast_if_small(materialize(gone))
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents but those without a language: null texts and texts without a letter. Null languages teach nothing."""
    model = language.train(docs, "doc_id", "text", "lang")
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    others = tuple(c for c in docs.columns if c != "doc_id")
    out = language.identify(docs, model, keep=others, names=("_lang_pred", "_lang_score"))
    return out.where(F.col("_lang_pred") != language.UNDECIDED).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal normalised texts the smallest doc_id stays; rows that repeat both id and text stay once; rows of null id stay."""
    found = exact_dedup(docs)
    kept = _without(docs, found.where(~F.col("kept")).select(F.col("doc_id").alias("gone_id")))
    again = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("doc_id").alias("again_id")))
    if again.isEmpty():
        return kept
    again = broadcast_if_small(again)
    once = kept.join(again, kept["doc_id"].eqNullSafe(again["again_id"]), "left_anti")
    return once.unionByName(kept.join(again, kept["doc_id"].eqNullSafe(again["again_id"]), "left_semi").dropDuplicates(["doc_id", "text"]))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more over shingles of five words connect, the smallest doc_id stays."""
    found = jaccard_components(docs, k=5, percent=80)
    return _without(docs, found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("gone_id")))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of ten words of a benchmark item."""
    found = decontaminate(docs, read(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated").select(F.col("doc_id").alias("gone_id")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, n_bytes, digests, and the ids of each document."""
    return encode_pieces(docs, default_model(), keep=("ids",))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_copies),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pieces", encode),
]

#: Language ID and the tokenizer are no SQL: the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
