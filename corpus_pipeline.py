"""The corpus pipeline: each stage calls one operator and hands the documents that stay to the next.

Texts, identifiers and columns of documents, whatever they are called, stay as they are up to the last stage, which
packs them. Documents without a text go with the first stage, as they have no language; of rows that repeat doc_id and
text one stays in the second. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kondate.llm import exact_dedup, langid, mixing, ngram_join, packing
from kondate.llm.common import Scratch, broadcast_if_small, read


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the doc_ids of a narrow table: by broadcast while they are few (counted), by shuffle beyond."""
    ids = Scratch(docs.sparkSession, "dropped").table(dropped.select(F.col("doc_id").alias("dropped_id")).distinct(), "ids")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    return rows.join(broadcast_if_small(ids, ids.count()), F.col("id").eqNullSafe(F.col("dropped_id")), "left_anti").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.identify(langid.document_rows(docs), langid.labelled_rows(docs))
    return _without(docs, found.where("not accepted"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = ngram_join.link_components(docs, 5, 80)
    return _without(docs, found.where("doc_id <> component_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample_documents(docs, 0.5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, 4096, 1)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates), ("ngram_jaccard", near_duplicates), ("mixing", mix), ("packing", pack)]

#: Trained likelihoods and best-fit packing have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
