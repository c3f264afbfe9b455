"""From raw documents to packed training sequences: quality, near-duplicates, mixture, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from maskbench.llm import jaccard, mixing, packing, quality
from maskbench.llm.base import WORD, split_by_ids, staged, table
from maskbench.llm.catalog import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels beside the tables."""
    judged = quality.classify(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return judged.where("predicted = 1").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies; documents without words all stay.

    The row with the smallest id stays, null ids last and rows of one id in the order of their texts' hashes.
    Copies of it in id and text go too. Other rows are told apart by id and text, so that of two texts with one
    id the one that has no copies stays. Only rows whose id may be gone or repeated are compared and shuffled;
    the rest keeps its place.
    """
    d = docs.select(*COLUMNS)
    rows = staged(jaccard.grouped(d).select("doc_id", "hash", "n_shingles", (
        F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("hash") == F.col("kept.hash"))).alias("stays")))
    gone = rows.where("n_shingles > 0 and not stays").select("doc_id", "hash").distinct()
    twice = rows.where("n_shingles > 0").groupBy("doc_id", "hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "hash")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("hash")).alias("key")
    marked = split_by_ids(d.withColumn("hash", jaccard.text_hash()).select("*", key), gone.union(twice).select(key), "key")
    g = gone.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"))
    compared = F.col("possible") & F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    left = marked.where(compared).join(g, (F.col("hash") == F.col("_hash")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_anti")
    return marked.where(~compared).select(*COLUMNS).unionByName(left.dropDuplicates(["doc_id", "text"]).select(*COLUMNS))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it."""
    return mixing.repeated(mixing.mix(docs.select(*COLUMNS))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every copy's pieces, placed in sequences of 1024 tokens."""
    return packing.pack(docs, tokenizer_path()).drop("ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents), ("near_duplicates", one_of_each_group), ("mixing", mixed_sources), ("packing", packed)]

#: The classifier and the tokenizer cannot be written in SQL; a test compares the stages with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
