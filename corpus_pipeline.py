"""The corpus pipeline: five stages from raw documents to packed sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import dartminhash, fmindex, packing, paragraphs, quality, storage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject.

    Null and empty texts are scored like any other; equal texts share their score, so
    repeated rows stay or go together."""
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near-duplicates, the one with the smallest doc_id.

    Null and wordless texts all stay; of repeated rows one stays."""
    return dartminhash.deduplicated(docs)


def new_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs and passages that occurred before.

    ``n_chars`` follows the text; a document that loses all of its text goes."""
    from pyspark.sql import functions as F

    kept = paragraphs.deduplicated(docs)
    emptied = (F.trim("text") == "") & (F.col("n_chars") > 0)
    kept = kept.where(~F.coalesce(emptied, F.lit(False)))
    return kept.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items, with all columns as they came.

    Null and empty texts stay; repeated rows are judged one by one."""
    return fmindex.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 token ids.

    Null is the empty text, of one token; repeated rows are packed one by one."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("substrings", new_passages), ("decontamination", not_in_benchmark), ("packing", packed)]

#: Learned scores, signatures and tokens have no SQL form; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
