"""The corpus operators as named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import toolcalls

    return toolcalls.digest(_table(spark, sf_dir, "conversations"))


def op2_dartminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import dartminhash

    return dartminhash.digest(_table(spark, sf_dir, "documents"))


def op3_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import suffixes

    return suffixes.digest(_table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import langid

    return langid.digest(_table(spark, sf_dir, "documents"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import matroska

    return matroska.digest(_table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import quality

    return quality.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from pulsegrid.llm import packing

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import paragraphs

    return paragraphs.digest(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import storage, warc

    return warc.digest(_table(spark, sf_dir, "pages"), storage.new_path(spark, "warc"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import fmindex

    return fmindex.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_apportion(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import apportion

    return apportion.digest(_table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import divergence

    return divergence.digest(_table(spark, sf_dir, "documents"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pulsegrid.llm import resampling

    return resampling.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from pulsegrid.llm import apportion, divergence, toolcalls

    return {"op1_toolcalls": toolcalls.ORACLE, "op11_apportion": apportion.ORACLE, "op12_divergence": divergence.ORACLE}
