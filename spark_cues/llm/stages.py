"""Pipeline stages ``(spark, docs, sf_dir) -> DataFrame``; all but packing keep the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, line_dedup, simhash
from . import packing as packer
from . import toxicity as scorer


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go; the lexicon is fitted on this stage's rows and the labels."""
    lexicon = scorer.fit_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scorer.drop_toxic(docs, lexicon)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cross-site boilerplate lines leave the texts but for their first place; every document stays."""
    return line_dedup.remove_all_boilerplate(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return simhash.drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every remaining document packed; a row per piece."""
    return packer.pack_documents(docs).drop("ids")
