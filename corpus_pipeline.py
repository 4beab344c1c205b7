"""The corpus pipeline: score and drop, clean, deduplicate, decontaminate, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spark_cues.llm import stages
from spark_cues.runtime import discard, materialize, scratch_path, temporary

STAGES = [
    ("toxicity", stages.toxicity),
    ("line_dedup", stages.line_dedup_stage),
    ("simhash_dedup", stages.simhash_dedup),
    ("decontamination", stages.decontamination),
    ("packing", stages.packing),
]

#: Learned scores, fingerprints by XXH64 and tokenizer ids are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn to ``documents``; each stage's rows are written and read again.

    A stage's own tables go when its rows are written, and its input when it was an earlier stage's output.
    """
    docs, read = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, f"pipeline-{name}")
        with temporary(spark):
            docs = materialize(stage(spark, docs, sf_dir), name, path)
        if read:
            discard(spark, read)
        read = path
    return STAGES[-1][1](spark, docs, sf_dir)
