"""From raw documents to token digests, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import stages
from graphloom.plans.ship import shipped
from graphloom.plans.staging import Stage

STAGES = [
    ("toxicity", shipped(stages.drop_toxic)),
    ("simhash_near_dedup", shipped(stages.drop_near_copies)),
    ("benchmark_decontamination", shipped(stages.drop_leaks)),
    ("pii", shipped(stages.redact_private)),
    ("byte_bpe", shipped(stages.encode)),
]

#: SQL can express neither the trained stages nor the encoder; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read as the next input."""
    stage = Stage(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage.cut(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
