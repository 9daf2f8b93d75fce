"""A corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm.common import discard, read_table, write_table
from sheaf.llm.stages import STAGES

#: The stages hold a trained model and iterative grouping, which SQL can't express; tests/llm hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, done = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if done is not None:  # read by no one any more
            discard(done)
        done = docs
    return docs
