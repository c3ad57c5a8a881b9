"""The corpus pipeline: stages over ``documents``, each written as Parquet and read by the next.

A stage is (name, function); the function takes (spark, docs, sf_dir) and returns a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetrank.llm import stages
from facetrank.llm.common import documents, ready, written

STAGES = stages.STAGES

# Classifiers, sampled hashes and tokenizers have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
