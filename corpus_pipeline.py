"""Training-corpus pipeline: toxicity, language, near duplicates, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesta.llm import stages
from attesta.llm.common import new_path

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("language", stages.identify_language),
    ("near_duplicates", stages.drop_near_duplicates),
    ("mixing", stages.mix_sources),
    ("sentencepiece", stages.encode_pieces),
]

#: No SQL expresses the trained stages and the approximate candidate search; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is a written table, so a lost executor costs one stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
