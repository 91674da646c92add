"""Corpus pipeline: five stages over the documents table, each written as Parquet and read again.

Toxic documents go, one document of each near-duplicate group stays, repeated passages are cut,
documents that hold benchmark items go, and what is left is packed into token sequences.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cachelens.llm import common, decontamination, near_dedup, packing, substring_dedup, toxicity

STAGES = [
    ("toxicity", toxicity.stage),
    ("near_dedup", near_dedup.stage),
    ("substring_dedup", substring_dedup.stage),
    ("decontamination", decontamination.stage),
    ("packing", packing.stage),
]

#: The toxicity and packing stages are no SQL: tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that pass all stages."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        path = f"{common.scratch_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
