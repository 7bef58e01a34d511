"""The corpus pipeline: language ID, near-duplicates, personal data, mixing, packing.

Each stage takes what the one before kept, written as Parquet and read again; the last gives the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from xylem.llm.common import shared_path
from xylem.llm.langid import stage_langid
from xylem.llm.mixing import stage_mixing
from xylem.llm.near import stage_near
from xylem.llm.packing import stage_packing
from xylem.llm.privacy import stage_private

STAGES = [
    ("language ID", stage_langid),
    ("near-duplicates", stage_near),
    ("personal data", stage_private),
    ("mixing", stage_mixing),
    ("packing", stage_packing),
]

# SQL has no form for the tables, sketches, models and plans of these stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{i}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
