"""A training-data pipeline of five stages over `documents`; each stage is one of the operators.

Toxic documents go, one document of each near-duplicate group stays, documents that hold
benchmark passages go, personal data is replaced, and the sources are mixed to their target weights.
Each stage's result is written as Parquet to the shared folder and read again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from winnow.llm import stages
from winnow.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("toxicity", stages.drop_toxic),
    ("near_dedup", stages.drop_near_copies),
    ("decontamination", stages.drop_contaminated),
    ("pii", stages.sanitise),
    ("mixing", stages.mix_sources),
]

# The classifier of the first stage is trained, which SQL cannot express. Tests check the operators
# of the stages one by one; of the whole, only columns, falling row counts and copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
