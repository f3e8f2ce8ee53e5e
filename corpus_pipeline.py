"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and its result is written as
Parquet and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplegraph.llm.line_dedup import line_dedup_stage
from ripplegraph.llm.mixing import mixing_stage
from ripplegraph.llm.ngram_join import ngram_join_stage
from ripplegraph.llm.packing import packing_stage
from ripplegraph.llm.toxicity import toxicity_stage
from ripplegraph.session import checkpoint_dir, ship_package, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _shipped(stage: Stage) -> Stage:
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _shipped(toxicity_stage)),
    ("line_dedup", _shipped(line_dedup_stage)),
    ("ngram_join", _shipped(ngram_join_stage)),
    ("mixing", _shipped(mixing_stage)),
    ("packing", _shipped(packing_stage)),
]

#: Training a classifier and the cube method's draws are beyond SQL; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus; what each stage returns is a table in the session's shared folder."""
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
