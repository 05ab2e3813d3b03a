"""Corpus pipeline: five stages over the table documents, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from retrova.llm import stages
from retrova.storage import shared_folder

STAGES = [
    ("quality classifier", stages.quality),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("suffix-array dedup", stages.suffixes),
    ("mixing to target weights", stages.mix),
    ("SentencePiece encoding", stages.encode),
]

#: SQL can express neither the classifier nor the encoder; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. Their tables lie in the folder of spark.checkpoint.dir (see `shared_folder` for where that is unset)."""
    root = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
