"""Fusion of vector and text scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def weighted(scored: DataFrame, alpha: float) -> DataFrame:
    return scored.withColumn("hybrid_score", F.lit(alpha) * F.col("vector_score") + F.lit(1 - alpha) * F.col("text_score"))


def reciprocal_rank(scored: DataFrame, constant: float = 60.0, by: str | None = None) -> DataFrame:
    """1 / (c + rank) summed over both lists; every row has a rank in each, whatever its score. by: the query, where there are many."""
    if constant <= 0:
        raise ValueError("the rank constant must be positive")
    window = Window.partitionBy(by) if by else Window.partitionBy()
    rank = lambda c: F.row_number().over(window.orderBy(F.desc(c), "id"))
    return scored.withColumn("hybrid_score", 1 / (constant + rank("vector_score")) + 1 / (constant + rank("text_score")))


def final(scored: DataFrame, k: int) -> DataFrame:
    for c in ("vector_score", "text_score", "hybrid_score"):
        scored = scored.withColumn(c, F.round(c, 6))
    return scored.orderBy(F.desc("hybrid_score"), F.desc("vector_score"), F.desc("text_score"), "id").limit(k)
