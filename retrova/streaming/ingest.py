"""Streaming ingestion: a folder of JSON documents to chunks, upserted batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.chunking import chunked, with_metadata


def read(spark: SparkSession, folder: str, files_a_batch: int = 64) -> DataFrame:
    return spark.readStream.schema("id string, text string").option("maxFilesPerTrigger", files_a_batch).json(folder)


def ingest(docs: DataFrame, out: str, checkpoint: str, tenant: str = "default", strategy: str = "heading", size: int = 1200, overlap: int = 120, dim: int = 64) -> StreamingQuery:
    """Chunks to Parquet folders of their batch. A batch that runs again, after a loss, overwrites what it wrote; ids follow from the content."""

    def write(batch: DataFrame, number: int) -> None:
        parts = with_metadata(chunked(batch, strategy, size, overlap, tenant, dim), tenant)
        parts.dropDuplicates(["id"]).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chunks(spark: SparkSession, out: str) -> DataFrame:
    """The newest row of each id over all batches."""
    rows = spark.read.parquet(out)
    names = [c for c in rows.columns if c not in ("id", "batch")]
    return rows.groupBy("id").agg(F.max_by(F.struct(*names), "batch").alias("r")).select("id", "r.*")
