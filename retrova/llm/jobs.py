"""Helpers for multi-step jobs: lineage cuts in the shared folder, session settings."""

from __future__ import annotations

import gc
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the cluster names in spark.checkpoint.dir; see `shared_folder` for where that is unset."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results have been cut off.

    A step's objects go in two collections: the first frees those of Python's side.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


#: Bytes of input a partition of a shuffle that tasks buffer whole.
PART_BYTES = 256 << 20


def partitions(spark: SparkSession, docs: DataFrame | None = None) -> int:
    """Partitions of shuffles that tasks buffer whole: the session's number, or more where the tables that `docs` reads are that large."""
    number = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    if docs is None:
        return number
    leaves = docs._jdf.queryExecution().analyzed().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return max(number, sum(x for x in sizes if x < 1 << 60) // PART_BYTES)  # tables without an estimate say 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def usable(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id and text of the rows that have both, and the columns `more`; other columns, whatever their names, go."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more).where("doc_id is not null and text is not null")


def counted(rows: DataFrame, limit: int = 50_000) -> DataFrame:
    """For a join: broadcast if it has been counted to be no more than `limit` rows, else left to a shuffle. `rows` should be cheap to count, as a cut one is."""
    return F.broadcast(rows) if rows.limit(limit + 1).count() <= limit else rows


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Texts go to Python in Arrow batches of at most so many rows, as a batch is held by the JVM and by Python at once. A lesser setting of the session stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def shrink(spark: SparkSession) -> None:
    """Executors collect their garbage and give back the heap that this leaves free, as Python workers need the memory beside it. A task a slot; that each executor gets one isn't sure, nor needed for right results."""
    slots = spark.sparkContext.defaultParallelism
    spark.range(0, slots, 1, slots).select(F.reflect(F.lit("java.lang.System"), F.lit("gc"))).write.format("noop").mode("overwrite").save()
