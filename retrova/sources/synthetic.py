"""A synthetic corpus, its queries, and a benchmark of searching it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluate, knn, lexical
from ..operators import chunks as C
from ..plans.request import SearchRequest
from ..plans.search import search_batch
from ..storage import shared_folder

#: Four words to each of the topics.
TOPICS = ["engine memory agent local", "ledger invoice payment audit", "harbour vessel cargo tide", "orchard harvest seed soil", "circuit voltage sensor relay", "museum canvas sculpture archive", "glacier summit ridge snow", "clinic patient dosage nurse"]
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def uniform(seed: np.ndarray) -> np.ndarray:
    """Numbers from 0 to 1 that follow from 64-bit seeds (splitmix64)."""
    x = seed + _A
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    x ^= x >> np.uint64(31)
    return (x.astype(np.float64) / float(2**64 - 1)).astype(np.float32)


def vectors(index: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors near the axis of the row's topic."""
    i = index.astype(np.uint64)[:, None]
    v = (uniform(((i + np.uint64(1)) << np.uint64(32)) ^ np.arange(1, dim + 1, dtype=np.uint64)) - np.float32(0.5)) * np.float32(0.08)
    v[np.arange(len(v)), (index % len(TOPICS)) % dim] += 1
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def corpus(spark: SparkSession, size: int, dim: int = 64, tenants: int = 1) -> DataFrame:
    """Chunks chunk-%08d, five to a document, of topics and tenants in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"rowid": batch.column(0), "embedding": pa.array(list(vectors(batch.column(0).to_numpy(), dim)), pa.list_(pa.float32()))})

    rows = spark.range(size).mapInArrow(run, "rowid long, embedding array<float>")
    topic = F.pmod("rowid", F.lit(len(TOPICS)))
    tenant = F.lit("bench") if tenants <= 1 else F.format_string("bench-%02d", F.pmod("rowid", F.lit(tenants)))
    content = F.concat(F.element_at(F.array(*map(F.lit, TOPICS)), (topic + 1).cast("int")), F.lit(" synthetic chunk "), F.col("rowid").cast("string"))
    return rows.select("rowid", F.format_string("chunk-%08d", "rowid").alias("id"), F.format_string("doc-%06d", F.floor(F.col("rowid") / 5)).alias("doc_id"), content.alias("content"), F.to_json(F.struct(tenant.alias("tenant"), F.concat(F.lit("topic_"), topic.cast("string")).alias("topic"))).alias("metadata"), "embedding", F.col("rowid").alias("created_at"))


def queries(spark: SparkSession, count: int, size: int, dim: int = 64) -> DataFrame:
    """(query_id, text, embedding, target): three words of a chunk's topic, its vector a little off, and its id."""
    target = np.arange(count, dtype=np.int64) * 9973 % size
    noise = (uniform((np.arange(count, dtype=np.uint64)[:, None] + np.uint64(1337)) ^ np.arange(1, dim + 1, dtype=np.uint64)) - np.float32(0.5)) * np.float32(0.02)
    v = vectors(target, dim) + noise
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(f"q{i:06d}", " ".join(TOPICS[t % len(TOPICS)].split()[:3]), [float(x) for x in v[i]], f"chunk-{t:08d}") for i, t in enumerate(target.tolist())]
    return spark.createDataFrame(rows, "query_id string, text string, embedding array<float>, target string")


def benchmark(spark: SparkSession, size: int = 3000, count: int = 200, dim: int = 64, k: int = 10, alpha: float = 0.65, candidate_limit: int = 300, tenants: int = 1) -> dict:
    """Throughput of a batch of hybrid searches, how often the first result is the target, and the recall of the vectors alone against an exact scan."""
    folder = f"{shared_folder(spark)}/benchmark-{uuid.uuid4().hex}"
    began = time.time()
    corpus(spark, size, dim, tenants).write.parquet(f"{folder}/chunks")
    chunks = spark.read.parquet(f"{folder}/chunks")
    index = lexical.TextIndex.create(chunks, folder)
    ingest_s = time.time() - began
    asked = queries(spark, count, size, dim)
    request = SearchRequest(text="x", vector=[0.0] * dim, top_k=k, alpha=alpha, candidate_limit=min(candidate_limit, size))
    began = time.time()
    search_batch(chunks, asked, request, index).write.parquet(f"{folder}/found")
    seconds = time.time() - began
    first = spark.read.parquet(f"{folder}/found").where("rank = 1").join(asked.select("query_id", "target"), "query_id")
    hit = first.agg(F.avg((F.col("chunk_id") == F.col("target")).cast("double")).alias("x")).first()["x"]
    exact = knn.batch_top_k(chunks, asked, k, dim, itself=True)
    near = knn.SignatureIndex.create(chunks, folder, dim).batch(asked, k)
    recall = evaluate.recall_against(near, exact, k).agg(F.avg("recall").alias("x")).first()["x"]
    return {"corpus_size": size, "queries": count, "ingest_chunks_per_s": size / ingest_s, "queries_per_s": count / seconds, "top1_hit_rate": hit, "vector_recall": recall, "vector_bytes": C.diagnostics(chunks).first()["bytes_f32"]}
