"""Ingestion into a store: sources, embedding by a provider with retries, partial failures, the report.

Chunk ids follow from the content, so a job that runs again puts the same rows; what
the store has already is left out (`resumed_from_chunk` of the report).
"""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_folder
from ..store import Store
from .chunking import chunked, embed_many, next_batch_size, with_metadata

#: A provider takes texts and gives, for each, a vector or an exception.
Provider = Callable[[list[str]], list]


@dataclass(frozen=True)
class Retry:
    times: int = 3
    wait_ms: int = 50
    most_ms: int = 1000


def load(direct: str | None = None, file: str | None = None, url: str | None = None) -> tuple[str, str]:
    """(label, content) of one source: text itself, a file of the driver, or a URL."""
    if sum(x is not None for x in (direct, file, url)) != 1:
        raise ValueError("a source is a text, a file or a URL")
    if direct is not None:
        return "direct", direct
    if file is not None:
        with open(file, encoding="utf-8") as f:
            return file, f.read()
    with urllib.request.urlopen(url) as answer:
        return url, answer.read().decode("utf-8")


def load_files(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of all files under a path that executors see, each a document."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("text"))


def deterministic(dim: int = 16) -> Provider:
    return lambda texts: embed_many(texts, dim).tolist()


def embed_with_retry(texts: list[str], provider: Provider, retry: Retry, sleep: Callable[[float], None] = time.sleep) -> list:
    """A vector for each text, None for those that fail `retry.times` times after the first. Only failed ones are asked again, after waits that double."""
    out: list = [None] * len(texts)
    pending, wait = list(range(len(texts))), max(1, retry.wait_ms)
    for attempt in range(retry.times + 1):
        answers = provider([texts[i] for i in pending])
        if len(answers) != len(pending):
            raise ValueError("the provider answered with another number of vectors")
        for i, a in zip(pending, answers, strict=True):
            out[i] = None if isinstance(a, BaseException) else a
        pending = [i for i, a in zip(pending, answers, strict=True) if isinstance(a, BaseException)]
        if not pending:
            break
        if attempt < retry.times:
            sleep(wait / 1000)
            wait = min(2 * wait, retry.most_ms)
    return out


def embedded(parts: DataFrame, provider: Provider, retry: Retry = Retry(), size: int = 32, adaptive: bool = True, target_ms: float = 500.0, most: int = 256) -> DataFrame:
    """`chunked` rows with their vectors, null where all tries failed. Each task sizes its requests by how long the last one took."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = min(size, most)
        for frame in frames:
            at, vectors = 0, []
            while at < len(frame):
                began = time.time()
                got = embed_with_retry(frame["content"].iloc[at : at + n].tolist(), provider, retry)
                vectors += got
                at += n
                if adaptive:
                    n = next_batch_size(n, time.time() - began, target_ms / 1000, any(v is None for v in got), most)
            yield frame.assign(embedding=pd.Series(vectors, index=frame.index, dtype=object))

    return parts.mapInPandas(run, parts.schema)


def ingest(store: Store, docs: DataFrame, tenant: str, provider: Provider | None = None, strategy: str = "heading", size: int = 1200, overlap: int = 120, retry: Retry = Retry(), partial: bool = False, batch: int = 32, name: str = "deterministic", version: str = "det-v1") -> dict:
    """Chunks, embeds and puts documents (id, text); the report says what became of their chunks.

    Chunks that can't be embedded are left out. Unless `partial`, that is an error after
    all others have been put, so that a second run has only these to do.
    """
    if not tenant.strip():
        raise ValueError("a tenant id is empty")
    if batch < 1:
        raise ValueError("batch must be 1 or more")
    began = time.time()
    parts = chunked(docs, strategy, size, overlap, tenant)
    known = store.chunks().select("id")
    path = f"{shared_folder(store.spark)}/ingest-{time.time_ns()}"
    embedded(parts.join(known, "id", "left_anti").select(*parts.columns), provider or deterministic(), retry, batch).write.parquet(path)
    new = store.spark.read.parquet(path)
    total = parts.count()
    counts = new.agg(F.count(F.lit(1)).alias("n"), F.count("embedding").alias("ok")).first()
    good = with_metadata(new.where("embedding is not null"), tenant, name, version)
    if counts["ok"]:
        store.ingest(good.select("id", "doc_id", "content", "metadata", "embedding", F.col("doc_id").alias("source")).orderBy("doc_id", "id"))
    seconds = time.time() - began
    failed = counts["n"] - counts["ok"]
    report = {"total_chunks": total, "processed_chunks": counts["ok"], "failed_chunks": failed, "resumed_from_chunk": total - counts["n"], "duration_ms": 1000 * seconds, "throughput_chunks_per_minute": 60 * counts["ok"] / seconds if seconds else 0.0, "provider": name, "model_version": version}
    if failed and not partial:
        raise RuntimeError(f"{failed} chunks could not be embedded")
    return report
