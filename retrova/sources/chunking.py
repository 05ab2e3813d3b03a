"""Chunking of documents: fixed sizes, heading-aware, sentence-wise; content ids and metadata."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import fnv1a64_all
from ..functions.text import fnv1a64_bytes as fnv1a64

STRATEGIES = ("fixed", "heading", "semantic")


def _floor(data: bytes, at: int, low: int) -> int:
    """The last character boundary at or before `at`, but not before `low`."""
    while at > low and at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def fixed(data: bytes, size: int, overlap: int) -> list[tuple[int, int]]:
    """Byte bounds of windows of `size` bytes that overlap, cut between characters."""
    size = max(size, 1)
    overlap = min(overlap, size - 1)
    out, begin = [], 0
    while begin < len(data):
        end = _floor(data, min(begin + size, len(data)), begin)
        if end <= begin:
            end = len(data)
        out.append((begin, end))
        if end == len(data):
            break
        back = _floor(data, max(end - overlap, 0), begin)
        begin = back if back > begin else end
    return out


def by_heading(data: bytes, size: int, overlap: int) -> list[tuple[int, int, str | None]]:
    """Sections from one line that starts with # to the next, each cut as `fixed`, with its heading."""
    sections, begin, heading, at = [], 0, None, 0
    for line in data.splitlines(keepends=True) if b"\r" not in data else re.findall(rb"[^\n]*\n|[^\n]+", data):
        text = line.decode().strip()
        if text.startswith("#"):
            if at > begin:
                sections.append((begin, at, heading))
            begin, heading = at, text.lstrip("#").strip()
        at += len(line)
    if begin < len(data):
        sections.append((begin, len(data), heading))
    return [(b + x, b + y, h) for b, e, h in sections for x, y in fixed(data[b:e], size, overlap)]


def by_sentence(data: bytes, size: int) -> list[tuple[int, int]]:
    """Sentences (up to . ! or ?) packed while they fit; one that is longer stays whole."""
    ends = [m.end() for m in re.finditer(rb"[.!?]", data)]
    if data and (not ends or ends[-1] < len(data)):
        ends.append(len(data))
    out, begin, last = [], 0, 0
    for end in ends:
        if end - begin > max(size, 1) and last > begin:
            out.append((begin, last))
            begin = last
        last = end
    if last > begin:
        out.append((begin, last))
    return out


def segments(text: str, strategy: str, size: int = 1200, overlap: int = 120) -> list[tuple[str, int, int, str | None]]:
    """(content, start, end, heading); the bounds count bytes of UTF-8. Sentence-wise content is trimmed and empty content left out."""
    data = text.encode()
    if strategy == "fixed":
        return [(data[a:b].decode(), a, b, None) for a, b in fixed(data, size, overlap)]
    if strategy == "heading":
        return [(data[a:b].decode(), a, b, h) for a, b, h in by_heading(data, size, overlap)]
    if strategy == "semantic":
        return [(t, a, b, None) for a, b in by_sentence(data, size) if (t := data[a:b].decode().strip())]
    raise ValueError(f"unknown chunking strategy {strategy!r}")


def chunk_ids(tenant: str, docs: list[str], parts: list[tuple[str, int, int]]) -> list[str]:
    """Ids that follow from tenant, document, place and content: the same input has the same id again."""
    safe = re.sub(r"[^A-Za-z0-9_]", "_", tenant)
    keys = [b"\0".join([tenant.encode(), d.encode(), str(a).encode(), str(b).encode(), c.encode()]) for d, (c, a, b) in zip(docs, parts, strict=True)]
    return [f"{safe}-{h:016x}" for h in fnv1a64_all(keys).tolist()]


def embed_many(texts: list[str], dim: int) -> np.ndarray:
    """Counts of hashed tokens (runs of ASCII letters and digits, case kept), of unit length; no token gives the first axis."""
    out = np.zeros((len(texts), dim), np.float32)
    memo: dict[str, int] = {}
    for i, t in enumerate(texts):
        for w in re.findall(r"[A-Za-z0-9]+", t):
            if w not in memo:
                memo[w] = fnv1a64(w.encode()) % dim
            out[i, memo[w]] += 1
    n = np.linalg.norm(out, axis=1)
    out[n == 0, 0] = 1
    return out / np.where(n == 0, 1, n)[:, None]


def chunked(docs: DataFrame, strategy: str = "heading", size: int = 1200, overlap: int = 120, tenant: str = "default", dim: int | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(doc_id, id, nth, content, start, end, heading, content_hash, embedding) of each chunk of each document; empty texts have none.

    dim: the size of the hash embedding; None leaves the vector null.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown chunking strategy {strategy!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                doc, nth, parts, heading = [], [], [], []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for k, (c, a, e, h) in enumerate(segments(t or "", strategy, size, overlap)):
                        doc.append(d)
                        nth.append(k)
                        parts.append((c, a, e))
                        heading.append(h)
                text = [p[0] for p in parts]
                vectors = pa.nulls(len(doc), pa.list_(pa.float32())) if dim is None else pa.array(list(embed_many(text, dim)), pa.list_(pa.float32()))
                yield pa.record_batch({
                    "doc_id": pa.array(doc, pa.string()), "id": pa.array(chunk_ids(tenant, doc, parts), pa.string()), "nth": pa.array(nth, pa.int32()), "content": pa.array(text, pa.string()),
                    "start": pa.array([p[1] for p in parts], pa.int64()), "end": pa.array([p[2] for p in parts], pa.int64()), "heading": pa.array(heading, pa.string()),
                    "content_hash": pa.array([f"{h:016x}" for h in fnv1a64_all([t.encode() for t in text]).tolist()], pa.string()), "embedding": vectors,
                })

    rows = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    return rows.mapInArrow(run, "doc_id string, id string, nth int, content string, start long, end long, heading string, content_hash string, embedding array<float>")


def with_metadata(parts: DataFrame, tenant: str, provider: str = "deterministic", version: str = "det-v1") -> DataFrame:
    """`chunked` rows with the metadata that ingestion stamps on them."""
    fields = F.struct(F.lit(tenant).alias("tenant"), "content_hash", F.col("start").alias("source_start"), F.col("end").alias("source_end"), F.lit(provider).alias("embedding_provider"), F.lit(version).alias("embedding_model_version"), "heading")
    return parts.withColumn("metadata", F.to_json(fields))


def next_batch_size(size: int, seconds: float, target: float, failed: bool, most: int) -> int:
    """Half after a failure or a slow batch, half as much again after one under 60 % of the target."""
    if failed or seconds > target:
        return max(1, size // 2)
    return min(most, size + size // 2 + 1) if seconds <= 0.6 * target else size


def reindexed(chunks: DataFrame, version: str, dim: int, provider: str = "deterministic", now_ms: int = 0) -> DataFrame:
    """Chunks embedded anew, but for those of this model version already; the metadata says so."""

    @F.pandas_udf("array<float>")
    def embed(s: pd.Series) -> pd.Series:
        return pd.Series(list(embed_many(s.fillna("").tolist(), dim)))

    stale = ~F.coalesce(F.get_json_object("metadata", "$.embedding_model_version") == version, F.lit(False))

    @F.pandas_udf("string")
    def stamp(s: pd.Series) -> pd.Series:
        return s.map(lambda m: json.dumps({**json.loads(m or "{}"), "embedding_provider": provider, "embedding_model_version": version, "reindexed_at_unix_ms": now_ms}, separators=(",", ":")))

    old, new = chunks.where(~stale), chunks.where(stale)
    return old.unionByName(new.withColumns({"embedding": embed("content"), "metadata": stamp("metadata")}))
