"""Importers of chunk records from other stores' exports."""

from __future__ import annotations

import json
import re
import sqlite3

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dotted paths of a record's parts, by source; None where there is none.
PATHS = {
    "pgvector": {"id": "id", "doc_id": "doc_id", "content": "content", "metadata": "metadata", "embedding": "embedding", "source": "source", "doc_metadata": "doc_metadata", "doc_source": "doc_source"},
    "qdrant": {"id": "id", "doc_id": "payload.doc_id", "content": "payload.content", "metadata": "payload", "embedding": "vector", "source": "payload.source", "doc_metadata": None, "doc_source": None},
    "weaviate": {"id": "id", "doc_id": "properties.doc_id", "content": "properties.content", "metadata": "properties", "embedding": "vector", "source": "properties.source", "doc_metadata": None, "doc_source": None},
    "milvus": {"id": "id", "doc_id": "doc_id", "content": "content", "metadata": "metadata", "embedding": "embedding", "source": "source", "doc_metadata": None, "doc_source": None},
}


def parse_embedding(raw: Column) -> Column:
    """An array, an object whose first array counts, or a string of either or of numbers with commas."""
    numbers = F.from_json(raw, "array<float>")
    first = F.filter(F.map_values(F.from_json(raw, "map<string,string>")), lambda v: v.startswith("["))
    listed = F.transform(F.filter(F.split(raw, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).try_cast("float"))
    t = F.trim(raw)
    return F.when(t.startswith("["), numbers).when(t.startswith("{"), F.from_json(F.try_element_at(first, F.lit(1)), "array<float>")).otherwise(listed)


def records(lines: DataFrame, source: str, paths: dict[str, str | None] | None = None) -> DataFrame:
    """Lines of JSON (value, and `line`, their order) as (line, id, doc_id, content, metadata, embedding, source, doc_metadata, doc_source)."""
    p = {**PATHS[source], **(paths or {})}
    at = lambda k: F.get_json_object("value", f"$.{p[k]}") if p[k] else F.lit(None).cast("string")
    rows = lines.where(F.trim("value") != "").select("line", at("id").alias("id"), at("doc_id").alias("doc_id"), at("content").alias("content"), F.coalesce(at("metadata"), F.lit("{}")).alias("metadata"), parse_embedding(at("embedding")).alias("embedding"), at("source").alias("source"), at("doc_metadata").alias("doc_metadata"), at("doc_source").alias("doc_source"))
    return rows.withColumns({"doc_metadata": F.coalesce("doc_metadata", "metadata") if not p["doc_metadata"] else F.coalesce("doc_metadata", F.lit("{}")), "doc_source": F.coalesce("doc_source", "source")})


def documents(recs: DataFrame) -> DataFrame:
    """(id, source, metadata): a document is as the first of its records says."""
    first = recs.groupBy("doc_id").agg(F.min_by(F.struct("doc_source", "doc_metadata"), "line").alias("d"))
    return first.select(F.col("doc_id").alias("id"), F.col("d.doc_source").alias("source"), F.col("d.doc_metadata").alias("metadata"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """A file's lines and their order: by file, then place."""
    text = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("n"))
    return text.select("value", F.struct("f", "n").alias("line"))


def _name(s: str) -> str:
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", s):
        raise ValueError(f"invalid identifier {s!r}")
    return s


def decode_embedding(raw) -> list[float] | None:
    """A blob of little-endian floats, or text as `parse_embedding` reads it."""
    if raw is None:
        return None
    if isinstance(raw, bytes):
        if len(raw) % 4:
            raise ValueError("a vector's bytes must be a multiple of 4")
        return np.frombuffer(raw, "<f4").tolist()
    s = raw.strip()
    if s.startswith("{"):
        return next((v for v in json.loads(s).values() if isinstance(v, list)), None)
    return json.loads(s) if s.startswith("[") else [float(x) for x in s.split(",") if x.strip()]


def read_sqlite(spark: SparkSession, path: str, table: str, columns: dict[str, str], batch: int = 10_000) -> DataFrame:
    """A table of an SQLite file that every executor sees; each task reads its range of rowids.

    columns: names of id, doc_id, content, metadata, embedding and source in that table.
    """
    cols = {k: _name(v) for k, v in columns.items()}
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {_name(table)}").fetchone()
    names = ("id", "doc_id", "content", "metadata", "embedding", "source")

    def read(batches):
        import pandas as pd

        for b in batches:
            with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
                for at in b["id"]:
                    picked = ", ".join(cols.get(n, "NULL") for n in names)
                    rows = db.execute(f"SELECT rowid, {picked} FROM {table} WHERE rowid BETWEEN ? AND ? ORDER BY rowid", (int(at), int(at) + batch - 1)).fetchall()
                    yield pd.DataFrame([(r[0], *(None if x is None else str(x) for x in r[1:4]), r[4] or "{}", decode_embedding(r[5]), r[6]) for r in rows], columns=["rowid", *names])

    ranges = spark.range(low, high + 1, batch, max(1, min(256, (high - low) // batch + 1)))
    return ranges.mapInPandas(read, "rowid long, id string, doc_id string, content string, metadata string, embedding array<float>, source string")
