"""The chunk relation: schema, scans, upserts, deletes, maintenance.

chunks(rowid LONG, id STRING, doc_id STRING, content STRING, metadata STRING (JSON),
embedding ARRAY<FLOAT>, created_at LONG). A chunk without a vector has a null one.
`created_at` is a logical time.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import shared_folder

COLUMNS = ("rowid", "id", "doc_id", "content", "metadata", "embedding", "created_at")
SCHEMA = "rowid long, id string, doc_id string, content string, metadata string, embedding array<float>, created_at long"


def from_tables(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """documents and their embeddings (doc_id = vec_id) as chunks; doc_id is the source.

    The metadata's keys stand beside it as columns meta_<key>, by which filters reach the
    scan. vectors: False leaves the embeddings unread, and null.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # named before the join, so that a semi-join on the id goes below it
    docs = docs.select(F.col("doc_id").alias("rowid"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("doc_id"), F.col("text").alias("content"), F.to_json(F.struct("lang", "source")).alias("metadata"), F.col("n_chars").alias("created_at"), F.col("lang").alias("meta_lang"), F.col("source").alias("meta_source"))
    if vectors:
        own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
        docs = docs.join(own, docs["rowid"] == own["vec_id"], "left")
    else:
        docs = docs.withColumn("embedding", F.lit(None).cast("array<float>"))
    return docs.select(*COLUMNS, "meta_lang", "meta_source")


def metadata_value(key: str, column: str = "metadata") -> Column:
    """A top-level metadata value as a string, numbers and booleans too. Keys are letters, digits and underscores."""
    if not re.fullmatch(r"[A-Za-z0-9_]+", key):
        raise ValueError(f"invalid metadata key {key!r}")
    return F.get_json_object(column, f"$.{key}")


def where(chunks: DataFrame, filters: dict[str, str] | None = None, doc_id: str | None = None) -> DataFrame:
    """Metadata equalities, compared as strings, and a document's id, all of which must hold. A key that has a column meta_<key> is looked up there, else in the JSON."""
    for key, value in sorted((filters or {}).items()):
        own = metadata_value(key)
        chunks = chunks.where((F.col(f"meta_{key}") if f"meta_{key}" in chunks.columns else own) == str(value))
    return chunks if doc_id is None else chunks.where(F.col("doc_id") == doc_id)


def with_size(chunks: DataFrame, dim: int) -> DataFrame:
    return chunks.where(F.size("embedding") == dim) if dim > 0 else chunks.where(F.lit(False))


def page(chunks: DataFrame, documents: DataFrame, offset: int, limit: int, tenant: str | None = None) -> DataFrame:
    """Chunks in the order of rowid with their document's source."""
    rows = chunks if tenant is None else where(chunks, {"tenant": tenant})
    docs = documents.select(F.col("id").alias("_doc"), F.col("source").alias("doc_source"))
    cut = rows.orderBy("rowid").offset(offset).limit(limit)  # only the page's rows look up their documents
    return cut.join(docs, cut["doc_id"] == docs["_doc"], "left").drop("_doc").orderBy("rowid")


def recent(chunks: DataFrame, limit: int) -> DataFrame:
    return chunks.orderBy(F.desc("created_at"), F.desc("rowid")).limit(limit)


def lookup(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """The chunks of `ids` (id, place), in the order of place."""
    return chunks.join(ids, "id").orderBy("place")


def numbered(rows: DataFrame, by: str) -> DataFrame:
    """The rows with `nth`, 1 and up in the order of `by`: sorted by ranges, each range numbered by itself after the counts of those before it."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/numbered-{uuid.uuid4().hex}"
    # written, as the ranges are sampled anew each time they are worked out
    rows.repartitionByRange(by).sortWithinPartitions(by).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_place")).write.parquet(path)
    own = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = own.groupBy("_range").agg(F.count(F.lit(1)).alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))  # a row a range
    place = F.col("_place") - F.shiftleft(F.col("_range").cast("long"), 33)
    return own.join(F.broadcast(counts), "_range").withColumn("nth", F.col("_before") + place + 1).drop("_range", "_place", "_before")


def upsert(chunks: DataFrame, changes: DataFrame) -> DataFrame:
    """Changes (seq, id, doc_id, content, metadata, embedding) into chunks: the last of an id wins; rowid and created_at of known ids stay.

    New ids get rowids after the largest one, in the order of their first change.
    """
    last = changes.groupBy("id").agg(F.max_by(F.struct("doc_id", "content", "metadata", "embedding"), "seq").alias("c"), F.min("seq").alias("first"), F.max("seq").alias("last"))
    joined = chunks.join(last, "id", "full")
    top = chunks.agg(F.coalesce(F.max("rowid"), F.lit(0)).alias("top"), F.coalesce(F.max("created_at"), F.lit(0)).alias("now"))
    new = last.join(chunks.select("id"), "id", "left_anti").select("id", "first")
    new = numbered(new, "first").select("id", "nth")
    joined = joined.join(new, "id", "left").crossJoin(F.broadcast(top))  # one row
    pick = lambda c: F.when(F.col("c").isNotNull(), F.col(f"c.{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(F.coalesce("rowid", F.col("top") + F.col("nth")).alias("rowid"), "id", pick("doc_id"), pick("content"), pick("metadata"), pick("embedding"), F.coalesce("created_at", F.col("now") + F.col("nth")).alias("created_at"))


def set_embedding(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """vectors (id, vector) in place of the chunks' own; an empty one is an error."""
    v = vectors.select("id", F.when(F.size("vector") > 0, F.col("vector")).otherwise(F.raise_error(F.lit("empty embedding")).cast("array<float>")).alias("_v"))
    return chunks.join(v, "id", "left").withColumn("embedding", F.coalesce("_v", "embedding")).select(*chunks.columns)


def set_metadata(chunks: DataFrame, metadata: DataFrame) -> DataFrame:
    """metadata (id, json) replaces the chunks' own as a whole."""
    return chunks.join(metadata.select("id", F.col("json").alias("_m")), "id", "left").withColumn("metadata", F.coalesce("_m", "metadata")).select(*chunks.columns)


def delete_by_metadata(chunks: DataFrame, key: str, value: str) -> DataFrame:
    return chunks.where(~F.coalesce(metadata_value(key) == value, F.lit(False)))


def delete_by_document(chunks: DataFrame, documents: DataFrame, doc_id: str) -> tuple[DataFrame, DataFrame]:
    left = chunks.where(F.col("doc_id") != doc_id)
    return left, documents.where(F.col("id") != doc_id)


def orphans(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents without chunks."""
    return documents.join(chunks.select(F.col("doc_id").alias("id")), "id", "left_anti")


def deduplicated(chunks: DataFrame) -> DataFrame:
    """Of the chunks with one document, tenant (none is '') and content_hash the one of the greatest rowid; those without a hash stay.

    The aggregate moves a (hash, rowid) pair a chunk, not the chunks.
    """
    keyed = chunks.withColumns({"_hash": metadata_value("content_hash"), "_tenant": F.coalesce(metadata_value("tenant"), F.lit(""))})
    best = keyed.where("_hash is not null").groupBy("doc_id", "_tenant", "_hash").agg(F.max("rowid").alias("rowid")).select("rowid")
    return keyed.where("_hash is null").select(*chunks.columns).unionByName(chunks.join(best, "rowid", "left_semi").select(*chunks.columns))


def compact(chunks: DataFrame, documents: DataFrame, dedupe: bool = True, prune: bool = True) -> tuple[DataFrame, DataFrame]:
    if not (dedupe or prune):
        raise ValueError("compaction needs an action")
    kept = deduplicated(chunks) if dedupe else chunks
    docs = documents.join(kept.select(F.col("doc_id").alias("id")), "id", "left_semi") if prune else documents
    return kept, docs


def diagnostics(chunks: DataFrame) -> DataFrame:
    """One row: counts, dimensions, and the bytes that vectors of each storage kind take."""
    n = F.sum(F.coalesce(F.size("embedding"), F.lit(0)).cast("long"))
    has = F.count_if(F.size("embedding") > 0)
    return chunks.agg(F.count(F.lit(1)).alias("chunk_count"), F.countDistinct("doc_id").alias("document_count"), has.alias("vector_count"), F.max(F.size("embedding")).alias("max_dim"), (n * 4).alias("bytes_f32"), (n * 2).alias("bytes_f16"), (n + has * 4).alias("bytes_int8"))
