"""Stages of the corpus pipeline: each takes (spark, docs, sf_dir) and gives the documents that go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobs import cut, release, shrink, small_batches, table
from .merge_dropout import encode_documents
from .mixing import mixed
from .ngram_join import near_groups
from .quality_bayes import keep_good, train_on
from .suffix_dedup import repeated_spans, strip_spans

#: Sources of the mix overlap: a document is in its language's and, if it is long, in one more.
WEIGHTS = {"de": 0.15, "en": 0.55, "es": 0.12, "fr": 0.15, "long": 0.03}
EPOCHS = 1.25


def sources() -> dict[str, Column]:
    return {lang: F.col("lang") == lang for lang in ("de", "en", "es", "fr")} | {"long": F.length("text") >= 20_000}


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects, null texts too.

    Empty and very long texts are judged like others, repeated rows alike; nulls of source
    and lang are values of their own. Columns stay, whatever their names. No rows: none.
    """
    small_batches(spark)
    shrink(spark)
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return keep_good(docs, train_on(docs, table(spark, sf_dir, "labels"), good, max_train=4000))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least doc_id of each group of alike documents.

    Of equal rows (same doc_id and text) one stays. The texts of a doc_id that has several
    are documents of their own, in the order of their hashes, so one that is like a lesser
    document's goes and the others stay. Texts with a null doc_id are documents too, after
    all others. Texts that are null or without words are like no other.
    """
    small_batches(spark)
    shrink(spark)
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").isEmpty():
        gone = near_groups(docs, n=3, threshold=(1, 2)).select("doc_id")
        release(spark)
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text", F.isnull("text")).alias("hash"), "text")
    keys = packed.select("id", "hash").distinct().orderBy(F.asc_nulls_last("id"), "hash")
    numbers = cut(keys.select(F.col("id").alias("id_"), F.col("hash").alias("hash_"), F.monotonically_increasing_id().alias("number")))
    single = packed.dropDuplicates(["id", "hash"])
    rows = cut(single.join(numbers, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_"))).select("row", "text", "number"))
    gone = near_groups(rows, n=3, threshold=(1, 2), id_col="number").select(F.col("doc_id").alias("number"))
    release(spark)
    return rows.join(gone, "number", "left_anti").select("row.*")


def suffixes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that occur earlier out of the texts; texts left without words go.

    Null ids or texts, and texts that were empty before, stay as they are; equal rows are
    one text and cut alike; very long texts are taken whole. No rows: none.
    """
    small_batches(spark)
    shrink(spark)
    spans = cut(repeated_spans(docs, length=50, k=8))
    release(spark)
    return strip_spans(docs, spans)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Languages and long documents to their weights; a document that comes twice is two rows.

    Null and empty texts have no tokens and come as their pattern's other documents do;
    a null lang is in no source and comes once. Equal rows are drawn alike, very long
    texts whole. Columns stay, whatever their names. No rows: none.
    """
    small_batches(spark)
    shrink(spark)
    packed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text", "lang")
    chosen = mixed(packed, sources(), WEIGHTS, epochs=EPOCHS, seed=17)
    return chosen.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of each row that has a doc_id and a text; empty texts have no ids, equal rows equal ones, very long texts all of theirs. No rows: none."""
    small_batches(spark)
    shrink(spark)
    return encode_documents(docs, dropout=0.1, seed=17)
