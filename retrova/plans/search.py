"""Search over chunks: the planner's steps as one plan of limits, unions and small joins.

Candidate lists are bounded by the request's limits, never by the corpus, so the
joins back to the chunks carry a list of that size. Two facts that decide the plan's
form, whether the vector list is full and whether any candidate was found, are asked
of the data beforehand, with a limit.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import lexical_overlap
from ..operators import chunks as C
from ..operators import fusion, knn, lexical
from ..storage import shared_folder
from .request import BALANCED, SKIP_RESCORE_FROM, TEXT_FIRST, VECTOR_FIRST, SearchRequest


def _vector_list(rows: DataFrame, q: SearchRequest, limit: int) -> DataFrame:
    """(id, vector_score) in the order of the score, then the id."""
    scored = C.with_size(rows, len(q.vector)).select("id", F.round(V.cosine(F.col("embedding"), V.literal(q.vector)), 6).alias("vector_score"))
    return scored.orderBy(F.desc("vector_score"), "id").limit(limit)


def _merged(lists: list[tuple[DataFrame, list]], limit: int) -> DataFrame:
    """Ids of ranked lists, the lists one after another, each id once, the first `limit`."""
    parts = [df.select("id", F.struct(F.lit(i), F.row_number().over(Window.orderBy(*order))).alias("place")) for i, (df, order) in enumerate(lists)]  # lists of bounded length
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.min("place").alias("place")).orderBy("place").limit(limit).select("id")


def _payload(found: DataFrame, chunks: DataFrame, include: bool) -> DataFrame:
    """The late join of what a result shows; results whose chunk is gone drop out."""
    scores = ["vector_score", "text_score", "hybrid_score"]
    if not include:
        return found.select(F.col("id").alias("chunk_id"), F.lit("").alias("doc_id"), F.lit("").alias("content"), F.lit(None).cast("string").alias("metadata"), *scores)
    found = spark_cut(found)  # top_k rows
    # the semi-join goes below a join of the chunks with their vectors, so that no other content is moved
    shown = chunks.select("id", "doc_id", "content", "metadata").join(F.broadcast(found.select("id")), "id", "left_semi")
    return shown.join(F.broadcast(found), "id").select(F.col("id").alias("chunk_id"), "doc_id", "content", "metadata", *scores).orderBy(F.desc("hybrid_score"), F.desc("vector_score"), F.desc("text_score"), "chunk_id")


def _matches(chunks: DataFrame, text: str, allowed: DataFrame | None, index: lexical.TextIndex | None) -> DataFrame:
    return lexical.matches(chunks, text, allowed) if index is None else index.matches(text, allowed)


def search(chunks: DataFrame, request: SearchRequest, index: lexical.TextIndex | None = None) -> DataFrame:
    """(chunk_id, doc_id, content, metadata, vector_score, text_score, hybrid_score), the best first.

    index: the chunks' text index; without it each lexical step reads the chunks.
    """
    q = request.resolved()
    q.validate()
    rows = C.where(chunks, q.filters, q.doc_id)
    every = not q.filters and q.doc_id is None
    by_vector, by_text = [F.desc("vector_score"), F.asc("id")], [F.desc("bm25"), F.asc("id")]
    by_time = [F.desc("created_at"), F.desc("rowid")]
    if q.text is None:
        found = _vector_list(rows, q, q.top_k).withColumn("text_score", F.lit(0.0)).withColumn("hybrid_score", F.col("vector_score"))
        return _payload(found, chunks, q.include_payloads)
    mode = q.mode()
    limit = q.candidate_limit
    vectors = texts = None
    n_vectors = 0
    if q.vector is not None and mode != TEXT_FIRST:
        budget = q.primary_budget(mode)
        vectors = spark_cut(_vector_list(rows, q, budget))
        n_vectors = vectors.count()
    known = None
    if mode == TEXT_FIRST or (mode == VECTOR_FIRST and n_vectors < q.top_k) or (mode in (BALANCED, None) and n_vectors < limit):
        texts = spark_cut(lexical.ranked(_matches(chunks, q.text, None if every else rows, index), q.primary_budget(mode) if mode else limit))
        if mode in (TEXT_FIRST, None):
            known = lexical.normalised(texts)
    if mode == TEXT_FIRST:
        vectors = spark_cut(_vector_list(rows, q, q.secondary_budget(mode)))
    lists = [(df, order) for df, order in ((vectors, by_vector), (texts, by_text)) if df is not None]
    if mode == TEXT_FIRST:
        lists.reverse()
    if mode in (BALANCED, None) or texts is not None and n_vectors == 0 and mode == VECTOR_FIRST:
        recent = rows.select("id", "created_at", "rowid").orderBy(*by_time).limit(limit)
        found_any = mode in (BALANCED, None) or any(df.limit(1).count() for df, _ in lists)
        lists = [*lists, (recent, by_time)] if found_any and mode in (BALANCED, None) else [(recent, by_time)] if not found_any else lists
    ids = _merged(lists, limit)
    if mode is not None:
        ids = _rerank_cut(ids, vectors, known, q, mode)
    ids = spark_cut(ids)  # candidate_limit rows, which several steps read
    # scores of the candidates
    inside = rows.join(F.broadcast(ids), "id", "left_semi")  # candidate_limit ids at most
    full = mode is not None and limit >= SKIP_RESCORE_FROM and n_vectors >= limit
    text_scores = known
    if not full:
        asked = ids if known is None else ids.join(F.broadcast(known), "id", "left_anti")  # candidate_limit rows at most
        asked = F.broadcast(asked) if index is not None else inside.join(F.broadcast(asked), "id", "left_semi")
        more = lexical.normalised(_matches(chunks, q.text, asked, index).withColumn("bm25", F.round("bm25", 6)))
        text_scores = more if known is None else known.unionByName(more)
    size_ok = F.size("embedding") == len(q.vector) if q.vector is not None else F.lit(False)
    vector_score = F.when(size_ok, F.round(V.cosine(F.when(size_ok, F.col("embedding")), V.literal(q.vector)), 6)).otherwise(0.0) if q.vector is not None else F.lit(0.0)
    scored = inside.select("id", vector_score.alias("vector_score"), lexical_overlap(F.lit(q.text), F.col("content")).alias("overlap"))
    if text_scores is not None:
        scored = scored.join(F.broadcast(text_scores.groupBy("id").agg(F.max("text_score").alias("fts"))), "id", "left")  # candidate_limit rows at most
    else:
        scored = scored.withColumn("fts", F.lit(None).cast("double"))
    scored = scored.select("id", F.coalesce("vector_score", F.lit(0.0)).alias("vector_score"), F.when(F.col("fts") > 0, F.col("fts")).otherwise(F.col("overlap")).alias("text_score"))
    if q.vector is None:
        scored = scored.withColumn("hybrid_score", F.col("text_score"))
    elif q.rrf_constant is not None:
        scored = fusion.reciprocal_rank(scored, q.rrf_constant)
    else:
        scored = fusion.weighted(scored, q.alpha)
    return _payload(fusion.final(scored, q.top_k), chunks, q.include_payloads)


def _rerank_cut(ids: DataFrame, vectors: DataFrame | None, known: DataFrame | None, q: SearchRequest, mode: str) -> DataFrame:
    """The best candidates by the scores known so far; an unknown one counts as 0."""
    zero = F.lit(0.0)
    out = ids
    out = out.join(vectors, "id", "left") if vectors is not None else out.withColumn("vector_score", zero)
    out = out.join(known, "id", "left") if known is not None else out.withColumn("text_score", zero)
    out = out.select("id", F.coalesce("vector_score", zero).alias("vector_score"), F.coalesce("text_score", zero).alias("text_score"))
    out = fusion.reciprocal_rank(out, q.rrf_constant) if q.rrf_constant is not None else fusion.weighted(out, q.alpha)
    return fusion.final(out, q.rerank_budget(mode)).select("id")


def search_batch(chunks: DataFrame, queries: DataFrame, request: SearchRequest, index: lexical.TextIndex) -> DataFrame:
    """`search` for many queries at once: (query_id, chunk_id, vector_score, text_score, hybrid_score, rank).

    queries: (query_id, text, embedding), each with the kinds that `request` has (its text
    and vector only tell which these are, and the dimension); all else is the request's.
    Lists are cut a query within each task before they meet. Candidates, of which a query
    has candidate_limit at most, are scored by joins on their ids. Null texts or vectors
    of a query find nothing by that kind.
    """
    q = request.resolved()
    q.validate()
    mode, limit = q.mode(), q.candidate_limit
    rows = C.where(chunks, q.filters, q.doc_id)
    queries = queries.withColumn("query_id", F.col("query_id").cast("string"))
    names = queries.select("query_id")
    vectors = texts = known = None
    if q.vector is not None:
        budget = q.top_k if q.text is None else q.secondary_budget(mode) if mode == TEXT_FIRST else q.primary_budget(mode)
        found = knn.batch_top_k(rows, queries.select("query_id", "embedding"), budget, len(q.vector), itself=True)
        vectors = found.select("query_id", "id", F.col("score").alias("vector_score"), F.col("rank").alias("place"))
    if q.text is None:
        out = vectors.withColumns({"text_score": F.lit(0.0), "hybrid_score": F.col("vector_score")})
        return _batch_final(out, q.top_k)
    asked = queries.select("query_id", "text")
    if vectors is not None and mode != TEXT_FIRST:
        # texts are asked only for queries whose vector lists are short of this
        enough = q.top_k if mode == VECTOR_FIRST else limit
        counts = names.join(vectors.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).alias("n"))
        counts = spark_cut(counts)
        asked = asked.join(counts.where(F.col("n") < enough), "query_id", "left_semi")
    else:
        counts = None
    texts = index.best(rows, asked, q.primary_budget(mode) if mode else limit)
    if mode in (TEXT_FIRST, None):
        texts = spark_cut(texts)
        best = Window.partitionBy("query_id")
        known = texts.select("query_id", "id", (1 / (1 + F.max("bm25").over(best) - F.col("bm25"))).alias("text_score"))
    lists = [x for x in ((texts, vectors) if mode == TEXT_FIRST else (vectors, texts)) if x is not None]
    listed = [x.select("query_id", "id", F.struct(F.lit(i), F.col("place").cast("int").alias("p")).alias("place")) for i, x in enumerate(lists)]
    merged = listed[0] if len(listed) == 1 else listed[0].unionByName(listed[1])
    if mode in (BALANCED, None, VECTOR_FIRST):
        recent = rows.select("id", "created_at", "rowid").orderBy(F.desc("created_at"), F.desc("rowid")).limit(limit)
        recent = recent.select("id", F.struct(F.lit(9), F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("rowid"))).alias("p")).alias("place"))  # candidate_limit rows
        lonely = names if mode in (BALANCED, None) else names.join(merged, "query_id", "left_anti")
        merged = merged.unionByName(lonely.crossJoin(F.broadcast(recent)))  # candidate_limit rows a query at most
    merged = merged.groupBy("query_id", "id").agg(F.min("place").alias("place"))
    ids = merged.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).where(F.col("nth") <= limit).select("query_id", "id")
    if mode is not None:
        zero = F.lit(0.0)
        score = lambda df, c: (lambda x: x.join(df.select("query_id", "id", c), ["query_id", "id"], "left") if df is not None else x.withColumn(c, zero))
        rough = score(known, "text_score")(score(vectors, "vector_score")(ids)).fillna(0.0, ["vector_score", "text_score"])
        rough = fusion.reciprocal_rank(rough, q.rrf_constant, "query_id") if q.rrf_constant is not None else fusion.weighted(rough, q.alpha)
        ids = _batch_final(rough, q.rerank_budget(mode)).select("query_id", F.col("chunk_id").alias("id"))
    ids = spark_cut(ids)
    unknown = ids if known is None else ids.join(known, ["query_id", "id"], "left_anti")
    if mode is not None and limit >= SKIP_RESCORE_FROM and counts is not None:
        unknown = unknown.join(counts.where(F.col("n") < limit), "query_id", "left_semi")
    more = index.scores(queries.select("query_id", "text"), unknown)
    more = more.select("query_id", "id", (1 / (1 + F.max("bm25").over(Window.partitionBy("query_id")) - F.col("bm25"))).alias("text_score"))
    fts = (more if known is None else known.unionByName(more)).withColumnRenamed("text_score", "fts")
    payload = rows.select("id", "content", *(["embedding"] if q.vector is not None else [])).join(lexical.small(ids.select("id").distinct()), "id", "left_semi")
    scored = ids.join(fts, ["query_id", "id"], "left").join(payload, "id").join(lexical.small(queries.select("query_id", "text", *([F.col("embedding").alias("_q")] if q.vector is not None else []))), "query_id")
    fits = (F.size("embedding") == len(q.vector)) & (F.size("_q") == len(q.vector)) if q.vector is not None else None
    vector_score = F.coalesce(F.when(fits, F.round(V.cosine(F.when(fits, F.col("embedding")), F.when(fits, F.col("_q"))), 6)), F.lit(0.0)) if q.vector is not None else F.lit(0.0)
    text_score = F.when(F.col("fts") > 0, F.col("fts")).otherwise(lexical_overlap(F.col("text"), F.col("content")))
    scored = scored.select("query_id", "id", vector_score.alias("vector_score"), text_score.alias("text_score"))
    if q.vector is None:
        scored = scored.withColumn("hybrid_score", F.col("text_score"))
    elif q.rrf_constant is not None:
        scored = fusion.reciprocal_rank(scored, q.rrf_constant, "query_id")
    else:
        scored = fusion.weighted(scored, q.alpha)
    return _batch_final(scored, q.top_k)


def spark_cut(rows: DataFrame) -> DataFrame:
    """Reads rows that several steps need once: a table in the shared folder."""
    path = f"{shared_folder(rows.sparkSession)}/search-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def _batch_final(scored: DataFrame, k: int) -> DataFrame:
    scored = scored.select("query_id", F.col("id").alias("chunk_id"), *[F.round(c, 6).alias(c) for c in ("vector_score", "text_score", "hybrid_score")])
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("hybrid_score"), F.desc("vector_score"), F.desc("text_score"), "chunk_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def rerank_hook(chunks: DataFrame, request: SearchRequest, candidates: int = 25) -> DataFrame:
    """The best candidates for a reranker outside."""
    from dataclasses import replace

    return search(chunks, replace(request, top_k=candidates, candidate_limit=max(candidates, request.candidate_limit)))
