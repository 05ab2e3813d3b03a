"""The catalogue: each query over its whole tables, and the DuckDB SQL of the same rows where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import vectors as V
from .operators import chunks as C
from .operators import evaluate, fusion, knn, lexical, reports
from .plans import evaluation, rewrite
from .plans.ddl import Catalog
from .plans.request import SearchRequest
from .plans.search import search, search_batch
from .sources import chunking, importers
from .storage import exists, shared_folder, version
from .store import Tools, temporary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

DIM = 64
VECTOR = [round(0.3 * math.sin(i + 1), 3) for i in range(DIM)]
TEXT = "that rest then les der entre on the"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "benchmark", "conversations", "pages")

# pieces of oracle SQL
CH = "chunks AS (SELECT d.doc_id AS rowid, CAST(d.doc_id AS VARCHAR) AS id, d.source AS doc_id, d.text AS content, d.lang, d.source, e.embedding::DOUBLE[] AS embedding, d.n_chars AS created_at FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id)"
QV = f"{VECTOR}::FLOAT[]::DOUBLE[]"
TOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
TERMS = "[" + ", ".join(f"'{t}'" for t in lexical.query_terms(TEXT)) + "]"
COS = f"round(list_cosine_similarity(embedding, {QV}), 6)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks for queries by text alone: their vectors stay unread."""
    return C.from_tables(spark, sf_dir, vectors=False)


def text_index(spark: SparkSession, sf_dir: str) -> lexical.TextIndex:
    """The stored text index of the documents as they are now, made where there is none."""
    path = f"{shared_folder(spark)}/text-index-{version(spark, f'{sf_dir}/documents.parquet')}"
    return lexical.TextIndex.kept(texts(spark, sf_dir), path)


def view(spark: SparkSession, sf_dir: str) -> None:
    C.from_tables(spark, sf_dir).createOrReplaceTempView("chunks")


# vectors


def _top(metric: str, sql: str, order: str):
    return f"WITH {CH}, s AS (SELECT id, round({sql}, 6) AS score FROM chunks WHERE embedding IS NOT NULL) SELECT id, score FROM s ORDER BY score {order}, id LIMIT 10"


@query(_top("cosine", f"list_cosine_similarity(embedding, {QV})", "DESC"))
def vec_topk_cosine(spark, sf_dir):
    return knn.top_k(C.from_tables(spark, sf_dir), VECTOR, 10)


@query(_top("l2", f"list_distance(embedding, {QV})", "ASC"))
def vec_topk_l2(spark, sf_dir):
    return knn.top_k(C.from_tables(spark, sf_dir), VECTOR, 10, "l2")


@query(_top("neg_ip", f"-list_inner_product(embedding, {QV})", "ASC"))
def vec_topk_neg_ip(spark, sf_dir):
    return knn.top_k(C.from_tables(spark, sf_dir), VECTOR, 10, "neg_ip")


@query(f"WITH {CH} SELECT id, {COS} AS score FROM chunks WHERE embedding IS NOT NULL AND lang = 'en' ORDER BY score DESC, id LIMIT 10")
def vec_topk_filtered_lang(spark, sf_dir):
    return knn.top_k(C.where(C.from_tables(spark, sf_dir), {"lang": "en"}), VECTOR, 10)


@query(f"WITH {CH} SELECT id, {COS} AS score FROM chunks WHERE embedding IS NOT NULL AND doc_id = 'src3' ORDER BY score DESC, id LIMIT 10")
def vec_topk_doc_scoped(spark, sf_dir):
    return knn.top_k(C.where(C.from_tables(spark, sf_dir), doc_id="src3"), VECTOR, 10)


def _every_vector(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")


@query("""
WITH e AS (SELECT CAST(vec_id AS VARCHAR) AS id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.id AS query_id, c.id, round(list_cosine_similarity(q.v, c.v), 6) AS score FROM e q JOIN e c ON q.id <> c.id)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM p QUALIFY rank <= 5""")
def vec_batch_topk(spark, sf_dir):
    e = _every_vector(spark, sf_dir)
    return knn.batch_top_k(e, e.withColumnRenamed("id", "query_id"), 5, DIM).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {CH}, t AS (SELECT id, {COS} AS score FROM chunks WHERE embedding IS NOT NULL ORDER BY score DESC, id LIMIT 20) SELECT id AS chunk_id, '' AS doc_id, '' AS content, NULL::VARCHAR AS metadata, score AS vector_score, 0.0::DOUBLE AS text_score, score AS hybrid_score FROM t")
def vec_missing_payload(spark, sf_dir):
    return search(C.from_tables(spark, sf_dir), SearchRequest(vector=VECTOR, top_k=20, include_payloads=False))


@query("SELECT vec_id, len(embedding)::INT AS dims FROM embeddings")
def vec_dims(spark, sf_dir):
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    return rewrite.execute(spark, "SELECT vec_id, vec_dims(embedding) AS dims FROM embeddings")


@query("SELECT vec_id, embedding::DOUBLE[] AS back, len(embedding) AS numbers FROM embeddings")
def vec_json_roundtrip(spark, sf_dir):
    table(spark, sf_dir, "embeddings").createOrReplaceTempView("embeddings")
    return rewrite.execute(spark, "SELECT vec_id, CAST(vector(vec_to_json(embedding)) AS ARRAY<DOUBLE>) AS back, CAST(size(split(vec_to_json(embedding), ',')) AS BIGINT) AS numbers FROM embeddings")


@query("SELECT event_id, [value::FLOAT::DOUBLE, (value * 2)::FLOAT::DOUBLE] AS v FROM events")
def vec_parse_literal(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = V.vector(F.concat(F.lit(" ["), F.col("value").cast("string"), F.lit(" , ,"), (F.col("value") * 2).cast("string"), F.lit("] ")))
    return e.select("event_id", F.transform(v, lambda x: x.cast("double")).alias("v"))


@query("""
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, greatest(list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))), 1e-6) / 127 AS s FROM embeddings)
SELECT vec_id, round(s, 9) AS scale, list_transform(v, lambda x: greatest(-127, least(127, round(x / s)))::INT) AS codes FROM e""")
def quantise_int8(spark, sf_dir):
    q = table(spark, sf_dir, "embeddings").select("vec_id", V.quantise_int8(F.col("embedding")).alias("q"))
    return q.select("vec_id", F.round("q.scale", 9).alias("scale"), F.transform("q.codes", lambda x: x.cast("int")).alias("codes"))


@query()
def quantise_int8_recall(spark, sf_dir):
    """How much of each vector's ten nearest int8 and half floats keep."""
    e = _every_vector(spark, sf_dir)
    truth = knn.batch_top_k(e, e.withColumnRenamed("id", "query_id"), 10, DIM)
    out = None
    for kind, v in (("int8", V.dequantise_int8(V.quantise_int8(F.col("embedding")))), ("f16", V.through_f16(F.col("embedding")))):
        q = e.select("id", v.alias("embedding"))
        r = evaluate.recall_against(knn.batch_top_k(q, q.withColumnRenamed("id", "query_id"), 10, DIM), truth, 10).agg(F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg("top1"), 4).alias("top1")).withColumn("kind", F.lit(kind))
        out = r if out is None else out.unionByName(r)
    return out


_PLANES = V.planes(6, 14, DIM)


@query("SELECT vec_id, (" + " + ".join(f"CASE WHEN list_inner_product(embedding::DOUBLE[], {[float(x) for x in p]}::DOUBLE[]) >= 0 THEN {1 << i} ELSE 0 END" for i, p in enumerate(_PLANES[0])) + ")::INT AS signature FROM embeddings")
def lsh_signature(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", V.signature(F.col("embedding"), _PLANES[0]).cast("int").alias("signature"))


def signatures(spark, sf_dir) -> knn.SignatureIndex:
    """The stored index of all embeddings as they are now."""
    path = f"{shared_folder(spark)}/signatures-{version(spark, f'{sf_dir}/embeddings.parquet')}"
    return knn.SignatureIndex.open(spark, path, DIM) if exists(spark, f"{path}/codes/_SUCCESS") else knn.SignatureIndex.create(_every_vector(spark, sf_dir), path, DIM)


@query()
def ann_topk_recall(spark, sf_dir):
    """For each vector whose id is divisible by 20: the recall of its ten nearest by the index, against an exact scan of all, and the share of all vectors that was scored."""
    e = _every_vector(spark, sf_dir)
    q = e.where("CAST(id AS BIGINT) % 20 = 0").withColumnRenamed("id", "query_id")
    index = signatures(spark, sf_dir)
    found = index.batch(q, 10, exact_below=0)
    share = found.groupBy("query_id").agg((F.max("scored") / index.count).alias("scored_share"))
    return evaluate.recall_against(found, knn.batch_top_k(e, q, 10, DIM), 10).join(share, "query_id")


@query(f"SELECT CAST(vec_id AS VARCHAR) AS id, round(list_cosine_similarity(embedding::DOUBLE[], {QV}), 6) AS score FROM embeddings ORDER BY score DESC, id LIMIT 10")
def ann_topk_small(spark, sf_dir):
    """Through the index, which is exact up to 2048 vectors."""
    return signatures(spark, sf_dir).top_k(VECTOR, 10)


# text

_TF = f"len(list_filter({TOK.format('content')}, lambda x: x = {{}}))"


@query(f"SELECT doc_id, t AS term, count(*) AS n FROM (SELECT doc_id, unnest({TOK.format('text')}) AS t FROM documents) GROUP BY ALL")
def tokenize_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


BM25 = f"list_sum(list_transform(list_distinct({TERMS}), lambda q: CASE WHEN len(list_filter(tok, lambda x: x = q)) > 0 THEN greatest(0.01, ln(1 + 1 / (len(list_filter(tok, lambda x: x = q)) + 1.0::DOUBLE)) + 1) * len(list_filter(tok, lambda x: x = q)) * 2.2::DOUBLE / (len(list_filter(tok, lambda x: x = q)) + 1.2::DOUBLE * (0.25 + 0.75 * len(tok) / 50.0::DOUBLE)) ELSE 0 END::DOUBLE))"
OVERLAP = f"least(1.0, len(list_filter({TERMS}, lambda q: list_contains(tok, q))) / len({TERMS})::DOUBLE + CASE WHEN contains(lower(content), '{TEXT}') THEN 0.15 ELSE 0 END)::DOUBLE"
CT = f"{CH}, ct AS (SELECT *, {TOK.format('content')} AS tok FROM chunks)"


@query(f"WITH {CT} SELECT id, round({BM25}, 6) AS score FROM ct ORDER BY score DESC, id LIMIT 10")
def bm25_score_topk(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.round(T.bm25_score(F.lit(TEXT), F.col("content")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


@query(f"WITH {CT} SELECT id, round({OVERLAP}, 6) AS score FROM ct ORDER BY score DESC, id LIMIT 10")
def lexical_overlap_topk(spark, sf_dir):
    return texts(spark, sf_dir).select("id", F.round(T.lexical_overlap(F.lit(TEXT), F.col("content")), 6).alias("score")).orderBy(F.desc("score"), "id").limit(10)


#: bm25 of all chunks that match, with the statistics of the whole corpus
FTS = f"""{CT},
st AS (SELECT count(*)::DOUBLE AS n, avg(len(tok)) AS avgdl FROM ct),
term AS (SELECT unnest({TERMS}) AS q),
po AS (SELECT id, q, len(list_filter(tok, lambda x: x = q))::DOUBLE AS tf, len(tok)::DOUBLE AS dl FROM ct, term),
df AS (SELECT q, count(*) FILTER (tf > 0)::DOUBLE AS df FROM po GROUP BY q),
sc AS (SELECT id, q, CASE WHEN (n - df + 0.5) / (df + 0.5) <= 1 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS w FROM po JOIN df USING (q), st WHERE tf > 0),
fts AS (SELECT id, round(sum(w), 6) AS bm25 FROM sc GROUP BY id)"""


@query(f"WITH {FTS} SELECT id, bm25 FROM fts ORDER BY bm25 DESC, id LIMIT 50")
def fts_bm25_topk(spark, sf_dir):
    return lexical.ranked(text_index(spark, sf_dir).matches(TEXT), 50)


@query(f"WITH {FTS} SELECT id, bm25 FROM fts JOIN chunks USING (id) WHERE lang = 'fr' ORDER BY bm25 DESC, id LIMIT 50")
def fts_bm25_filtered(spark, sf_dir):
    return lexical.ranked(text_index(spark, sf_dir).matches(TEXT, C.where(texts(spark, sf_dir), {"lang": "fr"})), 50)


@query(f"WITH {FTS}, r AS (SELECT * FROM fts ORDER BY bm25 DESC, id LIMIT 50) SELECT id, round(1 / (1 + (SELECT max(bm25) FROM r) - bm25), 6) AS text_score FROM r")
def fts_score_normalised(spark, sf_dir):
    """Read from the chunks themselves, without an index."""
    return lexical.normalised(lexical.ranked(lexical.matches(texts(spark, sf_dir), TEXT), 50)).select("id", F.round("text_score", 6).alias("text_score"))


@query(f"""
WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, {TOK.format('text')} AS tok FROM documents),
po AS (SELECT id, len(tok)::DOUBLE AS dl, t AS term, count(*)::DOUBLE AS tf FROM (SELECT id, tok, unnest(tok) AS t FROM c) GROUP BY ALL),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(tok)) AS avgdl FROM c),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark),
df AS (SELECT term, count(*)::DOUBLE AS df FROM po GROUP BY term),
s AS (SELECT query_id, id, round(sum(CASE WHEN (n - df + 0.5) / (df + 0.5) <= 1 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25 FROM q JOIN po USING (term) JOIN df USING (term), st GROUP BY query_id, id)
SELECT query_id, id, bm25, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, id) AS rank FROM s QUALIFY rank <= 10""")
def fts_batch_topk(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return lexical.batch(text_index(spark, sf_dir), texts(spark, sf_dir), q, 10).select("query_id", "id", "bm25", F.col("rank").cast("long").alias("rank"))


def _fnv_sql(x: str) -> str:
    """FNV-1a over UTF-8 bytes of a hex string, in 128-bit arithmetic."""
    return f"list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(len(hex(encode({x}))) // 2), lambda i: ('0x' || substr(hex(encode({x})), (2 * i + 1)::INT, 2))::INT::HUGEINT)), lambda h, b: ((h - h % 256 + xor((h % 256)::INT, b::INT)) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT)"


@query(f"SELECT n_nationkey, printf('%016x', {_fnv_sql('n_name')}::UBIGINT) AS hash FROM nation")
def fnv1a64_hex(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", T.fnv1a64(F.col("n_name")).alias("hash"))


@query(f"SELECT conv_id, turn, printf('%016x', {_fnv_sql('text')}::UBIGINT) AS content_hash FROM conversations")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.fnv1a64(F.col("text")).alias("content_hash"))


_LOW = "list_reduce(list_prepend(5, list_transform(string_split(t, ''), lambda c: ascii(c))), lambda h, c: (xor(h, c) * 435) & 15)"


@query(f"""
WITH t AS (SELECT item_id, unnest({TOK.format('text')}) AS t, generate_subscripts({TOK.format('text')}, 1) AS i FROM benchmark),
h AS (SELECT item_id, {_LOW} AS h, 1 / sqrt(i) AS w FROM t),
s AS (SELECT item_id, h AS slot, sum(CASE WHEN h % 2 = 0 THEN w ELSE -w END) AS x FROM h GROUP BY ALL)
SELECT * FROM (SELECT item_id, slot::INT AS slot, round((x / sqrt(sum(x * x) OVER (PARTITION BY item_id)))::FLOAT::DOUBLE, 5) AS x FROM s) WHERE abs(x) > 1e-7""")
def embed16(spark, sf_dir):
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("benchmark")
    return rewrite.execute(spark, "SELECT item_id, slot, round(double(x), 5) AS x FROM (SELECT item_id, posexplode(v) AS (slot, x) FROM (SELECT item_id, embed(text) AS v FROM benchmark)) WHERE abs(x) > 1e-7")


# SQL surface


def _surface(name: str, statement: str, oracle: str | None) -> None:
    def run(spark, sf_dir, statement=statement):
        view(spark, sf_dir)
        return rewrite.execute(spark, statement)

    run.__name__ = name
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


_V = f"vector('{','.join(map(str, VECTOR))}')"
for _name, _op, _sql in (("op_rewrite_l2", "<->", f"list_distance(embedding, {QV})"), ("op_rewrite_cosine", "<=>", f"1 - list_cosine_similarity(embedding, {QV})"), ("op_rewrite_ip", "<#>", f"-list_inner_product(embedding, {QV})")):
    _surface(_name, f"SELECT id, round(embedding {_op} {_V}, 6) AS d FROM chunks WHERE embedding IS NOT NULL /* a <=> b */ ORDER BY d, id LIMIT 10;", f"WITH {CH} SELECT id, round({_sql}, 6) AS d FROM chunks WHERE embedding IS NOT NULL ORDER BY d, id LIMIT 10")

_surface("hybrid_score_sql", f"SELECT id, round(hybrid_score(1.0 - cosine_distance(embedding, {_V}), bm25_score('{TEXT}', content), 0.65), 6) AS hybrid FROM chunks WHERE embedding IS NOT NULL ORDER BY hybrid DESC, id LIMIT 10", f"WITH {CT} SELECT id, round(0.65 * list_cosine_similarity(embedding, {QV}) + 0.35 * {BM25}, 6) AS hybrid FROM ct WHERE embedding IS NOT NULL ORDER BY hybrid DESC, id LIMIT 10")


def _search_sql(args: str, hybrid: str, where: str, limit: int) -> tuple[str, str]:
    return f"SELECT chunk_id, doc_id, round(hybrid_score, 6) AS hybrid_score FROM SEARCH({args}) ORDER BY hybrid_score DESC, chunk_id", f"WITH {CT}, s AS (SELECT id AS chunk_id, doc_id, {hybrid} AS h FROM ct WHERE {where} ORDER BY h DESC, id LIMIT {limit}) SELECT chunk_id, doc_id, round(h, 6) AS hybrid_score FROM s"


_BOTH = f"0.65 * list_cosine_similarity(embedding, {QV}) + 0.35 * {BM25}"
_surface("search_table_fn", *_search_sql(f"'{TEXT}', NULL, 10, 0.65, 500, 'balanced', NULL, 'src3'", BM25, "doc_id = 'src3'", 10))
_surface("search_text_only", *_search_sql(f"'{TEXT}', NULL, 10", BM25, "TRUE", 10))
_surface("search_latency_profile", *_search_sql(f"'{TEXT}', NULL, 50, 0.65, 20, 'latency'", BM25, "TRUE", 50))
_surface("search_filtered", *_search_sql(f"'{TEXT}', NULL, 10, 0.65, 500, 'recall', '{{\"lang\":\"es\"}}'", BM25, "lang = 'es'", 10))


_TYPED = _search_sql(f"'{TEXT}', NULL, 10, 0.65, 500, 'recall', '{{\"n\":3,\"long text\":true,\"deep.kind\":\"1\",\"a-b\":\"x\"}}'", BM25, "rowid % 7 = 3 AND len(content) > 1000 AND created_at % 2 = 1", 10)


@query(_TYPED[1])
def search_filter_typed(spark, sf_dir):
    """Metadata filters on a number, a boolean, a string within an object, and under keys of odd characters."""
    made = F.struct((F.col("rowid") % 7).alias("n"), (F.length("content") > 1000).alias("long text"), F.struct((F.col("created_at") % 2).cast("string").alias("kind")).alias("deep"), F.lit("x").alias("a-b"))
    texts(spark, sf_dir).withColumn("metadata", F.to_json(made)).createOrReplaceTempView("typed_chunks")
    return rewrite.execute(spark, _TYPED[0], "typed_chunks")


@query(f"WITH {CT}, s AS (SELECT id AS chunk_id, {_BOTH} AS h FROM ct WHERE embedding IS NOT NULL ORDER BY h DESC, id LIMIT 10) SELECT chunk_id, round(h, 6) AS hybrid_score FROM s")
def search_hybrid_sql(spark, sf_dir):
    C.from_tables(spark, sf_dir).where("embedding IS NOT NULL").createOrReplaceTempView("vector_chunks")
    return rewrite.execute(spark, f"SELECT chunk_id, round(hybrid_score, 6) AS hybrid_score FROM SEARCH('{TEXT}', {_V}, 10, 0.65) AS s", "vector_chunks")


@query(f"WITH {CH}, s AS (SELECT id AS chunk_id, list_cosine_similarity(embedding, {QV}) AS h FROM chunks WHERE embedding IS NOT NULL ORDER BY h DESC, id LIMIT 10) SELECT chunk_id, round(h, 6) AS hybrid_score, quality FROM s LEFT JOIN labels l ON CAST(l.doc_id AS VARCHAR) = chunk_id")
def search_vector_only(spark, sf_dir):
    C.from_tables(spark, sf_dir).where("embedding IS NOT NULL").createOrReplaceTempView("vector_chunks")
    table(spark, sf_dir, "labels").createOrReplaceTempView("labels")
    return rewrite.execute(spark, f"SELECT chunk_id, round(hybrid_score, 6) AS hybrid_score, quality FROM SEARCH(NULL, {_V}, 10) LEFT JOIN labels l ON CAST(l.doc_id AS STRING) = chunk_id", "vector_chunks")


# search


def _api(name: str, request: SearchRequest, oracle: str | None) -> None:
    def run(spark, sf_dir):
        return search(C.from_tables(spark, sf_dir, request.vector is not None), request, text_index(spark, sf_dir) if request.text else None).select("chunk_id", "doc_id", "vector_score", F.round("text_score", 6).alias("text_score"), "hybrid_score")

    run.__name__ = name
    QUERIES[name] = run
    if oracle:
        SQL[name] = oracle


_SHOW = "SELECT f.id AS chunk_id, c.doc_id, f.v AS vector_score, round(f.t, 6) AS text_score, round(f.h, 6) AS hybrid_score FROM f JOIN chunks c USING (id)"
_VEC = f"vc AS (SELECT id, {COS} AS v FROM chunks WHERE embedding IS NOT NULL)"
_SCORE = f"""
m AS (SELECT f0.id, fts.bm25 FROM (SELECT id FROM cand {{anti}}) f0 JOIN fts USING (id)),
ms AS (SELECT id, 1 / (1 + (SELECT max(bm25) FROM m) - bm25) AS t FROM m {{known}}),
x AS (SELECT c.id, coalesce(vc.v, 0) AS v, coalesce(ms.t, {OVERLAP}) AS t FROM cand JOIN ct c USING (id) LEFT JOIN vc USING (id) LEFT JOIN ms USING (id))"""
_FINAL = "f AS (SELECT id, round(v, 6) AS v, round(t, 6) AS t, round({h}, 6) AS h FROM x ORDER BY h DESC, v DESC, t DESC, id LIMIT 10)"


def _hybrid_oracle(candidates: str, h: str, anti: str = "", known: str = "") -> str:
    return f"WITH {FTS}, {_VEC}, {candidates}, {_SCORE.format(anti=anti, known=known)}, {_FINAL.format(h=h)} {_SHOW}"


_api("search_api_vector", SearchRequest(vector=VECTOR, top_k=10), f"WITH {CH}, {_VEC}, f AS (SELECT id, v, 0.0::DOUBLE AS t, v AS h FROM vc ORDER BY v DESC, id LIMIT 10) {_SHOW}")
_api("search_api_text", SearchRequest(text=TEXT, top_k=10), _hybrid_oracle("""
r AS (SELECT id, bm25, row_number() OVER (ORDER BY bm25 DESC, id) AS place FROM fts QUALIFY place <= 1000),
b AS (SELECT id, 10000 + row_number() OVER (ORDER BY created_at DESC, rowid DESC) AS place FROM chunks QUALIFY place <= 11000),
cand AS (SELECT id FROM (SELECT id, place FROM r UNION ALL SELECT id, place FROM b) GROUP BY id ORDER BY min(place) LIMIT 1000)""", "t").replace("coalesce(vc.v, 0) AS v", "0.0::DOUBLE AS v"))
_api("search_api_text_filtered", SearchRequest(text="zzzz nowhere", top_k=10, filters={"lang": "de"}), f"WITH {CH}, f AS (SELECT id, 0.0::DOUBLE AS v, 0.0::DOUBLE AS t, 0.0::DOUBLE AS h FROM (SELECT id FROM chunks WHERE lang = 'de' ORDER BY created_at DESC, rowid DESC LIMIT 1000) ORDER BY id LIMIT 10) {_SHOW}")
_api("search_api_hybrid_vector_first", SearchRequest(text=TEXT, vector=VECTOR, top_k=10, alpha=0.65), _hybrid_oracle("cand AS (SELECT id FROM vc ORDER BY v DESC, id LIMIT 40)", "0.65 * v + 0.35 * t"))
_TF_CAND = """
tl AS (SELECT id, bm25, 1 / (1 + max(bm25) OVER () - bm25) AS t FROM (SELECT * FROM fts ORDER BY bm25 DESC, id LIMIT 80)),
vl AS (SELECT id, v FROM vc ORDER BY v DESC, id LIMIT 40),
p AS (SELECT id, coalesce(v, 0) AS v, coalesce(t, 0) AS t FROM tl FULL JOIN vl USING (id)),
cand AS (SELECT id FROM (SELECT id, round(v, 6) AS v, round(t, 6) AS t, round(0.3 * v + 0.7 * t, 6) AS h FROM p) ORDER BY h DESC, v DESC, t DESC, id LIMIT 40)"""
_api("search_api_hybrid_text_first", SearchRequest(text=TEXT, vector=VECTOR, top_k=10, alpha=0.3), _hybrid_oracle(_TF_CAND, "0.3 * v + 0.7 * t", "WHERE id NOT IN (SELECT id FROM tl)", "UNION ALL SELECT id, t FROM tl"))
_BAL = """
vl AS (SELECT id, v, row_number() OVER (ORDER BY v DESC, id) AS place FROM vc QUALIFY place <= 1000),
tl AS (SELECT id, 10000 + row_number() OVER (ORDER BY bm25 DESC, id) AS place FROM fts WHERE (SELECT count(*) FROM vl) < 1000 QUALIFY place <= 11000),
b AS (SELECT id, 20000 + row_number() OVER (ORDER BY created_at DESC, rowid DESC) AS place FROM chunks QUALIFY place <= 21000),
mg AS (SELECT id FROM (SELECT id, place FROM vl UNION ALL SELECT * FROM tl UNION ALL SELECT * FROM b) GROUP BY id ORDER BY min(place) LIMIT 1000),
cand AS (SELECT id FROM (SELECT id, round(coalesce(v, 0), 6) AS v, round({h}, 6) AS h FROM mg LEFT JOIN vl USING (id)) ORDER BY h DESC, v DESC, id LIMIT 60)"""
_api("search_api_hybrid_balanced", SearchRequest(text=TEXT, vector=VECTOR, top_k=10, alpha=0.5), _hybrid_oracle(_BAL.format(h="0.5 * coalesce(v, 0)"), "0.5 * v + 0.5 * t").replace("coalesce(ms.t, ", "coalesce(CASE WHEN (SELECT count(*) FROM vl) < 1000 THEN ms.t END, "))


@query(f"""
WITH {CT}, st AS (SELECT count(*)::DOUBLE AS n, avg(len(tok)) AS avgdl FROM ct),
po AS (SELECT id, len(tok)::DOUBLE AS dl, t AS term, count(*)::DOUBLE AS tf FROM (SELECT id, tok, unnest(tok) AS t FROM ct) GROUP BY ALL),
df AS (SELECT term, count(*)::DOUBLE AS df FROM po GROUP BY term),
q AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text, list_distinct({TOK.format('text')}) AS terms, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id),
cand AS (SELECT query_id, id, near AS v FROM (SELECT query_id, c.id, round(list_cosine_similarity(c.embedding, q.v), 6) AS near FROM q JOIN ct c ON c.embedding IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY near DESC, id) <= 40),
s AS (SELECT query_id, id, round(sum(CASE WHEN (n - df + 0.5) / (df + 0.5) <= 1 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS bm25
      FROM cand JOIN (SELECT query_id, unnest(terms) AS term FROM q) t USING (query_id) JOIN po USING (id, term) JOIN df USING (term), st GROUP BY query_id, id),
m AS (SELECT query_id, id, 1 / (1 + max(bm25) OVER (PARTITION BY query_id) - bm25) AS t FROM s),
x AS (SELECT cand.query_id, cand.id, cand.v, coalesce(m.t, least(1.0, len(list_filter(q.terms, lambda w: list_contains(ct.tok, w))) / len(q.terms)::DOUBLE + CASE WHEN contains(lower(ct.content), lower(q.text)) THEN 0.15 ELSE 0 END)) AS t
      FROM cand JOIN q USING (query_id) JOIN ct USING (id) LEFT JOIN m ON m.query_id = cand.query_id AND m.id = cand.id),
f AS (SELECT query_id, id AS chunk_id, v AS vector_score, round(t, 6) AS text_score, round(0.6137 * v + 0.3863 * t, 6) AS hybrid_score FROM x)
SELECT query_id, chunk_id, vector_score, text_score, hybrid_score, row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, vector_score DESC, text_score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 10""")
def search_batch_hybrid(spark, sf_dir):
    """Every item of the benchmark that has a vector, by text and vector at once. The weight has four digits, so that sixth digits of the sums seldom tie."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), "embedding")
    asked = table(spark, sf_dir, "benchmark").join(vectors, "item_id").select(F.col("item_id").alias("query_id"), "text", "embedding")
    found = search_batch(C.from_tables(spark, sf_dir), asked, SearchRequest(text="x", vector=VECTOR, top_k=10, alpha=0.6137), text_index(spark, sf_dir))
    return found.withColumn("rank", F.col("rank").cast("long"))


def _scored(spark, sf_dir) -> DataFrame:
    """The 200 nearest chunks with both scores: fusion ranks candidates, not the corpus."""
    ch = C.with_size(C.from_tables(spark, sf_dir), DIM)
    cosine = F.round(V.cosine(F.col("embedding"), V.literal(VECTOR)), 6).alias("vector_score")
    near = F.broadcast(ch.select("id", cosine).orderBy(F.desc("vector_score"), "id").limit(200))  # 200 rows
    return ch.join(near, "id").select("id", "vector_score", F.round(T.bm25_score(F.lit(TEXT), F.col("content")), 6).alias("text_score"))


_SC = f"{CT}, n AS (SELECT id, {COS} AS vector_score FROM chunks WHERE embedding IS NOT NULL ORDER BY vector_score DESC, id LIMIT 200), s AS (SELECT id, vector_score, round({BM25}, 6) AS text_score FROM ct JOIN n USING (id))"


@query(f"WITH {_SC}, r AS (SELECT *, 1 / (60.0 + row_number() OVER (ORDER BY vector_score DESC, id)) + 1 / (60.0 + row_number() OVER (ORDER BY text_score DESC, id)) AS h FROM s) SELECT id, vector_score, text_score, round(h, 6) AS hybrid_score FROM r ORDER BY hybrid_score DESC, vector_score DESC, text_score DESC, id LIMIT 10")
def rrf_fusion(spark, sf_dir):
    return fusion.final(fusion.reciprocal_rank(_scored(spark, sf_dir), 60.0), 10)


@query(f"WITH {_SC} SELECT id, vector_score, text_score, round(0.65 * vector_score + 0.35 * text_score, 6) AS hybrid_score FROM s ORDER BY hybrid_score DESC, vector_score DESC, text_score DESC, id LIMIT 10")
def weighted_fusion(spark, sf_dir):
    return fusion.final(fusion.weighted(_scored(spark, sf_dir), 0.65), 10)


# ingestion and maintenance


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _chunk_query(name: str, strategy: str, size: int, overlap: int):
    def run(spark, sf_dir):
        return chunking.chunked(_docs(spark, sf_dir), strategy, size, overlap).select("doc_id", "id", "nth", "start", "end", "heading", "content_hash")

    run.__name__ = name
    QUERIES[name] = run


_chunk_query("chunk_fixed", "fixed", 1200, 120)
_chunk_query("chunk_heading", "heading", 1200, 120)
_chunk_query("chunk_semantic", "semantic", 1200, 0)


@query()
def chunk_ids(spark, sf_dir):
    return chunking.with_metadata(chunking.chunked(_docs(spark, sf_dir), "heading", tenant="acme-1", dim=16), "acme-1").select("id", "doc_id", "metadata", "embedding")


def _hashed(spark, sf_dir) -> DataFrame:
    """Chunks whose content hash is the language and the size, so that many are alike."""
    return C.from_tables(spark, sf_dir).withColumn("metadata", F.to_json(F.struct(F.concat("doc_id", F.lit("-"), (F.col("created_at") % 97).cast("string")).alias("content_hash"))))


@query("SELECT CAST(max(doc_id) AS VARCHAR) AS id FROM documents GROUP BY source, n_chars % 97")
def dedupe_content_hash(spark, sf_dir):
    return C.deduplicated(_hashed(spark, sf_dir)).select("id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return C.orphans(docs, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"))).select(F.col("id").alias("c_custkey"))


@query("""
WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS id, min(conv_id * 1000 + turn) AS first, arg_max(text, conv_id * 1000 + turn) AS content FROM (SELECT conv_id AS doc_id, conv_id, turn, text FROM conversations) GROUP BY 1)
SELECT coalesce(d.id, c.id) AS id, coalesce(c.content, d.content) AS content, coalesce(d.doc_id, t + row_number() OVER (PARTITION BY d.doc_id IS NULL ORDER BY first)) AS rowid, coalesce(d.n_chars, n + row_number() OVER (PARTITION BY d.doc_id IS NULL ORDER BY first)) AS created_at
FROM (SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, doc_id, n_chars FROM documents) d FULL JOIN c ON d.id = c.id, (SELECT max(doc_id) AS t, max(n_chars) AS n FROM documents)""")
def upsert_last_wins(spark, sf_dir):
    conv = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), F.col("conv_id").cast("string").alias("id"), F.lit("conv").alias("doc_id"), F.col("text").alias("content"), F.lit("{}").alias("metadata"), F.lit(None).cast("array<float>").alias("embedding"))
    return C.upsert(texts(spark, sf_dir), conv).select("id", "content", "rowid", "created_at")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE lang <> 'de'")
def delete_by_metadata(spark, sf_dir):
    return C.delete_by_metadata(C.from_tables(spark, sf_dir), "lang", "de").select("id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents WHERE source <> 'src3'")
def delete_by_doc(spark, sf_dir):
    ch = C.from_tables(spark, sf_dir)
    return C.delete_by_document(ch, ch.select(F.col("doc_id").alias("id")).distinct(), "src3")[0].select("id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS doc_source FROM documents ORDER BY doc_id LIMIT 50 OFFSET 100")
def page_scan(spark, sf_dir):
    ch = C.from_tables(spark, sf_dir)
    docs = ch.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("source")).distinct()
    return C.page(ch, docs, 100, 50).select("id", "doc_source")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents ORDER BY n_chars DESC, doc_id DESC LIMIT 25")
def recent_chunks(spark, sf_dir):
    return C.recent(C.from_tables(spark, sf_dir), 25).select("id")


@query(f"WITH {CH} SELECT count(*) AS chunk_count, count(DISTINCT doc_id) AS document_count, count(embedding) AS vector_count, max(len(embedding))::INT AS max_dim, sum(len(embedding))::BIGINT * 4 AS bytes_f32, sum(len(embedding))::BIGINT * 2 AS bytes_f16, sum(len(embedding))::BIGINT + count(embedding) * 4 AS bytes_int8 FROM chunks")
def diagnostics(spark, sf_dir):
    return C.diagnostics(C.from_tables(spark, sf_dir))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS place FROM documents WHERE doc_id % 20 = 0")
def lookup_ids(spark, sf_dir):
    """The chunks whose id is divisible by 20, in falling order."""
    ch = texts(spark, sf_dir)
    top = (ch.agg(F.max("rowid")).first()[0] or 0) // 20
    ids = spark.range(top + 1).select(F.col("id").alias("place"), ((top - F.col("id")) * 20).cast("string").alias("id"))
    return C.lookup(ch, ids).select("id", "doc_id", "place")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN '{\"kind\":\"' || lang || '\"}' ELSE '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' END AS metadata FROM documents")
def update_metadata(spark, sf_dir):
    new = table(spark, sf_dir, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"), F.to_json(F.struct(F.col("lang").alias("kind"))).alias("json"))
    return C.set_metadata(texts(spark, sf_dir), new).select("id", "metadata")


@query("WITH k AS (SELECT max(doc_id) AS doc_id, source FROM documents GROUP BY source, n_chars % 97) SELECT source AS document, count(*) AS chunks FROM k GROUP BY source")
def compact_chunks(spark, sf_dir):
    """Deduplicated chunks, and the documents that still have some, out of all the sources and one that has none."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("id")).distinct().union(spark.createDataFrame([("empty",)], "id string"))
    kept, left = C.compact(_hashed(spark, sf_dir), docs)
    return kept.groupBy(F.col("doc_id").alias("document")).agg(F.count(F.lit(1)).alias("chunks")).join(left.select(F.col("id").alias("document")), "document")


# evaluation and reports


@query("""
WITH r AS (SELECT e.label AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) AS rank FROM embeddings e),
rel AS (SELECT e.label AS query_id, l.doc_id AS id FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id WHERE quality = 1),
sz AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), qs AS (SELECT DISTINCT query_id FROM r),
g AS (SELECT query_id, coalesce(n, 0) AS n, k FROM qs LEFT JOIN sz USING (query_id), (SELECT unnest([1, 3, 5, 10]) AS k)),
h AS (SELECT g.query_id, n, k, count(rank) AS hits, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM g LEFT JOIN (SELECT query_id, rank FROM r JOIN rel USING (query_id, id)) x ON g.query_id = x.query_id AND rank <= k GROUP BY ALL)
SELECT k::INT AS k, round(avg(CASE WHEN n > 0 THEN hits / n ELSE 0 END), 6) AS recall, round(avg(CASE WHEN n > 0 THEN hits / k ELSE 0 END), 6) AS "precision", round(avg(CASE WHEN n > 0 THEN coalesce(1 / first, 0) ELSE 0 END), 6) AS mrr,
round(avg(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END), 6) AS ndcg, round(avg(CASE WHEN n > 0 AND hits > 0 THEN 1 ELSE 0 END), 6) AS hit_rate FROM h GROUP BY k""")
def eval_metrics_at_k(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    results = e.select(F.col("label").alias("query_id"), F.col("vec_id").alias("id"), rank.alias("rank"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return evaluate.metrics_at_k(results, results.select("query_id", "id").join(good, "id").select("query_id", "id"), [1, 3, 5, 10])


_METRICS = """,
sz AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1), qs AS (SELECT DISTINCT query_id FROM rel),
g AS (SELECT query_id, coalesce(n, 0) AS n, k FROM qs LEFT JOIN sz USING (query_id), (SELECT unnest([1, 3, 5]) AS k)),
h AS (SELECT g.query_id, n, k, count(rank) AS hits, min(rank) AS first, coalesce(sum(1 / log2(rank + 1)), 0) AS dcg FROM g LEFT JOIN (SELECT query_id, rank FROM r JOIN rel USING (query_id, id)) x ON g.query_id = x.query_id AND rank <= k GROUP BY ALL)
SELECT k::INT AS k, round(avg(hits / n), 6) AS recall, round(avg(hits / k), 6) AS "precision", round(avg(coalesce(1 / first, 0)), 6) AS mrr,
round(avg(dcg / list_sum(list_transform(range(1, least(n, k) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg, round(avg(CASE WHEN hits > 0 THEN 1 ELSE 0 END), 6) AS hit_rate FROM h GROUP BY k"""


@query(f"WITH {CH}, q AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, c.id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(c.embedding, q.v), 6) DESC, c.id) AS rank FROM q JOIN chunks c ON c.embedding IS NOT NULL QUALIFY rank <= 5), rel AS (SELECT CAST(q.vec_id AS VARCHAR) AS query_id, CAST(e.vec_id AS VARCHAR) AS id FROM q JOIN embeddings e ON q.label = e.label)" + _METRICS)
def eval_run(spark, sf_dir):
    """An evaluation of the vectors whose id is divisible by 20 against all chunks; those of their label are relevant."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", F.col("label").alias("group"))
    asked = e.where("CAST(id AS BIGINT) % 20 = 0").withColumnRenamed("id", "query_id")
    return evaluation.run_groups(C.from_tables(spark, sf_dir), asked, e.select("group", "id"), SearchRequest(vector=VECTOR), [1, 3, 5])[0]


@query(f"WITH {CH}, s AS (SELECT id AS chunk_id, doc_id, {COS} AS vector_score FROM chunks WHERE embedding IS NOT NULL AND lang = 'en' ORDER BY vector_score DESC, id LIMIT 10) SELECT *, vector_score AS hybrid_score FROM s")
def tool_search(spark, sf_dir):
    """All documents put into a store, which is asked by the tool of that name."""
    store = temporary(spark, shared_folder(spark))
    store.ingest(C.from_tables(spark, sf_dir))
    said = Tools(store).call("search", {"query_embedding": VECTOR, "top_k": 10, "metadata_filters": {"lang": "en"}})
    return spark.createDataFrame([(r["chunk_id"], r["doc_id"], r["vector_score"], r["hybrid_score"]) for r in said["payload"]], "chunk_id string, doc_id string, vector_score double, hybrid_score double")


@query("""
WITH v AS (SELECT vec_id AS id, label AS query_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS a, row_number() OVER (PARTITION BY label ORDER BY vec_id % 7, vec_id) AS b FROM embeddings)
SELECT query_id, sum(CASE WHEN b <= 10 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS recall, max(CASE WHEN a = 1 AND b = 1 THEN 1.0 ELSE 0.0 END)::DOUBLE AS top1 FROM v WHERE a <= 10 GROUP BY query_id""")
def recall_vs_truth(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("query_id"))
    by = lambda *o: e.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*o)))
    return evaluate.recall_against(by(F.col("id") % 7, "id"), by("id"), 10)


_SUMMARY = """
WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, """ + ", ".join(f"max(value) FILTER (i = floor((n - 1) * {p}::DOUBLE + 0.5) + 1) AS {q}" for p, q in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))) + " FROM s GROUP BY event_type"


@query(_SUMMARY)
def latency_summary(spark, sf_dir):
    return reports.latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def latency_interp(spark, sf_dir):
    return reports.latency_interpolated(table(spark, sf_dir, "events"), "value", ["event_type"])


@query("SELECT event_type, round(median(value), 6) AS median, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 6) AS success_rate FROM events GROUP BY event_type")
def quickstart_median(spark, sf_dir):
    return reports.quickstart(table(spark, sf_dir, "events"), "value", F.col("value") < 50, ["event_type"])


def _requests(spark, sf_dir) -> DataFrame:
    n, kind = F.col("event_id") % 100, F.col("event_type")
    path = F.when(kind == "click", "/v1/sql?compact=1").when(kind == "view", "/grpc/v1.QueryService/Query").otherwise("/health")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), path.alias("path"), F.when(n < 90, 200).when(n < 97, 404).otherwise(500).alias("status"), F.col("value").alias("duration_ms"))


_REQ = """WITH r AS (SELECT event_id AS seq, CASE event_type WHEN 'click' THEN '/v1/sql?compact=1' WHEN 'view' THEN '/grpc/v1.QueryService/Query' ELSE '/health' END AS path, CASE WHEN event_id % 100 < 90 THEN 200 WHEN event_id % 100 < 97 THEN 404 ELSE 500 END AS status, value AS duration_ms, event_type IN ('click', 'view') AS is_sql FROM events),
m AS (SELECT count(*) AS requests, count(*) FILTER (status BETWEEN 400 AND 499) AS client_errors, count(*) FILTER (status >= 500) AS server_errors, count(*) FILTER (is_sql) AS sql_requests, count(*) FILTER (is_sql AND status >= 400) AS sql_failed, round(coalesce(avg(duration_ms) FILTER (is_sql), 0), 6) AS sql_avg_ms, coalesce(max(duration_ms) FILTER (is_sql), 0) AS sql_max_ms FROM r)"""


@query(f"{_REQ} SELECT * FROM m")
def request_metrics(spark, sf_dir):
    return reports.request_metrics(_requests(spark, sf_dir))


@query(f"{_REQ} SELECT round(100 * (requests - server_errors) / requests, 6) AS availability, 100 * (requests - server_errors) / requests >= 99.95 AS availability_met, 2.5::DOUBLE AS rpo_seconds, TRUE AS rpo_met, round(sql_failed / sql_requests, 6) AS sql_error_rate, sql_failed / sql_requests > 0.05 AS alert_sql_errors, sql_avg_ms > 50 AS alert_sql_latency, TRUE AS alert_lag, FALSE AS alert_restore FROM m")
def slo_report(spark, sf_dir):
    return reports.service_levels(reports.request_metrics(_requests(spark, sf_dir)), lag_ms=2500.0, restore_ms=300_000)


@query(f"{_REQ} SELECT seq, path, status, duration_ms FROM r ORDER BY seq DESC LIMIT 512")
def recent_requests(spark, sf_dir):
    return reports.recent_requests(_requests(spark, sf_dir))


@query("SELECT event_id AS unix_ms, CAST(user_id AS VARCHAR) AS actor_id, 't' || (user_id % 4) AS tenant_id, event_type AS operation, event_id % 10 <> 0 AS allowed FROM events WHERE user_id % 4 = 1 AND event_id % 10 = 0 AND event_id >= 100")
def audit_filter(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("unix_ms"), F.col("user_id").cast("string").alias("actor_id"), F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"), F.col("event_type").alias("operation"), (F.col("event_id") % 10 != 0).alias("allowed"))
    return reports.audit(e, tenant="t1", allowed=False, since=100)


#: Who may do what, by role and operation: granted to some role, and for another tenant only with the role admin.
_RBAC = """
WITH e AS (SELECT event_id, user_id % 5 = event_id % 5 AS own, ['query', 'ingest', 'sql_admin', 'delete_tenant'][1 + event_id % 4] AS op,
        [['reader'], ['writer'], ['tenant_admin'], ['admin'], ['reader', 'tenant_admin'], ['stranger'], [], ['stranger', 'admin']][1 + user_id % 8] AS roles FROM events),
g(role, op) AS (VALUES ('reader', 'query'), ('writer', 'query'), ('writer', 'ingest'), ('tenant_admin', 'query'), ('tenant_admin', 'ingest'), ('tenant_admin', 'delete_tenant'),
        ('admin', 'query'), ('admin', 'ingest'), ('admin', 'sql_admin'), ('admin', 'delete_tenant'))
SELECT event_id, EXISTS (SELECT 1 FROM g WHERE g.op = e.op AND list_contains(e.roles, g.role)) AND (own OR list_contains(roles, 'admin')) AS allowed FROM e"""


@query(_RBAC)
def rbac_allowed(spark, sf_dir):
    held = [["reader"], ["writer"], ["tenant_admin"], ["admin"], ["reader", "tenant_admin"], ["stranger"], [], ["stranger", "admin"]]
    roles = F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in held])
    ops = F.array(*map(F.lit, ("query", "ingest", "sql_admin", "delete_tenant")))
    pick: Callable[[Column, Column], Column] = lambda a, i: F.element_at(a, (i + 1).cast("int"))
    e = table(spark, sf_dir, "events").select("event_id", pick(roles, F.col("user_id") % 8).alias("actor_roles"), (F.col("user_id") % 5).alias("actor_tenant"), (F.col("event_id") % 5).alias("tenant"), pick(ops, F.col("event_id") % 4).alias("operation"))
    return reports.allowed(e).select("event_id", "allowed")


@query(f"WITH {CH} SELECT id, {COS} AS score FROM chunks WHERE embedding IS NOT NULL AND source = 'src5' AND lang = 'en' ORDER BY score DESC, id LIMIT 10")
def tenant_scope(spark, sf_dir):
    ch = C.from_tables(spark, sf_dir).withColumn("metadata", F.to_json(F.struct(F.col("doc_id").alias("tenant"), F.get_json_object("metadata", "$.lang").alias("lang"))))
    return knn.top_k(C.where(ch, reports.tenant_filters({"lang": "en"}, "src5")), VECTOR, 10)


@query("""
WITH a AS (SELECT event_id + 1 AS i, (CASE WHEN event_id % 997 <> 0 OR event_id < 2000 THEN 1 ELSE 0 END) + (CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END) + 1 AS n FROM events)
SELECT coalesce(least(min(i) FILTER (n < 2), (SELECT max(i) + 1 FROM a)), 1) - 1 AS commit_index FROM a""")
def replication_commit_index(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = (F.col("event_id") + 1).alias("index")
    acks = e.select(i, F.lit("n0").alias("node_id")).union(e.where("event_id % 997 <> 0 OR event_id < 2000").select(i, F.lit("n1"))).union(e.where("event_id % 2 = 0").select(i, F.lit("n2")))
    return reports.commit_index(e.select(i), acks, 2)


def _snapshots(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("snapshot_id"), (F.col("o_custkey") * 1000 + F.col("o_orderkey") % 1000).alias("created_ms"), (F.col("o_orderkey") % 5 != 0).alias("present"))


_SNAP = "WITH s AS (SELECT o_orderkey AS snapshot_id, o_custkey * 1000 + o_orderkey % 1000 AS created_ms, o_orderkey % 5 <> 0 AS present FROM orders)"


@query(f"{_SNAP} SELECT * FROM s WHERE created_ms <= 90000 AND present ORDER BY created_ms DESC, snapshot_id DESC LIMIT 1")
def pitr_select(spark, sf_dir):
    return reports.restore_point(_snapshots(spark, sf_dir), 90_000)


@query(f"{_SNAP} SELECT * FROM s WHERE created_ms < 50000 AND present AND snapshot_id <> (SELECT snapshot_id FROM s ORDER BY created_ms DESC, snapshot_id LIMIT 1)")
def snapshot_prune(spark, sf_dir):
    return reports.prunable(_snapshots(spark, sf_dir), 100_000, 50_000)


@query("SELECT count(*) AS scanned, count(*) FILTER (user_id % 2 = 0) AS encrypted, count(*) FILTER (user_id % 6 = 0) AS current, (SELECT string_agg(k, ',' ORDER BY k) FROM (SELECT DISTINCT 'k' || (user_id % 3) AS k FROM events WHERE user_id % 2 = 0 AND user_id % 3 <> 0)) AS stale_keys, FALSE AS verified FROM events")
def key_rotation_report(spark, sf_dir):
    value = F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("enc:v1:k"), (F.col("user_id") % 3).cast("string"), F.lit(":00ff"))).otherwise("plain")
    return reports.key_report(table(spark, sf_dir, "events").select(value.alias("value")), "k0")


@query("""SELECT event_id, '{"k":"[REDACTED]"}' AS detail FROM events""")
def redact_detail(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.redact(F.col("props"), ["k"]).alias("detail"))


# importers


def _import_query(name: str, source: str, record: Callable[[DataFrame], DataFrame], oracle: str) -> None:
    def run(spark, sf_dir):
        lines = record(C.from_tables(spark, sf_dir).where("embedding is not null"))
        recs = importers.records(lines, source)
        return recs.select("id", "doc_id", "content", F.size("embedding").alias("dims"), F.round(V.norm(F.col("embedding")), 4).alias("length"), "source", "doc_source")

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = oracle


_IMPORTED = f"WITH {CH} SELECT id, doc_id, content, len(embedding)::INT AS dims, round(sqrt(list_inner_product(embedding, embedding)), 4) AS length, lang AS source, {{}} AS doc_source FROM chunks WHERE embedding IS NOT NULL"
_lang = F.get_json_object
_import_query("import_pgvector_shape", "pgvector", lambda c: c.select(F.col("rowid").alias("line"), F.to_json(F.struct("id", "doc_id", "content", F.from_json("metadata", "map<string,string>").alias("metadata"), "embedding", F.get_json_object("metadata", "$.lang").alias("source"), F.lit("made").alias("doc_source"))).alias("value")), _IMPORTED.format("'made'"))
_import_query("import_weaviate_shape", "weaviate", lambda c: c.select(F.col("rowid").alias("line"), F.to_json(F.struct("id", F.struct("doc_id", "content", F.get_json_object("metadata", "$.lang").alias("source")).alias("properties"), F.col("embedding").alias("vector"))).alias("value")), _IMPORTED.format("lang"))
_import_query("import_milvus_shape", "milvus", lambda c: c.select(F.col("rowid").alias("line"), F.to_json(F.struct("id", "doc_id", "content", F.from_json("metadata", "map<string,string>").alias("metadata"), "embedding", F.get_json_object("metadata", "$.lang").alias("source"))).alias("value")), _IMPORTED.format("lang"))
_import_query("import_qdrant_shape", "qdrant", lambda c: c.select(F.col("rowid").alias("line"), F.to_json(F.struct("id", F.struct("doc_id", "content", F.get_json_object("metadata", "$.lang").alias("source")).alias("payload"), F.col("embedding").alias("vector"))).alias("value")), _IMPORTED.format("lang"))


@query("""SELECT * FROM (VALUES ('by_vector', 'vector', 'chunks', 'embedding', 'hnsw', '{"ef_construction": 64, "m": 16}', 'active'), ('by_text', 'text', 'chunks', 'content', 'fts5', '{}', 'active')) AS t(name, index_kind, table_name, column_name, using_engine, options_json, status)""")
def index_catalog(spark, sf_dir):
    view(spark, sf_dir)
    catalog = Catalog()
    for s in ("CREATE VECTOR INDEX IF NOT EXISTS by_vector ON chunks(embedding) USING HNSW WITH (m=16, ef_construction=64);", "CREATE TEXT INDEX by_text ON chunks(content) USING FTS5"):
        catalog.run(spark, s)
    return catalog.table(spark)


@query("SELECT 'brute_force_fallback' AS vector_path, 'vector_only' AS fusion_mode, TRUE AS tie_break")
def explain_retrieval(spark, sf_dir):
    view(spark, sf_dir)
    said = Catalog().explain(spark, f"EXPLAIN RETRIEVAL SELECT id, embedding <=> {_V} AS d FROM chunks WHERE embedding IS NOT NULL ORDER BY d, id LIMIT 5")
    return spark.createDataFrame([(said["execution_path"]["vector"], said["score_attribution"]["fusion_mode"], said["determinism"]["has_explicit_tie_break"])], "vector_path string, fusion_mode string, tie_break boolean")


@query(f"WITH {CH}, s AS (SELECT id, doc_id, {COS} AS score FROM chunks WHERE embedding IS NOT NULL ORDER BY score DESC, id LIMIT 10) SELECT list(id ORDER BY score DESC, id) AS ids, list(doc_id ORDER BY score DESC, id) AS doc_ids, list(score ORDER BY score DESC, id) AS scores, count(*) AS row_count FROM s")
def compact_envelope(spark, sf_dir):
    found = knn.top_k(C.from_tables(spark, sf_dir), VECTOR, 10).join(C.from_tables(spark, sf_dir).select("id", "doc_id"), "id")
    rows = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id", "doc_id")))
    return found.agg(rows.alias("r"), F.count(F.lit(1)).alias("row_count")).select(F.col("r.id").alias("ids"), F.col("r.doc_id").alias("doc_ids"), F.transform("r.s", lambda x: -x).alias("scores"), "row_count")


# SQL that needs no more than Spark's own; one text serves both engines


def _plain(name: str, sql: str) -> None:
    def run(spark, sf_dir):
        for t in TABLES:
            if t in sql:
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(sql)

    run.__name__ = name
    QUERIES[name], SQL[name] = run, sql


_plain("sql_join_inner", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
_plain("sql_join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
_plain("sql_join_right", "SELECT r_name, count(n_nationkey) AS n FROM nation RIGHT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
_plain("sql_join_full", "SELECT coalesce(s_nationkey, n_nationkey) AS k, count(s_suppkey) AS n FROM supplier FULL JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
_plain("sql_join_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_plain("sql_join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
_plain("sql_join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_plain("sql_join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
_plain("sql_join_natural", "SELECT count(*) AS n FROM (SELECT n_nationkey AS k, n_name FROM nation) NATURAL JOIN (SELECT s_nationkey AS k, s_name FROM supplier)")
_plain("sql_setop_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
_plain("sql_setop_union_all", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
_plain("sql_setop_intersect", "SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer")
_plain("sql_setop_except", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem")
_plain("sql_window_rank", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
_plain("sql_window_shift", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, lead(o_orderkey, 2) OVER w AS after, first_value(o_orderkey) OVER w AS first FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
_plain("sql_window_frame", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS mean FROM events")
_plain("sql_window_range", "SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS n, percent_rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS pr, cume_dist() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) AS cd FROM lineitem")
_QUOTED = "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, count(*) AS n, CAST(max(datediff({})) AS BIGINT) AS days FROM orders GROUP BY 1, 2, 3"
_plain("sql_dates", _QUOTED.format("CAST(o_orderdate AS DATE), DATE '1990-01-01'"))
SQL["sql_dates"] = _QUOTED.format("'day', DATE '1990-01-01', CAST(o_orderdate AS DATE)")
_plain("sql_group_having", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 100")
_plain("sql_distinct", "SELECT DISTINCT p_brand, p_size FROM part")
_plain("sql_group_concat", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
SQL["sql_group_concat"] = "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"
_plain("sql_recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT n, count(s_suppkey) AS suppliers FROM t LEFT JOIN supplier ON s_suppkey % 50 = n - 1 GROUP BY n")
_plain("sql_json_extract", "SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS BIGINT)) AS k FROM events GROUP BY event_type")
SQL["sql_json_extract"] = "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type"
_plain("sql_scalar_functions", "SELECT p_partkey, upper(p_name) AS u, substr(p_type, 1, 5) AS s, length(p_name) AS n, replace(p_brand, '#', '-') AS r, instr(p_type, ' ') AS i, round(abs(p_retailprice - 1000), 2) AS a FROM part")
