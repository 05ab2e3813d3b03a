"""Known values of the functions, the planner, SQL rewriting, chunking, imports, maintenance and streaming."""

from __future__ import annotations

import json
import shutil
import sqlite3
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrova.functions import cipher
from retrova.functions import text as T
from retrova.operators import chunks as C
from retrova.operators import evaluate, fusion, knn, reports
from retrova.plans import rewrite
from retrova.plans.ddl import Catalog
from retrova.plans.request import BALANCED, TEXT_FIRST, VECTOR_FIRST, SearchRequest, candidate_limit
from retrova.plans.search import search
from retrova.sources import chunking, importers
from retrova.streaming import ingest

SEED = [
    (1, "c1", "d1", "Rust powers AI agents with safe systems code.", '{"tenant":"acme","topic":"rust"}', [1.0, 0.0, 0.0], 1),
    (2, "c2", "d2", "PostgreSQL handles relational workloads at scale.", '{"tenant":"acme","topic":"postgres"}', [0.0, 1.0, 0.0], 2),
    (3, "c3", "d1", "SQLite is excellent for local-first RAG memory.", '{"tenant":"beta","topic":"sqlite"}', [0.8, 0.2, 0.0], 3),
]


@pytest.fixture(scope="module")
def seed(spark):
    df = spark.createDataFrame(SEED, C.SCHEMA).cache()
    df.createOrReplaceTempView("chunks")
    return df


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def test_search_seed(seed):
    assert ids(search(seed, SearchRequest(vector=[0.95, 0.05, 0.0], top_k=2)))[0] == "c1"
    assert ids(search(seed, SearchRequest(text="local rag memory sqlite", vector=[0.7, 0.3, 0.0], alpha=0.5, top_k=2)))[0] == "c3"
    assert set(ids(search(seed, SearchRequest(vector=[1.0, 0, 0], filters={"tenant": "acme"})))) == {"c1", "c2"}
    assert ids(search(seed, SearchRequest(text="zzz", top_k=3))) == ["c1", "c2", "c3"]
    assert search(seed, SearchRequest(text="rust", filters={"tenant": "nobody"})).count() == 0


def test_ties_go_to_the_lower_id(spark):
    rows = [(1, "z-chunk", "d", "same", "{}", [1.0, 0.0], 1), (2, "a-chunk", "d", "same", "{}", [1.0, 0.0], 2)]
    df = spark.createDataFrame(rows, C.SCHEMA)
    assert ids(search(df, SearchRequest(vector=[1.0, 0.0]))) == ["a-chunk", "z-chunk"]
    assert ids(search(df, SearchRequest(text="same", vector=[1.0, 0.0], alpha=0.5)))[0] == "a-chunk"


def test_rank_fusion_differs_from_weights(spark):
    rows = [(1, "z", "d", "noise", "{}", [1.0, 0.0], 1), (2, "b", "d", "target", "{}", [0.97, 0.03], 2), (3, "c", "d", "target", "{}", [0.94, 0.06], 3)]
    df = spark.createDataFrame(rows, C.SCHEMA)
    assert ids(search(df, SearchRequest(text="target", vector=[1.0, 0.0], alpha=1.0, top_k=3)))[0] == "z"
    assert ids(search(df, SearchRequest(text="target", vector=[1.0, 0.0], alpha=1.0, top_k=3, rrf_constant=1.0)))[0] == "b"
    with pytest.raises(ValueError):
        fusion.reciprocal_rank(df, 0)


def test_needle_among_noise(spark):
    rows = [(1, "needle", "d", "ultrauniqueterm retrieval anchor", "{}", None, 1)] + [(i, f"n{i}", "d", f"noise row {i}", "{}", None, i) for i in range(2, 22)]
    assert ids(search(spark.createDataFrame(rows, C.SCHEMA), SearchRequest(text="ultrauniqueterm", top_k=1, candidate_limit=5))) == ["needle"]


def test_profiles_and_budgets():
    assert candidate_limit("latency", 4, 500) == 32 and candidate_limit("recall", 5, 20) == 200
    q = SearchRequest(text="a", vector=[1.0], top_k=10, candidate_limit=200)
    assert [q.rerank_budget(m) for m in (VECTOR_FIRST, TEXT_FIRST, BALANCED)] == [40, 40, 60]
    modes = {a: SearchRequest(text="a", vector=[1.0], alpha=a).mode() for a in (0.3, 0.5, 0.7)}
    assert modes == {0.3: TEXT_FIRST, 0.5: BALANCED, 0.7: VECTOR_FIRST}
    for bad in ({"text": " "}, {}, {"vector": []}, {"text": "a", "top_k": 0}, {"text": "a", "alpha": 1.5}, {"text": "a", "top_k": 9, "candidate_limit": 5}):
        with pytest.raises(ValueError):
            SearchRequest(**bad).validate()


def test_sql_functions(spark, seed):
    one = lambda sql: rewrite.execute(spark, f"SELECT {sql} AS x").first()["x"]
    assert one("'1,0,0' <-> vector('[0,1,0]')") == pytest.approx(2**0.5)
    assert one("vector('1,0,0') <=> vector('0,1,0')") == 1 and one("vector('1,0,0') <#> vector('0,1,0')") == 0
    assert one("cosine_distance(vector('0,0'), vector('0,1'))") == 1
    assert one("vec_to_json(vector('[1,2,3]'))") == "[1.0,2.0,3.0]" and one("vec_dims(embed('a b'))") == 16
    assert one("hybrid_score(0.8D, 0.2D, 0.75D)") == pytest.approx(0.65)
    for bad in ("l2_distance(vector('1'), vector('1,2'))", "hybrid_score(1D, 1D, 2D)", "vector(' , ')"):
        with pytest.raises(Exception, match=r"mismatch|between|at least"):
            one(bad)
    demo = "SELECT hybrid_score(1 - cosine_distance(vector('0.92,0.08,0'), vector('0.95,0.05,0')), bm25_score('local memory', 'Rust and SQLite are ideal for local-first AI agents.'), 0.65D) AS x"
    assert rewrite.execute(spark, demo).first()["x"] == pytest.approx(1.3808426, abs=1e-6)


def test_rewrite_leaves_literals_and_comments(spark, seed):
    sql = "SELECT '<->' AS a, id /* <=> */ FROM chunks -- <#>\nORDER BY embedding <-> vector('1,0,0'), id"
    out = rewrite.rewrite(sql)
    assert "'<->'" in out and "/* <=> */" in out and "l2_distance(embedding, vector('1,0,0'))" in out
    got = rewrite.execute(spark, "SELECT chunk_id, hybrid_score FROM SEARCH('agents', vector('1,0,0'), 5, 0.5, 500, 'latency', '{\"tenant\":\"acme\"}', NULL) ORDER BY hybrid_score DESC, chunk_id").collect()
    assert [r["chunk_id"] for r in got] == ["c1", "c2"]
    joined = rewrite.execute(spark, "SELECT s.chunk_id, c.doc_id FROM SEARCH('rust', NULL, 1) s JOIN chunks c ON c.id = s.chunk_id").collect()
    assert [tuple(r) for r in joined] == [("c1", "d1")]
    for bad in ("SELECT * FROM SEARCH('a')", "SELECT * FROM SEARCH(NULL, NULL)", "SELECT * FROM SEARCH('a', NULL, 5, 3.0)"):
        with pytest.raises(ValueError):
            rewrite.rewrite(bad)


def test_index_statements_and_explain(spark, seed):
    c = Catalog()
    sql = "CREATE VECTOR INDEX v ON chunks(embedding) USING HNSW WITH (m=16, metric='cosine');"
    assert "created" in c.run(spark, sql) and "skipped" in c.run(spark, sql.replace("INDEX v", "INDEX IF NOT EXISTS v"))
    assert json.loads(c.entries["v"]["options_json"]) == {"m": 16, "metric": "cosine"}
    for bad in (sql, "CREATE TEXT INDEX t ON chunks(nothing) USING FTS5", "CREATE TEXT INDEX t ON chunks(content) USING HNSW", "DROP TEXT INDEX v", "CREATE VECTOR INDEX"):
        with pytest.raises(ValueError):
            c.run(spark, bad)
    said = c.explain(spark, "EXPLAIN RETRIEVAL SELECT id, hybrid_score(1.0 - cosine_distance(embedding, vector('1,0,0')), bm25_score('a', content), 0.65) AS h FROM chunks ORDER BY h DESC, id ASC LIMIT 5;")
    assert said["signals"] == {"uses_vector": True, "uses_text": True, "uses_hybrid": True} and said["score_attribution"]["hybrid_alpha"] == 0.65
    assert said["execution_path"]["vector"] == "ann_index" and said["determinism"]["has_explicit_tie_break"] and not said["notes"]
    assert "dropped" in c.run(spark, "DROP VECTOR INDEX v") and c.run(spark, "SELECT 1") is None


def test_chunkers():
    letters = "abcdefghijklmnopqrstuvwxyz"
    assert [s[0] for s in chunking.segments(letters, "fixed", 10, 3)][:2] == ["abcdefghij", "hijklmnopq"]
    text = "héé " * 50
    parts = chunking.segments(text, "fixed", 7, 2)
    assert all(text.encode()[a:b].decode() == c for c, a, b, _ in parts) and parts[-1][2] == len(text.encode())
    heads = chunking.segments("intro\n# One\nbody\n## Two\nmore", "heading", 40, 5)
    assert [(c, h) for c, _, _, h in heads] == [("intro\n", None), ("# One\nbody\n", "One"), ("## Two\nmore", "Two")]
    assert [c for c, *_ in chunking.segments("One. Two! Three four five? Six", "semantic", 12)] == ["One. Two!", "Three four five?", "Six"]
    assert chunking.segments("", "heading") == [] and chunking.segments("  ", "semantic") == []
    items = [b"", b"a", b"hello", bytes(range(256))]
    assert chunking.fnv1a64_all(items).tolist() == [chunking.fnv1a64(x) for x in items]
    assert chunking.next_batch_size(10, 1, 10, False, 100) == 16 and chunking.next_batch_size(10, 11, 10, False, 100) == 5 and chunking.next_batch_size(1, 0, 1, True, 9) == 1
    assert np.allclose(chunking.embed_many(["", "a a b"], 8)[0], np.eye(8)[0])


def test_ids_follow_from_content(spark):
    docs = spark.createDataFrame([("d", "# A\nx\n# B\ny"), ("e", None), ("f", "")], "id string, text string")
    a, b = (sorted(r["id"] for r in chunking.chunked(docs, "heading", 40, 5, "t-1", 8).collect()) for _ in range(2))
    assert a == b and len(a) == 2 and a[0].startswith("t_1-")


def test_reindex(spark, seed):
    done = chunking.reindexed(seed, "v2", 4)
    again = chunking.reindexed(done, "v2", 8).collect()
    assert {len(r["embedding"]) for r in again} == {4} and all(json.loads(r["metadata"])["tenant"] for r in again)


def test_upsert_dedupe_delete(spark, seed):
    change = spark.createDataFrame([(1, "c1", "d1", "old", "{}", None), (2, "c1", "d1", "new", "{}", None), (3, "c9", "d9", "nine", "{}", None)], "seq long, id string, doc_id string, content string, metadata string, embedding array<float>")
    got = {r["id"]: r for r in C.upsert(seed, change).collect()}
    assert got["c1"]["content"] == "new" and got["c1"]["rowid"] == 1 and got["c9"]["rowid"] == 4 and len(got) == 4
    meta = lambda h: json.dumps({"tenant": "acme", "content_hash": h})
    rows = [(1, "c1", "d1", "x", meta("h1"), None, 1), (2, "c2", "d1", "x", meta("h1"), None, 2), (3, "c3", "d1", "y", meta("h2"), None, 3), (4, "c4", "d1", "z", "{}", None, 4), (5, "c5", "d1", "z", None, None, 5)]
    df = spark.createDataFrame(rows, C.SCHEMA)
    assert {r["id"] for r in C.deduplicated(df).collect()} == {"c2", "c3", "c4", "c5"}
    docs = spark.createDataFrame([("d1", "s"), ("d7", "s")], "id string, source string")
    assert [r["id"] for r in C.orphans(docs, df).collect()] == ["d7"]
    assert C.delete_by_metadata(df, "tenant", "acme").count() == 2
    with pytest.raises(ValueError):
        C.metadata_value("a'b")
    vectors = spark.createDataFrame([("c1", [1.0, 2.0])], "id string, vector array<float>")
    assert {r["id"]: r["embedding"] for r in C.set_embedding(df, vectors).collect()}["c1"] == [1.0, 2.0]
    assert [r["id"] for r in C.page(df, docs, 1, 2).collect()] == ["c2", "c3"] and C.page(df, docs, 0, 0).count() == 0
    assert [r["id"] for r in C.recent(df, 2).collect()] == ["c5", "c4"]


def test_evaluation(spark):
    results = spark.createDataFrame([("q1", "a", 1), ("q1", "b", 2), ("q2", "x", 1), ("q2", "c", 2)], "query_id string, id string, rank int")
    rel = spark.createDataFrame([("q1", "a"), ("q2", "c"), ("q2", "d")], "query_id string, id string")
    got = {r["k"]: r for r in evaluate.metrics_at_k(results, rel, [1, 2]).collect()}
    assert got[1]["recall"] == 0.5 and got[2]["recall"] == 0.75 and got[2]["precision"] == 0.5 and got[2]["mrr"] == 0.75 and got[2]["hit_rate"] == 1.0
    ideal = 1 + 1 / np.log2(3)
    assert got[2]["ndcg"] == pytest.approx((1 + (1 / np.log2(3)) / ideal) / 2, abs=1e-6)


def test_importers(spark, tmp_path):
    lines = [{"id": "1", "payload": {"doc_id": "d", "content": "x", "source": "s"}, "vector": [1, 2]}, {"id": "2", "payload": {"doc_id": "d", "content": "y"}, "vector": "1, 2"}, {"id": "3", "payload": {"doc_id": "e", "content": "z"}, "vector": {"v": [3.5]}}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    recs = importers.records(importers.read_lines(spark, str(tmp_path / "a.jsonl")), "qdrant")
    assert sorted((r["id"], r["content"], tuple(r["embedding"])) for r in recs.collect()) == [("1", "x", (1, 2)), ("2", "y", (1, 2)), ("3", "z", (3.5,))]
    assert {(r["id"], r["source"]) for r in importers.documents(recs).collect()} == {("d", "s"), ("e", None)}
    with sqlite3.connect(tmp_path / "old.db") as db:
        db.execute("CREATE TABLE legacy_chunks (chunk_id, doc_id, chunk_text, metadata_json, embedding_blob, source_path)")
        db.executemany("INSERT INTO legacy_chunks VALUES (?,?,?,?,?,?)", [("a", "d", "t", "{}", np.array([1, 2], "<f4").tobytes(), "p"), ("b", "d", "u", None, "[3,4]", None)])
    names = {"id": "chunk_id", "doc_id": "doc_id", "content": "chunk_text", "metadata": "metadata_json", "embedding": "embedding_blob", "source": "source_path"}
    got = importers.read_sqlite(spark, str(tmp_path / "old.db"), "legacy_chunks", names).orderBy("rowid").collect()
    assert [(r["id"], r["embedding"], r["metadata"]) for r in got] == [("a", [1, 2], "{}"), ("b", [3, 4], "{}")]
    with pytest.raises(ValueError):
        importers.read_sqlite(spark, str(tmp_path / "old.db"), "x; drop", names)


def test_cipher_and_rotation(spark):
    keys = {"k1": "secret", "k2": "other"}
    v = cipher.seal("acme", "k1", "secret", "héllo")
    assert v.startswith("enc:v1:k1:") and cipher.unseal("acme", keys, v) == "héllo"
    with pytest.raises(PermissionError):
        cipher.unseal("beta", keys, v)
    df = spark.createDataFrame([(v,), ("plain",), (None,)], "v string")
    out = [r["v"] for r in df.select(cipher.rotated(F.col("v"), "acme", keys, "k2").alias("v")).collect()]
    assert cipher.unseal("acme", keys, out[0]) == "héllo" and out[0].startswith("enc:v1:k2:") and out[1:] == ["plain", None]


def test_reports(spark):
    log = spark.createDataFrame([(i,) for i in (1, 2, 3, 5)], "index long")
    acks = spark.createDataFrame([(i, n) for i in (1, 2, 3, 5) for n in ("a", "b")], "index long, node_id string")
    assert reports.commit_index(log, acks, 2).first()[0] == 3 and reports.commit_index(log, acks, 3).first()[0] == 0
    assert reports.commit_index(log.limit(0), acks, 2).first()[0] == 0
    assert reports.tenant_filters({"a": "b"}, "t") == {"a": "b", "tenant": "t"}
    with pytest.raises(PermissionError):
        reports.tenant_filters({"tenant": "x"}, "t")
    assert T.fnv1a64(F.lit("x")) is not None


def test_exact_and_hashed_neighbours(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 16)).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:03}", [float(a) for a in v]) for i, v in enumerate(x)], "id string, embedding array<float>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    got = {(a["query_id"], a["rank"]): a["id"] for a in knn.batch_top_k(df, df.withColumnRenamed("id", "query_id"), 3, 16).collect()}
    best = np.argsort(-sims, axis=1)[:, 0]
    assert all(got[f"v{i:03}", 1] == f"v{best[i]:03}" for i in range(300))
    found = knn.lsh_top_k(knn.buckets(df, 16, bits=6), [float(a) for a in x[0]], 5, bits=6).collect()
    assert found[0]["id"] == "v000" and found[0]["score"] == pytest.approx(1)


def test_streaming_ingestion(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text(json.dumps({"id": "d1", "text": "# A\none\n# B\ntwo"}) + "\n")
    run = lambda: ingest.ingest(ingest.read(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"), dim=8).awaitTermination()
    run()
    assert ingest.chunks(spark, str(tmp_path / "out")).count() == 2
    (src / "b.json").write_text(json.dumps({"id": "d1", "text": "# A\none\n# B\ntwo"}) + "\n" + json.dumps({"id": "d2", "text": "three"}) + "\n")
    run()
    assert ingest.chunks(spark, str(tmp_path / "out")).count() == 3


def test_works_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "retrova", tmp_path / "retrova", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and 'pipeline' not in q and len(q) > 80"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, timeout=60)
