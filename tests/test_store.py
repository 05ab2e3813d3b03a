"""The store, its tools, ingestion, evaluation runs, batch searches, and the synthetic corpus."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from retrova.operators import chunks as C
from retrova.operators import knn, lexical, reports
from retrova.plans import evaluation
from retrova.plans.request import SearchRequest
from retrova.plans.search import search, search_batch
from retrova.sources import ingestion, synthetic
from retrova.store import Store, Tools, manifest

ROWS = [
    ("c1", "d1", "Rust powers AI agents with safe systems code.", '{"tenant":"acme","content_hash":"h1"}', [1.0, 0.0, 0.0], "s1"),
    ("c2", "d2", "PostgreSQL handles relational workloads at scale.", '{"tenant":"acme","content_hash":"h2"}', [0.0, 1.0, 0.0], "s2"),
    ("c3", "d1", "SQLite is excellent for local-first RAG memory.", '{"tenant":"beta","content_hash":"h3"}', [0.8, 0.2, 0.0], None),
]
SCHEMA = "id string, doc_id string, content string, metadata string, embedding array<float>, source string"


def ids(df):
    return [r["chunk_id"] for r in df.collect()]


def test_store_changes_and_compaction(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    assert s.chunks().count() == 0 and s.health()["integrity_check_ok"]
    assert s.ingest(spark.createDataFrame(ROWS, SCHEMA).coalesce(1)) == 3
    first = {r["id"]: r["rowid"] for r in s.chunks().collect()}
    assert sorted(first, key=first.get) == ["c1", "c2", "c3"]
    assert s.ingest(spark.createDataFrame([("c1", "d1", "new words", "{}"), ("c9", "d9", "nine", '{"content_hash":"h9"}'), ("c8", "d9", "eight", '{"content_hash":"h9"}')], "id string, doc_id string, content string, metadata string").coalesce(1)) == 3
    now = {r["id"]: r for r in s.chunks().collect()}
    assert now["c1"]["content"] == "new words" and now["c1"]["rowid"] == first["c1"] and now["c9"]["rowid"] > first["c3"] and now["c9"]["embedding"] is None
    assert [r["id"] for r in s.lookup(["c9", "nope", "c1"]).collect()] == ["c9", "c1"]
    assert ids(s.search(SearchRequest(text="rag memory", top_k=1))) == ["c3"]
    assert s.delete_by_metadata("tenant", "beta") == 1 and s.delete_by_metadata("tenant", "nobody") == 0
    assert s.delete_document("d2") == 1 and {r["id"] for r in s.documents().collect()} == {"d1", "d9"}
    said = s.compact()
    assert said["rows_after"] == 2 and said["deduplicated"] == 1 and {r["id"] for r in s.chunks().collect()} == {"c1", "c8"}
    again = Store.open(spark, str(tmp_path / "s"))
    assert again.chunks().count() == 2 and again.health() == {"schema_version": 1, "chunk_count": 2, "document_count": 2, "vector_count": 0, "vector_bytes": 0, "segments": 1, "integrity_check_ok": True}
    with pytest.raises(Exception, match="id is empty"):
        again.ingest(spark.createDataFrame([(" ", "d", "x")], "id string, doc_id string, content string"))
    assert again.chunks().count() == 2


def test_tools(spark, tmp_path):
    tools = Tools(Store.open(spark, str(tmp_path / "s")))
    put = {"tool": "ingest", "chunks": [{"id": r[0], "doc_id": r[1], "content": r[2], "metadata": json.loads(r[3]), "embedding": r[4], "source": r[5]} for r in ROWS]}
    assert json.loads(tools.call_json(json.dumps(put)))["payload"] == {"ingested": 3, "chunk_count": 3}
    found = tools.call("search", {"query_text": "agents", "query_embedding": [1.0, 0, 0], "top_k": 2, "metadata_filters": {"tenant": "acme"}})
    assert found["status"] == "ok" and [r["chunk_id"] for r in found["payload"]] == ["c1", "c2"] and found["payload"][0]["metadata"]["tenant"] == "acme"
    assert tools.call("health", {})["payload"]["chunk_count"] == 3
    assert tools.call("delete_by_metadata", {"key": "tenant", "value": "acme"})["payload"] == {"deleted": 2}
    assert tools.call("nothing", {})["message"] == "unknown tool `nothing`" and tools.call("search", {"top_k": 3})["status"] == "error"
    assert "invalid request json" in json.loads(tools.call_json("{"))["message"] and [t["name"] for t in manifest()] == ["search", "ingest", "health", "delete_by_metadata"]


def test_ingestion_retries_and_reports(spark, tmp_path):
    s = Store.open(spark, str(tmp_path / "s"))
    docs = spark.createDataFrame([("a", "# One\nbody of one\n# Two\nmore"), ("b", "bad luck"), ("c", None)], "id string, text string")

    def provider(texts):
        return [ValueError(t) if "bad" in t else [float(len(t)), 1.0] for t in texts]

    retry = ingestion.Retry(2, 1, 2)
    with pytest.raises(RuntimeError, match="1 chunks"):
        ingestion.ingest(s, docs, "t", provider, size=40, overlap=5, retry=retry)
    assert s.chunks().count() == 2
    said = ingestion.ingest(s, docs, "t", lambda texts: [[1.0, 2.0] for _ in texts], size=40, overlap=5)
    assert (said["total_chunks"], said["processed_chunks"], said["failed_chunks"], said["resumed_from_chunk"]) == (3, 1, 0, 2)
    meta = [json.loads(r["metadata"]) for r in s.chunks().collect()]
    assert {m["tenant"] for m in meta} == {"t"} and all(m["content_hash"] for m in meta)
    with pytest.raises(ValueError):
        ingestion.ingest(s, docs, " ")
    calls, waits = [], []

    def flaky(texts):
        calls.append(list(texts))
        return [ValueError("x") if t == "b" and len(calls) < 3 else [1.0] for t in texts]

    assert ingestion.embed_with_retry(["a", "b"], flaky, ingestion.Retry(3, 10, 15), waits.append) == [[1.0], [1.0]]
    assert calls == [["a", "b"], ["b"], ["b"]] and waits == [0.01, 0.015]
    with pytest.raises(ValueError):
        ingestion.embed_with_retry(["a", "b"], lambda t: [[1.0]], retry)
    (tmp_path / "f.md").write_text("from a file")
    assert ingestion.load(file=str(tmp_path / "f.md"))[1] == "from a file" and ingestion.load(direct="x") == ("direct", "x")
    assert ingestion.load(url=(tmp_path / "f.md").as_uri())[1] == "from a file" and ingestion.load_files(spark, str(tmp_path / "f.md")).first()["text"] == "from a file"
    with pytest.raises(ValueError):
        ingestion.load()


def seeded(spark):
    return spark.createDataFrame([(i + 1, *r[:5], i + 1) for i, r in enumerate(ROWS)], "rowid long, id string, doc_id string, content string, metadata string, embedding array<float>, created_at long").select(*C.COLUMNS)


@pytest.mark.parametrize("alpha,vector,text,limit,rrf", [(0.3, True, True, 6, None), (0.5, True, True, 600, None), (0.7, True, True, 6, 30.0), (0.65, False, True, 6, None)])
def test_batch_search_is_search_of_each(spark, tmp_path, alpha, vector, text, limit, rrf):
    chunks = synthetic.corpus(spark, 60, 8, 3).where("rowid % 7 <> 5").unionByName(spark.createDataFrame([(100, "x1", "d", "local relay snow", "{}", None, 3), (101, "x2", "d", "", "{}", [0.0] * 8, 200)], "rowid long, id string, doc_id string, content string, metadata string, embedding array<float>, created_at long")).cache()
    index = lexical.TextIndex.create(chunks, str(tmp_path / "i"))
    asked = synthetic.queries(spark, 2, 60, 8).drop("target").unionByName(spark.createDataFrame([("none", "zzz nowhere", [0.0] * 8)], "query_id string, text string, embedding array<float>"))
    shape = SearchRequest(text="x" if text else None, vector=[0.0] * 8 if vector else None, top_k=5, alpha=alpha, candidate_limit=limit, rrf_constant=rrf)
    got = {}
    for r in search_batch(chunks, asked, shape, index).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], r["vector_score"], r["text_score"], r["hybrid_score"]))
    for q in asked.collect():
        one = SearchRequest(text=q["text"] if text else None, vector=list(q["embedding"]) if vector else None, top_k=5, alpha=alpha, candidate_limit=limit, rrf_constant=rrf)
        want = [(r["chunk_id"], r["vector_score"], r["text_score"], r["hybrid_score"]) for r in search(chunks, one, index).collect()]
        assert got.get(q["query_id"], []) == want, q["query_id"]
    if alpha == 0.3:
        assert ids(search(chunks, one)) == [r[0] for r in want]


def test_evaluation_run(spark):
    q = [evaluation.Query("q1", ["c1"], text="agents", vector=[1.0, 0, 0]), evaluation.Query("q2", ["c2", "c3"], vector=[0.0, 1.0, 0.0]), evaluation.Query("q3", ["c9"], text="rag", filters={"tenant": "acme"})]
    metrics, found = evaluation.run(seeded(spark), q, [3, 1, 3, 0])
    assert {r["query_id"]: r["id"] for r in found.where("rank = 1").collect()}.items() >= {"q1": "c1", "q2": "c2"}.items()
    got = {r["k"]: r for r in metrics.collect()}
    assert sorted(got) == [1, 3] and got[1]["recall"] == pytest.approx((1 + 0.5) / 3, abs=1e-6) and got[3]["recall"] == pytest.approx(2 / 3, abs=1e-6)
    for bad in ([], [evaluation.Query("a", ["x"])], [evaluation.Query("a", [], text="t")], [evaluation.Query("a", ["x"], text="t", alpha=2)]):
        with pytest.raises(ValueError):
            evaluation.run(seeded(spark), bad)
    with pytest.raises(ValueError):
        evaluation.cutoffs([0])


def test_synthetic_corpus_and_benchmark(spark):
    rows = synthetic.corpus(spark, 20, 8, 2).orderBy("rowid").collect()
    assert rows[7]["id"] == "chunk-00000007" and rows[7]["doc_id"] == "doc-000001" and json.loads(rows[7]["metadata"]) == {"tenant": "bench-01", "topic": "topic_7"}
    assert all(abs(np.linalg.norm(r["embedding"]) - 1) < 1e-5 and int(np.argmax(r["embedding"])) == i % 8 for i, r in enumerate(rows))
    said = synthetic.benchmark(spark, 60, 5, 8)
    assert said["vector_recall"] == 1.0 and said["queries_per_s"] > 0 and 0 <= said["top1_hit_rate"] <= 1


def test_signature_index(spark, tmp_path):
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 16)).astype(np.float32)
    df = spark.createDataFrame([(f"v{i:04}", [float(a) for a in v]) for i, v in enumerate(x)], "id string, embedding array<float>")
    index = knn.SignatureIndex.create(df, str(tmp_path), 16, 256)
    q = df.where("id < 'v0040'").withColumnRenamed("id", "query_id")
    exact = {(a["query_id"], a["id"]) for a in knn.batch_top_k(df, q, 10, 16).collect()}
    found = index.batch(q, 10).collect()
    assert len({(a["query_id"], a["id"]) for a in found} & exact) >= 0.9 * len(exact) and all(a["scored"] <= 0.13 * 3000 for a in found)
    one = index.top_k([float(a) for a in x[5]], 3).collect()
    assert one[0]["id"] == "v0005" and one[0]["score"] == pytest.approx(1)
    assert index.top_k([float(a) for a in x[5]], 3, exact_below=5000).count() == 3
    assert knn.batch_top_k(df.limit(0), q, 3, 16).count() == 0 and knn.batch_top_k(df, q.limit(0), 3, 16).count() == 0


def test_roles_audit_and_pruning(spark, tmp_path):
    ask = lambda roles, own, tenant, op: reports.allowed(spark.createDataFrame([(roles, own, tenant, op)], "actor_roles array<string>, actor_tenant string, tenant string, operation string")).first()["allowed"]
    assert ask(["reader"], "a", "a", "query") and not ask(["reader"], "a", "a", "ingest") and not ask(["writer"], "a", "a", "delete_tenant") and ask(["tenant_admin"], "a", "a", "delete_tenant")
    assert ask(["admin"], "a", "b", "sql_admin") and not ask(["tenant_admin"], "a", "b", "query") and not ask([], "a", "a", "query")
    with pytest.raises(Exception, match="tenant id is empty"):
        ask(["admin"], "a", " ", "query")
    events = spark.createDataFrame([(5, "x", "t", "query", True, '{"secret":"s","n":"1"}'), (4, "y", "t", "ingest", False, "{}")], reports.AUDIT_SCHEMA)
    reports.audit_write(events, str(tmp_path / "log"), ["secret"])
    got = reports.audit(reports.audit_read(spark, str(tmp_path / "log")), operation="query").collect()
    assert len(got) == 1 and json.loads(got[0]["detail"]) == {"secret": "[REDACTED]", "n": "1"}
    assert reports.audit_export(reports.audit(events, allowed=False), str(tmp_path / "out")) == 1
    snaps = spark.createDataFrame([("a", 10, True), ("b", 90, False), ("c", 90, True), ("d", 20, False)], "snapshot_id string, created_ms long, present boolean")
    assert {r["snapshot_id"] for r in reports.prunable(snaps, 100, 5).collect()} == {"a", "c"}
    quiet = reports.request_metrics(spark.createDataFrame([], "path string, status int, duration_ms double"))
    assert reports.service_levels(quiet).first().asDict()["availability"] == 100.0
    log = spark.createDataFrame([("/v1/sql", 500, 10.0), ("/health", 200, 900.0), ("/v1/query?x=1", 200, 20.0)], "path string, status int, duration_ms double")
    said = reports.service_levels(reports.request_metrics(log), lag_ms=2001).first().asDict()
    assert said["sql_error_rate"] == 0.5 and said["alert_sql_errors"] and not said["alert_sql_latency"] and said["alert_lag"] and not said["alert_restore"] and F is not None
