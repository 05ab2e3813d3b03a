"""Steps that once grew faster than their input."""

from __future__ import annotations

import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from retrova import queries
from retrova.functions import text as T
from retrova.operators import chunks as C
from retrova.operators import knn, lexical
from retrova.plans import evaluation
from retrova.plans.request import SearchRequest
from retrova.plans.search import search


def test_hash_takes_time_by_the_byte(spark):
    """Each byte cut the text's hex digits anew, so that one of 100 KB took minutes."""
    texts = ["", "a", "é" * 50_000, None, *("word " * (i % 9) for i in range(100))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    began = time.time()
    got = {r["i"]: r["h"] for r in df.select("i", T.fnv1a64(F.col("text")).alias("h")).collect()}
    assert time.time() - began < 30
    assert got == {i: None if x is None else f"{T.fnv1a64_bytes(x.encode()):016x}" for i, x in enumerate(texts)}
    assert got[0] == "cbf29ce484222325" and got[1] == "af63dc4c8601ec8c"


def test_evaluation_never_lists_pairs(spark, sf_dir, monkeypatch):
    """Each query had all ids of its label as a list, made in the driver: a twentieth of all vectors times a tenth of them."""

    def refuse(*args, **kwargs):
        raise AssertionError("relevant ids in the driver")

    monkeypatch.setattr(evaluation, "run", refuse)
    assert queries.eval_run(spark, sf_dir).count() == 3


def test_evaluation_by_groups_is_that_by_lists(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, f"c{i}", "d", "", "{}", [float(a) for a in x[i]], i) for i in range(60)]
    chunks = spark.createDataFrame(rows, "rowid long, id string, doc_id string, content string, metadata string, embedding array<float>, created_at long")
    group = {f"c{i}": i % 7 for i in range(60)}
    asked = spark.createDataFrame([(f"c{i}", i % 7, rows[i][5]) for i in range(0, 60, 5)], "query_id string, group int, embedding array<float>")
    got = evaluation.run_groups(chunks, asked, spark.createDataFrame([(g, i) for i, g in group.items()], "group int, id string"), SearchRequest(vector=[0.0] * 8), [1, 4])[0]
    lists = [evaluation.Query(f"c{i}", [c for c, g in group.items() if g == i % 7], vector=rows[i][5]) for i in range(0, 60, 5)]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, evaluation.run(chunks, lists, [1, 4])[0].collect()))


def test_batch_search_shuffles_by_task_not_by_tile(spark, monkeypatch):
    """k + 1 rows a query went into the shuffle for each tile of vectors, so that rows grew as their square."""
    monkeypatch.setattr(knn, "TILE", 50)
    monkeypatch.setattr(knn, "ROWS", 16)
    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(size=(380, 8)), np.zeros((10, 8)), np.ones((10, 8))]).astype(np.float32)
    x[100:140] = x[60:100]  # ties, which the least ids win
    df = spark.createDataFrame([(f"v{i}", [float(a) for a in v]) for i, v in enumerate(x)], "id string, embedding array<float>")
    pairs = knn._crossed(knn._tiled(df.coalesce(1), "id", 8), knn._tiled(df.coalesce(1), "id", 8)).toArrow().to_batches()
    assert sum(b.num_rows for b in knn._best(3, 8)(iter(pairs))) == 400 * 4
    norm = np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    unit = np.divide(x, norm, out=np.zeros(x.shape), where=norm > 0)
    s = np.round(unit @ unit.T, 6)
    want = {(f"v{i}", n + 1): f"v{j}" for i in range(400) for n, j in enumerate(sorted((j for j in range(400) if j != i), key=lambda j: (-s[i, j], f"v{j}"))[:3])}
    assert {(a["query_id"], a["rank"]): a["id"] for a in knn.batch_top_k(df, df.withColumnRenamed("id", "query_id"), 3, 8).collect()} == want


TEXTS = ["", "a b a", "B, c!", "zé z a", "a c c c", "  ", "b b b b", "q"] * 3


def _batches():
    ids = pa.array([f"d{i}" for i in range(len(TEXTS))] + ["none"])
    return iter([pa.record_batch({"id": ids, "text": pa.array([t.lower() for t in TEXTS] + [None], pa.string())})])


def test_postings_need_no_shuffle(spark, monkeypatch):
    """All postings were shuffled twice, by (term, id) and by ranges."""
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(TEXTS)] + [("none", None)], "id string, content string")
    made = lexical.postings(df)
    assert "Exchange" not in made._jdf.queryExecution().toString()
    words = [re.findall("[a-z0-9]+", t.lower()) for t in TEXTS]
    want = {(w, f"d{i}", n, len(own)) for i, own in enumerate(words) for w, n in Counter(own).items()}
    assert set(map(tuple, made.select("term", "id", "tf", "dl").collect())) == want
    monkeypatch.setattr(lexical, "PIECE", 8)
    parts = [b.to_pylist() for b in lexical._post(_batches())]
    assert len(parts) > 5 and {tuple(r.values()) for p in parts for r in p} == want
    assert all([(r["term"], r["id"]) for r in p] == sorted((r["term"], r["id"]) for r in p) for p in parts)


@pytest.mark.parametrize("k", [2, 100])
def test_batch_ranking_keeps_k_a_task(monkeypatch, k):
    """A row for each query and each text that shares a word with it went into a shuffle."""
    for name, x in (("PIECE", 40), ("QUERIES", 2), ("CELLS", 7)):
        monkeypatch.setattr(lexical, name, x)
    asked = {1: "ab", 2: "c", 3: "az", 4: "w"}
    idf = {"a": 0.5, "b": 1e-9, "c": 2.0, "z": 0.25, "w": 1.0}
    rows = pa.table({"query_id": [q for q, t in asked.items() for _ in t], "term": [w for t in asked.values() for w in t], "idf": [idf[w] for t in asked.values() for w in t]})
    got = {}
    for b in lexical._ranker(rows, 2.0, k)(_batches()):
        for r in b.to_pylist():
            got.setdefault(r["query_id"], []).append((r["id"], r["bm25"]))
    for q, terms in asked.items():
        every = []
        for i, t in enumerate(TEXTS):
            own = re.findall("[a-z0-9]+", t.lower())
            if set(own) & set(terms):
                every.append((f"d{i}", round(sum(idf[w] * own.count(w) * 2.2 / (own.count(w) + 1.2 * (0.25 + 0.75 * len(own) / 2.0)) for w in terms), 6)))
        assert got.get(q, []) == sorted(every, key=lambda x: (-x[1], x[0]))[:k]


def test_candidates_meet_postings_without_shuffling_them(spark, tmp_path, monkeypatch):
    """Candidates times their queries' terms were too many to broadcast, so that all postings were shuffled."""
    df = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(TEXTS)], "id string, content string")
    index = lexical.TextIndex.create(df, str(tmp_path))
    monkeypatch.setattr(lexical, "BROADCAST_ROWS", 40)
    asked = spark.createDataFrame([(q, "a b c") for q in "uv"], "query_id string, text string")
    pairs = spark.createDataFrame([(q, f"d{i}") for q in "uv" for i in range(20)], "query_id string, id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = index.scores(asked, pairs)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        every = {(r["query_id"], r["id"]): r["bm25"] for r in index.best(df, asked, 100).collect()}
        assert {(r["query_id"], r["id"]): r["bm25"] for r in found.collect()} == {x: s for x, s in every.items() if int(x[1][1:]) < 20}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_search_shows_content_below_the_join_with_vectors(spark, sf_dir):
    """All content went through the shuffle that joins chunks and vectors, for ten results."""
    shown = search(C.from_tables(spark, sf_dir), SearchRequest(vector=queries.VECTOR, top_k=3))
    plan = shown._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("LeftOuter") < plan.find("LeftSemi")
