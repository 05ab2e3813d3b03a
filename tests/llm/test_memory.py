"""What keeps the pipeline's executors within their memory: few Python workers, small temporary arrays."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark import SparkContext

from retrova.llm import merge_dropout, stages


@pytest.fixture
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_quality_scores_each_text_once(spark, sf_dir, docs):
    """A second evaluation of the classifier in a task takes a second Python worker, and the time again."""
    plan = stages.quality(spark, docs, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_mix_starts_no_python_workers(spark, sf_dir, docs, monkeypatch):
    want = stages.mix(spark, docs, sf_dir).count()

    def refuse(*_, **__):
        raise AssertionError("rows of Python are read by Python workers")

    monkeypatch.setattr(SparkContext, "parallelize", refuse)
    assert stages.mix(spark, docs, sf_dir).count() == want > docs.count()
    assert stages.mix(spark, docs.limit(0), sf_dir).count() == 0


def test_encoding_holds_small_arrays(sf_dir):
    """4 MB of text whose units are all there once, as then the arrays are largest."""
    rng = np.random.default_rng(5)
    words = rng.integers(97, 123, (600_000, 7), np.uint8)
    words[:, 6] = 32
    text = words.tobytes().decode()
    step = 10_500
    rows = [text[k : k + step] for k in range(0, len(text), step)]
    batch = pa.record_batch({"doc_id": pa.array(range(len(rows)), pa.int64()), "text": rows})
    path = merge_dropout.default_model()
    merge_dropout.vocabulary(path)
    tracemalloc.start()
    try:
        got = [b.column("lossless").to_pylist() for b in merge_dropout._encoded(path, 0.1, 17)(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    assert all(map(all, got)) and sum(map(len, got)) == len(rows)
    assert peak < 200, peak


def test_shrink_makes_executors_collect(spark):
    from retrova.llm.jobs import shrink

    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    runs = lambda: sum(b.getCollectionCount() for b in beans())
    before = runs()
    shrink(spark)
    assert runs() > before
