"""Each query of the catalogue against its SQL in DuckDB; those without SQL give rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from retrova import queries


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return round(float(v), 6) + 0.0 if isinstance(v, float) or hasattr(v, "as_tuple") else v


def rows_of(columns, rows):
    return sorted((tuple(norm(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, db, sf_dir, name):
    want = db.sql(queries.SQL[name])
    columns = sorted(want.columns)
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    named = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    assert rows_of(columns, got.collect()) == rows_of(columns, named)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_gives_rows(spark, sf_dir, name):
    assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_index_keeps_recall_and_scores_few(spark, sf_dir):
    rows = queries.ann_topk_recall(spark, sf_dir).collect()
    assert sum(r["recall"] for r in rows) / len(rows) >= 0.9 and max(r["scored_share"] for r in rows) < 0.2
