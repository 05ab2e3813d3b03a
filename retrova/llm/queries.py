"""Queries over the whole tables for the operators of this subpackage, with DuckDB SQL where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licence_scan as licence
from . import stages
from .jobs import table
from .line_dedup import repeated_units
from .mcd_rules import robust_distances, within
from .merge_dropout import encode_documents
from .mixing import mixed
from .ngram_join import jaccard_links
from .phrases import fingerprints
from .quality_bayes import classify, train_on
from .suffix_dedup import repeated_spans
from .url_filter import url_scores
from .url_terms import SOFT, STRICT

WORDS = "list_filter(string_split_regex(text, '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')"


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"), length=50, k=8).drop("text_hash")


def op2_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, each with its evidence and posterior.

    The documents have no URL: host is the column source, and path is lang, one of four languages rather than a path of a site.
    """
    docs = table(spark, sf_dir, "documents")
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    model = train_on(docs, table(spark, sf_dir, "labels"), good, max_train=4000)
    kept = classify(docs.select("doc_id", "text", "source", "lang"), model).where("_quality >= 0.6 and text is not null")
    return kept.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), F.col("_evidence").alias("evidence"), F.col("_host_rate").alias("host_rate"), F.col("_path_rate").alias("path_rate"), F.col("_quality").alias("quality"))


def op3_mcd_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that are kept, each with its group's level and its distance."""
    return within(robust_distances(table(spark, sf_dir, "documents"), h=0.75, steps=4, least=200)).select("doc_id", "lang", "source", "level", "distance")


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licence.licence_scan(docs, licence.train_on(docs, max_background=2000, per_document=8), confirm=0.6)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that is like another one, with its class and its number of links."""
    return jaccard_links(table(spark, sf_dir, "documents"), n=3, threshold=(1, 2))


OP6_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM d WHERE len(w) > 0),
h AS MATERIALIZED (SELECT s, min(doc_id) AS head, count(*) AS m, len(s) AS size, row_number() OVER (ORDER BY min(doc_id), s) AS k FROM g GROUP BY s),
e AS MATERIALIZED (SELECT k, size, m, unnest(s) AS x FROM h),
p AS MATERIALIZED (SELECT a.k AS a, b.k AS b, a.m AS m_a, b.m AS m_b FROM e a JOIN e b ON a.x = b.x AND a.k < b.k
      GROUP BY a.k, b.k, a.m, b.m, a.size, b.size HAVING 3 * count(*) >= a.size + b.size),
q AS MATERIALIZED (SELECT a, b, m_b AS m FROM p UNION ALL SELECT b, a, m_a FROM p),
reach AS (SELECT k, k AS r FROM h UNION SELECT reach.k, q.b FROM reach JOIN q ON q.a = reach.r),
c AS (SELECT reach.k, min(o.head) AS class_id FROM reach JOIN h o ON o.k = reach.r GROUP BY reach.k),
n AS (SELECT a AS k, sum(m) AS n FROM q GROUP BY a)
SELECT g.doc_id, c.class_id, (coalesce(n.n, 0) + h.m - 1)::BIGINT AS n_links
FROM g JOIN h USING (s) JOIN c ON c.k = h.k LEFT JOIN n ON n.k = h.k WHERE coalesce(n.n, 0) + h.m > 1
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences to remove. A passage of 50 words that begins and ends within sentences still has some 25 words of whole ones."""
    return repeated_units(table(spark, sf_dir, "documents"), unit="sentence", min_words=25)


OP9_SQL = r"""
WITH s AS (SELECT doc_id, string_split(replace(regexp_replace(text, '([.!?])([ \t\r\v\f])', '\1' || chr(1) || '\2', 'g'), chr(10), chr(10) || chr(1)), chr(1)) AS u
      FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT doc_id, unnest(u) AS part, unnest(range(len(u))) AS unit_no FROM s),
o AS (SELECT doc_id, unit_no, length(rtrim(part, chr(10))) AS n_chars, trim(regexp_replace(lower(part), '[ \t\n\v\f\r]+', ' ', 'g')) AS norm,
        coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY unit_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM p),
w AS (SELECT *, len(string_split(norm, ' ')) AS n_words, row_number() OVER (PARTITION BY doc_id ORDER BY unit_no) AS seq FROM o WHERE norm <> ''),
f AS (SELECT norm, min((doc_id, unit_no)) AS first, count(*) AS copies FROM w GROUP BY norm HAVING count(*) > 1),
g AS (SELECT *, seq - row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS run FROM w JOIN f USING (norm) WHERE (doc_id, unit_no) <> first),
r AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id, run) AS words FROM g)
SELECT doc_id, unit_no, start, n_chars, first[1] AS first_doc_id, first[2] AS first_unit_no, copies FROM r WHERE words >= 25
"""

def op10_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"), depth=5)


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), dropout=0.1, seed=17)


def op7_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the mix and how often each comes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    chosen = mixed(docs, stages.sources(), stages.WEIGHTS, epochs=stages.EPOCHS, seed=17)
    return chosen.select("doc_id", F.col("_pattern").alias("pattern"), F.col("_tokens").alias("n_words"), F.col("_copies").alias("copies"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_scores(table(spark, sf_dir, "pages"), STRICT, SOFT, soft_limit=3, weight_limit=3.0)


def _op5_sql() -> str:
    """A regular expression for each term; the other side of the boundary check is a lookahead that RE2 lacks, so hits are counted on doubled separators."""
    rows = ", ".join([*(f"('{t}', TRUE, 0.0)" for t in sorted(STRICT)), *(f"('{t}', FALSE, {w})" for t, w in sorted(SOFT.items()))])
    return f"""
WITH v(term, strict, weight) AS (VALUES {rows}),
u AS (SELECT row_number() OVER () AS r, page_id, url, regexp_replace(regexp_replace(lower(coalesce(url, '')), '%[0-9a-f]{{2}}', '%', 'g'), '([^a-z0-9])', '\\1\\1', 'g') AS x FROM pages),
h AS (SELECT r, strict, weight, len(regexp_extract_all(x, '(^|[^a-z0-9])' || replace(replace(term, '-', '--'), '_', '__') || '([^a-z0-9]|$)')) AS n FROM u, v),
s AS (SELECT r, sum(CASE WHEN strict THEN n ELSE 0 END)::BIGINT AS n_strict, count(*) FILTER (NOT strict AND n > 0) AS n_soft,
        coalesce(sum(weight) FILTER (NOT strict AND n > 0), 0)::DOUBLE AS weight FROM h GROUP BY r)
SELECT page_id, url, n_strict, n_soft, weight, n_strict > 0 OR n_soft >= 3 OR weight >= 3.0 AS rejected FROM u JOIN s USING (r)
"""


QUERIES = {
    "op1_suffix_array_dedup": op1_suffix_array_dedup,
    "op2_quality_bayes": op2_quality_bayes,
    "op3_mcd_rules": op3_mcd_rules,
    "op4_merge_dropout": op4_merge_dropout,
    "op5_url_filter": op5_url_filter,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_flow_mixing": op7_flow_mixing,
    "op8_licence_scan": op8_licence_scan,
    "op9_line_dedup": op9_line_dedup,
    "op10_phrase_fingerprints": op10_phrase_fingerprints,
}
SQL = {"op5_url_filter": _op5_sql(), "op9_line_dedup": OP9_SQL, "op6_ngram_jaccard": OP6_SQL}
