"""URL filters: a weighted vocabulary of strict and soft terms, found by Aho-Corasick with boundary checks.

One automaton finds all terms of a URL in one pass. A term counts where no ASCII
letter or digit is beside it; an escape (%2F, %20) is a separator. One strict term rejects the URL, and so do
`soft_limit` different soft terms, or soft terms whose weights, each counted once,
reach `weight_limit`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .url_terms import SOFT, STRICT

_ESCAPE = re.compile("%[0-9a-f]{2}")


@lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[tuple[str, float], ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, term in enumerate([*strict, *(t for t, _ in soft)]):
        a.add_word(term, (k, len(term)))
    if len(a):
        a.make_automaton()
    return a


def _word(c: str) -> bool:
    return c.isascii() and c.isalnum()


def hits(url: str, automaton) -> dict[int, int]:
    """How often each term, by its number, stands in the lower-case URL between boundaries."""
    out: dict[int, int] = {}
    if not len(automaton):
        return out
    n = len(url)
    for end, (k, size) in automaton.iter(url):
        begin = end - size + 1
        if (begin == 0 or not _word(url[begin - 1])) and (end + 1 == n or not _word(url[end + 1])):
            out[k] = out.get(k, 0) + 1
    return out


def _rows(strict: tuple[str, ...], soft: tuple[tuple[str, float], ...], soft_limit: int, weight_limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(strict, soft)
        weights = [w for _, w in soft]
        lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        for batch in batches:
            n_strict, n_soft, weight = [], [], []
            for url in batch.column(1).to_pylist():
                got = hits(_ESCAPE.sub("%", url.translate(lower)), automaton) if url else {}
                n_strict.append(sum(c for k, c in got.items() if k < len(strict)))
                soft_hits = sorted(k - len(strict) for k in got if k >= len(strict))
                n_soft.append(len(soft_hits))
                weight.append(sum(weights[k] for k in soft_hits))
            rejected = (np.array(n_strict) > 0) | (np.array(n_soft) >= soft_limit) | (np.array(weight) >= weight_limit)
            yield pa.record_batch({"page_id": batch.column(0), "url": batch.column(1), "n_strict": pa.array(n_strict, pa.int64()), "n_soft": pa.array(n_soft, pa.int64()), "weight": pa.array(weight, pa.float64()), "rejected": pa.array(rejected.astype(bool), pa.bool_())})

    return run


def url_scores(pages: DataFrame, strict: tuple[str, ...] = STRICT, soft: dict[str, float] = SOFT, soft_limit: int = 3, weight_limit: float = 3.0, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, url, n_strict, n_soft, weight, rejected) of each row.

    n_strict counts the strict hits, n_soft the different soft terms, weight sums
    these terms' weights. The terms are by default those of `url_terms`. Matching ignores the case of ASCII letters; terms must be
    in lower case. A null or empty URL has no hits and is not rejected. A null
    page_id stays. Repeated rows each give one. Very long URLs are searched whole.
    No rows: none. Other columns are not read.
    """
    if any(not t or t != t.lower() for t in [*strict, *soft]):
        raise ValueError("terms must be in lower case and not empty")
    if set(strict) & set(soft):
        raise ValueError("a term is strict or soft, not both")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return rows.mapInArrow(_rows(tuple(sorted(strict)), tuple(sorted(soft.items())), soft_limit, weight_limit), "page_id long, url string, n_strict long, n_soft long, weight double, rejected boolean")
