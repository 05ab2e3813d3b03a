"""Document fingerprints by locally consistent parsing.

A text's bytes are level 0. Each level cuts its symbols into phrases and names
each by the hash of its symbols, so that a level has at most half as many symbols
as the one before, about:

1. a run of equal symbols becomes one symbol;
2. deterministic coin tossing shrinks the names to labels: twice the lowest bit
   in which a symbol differs from its left neighbour, plus that bit. Four rounds
   leave labels under 6; the labels 3, 4 and 5 then take the least of 0 to 2 that
   neither neighbour has. Neighbours always differ;
3. a phrase starts at each local maximum of the labels, and at each local minimum
   that has no maximum beside it.

Where a phrase starts depends on a few symbols to its left and right only. Equal
substrings are therefore cut alike but for a margin at their ends, and share the
names of their interior phrases whatever their offsets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .jobs import usable

U = np.uint64
_B = 0xA24BAED4963EE407
_INVERSE = pow(_B, -1, 1 << 64)


def labels(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels 0 to 2 of symbols, none equal to a neighbour's; `head` marks each text's first symbol."""
    if not len(x):
        return np.zeros(0, np.uint8)
    one = x.dtype.type(1)
    before = np.empty_like(x)
    before[1:] = x[:-1]
    before[head] = x[head] ^ one
    d = x ^ before
    bit = np.bitwise_count((d & (~d + one)) - one)
    lab = (2 * bit + ((x >> bit.astype(x.dtype)) & one).astype(np.uint8)).astype(np.uint8)
    for _ in range(3):
        before = np.empty_like(lab)
        before[1:] = lab[:-1]
        before[head] = lab[head] ^ 1
        d = lab ^ before
        bit = np.bitwise_count((d & (~d + np.uint8(1))) - np.uint8(1))
        lab = 2 * bit + ((lab >> bit) & 1)
    end = np.append(head[1:], True)
    for v in (3, 4, 5):
        at = np.flatnonzero(lab == v)
        left = np.where(head[at], 9, lab[at - 1])
        right = np.where(end[at], 9, lab[np.minimum(at + 1, len(lab) - 1)])
        free = np.zeros(len(at), np.uint8)
        for c in (2, 1, 0):
            free[(left != c) & (right != c)] = c
        lab[at] = free
    return lab


def phrase_heads(lab: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Where phrases start."""
    n = len(lab)
    end = np.append(head[1:], True)
    left, right = np.empty(n, np.int8), np.empty(n, np.int8)
    left[1:], right[:-1] = lab[:-1], lab[1:]
    left[head], right[end] = -1, -1
    top = (lab > left) & (lab > right) & ~head & ~end
    beside = np.zeros(n, bool)
    beside[1:] |= top[:-1]
    beside[:-1] |= top[1:]
    low = (lab < left) & (lab < right) & ~head & ~end & ~beside
    return top | low | head


def level(x: np.ndarray, row: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level of parsing: names, rows and first bytes of the symbols to those of the phrases."""
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    run = np.diff(np.append(at, len(x)))
    x, row, begin = x[at], row[at], begin[at]
    head = np.ones(len(x), bool)
    head[1:] = row[1:] != row[:-1]
    if x.dtype == np.uint8:
        lab = labels(x, head)  # neighbours differ, with or without the runs' lengths
        x = K.mix(x.astype(U) + U(1))
        x = np.where(run > 1, K.mix(x * U(_B) + run.astype(U)), x)
    else:
        x = np.where(run > 1, K.mix(x * U(_B) + run.astype(U)), x)
        lab = labels(x, head)
    start = np.flatnonzero(phrase_heads(lab, head))
    end = np.append(start[1:], len(x))
    sums = np.zeros(len(x) + 1, U)
    np.cumsum(x * K._pow_table(_B, len(x)), out=sums[1:])
    names = K.mix((sums[end] - sums[start]) * K._pow_table(_INVERSE, len(x) + 1)[start] + (end - start).astype(U))
    return names, row[start], begin[start]


def parse(buf: np.ndarray, offs: np.ndarray, depth: int) -> dict[str, np.ndarray]:
    """The phrases of level `depth`, and each text's fingerprint: the name left when one symbol is, and at what level."""
    rows = len(offs) - 1
    x, row, begin = buf, np.repeat(np.arange(rows), np.diff(offs)), np.arange(len(buf)) - np.repeat(offs[:-1], np.diff(offs))
    height, name = np.zeros(rows, np.int64), np.zeros(rows, U)
    todo, k = np.diff(offs) > 0, 0
    out = {"names": np.zeros(0, U), "row": np.zeros(0, np.int64), "begin": np.zeros(0, np.int64)}
    while len(x):
        x, row, begin = level(x, row, begin)
        k += 1
        if k == depth:
            out = {"names": x, "row": row, "begin": begin}
        count = np.bincount(row, minlength=rows)
        done = todo & (count == 1)
        name[done] = x[np.searchsorted(row, np.flatnonzero(done))]
        height[done] = k
        todo &= ~done
        if k >= depth:
            if not todo.any():
                break
            live = todo[row]
            x, row, begin = x[live], row[live], begin[live]
    return out | {"height": height, "name": name}


def _rows(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch):
                p = parse(*K.utf8(piece.column(1)), depth)
                count = np.bincount(p["row"], minlength=piece.num_rows)
                yield pa.record_batch({
                    "doc_id": piece.column(0), "fingerprint": p["name"].view(np.int64), "height": p["height"],
                    "starts": K.lists(p["begin"], count), "names": K.lists(p["names"].view(np.int64), count),
                })

    return K.tidy(run)


def fingerprints(docs: DataFrame, depth: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, height, starts, names) of each document.

    `names` are the phrase names of level `depth` in the text's order, `starts`
    their first bytes (UTF-8, from 0). `fingerprint` is the one name left at level
    `height`: texts have it in common if and only if they are equal (64-bit
    hashes aside).

    An empty text has fingerprint 0, height 0 and no phrases. Rows with a null
    doc_id or text are left out. Repeated rows each give one. Very long texts are
    parsed whole. No rows: none. Other columns are not read.
    """
    if depth < 1:
        raise ValueError("depth must be 1 or more")
    return usable(docs, id_col, text_col).mapInArrow(_rows(depth), "doc_id long, fingerprint long, height long, starts array<long>, names array<long>")
