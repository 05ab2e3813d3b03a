"""Vectorised text kernels shared by the corpus operators.

Everything here works on Arrow batches through numpy: a batch of texts is one
byte buffer with row offsets, tokens are maximal runs of bytes other than ASCII
white space, and a token's hash is taken from prefix sums, so no Python loop
runs per character or per token.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20

_powers: dict[int, np.ndarray] = {}


def _pow_table(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        out = np.empty(size, dtype=U)
        out[0] = 1
        k = 1
        while k < size:
            step = min(k, size - k)
            out[k : k + step] = out[:step] * U(pow(base, k, 1 << 64))
            k += step
        _powers[base] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(29)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(32)
    return x


def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


@cache
def _lean() -> None:
    """In a task's process, arrays of 1 MB or more go back to the system as soon as they are freed."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):
        libc.mallopt(-3, 1 << 20)


def give_back() -> None:
    """Frees what a task's process holds for later, as it may stay idle beside others."""
    _powers.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def tidy(run):
    """A function of batches, for mapInArrow, that gives its process's memory back when it ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _lean()
        yield from run(batches)
        give_back()

    return tidied


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch between rows into pieces of about `limit` bytes of text."""
    _lean()
    n = batch.num_rows
    if not n:
        return
    _, offs = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    pa.default_memory_pool().release_unused()


class Tokens:
    """Tokens of a piece: byte bounds, 64-bit hashes, and `first[i]:first[i+1]` for row i."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        n = len(buf)
        self.buf, self.offs = buf, offs
        if not n:
            self.start = self.end = np.zeros(0, np.int64)
            self.hash = np.zeros(0, U)
            self.first = np.zeros(len(offs), np.int64)
            return
        space = _SPACE[buf]
        edge = np.empty(n + 1, dtype=bool)
        edge[0] = edge[n] = True
        edge[1:n] = space[:-1]
        edge[offs[offs < n]] = True
        self.start = np.flatnonzero(~space & edge[:n])
        edge[:n] = space
        edge[offs] = True
        self.end = np.flatnonzero(~space & edge[1:]) + 1
        sums = np.empty(n + 1, dtype=U)
        sums[0] = 0
        value = buf.astype(U)
        value += U(1)
        value *= _pow_table(_BASE, n)
        np.cumsum(value, out=sums[1:])
        del value, space, edge
        inverse = pow(_BASE, -1, 1 << 64)
        self.hash = mix((sums[self.end] - sums[self.start]) * _pow_table(inverse, n)[self.start] + (self.end - self.start).astype(U))
        del sums
        self.first = np.searchsorted(self.start, offs)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each token."""
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)


def tokens(batch: pa.RecordBatch, text: str = "text") -> Tokens:
    return Tokens(*utf8(batch.column(batch.schema.get_field_index(text))))


def char_index(buf: np.ndarray) -> np.ndarray:
    """Number of characters before each byte position, and in all, of UTF-8 bytes."""
    out = np.empty(len(buf) + 1, dtype=np.int64)
    out[0] = 0
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def grams(tok: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word n-grams with the row of each; a row of 1 to n-1 words gives one gram of all its words."""
    rows = tok.rows()
    h = tok.hash
    m = len(h)
    if not m:
        return np.zeros(0, U), np.zeros(0, np.int64)
    full = np.zeros(0, U)
    at = np.zeros(0, np.int64)
    if m >= n:
        acc = h[: m - n + 1] * U(0x9FB21C651E98DF25)
        for k in range(1, n):
            acc = mix(acc + h[k : m - n + 1 + k]) * U(0x9FB21C651E98DF25)
        ok = rows[: m - n + 1] == rows[n - 1 :]
        full, at = acc[ok], rows[: m - n + 1][ok]
    short = np.flatnonzero((tok.counts > 0) & (tok.counts < n))
    if len(short):
        extra = np.zeros(len(short), U)
        for k in range(n - 1):
            live = tok.counts[short] > k
            extra[live] = mix(extra[live] * U(0x9FB21C651E98DF25) + h[tok.first[short[live]] + k] + U(k + 1))
        full, at = np.concatenate([full, extra]), np.concatenate([at, short])
        order = np.argsort(at, kind="stable")
        full, at = full[order], at[order]
    return full, at


def ragged(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, on end."""
    total = int(counts.sum())
    out = np.arange(total)
    return out - np.repeat(np.cumsum(counts) - counts, counts)


def lists(flat, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    offs = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offs[1:])
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, type=kind) if not isinstance(flat, pa.Array) else flat)
