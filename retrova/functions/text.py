"""Text expressions: tokens, per-document BM25, lexical overlap, FNV-1a, hash embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B, AVGDL = 1.2, 0.75, 50.0
FNV_SEED, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
#: Strings that are hashed byte by byte, as arrays of so few gain nothing; bytes of strings that are hashed at once.
FNV_FEW, FNV_PIECE = 32, 8 << 20


def tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def count_of(items: Column, one: Column) -> Column:
    """How many of the items equal one, as a double; a loop of the JVM without a lambda."""
    return (F.size(items) - F.size(F.array_remove(items, one))).cast("double")


def bm25_score(query: Column, document: Column) -> Column:
    """BM25 of one document without corpus statistics: the mean length counts as 50 words. The document is cut once."""

    def part(tf: Column, size: Column) -> Column:
        idf = F.greatest(F.lit(0.01), F.log(1 + 1 / (tf + 1)) + 1)
        return F.when(tf > 0, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / AVGDL))).otherwise(0.0)

    def score(d: Column) -> Column:
        each = F.transform(F.array_distinct(tokens(query)), lambda q: count_of(d, q))
        return F.aggregate(each, F.lit(0.0), lambda s, tf: s + part(tf, F.size(d).cast("double")))

    return F.transform(F.array(tokens(document)), score)[0]


def lexical_overlap(query: Column, document: Column) -> Column:
    """Share of the query's distinct tokens in the document, 0.15 more if it holds the query as it is, 1 at most; 0 without tokens."""
    q = F.array_distinct(tokens(query))
    share = F.size(F.array_intersect(q, tokens(document))) / F.nullif(F.size(q), F.lit(0))
    return F.coalesce(F.least(F.lit(1.0), share + F.when(F.contains(F.lower(document), F.lower(query)), 0.15).otherwise(0.0)), F.lit(0.0))


def fnv1a64_bytes(data: bytes, h: int = FNV_SEED) -> int:
    """FNV-1a of the bytes in 64 bits, going on from h."""
    for b in data:
        h = ((h ^ b) * FNV_PRIME) & 0xFFFFFFFFFFFFFFFF
    return h


def fnv1a64_all(items: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings, all strings' next byte at a time, the longer ones first; the last few go byte by byte."""
    n = np.array([len(x) for x in items], np.int64)
    order = np.argsort(-n, kind="stable")
    buf = np.frombuffer(b"".join(items), np.uint8)
    start, ends = (np.cumsum(n) - n)[order], n[order]
    h = np.full(len(items), FNV_SEED, np.uint64)
    live, k = int(np.searchsorted(-ends, 0)), 0
    while live >= FNV_FEW:
        h[:live] = (h[:live] ^ buf[start[:live] + k]) * np.uint64(FNV_PRIME)
        k += 1
        live = int(np.searchsorted(-ends, -k))
    for i in range(live):
        h[i] = fnv1a64_bytes(items[order[i]][k:], int(h[i]))
    out = np.empty_like(h)
    out[order] = h
    return out


def fnv1a64(text: Column) -> Column:
    """FNV-1a of the UTF-8 bytes in 64 bits, as 16 hex digits."""

    @F.arrow_udf("string")
    def run(batch: pa.Array) -> pa.Array:
        out, items, size = [], [], 0
        flush = lambda: out.extend(f"{h:016x}" for h in fnv1a64_all(items).tolist())
        for x in batch.cast(pa.binary()).to_pylist():
            items.append(x or b"")
            size += len(items[-1])
            if size >= FNV_PIECE:
                flush()
                items, size = [], 0
        flush()
        return pa.array(out, pa.string(), mask=batch.is_null().to_numpy(zero_copy_only=False))

    return run(text)


def embed(text: Column, dim: int = 16) -> Column:
    """Signed hash embedding of the tokens, the one at place i weighing 1/sqrt(i + 1), of unit length. `dim` is a power of two.

    Slot and sign need only the low bits of a token's FNV-1a, which the low bits alone determine.
    """
    if dim < 2 or dim & (dim - 1):
        raise ValueError("dim must be a power of two")
    low = lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0x25 % dim if dim <= 32 else 0x84222325 % dim), lambda h, i: (h.bitwiseXOR(F.ascii(F.substring(t, i, F.lit(1)))) * 435).bitwiseAND(dim - 1))
    marked = F.transform(tokens(text), lambda t, i: F.struct(low(t).alias("h"), (1 / F.sqrt(i.cast("double") + 1)).alias("w")))
    slot = lambda k: F.aggregate(F.filter(marked, lambda m: m["h"] == k), F.lit(0.0), lambda s, m: s + m["w"] * (1 if k % 2 == 0 else -1))
    raw = F.array(*[slot(k) for k in range(dim)])
    length = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    unit = F.array(F.lit(1.0), *[F.lit(0.0)] * (dim - 1))
    return F.when(F.size(tokens(text)) == 0, unit).when(length > 0, F.transform(raw, lambda x: x / length)).otherwise(raw)


def hybrid_score(vector_score: Column, text_score: Column, alpha: Column) -> Column:
    return F.when((alpha < 0) | (alpha > 1) | F.isnan(alpha), F.raise_error(F.lit("hybrid_score alpha must be between 0.0 and 1.0")).cast("double")).otherwise(alpha * vector_score + (1 - alpha) * text_score)


def redact(json: Column, fields: list[str]) -> Column:
    """A JSON object's named top-level fields as "[REDACTED]"."""
    kind = "map<string,string>"
    m = F.from_json(json, kind)
    return F.to_json(F.transform_values(m, lambda k, v: F.when(k.isin(fields), F.lit("[REDACTED]")).otherwise(v)))
