"""Vector expressions over ARRAY<FLOAT> columns, all JVM-side, summed in DOUBLE."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v]).cast("array<float>")


def same_size(a: Column, b: Column) -> Column:
    """null where a and b have one dimension; an error otherwise."""
    left, right = F.coalesce(F.size(a), F.lit(-1)), F.coalesce(F.size(b), F.lit(-1))
    return F.when((left != right) & a.isNotNull() & b.isNotNull(), F.raise_error(F.concat(F.lit("vector dimension mismatch: left="), left.cast("string"), F.lit(" right="), right.cast("string"))))


def _sum(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.coalesce(same_size(a, b).cast("double"), value)


def l2_distance(a: Column, b: Column) -> Column:
    return _checked(a, b, F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for a vector without length."""
    n = norm(a) * norm(b)
    return _checked(a, b, F.when(n == 0, 0.0).otherwise(dot(a, b) / F.nullif(n, F.lit(0.0))))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine(a, b)


def neg_inner_product(a: Column, b: Column) -> Column:
    return _checked(a, b, -dot(a, b))


def vector(text: Column) -> Column:
    """'[1,2]' or '1, 2' to a vector; empty elements are skipped, none left is an error."""
    t = F.trim(text)
    inner = F.when(t.startswith("[") & t.endswith("]") & (F.length(t) >= 2), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
    out = F.transform(F.filter(F.split(inner, ","), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("float"))
    return F.when(F.size(out) > 0, out).otherwise(F.raise_error(F.lit("vector literal must contain at least one value")).cast("array<float>"))


def int8_scale(v: Column) -> Column:
    return F.greatest(F.array_max(F.transform(v, F.abs)).cast("double"), F.lit(1e-6)) / 127


def quantise_int8(v: Column) -> Column:
    """(scale, codes): the codes times the scale are the vector, about."""
    s = int8_scale(v)
    return F.struct(s.alias("scale"), F.transform(v, lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x.cast("double") / s))).cast("tinyint")).alias("codes"))


def dequantise_int8(q: Column) -> Column:
    return F.transform(q["codes"], lambda x: (x.cast("double") * q["scale"]).cast("float"))


def through_f16(v: Column) -> Column:
    """The vector as half floats hold it."""

    @F.arrow_udf("array<float>")
    def run(batch: pa.Array) -> pa.Array:
        flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float32)
        sizes = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offs = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32), mask=np.append(batch.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(offs, pa.array(flat))

    return run(v)


def planes(tables: int, bits: int, dim: int, seed: int = 17) -> np.ndarray:
    """Unit normals (tables, bits, dim) of the hyperplanes, the same for a seed on any machine."""
    i = np.arange(tables * bits * dim, dtype=np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for shift, k in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        i = (i ^ (i >> np.uint64(shift))) * np.uint64(k)
    i ^= i >> np.uint64(31)
    p = (i >> np.uint64(11)).astype(float).reshape(tables, bits, dim) / 2**52 - 1
    return np.round(p / np.linalg.norm(p, axis=2, keepdims=True), 6)


def signature(v: Column, normals: np.ndarray) -> Column:
    """Bit i is set if the vector's product with normal i is 0 or more."""
    out = F.lit(0)
    for i, p in enumerate(normals):
        out = out + F.when(dot(v, F.array(*[F.lit(float(x)) for x in p])) >= 0, 1 << i).otherwise(0)
    return out
