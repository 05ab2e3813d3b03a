"""The scalar functions of the SQL surface, as temporary SQL functions of the session."""

from __future__ import annotations

from pyspark.sql import SparkSession

_TOKENS = "array_remove(split(lower({0}), '[^a-z0-9]+'), '')"
_SUM = "aggregate({0}, 0D, (s, x) -> s + x)"
_MATCH = "if(size(a) <> size(b), raise_error(concat('vector dimension mismatch: left=', size(a), ' right=', size(b))), {0})"
_DOT = _SUM.format("zip_with(a, b, (x, y) -> double(x) * double(y))")
_NORM = "sqrt(" + _SUM.format("transform({0}, x -> double(x) * double(x))") + ")"
_NORMS = f"({_NORM.format('a')} * {_NORM.format('b')})"
_INNER = "if(startswith(trim(x), '[') AND endswith(trim(x), ']'), substr(trim(x), 2, length(trim(x)) - 2), trim(x))"
_PARSED = f"transform(filter(split({_INNER}, ','), t -> trim(t) <> ''), t -> float(trim(t)))"
_PART = "if(tf > 0, greatest(0.01D, ln(1 + 1 / (tf + 1)) + 1) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * size(d) / 50)), 0D)"
_COUNTS = f"transform(array_distinct({_TOKENS.format('query')}), q -> double(size(d) - size(array_remove(d, q))))"
_LOW = "aggregate(sequence(1, length(t)), 5, (h, i) -> ((h ^ ascii(substr(t, i, 1))) * 435) & 15)"


def _bound(name: str, value: str, body: str) -> str:
    """`body` with `name` standing for `value`, which is worked out once."""
    return f"transform(array({value}), {name} -> {body})[0]"


_MARKED = f"transform(toks, (t, i) -> struct({_LOW} AS h, 1 / sqrt(i + 1D) AS w))"
_RAW = "transform(sequence(0, 15), k -> aggregate(filter(marks, m -> m.h = k), 0D, (s, m) -> s + if(k % 2 = 0, m.w, -m.w)))"
_UNIT = _bound("n", "sqrt(aggregate(raw, 0D, (s, y) -> s + y * y))", "transform(raw, r -> float(r / nullif(n, 0D)))")
_EMBED = _bound("toks", _TOKENS.format("x"), f"if(size(toks) = 0, transform(sequence(0, 15), k -> if(k = 0, float(1), float(0))), {_bound('marks', _MARKED, _bound('raw', _RAW, _UNIT))})")

FUNCTIONS = {
    "vector(x STRING)": ("ARRAY<FLOAT>", f"if(size({_PARSED}) > 0, {_PARSED}, cast(raise_error('vector literal must contain at least one value') AS ARRAY<FLOAT>))"),
    "vec_dims(v ARRAY<FLOAT>)": ("INT", "size(v)"),
    "vec_to_json(v ARRAY<FLOAT>)": ("STRING", "to_json(v)"),
    "l2_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": ("DOUBLE", _MATCH.format("sqrt(" + _SUM.format("zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y)))") + ")")),
    "cosine_distance(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": ("DOUBLE", _MATCH.format(f"if({_NORMS} = 0, 1D, 1 - {_DOT} / nullif({_NORMS}, 0D))")),
    "neg_inner_product(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": ("DOUBLE", _MATCH.format(f"-{_DOT}")),
    "embed(x STRING)": ("ARRAY<FLOAT>", _EMBED),
    # the document is cut once, and bound to d
    "bm25_score(query STRING, document STRING)": ("DOUBLE", _bound("d", _TOKENS.format("document"), f"aggregate({_COUNTS}, 0D, (score, tf) -> score + {_PART})")),
    "hybrid_score(v DOUBLE, t DOUBLE, alpha DOUBLE)": ("DOUBLE", "if(alpha BETWEEN 0 AND 1, alpha * v + (1 - alpha) * t, double(raise_error('hybrid_score alpha must be between 0.0 and 1.0')))"),
}


def register(spark: SparkSession) -> None:
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
