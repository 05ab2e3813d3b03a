"""The SQL surface: distance operators and the SEARCH table function, rewritten before Spark parses.

`<=>` must go before Spark sees it, to which it is null-safe equality. Literals,
quoted names and comments are left as they are.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.register import register
from .request import candidate_limit

OPERATORS = {"<->": "l2_distance", "<=>": "cosine_distance", "<#>": "neg_inner_product"}
_TOKEN = re.compile(r"""(?P<quoted>'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<space>\s+)|(?P<op><->|<=>|<\#>)|(?P<word>[A-Za-z_][\w$]*(?:\.[A-Za-z_][\w$]*|\.`[^`]*`)*)|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?[A-Za-z]*|\.\d+)|(?P<mark>.)""", re.S)
_STOP = {"select", "from", "where", "and", "or", "not", "as", "on", "by", "order", "group", "having", "limit", "when", "then", "else", "case", "end", "in", "is", "between", "like", "asc", "desc", "union", "join"}
_OPEN, _CLOSE = {"(": ")", "[": "]"}, {")": "(", "]": "["}


def _tokens(sql: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in _TOKEN.finditer(sql)]


def _skip(toks: list[tuple[str, str]], i: int, step: int) -> int:
    while 0 <= i < len(toks) and toks[i][0] in ("space", "comment"):
        i += step
    return i


def _matching(toks: list[tuple[str, str]], i: int, step: int) -> int:
    depth = 0
    while 0 <= i < len(toks):
        kind, t = toks[i]
        if kind == "mark" and t in "()[]":
            depth += 1 if (t in _OPEN) == (step > 0) else -1
            if depth == 0:
                return i
        i += step
    raise ValueError("unbalanced brackets")


def _operand_before(toks: list[tuple[str, str]], i: int) -> int:
    """Where the operand that ends at i begins."""
    kind, t = toks[i]
    if kind == "mark" and t in _CLOSE:
        i = _matching(toks, i, -1)
        j = _skip(toks, i - 1, -1)
        if j >= 0 and toks[j][0] in ("word", "quoted") and toks[j][1].lower() not in _STOP and (j == i - 1 or toks[j][0] == "word") and not toks[j][1].startswith("'"):
            return j
        return i
    if kind in ("word", "quoted", "number"):
        return i
    raise ValueError(f"no operand before a distance operator: {t!r}")


def _operand_after(toks: list[tuple[str, str]], i: int) -> int:
    """Where the operand that begins at i ends."""
    kind, t = toks[i] if i < len(toks) else ("mark", "")
    if kind == "mark" and t in _OPEN:
        return _matching(toks, i, 1)
    if kind in ("word", "quoted", "number"):
        j = _skip(toks, i + 1, 1)
        if kind == "word" and j < len(toks) and toks[j] == ("mark", "("):
            return _matching(toks, j, 1)
        return i
    raise ValueError("no operand after a distance operator")


def _vector_text(sql: str) -> str:
    """A string literal as an operand is a vector literal."""
    s = sql.strip()
    return f"vector({s})" if s.startswith("'") else s


def rewrite_operators(sql: str) -> str:
    """`a <-> b` and the like to function calls, from left to right."""
    toks = _tokens(sql)
    while True:
        at = next((i for i, t in enumerate(toks) if t[0] == "op"), None)
        if at is None:
            return "".join(t for _, t in toks)
        last, first = _skip(toks, at - 1, -1), _skip(toks, at + 1, 1)
        if last < 0:
            raise ValueError("no operand before a distance operator")
        begin, end = _operand_before(toks, last), _operand_after(toks, first)
        left, right = ("".join(t for _, t in toks[a:b]) for a, b in ((begin, last + 1), (first, end + 1)))
        call = f"{OPERATORS[toks[at][1]]}({_vector_text(left)}, {_vector_text(right)})"
        inner = _tokens(call)
        toks[begin : end + 1] = inner


def split_arguments(text: str) -> list[str]:
    out, depth, current = [], 0, ""
    for kind, t in _tokens(text):
        if kind == "mark" and t in _OPEN:
            depth += 1
        elif kind == "mark" and t in _CLOSE:
            depth -= 1
        if kind == "mark" and t == "," and depth == 0:
            out.append(current.strip())
            current = ""
        elif kind != "comment":
            current += t
    if current.strip() or out:
        out.append(current.strip())
    return out


def _is_null(x: str) -> bool:
    return x.upper() == "NULL"


def _literal(x: str, what: str) -> str:
    if not (x.startswith("'") and x.endswith("'") and len(x) > 1):
        raise ValueError(f"{what} must be a string literal")
    return x[1:-1].replace("''", "'")


def quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _filter(key: str, value) -> str:
    """A typed comparison: strings, numbers and booleans (as 1 and 0) each match their own kind only, null matches nothing.

    A dot in the key leads into an object, [n] into an array; other characters stand for themselves.
    """
    if value is None:
        return "false"
    path = "$" + "".join(f"[{n}]" if n else f'["{name}"]' for name, n in re.findall(r"([^.\[]+)|\[(\d+)\]", key))
    found = lambda kind: f"try_variant_get(try_parse_json(metadata), {quoted(path)}, '{kind}')"
    typed = f"coalesce(schema_of_variant({found('variant')}), '')"
    if isinstance(value, (bool, int, float)):
        number = int(value) if isinstance(value, bool) else value
        return f"CASE WHEN {typed} = 'BOOLEAN' THEN if({found('boolean')}, 1, 0) = {number} WHEN {typed} = 'STRING' THEN false ELSE coalesce({found('double')} = {number}, false) END"
    if isinstance(value, str):
        return f"({typed} = 'STRING' AND {found('string')} = {quoted(value)})"
    raise ValueError("metadata filters must be scalars")


def search_query(arguments: str, table: str = "chunks") -> str:
    """The subquery that SEARCH(arguments) stands for."""
    args = split_arguments(arguments)
    if not 2 <= len(args) <= 8:
        raise ValueError("SEARCH takes 2 to 8 arguments: text, vector, top_k, alpha, candidate_limit, profile, filters, doc_id")
    args += ["", "", "", "", "", ""][: 8 - len(args)]
    text, vec = (None if _is_null(a) else a for a in args[:2])
    if text is None and vec is None:
        raise ValueError("SEARCH needs text, a vector, or both")
    top_k, alpha, given = int(args[2] or 5), float(args[3] or 0.65), int(args[4] or 500)
    if not 0 <= alpha <= 1:
        raise ValueError("alpha must be from 0 to 1")
    profile = "balanced" if not args[5] or _is_null(args[5]) else _literal(args[5], "query_profile").lower()
    filters = {} if not args[6] or _is_null(args[6]) else json.loads(_literal(args[6], "metadata_filters"))
    where = [_filter(k, v) for k, v in sorted(filters.items())]
    if args[7] and not _is_null(args[7]):
        where.append(f"doc_id = {quoted(_literal(args[7], 'doc_id'))}")
    v = f"1 - cosine_distance(embedding, {_vector_text(vec)})" if vec else "0D"
    t = f"bm25_score({text}, content)" if text else "0D"
    both = f"hybrid_score(vector_score, text_score, {alpha}D)" if vec and text else "vector_score" if vec else "text_score"
    limit = min(top_k, candidate_limit(profile, top_k, given))  # of two nested limits over one order the lesser
    return (
        f"(SELECT chunk_id, doc_id, content, metadata, vector_score, text_score, {both} AS hybrid_score FROM "
        f"(SELECT id AS chunk_id, doc_id, content, metadata, {v} AS vector_score, {t} AS text_score FROM {table}{' WHERE ' + ' AND '.join(where) if where else ''}) "
        f"ORDER BY hybrid_score DESC, chunk_id LIMIT {limit})"
    )


_AFTER = {"where", "group", "having", "order", "limit", "offset", "join", "inner", "left", "right", "full", "cross", "natural", "on", "union", "intersect", "except", "window", "using", "qualify", "lateral"}


def rewrite_search(sql: str, table: str = "chunks") -> str:
    """The first FROM SEARCH(...) or JOIN SEARCH(...) to its subquery, named search_results if it has no alias."""
    toks = _tokens(sql)
    for i, (kind, t) in enumerate(toks):
        if kind != "word" or t.lower() != "search":
            continue
        before, after = _skip(toks, i - 1, -1), _skip(toks, i + 1, 1)
        if before < 0 or toks[before][1].lower() not in ("from", "join", ",") or after >= len(toks) or toks[after] != ("mark", "("):
            continue
        end = _matching(toks, after, 1)
        inner = "".join(x for _, x in toks[after + 1 : end])
        nxt = _skip(toks, end + 1, 1)
        named = nxt < len(toks) and (toks[nxt][0] == "quoted" or toks[nxt][0] == "word" and toks[nxt][1].lower() not in _AFTER)
        return "".join(x for _, x in toks[:i]) + search_query(inner, table) + ("" if named else " AS search_results") + "".join(x for _, x in toks[end + 1 :])
    return sql


def rewrite(sql: str, table: str = "chunks") -> str:
    return rewrite_operators(rewrite_search(sql, table)).strip().rstrip(";")


def execute(spark: SparkSession, sql: str, table: str = "chunks") -> DataFrame:
    """A statement of the SQL surface over the view `table`."""
    register(spark)
    return spark.sql(rewrite(sql, table))


def envelope(spark: SparkSession, sql: str, table: str = "chunks") -> dict:
    """The result as a JSON-like object, for callers with small results."""
    import time

    began = time.time()
    rows = [json.loads(r) for r in execute(spark, sql, table).toJSON().collect()]
    return {"kind": "query", "statement": sql, "rewritten": rewrite(sql, table), "elapsed_ms": (time.time() - began) * 1000, "rows": rows, "row_count": len(rows)}
