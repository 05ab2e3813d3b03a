"""Mixing overlapping sources to target weights by min-cost flow.

1. Documents are aggregated by membership pattern (which sources hold them) and
   by a slice of a seeded hash: one row a pattern and slice.
2. Each pattern offers its tokens once for nothing, again at costs that rise with
   each repetition; each source wants its weight's share of the token budget. The
   flow of least cost routes the patterns' tokens to the sources. The network has a
   node a pattern and a node a source, so it is solved on the driver.
3. A pattern's flow over its tokens is how often its documents come: the whole
   number of times each, and once more for those whose seeded hash is under the
   place in the slices where the remaining tokens are reached.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .jobs import counted, cut

SLICES = 4096
FINE = 1 << 30
WIDTH = FINE // SLICES


@dataclass
class _Arc:
    to: int
    cap: float
    cost: float
    back: int


def min_cost_flow(capacity: dict[str, float], quota: list[float], levels: int = 8) -> tuple[dict[str, list[float]], list[float]]:
    """Tokens from each pattern to each source, and what each source lacks, at the least total cost.

    A pattern (a string of 0 and 1, one for each source) offers its capacity
    `levels` times; the k-th repetition of a token costs k. Among the flows that
    fill most of the quotas, this is one of least cost: successive shortest paths,
    the arcs in the order of the patterns' names.
    """
    names = sorted(p for p in capacity if "1" in p and capacity[p] > 0)
    m, k = len(names), len(quota)
    source, sink = m + k, m + k + 1
    graph: list[list[_Arc]] = [[] for _ in range(m + k + 2)]

    def arc(a: int, b: int, cap: float, cost: float) -> None:
        graph[a].append(_Arc(b, cap, cost, len(graph[b])))
        graph[b].append(_Arc(a, 0.0, -cost, len(graph[a]) - 1))

    for i, p in enumerate(names):
        for level in range(levels):
            arc(source, i, capacity[p], level)
        for j in range(k):
            if p[j] == "1":
                arc(i, m + j, float("inf"), 0.0)
    for j in range(k):
        arc(m + j, sink, quota[j], 0.0)
    tiny = 1e-9 * max(1.0, sum(quota))
    while True:
        far = [float("inf")] * len(graph)
        via: list[tuple[int, int] | None] = [None] * len(graph)
        far[source] = 0.0
        changed = True
        while changed:
            changed = False
            for a, arcs in enumerate(graph):
                if far[a] < float("inf"):
                    for x, e in enumerate(arcs):
                        if e.cap > tiny and far[a] + e.cost < far[e.to] - 1e-12:
                            far[e.to], via[e.to], changed = far[a] + e.cost, (a, x), True
        if via[sink] is None:
            break
        path, at = [], sink
        while at != source:
            a, x = via[at]
            path.append(graph[a][x])
            at = a
        push = min(e.cap for e in path)
        for e in path:
            e.cap -= push
            graph[e.to][e.back].cap += push
    flow = {p: [0.0] * k for p in capacity}
    for i, p in enumerate(names):
        for e in graph[i]:
            if m <= e.to < m + k:
                flow[p][e.to - m] = graph[e.to][e.back].cap
    lacks = [next(e.cap for e in graph[m + j] if e.to == sink) for j in range(k)]
    return flow, [x if x > tiny else 0.0 for x in lacks]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def mixed(docs: DataFrame, sources: dict[str, Column], weights: dict[str, float], epochs: float = 1.0, seed: int = 0, others: str = "keep", levels: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with `_pattern`, `_tokens` and `_copies` (1 or more) added; those of no copies are gone.

    The token budget is `epochs` times the words of all documents in a source;
    source j gets weights[j] / sum(weights) of it, as far as its documents, each
    taken `levels` times at most, can fill that; a warning names the sources that
    lack tokens so, and how many. A predicate that is null is false. Documents in no
    source come once (others="keep") or not at all ("drop").

    A text without words, or a null one, has no tokens: it comes as often as its
    pattern's documents do, but for the seeded extra copy. Rows equal in doc_id and
    text, null or not, are treated alike, as are others whose draws tie. Very long texts
    count whole; where one holds more tokens than its slice still lacks, it comes or not
    by its draw. No rows: none. All columns of `docs` stay, but for those that have a
    name of an added one, which are replaced.
    """
    if others not in ("keep", "drop"):
        raise ValueError("others must be keep or drop")
    names = sorted(weights)
    if set(names) != set(sources) or min(weights.values(), default=0) < 0 or sum(weights.values()) <= 0:
        raise ValueError("weights must name the sources and be positive in sum")
    spark = docs.sparkSession
    pattern = F.concat(*[F.when(sources[s], "1").otherwise("0") for s in names])
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), F.lit(FINE))
    kept = [c for c in docs.columns if c not in ("_pattern", "_tokens", "_copies")]
    each = docs.select(F.struct(*kept).alias("row"), pattern.alias("pattern"), word_count(F.col(text_col)).alias("tokens"), draw.alias("draw"))
    slices = cut(each.groupBy("pattern", F.floor(F.col("draw") / WIDTH).cast("int").alias("slice")).agg(F.sum("tokens").alias("tokens")))
    held = {r["pattern"]: float(r["tokens"]) for r in slices.groupBy("pattern").agg(F.sum("tokens").alias("tokens")).collect()}  # a row a pattern, as the network has a node
    budget = epochs * sum(c for p, c in held.items() if "1" in p)
    flow, lacks = min_cost_flow(held, [budget * weights[s] / sum(weights.values()) for s in names], levels)
    if short := {s: round(x) for s, x in zip(names, lacks, strict=True) if x >= 1}:
        warnings.warn(f"these sources lack tokens: {short}", stacklevel=2)
    rates = []
    for p, c in sorted(held.items()):
        if "1" in p:
            rate = sum(flow[p]) / c if c else 0.0
            whole = int(rate + 1e-9)
            rates.append((p, whole, max(0.0, rate - whole) * c))
        else:
            rates.append((p, int(others == "keep"), 0.0))
    kinds = pa.schema({"pattern": pa.string(), "whole": pa.int32(), "want": pa.float64()})
    rates = spark.createDataFrame(pa.Table.from_arrays([pa.array([r[k] for r in rates], x.type) for k, x in enumerate(kinds)], schema=kinds))  # rows of Python would start Python workers of another kind, which stay beside those of the next step
    # where in a pattern's slices the tokens that are wanted beyond whole times are reached; within a slice in proportion
    order = Window.partitionBy("pattern").orderBy("slice")
    part = slices.join(counted(rates.where("want >= 1e-6")), "pattern").withColumn("upto", F.sum("tokens").over(order))
    reached = F.col("slice") * WIDTH + F.floor(WIDTH * (F.col("want") - F.col("upto") + F.col("tokens")) / F.col("tokens"))
    until = part.where("upto > want").groupBy("pattern").agg(F.min_by(reached, F.col("slice")).alias("until"))
    plan = rates.join(until, "pattern", "left").select("pattern", "whole", F.when(F.col("want") < 1e-6, 0).otherwise(F.coalesce("until", F.lit(FINE))).alias("until"))
    copies = F.col("whole") + (F.col("draw") < F.col("until")).cast("int")
    out = each.join(counted(cut(plan)), "pattern").withColumn("copies", copies).where("copies > 0")
    return out.select("row.*", F.col("pattern").alias("_pattern"), F.col("tokens").alias("_tokens"), F.col("copies").alias("_copies"))
