"""Quality classifier: hierarchical empirical Bayes over documents, paths and hosts.

1. A logistic regression over word presence and shape statistics, trained on a
   bounded sample of labelled documents (`max_train`), gives every document
   evidence in log odds.
2. Paths and hosts gather their documents' expected good counts by grouped
   aggregation over the whole corpus. Beta priors are fitted to the spread between
   groups by moments, and a host's rate is shrunk toward the global one, a path's
   toward its host's; sparse sites stay near their prior.
3. A document's posterior moves its evidence by the log odds of its path's rate
   against the global one.

Texts are read once for the aggregation and once for the result; what is shuffled
is one row a path and, for the result, nothing unless there are more than
BROADCAST_PATHS paths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .jobs import cut

U = np.uint64
SHAPES = 9
#: Rates of up to so many paths (some 100 bytes each) are broadcast.
BROADCAST_PATHS = 200_000
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_PLAIN = np.zeros(256, bool)  # marks of ordinary prose
_PLAIN[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _sums(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=c[1:])
    return (c[offs[1:]] - c[offs[:-1]]).astype(float)


def words(buf: np.ndarray, offs: np.ndarray) -> K.Tokens:
    """Tokens with ASCII letters in lower case and ASCII marks as white space."""
    return K.Tokens(np.where(_MARK[buf], np.uint8(32), _FOLD[buf]), offs)


def presence(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) pairs."""
    order = np.lexsort((hashes, rows))
    r, h = rows[order], hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


def shapes(buf: np.ndarray, offs: np.ndarray, tok: K.Tokens) -> np.ndarray:
    """Shape statistics of each row: shares of marks, capitals, digits, repeats and the like."""
    n = np.maximum(np.diff(offs), 1).astype(float)
    letters = np.maximum(_sums(_LETTER[buf], offs), 1)
    count = np.maximum(tok.counts, 1).astype(float)
    same = np.zeros(len(buf), bool)
    same[1:] = buf[1:] == buf[:-1]
    odd = _sums(_MARK[buf] & ~_PLAIN[buf], offs)
    again = np.zeros(len(tok.hash) + 1, np.int64)
    if len(tok.hash) > 1:
        rows = tok.rows()
        np.cumsum(np.concatenate([[False], (tok.hash[1:] == tok.hash[:-1]) & (rows[1:] == rows[:-1])]), out=again[1:])
    next_again = again[tok.first[1:]] - again[tok.first[:-1]]
    length = _sums(_LETTER[buf] | _DIGIT[buf], offs)
    return np.column_stack([
        np.log1p(odd / n * 100), np.log1p(_sums(buf == 33, offs) / n * 100), np.log1p(_sums(buf == 124, offs) / n * 100), _sums(_UPPER[buf], offs) / letters, np.log1p(_sums(_DIGIT[buf], offs) / n * 100),
        next_again / count, np.log1p(length / count), np.log1p(count), _sums(same & ~_LETTER[buf], offs) / n,
    ])


@dataclass(frozen=True)
class Model:
    """keys: sorted word hashes; weights: of these words' presence; shape: mean, scale and weight of each statistic."""

    keys: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    shape: np.ndarray
    bias: float

    def log_odds(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        tok = words(buf, offs)
        x = (shapes(buf, offs, tok) - self.mean) / self.scale
        out = np.clip(x, -8, 8) @ self.shape + self.bias
        if len(self.keys) and len(tok.hash):
            at = np.minimum(np.searchsorted(self.keys, tok.hash), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == tok.hash)
            r, h = presence(tok.rows()[hit], tok.hash[hit])
            out += np.bincount(r, weights=self.weights[np.searchsorted(self.keys, h)], minlength=len(offs) - 1)
        return np.clip(out, -30, 30)


def train(texts: list[str] | pa.ChunkedArray, good: np.ndarray, max_words: int = 300, ridge: float = 0.3, steps: int = 25) -> Model:
    """Ridge logistic regression by Newton steps; words chosen by their chi-squared with the label."""
    y = np.asarray(good, float)
    r, h, s, done = [], [], [], 0
    for piece in K.slices(pa.record_batch({"text": texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else pa.array(texts, pa.string())})):
        buf, offs = K.utf8(piece.column(0))
        tok = words(buf, offs)
        rows, hashes = presence(tok.rows(), tok.hash)
        r.append(rows + done)
        h.append(hashes)
        s.append(shapes(buf, offs, tok))
        done += piece.num_rows
    r, h, s = np.concatenate(r), np.concatenate(h), np.concatenate(s)
    mean, scale = s.mean(0), s.std(0) + 1e-6
    s = np.clip((s - mean) / scale, -8, 8)
    keys, inv, df = np.unique(h, return_inverse=True, return_counts=True)
    pos = np.bincount(inv, weights=y[r], minlength=len(keys))
    n, p = len(y), y.mean() if len(y) else 0.5
    if len(keys) and 0 < p < 1:
        expect = df * p
        chi = (np.abs(pos - expect) - 0.5).clip(0) ** 2 / np.maximum(expect * (1 - p) * np.maximum(1 - df / n, 1e-3), 1e-9)
        picked = np.flatnonzero((df >= 3) & (chi > 10.8))
        picked = np.sort(picked[np.argsort(-chi[picked], kind="stable")][:max_words])
    else:
        picked = np.zeros(0, np.int64)
    x = np.zeros((n, 1 + s.shape[1] + len(picked)))
    x[:, 0] = 1
    x[:, 1 : 1 + s.shape[1]] = s
    column = np.full(len(keys), -1)
    column[picked] = np.arange(len(picked))
    c = column[inv]
    x[r[c >= 0], 1 + s.shape[1] + c[c >= 0]] = 1
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * np.maximum(q * (1 - q), 1e-6)) @ x + np.diag(penalty), x.T @ (y - q) - penalty * w)
        size = np.abs(step).max()
        w += step * min(1.0, 4 / max(size, 1e-12))
        if size < 1e-6:
            break
    k = 1 + s.shape[1]
    return Model(keys[picked], w[k:], mean, scale, w[1:k], float(w[0]))


def train_on(docs: DataFrame, labels: DataFrame, good: Column, max_train: int = 4000, max_words: int = 300) -> Model:
    """Trains on the texts of the `max_train` labelled doc_ids of the least hash; that bound is the sample's size.

    `max_words` is the size of the model: how many words, those that tell most about
    the label, have a weight of their own besides the shape statistics.

    Rows that lack a text or a label are left out; of repeated ones the least
    counts. Very long texts count whole. Without both labels among them, or without
    rows, the model says the same of all texts. Other columns are not read.
    """
    picked = labels.select("doc_id", good.cast("int").alias("good")).dropna().groupBy("doc_id").agg(F.min("good").alias("good"))
    picked = picked.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(max_train)
    sample = docs.select("doc_id", "text").dropna().join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("good").alias("good"))  # max_train rows at most
    sample = sample.toArrow().sort_by("doc_id")
    if not sample.num_rows:
        return Model(np.zeros(0, U), np.zeros(0), np.zeros(SHAPES), np.ones(SHAPES), np.zeros(SHAPES), 0.0)
    return train(sample["text"], sample["good"].to_numpy(), max_words)


def _scored(model: Model, text: str) -> Column:
    @F.arrow_udf("double")
    def log_odds(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for s in texts:
            out = [model.log_odds(*K.utf8(p.column(0))) for p in K.slices(pa.record_batch({"t": s}), "t")]
            yield pa.array(np.concatenate(out) if out else np.zeros(0))
        K.give_back()

    # never null, which Spark can't know: it would filter by that below the join, and so score each text twice
    return F.coalesce(log_odds(F.col(text)), F.lit(0.0))


def _strength(rates: DataFrame, rate: str, n: str, prior: Column) -> Column:
    """Moment estimate of a Beta prior's weight from (rate, n) rows around `prior`, in an aggregation.

    Var(rate) over groups is prior*(1-prior) * (1/n + (1 - 1/n)/(weight + 1)) about; groups count by n.
    """
    spread = F.sum(F.col(n) * (F.col(rate) - prior) ** 2)
    noise = F.sum(prior * (1 - prior))
    between = F.greatest(F.lit(1e-6), (spread - noise) / F.greatest(F.lit(1.0), F.sum(n) - F.sum(F.col(n) ** 2) / F.sum(n)))
    var = F.greatest(F.lit(1e-9), F.avg(prior * (1 - prior)))
    return F.greatest(F.lit(2.0), F.least(F.lit(1e6), var / between - 1))


def posterior_rates(scored: DataFrame) -> DataFrame:
    """(host, path, path_rate, host_rate, global_rate) from rows (host, path, p), one row a host and path.

    A host's rate is its mean p shrunk toward the global one, a path's toward its host's,
    each by a Beta prior whose weight is a moment estimate over all hosts, or paths.
    Repeated rows each count; nulls should be names of their own. No rows: none.
    """
    paths = cut(scored.groupBy("host", "path").agg(F.sum("p").alias("good"), F.count(F.lit(1)).cast("double").alias("n")))
    hosts = paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"))
    whole = paths.agg(((F.sum("good") + 1) / (F.sum("n") + 2)).alias("global_rate"))
    hosts = hosts.crossJoin(F.broadcast(whole)).withColumn("r", F.col("host_good") / F.col("host_n"))  # one row
    weight = hosts.agg(_strength(hosts, "r", "host_n", F.col("global_rate")).alias("host_weight"))
    hosts = hosts.crossJoin(F.broadcast(weight)).select(  # one row
        "host", "global_rate", ((F.col("host_good") + F.col("host_weight") * F.col("global_rate")) / (F.col("host_n") + F.col("host_weight"))).alias("host_rate"),
    )
    paths = paths.join(hosts, "host").withColumn("r", F.col("good") / F.col("n"))
    weight = paths.agg(_strength(paths, "r", "n", F.col("host_rate")).alias("path_weight"))
    return paths.crossJoin(F.broadcast(weight)).select(  # one row
        "host", "path", "global_rate", "host_rate", ((F.col("good") + F.col("path_weight") * F.col("host_rate")) / (F.col("n") + F.col("path_weight"))).alias("path_rate"),
    )


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


_ADDED = ("_host", "_path", "_evidence", "_path_rate", "_host_rate", "_global", "_quality")


def classify(docs: DataFrame, model: Model, host: Column | None = None, path: Column | None = None, text_col: str = "text") -> DataFrame:
    """The documents with `_evidence` (log odds), `_path_rate`, `_host_rate` and `_quality` (posterior) added.

    host and path default to `source` and `lang`. A null host or path is a value of
    its own; a null text is scored as an empty one. Repeated rows each count. An
    empty table gives an empty one. Very long texts are scored whole. All columns of
    `docs` stay, but for those that have a name of an added one, which are replaced.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    host, path = host.alias("_host"), path.alias("_path")
    kept = [c for c in docs.columns if c not in _ADDED]
    docs = docs.select(*kept, host, path)
    keys = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    scored = docs.withColumns({"_host": keys(F.col("_host")), "_path": keys(F.col("_path")), "_evidence": _scored(model, text_col)})
    rates = cut(posterior_rates(scored.select(F.col("_host").alias("host"), F.col("_path").alias("path"), (1 / (1 + F.exp(-F.col("_evidence")))).alias("p"))))
    rates = rates.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("path_rate").alias("_path_rate"), F.col("host_rate").alias("_host_rate"), F.col("global_rate").alias("_global"))
    if rates.count() <= BROADCAST_PATHS:  # else texts and rates meet by a shuffle
        rates = F.broadcast(rates)
    out = scored.join(rates, ["_host", "_path"])
    total = F.col("_evidence") + _logit(F.col("_path_rate")) - _logit(F.col("_global"))
    return out.withColumn("_quality", 1 / (1 + F.exp(-total))).select(*kept, "_evidence", "_path_rate", "_host_rate", "_quality")


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.6, host: Column | None = None, path: Column | None = None, text_col: str = "text") -> DataFrame:
    """The documents whose posterior is `threshold` or more, with their own columns, whatever their names.

    Documents with a null text are rejected, empty and very long ones judged like others.
    Null hosts and paths are values of their own. Repeated rows are judged alike, and all
    stay or go. No rows: none.
    """
    host, path = F.col("source") if host is None else host, F.col("lang") if path is None else path
    packed = docs.select(F.struct(*docs.columns).alias("row"), host.alias("host"), path.alias("path"), F.col(text_col).alias("text"))
    return classify(packed, model, F.col("host"), F.col("path")).where((F.col("_quality") >= threshold) & F.col("text").isNotNull()).select("row.*")
