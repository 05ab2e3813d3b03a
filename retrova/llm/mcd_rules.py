"""Quality rules: robust multivariate outliers by minimum covariance determinant.

Each text becomes a vector of transformed statistics. For each (language, source),
each language and all texts, concentration steps look for the share `h` of the
vectors whose covariance has the least determinant: from a start, all vectors'
Mahalanobis distances are taken, and mean and covariance are estimated anew from
the h closest. Two starts are tried, by medians with absolute deviations and by
spatial signs; the lesser determinant wins. Texts beyond a chi-squared quantile of
their group's distances are rejected; groups of fewer than `least` texts use the
next wider group.

A step is one aggregation: distances fall into logarithmic bins, each (group, bin)
sums moments (which combine on the map side), and a group's bins, a bounded number,
give the h closest and the new estimate. Estimates, two rows a group, go to the
vectors: broadcast while they have been counted to be few, else by a join. So a
source that holds half the corpus is no hot spot.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .jobs import counted, cut
from .quality_bayes import _DIGIT, _LETTER, _MARK, _PLAIN, _UPPER, _sums, words

STATS = ("log_words", "odd_marks", "plain_marks", "capitals", "digits", "repeats", "word_length", "line_ends")
P = len(STATS)
#: Least spread of a statistic, in the transformed scale; a larger one stays as it is. Odd marks and digits, which
#: most texts lack, have that of one character in 400.
FLOOR = np.array([0.1, 0.05, 0.01, 0.01, 0.05, 0.01, 0.01, 0.01])
BINS = 16  # bins of a distance's doubling
_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """The vectors of texts: shares by arcsine of the root, sizes by logarithm."""
    tok = words(buf, offs)
    chars = np.maximum(_sums((buf & 0xC0) != 0x80, offs), 1)
    letters = np.maximum(_sums(_LETTER[buf] & ((buf & 0xC0) != 0x80), offs), 1)
    count = np.maximum(tok.counts, 1).astype(float)
    again = np.zeros(len(tok.hash) + 1, np.int64)
    if len(tok.hash) > 1:
        rows = tok.rows()
        np.cumsum(np.concatenate([[False], (tok.hash[1:] == tok.hash[:-1]) & (rows[1:] == rows[:-1])]), out=again[1:])
    # a few words of ordinary prose are added to each text, so that short ones don't scatter more than long ones
    share = lambda x, n, r, a: np.arcsin(np.sqrt(np.clip((x + r * a) / (n + a), 0, 1)))
    return np.column_stack([
        np.log1p(tok.counts), share(_sums(_MARK[buf] & ~_PLAIN[buf], offs), chars, 0, 200), share(_sums(_PLAIN[buf], offs), chars, 0.024, 200), share(_sums(_UPPER[buf], offs), letters, 0.018, 200),
        share(_sums(_DIGIT[buf], offs), chars, 0, 200), share(again[tok.first[1:]] - again[tok.first[:-1]], count, 0.006, 40), np.log((letters + 40 * 4.9) / (count + 40)), share(_sums(buf == 10, offs), chars, 0.003, 200),
    ])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in K.slices(batch):
            x = statistics(*K.utf8(piece.column(piece.schema.get_field_index("text"))))
            keep = [n for n in piece.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([piece.column(n) for n in keep] + [pa.array(x[:, k]) for k in range(P)], names=[*keep, *(f"x{k}" for k in range(P))])


def chi2_quantile(p: float, df: int) -> float:
    """By Wilson and Hilferty's cube of a normal quantile."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return df * (1 - 2 / (9 * df) + z * math.sqrt(2 / (9 * df))) ** 3


def _whitening(cov: np.ndarray) -> tuple[np.ndarray, float, float]:
    """The lower inverse Cholesky factor of a covariance, its log determinant, and the mean squared distance it leaves.

    In units of FLOOR, eigenvalues under 1 are raised to 1 and others left; the mean is P less what the raised ones lack.
    """
    w, v = np.linalg.eigh(cov / np.outer(FLOOR, FLOOR))
    raised = np.maximum(w, 1)
    low = np.linalg.cholesky(((v * raised) @ v.T) * np.outer(FLOOR, FLOOR))
    return np.linalg.inv(low), float(2 * np.log(np.diag(low)).sum()), float((np.maximum(w, 0) / raised).sum())


_ESTIMATE = "grp string, start int, n double, logdet double, df double, half double, mean array<double>, white array<double>"


def _row(grp, start, n, half, mean, cov) -> dict:
    white, logdet, df = _whitening(cov)
    return {"grp": grp, "start": start, "n": n, "logdet": logdet, "df": df, "half": half, "mean": mean.tolist(), "white": white[np.tril_indices(P)].tolist()}


def _concentrate(h: float):
    """A group's bins to its next estimate: the closest bins that hold h of its rows."""

    def run(key: tuple, bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        n, total = bins["n"].to_numpy(), bins["n"].sum()
        k = int(np.searchsorted(np.cumsum(n), h * total - 1e-9)) + 1
        m = n[:k].sum()
        s1 = np.array([bins[f"s{i}"].to_numpy()[:k].sum() for i in range(P)]) / m
        cov = np.zeros((P, P))
        for i, j in _PAIRS:
            cov[i, j] = cov[j, i] = bins[f"q{i}_{j}"].to_numpy()[:k].sum() / m - s1[i] * s1[j]
        cov = (cov + cov.T) / 2
        w, v = np.linalg.eigh(cov)
        cov = (v * np.maximum(w, 0)) @ v.T
        half = 2.0 ** ((bins["bin"].to_numpy()[int(np.searchsorted(np.cumsum(n), 0.5 * total - 1e-9))] + 1) / BINS)
        return pd.DataFrame([_row(key[0], key[1], float(total), half, s1, cov)])

    return run


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. from the joined mean and whitening."""
    out, at = F.lit(0.0), 0
    diff = [F.col(f"x{k}") - F.col("mean")[k] for k in range(P)]
    for i in range(P):
        z = F.lit(0.0)
        for j in range(i + 1):
            z = z + F.col("white")[at] * diff[j]
            at += 1
        out = out + z * z
    return out


def _first(rows: DataFrame) -> DataFrame:
    """Starts 0 (medians and absolute deviations) and 1 (spatial signs about the medians)."""
    middle = rows.groupBy("grp").agg(*[F.percentile_approx(f"x{k}", 0.5, 1000).alias(f"m{k}") for k in range(P)])
    with_m = rows.join(counted(cut(middle)), "grp")
    spread = with_m.groupBy("grp").agg(*[F.percentile_approx(F.abs(F.col(f"x{k}") - F.col(f"m{k}")), 0.5, 1000).alias(f"d{k}") for k in range(P)])
    scaled = [(F.col(f"x{k}") - F.col(f"m{k}")) / F.greatest(1.4826 * F.col(f"d{k}"), F.lit(float(FLOOR[k]))) for k in range(P)]
    norm = F.greatest(F.sqrt(sum((z * z for z in scaled), F.lit(0.0))), F.lit(1e-9))
    signs = with_m.join(counted(cut(spread)), "grp").groupBy("grp").agg(*[F.avg(scaled[i] * scaled[j] / (norm * norm)).alias(f"q{i}_{j}") for i, j in _PAIRS], *[F.first(f"m{k}").alias(f"m{k}") for k in range(P)], *[F.first(f"d{k}").alias(f"d{k}") for k in range(P)], F.count(F.lit(1)).cast("double").alias("n"))

    def starts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                mean = np.array([r[f"m{k}"] for k in range(P)])
                sd = np.maximum(1.4826 * np.array([r[f"d{k}"] for k in range(P)]), FLOOR)
                out.append(_row(r["grp"], 0, r["n"], float("nan"), mean, np.diag(sd**2)))
                s = np.zeros((P, P))
                for i, j in _PAIRS:
                    s[i, j] = s[j, i] = r[f"q{i}_{j}"]
                out.append(_row(r["grp"], 1, r["n"], float("nan"), mean, s * P * np.outer(sd, sd)))
            yield pd.DataFrame(out, columns=["grp", "start", "n", "logdet", "df", "half", "mean", "white"])

    return signs.mapInPandas(starts, _ESTIMATE)


def _levels(lang: str, source: str) -> Column:
    """Names of a row's groups from the narrowest; nulls are a value of their own."""
    part = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.array(F.concat_ws("\x01", F.lit("2"), part(lang), part(source)), F.concat_ws("\x01", F.lit("1"), part(lang)), F.lit("0"))


def robust_distances(docs: DataFrame, h: float = 0.75, steps: int = 4, least: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, distance, level, x0..) of the documents with a text.

    `distance` is the Mahalanobis distance squared, scaled up or down so that its group's
    median is that of the chi-squared distribution with the degrees of freedom that FLOOR
    leaves (up twofold at most: groups of mostly equal texts have a median of 0); `level` tells the group: 2 for language
    and source, 1 language, 0 all. Null languages and sources are values of their
    own. A null text is left out; an empty one is a vector like others; a null
    doc_id stays. Repeated rows each count. Very long texts count whole. No rows: none.
    Starts whose determinants tie: the first; distances that tie fall into one bin, and
    a bin that reaches the share `h` counts whole. Other columns are not read.

    `steps`: the determinant falls with each step and settles within a few; the number
    is fixed, so that every group takes the same passes over the vectors.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    each = cut(rows.mapInArrow(K.tidy(_vectors), "doc_id long, lang string, source string, " + ", ".join(f"x{k} double" for k in range(P))))
    named = each.withColumn("_grp", _levels("lang", "source"))
    spread = named.select(F.explode("_grp").alias("grp"), *[f"x{k}" for k in range(P)])
    estimate = cut(_first(spread))
    for _ in range(steps):
        d = F.greatest(_distance(), F.lit(1e-12))
        binned = spread.join(counted(estimate.select("grp", "start", "mean", "white")), "grp").withColumn("bin", F.floor(F.log2(d) * BINS).cast("int"))
        sums = binned.groupBy("grp", "start", "bin").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"x{k}").alias(f"s{k}") for k in range(P)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in _PAIRS])
        estimate = cut(sums.groupBy("grp", "start").applyInPandas(_concentrate(h), _ESTIMATE))
    best = cut(estimate.groupBy("grp").agg(F.min_by(F.struct("n", "df", "mean", "white"), F.struct("logdet", "start")).alias("e")).select("grp", "e.*"))
    # the medians of the final estimates' distances
    ranked = spread.join(counted(best.select("grp", "mean", "white")), "grp").select("grp", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-12))) * BINS * 4).alias("bin"))
    bins = ranked.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("c"))
    up = F.sum("c").over(Window.partitionBy("grp").orderBy("bin")) >= F.sum("c").over(Window.partitionBy("grp")) / 2
    middle = bins.withColumn("up", up).where("up").groupBy("grp").agg(F.min("bin").alias("bin")).select("grp", F.pow(F.lit(2.0), (F.col("bin") + 0.5) / (BINS * 4)).alias("median"))
    df = F.greatest(F.lit(1.0), F.col("df"))
    scale = F.greatest(F.lit(0.5), F.col("median") / (df * F.pow(1 - 2 / (9 * df), F.lit(3))))
    final = cut(best.where((F.col("n") >= least) | (F.col("grp") == "0")).join(middle, "grp").withColumn("scale", scale))
    out = named
    for k, level in enumerate((2, 1, 0)):
        mine = final.where(F.col("grp").startswith(str(level))).select(F.col("grp").alias(f"g{level}"), F.struct("mean", "white", "scale").alias(f"e{level}"))
        out = out.withColumn(f"g{level}", F.col("_grp")[k]).join(counted(mine), f"g{level}", "left")
    chosen = F.coalesce("e2", "e1", "e0")
    level = F.when(F.col("e2").isNotNull(), 2).when(F.col("e1").isNotNull(), 1).otherwise(0)
    out = out.withColumn("_level", level).withColumn("_e", chosen).select("doc_id", "lang", "source", F.col("_level").alias("level"), "_e.*", *[f"x{k}" for k in range(P)])
    return out.select("doc_id", "lang", "source", "level", (_distance() / F.col("scale")).alias("distance"), *[F.col(f"x{k}").alias(STATS[k]) for k in range(P)])


def within(distances: DataFrame, quantile: float = 0.9999) -> DataFrame:
    """The rows whose distance is at most that quantile of the chi-squared distribution."""
    return distances.where(F.col("distance") <= chi2_quantile(quantile, P))
