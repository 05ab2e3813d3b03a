"""Licence scans by a trained paragraph classifier.

1. Paragraphs (lines) of templates of the licence families, alone, wrapped and
   embedded in prose, and paragraphs without a licence, train a logistic regression
   of several classes over the presence of word 1- to 3-grams. The weights are
   sparse: n-grams below a bound go, and the rest is fitted again.
2. Held-out examples calibrate the class "unknown": a temperature for the
   probabilities, and the probability under which a paragraph counts as unknown,
   so that at most `false_rate` of the held-out paragraphs without a licence pass.
3. A prediction is confirmed if the paragraph's 3-grams overlap those of one of the
   family's templates, measured against the smaller of the two sets.

Paragraphs are cut, hashed and scored a batch at a time; a paragraph without any
n-gram of the model never leaves numpy. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import licences
from . import textkit as K
from .jobs import cut, usable
from .quality_bayes import words

U = np.uint64
#: n-grams of a template for its comparison.
SHINGLE = 3


def _lines(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the lines of all rows on end (a line feed belongs to the line it ends), and each line's row."""
    n = len(buf)
    at = np.flatnonzero(buf == 10) + 1
    bounds = np.union1d(at[at < n], offs[:-1][np.diff(offs) > 0])
    return np.append(bounds, n).astype(np.int64), np.searchsorted(offs, bounds, side="right") - 1


def features(buf: np.ndarray, offs: np.ndarray, keep=None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of each row's word 1- to 3-grams; `keep` tells which hashes matter."""
    tok = words(buf, offs)
    rows = tok.rows()
    got_r, got_h = [], []
    h = tok.hash
    for n in (1, 2, 3):
        if n > 1:
            if len(tok.hash) < n:
                break
            h = K.mix(h[:-1] * U(0x9FB21C651E98DF25) + tok.hash[n - 1 :])
        ok = rows[: len(h)] == rows[n - 1 :] if n > 1 else np.ones(len(h), bool)
        if keep is not None:
            ok = ok & keep(h)
        got_r.append(rows[: len(h)][ok])
        got_h.append(h[ok])
    r, h = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((got_r, np.int64), (got_h, U)))
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


def _shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, hash) of word 3-grams; a row of one or two words has one of all its words."""
    h, r = K.grams(words(buf, offs), SHINGLE)
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return r[new], h[new]


@dataclass(frozen=True)
class Model:
    """keys: sorted n-gram hashes; weights: a row each, a column a family, the first unknown; templates by family."""

    families: tuple[str, ...]
    keys: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float
    sieve: np.ndarray
    names: tuple[str, ...]
    owner: np.ndarray
    shingles: np.ndarray
    shingle_template: np.ndarray
    sizes: np.ndarray

    def known(self, h: np.ndarray) -> np.ndarray:
        """Which hashes are keys."""
        out = self.sieve[(h >> U(44)).astype(np.int64)]
        at = np.flatnonzero(out)
        x = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        out[at] = self.keys[x] == h[at]
        return out

    def probabilities(self, r: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
        score = np.tile(self.bias, (rows, 1))
        np.add.at(score, r, self.weights[np.searchsorted(self.keys, h)])
        score /= self.temperature
        score = np.exp(score - score.max(1, keepdims=True))
        return score / score.sum(1, keepdims=True)

    def compare(self, buf: np.ndarray, offs: np.ndarray, family: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's best template of its family, and the overlap with it."""
        rows = len(offs) - 1
        r, h = _shingles(buf, offs)
        size = np.maximum(np.bincount(r, minlength=rows), 1)
        lo, hi = np.searchsorted(self.shingles, h, side="left"), np.searchsorted(self.shingles, h, side="right")
        n = hi - lo
        t = self.shingle_template[np.repeat(lo, n) + K.ragged(n)]
        rr = np.repeat(r, n)
        mine = self.owner[t] == family[rr]
        code, common = np.unique(rr[mine] * len(self.names) + t[mine], return_counts=True)
        rr, t = code // len(self.names), code % len(self.names)
        similar = common / np.minimum(size[rr], self.sizes[t])
        best, overlap = np.full(rows, -1), np.zeros(rows)
        order = np.lexsort((t, -self.sizes[t], -similar, rr))  # the longest of the equally similar, then the first
        rr, t, similar = rr[order], t[order], similar[order]
        first = np.flatnonzero(np.concatenate([[True], rr[1:] != rr[:-1]])) if len(rr) else np.zeros(0, np.int64)
        best[rr[first]], overlap[rr[first]] = t[first], similar[first]
        return best, overlap


def _fit(x: np.ndarray, y: np.ndarray, classes: int, ridge: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression of several classes, by accelerated gradient steps. Equal rows are one, with the counts of their classes."""
    n, most = len(y), max(float((x.sum(1) + 1).mean()), 1.0)
    _, first, back = np.unique(np.packbits(x > 0, axis=1), axis=0, return_index=True, return_inverse=True)
    x = x[first]
    target = np.zeros((len(x), classes), np.float32)
    np.add.at(target, (back.reshape(-1), y), 1)
    times = target.sum(1, keepdims=True)
    w, b = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    vw, vb = w, b
    rate = np.float32(1 / (0.5 * most / 4 + ridge))
    for k in range(steps):
        s = x @ vw + vb
        s = np.exp(s - s.max(1, keepdims=True))
        g = (s / s.sum(1, keepdims=True) * times - target) / n
        nw, nb = vw - rate * (x.T @ g + np.float32(ridge / n) * vw), vb - rate * g.sum(0)
        vw, vb = nw + (nw - w) * np.float32(k / (k + 3)), nb + (nb - b) * np.float32(k / (k + 3))
        w, b = nw, nb
    return w, b


def train(background: list[str], seed: int = 17, false_rate: float = 0.001, ridge: float = 0.1, steps: int = 300, sparse: float = 0.02) -> Model:
    """The model from the built-in templates and paragraphs of `background` that have no licence."""
    texts, family = licences.examples(background, seed)
    names = ("", *sorted(licences.NAMES))
    y = np.array([names.index(f) for f in family])
    buf, offs = K.utf8(pa.array(texts, pa.string()))
    r, h = features(buf, offs)
    keys, inv = np.unique(h, return_inverse=True)
    # only n-grams of the templates count: what is around them says nothing, and long prose holds much of it
    own = np.unique(features(*K.utf8(pa.array([t for _, _, t in licences.templates()], pa.string())))[1])
    named = np.zeros(len(keys), np.int64)
    np.add.at(named, inv, y[r] > 0)
    picked = np.flatnonzero((named >= 4) & np.isin(keys, own))
    column = np.full(len(keys), -1)
    column[picked] = np.arange(len(picked))
    c = column[inv]
    x = np.zeros((len(texts), len(picked)), np.float32)
    x[r[c >= 0], c[c >= 0]] = 1
    keys = keys[picked]
    held = (K.mix(np.arange(len(y), dtype=U) + U(seed)) % U(4)) == 0
    w, b = _fit(x[~held], y[~held], len(names), ridge, steps)
    live = np.abs(w).max(1) >= sparse
    keys, x = keys[live], x[:, live]
    w, b = _fit(x[~held], y[~held], len(names), ridge, steps)
    score = (x[held] @ w + b).astype(float)
    true = y[held]

    def soft(t: float) -> np.ndarray:
        s = np.exp((score - score.max(1, keepdims=True)) / t)
        return s / s.sum(1, keepdims=True)

    temperature = min(np.geomspace(0.2, 5, 33), key=lambda t: -np.log(np.maximum(soft(t)[np.arange(len(true)), true], 1e-12)).mean())
    p = soft(temperature)
    none = np.sort(np.where(p.argmax(1) > 0, p[:, 1:].max(1), 0)[true == 0])[::-1]
    over = int(false_rate * len(none))
    least = max(0.5, float(np.nextafter(none[over], 2)) if over < len(none) else 0.5)
    tmpl = licences.templates()
    tb, to = K.utf8(pa.array([t for _, _, t in tmpl], pa.string()))
    tr, th = _shingles(tb, to)
    order = np.argsort(th, kind="stable")
    sieve = np.zeros(1 << 20, bool)
    sieve[(keys >> U(44)).astype(np.int64)] = True
    return Model(names, keys, w.astype(float), b.astype(float), float(temperature), min(least, 0.99), sieve, tuple(n for _, n, _ in tmpl), np.array([names.index(f) for f, _, _ in tmpl]), th[order], tr[order], np.bincount(tr, minlength=len(tmpl)))


_NAMED = re.compile(r"licen[cs]|spdx|\bgpl|creative commons|\bcc[ -]?(by|0)", re.IGNORECASE)


def _background(per_document: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = [], []
            for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [x for x in text.split("\n") if x.strip() and not _NAMED.search(x)]
                for x in own[:: max(1, -(-len(own) // per_document))]:
                    ids.append(i)
                    lines.append(x)
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "x": pa.array(lines, pa.string())})

    return K.tidy(run)


def background(docs: DataFrame, max_background: int, per_document: int, seed: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x) of the lines that `train_on` takes for examples without a licence."""
    keys = usable(docs, id_col, text_col).select("doc_id", F.xxhash64("doc_id", F.lit(seed)).alias("h"), F.xxhash64("text").alias("t"))
    picked = cut(keys.orderBy("h", "doc_id", "t").limit(max_background).select("doc_id").distinct())
    sample = usable(docs, id_col, text_col).join(F.broadcast(picked), "doc_id", "left_semi")  # max_background ids at most
    # lines are cut in Arrow batches: an expression over `text` would be pushed below the join and run on every document
    return sample.mapInArrow(_background(per_document), "doc_id long, x string").distinct()


def train_on(docs: DataFrame, max_background: int = 2000, per_document: int = 8, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trains with lines of the `max_background` documents of the least hash as examples without a licence.

    The sample is bounded by `max_background`, and by `per_document` evenly spaced lines
    of each; lines that name a licence are left out of it. Null doc_id or text: not
    read. Repeated rows and equal lines of a doc_id count once; ties of the hash go by
    doc_id, then text. Very long texts are cut whole. Without rows the built-in prose is
    all there is. Other columns are not read.
    """
    return train([r["x"] for r in background(docs, max_background, per_document, seed, id_col, text_col).orderBy("doc_id", "x").collect()], seed)


def _scan(model: Model, confirm: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch):
                buf, offs = K.utf8(piece.column(1))
                if not len(buf):
                    continue
                bounds, row = _lines(buf, offs)
                r, h = features(buf, bounds, model.known)
                lines, r = np.unique(r, return_inverse=True)
                if not len(lines):
                    continue
                p = model.probabilities(r, h, len(lines))
                best = p.argmax(1)
                prob = p[np.arange(len(lines)), best]
                hit = np.flatnonzero((best > 0) & (prob >= model.least))
                if not len(hit):
                    continue
                lines, family, prob = lines[hit], best[hit], prob[hit]
                size = bounds[lines + 1] - bounds[lines]
                own = np.zeros(len(lines) + 1, np.int64)
                np.cumsum(size, out=own[1:])
                text = buf[np.repeat(bounds[lines], size) + K.ragged(size)]
                template, overlap = model.compare(text, own, family)
                chars = K.char_index(buf)
                owner, begin, end = row[lines], bounds[lines], bounds[lines + 1]
                end = end - (buf[end - 1] == 10)
                yield pa.record_batch({
                    "doc_id": piece.column(0).take(pa.array(owner)), "start": chars[begin] - chars[offs[owner]], "end": chars[end] - chars[offs[owner]],
                    "family": pa.array([model.families[f] for f in family], pa.string()), "probability": prob,
                    "template": pa.array([model.names[t] if t >= 0 else None for t in template], pa.string()), "overlap": overlap, "confirmed": overlap >= confirm,
                })

    return K.tidy(run)


def licence_scan(docs: DataFrame, model: Model, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, family, probability, template, overlap, confirmed) of each paragraph that is taken for a licence notice.

    `start` and `end` count characters from 0 in the original text. `template` is the
    family's template that shares the largest part of the smaller 3-gram set, null if
    none shares any; `confirmed` tells that the part is `confirm` or more. Paragraphs of
    the class unknown, or below the calibrated probability, are not in the result.

    A paragraph is a line. Null doc_id or text: not read. Empty texts and lines have
    no findings. Repeated rows each give theirs. Equally good templates: the longest,
    then the first by name. Very long texts and lines are scanned whole. No rows: no findings.
    Other columns are not read.
    """
    return usable(docs, id_col, text_col).mapInArrow(_scan(model, confirm), "doc_id long, start long, end long, family string, probability double, template string, overlap double, confirmed boolean")
