"""Suffix-array dedup: passages of at least L words that occur earlier in the corpus.

A word window of length L is a repeat if the same L words start earlier, in the
order (doc_id, text hash, word), and, within one text, end before it starts.
A word is removed if a repeat covers it.

Suffixes are sorted only from the words that can start one bucket's work:

1. Every window is owned by the leftmost least k-gram in it (its anchor; equal
   windows have it at the same place). Anchors whose k-gram occurs once in the
   corpus own no repeat and go.
2. Splitters are sampled from the leading words of the remaining anchors'
   suffixes; an anchor goes with the words of all windows that it owns to the
   bucket of its leading words. Leading words so frequent that several splitters
   are equal are spread over the buckets between these.
3. A bucket sorts its suffixes by multikey quicksort, breadth first: one packed
   symbol of words at a time, and only runs that are still equal go on. Runs
   equal over L words have a common prefix of L or more.
4. Suffixes whose leading words cross bucket boundaries are compared with those
   of the neighbouring buckets in a second step.
5. Overlapping repeats of a text are merged into spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .jobs import cut, partitions, release, usable

U = np.uint64
SYMBOL = 10  # words in one packed symbol of the sort
HELD = 1_000_000  # words of a bucket that are sorted at once; suffixes of the same leading words stay together
_B = 0xD6E8FEB86659FD93


def anchors(tok: K.Tokens, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor word, first and last window start that it owns, and its k-gram, in word positions of the piece."""
    h, m = tok.hash, len(tok.hash)
    none = np.zeros(0, np.int64)
    if m < length:
        return none, none, none, np.zeros(0, U)
    gram = h[: m - k + 1].copy()
    for q in range(1, k):
        gram = K.mix(gram * U(_B) + h[q : m - k + 1 + q])
    bits = U(max(int(m).bit_length(), 1))
    low = ((gram >> bits) << bits) | np.arange(len(gram), dtype=U)
    width, have = length - k + 1, 1
    while have < width:
        step = min(have, width - have)
        low = np.minimum(low[: len(low) - step], low[step:])
        have += step
    rows = tok.rows()
    start = np.flatnonzero(rows[: m - length + 1] == rows[length - 1 :])
    if not len(start):
        return none, none, none, np.zeros(0, U)
    at = (low[start] & ((U(1) << bits) - U(1))).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (rows[start[1:]] != rows[start[:-1]])]))
    last = np.append(new[1:], len(start)) - 1
    return at[new], start[new], start[last], gram[at[new]]


def leading(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """16 bits of each of the four words from `at`, as a signed key."""
    out = np.zeros(len(at), U)
    for q in range(4):
        out = (out << U(16)) | (h[at + q] >> U(48))
    return (out ^ (U(1) << U(63))).view(np.int64)


def _anchor_rows(length: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch):
                tok = K.tokens(piece)
                at, _, _, gram = anchors(tok, length, k)
                if not len(at):
                    continue
                row = np.searchsorted(tok.first, at, side="right") - 1
                take = pa.array(row)
                yield pa.record_batch({"gram": gram.view(np.int64), "key": leading(tok.hash, at), "doc_id": piece.column(0).take(take), "text_hash": piece.column(2).take(take), "place": at - tok.first[row]})

    return K.tidy(run)


def _suffix_rows(length: int, k: int, splitters: np.ndarray):
    """One row an anchor: its bucket, the words of all its windows (32 bits each) and where they start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch):
                tok = K.tokens(piece)
                at, lo, hi, _ = anchors(tok, length, k)
                if not len(at):
                    continue
                row = np.searchsorted(tok.first, at, side="right") - 1
                places = piece.column(3)
                flat, offs = places.flatten().to_numpy(), places.offsets.to_numpy()
                wanted = flat + np.repeat(tok.first[:-1], np.diff(offs))
                keep = np.isin(at, wanted)
                at, lo, hi, row = at[keep], lo[keep], hi[keep], row[keep]
                if not len(at):
                    continue
                key = leading(tok.hash, at)
                left, right = np.searchsorted(splitters, key, side="left"), np.searchsorted(splitters, key, side="right")
                crossing = right > left
                doc, text_hash = (piece.column(q).take(pa.array(row)).to_numpy() for q in (0, 2))
                spread = (K.mix(doc.view(U) ^ text_hash.view(U)) % (right - left + 1).astype(U)).astype(np.int64)
                n = hi - lo + length
                chars = K.char_index(tok.buf)
                begins = np.append(chars[tok.start], 0)
                ends = chars[tok.offs[1:]]  # characters before the end of each row
                base = chars[tok.offs[:-1]]
                word = np.repeat(lo, n) + K.ragged(n)
                words = (tok.hash[word] >> U(32)).astype(np.uint32)
                edge = np.repeat(lo, n + 1) + K.ragged(n + 1)
                r = np.repeat(row, n + 1)
                place = np.where(edge == tok.first[r + 1], ends[r], begins[np.minimum(edge, len(tok.start))]) - base[r]
                first = place[np.cumsum(n + 1) - (n + 1)]
                gaps = np.diff(place)
                gaps = np.delete(gaps, (np.cumsum(n + 1) - 1)[:-1])
                yield pa.record_batch({
                    "bucket": (left + spread).astype(np.int32), "crossing": crossing, "key": key, "doc_id": doc, "text_hash": text_hash, "word": lo - tok.first[row], "start": first,
                    "words": _slabs(words, n), "gaps": K.lists(gaps.astype(np.int32), n),
                })

    return K.tidy(run)


def _slabs(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    offs = np.zeros(len(n) + 1, np.int32)
    np.cumsum(n * flat.itemsize, out=offs[1:])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(flat))])


def equal_runs(symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort, breadth first: positions that equal another in all symbols, and their run."""
    alive = np.arange(len(symbols[0]))
    run = np.zeros(len(alive), np.int64)
    for s in symbols:
        order = np.lexsort((s[alive], run))
        alive, run = alive[order], run[order]
        x = s[alive]
        new = np.ones(len(alive) + 1, bool)
        new[1:-1] = (run[1:] != run[:-1]) | (x[1:] != x[:-1])
        keep = ~(new[:-1] & new[1:])  # runs of one suffix are in place
        run = np.cumsum(new[:-1])[keep]
        alive = alive[keep]
        if not len(alive):
            break
    return alive, run


_SPANS = "doc_id long, text_hash long, word long, word_end long, start long, end long, first_doc_id long"


def _repeats(run, doc, text_hash, word, length):
    """Of windows in runs of equals: which are removed, and the doc_id of each one's first."""
    order = np.lexsort((word, text_hash, doc, run))
    run, doc, text_hash, word = run[order], doc[order], text_hash[order], word[order]
    head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    first = np.repeat(head, np.diff(np.append(head, len(run))))
    same = (doc == doc[first]) & (text_hash == text_hash[first])
    gone = ~same | (word >= word[first] + length)
    return order[gone], doc[first][gone]


def _sort_bucket(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        del got
        parts = 1 + sum(c.nbytes for c in t.column("words").chunks) // (4 * HELD)
        if parts == 1:
            yield from ordered(t)
            return
        # a large bucket is sorted range by range, in the order of the leading words
        key = t.column("key").to_numpy()
        part = np.searchsorted(np.sort(key)[np.arange(1, parts) * len(key) // parts], key, side="right")
        for k in range(parts):
            if (part == k).any():
                yield from ordered(t.filter(pa.array(part == k)))

    def ordered(t: pa.Table) -> Iterator[pa.RecordBatch]:
        crossing = t.column("crossing").to_numpy()
        doc, text_hash, word, start = (t.column(c).to_numpy() for c in ("doc_id", "text_hash", "word", "start"))
        words = np.concatenate([np.frombuffer(c.buffers()[2], np.uint32)[(o := np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1])[0] // 4 : o[-1] // 4] for c in t.column("words").chunks])
        n = pc.list_value_length(t.column("gaps")).to_numpy().astype(np.int64)
        gaps = np.concatenate([c.flatten().to_numpy() for c in t.column("gaps").chunks]).astype(np.int64)
        base = np.cumsum(n) - n
        # packed symbols: hashes of SYMBOL words from each word on
        sums = np.zeros(len(words) + 1, U)
        np.cumsum(K.mix(words.astype(U) + U(1)) * K._pow_table(_B, len(words)), out=sums[1:])
        inverse = K._pow_table(pow(_B, -1, 1 << 64), len(words))
        count = n - length + 1
        row = np.repeat(np.arange(len(n)), count)
        shift = K.ragged(count)
        at = base[row] + shift
        step = min(SYMBOL, length)
        cuts = [*range(0, length - step, step), length - step]
        symbol = lambda q: K.mix((sums[at + q + step] - sums[at + q]) * inverse[at + q])
        symbols = [symbol(q) for q in cuts]
        place = np.zeros(len(gaps) + 1, np.int64)
        np.cumsum(gaps, out=place[1:])
        local = ~crossing[row]
        inside = np.flatnonzero(local)
        alive, group = equal_runs([s[inside] for s in symbols])
        alive = inside[alive]
        gone, first = _repeats(group, doc[row[alive]], text_hash[row[alive]], word[row[alive]] + shift[alive], length)
        yield from _spans(alive[gone], first, row, shift, at, doc, text_hash, word, start, place, base, length)
        open_ = np.flatnonzero(~local)
        if len(open_):
            whole = symbols[0][open_]
            for s in symbols[1:]:
                whole = K.mix(whole * U(_B) + s[open_])
            r = row[open_]
            begin = start[r] + place[at[open_]] - place[base[r]]
            end = start[r] + place[at[open_] + length] - place[base[r]]
            w = word[r] + shift[open_]
            for q in range(0, len(open_), 1 << 17):
                z = slice(q, q + (1 << 17))
                yield pa.record_batch({"doc_id": doc[r[z]], "text_hash": text_hash[r[z]], "word": w[z], "word_end": w[z] + length, "start": begin[z], "end": end[z], "first_doc_id": pa.nulls(len(r[z]), pa.int64()), "whole": whole[z].view(np.int64)})

    return K.tidy(run)


def _spans(gone, first, row, shift, at, doc, text_hash, word, start, place, base, length):
    """Joins neighbouring removed windows of an anchor into one span."""
    if not len(gone):
        return
    order = np.lexsort((shift[gone], row[gone]))
    gone, first = gone[order], first[order]
    r, s = row[gone], shift[gone]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (s[1:] > s[:-1] + length)]))
    last = gone[np.append(new[1:], len(gone)) - 1]
    head, first = gone[new], np.minimum.reduceat(first, new)
    r = row[head]
    begin = start[r] + place[at[head]] - place[base[r]]
    end = start[r] + place[at[last] + length] - place[base[r]]
    for q in range(0, len(head), 1 << 17):
        z = slice(q, q + (1 << 17))
        yield pa.record_batch({"doc_id": doc[r[z]], "text_hash": text_hash[r[z]], "word": word[r[z]] + shift[head[z]], "word_end": word[r[z]] + shift[last[z]] + length, "start": begin[z], "end": end[z], "first_doc_id": first[z], "whole": pa.nulls(len(r[z]), pa.int64())})


def _compare_across(windows: DataFrame, length: int) -> DataFrame:
    """Windows whose leading words cross boundaries. The first of equal ones is a minimum, which tasks take of their own before rows meet; then each window is held against it."""
    first = windows.groupBy("whole").agg(F.min(F.struct("doc_id", "text_hash", "word")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("whole", "first")
    gone = windows.drop("first_doc_id").join(first, "whole").where((F.col("doc_id") != F.col("first.doc_id")) | (F.col("text_hash") != F.col("first.text_hash")) | (F.col("word") >= F.col("first.word") + length))
    return gone.select("doc_id", "text_hash", "word", "word_end", "start", "end", F.col("first.doc_id").alias("first_doc_id"))


def repeated_spans(docs: DataFrame, length: int = 50, k: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans (doc_id, text_hash, start, end, n_words, first_doc_id) of the words that repeats of `length` words cover.

    `start` and `end` count characters from 0 in the original text; a span ends
    where the next word starts, or at the text's end. first_doc_id is the least
    document that holds the first occurrence of one of the span's windows; the
    first occurrences are in no span.

    Words are runs of bytes other than ASCII white space. Null doc_id or text: not
    read, in no span. Texts of fewer than `length` words, empty ones too: no span.
    Equal rows (doc_id and text) are one document. Rows with one doc_id and
    different texts are different documents, told apart and ordered by text_hash.
    Runs of one repeated word: the first `length` words stay. Very long texts are
    taken whole. No rows: no spans. Other columns are not read.
    """
    if not 4 <= k <= length:
        raise ValueError("k must be from 4 to length")
    spark = docs.sparkSession
    parts = partitions(spark, docs)
    texts = usable(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    rows = texts.mapInArrow(_anchor_rows(length, k), "gram long, key long, doc_id long, text_hash long, place long")
    # a k-gram that is in a third of all texts is one count a task; its rows are a skewed side that adaptive joins split
    often = rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    kept = cut(rows.join(often, "gram", "left_semi").drop("gram"))
    del rows, often
    release(spark)
    splitters = kept.agg(F.percentile_approx("key", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000)).first()[0] if parts > 1 else []
    splitters = np.array(sorted(splitters or []), np.int64)
    places = kept.groupBy("doc_id", "text_hash").agg(F.collect_set("place").alias("places"))
    suffixes = texts.join(places, ["doc_id", "text_hash"]).select("doc_id", "text", "text_hash", "places").mapInArrow(_suffix_rows(length, k, splitters), "bucket int, crossing boolean, key long, doc_id long, text_hash long, word long, start long, words binary, gaps array<int>")
    # equal splitters leave buckets between them for the keys that cross
    found = cut(suffixes.repartitionById(parts, F.col("bucket")).mapInArrow(_sort_bucket(length), _SPANS + ", whole long"))
    del suffixes
    release(spark)
    across = _compare_across(found.where("whole is not null"), length)
    spans = found.where("whole is null").drop("whole").unionByName(across)
    order = Window.partitionBy("doc_id", "text_hash").orderBy("word", "word_end")
    reach = F.max("word_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum((F.col("word") > F.coalesce(reach, F.lit(-1))).cast("int")).over(order)
    return (
        spans.withColumn("island", island).groupBy("doc_id", "text_hash", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), (F.max("word_end") - F.min("word")).alias("n_words"), F.min("first_doc_id").alias("first_doc_id"))
        .drop("island")
    )


def strip_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without the spans' characters, all other columns kept, whatever their names; texts without words left go.

    n_chars, if there, is set anew. Rows that no span names, null and empty ones among
    them, stay as they are. Repeated rows (doc_id and text) are cut alike, very long
    texts whole. Equal spans count once. No rows: none; no spans: all rows.
    """
    cuts = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_cuts"))
    cuts = cuts.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_cuts")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("_hash"))
    text, cut_ = F.col("text"), F.col("_cuts")
    step = F.aggregate(
        cut_, F.struct(F.lit("").alias("t"), F.lit(0).cast("long").alias("at")),
        lambda s, c: F.struct(F.concat(s["t"], F.substring(text, (s["at"] + 1).cast("int"), (c["start"] - s["at"]).cast("int"))).alias("t"), c["end"].alias("at")),
        lambda s: F.concat(s["t"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text))),
    )
    out = packed.join(cuts, ["_id", "_hash"], "left").withColumn("left", F.when(cut_.isNotNull(), step))
    out = out.where(cut_.isNull() | F.col("left").rlike(r"[^ \t\n\x0B\f\r]"))
    row = F.col("row").withField(text_col, F.col("left"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.length("left").cast(docs.schema["n_chars"].dataType))
    return out.select(F.when(cut_.isNull(), F.col("row")).otherwise(row).alias("row")).select("row.*")
