"""Substring dedup by line or paragraph hashing.

Texts are cut into units, units are normalised and hashed (128 bits), and the
digests are grouped over the whole corpus. Of the units with one digest the
earliest ranked stays. Others are removed where they stand in a run: neighbouring
units of a text, all of them repeated, of so many words together. A short unit
that is common in any text stays, while one inside a repeated passage goes with it.
The places of what is removed in the original text are kept.

Passages rarely begin where a line does, so besides lines and paragraphs a unit can
be a sentence, i.e. a line cut after each full stop, exclamation or question mark
that white space follows.

Only digests and places leave the texts. A unit that is everywhere is no hot spot:
its first occurrence is a minimum, which aggregates partially, and the join back is
one that adaptive execution can split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as K
from .jobs import usable

#: What ends a unit, with the bytes that still belong to it in front. Units and what is between them make up the text.
_END = {"line": re.compile(rb"\n"), "paragraph": re.compile(rb"\n[ \t\r\x0b\f]*\n"), "sentence": re.compile(rb"\n|(?<=[.!?])(?=[ \t\r\x0b\f])")}
_PLACE = "doc_id long, rank long, text_hash long, seq int, unit_no int, start int, n_chars int, n_words int"


def _units(unit: str):
    end = _END[unit]
    digest = xxhash.xxh3_128_digest
    text_digest = xxhash.xxh3_64_intdigest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch):
                owner, seq, number, start, size, count, digests, hashes = [], [], [], [], [], [], [], []
                for row, text in enumerate(piece.column(1).to_pylist()):
                    raw = text.encode("utf-8", "surrogatepass")
                    plain = len(raw) == len(text)
                    own = text_digest(raw)
                    low = raw.lower() if plain else None
                    at = no = k = chars = 0
                    stops = [m.span() for m in end.finditer(raw)]
                    stops.append((len(raw), len(raw)))
                    for stop, after in stops:
                        part = raw[at:stop] if plain else raw[at:stop].decode("utf-8", "surrogatepass")
                        words = low[at:stop].split() if plain else part.lower().encode("utf-8", "surrogatepass").split()
                        if words:
                            owner.append(row)
                            seq.append(k)
                            number.append(no)
                            start.append(chars)
                            size.append(len(part))
                            count.append(len(words))
                            digests.append(digest(b" ".join(words)))
                            hashes.append(own)
                            k += 1
                        chars += len(part) + after - stop
                        at = after
                        no += 1
                ids, ranks = (piece.column(c).take(pa.array(owner, pa.int32())) for c in (0, 2))
                whole = lambda x: pa.array(x, pa.int32())
                yield pa.record_batch({"digest": pa.array(digests, pa.binary()), "doc_id": ids, "rank": ranks, "text_hash": pa.array(hashes, pa.uint64()).view(pa.int64()), "seq": whole(seq), "unit_no": whole(number), "start": whole(start), "n_chars": whole(size), "n_words": whole(count)})

    return K.tidy(run)


def units(docs: DataFrame, unit: str = "line", id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None) -> DataFrame:
    """(digest, doc_id, rank, text_hash, seq, unit_no, start, n_chars, n_words) of each unit that has a word.

    `start` counts characters and unit_no units, both from 0, in the original text; `seq`
    counts the units that have words. `rank` is that column, doc_id where none is named.
    """
    if unit not in _END:
        raise ValueError("unit must be line, paragraph or sentence")
    rank = F.col(rank_col or id_col).cast("long")
    texts = usable(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(rank, F.lit(2**63 - 1)).alias("rank")), more=("rank",))
    return texts.mapInArrow(_units(unit), f"digest binary, {_PLACE}")


def repeated_units(docs: DataFrame, unit: str = "line", min_words: int = 25, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None) -> DataFrame:
    """The units to remove: (doc_id, unit_no, start, n_chars, first_doc_id, first_unit_no, copies).

    A unit is a line, a paragraph (cut at empty lines), or a sentence (a line cut after
    `.`, `!` or `?` before white space, which belongs to the next one). Two units are
    equal if they are so in lower case with each run of ASCII white space as one space
    and none at the ends. Of equal units the first stays, the one with the least
    (rank, doc_id, unit_no), named as first; `copies` counts all of them. `rank_col`
    names a column of whole numbers to rank by, nulls last; without it doc_id ranks.

    The others are repeated. Repeated units that follow each other in a text, units
    without words between them left out, form a run; a run of `min_words` words or more
    is removed, a shorter one stays. With 1 every repeated unit goes.

    Null doc_id or text: not read. Rows of one doc_id with equal texts are one document,
    though copies counts each; other texts of it are documents of their own, and units
    of theirs that tie with the first (same doc_id and unit_no) stay. Very long texts are
    taken whole. No rows: no units. Other columns are not read.
    """
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    each = units(docs, unit, id_col, text_col, rank_col)
    first = each.groupBy("digest").agg(F.min(F.struct("rank", "doc_id", "unit_no")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    gone = each.join(first, "digest").where("(rank, doc_id, unit_no) <> first").drop("digest").dropDuplicates(["doc_id", "text_hash", "seq"])
    text = Window.partitionBy("doc_id", "text_hash")
    gone = gone.withColumn("run", F.col("seq") - F.row_number().over(text.orderBy("seq")))
    gone = gone.withColumn("words", F.sum("n_words").over(Window.partitionBy("doc_id", "text_hash", "run"))).where(F.col("words") >= min_words)
    long = lambda c: F.col(c).cast("long").alias(c)
    return gone.select("doc_id", long("unit_no"), long("start"), long("n_chars"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.unit_no").cast("long").alias("first_unit_no"), "copies")
