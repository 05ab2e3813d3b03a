"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A text gets one space in front, is cut into units (runs of spaces with what
follows them; a line feed is a unit of its own), and each unit's agenda of merges
is worked off: the candidate of the best score, the leftmost of equals, is taken
first. A keyed hash of (seed, document, unit's place, candidate's bounds) skips a
candidate with probability `dropout`; it stays skipped. Each occurrence of a unit so
draws for itself. Those of a batch that draw alike share the work: one occurrence's
agenda is worked off, the others' draws are held against its own, and those that
differ go on in groups by the first difference. One numpy pass takes the next merge
of all agendas.

Characters outside the vocabulary, and literal U+2581, become byte pieces, so that
decoding gives back every text.
"""

from __future__ import annotations

import heapq
import importlib.util
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .jobs import usable

U = np.uint64
NONE = np.int32(2**31 - 1)
#: Symbols of a unit from which its agenda is a heap of its own.
LONG = 64
#: Bytes of text whose units are worked off together.
PIECE = 1 << 20
#: Draws of occurrences that are compared at a time.
DRAWS = 1 << 18


def default_model() -> str:
    """The model file of the installed package of public tokenizers."""
    spec = importlib.util.find_spec("public_tokenizers")
    root = Path(spec.origin).parent if spec and spec.origin else Path("/opt/tokenizers")
    return str(root / "piece_bpe_32k.model")


class Vocabulary:
    """Pieces, their bytes, and which two pieces merge into which, with what rank (0 is first)."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        self.size = n
        self.byte = np.zeros(256, np.int32)
        self.first_byte = sp.piece_to_id("<0x00>")
        raw: list[bytes] = []
        normal: dict[str, int] = {}
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                normal[p] = i
                raw.append(p.replace("▁", " ").encode())
        self.length = np.array([len(r) for r in raw], np.int64)
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.start = np.cumsum(self.length) - self.length
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.char[32], self.char[0x2581] = self.char[0x2581], -1
        scores = np.array([-sp.get_score(i) for i in range(n)])
        rank = np.unique(scores, return_inverse=True)[1].astype(np.int32)
        left, right, merged = [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        keys = (np.array(left, U) << U(32)) | np.array(right, U)
        merged = np.array(merged, np.int32)
        self.rank = rank
        self.tables = []
        for bits, salt in ((21, 0x9E3779B97F4A7C15), (17, 0xC2B2AE3D27D4EB4F), (14, 0x165667B19E3779F9), (12, 0xD6E8FEB86659FD93)):
            slot = (keys * U(salt)) >> U(64 - bits)
            _, first = np.unique(slot, return_index=True)
            table, value = np.full(1 << bits, 2**64 - 1, U), np.full(1 << bits, -1, np.int32)
            table[slot[first]], value[slot[first]] = keys[first], merged[first]
            self.tables.append((U(salt), U(64 - bits), table, value))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, merged = keys[rest], merged[rest]
        if len(keys):
            raise ValueError("merge table overflow")

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that a and b make, or -1."""
        ok = (a >= 0) & (b >= 0)
        keys = (a.astype(U) << U(32)) | (b.astype(np.int64) & 0xFFFFFFFF).astype(U)
        out = np.full(len(a), -1, np.int32)
        for salt, shift, table, value in self.tables:
            slot = (keys * salt) >> shift
            hit = table[slot] == keys
            out[hit] = value[slot[hit]]
        out[~ok] = -1
        return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _where(start: np.ndarray, mid: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the candidates [start, mid) + [mid, end)."""
    return K.mix(((start.astype(U) << U(42)) ^ (mid.astype(U) << U(21)) ^ end.astype(U)) + U(0x51ED270B))


def _skipped(key: np.ndarray, where: np.ndarray, dropout: float) -> np.ndarray:
    """Whether keyed hashes skip these candidates of occurrences with these keys."""
    return K.mix(key ^ where) < U(min(int(dropout * 2**64), 2**64 - 1))


def _agendas(v: Vocabulary, sym: np.ndarray, unit: np.ndarray, key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Works off the agendas of units (`unit` names each symbol's, in order; `key` is each unit's hash).

    Symbols, their units, and with dropout the draws in order: unit, candidate, whether skipped.
    """
    done_s, done_u, done_p = [], [], []
    draws: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    n = len(sym)
    first = np.ones(n, bool)
    first[1:] = unit[1:] != unit[:-1]
    begin = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    size = np.bincount(unit, minlength=len(key))
    sym, unit, begin = sym.copy(), unit.copy(), begin.astype(np.int64)

    def candidates(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of the pair that starts at each of `at`."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        same = (at + 1 < len(sym)) & (unit[nxt] == unit[at])
        piece = np.full(len(at), -1, np.int32)
        piece[same] = v.merge(sym[at[same]], sym[nxt[same]])
        rank = np.full(len(at), NONE)
        good = piece >= 0
        rank[good] = v.rank[piece[good]]
        return rank, piece

    rank, piece = candidates(np.arange(n))
    while len(sym):
        first = np.ones(len(sym), bool)
        first[1:] = unit[1:] != unit[:-1]
        head = np.flatnonzero(first)
        order = (rank.astype(np.int64) << 32) | np.arange(len(sym))
        best = np.minimum.reduceat(order, head)
        live = (best >> 32) < NONE
        count = np.diff(np.append(head, len(sym)))
        if not live.all():
            over = np.repeat(~live, count)
            done_s.append(sym[over])
            done_u.append(unit[over])
            done_p.append(begin[over])
        at = best[live] & 0xFFFFFFFF
        keep = np.repeat(live, count)
        if dropout > 0 and len(at):
            over = np.minimum(at + 2, len(sym) - 1)
            stop = np.where((at + 2 < len(sym)) & (unit[over] == unit[at]), begin[over], size[unit[at]])
            where = _where(begin[at], begin[at + 1], stop)
            skip = _skipped(key[unit[at]], where, dropout)
            draws.append((unit[at], where, skip))
            rank[at[skip]], piece[at[skip]] = NONE, -1
            at = at[~skip]
        sym[at] = piece[at]
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        sym, unit, begin, rank, piece = sym[keep], unit[keep], begin[keep], rank[keep], piece[keep]
        at = place[at]
        if not len(sym):
            break
        fresh = np.concatenate([at, at[(at > 0) & (unit[at - 1] == unit[at])] - 1])
        rank[fresh], piece[fresh] = candidates(fresh)
    sym, unit, begin = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_s, done_u, done_p))
    order = np.lexsort((begin, unit))
    drawn = tuple(np.concatenate(x) for x in zip(*draws, strict=True)) if draws else (np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, bool))
    by = np.argsort(drawn[0], kind="stable")
    return sym[order].astype(np.int32), unit[order], tuple(x[by] for x in drawn)


def _first_difference(group: np.ndarray, key: np.ndarray, groups: int, drawn: tuple[np.ndarray, np.ndarray, np.ndarray], dropout: float) -> np.ndarray:
    """The number of each occurrence's first draw that isn't as in its group's agenda; -1 if all are."""
    unit, where, skip = drawn
    many = np.bincount(unit, minlength=groups)
    start = np.cumsum(many) - many
    out = np.full(len(group), -1, np.int64)
    some = np.flatnonzero(many[group] > 0)
    ends = np.cumsum(many[group[some]])
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + DRAWS, side="right")))
        rows = some[at:to]
        size = many[group[rows]]
        number = K.ragged(size)
        take = np.repeat(start[group[rows]], size) + number
        differs = _skipped(np.repeat(key[rows], size), where[take], dropout) != skip[take]
        least = np.minimum.reduceat(np.where(differs, number, NONE), np.cumsum(size) - size)
        out[rows] = np.where(least < NONE, least, -1)
        at = to
    return out


def _cut_units(v: Vocabulary, sym: np.ndarray, unit: np.ndarray, back: np.ndarray, key: np.ndarray, dropout: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segmentations of all occurrences (`back` names each one's unit, `key` its draws).

    The symbols of the distinct segmentations on end, each segmentation's length, and which one each occurrence has.
    """
    count = np.bincount(unit)
    begin = np.cumsum(count) - count
    which = np.zeros(len(back), np.int64)
    symbols, lengths, made = [], [], 0
    long_ = count[back] > LONG
    for i in np.flatnonzero(long_):
        u = back[i]
        got = np.array([g[0] for g in _long_agenda(v, sym[begin[u] : begin[u] + count[u]].tolist(), int(key[i]), dropout)], np.int32)
        symbols.append(got)
        lengths.append(np.array([len(got)]))
        which[i] = made
        made += 1
    left = np.flatnonzero(~long_)
    group = back[left]
    while len(left):
        _, lead, group = np.unique(group, return_index=True, return_inverse=True)
        of = back[left[lead]]
        size = count[of]
        out_s, out_u, drawn = _agendas(v, sym[np.repeat(begin[of], size) + K.ragged(size)], np.repeat(np.arange(len(of)), size), key[left[lead]], dropout)
        symbols.append(out_s)
        lengths.append(np.bincount(out_u, minlength=len(of)))
        which[left] = made + group
        made += len(of)
        if not dropout:
            break
        differs = _first_difference(group, key[left], len(of), drawn, dropout)
        go = np.flatnonzero(differs >= 0)
        left, group = left[go], (group[go] << 32) | differs[go]
    return np.concatenate(symbols), np.concatenate(lengths), which


def _long_agenda(v: Vocabulary, sym: list[int], key: int, dropout: float) -> list[tuple[int, int]]:
    """One unit's agenda as a heap: (symbol, first symbol's place) of the outcome."""
    n = len(sym)
    after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(pairs: list[tuple[int, int]]) -> None:
        if not pairs:
            return
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        sa, sb = np.array([sym[p] for p in a], np.int32), np.array([sym[p] for p in b], np.int32)
        m = v.merge(sa, sb)
        stop = np.array([end[p] for p in b])
        skip = _skipped(np.full(len(a), key, U), _where(a, b, stop), dropout) if dropout else np.zeros(len(a), bool)
        for i in np.flatnonzero((m >= 0) & ~skip):
            heapq.heappush(heap, (int(v.rank[m[i]]), int(a[i]), int(b[i]), int(m[i]), int(stop[i])))

    offer([(i, i + 1) for i in range(n - 1)])
    alive = [True] * n
    while heap:
        _, a, b, m, stop = heapq.heappop(heap)
        if not (alive[a] and b < n and alive[b] and after[a] == b and end[b] == stop):
            continue
        sym[a], end[a], after[a], alive[b] = m, end[b], after[b], False
        if after[a] < n:
            before[after[a]] = a
        offer(([(before[a], a)] if before[a] >= 0 else []) + ([(a, after[a])] if after[a] < n else []))
    return [(sym[i], i) for i in range(n) if alive[i]]


def _symbols(v: Vocabulary, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of UTF-8 rows as pieces (-1 - first byte's place for others), their rows and byte lengths."""
    begin = np.flatnonzero((buf & 0xC0) != 0x80)
    size = np.diff(np.append(begin, len(buf)))
    code = buf[begin].astype(np.int64)
    for width, mask in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        at = np.flatnonzero(size == width)
        c = code[at] & mask
        for k in range(1, width):
            c = (c << 6) | (buf[begin[at] + k] & 0x3F)
        code[at] = c
    piece = v.char[np.minimum(code, 0x10FFFF)].astype(np.int64)
    sym = np.where(piece >= 0, piece, -1 - begin)
    row = np.searchsorted(offs, begin, side="right") - 1
    return sym, row, size


def encode(v: Vocabulary, buf: np.ndarray, offs: np.ndarray, who: np.ndarray, dropout: float = 0.1, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all rows on end, and how many each has. `who`: each row's key, by which its units' merges are drawn."""
    rows = len(offs) - 1
    size = np.diff(offs)
    lead = size > 0
    new = np.zeros(rows + 1, np.int64)
    np.cumsum(size + lead, out=new[1:])
    text = np.full(new[-1], 32, np.uint8)
    own = np.ones(len(text), bool)
    own[new[:-1][lead]] = False
    text[own] = buf
    del own
    n = len(text)
    if not n:
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    edge = np.zeros(n, bool)
    space, feed = text == 32, text == 10
    edge[1:] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    edge[new[:-1][lead]] = True
    start = np.flatnonzero(edge)
    end = np.append(start[1:], n)
    sums = np.zeros(n + 1, U)
    value = text.astype(U)
    value += U(1)
    value *= K._pow_table(K._BASE, n)
    np.cumsum(value, out=sums[1:])
    del value, space, feed, edge
    name = K.mix((sums[end] - sums[start]) * K._pow_table(pow(K._BASE, -1, 1 << 64), n)[start] + (end - start).astype(U))
    del sums
    row = np.searchsorted(new, start, side="right") - 1
    key = K.mix(name ^ U(seed * 0x2545F4914F6CDD1D % 2**64))
    if dropout > 0:
        nth = np.arange(len(start)) - np.searchsorted(start, new[:-1])[row]
        place = K.mix(who[row] ^ K.mix(nth.astype(U) + U(seed % 2**63)))
        key = K.mix(key + place)
    _, at, back = np.unique(name, return_index=True, return_inverse=True)
    # the distinct units' bytes on end
    width = (end - start)[at]
    at = np.repeat(start[at], width) + K.ragged(width)
    own = text[at]
    bounds = np.zeros(len(width) + 1, np.int64)
    np.cumsum(width, out=bounds[1:])
    sym, unit, chars = _symbols(v, own, bounds)
    out_s, per, which = _cut_units(v, sym, unit, back, key, dropout)
    out_u = np.repeat(np.arange(len(per)), per)
    # others than pieces become bytes
    other = np.flatnonzero(out_s < 0)
    many = np.ones(len(out_s), np.int64)
    if len(other):
        first = -1 - out_s[other].astype(np.int64)
        wide = np.zeros(len(own), np.int64)
        begins = np.flatnonzero((own & 0xC0) != 0x80)
        wide[begins] = chars
        many[other] = wide[first]
        spread = np.repeat(out_s.astype(np.int64), many)
        is_other = spread < 0
        spread[is_other] = v.byte[own[-1 - spread[is_other] + K.ragged(many)[is_other]]]
        out_u = np.repeat(out_u, many)
        out_s = spread
    per = np.bincount(out_u, minlength=len(per))
    first = np.cumsum(per) - per
    take = per[which]
    ids = out_s[np.repeat(first[which], take) + K.ragged(take)].astype(np.int32)
    return ids, np.bincount(row, weights=take, minlength=rows).astype(np.int64)


def decode(v: Vocabulary, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows on end and their offsets, without the space in front."""
    size = v.length[ids]
    buf = v.bytes[np.repeat(v.start[ids], size) + K.ragged(size)]
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    offs = np.zeros(len(counts) + 1, np.int64)
    offs[1:] = ends[np.cumsum(counts)]
    head = offs[:-1][np.diff(offs) > 0]
    keep = np.ones(len(buf), bool)
    keep[head] = buf[head] != 32
    gone = np.zeros(len(counts), np.int64)
    gone[np.diff(offs) > 0] = ~keep[head]
    offs[1:] -= np.cumsum(gone)
    return buf[keep], offs


def _encoded(path: str, dropout: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for piece in K.slices(batch, limit=PIECE):
                buf, offs = K.utf8(piece.column(1))
                who = K.mix(piece.column(0).to_numpy().view(U))
                ids, counts = encode(v, buf, offs, who, dropout, seed)
                back, at = decode(v, ids, counts)
                if np.array_equal(at, offs) and np.array_equal(back, buf):
                    same = np.ones(piece.num_rows, bool)
                else:
                    same = np.array([np.array_equal(back[at[i] : at[i + 1]], buf[offs[i] : offs[i + 1]]) for i in range(piece.num_rows)], bool)
                yield pa.record_batch({"doc_id": piece.column(0), "n_tokens": counts, "ids": K.lists(ids, counts), "lossless": same})

    return K.tidy(run)


def encode_documents(docs: DataFrame, path: str | None = None, dropout: float = 0.1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, lossless) of each document; `lossless` tells that the ids decode to the text.

    dropout 0 gives the model's own encoding (but for literal U+2581, which becomes
    bytes here). The same seed, doc_id and text give the same ids in any job.
    Occurrences of a unit draw independently of each other.

    An empty text has no ids. Rows with a null doc_id or text are left out. Repeated
    rows each give one, equal ones. Very long texts and units are encoded whole.
    No rows: none. Other columns are not read.
    """
    if not 0 <= dropout < 1:
        raise ValueError("dropout must be in [0, 1)")
    return usable(docs, id_col, text_col).mapInArrow(_encoded(path or default_model(), dropout, seed), "doc_id long, n_tokens long, ids array<int>, lossless boolean")


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of a column of id arrays; null for null."""
    where = path or default_model()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(where)
        for a in batches:
            counts = np.diff(a.offsets.to_numpy()) if len(a) else np.zeros(0, np.int64)
            buf, offs = decode(v, a.flatten().to_numpy(), counts)
            out = pa.Array.from_buffers(pa.large_utf8(), len(a), [None, pa.py_buffer(offs), pa.py_buffer(buf)]).cast(pa.string())
            yield pc.if_else(a.is_valid(), out, None)

    return run(ids)
