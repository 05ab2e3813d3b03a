"""N-gram Jaccard join: every pair of documents whose word n-gram sets are alike.

The incidence matrix (distinct n-gram sets by n-grams) is cut into blocks of
columns. Each block travels as a compact binary tile, not as one row an entry.

1. A column block counts each n-gram's sets. Only n-grams of two sets or more
   can add to an overlap; their entries go on to the sets' row blocks. Columns that
   the same sets hold, as those of a shared passage, become one weighted column.
2. A set with fewer such n-grams than ceil(t * size) can't reach the threshold
   with anything and is discarded.
3. n-grams are ordered by how many sets hold them. Two sets that reach the
   threshold share one of the first size - ceil(t * size) + 1 n-grams of both,
   so only these are multiplied, within the bounds t * |B| <= |A| <= |B| and the
   overlap still possible after each position.
   What goes on are the sets that a block must compare, not pairs.
4. Each block gets its sets whole and accumulates the overlaps of its pairs in
   full. A pair belongs to the block of the first n-gram that both sets share,
   which the block sees for itself: pairs are never shuffled.

A column that more than HOT sets hold is cut into parts of sets, and each pair of
parts is a block of its own, wherever it is worked on: how many sets hold a column
stands in its name, so that needs no count and no join.

The result is exact (hashes of 64 bits for n-grams and of 57 for columns aside). Identical sets are one row of
the matrix, weighted by their documents. What leaves the blocks is a spanning
forest of their pairs and each set's number of links, so that the result has one
row a document, however large a group is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as K
from .jobs import cut, partitions, release, usable

U = np.uint64
#: Entries that a task holds before it writes tiles.
FLUSH = 1_000_000
#: Pairs that are multiplied at once.
PAIRS = 2_000_000
#: Sets of a block's tile; an n-gram that more sets have in their prefixes is compared tile by tile.
TILE = 1024
#: Earlier n-grams of the set that a posting carries.
BEFORE = 8
#: A column of more sets is multiplied part by part.
HOT = 4096


def _part(gram: np.ndarray, sid: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """How many parts of about `hot` sets each column has, and in which of them the set is. Its name begins with twice the binary logarithm of its sets."""
    times = np.maximum(1, np.ceil(2.0 ** ((np.arange(64) + 1) / 2) / hot)).astype(np.int64)[gram >> 57]
    return times, ((K.mix(sid.view(U)) >> U(11)).astype(np.int64)) % times


def _met(part: np.ndarray, times: np.ndarray, pair: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a block of a pair of parts is the one where the rows i and j meet."""
    return np.minimum(part[i], part[j]) * times[i] + np.maximum(part[i], part[j]) == pair[i]


def row_sets(piece: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams row by row, how many each row has, and a digest of each row's set."""
    g, r = K.grams(K.tokens(piece), n)
    rows = piece.num_rows
    order = np.lexsort((g, r))
    g, r = g[order], r[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
    g, r = g[new], r[new]
    counts = np.bincount(r, minlength=rows)
    digest = np.zeros(rows, U)
    if len(g):
        sums = np.zeros(len(g) + 1, U)
        np.cumsum(K.mix(g), out=sums[1:])
        ends = np.cumsum(counts)
        digest = K.mix((sums[ends] - sums[ends - counts]) ^ K.mix(counts.astype(U)))
    return g, counts, digest


def _bucket(x: np.ndarray, parts: int) -> np.ndarray:
    return ((x >> U(32)) * U(parts)) >> U(32)


def _packed(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences of as few bytes as they need."""
    d = np.diff(values, prepend=U(0))
    first, d = d[:1], d[1:]
    width = next((w for w in (4, 5, 6, 7) if not len(d) or int(d.max()) < 1 << (8 * w)), 8)
    return bytes([width]) + first.tobytes() + np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _unpacked(data: memoryview, n: int) -> tuple[np.ndarray, int]:
    if not n:
        return np.zeros(0, U), 1
    width = data[0]
    used = 9 + width * (n - 1)
    wide = np.zeros((n, 8), np.uint8)
    wide[0] = np.frombuffer(data[1:9], np.uint8)
    wide[1:, :width] = np.frombuffer(data[9:used], np.uint8).reshape(-1, width)
    return np.cumsum(wide.reshape(-1).view(U)), used


def _members(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in K.slices(batch):
                _, counts, digest = row_sets(piece, n)
                keep = counts > 0
                yield pa.record_batch({"doc_id": piece.column(0).filter(pa.array(keep)), "set_id": digest[keep].view(np.int64), "size": counts[keep].astype(np.int64)})

    return K.tidy(run)


def _column_tiles(n: int, parts: int):
    def flush(held: list) -> Iterator[pa.RecordBatch]:
        g = np.concatenate([x[0] for x in held])
        digest = np.concatenate([x[1] for x in held])
        size = np.concatenate([x[2] for x in held])
        digest, first, back = np.unique(digest, return_index=True, return_inverse=True)
        row = np.repeat(back.astype(np.uint32), size)
        size = size[first].astype(np.uint32)
        order = np.argsort(g)
        g, row = g[order], row[order]
        bounds = np.searchsorted(_bucket(g, parts), np.arange(parts + 1, dtype=U))
        ids, tiles = [], []
        for b in np.flatnonzero(np.diff(bounds)):
            lo, hi = bounds[b], bounds[b + 1]
            here, at = np.unique(row[lo:hi], return_inverse=True)
            at = at.astype(np.uint16 if len(here) <= 1 << 16 else np.uint32)
            ids.append(b)
            tiles.append(np.array([len(here), hi - lo], np.uint32).tobytes() + digest[here].tobytes() + size[here].tobytes() + at.tobytes() + _packed(g[lo:hi]))
        yield pa.record_batch({"block": pa.array(ids, pa.int32()), "tile": pa.array(tiles, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total = [], 0
        for batch in batches:
            for piece in K.slices(batch):
                g, counts, digest = row_sets(piece, n)
                keep = counts > 0
                held.append((g, digest[keep], counts[keep]))
                total += len(g)
                if total >= FLUSH:
                    yield from flush(held)
                    held, total = [], 0
        if total:
            yield from flush(held)

    return K.tidy(run)


def _count_columns(parts: int):
    """Column blocks to row tiles: entries of n-grams that two sets or more hold.

    Columns that the same sets hold are one column of their number's weight, named
    by their sets and ordered by how many these are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, row, digest, size, base = [], [], [], [], 0
        for batch in batches:
            for tile in batch.column(1):
                view = memoryview(tile.as_buffer())
                nd, ne = np.frombuffer(view[:8], np.uint32)
                nd, ne = int(nd), int(ne)
                at = 8
                digest.append(np.frombuffer(view[at : at + 8 * nd], U))
                at += 8 * nd
                size.append(np.frombuffer(view[at : at + 4 * nd], np.uint32))
                at += 4 * nd
                kind = np.uint16 if nd <= 1 << 16 else np.uint32
                w = np.dtype(kind).itemsize
                row.append(np.frombuffer(view[at : at + w * ne], kind).astype(np.int64) + base)
                at += w * ne
                g.append(_unpacked(view[at:], ne)[0])
                base += nd
        if not g:
            return
        g, row, digest, size = map(np.concatenate, (g, row, digest, size))
        order = np.argsort(g)
        g, row = g[order], row[order]
        same = g[1:] == g[:-1]
        keep = np.zeros(len(g), bool)
        keep[1:] |= same
        keep[:-1] |= same
        g, row = g[keep], row[keep]
        del order, same, keep
        order = np.lexsort((digest[row], g))  # a set that several tasks met counts once
        g, row = g[order], row[order]
        d = digest[row]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        g, row, d = g[new], row[new], d[new]
        if not len(g):
            return
        start = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        df = np.diff(np.append(start, len(g)))
        column = np.add.reduceat(K.mix(d), start)
        level = np.minimum(63, np.floor(2 * np.log2(df))).astype(U)
        key = np.repeat((level << U(57)) | (K.mix(column) >> U(7)), df)
        keep = np.repeat(df > 1, df)
        row, d, key = row[keep], d[keep], key[keep]
        order = np.lexsort((key, d))
        row, d, key = row[order], d[order], key[order]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (key[1:] != key[:-1])])) if len(d) else np.zeros(0, np.int64)
        weight = np.diff(np.append(new, len(d))).astype(np.uint32)
        row, d, key = row[new], d[new], key[new]
        bounds = np.searchsorted(_bucket(d, parts), np.arange(parts + 1, dtype=U))
        ids, tiles = [], []
        for b in np.flatnonzero(np.diff(bounds)):
            lo, hi = bounds[b], bounds[b + 1]
            first = np.flatnonzero(np.concatenate([[True], d[lo + 1 : hi] != d[lo : hi - 1]]))
            count = np.diff(np.append(first, hi - lo)).astype(np.uint32)
            ids.append(b)
            tiles.append(np.array([len(first), hi - lo], np.uint32).tobytes() + d[lo:hi][first].tobytes() + size[row[lo:hi][first]].tobytes() + count.tobytes() + weight[lo:hi].tobytes() + key[lo:hi].tobytes())
        yield pa.record_batch({"block": pa.array(ids, pa.int32()), "tile": pa.array(tiles, pa.binary())})

    return K.tidy(run)


def _survivors(num: int, den: int):
    """Row blocks: the sets with enough shared n-grams, their columns in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, size, key, weight = [], [], [], []
        for batch in batches:
            for tile in batch.column(1):
                view = memoryview(tile.as_buffer())
                nd, ne = (int(x) for x in np.frombuffer(view[:8], np.uint32))
                at = 8
                d = np.frombuffer(view[at : at + 8 * nd], U)
                at += 8 * nd
                s = np.frombuffer(view[at : at + 4 * nd], np.uint32)
                at += 4 * nd
                c = np.frombuffer(view[at : at + 4 * nd], np.uint32)
                at += 4 * nd
                weight.append(np.frombuffer(view[at : at + 4 * ne], np.uint32))
                at += 4 * ne
                key.append(np.frombuffer(view[at : at + 8 * ne], U))
                digest.append(np.repeat(d, c))
                size.append(np.repeat(s, c))
        if not digest:
            return
        digest, size, key, weight = map(np.concatenate, (digest, size, key, weight))
        order = np.lexsort((key, digest))
        digest, size, key, weight = digest[order], size[order], key[order], weight[order]
        new = np.flatnonzero(np.concatenate([[True], (digest[1:] != digest[:-1]) | (key[1:] != key[:-1])]))
        weight = np.add.reduceat(weight.astype(np.int64), new)
        digest, size, key = digest[new], size[new].astype(np.int64), key[new].view(np.int64)
        start = np.flatnonzero(np.concatenate([[True], digest[1:] != digest[:-1]]))
        count, n, shared = np.diff(np.append(start, len(digest))), size[start], np.add.reduceat(weight, start)
        keep = shared * den >= n * num
        start, count, n = start[keep], count[keep], n[keep]
        for lo in range(0, len(count), 4096):
            z = slice(lo, lo + 4096)
            at = np.repeat(start[z], count[z]) + K.ragged(count[z])
            yield pa.record_batch({"set_id": digest[start[z]].view(np.int64), "size": n[z], "grams": K.lists(key[at], count[z]), "weights": K.lists(weight[at], count[z])})

    return K.tidy(run)


def _places(n: np.ndarray, weight: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many n-grams of its set come before each column: the unshared ones, then the columns in order."""
    total = np.zeros(len(weight) + 1, np.int64)
    np.cumsum(weight, out=total[1:])
    end = np.cumsum(count)
    return total[:-1] + np.repeat(n - total[end], count)


def _prefixes(num: int, den: int, hot: int):
    """Postings of the prefixes. Each carries the BEFORE columns before it in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sid, n = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            flat, weight = (batch.column(k).flatten().to_numpy() for k in (3, 4))
            count = np.diff(batch.column(3).offsets.to_numpy())
            place = _places(n, weight, count)
            take = np.flatnonzero(place <= np.repeat(n - -(-n * num // den), count))
            at, own, size = K.ragged(count)[take], np.repeat(sid, count)[take], np.repeat(n, count)[take]
            times, part = _part(flat[take], own, hot)
            ends, lo = np.cumsum(times), 0
            while lo < len(take):
                to = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + FLUSH // 4, side="right")))
                row = np.repeat(np.arange(lo, to), times[lo:to])
                other, here = K.ragged(times[lo:to]), take[row]
                out = {"gram": flat[here], "pair": np.minimum(part[row], other) * times[row] + np.maximum(part[row], other), "set_id": own[row], "size": size[row], "place": place[here]}
                for k in range(1, BEFORE + 1):
                    out[f"before{k}"] = np.where(at[row] >= k, flat[np.maximum(here - k, 0)], -k)
                yield pa.record_batch(out)
                lo = to

    return K.tidy(run)


def _pairs(group: np.ndarray, n: np.ndarray, place: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions i < j of one group (rows come by group and size) whose sizes and places still allow the threshold."""
    most = n * den // num
    scale = np.int64(max(int(most.max()), int(n.max())) + 2)
    comp = group * scale + n
    hi = np.searchsorted(comp, group * scale + most, side="right")
    count = np.maximum(hi - np.arange(len(n)) - 1, 0)
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        to = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        c = count[lo:to]
        i = np.repeat(np.arange(lo, to), c)
        j = i + 1 + K.ragged(c)
        ok = np.minimum(n[i] - place[i], n[j] - place[j]) >= -(-(n[i] + n[j]) * num // (num + den))
        yield i[ok], j[ok]
        lo = to


def _multiply(num: int, den: int, hot: int):
    """Postings of a column, or of a pair of its parts, to the sets that their blocks must compare.

    A pair is left to an earlier n-gram if both carry one in common. The first
    n-gram that two sets share is never skipped, so each pair is met at least once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        gram, pair, sid, n, place, *before = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(5 + BEFORE))
        order = np.lexsort((sid, n, pair, gram))
        gram, pair, sid, n, place = gram[order], pair[order], sid[order], n[order], place[order]
        before = [x[order] for x in before]
        times, part = _part(gram, sid, hot)
        split = times.max() > 1
        new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (pair[1:] != pair[:-1])])
        group, start = np.cumsum(new) - 1, np.flatnonzero(new)
        tile = (np.arange(len(gram)) - start[group]) // TILE
        tiles = np.int64(tile.max() + 1)
        held: list[np.ndarray] = []

        def wanted(parts: list[np.ndarray]) -> np.ndarray:
            return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)

        size, scale = 0, np.int64(len(gram))
        for i, j in _pairs(group, n, place, num, den):
            if split:
                ok = _met(part, times, pair, i, j)
                i, j = i[ok], j[ok]
            earlier = np.zeros(len(i), bool)
            for x in before:
                for y in before:
                    earlier |= (x[i] == y[j]) & (x[i] >= 0)
            i, j = i[~earlier], j[~earlier]
            # a block's code: the place of its other tile, and the row itself; 2 * other + side
            for mine, other, side in ((i, j, 0), (j, i, 1)):
                code = (tile[other] * 2 + side) * scale + mine
                held.append(np.unique(code))
            size += len(held[-1]) + len(held[-2])
            if size > 4 * PAIRS:
                held = [wanted(held)]
                size = len(held[0])
        code = wanted(held)
        mine, other = code % scale, code // scale
        side, other = other % 2, other // 2
        left, right = np.where(side == 0, tile[mine], other), np.where(side == 0, other, tile[mine])
        side = np.where(left == right, 2, side)
        rows = np.unique(np.column_stack([mine, left * tiles + right, side]), axis=0) if len(mine) else np.zeros((0, 3), np.int64)
        mine = rows[:, 0]
        for k in range(0, len(rows), 1 << 18):
            z = slice(k, k + (1 << 18))
            yield pa.record_batch({"gram": gram[mine[z]], "pair": pair[mine[z]], "tile": rows[z, 1], "side": rows[z, 2], "set_id": sid[mine[z]]})

    return K.tidy(run)


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of an edge list, each but the least of its component, with that least one."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new[new] != new).any():
            new = new[new]
        label = new[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    rest = label != np.arange(len(nodes))
    return nodes[rest], nodes[label[rest]]


def _accumulate(num: int, den: int, pairs: bool, hot: int):
    """Whole blocks of sets to the pairs that reach the threshold; a pair counts in the block of the first n-gram that it shares.

    pairs: they come as they are. Otherwise come the edges (0, set, set) that keep a
    task's groups together, and the sums (1, set, documents of the sets that it is paired with).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        gram, pair, tile, side, sid, n, head, m = (np.concatenate([b.column(k).to_numpy() for b in got]) for k in range(8))
        flat, weight = (np.concatenate([b.column(k).flatten().to_numpy() for b in got]) for k in (8, 9))
        count = np.concatenate([np.diff(b.column(8).offsets.to_numpy()) for b in got])
        start = np.cumsum(count) - count
        order = np.lexsort((sid, n, tile, pair, gram))
        gram, pair, tile, side, sid, head, m, n, count, start = (x[order] for x in (gram, pair, tile, side, sid, head, m, n, count, start))
        at = np.repeat(start, count) + K.ragged(count)
        flat, weight = flat[at], weight[at]
        start = np.cumsum(count) - count
        names, cell = np.unique(flat, return_inverse=True)
        width = np.int64(len(names))
        cells = np.repeat(np.arange(len(n)), count) * width + cell  # sorted, as rows and their n-grams are
        mine = np.searchsorted(names, gram)
        place = _places(n, weight, count)[np.searchsorted(cells, np.arange(len(n)) * width + mine)]
        times, part = _part(gram, sid, hot)
        split = times.max() > 1
        group = np.cumsum(np.concatenate([[0], (gram[1:] != gram[:-1]) | (pair[1:] != pair[:-1]) | (tile[1:] != tile[:-1])]))
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        links = np.zeros(len(n), np.int64)
        for i, j in _pairs(group, n, place, num, den):
            ok = (side[i] == 2) | ((side[i] == 0) & (side[j] == 1))
            if split:
                ok &= _met(part, times, pair, i, j)
            i, j = i[ok], j[ok]
            few, many = np.where(count[i] <= count[j], i, j), np.where(count[i] <= count[j], j, i)
            ends, lo = np.cumsum(count[few]), 0
            while lo < len(i):
                to = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
                z = slice(lo, to)
                c = count[few[z]]
                at = np.repeat(start[few[z]], c) + K.ragged(c)
                x = cell[at]
                want = np.repeat(many[z] * width, c) + x
                hit = cells[np.minimum(np.searchsorted(cells, want), len(cells) - 1)] == want
                earlier = hit & (x < np.repeat(mine[i[z]], c))
                e = np.cumsum(c)
                overlap, earlier = ((s := np.concatenate([[0], np.cumsum(v)]))[e] - s[e - c] for v in (hit * weight[at], earlier))
                a, b = i[z], j[z]
                ok = (earlier == 0) & (overlap * (num + den) >= num * (n[a] + n[b]))
                a, b, overlap = a[ok], b[ok], overlap[ok]
                if pairs:
                    ok = head[a] != head[b]
                    a, b, overlap = a[ok], b[ok], overlap[ok]
                    a, b = np.where(head[a] < head[b], a, b), np.where(head[a] < head[b], b, a)
                    yield pa.record_batch({"doc_a": head[a], "doc_b": head[b], "overlap": overlap, "size_a": n[a], "size_b": n[b]})
                else:
                    edges.append(roots(sid[a], sid[b]))
                    np.add.at(links, a, m[b])
                    np.add.at(links, b, m[a])
                lo = to
        if edges:
            node, root = roots(*(np.concatenate([e[k] for e in edges]) for k in range(2)))
            yield pa.record_batch({"kind": np.zeros(len(node), np.int64), "a": node, "b": root})
            some = np.flatnonzero(links)
            own, back = np.unique(sid[some], return_inverse=True)
            total = np.zeros(len(own), np.int64)
            np.add.at(total, back, links[some])
            yield pa.record_batch({"kind": np.ones(len(own), np.int64), "a": own, "b": total})

    return K.tidy(run)


def _alike(docs: DataFrame, n: int, threshold: tuple[int, int], id_col: str, text_col: str, pairs: bool, hot: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `_accumulate` gives; (doc_id, set_id, size) of the documents; (set_id, head, m) of the sets."""
    num, den = threshold
    if not 0 < num <= den:
        raise ValueError("threshold must be in (0, 1]")
    spark = docs.sparkSession
    parts = partitions(spark, docs)
    texts = usable(docs, id_col, text_col)
    tile = "block int, tile binary"
    members = cut(texts.mapInArrow(_members(n), "doc_id long, set_id long, size long").distinct())
    heads = members.groupBy("set_id").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("m"))
    columns = texts.mapInArrow(_column_tiles(n, parts), tile).repartitionById(parts, F.col("block"))
    rows = columns.mapInArrow(_count_columns(parts), tile).repartitionById(parts, F.col("block"))
    sets = rows.mapInArrow(_survivors(num, den), "set_id long, size long, grams array<long>, weights array<long>")
    sets = cut(sets.join(heads, "set_id").select("set_id", "head", "size", "grams", "weights", "m"))
    del columns, rows
    release(spark)
    postings = sets.mapInArrow(_prefixes(num, den, hot), "gram long, pair long, set_id long, size long, place long" + "".join(f", before{k} long" for k in range(1, BEFORE + 1)))
    wanted = postings.repartition(parts, "gram", "pair").mapInArrow(_multiply(num, den, hot), "gram long, pair long, tile long, side long, set_id long")
    blocks = wanted.join(sets, "set_id").select("gram", "pair", "tile", "side", "set_id", "size", "head", "m", "grams", "weights").repartition(parts, "gram", "pair", "tile")
    return blocks.mapInArrow(_accumulate(num, den, pairs, hot), "doc_a long, doc_b long, overlap long, size_a long, size_b long" if pairs else "kind long, a long, b long"), members, heads


def _components(edges: DataFrame) -> DataFrame:
    """(u, v): each node of the edges but the least of its component, with that least one, by alternating stars until nothing changes."""
    edges = cut(edges.distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = cut(small)
        sums = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if sums(new) == sums(edges):
            return new
        edges = new


def jaccard_links(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (1, 2), id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """(doc_id, class_id, n_links) of every document that has a link, i.e. another one with a Jaccard similarity of `threshold` (numerator, denominator) or more.

    `n_links` counts those others, copies one by one. `class_id` is the least doc_id
    of the documents that links join, directly or through others. Documents without a
    link have no row: they are alone in their class.

    Words are runs of bytes other than ASCII white space, case and punctuation kept.
    A text of 1 to n-1 words has one n-gram, all its words. A document is a doc_id
    with a set of n-grams: repeated rows count once, and each of several unlike texts
    of a doc_id is one, with its own row and links.

    `hot`: n-grams of more sets are compared in parts of that size; the result is the same.

    Null doc_id or text, and texts without words: no link. Very long texts are taken
    whole. No rows: no links. Other columns are not read.
    """
    found, members, heads = _alike(docs, n, threshold, id_col, text_col, False, hot)
    found = cut(found)
    tree = _components(found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))
    node = tree.unionByName(tree.select(F.col("v").alias("u"), "v").distinct()).select(F.col("u").alias("set_id"), F.col("v").alias("root"))
    node = node.join(heads, "set_id").select("set_id", "root", "head")
    least = node.groupBy("root").agg(F.min("head").alias("class_id"))
    node = node.join(least, "root").select("set_id", "class_id")
    links = found.where("kind = 1").groupBy(F.col("a").alias("set_id")).agg(F.sum("b").alias("n"))
    sets = heads.join(node, "set_id", "left").join(links, "set_id", "left").where("m > 1 or n > 0")
    sets = sets.select("set_id", F.coalesce("class_id", "head").alias("class_id"), (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    return members.join(sets, "set_id").select("doc_id", "class_id", "n_links")


def jaccard_join(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (1, 2), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (doc_a < doc_b, overlap, size_a, size_b, jaccard) with a Jaccard similarity of `threshold` (numerator, denominator) or more.

    Pairs between representatives, and membership: documents with equal n-gram sets
    form a group, each is paired with its least doc_id (jaccard 1), and only that one
    takes part in pairs with other sets. Large groups of alike sets have many pairs;
    `jaccard_links` gives one row a document.

    Words are runs of bytes other than ASCII white space, case and punctuation kept.
    A text of 1 to n-1 words has one n-gram, all its words.

    Null doc_id or text, and texts without words: in no pair. Repeated rows and
    rows of one doc_id: equal sets count once; a doc_id is never paired with itself,
    and one with several texts has a pair for each of them that is alike. Very long texts are taken whole. No rows: no pairs. Other columns
    are not read.
    """
    across, members, heads = _alike(docs, n, threshold, id_col, text_col, True, HOT)
    size = F.col("size")
    equal = members.join(heads.where("m > 1"), "set_id").where("doc_id <> head").select(F.col("head").alias("doc_a"), F.col("doc_id").alias("doc_b"), size.alias("overlap"), size.alias("size_a"), size.alias("size_b"))
    ratio = F.col("overlap") / (F.col("size_a") + F.col("size_b") - F.col("overlap"))
    return across.unionByName(equal).withColumn("jaccard", F.round(ratio, 6))


def near_groups(docs: DataFrame, n: int = 3, threshold: tuple[int, int] = (1, 2), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, head): the documents of `jaccard_links` that aren't the least of their class, and that least one.

    Null, empty, repeated and very long inputs are taken as there.
    """
    return jaccard_links(docs, n, threshold, id_col, text_col).where("doc_id <> class_id").select("doc_id", F.col("class_id").alias("head"))
