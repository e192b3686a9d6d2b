"""Near-duplicate records with small edits, by deletion-variant signatures.

A record is the set of its elements: each word with the number of its occurrence. Records of similarity t differ in at
most H = (1-t)/(1+t) (n+m) elements. A hash cuts the elements into K = floor(H/2) + 2 segments, so that at least two
segments of a similar pair differ by at most one element. Each segment is indexed whole, and once more for each of its
elements with that element taken out; two segments differ by at most one element if the whole one equals the other's
whole or a variant of it. Records meet by equality of these signatures, lengths and a parity sketch discard what cannot
reach t, and the rest is verified exactly. No similar pair is lost.

H follows from the length, so there are levels: level l holds the lengths b(l) to b(l)/t. A record is at home in its own
level and visits the next one if a partner may live there; visitors do not meet each other.

Signatures of at most TINY elements (none: empty segments) are shared by unrelated records. They are never used alone: as two segments match,
a pair that meets in tiny ones only meets in a pair of them, and such pairs of tiny signatures are indexed instead.
A signature that even so is held by more than BLOCK records is cut into blocks of that size, each pair of which is a
task of its own. So no signature, however common, lands in one task.

A map task signs a batch of records at a time and sends one packed row to each part of the signatures: 48-bit
signatures as differences of sorted numbers, two bytes for record and role, and each record's class, length and sketch.
As the last three go to each part that a record reaches, the bytes of a signature rise with the number of parts. So the
parts are filled in rounds: each sends at most SENT bytes a word, and its shuffle files go before the next one begins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.operators.components import connected_components
from quillstream.session import cut, settled, small, written

#: Similarity and least number of words.
SIMILARITY, MIN_WORDS = 0.7, 5
#: Signatures of at most so many elements count only in pairs of two.
TINY = 0
#: Records of a block of one signature, signatures of a part, and pairs formed at once.
BLOCK, PART, PAIRS = 20_000, 4_000_000, 200_000
#: Bytes a word of all records that a round may send to its parts.
SENT = 8
#: Records of a signature from which its pairs are compared as a table, and columns of a tile of it.
DENSE, TILE = 128, 512
#: Bytes of a column's dictionary in the table of hashed words.
DICTIONARY = 8 << 20
#: Words and records that a map task signs at a time; 13 bits of a row tell the record.
BATCH_WORDS, BATCH_RECORDS = 500_000, 8192
#: Bits of the parity sketch: so many per element of difference, in words of 64, at most so many words.
SKETCH_BITS, SKETCH_WORDS = 3.0, 64
#: Words of the second sketch of levels whose first one is a single word.
FINE = 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Levels:
    """Lengths first[l] to first[l + 1] - 1 of each level, the most elements in which its pairs differ, its segments."""

    def __init__(self, t: float, least: int):
        first = [max(1, least)]
        while first[-1] < 1 << 40:
            first.append(math.floor(first[-1] / t + 1e-9) + 1)
        self.t, self.first = t, np.array(first, np.int64)
        longest = self.first[1:] - 1
        self.apart = np.floor((1 - t) / (1 + t) * 2 * longest + 1e-9).astype(np.int64)
        self.segments = self.apart // 2 + 2
        self.words = np.clip(np.ceil(self.apart * SKETCH_BITS / 64), 1, SKETCH_WORDS).astype(np.int64)
        self.fine = np.where(self.words == 1, FINE, 0)

    def home(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, n, side="right") - 1

    def visits(self, n: np.ndarray) -> np.ndarray:
        """Whether a partner may live in the next level."""
        return np.floor(n / self.t + 1e-9) >= self.first[self.home(n) + 1]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list column."""
    offsets = np.asarray(column.offsets, np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), offsets - offsets[0]


def elements(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes, record by record (65,536 at most), to elements of 48 bits, ascending within each record, and their records."""
    row = np.repeat(np.arange(len(sizes), dtype=np.uint64) << np.uint64(48), sizes)
    key = row | values >> np.uint64(16)
    key.sort()
    place = np.arange(len(key))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    nth = place - np.maximum.accumulate(np.where(fresh, place, 0))
    key = row | _mix((key & _LOW) + nth.astype(np.uint64) * _GOLD) >> np.uint64(16)
    key.sort()
    return key & _LOW, (row >> np.uint64(48)).astype(np.int64)


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def sketch(e: np.ndarray, row: np.ndarray, n: int, words: int) -> np.ndarray:
    """Parity of the elements per bit: two records' sketches differ in no more bits than the records in elements."""
    bits = 64 * words
    bit = ((e & np.uint64(0xFFFFFFFF)) * np.uint64(bits) >> np.uint64(32)).astype(np.int64)
    odd = np.bincount(row * bits + bit, minlength=n * bits).astype(np.uint8) & 1
    return np.packbits(odd.reshape(-1, bits), axis=1).view(np.uint64)


def signatures(e: np.ndarray, row: np.ndarray, tag: np.ndarray, level: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of records (0 to len(tag) - 1, row of each element) in k segments: signature, record, role.

    Bit 0 of a role says that an element of the segment has been taken out; of a pair of tiny signatures, bit 0 tells it
    of the first and bit 1 of the second. Records meet only if they have no such bit in common.
    """
    n = len(tag)
    slot = row * k + ((e >> np.uint64(16)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
    m = _mix(e)
    total, held = np.zeros(n * k, np.uint64), np.bincount(slot, minlength=n * k)
    total[slot[start]] = np.add.reduceat(m, start)
    own = (tag[:, None] ^ _mix(np.arange(k, dtype=np.uint64) + np.uint64(level << 32))).ravel()
    left = held[slot] - 1
    strong, less = held > TINY, left > TINY
    whole = _mix(total + own)
    taken = _mix((total + own)[slot] - m)
    sig, who = [whole[strong], taken[less]], [np.flatnonzero(strong) // k, row[less]]
    role = [np.zeros(len(sig[0]), np.uint8), np.ones(len(sig[1]), np.uint8)]
    # pairs of tiny ones of different segments
    tiny = np.concatenate((whole[~strong], taken[~less]))
    at = np.concatenate((np.flatnonzero(~strong), slot[~less]))
    out = np.repeat(np.arange(2, dtype=np.uint8), ((~strong).sum(), (~less).sum()))
    order = np.argsort(at, kind="stable")
    tiny, at, out = tiny[order], at[order], out[order]
    per = np.bincount(at // k, minlength=n)
    later = np.repeat(per, per) - _within(per) - 1
    a = np.repeat(np.arange(len(at)), later)
    b = a + 1 + _within(later)
    other = at[a] != at[b]
    a, b = a[other], b[other]
    sig.append(_mix(tiny[a] + _mix(tiny[b] ^ _GOLD)))
    who.append(at[a] // k)
    role.append(out[a] | out[b] << 1)
    return np.concatenate(sig), np.concatenate(who), np.concatenate(role)


def pack(level: int, classes: np.ndarray, n: np.ndarray, sketches: np.ndarray, sig: np.ndarray, said: np.ndarray) -> bytes:
    """One packed row: signatures (ascending, 48 bits), each with said: record << 3 | role; class, n and sketch of the records."""
    step = np.diff(sig, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T
    head = np.array([level, len(n), sketches.shape[1], len(sig)], np.int64)
    return b"".join(x.tobytes() for x in (head, classes, n.astype(np.int32), sketches, step, said.astype(np.uint16)))


def unpack(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """level, class, n and sketch of the records, signatures, said."""
    level, m, words, size = np.frombuffer(data, np.int64, 4).tolist()
    at = 32
    classes = np.frombuffer(data, np.int64, m, at)
    n = np.frombuffer(data, np.int32, m, at := at + 8 * m)
    sketches = np.frombuffer(data, np.uint64, m * words, at := at + 4 * m).reshape(m, words)
    step = np.zeros((size, 8), np.uint8)
    step[:, :6] = np.frombuffer(data, np.uint8, 6 * size, at := at + 8 * m * words).reshape(6, size).T
    return level, classes, n, sketches, np.cumsum(step.view(np.uint64)[:, 0], dtype=np.uint64), np.frombuffer(data, np.uint16, size, at + 6 * size)


def plan(levels: Levels, held: dict[int, tuple[int, int]], part: int, sent: float) -> tuple[dict[int, tuple[int, int]], list[tuple[int, int]]]:
    """First part and number of parts of each level, and the rounds: ranges of parts. held: records and words at home in a level."""
    parts: dict[int, tuple[int, int]] = {}
    weights: list[float] = []
    for level in sorted({x for k in held for x in (k, k + 1)}):
        records, words = (sum(held.get(k, (0, 0))[i] for k in (level, level - 1)) for i in (0, 1))
        signed = 1.3 * words
        many = max(1, -(-int(signed) // part))
        reached = many * -math.expm1(-signed / records / many)  # parts that a record reaches
        parts[level] = len(weights), many
        weights += [(6 * signed + (12 + 8 * int(levels.words[level] + levels.fine[level])) * records * reached) / many] * many
    rounds = max(1, math.ceil(sum(weights) / (sent * max(1, sum(w for _, w in held.values())))))
    ends = np.searchsorted(np.cumsum(weights), np.arange(1, rounds) * sum(weights) / rounds) + 1
    edges = sorted({0, len(weights), *ends.tolist()})
    return parts, list(zip(edges, edges[1:]))


def _sign(levels: Levels, parts: dict[int, tuple[int, int]], since: int, upto: int):
    """(class, n, tag, words) to packed rows (part, data) of the parts from since to upto - 1, counted from since; parts: first part and number of each level."""

    def batches(records: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.cumsum(records.column("n").to_numpy().astype(np.int64))
        at = 0
        while at < records.num_rows:
            upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_WORDS, side="right"))
            upto = min(max(at + 1, upto), at + BATCH_RECORDS)
            yield records.slice(at, upto - at)
            at = upto

    def packed(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        _, first = np.unique(batch.column("class").to_numpy(), return_index=True)
        if len(first) < batch.num_rows:
            batch = batch.take(pa.array(np.sort(first)))
        classes, tag = batch.column("class").to_numpy(), batch.column("tag").to_numpy().view(np.uint64)
        values, offsets = _lists(batch.column("words"))
        n = np.diff(offsets)
        e, _ = elements(values, n)
        home, visits = levels.home(n), levels.visits(n)
        for level in np.unique(np.concatenate((home, home[visits] + 1))).tolist():
            begin, many = parts[level]
            now = range(max(since - begin, 0), min(upto - begin, many))
            if not now:
                continue
            own = np.flatnonzero((home == level) | ((home == level - 1) & visits))
            size = n[own]
            mine, row = e[np.repeat(offsets[own], size) + _within(size)], np.repeat(np.arange(len(own)), size)
            sig, who, role = signatures(mine, row, tag[own], level, int(levels.segments[level]))
            role |= (home[own] < level).astype(np.uint8)[who] << 2
            key = (sig & ~np.uint64(0xFFFF)) | (who << 3 | role).astype(np.uint64)
            key.sort()
            sig, said = key >> np.uint64(16), key & np.uint64(0xFFFF)
            marks = sketch(mine, row, len(own), int(levels.words[level]))
            if levels.fine[level]:
                marks = np.hstack((marks, sketch(_mix(mine), row, len(own), int(levels.fine[level]))))
            # part p holds the p-th of many equal ranges of the signatures
            edge = np.searchsorted(sig, np.array([-(-(p << 48) // many) for p in range(many + 1)], np.uint64))
            for p in now:
                a, b = edge[p], edge[p + 1]
                if a < b:
                    record = (said[a:b] >> np.uint64(3)).astype(np.int64)
                    used = np.zeros(len(own), bool)
                    used[record] = True
                    number = np.cumsum(used) - 1
                    yield begin + p - since, pack(level, classes[own[used]], size[used], marks[used], sig[a:b], number[record] << 3 | (said[a:b] & np.uint64(7)).astype(np.int64))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for records in stream:
            for batch in batches(records):
                rows = list(packed(batch))
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows[at : at + 64]], pa.int32()), pa.array([d for _, d in rows[at : at + 64]], pa.binary())], ["part", "data"])

    return run


def _close(a: np.ndarray, b: np.ndarray, apart: np.ndarray, role: np.ndarray, n: np.ndarray, fine: np.ndarray, t: float) -> np.ndarray:
    """Which pairs of entries may meet and reach t, of lengths n, first sketches that differ in apart bits and second sketches fine."""
    na, nb = n[a], n[b]
    most = (1 - t) / (1 + t) * (na + nb) + 1e-9
    kept = np.flatnonzero(((role[a] & role[b]) == 0) & (apart <= most) & (np.minimum(na, nb) >= t * np.maximum(na, nb) - 1e-9))
    if len(fine) and len(kept):
        x, y = a[kept], b[kept]
        kept = kept[np.bitwise_count(fine[:, x] ^ fine[:, y]).sum(axis=0, dtype=np.int64) <= most[kept]]
    return kept


def _sparse(left: np.ndarray, low: np.ndarray, high: np.ndarray, role: np.ndarray, n: np.ndarray, marks: np.ndarray, fine: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of entries, of left[i] with low[i] to high[i] - 1, about PAIRS at a time."""
    width = np.maximum(high - low, 0)
    ends = np.cumsum(width)
    at = 0
    while at < len(left):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
        w = width[at:upto]
        a = np.repeat(left[at:upto], w)
        b = np.repeat(low[at:upto], w) + _within(w)
        at = upto
        apart = np.zeros(len(a), np.int64)
        for mark in marks:
            apart += np.bitwise_count(mark[a] ^ mark[b])
        kept = _close(a, b, apart, role, n, fine, t)
        if len(kept):
            yield a[kept], b[kept]


def _dense(rows: tuple[int, int], cols: tuple[int, int], role: np.ndarray, n: np.ndarray, marks: np.ndarray, fine: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Close pairs of entries, of a range of rows with the later ones of a range of columns, a tile at a time."""
    if rows[0] == rows[1] or cols[0] == cols[1]:
        return
    limit = int((1 - t) / (1 + t) * 2 * max(n[rows[0] : rows[1]].max(), n[cols[0] : cols[1]].max()) + 1e-9)
    kind = np.uint8 if len(marks) < 4 else np.uint16
    high = min(TILE, max(16, (rows[1] - rows[0]) // 6))
    for r in range(rows[0], rows[1], high):
        q = min(r + high, rows[1])
        for c in range(max(r, cols[0]), cols[1], TILE):
            d = min(c + TILE, cols[1])
            apart = np.zeros((q - r, d - c), kind)
            for mark in marks:
                apart += np.bitwise_count(mark[r:q, None] ^ mark[None, c:d])
            near = np.flatnonzero(apart <= limit)
            if len(near):
                a, b = near // (d - c) + r, near % (d - c) + c
                kept = _close(a, b, apart.ravel()[near], role, n, fine, t)
                kept = kept[a[kept] < b[kept]]
                if len(kept):
                    yield a[kept], b[kept]


def _pairs(classes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    x, y = classes[a], classes[b]
    pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    ends = [pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)]
    return pa.RecordBatch.from_arrays([*ends, pa.nulls(len(pairs), pa.string()), pa.nulls(len(pairs), pa.binary())], ["ca", "cb", "cell", "data"])


_MET = "ca bigint, cb bigint, cell string, data binary"


def _meetings(levels: Levels, block: int):
    """The packed rows of one part to pairs of classes that may reach t, and to the blocks of overfull signatures."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [unpack(x) for batch in stream for x in batch.column("data").to_pylist()]
        if not held:
            return
        t, level = levels.t, held[0][0]
        # a copy met in another batch has the same signatures: the first one stands for all
        classes, first, number = np.unique(np.concatenate([h[1] for h in held]), return_index=True, return_inverse=True)
        n, marks = np.concatenate([h[2] for h in held])[first].astype(np.int64), np.concatenate([h[3] for h in held])[first]
        base = np.cumsum([0] + [len(h[1]) for h in held])
        # one number per entry: signature, whether elements are taken out, visitor, record; sorted, equal ones are one
        bits = max(1, len(classes)).bit_length()
        drop = np.uint64(max(0, 48 + 3 + bits - 64))
        keys = []
        for h, b in zip(held, base):
            role = h[5].astype(np.uint64) & np.uint64(7)
            record = number[(h[5] >> 3).astype(np.int64) + b].astype(np.uint64)
            keys.append((h[4] >> drop) << np.uint64(3 + bits) | ((role & np.uint64(3)) << np.uint64(1) | role >> np.uint64(2)) << np.uint64(bits) | record)
        del held
        key = np.concatenate(keys)
        del keys
        key.sort()
        sig = key >> np.uint64(3 + bits)
        alone = np.ones(len(key), bool)
        same = sig[1:] == sig[:-1]
        alone[1:] &= ~same
        alone[:-1] &= ~same
        key, sig = key[~alone], sig[~alone]
        if not len(key):
            return
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        key, sig = key[fresh], sig[fresh]
        start = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
        size = np.diff(np.append(start, len(sig)))
        group = np.repeat(np.arange(len(start)), size)
        record = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
        coded = (key >> np.uint64(bits)).astype(np.uint8) & np.uint8(7)
        role = coded >> 1 | (coded & 1) << 2
        taken, end = role & 3, (start + size)[group]
        # whole ones meet all later ones, whole visitors those at home, those of taken 1 those of taken 2
        low, high = np.arange(1, len(key) + 1), end.copy()
        order = group * 8 + coded
        visitor, half = np.flatnonzero(coded == 1), np.flatnonzero(taken == 1)
        low[visitor] = np.searchsorted(order, group[visitor] * 8 + 2)
        low[half], high[half] = (np.searchsorted(order, group[half] * 8 + x) for x in (4, 6))
        n, marks = n[record], np.ascontiguousarray(marks[record].T)
        first, fine = marks[: levels.words[level]], marks[levels.words[level] :]
        left = np.flatnonzero((taken <= 1) & (high > low) & (size < DENSE)[group])
        for a, b in _sparse(left, low[left], high[left], role, n, first, fine, t):
            yield _pairs(classes, record[a], record[b])
        for g in np.flatnonzero((size >= DENSE) & (size <= block)).tolist():
            s, e = int(start[g]), int(start[g] + size[g])
            k = (s + np.searchsorted(coded[s:e], np.arange(9))).tolist()
            tables = [((k[0], k[1]), (s, e)), ((k[1], k[2]), (k[2], k[3])), ((k[1], k[2]), (k[4], e)), ((k[2], k[3]), (k[4], k[6])), ((k[3], k[4]), (k[4], k[5]))]
            for a, b in chain.from_iterable(_dense(rows, cols, role, n, first, fine, t) for rows, cols in tables):
                yield _pairs(classes, record[a], record[b])
        for g in np.flatnonzero(size > block).tolist():
            own = np.arange(start[g], start[g] + size[g])
            name = f"{level}:{int(sig[start[g]])}"
            pieces = np.array_split(own, -(-len(own) // block))
            packed = [pack(level, classes[record[p]], n[p], np.ascontiguousarray(marks[:, p].T), np.zeros(len(p), np.uint64), role[p]) for p in pieces]
            for i in range(len(pieces)):
                cells = [f"{name}:{min(i, j)}:{max(i, j)}" for j in range(len(pieces))]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(cells), pa.int64()), pa.nulls(len(cells), pa.int64()), pa.array(cells), pa.array([packed[i]] * len(cells), pa.binary())], ["ca", "cb", "cell", "data"])

    return run


def _cells(levels: Levels):
    """The two blocks (or one) of a cell to pairs of classes that may reach t."""

    def run(group: pa.Table) -> pa.Table:
        blocks = [unpack(x) for x in group.column("data").to_pylist()]
        classes, n, marks, role = (np.concatenate([b[i] for b in blocks]) for i in (1, 2, 3, 5))
        n, marks, own = n.astype(np.int64), np.ascontiguousarray(marks.T), len(blocks[0][1])
        cols = (0, own) if len(blocks) == 1 else (own, len(n))
        words = levels.words[blocks[0][0]]
        found = [_pairs(classes, a, b) for a, b in _dense((0, own), cols, role, n, marks[:words], marks[words:], levels.t)]
        rows = pa.Table.from_batches(found) if found else pa.Table.from_batches([_pairs(classes, np.zeros(0, np.int64), np.zeros(0, np.int64))])
        return rows.select(["ca", "cb"])

    return run


def _shared(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ca, cb and the word hashes of both to the number of elements that both have, and of both together."""
    for whole in stream:
        for at in range(0, whole.num_rows, 2000):
            batch = whole.slice(at, 2000)
            sides = [_lists(batch.column(c)) for c in ("wa", "wb")]
            sizes = [np.diff(o) for _, o in sides]
            keys = [e | row.astype(np.uint64) << np.uint64(48) for e, row in (elements(v, s) for (v, _), s in zip(sides, sizes))]
            key = np.sort(np.concatenate(keys))
            shared = np.bincount((key[1:][key[1:] == key[:-1]] >> np.uint64(48)).astype(np.int64), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("ca"), batch.column("cb"), pa.array(shared.astype(np.int32)), pa.array((sizes[0] + sizes[1]).astype(np.int32))], ["ca", "cb", "shared", "both"])


class NearDuplicates:
    """members: field, id, rep (each record with the least id of its exact class). links: field, a, b, shared, similarity of reps."""

    def __init__(self, members: DataFrame, links: DataFrame):
        self.members, self.links = members, links


def words(text: Column) -> Column:
    """Maximal runs of letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)


def _class() -> Column:
    """The class of a record: equal for equal words with repetition, in one field."""
    return F.xxhash64("field", F.sort_array("w"))


def near_duplicates(fields: dict[str, DataFrame], similarity: float = SIMILARITY, min_words: int = MIN_WORDS, block: int = BLOCK, part: int = PART, sent: float = SENT) -> NearDuplicates:
    """Records of each field (a frame of id, text) whose word multisets are similar enough.

    Similarity is the number of words both have over that of the words of either, with repetition; words are maximal
    runs of letters and digits of the lower-cased text. Records with fewer than min_words words, and null, empty or
    blank texts, are not compared; an id met again with the same text counts once. Texts of any length are read whole.
    Empty frames give empty results, ties do not arise, other columns than id and text are not looked at.

    Records of equal words form one class: copies, however many, are signed once per batch and met once per part.
    """
    texts = reduce(DataFrame.unionByName, [df.where("id is not null and text is not null").select(F.lit(k).alias("field"), F.col("id").cast("bigint").alias("id"), "text") for k, df in fields.items()])
    rows = settled(texts, w=words(F.col("text"))).where(F.size("w") >= min_words)
    levels = Levels(similarity, min_words)
    # words are few and occur often: the dictionaries of the columns take most of the bytes away
    hashed = written(
        rows.select("field", "id", _class().alias("class"), F.size("w").alias("n"), F.transform("w", lambda w: F.xxhash64(w, F.col("field"))).alias("words")), **{"parquet.dictionary.page.size": str(DICTIONARY)}
    )
    ids = hashed.select("field", "id", "class", "n")
    reps = ids.groupBy("field", "class").agg(F.min("id").alias("rep"))
    members = written(ids.select("field", "id", "class").distinct().join(reps, ["field", "class"]).select("field", "id", "rep"))

    level = F.size(F.filter(F.array(*(F.lit(int(b)) for b in levels.first if b < 1 << 31)), lambda b: b <= F.col("n"))) - 1
    held = {int(r.l): (int(r.c), int(r.s)) for r in ids.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).collect()}  # one row per level
    no_links = NearDuplicates(members, cut(members.select("field", F.col("id").alias("a"), F.col("rep").alias("b"), F.lit(0).alias("shared"), F.lit(0.0).alias("similarity")).limit(0)))
    if not held:
        return no_links
    parts, rounds = plan(levels, held, part, sent)
    met = []
    for since, upto in rounds:
        own = [k for k, (begin, many) in parts.items() if begin < upto and begin + many > since]
        shortest, longest = int(levels.first[max(own[0] - 1, 0)]), int(levels.first[own[-1] + 1]) - 1
        records = hashed.where(F.col("n").between(shortest, longest)).select("class", "n", F.xxhash64("field").alias("tag"), "words")
        signed = records.mapInArrow(_sign(levels, parts, since, upto), "part int, data binary")
        met.append(written(signed.repartitionById(upto - since, F.col("part")).mapInArrow(_meetings(levels, block), _MET)))
    met = reduce(DataFrame.unionByName, met)
    pairs = met.where("ca is not null").select("ca", "cb")
    full = met.where("cell is not null").select("cell", "data")
    if not full.isEmpty():
        pairs = pairs.unionByName(full.groupBy("cell").applyInArrow(_cells(levels), "ca bigint, cb bigint"))
    pairs = written(pairs.distinct())
    wanted = pairs.select(F.col("ca").alias("class")).union(pairs.select(F.col("cb").alias("class"))).distinct()
    needed = cut(reps.join(wanted, "class").select("field", F.col("rep").alias("id"), "class"))
    kept = texts.join(small(needed), ["field", "id"])
    kept = settled(kept, w=words(F.col("text"))).where(_class() == F.col("class")).dropDuplicates(["class"]).select("class", "text")
    left, right = kept.select(F.col("class").alias("ca"), F.col("text").alias("ta")), kept.select(F.col("class").alias("cb"), F.col("text").alias("tb"))
    both = pairs.join(left, "ca").join(right, "cb")
    hashes = lambda c: F.transform(words(F.col(c)), lambda w: F.xxhash64(w))
    counted = both.select("ca", "cb", hashes("ta").alias("wa"), hashes("tb").alias("wb")).mapInArrow(_shared, "ca bigint, cb bigint, shared int, both int")
    enough = counted.where(F.col("shared") >= similarity * (F.col("both") - F.col("shared")) - 1e-9)
    name = lambda c, i: needed.select(F.col("class").alias(c), F.col("id").alias(i), *(["field"] if i == "ia" else []))
    links = (
        enough.join(name("ca", "ia"), "ca")
        .join(name("cb", "ib"), "cb")
        .select("field", F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), "shared", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity"))
    )
    return NearDuplicates(members, written(links))


def all_pairs(found: NearDuplicates) -> DataFrame:
    """field, id_a, id_b (id_a < id_b): every similar pair of records, copies included."""
    m = found.members
    a, b = m.select("field", F.col("id").alias("x"), F.col("rep").alias("a")), m.select("field", F.col("id").alias("y"), F.col("rep").alias("b"))
    across = found.links.select("field", "a", "b").join(a, ["field", "a"]).join(b, ["field", "b"]).select("field", "x", "y")
    several = m.groupBy("field", "rep").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("field", "rep")
    copies = m.join(several, ["field", "rep"], "left_semi")
    within = copies.select("field", "rep", F.col("id").alias("x")).join(copies.select("field", "rep", F.col("id").alias("y")), ["field", "rep"]).where("x < y").select("field", "x", "y")
    return across.unionByName(within).select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def groups(found: NearDuplicates) -> DataFrame:
    """field, id, rep, group_id, n_links of every record that has a similar one: its class, its group and how many classes it is linked to.

    group_id is the least representative of all classes that are linked, directly or through others, in the field.
    """
    key = lambda c: F.concat_ws(":", "field", F.lpad(F.col(c).cast("string"), 20, "0"))
    linked = connected_components(found.links.select(key("a").alias("ka"), key("b").alias("kb")), "ka", "kb") if not found.links.isEmpty() else None
    ends = found.links.select("field", F.col("a").alias("rep")).unionAll(found.links.select("field", F.col("b").alias("rep"))).groupBy("field", "rep").agg(F.count(F.lit(1)).alias("n_links"))
    copies = found.members.groupBy("field", "rep").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("field", "rep")
    own = ends.join(copies.withColumn("copied", F.lit(True)), ["field", "rep"], "full")
    if linked is not None:
        own = own.withColumn("node", key("rep")).join(linked, "node", "left").withColumn("group_id", F.coalesce(F.substring_index("component", ":", -1).cast("bigint"), F.col("rep")))
    else:
        own = own.withColumn("group_id", F.col("rep"))
    return found.members.join(own.select("field", "rep", "group_id", F.coalesce("n_links", F.lit(0)).alias("n_links")), ["field", "rep"]).select("field", "id", "rep", "group_id", "n_links")


def kb_fields(note_files: DataFrame, parsed_notes: DataFrame, author_regions: DataFrame) -> dict[str, DataFrame]:
    """The three compared fields as frames of id and text."""
    return {
        "body": note_files.select(F.col("note_id").alias("id"), F.col("body").alias("text")),
        "title": parsed_notes.select(F.col("note_id").alias("id"), F.col("title").alias("text")),
        "source_text": author_regions.select(F.col("region_no").alias("id"), F.col("source_text").alias("text")),
    }
