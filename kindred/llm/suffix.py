"""Removal of repeated byte strings by bucket-pointer refinement.

Bucket-pointer refinement sorts suffixes bucket by bucket: q-gram buckets first; then every
bucket is split by the bucket pointers found at a later offset, the pointers are updated at
once, and the next split uses them, so that the depth doubles; what is alone in its bucket
is done. Here the depth ends at 50 bytes, and the first buckets are laid out so that they
can lie in different tasks:

1. A start's first bucket is the 25-gram of least hash in its 50 bytes. Neighbouring starts
   share it, so a run of some 13 starts costs one name, a hash of the gram. A bucket that only
   one document has is done.
2. The other runs are sent, as bytes, to the task that owns their bucket. Within it, buckets
   of 8-grams are refined by the pointers 8, 16 and 18 bytes further on to depths of 16, 32
   and 50; then two starts have one pointer if and only if their 50 bytes are equal.

Hashes only bring strings together; that two are equal is decided by their bytes.

Documents lie in chunks of consecutive ids, so that "in a smaller document" is "in a smaller
chunk, or earlier in this one". A chunk sends each distinct run once, and gets a bit for each
of its starts back. No row stands for a position, and no group of copies meets in one task: a
run comes once from a chunk however often it occurs there.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import Scratch
from .workers import claim

LENGTH = 50
_HALF = LENGTH // 2
#: Starts hashed at once: what fits into a processor's cache.
_BLOCK = 1 << 14
#: Bytes of runs that are refined or compared at once, whole buckets at a time.
_SLICE = 1 << 20
#: Text that a task holds at once: at least, and at most.
LEAST_CHUNK, MOST_CHUNK = 4e6, 128e6
#: Cells of ids that chunk bounds are found in.
CELLS = 1024
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_random = np.random.default_rng(50)
_BYTE = _random.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(1, 1 << 63, 2 * LENGTH, np.uint64) * np.uint64(2) + np.uint64(1)
#: Kinds of rows between chunks and ranges: names or runs, and what a chunk keeps for later.
COPIES, FIRST, RUNS, KEEP = 0, 1, 2, 10
_MESSAGE = pa.schema([("range", pa.int64()), ("chunk", pa.int64()), ("kind", pa.int32()), ("part", pa.int64()), ("data", pa.binary())])
_MESSAGE_SQL = "range long, chunk long, kind int, part long, data binary"


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of two adjoining strings -> name of both."""
    h = a * _A
    h += b
    h ^= h >> np.uint64(32)
    h *= _B
    return h


def least_grams(data: np.ndarray) -> np.ndarray:
    """48-bit name of the 25-gram of least hash in each 50-byte string of data."""
    h1 = _BYTE[data]
    h2 = _join(h1[:-1], h1[1:])
    h4 = _join(h2[:-2], h2[2:])
    h8 = _join(h4[:-4], h4[4:])
    h16 = _join(h8[:-8], h8[8:])
    h24 = _join(h16[:-8], h8[16:])
    least = _join(h24[:-1], h1[24:])
    for step in (1, 2, 4, 8, 10):  # 26 grams lie in 50 bytes
        least = np.minimum(least[:-step], least[step:])
    return _join(least, least) >> np.uint64(16)  # least hashes crowd at the low end; mixed anew, they spread


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... for each length in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


def _cuts(lengths: np.ndarray, most: int, whole: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Ranges of places with at most so much length each; equal neighbours in whole stay together."""
    share = (np.cumsum(lengths) - lengths) // most
    if whole is not None and len(whole):
        first = np.concatenate([[True], whole[1:] != whole[:-1]])
        share = share[first][np.cumsum(first) - 1]
    ends = np.flatnonzero(np.diff(share)) + 1
    return list(zip([0, *ends.tolist()], [*ends.tolist(), len(lengths)])) if len(lengths) else []


def distinct(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of each run's text, a run of each text); runs of one number have equal bytes."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sums = np.empty(len(first), np.uint64)
    cuts = _cuts(size, _SLICE)
    for a, b in cuts:
        at = _within(size[a:b])
        values = (data[np.repeat(first[a:b], size[a:b]) + at].astype(np.uint64) + np.uint64(1)) * _PLACE[at]
        sums[a:b] = np.add.reduceat(values, np.cumsum(size[a:b]) - size[a:b])
    order = np.lexsort((size, sums))
    new = np.ones(len(order), bool)
    new[1:] = (sums[order][1:] != sums[order][:-1]) | (size[order][1:] != size[order][:-1])
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    other = np.zeros(len(first), bool)
    for a, b in cuts:
        at, model = _within(size[a:b]), first[one[number[a:b]]]
        unequal = data[np.repeat(first[a:b], size[a:b]) + at] != data[np.repeat(model, size[a:b]) + at]
        other[a:b] = np.add.reduceat(unequal.astype(np.int64), np.cumsum(size[a:b]) - size[a:b]) > 0
    if other.any():  # equal sums of different texts
        left = np.flatnonzero(other)
        again, more = distinct(data, first[left], size[left])
        number[left] = len(one) + again
        one = np.concatenate([one, left[more]])
    return number, one


def refine(flat: np.ndarray) -> np.ndarray:
    """Bucket pointers at depth 50 for every place of flat at which 50 bytes begin, in suffix order."""
    n = len(flat)
    padded = np.concatenate([flat, np.zeros(8, np.uint8)]).astype(np.uint64)
    gram = np.zeros(n, np.uint64)
    for i in range(8):
        gram |= padded[i : i + n] << np.uint64(56 - 8 * i)
    order = np.argsort(gram)
    new = np.concatenate([[True], gram[order][1:] != gram[order][:-1]])
    begin = np.flatnonzero(new)
    number = np.cumsum(new) - 1
    pointer = np.zeros(n + LENGTH, np.uint64)
    pointer[order] = begin[number]
    live = order[np.diff(np.append(begin, n))[number] > 1]
    for offset in (8, 16, 18):
        if not len(live):
            break
        key = pointer[live] << np.uint64(32) | pointer[live + offset]
        order = np.argsort(key)
        live, key = live[order], key[order]
        old, new = (np.concatenate([[True], k[1:] != k[:-1]]) for k in (key >> np.uint64(32), key))
        begin, number = np.flatnonzero(new), np.cumsum(new) - 1
        bucket = np.flatnonzero(old)[np.cumsum(old)[new] - 1]
        pointer[live] = ((key[new] >> np.uint64(32)) + (begin - bucket).astype(np.uint64))[number]
        live = live[np.diff(np.append(begin, len(live)))[number] > 1]
    return pointer[:n].astype(np.int64)


def classes(data: np.ndarray, first: np.ndarray, size: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """A number for every start of distinct texts, in their order; equal if and only if the 50 bytes are.

    Texts of different buckets hold no equal strings, and one that is alone in its bucket
    needs no refinement (its own repeats get different numbers).
    """
    starts = size - LENGTH + 1
    base = np.cumsum(starts) - starts
    out = np.arange(int(starts.sum()))
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    alone = np.ones(len(b), bool)
    alone[1:] &= b[1:] != b[:-1]
    alone[:-1] &= b[1:] != b[:-1]
    order = order[~alone]
    for s, e in _cuts(size[order], _SLICE, bucket[order]):
        own = order[s:e]
        flat = data[np.repeat(first[own], size[own]) + _within(size[own])]
        pointer = refine(flat)
        place = np.repeat(np.cumsum(size[own]) - size[own], starts[own]) + _within(starts[own])
        target = np.repeat(base[own], starts[own]) + _within(starts[own])
        one = np.zeros(len(flat), np.int64)
        one[pointer[place]] = target  # any start of the class stands for it
        out[target] = one[pointer[place]]
    return out


def _least(classes_of: np.ndarray, starts: np.ndarray, holder: np.ndarray) -> np.ndarray:
    """For every start of the texts, the least holder of a text that has its string."""
    least = np.full(len(classes_of), np.iinfo(np.int64).max)
    np.minimum.at(least, classes_of, np.repeat(holder, starts))
    return least[classes_of]


def _holders(number: np.ndarray, texts: int, holder: np.ndarray) -> np.ndarray:
    least = np.full(texts, np.iinfo(np.int64).max)
    np.minimum.at(least, number, holder)
    return least


class Chunk:
    """Documents of consecutive ids, in order, and how far their starts are decided.

    Names are made a cache-sized block at a time and kept for runs alone, so a chunk takes a
    few bytes of memory for each byte of text.
    """

    def __init__(self, keys: list, texts: list[bytes], copies: dict[bytes, int]):
        self.order = sorted(range(len(keys)), key=lambda i: (keys[i] is None, keys[i], texts[i]))  # however the rows came
        self.keys, self.texts = keys, texts
        sizes = {d[16:] for d in copies}
        self.copies = {i for i, k in enumerate(keys) if k is not None and (n := len(texts[i]).to_bytes(8)) in sizes and copies.get(hashlib.md5(texts[i]).digest() + n, k) < k}
        self.live = [i for i in self.order if keys[i] is not None and i not in self.copies and len(texts[i]) >= LENGTH]
        self.data = np.frombuffer(b"".join(texts[i] for i in self.live), np.uint8)
        self.begins = np.cumsum([0, *(len(texts[i]) for i in self.live)], dtype=np.int64)
        rank, doc, last = [], -1, None
        for i in self.live:  # rows of one id are one document
            doc, last = (doc, last) if keys[i] == last else (doc + 1, keys[i])
            rank.append(doc)
        parts = [self._runs(at) for at in range(0, len(self.data) - LENGTH + 1, _BLOCK)]
        kinds = (np.int64, np.int64, np.uint64, np.int32)
        self.first, self.starts, self.bucket, row = (np.concatenate([np.zeros(0, k), *c]) for k, c in zip(kinds, zip(*parts) if parts else [()] * 4))
        self.doc = np.array(rank, np.int64)[row] if len(row) else np.zeros(0, np.int64)

    def _runs(self, at: int) -> tuple[np.ndarray, ...]:
        """Runs of starts of one block with the same bucket and document, at most 26 long."""
        bucket = least_grams(self.data[at : at + _BLOCK + LENGTH - 1])
        n = len(bucket)
        lo, hi = np.searchsorted(self.begins, [at, at + n - 1], "right") - 1
        row = np.repeat(np.arange(lo, hi + 1, dtype=np.int32), np.diff(np.concatenate([[at], self.begins[lo + 1 : hi + 1], [at + n]])))
        inside = np.flatnonzero(np.arange(at + LENGTH, at + LENGTH + n) <= self.begins[row + 1])
        bucket, row = bucket[inside], row[inside]
        new = np.ones(len(inside), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1])
        place = np.arange(len(inside))
        place -= np.maximum.accumulate(np.where(new, place, 0))
        new |= place % (_HALF + 1) == 0
        first = np.flatnonzero(new)
        return inside[first] + at, np.diff(np.append(first, len(inside))), bucket[first], row[first]

    def names(self) -> np.ndarray:
        """Distinct buckets in order; many: those that two documents of this chunk have."""
        found, first, self.name = np.unique(self.bucket, return_index=True, return_inverse=True)
        self.many = np.zeros(len(found), bool)
        self.many[self.name[self.doc != self.doc[first][self.name]]] = True
        return found

    def shared(self, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(runs of such buckets, number of each one's text, a run of each text), texts in order of bucket."""
        runs = np.flatnonzero(buckets[self.name])
        number, one = distinct(self.data, self.first[runs], self.starts[runs] + LENGTH - 1)
        order = np.argsort(self.bucket[runs[one]], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return runs, place[number] if len(runs) else number, runs[one[order]]

    def spans(self, elsewhere: np.ndarray, smaller: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(place, removed spans as rows of begin and end) of every document.

        elsewhere: buckets that other chunks have; smaller: for every start of their texts,
        whether a smaller chunk has it.
        """
        repeated = np.zeros(len(self.data), bool)
        for buckets, told in ((elsewhere, smaller), (self.many, None)):
            runs, number, one = self.shared(buckets)
            starts = self.starts[one]
            if told is None:
                numbers = classes(self.data, self.first[one], starts + LENGTH - 1, self.bucket[one])
                least = _least(numbers, starts, _holders(number, len(one), self.doc[runs]))
            base = np.cumsum(starts) - starts
            for a, b in _cuts(self.starts[runs], _SLICE):
                own, length = runs[a:b], self.starts[runs[a:b]]
                text = np.repeat(base[number[a:b]], length) + _within(length)
                hit = told[text] if told is not None else least[text] < np.repeat(self.doc[own], length)
                repeated[(np.repeat(self.first[own], length) + _within(length))[hit]] = True
        covered = np.cumsum(repeated, dtype=np.int32)
        covered[LENGTH:] -= covered[:-LENGTH].copy()
        covered = covered > 0
        where = {i: n for n, i in enumerate(self.live)}
        for i in self.order:
            text = self.texts[i]
            if i in where:
                own = covered[self.begins[where[i]] : self.begins[where[i] + 1]]
                turns = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
                yield i, turns.reshape(-1, 2)
            elif i in self.copies:
                yield i, np.array([[0, len(text)]])
            else:
                yield i, np.zeros((0, 2), np.int64)


def _owner(bucket: np.ndarray, ranges: int) -> np.ndarray:
    return ((bucket >> np.uint64(24)) * np.uint64(ranges) >> np.uint64(24)).astype(np.int64)


def _low(column: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(column.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _number(data: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = data.reshape(-1, width)
    return out.view("<u8").ravel()


def _name_parts(found: np.ndarray, ranges: int) -> list[tuple[int, bytes]]:
    """(range, names of 48 bits that it owns)."""
    cuts = np.searchsorted(_owner(found, ranges), np.arange(ranges + 1))
    data = _low(found, 6)
    return [(r, data[a:b].tobytes()) for r, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a]


def _run_parts(chunk: Chunk, one: np.ndarray, ranges: int) -> list[tuple[int, bytes]]:
    """(range, texts that it owns): their number, then starts, buckets and bytes of each."""
    bucket, starts = chunk.bucket[one], chunk.starts[one]
    cuts = np.searchsorted(_owner(bucket, ranges), np.arange(ranges + 1))
    out = []
    for r in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[r], cuts[r + 1])
        size = starts[own] + LENGTH - 1
        text = chunk.data[np.repeat(chunk.first[one[own]], size) + _within(size)]
        out.append((r, len(size).to_bytes(8, "little") + starts[own].astype(np.uint8).tobytes() + _low(bucket[own], 6).tobytes() + text.tobytes()))
    return out


def _runs_of(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, buckets, bytes) of the texts in a message."""
    n = int.from_bytes(data[:8], "little")
    raw = np.frombuffer(data, np.uint8, offset=8)
    return raw[:n].astype(np.int64), _number(raw[n : 7 * n], 6), raw[7 * n :]


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, _MESSAGE)], schema=_MESSAGE)


def _bits(flags: np.ndarray) -> bytes:
    return len(flags).to_bytes(8, "little") + np.packbits(flags).tobytes()


def _flags(data: bytes | None) -> np.ndarray:
    if data is None:
        return np.zeros(0, bool)
    return np.unpackbits(np.frombuffer(data, np.uint8, offset=8), count=int.from_bytes(data[:8], "little")).astype(bool)


def shared_names(asks: list[bytes]) -> list[np.ndarray]:
    """For each chunk's names, whether another chunk has them."""
    names = [_number(np.frombuffer(a, np.uint8), 6) for a in asks]
    every = np.concatenate(names)
    order = np.argsort(every, kind="stable")
    same = every[order][1:] == every[order][:-1]
    flags = np.empty(len(every), bool)
    flags[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return np.split(flags, np.cumsum([len(n) for n in names])[:-1])


def earlier_starts(asks: list[bytes]) -> list[np.ndarray]:
    """For each chunk's texts, in order of chunk, whether an earlier one has the string at each start."""
    parts = [_runs_of(a) for a in asks]
    starts, bucket, data = (np.concatenate(c) for c in zip(*parts))
    holder = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    size = starts + LENGTH - 1
    number, one = distinct(data, np.cumsum(size) - size, size)
    first = (np.cumsum(size) - size)[one]
    texts = starts[one]
    least = _least(classes(data, first, size[one], bucket[one]), texts, _holders(number, len(one), holder))
    base = np.cumsum(texts) - texts
    out = []
    ends = np.cumsum([len(p[0]) for p in parts])
    for n, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())):
        out.append(least[np.repeat(base[number[a:b]], starts[a:b]) + _within(starts[a:b])] < n)
    return out


def _own(rows: pa.Table) -> pa.Table:
    """Answers of one range to the chunks that asked."""
    claim("suffix")
    rows = rows.select(_MESSAGE.names).sort_by([("chunk", "ascending"), ("kind", "ascending"), ("part", "ascending")])
    kinds = np.array(rows["kind"].to_pylist())
    asks = np.flatnonzero(kinds < KEEP).tolist()
    out = [tuple(rows[c][i].as_py() for c in _MESSAGE.names) for i in np.flatnonzero(kinds >= KEEP).tolist()]
    if asks:
        answer = shared_names if kinds[asks[0]] == FIRST else earlier_starts
        for i, flags in zip(asks, answer([rows["data"][i].as_py() for i in asks])):
            out.append((rows["range"][i].as_py(), rows["chunk"][i].as_py(), int(kinds[i]), rows["part"][i].as_py(), _bits(flags)))
    return _table(out)


class _Learnt:
    """What a chunk has been told so far."""

    def __init__(self, rows: pa.Table):
        self.keep: dict[int, bytes] = {}
        copies: list[bytes] = []
        new: dict[int, list[tuple[int, bytes]]] = {}
        for kind, part, data in zip(rows["kind"].to_pylist(), rows["part"].to_pylist(), rows["data"].to_pylist()):
            if kind == COPIES:
                copies.append(part.to_bytes(8, "little", signed=True) + data)
            elif kind >= KEEP:
                self.keep[kind - KEEP] = data
            else:
                new.setdefault(kind, []).append((part, data))
        if copies:
            self.keep[COPIES] = b"".join(sorted(copies))
        data = self.keep.get(COPIES, b"")
        self.copies = {data[a + 8 : a + 32]: int.from_bytes(data[a : a + 8], "little", signed=True) for a in range(0, len(data), 32)}
        for kind, parts in new.items():
            self.keep[kind] = _bits(np.concatenate([_flags(d) for _, d in sorted(parts)]))


def _chunk(docs: pa.Table, told: _Learnt) -> Chunk:
    return Chunk(docs["key"].to_pylist(), docs["text"].to_pylist(), told.copies)


def _elsewhere(chunk: Chunk, told: _Learnt) -> np.ndarray:
    found, flags = chunk.names(), _flags(told.keep.get(FIRST))
    return flags if len(flags) else np.zeros(len(found), bool)


def _asking(kind: int, ranges: int):
    def ask(group, left: pa.Table, right: pa.Table) -> pa.Table:
        claim("suffix")
        learnt, at = _Learnt(right), group[0].as_py()
        if not len(left):
            return _table([])
        chunk = _chunk(left, learnt)
        if kind == FIRST:
            parts = _name_parts(chunk.names(), ranges)
        else:
            parts = _run_parts(chunk, chunk.shared(_elsewhere(chunk, learnt))[2], ranges)
        return _table([(r, at, kind, r, data) for r, data in parts] + [(at % ranges, at, KEEP + k, 0, v) for k, v in learnt.keep.items()])

    return ask


def _cell(key: Column, bounds: list[int]) -> Column:
    """How many bounds lie below key; found in two steps, so the cost is the root of their number."""
    step = max(1, math.isqrt(len(bounds)))
    tops = bounds[step - 1 :: step]
    lows = [bounds[i : i + step] for i in range(0, len(tops) * step + 1, step)]
    below = lambda items: F.size(F.filter(items, lambda b: b < key))
    literal = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs)) if xs else F.array().cast("array<bigint>")
    coarse = below(literal(tops))
    return (coarse * step + below(F.get(F.array(*map(literal, lows)), coarse))).cast("long")


def chunked(texts: DataFrame, scratch: Scratch, chunk_bytes: int | None = None) -> tuple[DataFrame, int]:
    """texts(key, text, ...) with the chunk of each, which rises with key, and about how many there are.

    A chunk holds chunk_bytes of text, and the document that exceeds it; rows of one key lie
    in one chunk, rows without a key in chunks of their own (below zero). The bounds are
    found within at most CELLS quantile cells of keys, and are a small table (8 bytes each).
    """
    sizes, _ = scratch.put(texts.select("key", F.octet_length("text").cast("long").alias("n")), "sizes")
    total = sizes.agg(F.sum("n")).first()[0] or 0
    size = chunk_bytes or int(min(MOST_CHUNK, LEAST_CHUNK * max(1.0, math.sqrt(total / 1e9))))
    count = max(1, math.ceil(total / size))
    keyless = -1 - F.pmod(F.xxhash64("text"), F.lit(count))
    if count == 1:
        return texts.withColumn("chunk", F.when(F.col("key").isNull(), keyless).otherwise(F.lit(0).cast("long"))), count
    cells = min(CELLS, count)
    bounds = sizes.agg(F.percentile_approx("key", [i / cells for i in range(1, cells)], 100 * cells)).first()[0] if cells > 1 else []
    cell = _cell(F.col("key"), sorted(set(bounds or [])))
    before = F.sum("n").over(Window.partitionBy("cell").orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    parts = sizes.where("key is not null").groupBy("key").agg(F.sum("n").alias("n")).withColumn("cell", cell)
    parts = parts.select("cell", "key", F.floor(F.coalesce(before, F.lit(0)) / size).alias("part")).groupBy("cell", "part").agg(F.min("key").alias("low"))
    lows, _ = scratch.put(parts.groupBy("cell").agg(F.collect_list("low").alias("lows")).coalesce(1), "bounds")
    own = texts.withColumn("cell", F.coalesce(cell, F.lit(0).cast("long"))).join(lows, "cell", "left")
    place = F.size(F.filter("lows", lambda b: b <= F.col("key"))).cast("long")
    return own.withColumn("chunk", F.when(F.col("key").isNull(), keyless).otherwise(F.shiftleft("cell", 32) + place)).drop("cell", "lows"), count


def repeated_spans(docs: DataFrame, scratch: Scratch, *, key: str = "doc_id", text: str = "text", chunk_bytes: int | None = None, carry: list[str] | None = None) -> DataFrame:
    """(key, n_bytes, spans array<struct<begin, end>>, kept binary, rest) of every document.

    Spans are the maximal runs of bytes covered by a 50-byte string that also starts in a
    document with a smaller id, judged on the input; kept is the rest. chunk_bytes is the
    text a task holds at once (by default 4 MB, growing with the root of the input to 128 MB);
    a document longer than that, or all rows of one id, lie in one chunk whatever their size.
    rest holds the columns named in carry, which take the same way; without any it is null.

    Null texts are empty. Texts under 50 bytes lose nothing. Rows that share an id are one
    document and take nothing from each other; a row with a null id neither loses nor takes
    anything. An empty table gives no row.
    """
    texts = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), (F.struct(*carry) if carry else F.lit(None).cast("struct<none:int>")).alias("rest"))
    placed, count = chunked(texts, scratch, chunk_bytes)

    # Exact copies: one row for each text and chunk meets the text's least id.
    same = placed.where("key is not null").select("chunk", "key", F.unhex(F.md5("text")).alias("digest"), F.octet_length("text").alias("n")).where(F.col("n") >= LENGTH)
    held, _ = scratch.put(same.groupBy("digest", "n", "chunk").agg(F.min("key").alias("first"), F.max("key").alias("last")), "texts")
    firsts = held.groupBy("digest", "n").agg(F.min("first").alias("least"), F.max("last").alias("most")).where("most > least").select("digest", "n", "least")
    size = F.unhex(F.lpad(F.hex("n"), 16, "0"))
    told = held.join(firsts, ["digest", "n"]).where("last > least").select("chunk", F.lit(COPIES).alias("kind"), F.col("least").alias("part"), F.concat("digest", size).alias("data"))
    answers, _ = scratch.put(told, "copies")

    for kind, ranges in ((FIRST, max(1, count // 4)), (RUNS, count)):
        asked = placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_asking(kind, ranges), _MESSAGE_SQL)
        answers = asked.groupBy("range").applyInArrow(_own, _MESSAGE_SQL).select("chunk", "kind", "part", "data")

    def finish(group, left: pa.Table, right: pa.Table) -> pa.Table:
        claim("suffix")
        learnt = _Learnt(right)
        rows, sizes, spans, kept = [], [], [], []
        if len(left):
            chunk = _chunk(left, learnt)
            for i, own in chunk.spans(_elsewhere(chunk, learnt), _flags(learnt.keep.get(RUNS))):
                t = chunk.texts[i]
                rows.append(i)
                sizes.append(len(t))
                spans.append([{"begin": int(a), "end": int(b)} for a, b in own])
                ends = [0, *own.ravel().tolist(), len(t)]
                kept.append(b"".join(t[a:b] for a, b in zip(ends[::2], ends[1::2])))
        at = pa.array(rows, pa.int64())
        found = [pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())]
        return pa.Table.from_arrays([left["key"].take(at), *found, left["rest"].take(at)], ["key", "n_bytes", "spans", "kept", "rest"])

    kind = placed.schema["rest"].dataType.simpleString()
    out = placed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, f"key long, n_bytes long, spans array<struct<begin: long, end: long>>, kept binary, rest {kind}")
    return out.withColumnRenamed("key", key)


def without_repeats(docs: DataFrame, scratch: Scratch, *, key: str = "doc_id", text: str = "text", length: str = "n_chars", chunk_bytes: int | None = None) -> DataFrame:
    """docs with what repeats cut out of text and length (if there) counted anew.

    A document of which nothing is left is a copy of earlier ones and goes; one that was
    empty before stays. A character that a cut parts loses its other bytes, too. The columns
    and their order stay.
    """
    others = [c for c in docs.columns if c not in (key, text)]
    found = repeated_spans(docs, scratch, key=key, text=text, chunk_bytes=chunk_bytes, carry=others)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [b.decode("utf-8", "ignore") for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.string()), batch.column(2)], ["key", "kept", "rest"])

    kept = found.where("n_bytes = 0 or octet_length(kept) > 0").select(F.col(key).alias("key"), "kept", "rest")
    kept = kept.mapInArrow(whole, f"key long, kept string, rest {kept.schema['rest'].dataType.simpleString()}")
    column = {key: F.col("key").cast(docs.schema[key].dataType).alias(key), text: F.col("kept").alias(text)}
    if length in others:
        column[length] = F.length("kept").cast(docs.schema[length].dataType).alias(length)
    return kept.select(*(column.get(c, F.col("rest").getField(c).alias(c)) for c in docs.columns))
