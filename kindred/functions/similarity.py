"""Similarity of two strings or token lists; 0 where a side has nothing to compare."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters up to which a pair is compared together with others, and stretches that are.
LONG, AT_ONCE = 200, 2048


def matched_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp: 2 M / T over the longest matching blocks. Not symmetric."""
    return 1.0 if a == b else SequenceMatcher(None, a, b, autojunk=False).ratio()


def _codes(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of both lists as (position, string) matrices; 0 and 1 stand beyond the strings' ends."""
    sides = [np.frombuffer("".join(x).encode("utf-32-le", "surrogatepass"), np.uint32) for x in (left, right)]
    used = np.zeros(max((int(x.max()) for x in sides if len(x)), default=0) + 1, bool)
    for x in sides:
        used[x] = True
    place = np.cumsum(used) + 1
    kind = np.uint8 if place[-1] < 256 else np.uint16 if place[-1] < 65536 else np.uint32
    made = []
    for beyond, (strings, x) in enumerate(zip((left, right), sides)):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        out = np.full((len(strings), int(sizes.max(initial=0))), beyond, kind)
        out[np.arange(out.shape[1]) < sizes[:, None]] = place[x]
        made.append(np.ascontiguousarray(out.T))
    return made[0], made[1]


def _longest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, end in a, end in b) of the first longest common block of each pair of columns."""
    size, at_a, at_b = (np.zeros(a.shape[1], np.int64) for _ in range(3))
    run = np.zeros((b.shape[0] + 1, a.shape[1]), np.uint8)
    most = np.zeros(a.shape[1], np.uint8)
    for i in range(a.shape[0]):
        same = b == a[i]
        run[1:] = (run[:-1] + 1) * same
        here = run.max(axis=0)
        better = np.flatnonzero(here > most)
        if len(better):
            most[better] = here[better]
            size[better], at_a[better], at_b[better] = here[better], i + 1, run[:, better].argmax(axis=0)
    return size, at_a, at_b


def matched_ratios(left: list[str], right: list[str]) -> np.ndarray:
    """matched_ratio of each pair, for all pairs at once: what lies before and after the
    longest blocks of all pairs is looked at together, until nothing matches."""
    sizes = [np.fromiter(map(len, x), np.int64, len(x)) for x in (left, right)]
    total, matches = sizes[0] + sizes[1], np.zeros(len(left), np.int64)
    long = np.maximum(*sizes) > LONG
    short = np.flatnonzero(~long)
    if len(short):
        a, b = _codes([left[i] for i in short], [right[i] for i in short])
        todo = np.stack([np.arange(len(short)), np.zeros(len(short), np.int64), sizes[0][short], np.zeros(len(short), np.int64), sizes[1][short]])
        while todo.shape[1]:
            todo = todo[:, (todo[1] < todo[2]) & (todo[3] < todo[4])]
            width, rest = np.maximum(todo[2] - todo[1], todo[4] - todo[3]), []
            for least, most in zip((0, 4, 8, 16, 32, 64), (4, 8, 16, 32, 64, LONG)):
                own = todo[:, (width > least) & (width <= most)]
                for part in (own[:, i : i + AT_ONCE] for i in range(0, own.shape[1], AT_ONCE)):
                    rest += _matched(a, b, part, short, matches)
            todo = np.concatenate(rest, axis=1) if rest else todo[:, :0]
    with np.errstate(invalid="ignore"):
        out = np.where(total > 0, 2.0 * matches / np.maximum(total, 1), 1.0)
    for i in np.flatnonzero(long):
        out[i] = matched_ratio(left[i], right[i])
    return out


def _matched(a: np.ndarray, b: np.ndarray, part: np.ndarray, short: np.ndarray, matches: np.ndarray) -> list[np.ndarray]:
    """Adds the longest blocks of stretches (pair, from and to in a, from and to in b) to matches; gives the stretches beside them."""
    pair, a0, a1, b0, b1 = part
    cut = []
    for codes, first, last, beyond in ((a, a0, a1, 0), (b, b0, b1, 1)):
        at = np.arange(int((last - first).max()))[:, None] + first
        stretch = codes[np.minimum(at, codes.shape[0] - 1), pair]
        stretch[at >= last] = beyond
        cut.append(stretch)
    size, at_a, at_b = _longest(*cut)
    hit = size > 0
    pair, a0, a1, b0, b1, size, at_a, at_b = (x[hit] for x in (pair, a0, a1, b0, b1, size, at_a, at_b))
    np.add.at(matches, short[pair], size)
    return [np.stack([pair, a0, a0 + at_a - size, b0, b0 + at_b - size]), np.stack([pair, a0 + at_a, a1, b0 + at_b, b1])]


def ratios(left: list[str | None], right: list[str | None]) -> np.ndarray:
    """matched_ratios, NaN where either side is null; equal pairs are computed once."""
    seen: dict[tuple[str, str], int] = {}
    place = [-1 if pair[0] is None or pair[1] is None else seen.setdefault(pair, len(seen)) for pair in zip(left, right)]
    return np.append(matched_ratios([p[0] for p in seen], [p[1] for p in seen]), np.nan)[place]


def count_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.least(a, b).cast("double"), F.greatest(a, b).cast("double")), F.lit(0.0))


def length_ratio(a: Column, b: Column) -> Column:
    return count_ratio(F.length(a), F.length(b))


def bigrams(s: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single character stands for itself."""
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))
    return F.when(F.length(s) < 2, F.filter(F.array(s), lambda x: x != "")).otherwise(pairs)


def jaccard(a: Column, b: Column) -> Column:
    """Of two lists without duplicates."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), (F.size(a) + F.size(b) - both).cast("double")), F.lit(0.0))


def strict_bigram_jaccard(a: Column, b: Column) -> Column:
    """The diagnosis' own measure: strings under two characters have no bigrams, and are 1 if equal, else 0."""
    short = (F.length(a) < 2) | (F.length(b) < 2)
    return F.when(short, (a == b).cast("double")).otherwise(jaccard(bigrams(a), bigrams(b)))
