"""Token counts by a linear longest-match automaton.

The vocabulary is a trie of pieces. A node's failure link leads where reading
goes on after the longest pieces at the front of what has been read are split off; how many
pieces that takes is stored beside the link. So a word's greedy longest-match pieces are
counted in one pass over its bytes, and no piece is built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import bpe
from .workers import claim

#: Added to a word's last byte: an ending is another symbol than the same byte inside a word.
_LAST = 256


class LongestMatch:
    """Counts greedy longest-match pieces of words.

    pieces: (byte string, whether it ends a word). With marked False no piece is bound to
    the end of a word.
    """

    def __init__(self, pieces: Iterable[tuple[bytes, bool]], marked: bool = True):
        self.last = _LAST if marked else 0
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for data, ends in pieces:
            node = 0
            for b in [*data[:-1], data[-1] + self.last * ends]:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                node = self.next[node][b]
            whole[node] = node != 0
        self.fail, self.pops = [-1] * len(whole), [0] * len(whole)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for b, child in self.next[node].items():
                if whole[child]:
                    self.fail[child], self.pops[child] = 0, 1
                else:
                    at, pops = self.fail[node], self.pops[node]
                    while at >= 0 and b not in self.next[at]:
                        pops += self.pops[at]
                        at = self.fail[at]
                    if at >= 0:
                        self.fail[child], self.pops[child] = self.next[at][b], pops
                queue.append(child)

    def count(self, word: bytes) -> int | None:
        """Number of pieces, None if the pieces can't make the word."""
        if not word:
            return 0
        node, total = 0, 0
        following, fail, pops = self.next, self.fail, self.pops
        for b in [*word[:-1], word[-1] + self.last]:
            while (to := following[node].get(b)) is None:
                if fail[node] < 0:
                    return None
                total += pops[node]
                node = fail[node]
            node = to
        while node:
            if fail[node] < 0:
                return None
            total += pops[node]
            node = fail[node]
        return total


class Counter:
    """Counts of a tokenizers file's vocabulary over texts that its own rules split into words."""

    def __init__(self, path: str):
        self.codec = bpe.codec(path)
        symbols, suffix = bpe.byte_of_symbol(), self.codec.transducer.suffix
        special = set(self.codec.added.values())
        pieces = []
        for i, name in enumerate(self.codec.names):
            if name and i not in special:
                ends = bool(suffix) and name.endswith(suffix) and name != suffix
                body = name[: -len(suffix)] if ends else name
                pieces.append((bytes(symbols[c] for c in body), ends))
        self.automaton = LongestMatch(pieces, bool(suffix))
        self.chunks = bpe._Table(self._chunk)

    def _chunk(self, chunk: str) -> int:
        return sum(1 if isinstance(w, int) else self._word(w) for w in self.codec.split_words(chunk))

    def _word(self, word: bytes) -> int:
        n = self.automaton.count(word)
        return 1 if n is None else n  # one unknown piece

    def count(self, text: str | None) -> int:
        return sum(map(self.chunks.__getitem__, (text or "").replace("\n", " ").split(" ")))


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def _release() -> None:
    counter.cache_clear()
    bpe.codec.cache_clear()


def token_counts(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens): greedy longest-match pieces of each whole text; no shuffle.

    A word that the vocabulary can't make counts as one unknown piece. Null and empty texts
    count 0. Repeated rows and null keys stay; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("wordpiece", _release)
        c = counter(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.count(t.as_py()) for t in batch.column(1)], pa.int64())], [key, "n_tokens"])
        c.chunks.clear()
        c.chunks.older = {}

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long")
