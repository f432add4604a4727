"""Byte-pair encoding as a bounded-lookahead streaming transducer, and decoding.

A merge list is proper if no rule uses a symbol that a later rule makes. For such a list
merging by rank equals applying the rules one after another, and text that follows can
change a segmentation only through a chain of rules of rising rank, each of which ends
on the symbol that its forerunner began with. The longest such chain, in bytes, is the
sufficient lookahead: a token that ends that far before the end of what has been read is
final. So a word of any length is encoded in a window of fixed size, and every word goes
through the transducer; a bounded table only remembers what it gave for short ones. A text
is read in portions that end at a blank, and each portion's ids are decoded by a state
machine over bytes before the next is read.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .workers import claim, trim

#: Words kept with their ids in one Python worker, twice over. Results don't depend on it.
CACHED_WORDS = 220_000
#: Bytes of output gathered before a batch goes back to Spark.
BATCH_BYTES = 4_000_000
#: Characters of a text that are encoded and decoded at once, up to the blank that follows.
PORTION = 1 << 16


class _Table(dict):
    """Bounded word table that computes what it lacks; what is used again outlives a clearing."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 64:  # a longer word hardly comes twice
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


def _packed(ids: str) -> bytes:
    """Ids, held as characters, as little-endian unsigned 32-bit integers."""
    return ids.encode("utf-32-le", "surrogatepass")


#: Byte-level symbols: the printable Latin-1 characters stand for themselves, the other bytes for U+0100 on.
def byte_of_symbol() -> dict[str, int]:
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + n): b for n, b in enumerate(rest)}


class MergeTransducer:
    """Encodes words, given as bytes, with a merge list over byte-level symbols.

    With a suffix, the last byte of a word is a symbol of its own (character plus suffix).
    Ids are held as characters of that code point, so a word is a string, a pair of two
    characters is a rule's name, and UTF-32 is the list of its ids.
    """

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str = ""):
        if max(vocab.values(), default=0) > sys.maxunicode:
            raise ValueError("ids must be code points")
        self.suffix = suffix
        symbols = byte_of_symbol()
        self.plain, self.final = [""] * 256, [""] * 256
        for c, b in symbols.items():
            self.plain[b], self.final[b] = chr(vocab[c]), chr(vocab[c + suffix])
        width = {chr(i): len(s) - (len(suffix) if suffix and s.endswith(suffix) and len(s) > len(suffix) else 0) for s, i in vocab.items()}
        self.width = width
        self.rank: dict[str, int] = {}  # pair -> rank of its rule
        self.made: list[str] = []  # rank -> symbol made
        left: dict[str, str] = {}
        self.proper, reach, self.lookahead = True, {}, 0
        used: set[str] = set()
        for rank, (a, b) in enumerate(merges):
            ia, ib, ic = chr(vocab[a]), chr(vocab[b]), chr(vocab[a + b])
            self.rank[ia + ib] = rank
            self.made.append(ic)
            self.proper &= ic not in used
            used |= {ia, ib}
            chain, s = 0, ib  # rules that ib waits for begin on a symbol of its left edge
            while True:
                chain = max(chain, reach.get(s, 0))
                if s not in left:
                    break
                s = left[s]
            left.setdefault(ic, ia)
            reach[ia] = max(reach.get(ia, 0), chain + width[ia])
            self.lookahead = max(self.lookahead, reach[ia])
        self.window = 2 * self.lookahead + max(width.values(), default=1) + 1

    def merge(self, word: str) -> str:
        """All rules applied, the one of least rank first and from left to right."""
        if len(word) > 64:
            return self._merge_long(list(word))
        rank, made, none = self.rank.get, self.made, len(self.made)
        symbols, ranks = list(word), list(map(rank, map(add, word, word[1:]), repeat(none)))
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            symbols[at] = new = made[best]
            del symbols[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank(symbols[at - 1] + new, none)
            if at < len(ranks):
                ranks[at] = rank(new + symbols[at + 1], none)
        return "".join(symbols)

    def _merge_long(self, word: list[str]) -> str:
        """The same, and for any list, with a heap over a linked list."""
        rank, n = self.rank.get, len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i, (a, b) in enumerate(zip(word, word[1:])) if (r := rank(a + b)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            r, i = heapq.heappop(heap)
            if gone[i] or (j := after[i]) >= n or rank(word[i] + word[j]) != r:
                continue
            word[i], gone[j], k = self.made[r], 1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (q := rank(word[i] + word[k])) is not None:
                    heapq.heappush(heap, (q, i))
            if (h := before[i]) >= 0 and (q := rank(word[h] + word[i])) is not None:
                heapq.heappush(heap, (q, h))
        return "".join([x for x, dead in zip(word, gone) if not dead])

    def symbols(self, word: bytes, ended: bool) -> str:
        plain = self.plain
        if not ended:
            return "".join([plain[b] for b in word])
        return "".join([plain[b] for b in word[:-1]]) + self.final[word[-1]]

    def stream(self, parts: Iterable[bytes]) -> Iterator[str]:
        """Ids of one word that arrives in parts, as they are stable; keeps a window of it, whatever its length."""
        if not self.proper:
            parts = [b"".join(parts)]
        held, most = b"", 2 * self.window if self.proper else sys.maxsize
        for part in parts:
            if len(held) + len(part) <= most:
                held += part
                continue
            for at in range(0, len(part), self.window):
                held += part[at : at + self.window]
                if len(held) > most:
                    # The last byte may yet turn out to end the word, so it counts as unread.
                    room, used, stable, merged = len(held) - 1 - self.lookahead, 0, 0, self.merge(self.symbols(held, False))
                    while used + self.width[merged[stable]] <= room:
                        used += self.width[merged[stable]]
                        stable += 1
                    yield merged[:stable]
                    held = held[used:]
        if held:  # the word has ended, so all of it is stable
            yield self.merge(self.symbols(held, True))


class Codec:
    """A tokenizers file: its normalizer and word splitter, our encoder and decoder.

    Only files whose rules make a blank the end of a word are taken; others raise.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain BPE model is needed")
        self.library = Tokenizer.from_file(path)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = MergeTransducer(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(set(t) & set(" \t\n\r\f\v") for t in self.added):
            raise ValueError("an added token holds white space, so blanks don't part a text")
        self._added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        names = {i: s for s, i in model["vocab"].items()} | {i: s for s, i in self.added.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self._symbols = byte_of_symbol()
        self._plain = _plain_pattern(spec)
        self.words = _Table(lambda word: self._word(word.encode()))
        self.chunks = _Table(self._chunk)

    def split_words(self, text: str) -> list[bytes | int]:
        """Words in bytes; added tokens as their ids."""
        if _PLAIN.match(text) and not (self._added and self._added.search(text)):
            return [w.encode() for w in self._plain.findall(text.lower())]
        out: list[bytes | int] = []
        for part in self._added.split(text) if self._added else [text]:
            if part in self.added:
                out.append(self.added[part])
            elif part:
                words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [bytes(map(self._symbols.__getitem__, w)) for w, _ in words]
        return out

    def _word(self, word: bytes) -> bytes:
        return _packed("".join(self.transducer.stream([word])))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([_packed(chr(w)) if isinstance(w, int) else self._word(w) for w in self.split_words(chunk)])

    def _portion(self, part: str) -> bytes:
        """Ids of text that ends at a blank; stretches of plain characters are split into words at once."""
        if self._added and self._added.search(part):
            return b"".join(map(self.chunks.__getitem__, part.replace("\n", " ").split(" ")))
        out, at = [], 0
        while at < len(part):
            end = _PLAIN_TEXT.match(part, at).end()
            if end < len(part):  # back to where the word with another character begins
                end = max(at, part.rfind(" ", at, end) + 1, part.rfind("\n", at, end) + 1)
            out += map(self.words.__getitem__, self._plain.findall(part[at:end].lower()))
            if end < len(part):
                other = _CHUNK.match(part, end)
                out.append(self.chunks[other[0]])
                end = other.end()
            at = end
        return b"".join(out)

    def portions(self, text: str | None, size: int = PORTION) -> Iterator[bytes]:
        """Ids as little-endian unsigned 32-bit integers, a portion of the text at a time.

        What is held is a portion's, and the longest run without a blank.
        """
        at, text = 0, text or ""
        while at < len(text):
            end = text.find(" ", at + size) + 1 or len(text)
            yield self._portion(text[at:end])
            at = end

    def encode(self, text: str | None) -> bytes:
        """All portions at once."""
        return b"".join(self.portions(text))

    def forget(self) -> None:
        """Empties the word tables; for a task's end, as idle Python workers keep their memory."""
        for t in (self.chunks, self.words):
            t.clear()
            t.older = {}
        trim()

    def decode(self, ids: bytes) -> str:
        """What a tokenizers file without decoder gives: token names with blanks between."""
        decoder = StreamDecoder(self)
        return decoder.feed(np.frombuffer(ids, "<u4").tolist()) + decoder.end()

    @cached_property
    def name_bytes(self) -> list[bytes]:
        """For each id, a blank and the token's name."""
        return [b" " + name.encode() for name in self.names]

    @cached_property
    def text_bytes(self) -> list[bytes]:
        """For each id, the bytes that it stands for; the suffix of a word's end is a blank."""
        suffix, special, out = self.transducer.suffix, set(self.added.values()), []
        for i, name in enumerate(self.names):
            ended = bool(suffix) and name.endswith(suffix) and i not in special
            body = name[: -len(suffix)] if ended else name
            out.append((body.encode() if i in special else bytes(self._symbols[c] for c in body)) + b" " * ended)
        return out


#: Characters that no Unicode version normalizes or lower-cases in another way, without white space.
_PLAIN = re.compile("[!-~\u00a1-\u012f\u0131-\u024f]*\\Z")
_PLAIN_TEXT = re.compile("[\n -~\u00a1-\u012f\u0131-\u024f]*")
_CHUNK = re.compile("[^\n ]*")


def _plain_pattern(spec: dict):
    """The file's own split pattern; raises if its rules are not of the one kind that is known here."""
    kinds = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    split, *rest = (spec.get("pre_tokenizer") or {}).get("pretokenizers", None) or [{}]
    known = (
        kinds == ["NFC", "Replace", "Lowercase"]
        and split.get("type") == "Split"
        and split.get("behavior") == "Removed"
        and split.get("invert")
        and [r["type"] for r in rest] == ["ByteLevel"]
        and not rest[0]["add_prefix_space"]
        and not rest[0]["use_regex"]
    )
    if not known or spec.get("decoder"):
        raise ValueError("a tokenizers file is needed that normalizes by NFC, white space and case, keeps the matches of a pattern as words, and has no decoder")
    return _spelt_out(split["pattern"]["Regex"])


def _spelt_out(pattern: str):
    """The pattern with the plain letters and numbers in place of their properties, which the
    standard module finds faster; as it is if a property stands outside of brackets."""
    plain = [chr(c) for c in (*range(0x20, 0x7F), *range(0xA1, 0x130), *range(0x131, 0x250))]
    spelt = pattern
    for kind in "LN":
        spelt = spelt.replace(f"\\p{{{kind}}}", "".join(re.escape(c) for c in plain if unicodedata.category(c)[0] == kind))
    if "\\p" in re.sub(r"\[[^\]]*\]", "", pattern) or "\\p" in spelt or "\\P" in spelt:
        return regex.compile(pattern)
    return re.compile(spelt)


#: Whole characters of one or two bytes, which leave the state machine where it was.
_WHOLE = re.compile(b"(?:[\x00-\x7f]+|[\xc2-\xdf][\x80-\xbf])*")


class ByteTextMachine:
    """Bytes in, text out, in any portions: a state machine over UTF-8.

    State: the bytes still wanted, the value so far, the range for the next byte. What can't
    go on becomes one U+FFFD per longest well-formed beginning.
    """

    def __init__(self):
        self.need, self.value, self.low, self.high = 0, 0, 0x80, 0xBF

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        at = 0
        while at < len(data):
            if not self.need and (run := _WHOLE.match(data, at).end()) > at:
                out.append(data[at:run].decode())
                at = run
                continue
            b = data[at]
            if self.need and not self.low <= b <= self.high:
                out.append("\ufffd")
                self.need, self.low, self.high = 0, 0x80, 0xBF
                continue  # b begins anew
            at += 1
            if self.need:
                self.value, self.need, self.low, self.high = self.value << 6 | b & 0x3F, self.need - 1, 0x80, 0xBF
                if not self.need:
                    out.append(chr(self.value))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.value, self.low, self.high = 2, b & 0x0F, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
            elif 0xF0 <= b <= 0xF4:
                self.need, self.value, self.low, self.high = 3, b & 0x07, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
            else:
                out.append("\ufffd")
        return "".join(out)

    def end(self) -> str:
        left, self.need = self.need, 0
        return "\ufffd" if left else ""


class StreamDecoder:
    """Ids in, text out, in any portions; keeps the state machine alone.

    The text is what the library's decode gives for a file without decoder, or with
    readable the text that the bytes of the ids make.
    """

    def __init__(self, codec: Codec, readable: bool = False):
        self.pieces = codec.text_bytes if readable else codec.name_bytes
        self.skip = 0 if readable else 1  # the blank before the first name
        self.machine = ByteTextMachine()

    def feed(self, ids: Iterable[int]) -> str:
        data = b"".join(map(self.pieces.__getitem__, ids))
        if data and self.skip:
            data, self.skip = data[1:], 0
        return self.machine.feed(data)

    def end(self) -> str:
        return self.machine.end()


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_decode(docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids, decoded): the ids of each whole text and what they decode to.

    ids: little-endian unsigned 32-bit integers. Null counts as empty: no ids, empty text.
    Repeated rows and null keys are kept as they are; an empty table gives none. Each row
    is worked on where it was read: no shuffle. Beside a row's own values a worker holds one
    portion of its text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("bpe", codec.cache_clear)
        c = codec(path)
        for batch in batches:
            keys, held, size = [], ([], [], []), 0
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                decoder, made, parts = StreamDecoder(c), [], []
                for portion in c.portions(t.as_py()):
                    made.append(portion)
                    parts.append(decoder.feed(np.frombuffer(portion, "<u4").tolist()))
                ids, decoded = b"".join(made), "".join(parts) + decoder.end()
                keys.append(k)
                for column, value in zip(held, (len(ids) // 4, ids, decoded)):
                    column.append(value)
                size += len(ids) + len(decoded)
                if size > BATCH_BYTES:
                    yield out(batch, keys, held)
                    keys, held, size = [], ([], [], []), 0
            if keys:
                yield out(batch, keys, held)
        c.forget()

    def out(batch, keys, held):
        return pa.RecordBatch.from_arrays([pa.array(keys, batch.column(0).type), pa.array(held[0], pa.int64()), pa.array(held[1], pa.binary()), pa.array(held[2], pa.string())], [key, "n_tokens", "ids", "decoded"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_tokens long, ids binary, decoded string")
