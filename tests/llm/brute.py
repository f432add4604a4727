"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import xxhash


def components(n: int, pairs) -> list[int]:
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(text: str | None) -> int:
    data = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_groups(docs: dict) -> dict:
    """doc_id -> (fingerprint, component_id)."""
    ids = sorted(docs)
    fps = [simhash(docs[i]) for i in ids]
    pairs = [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    return {i: (fps[n], ids[c]) for n, (i, c) in enumerate(zip(ids, components(len(ids), pairs)))}


def shingles(text: str, k: int = 5) -> set:
    w = text.lower().split()
    return {tuple(w)} if len(w) < k else set(zip(*(w[i:] for i in range(k))))


def first_of_near_copies(docs: dict) -> set:
    """Ids that no smaller one reaches by links of a Jaccard similarity of 0.8 of 5-word shingles."""
    ids, sets = sorted(docs), {i: shingles(t) for i, t in docs.items()}
    pairs = [(a, b) for a, i in enumerate(ids) for b, j in enumerate(ids[:a]) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    label = components(len(ids), pairs)
    return {ids[n] for n, c in enumerate(label) if c == n}


def letter_grams(text: str | None) -> Counter:
    """n-grams of one to three characters of lower-cased words of letters, a blank on either side."""
    found = Counter()
    for word in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split():
        padded = f" {word} "
        found.update(g for n in (1, 2, 3) for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) != " ")
    return found


def rank_order(counts: Counter, size: int = 300) -> list[str]:
    """The most frequent n-grams, ties by length, then by code points."""
    return sorted(counts, key=lambda g: (-counts[g], len(g), [ord(c) for c in g]))[:size]


def language_profiles(labelled: list[tuple[str, str]]) -> dict[str, dict[str, int]]:
    counts: dict[str, Counter] = {}
    for text, lang in labelled:
        counts.setdefault(lang, Counter()).update(letter_grams(text))
    return {lang: {g: n for n, g in enumerate(rank_order(c))} for lang, c in sorted(counts.items())}


def language(text: str | None, profiles: dict, size: int = 300) -> tuple[str, float]:
    own = rank_order(letter_grams(text), size)
    if not own or not profiles:
        return "und", 0.0
    away = {lang: sum(abs(ranks[g] - n) if g in ranks else size for n, g in enumerate(own)) for lang, ranks in profiles.items()}
    best = min(away, key=lambda lang: (away[lang], lang))
    return best, 1 - away[best] / (size * len(own))


def least_language_score(labelled: list[tuple[str, str]], profiles: dict) -> float:
    scores = sorted(s for name, s in (language(t, profiles) for t, _ in labelled) if name != "und")
    n = len(labelled)
    return 0.6 * scores[max(1, math.ceil(len(scores) / 100)) - 1] * n / (n + 20)


def cut_repeats(docs: dict, length: int = 50) -> dict:
    """doc_id -> (bytes, spans, kept)."""
    seen, out = set(), {}
    for i in sorted(docs):
        data = (docs[i] or "").encode()
        grams = [data[a : a + length] for a in range(len(data) - length + 1)]
        cover = np.zeros(len(data), bool)
        for a, g in enumerate(grams):
            if g in seen:
                cover[a : a + length] = True
        seen.update(grams)
        turns = np.flatnonzero(np.diff(np.concatenate([[0], cover.view(np.int8), [0]]))).reshape(-1, 2)
        out[i] = (data, [tuple(t) for t in turns.tolist()], bytes(np.frombuffer(data, np.uint8)[~cover]))
    return out


def check_packing(pieces, ids_of: dict, capacity: int = 2048) -> int:
    """Asserts the contract of packed pieces (a pandas frame); returns the tokens of padding."""
    padding = 0
    for _, g in pieces.sort_values("offset").groupby("sequence_id"):
        ends = g["length"].cumsum().tolist()
        assert g["offset"].tolist() == [0, *ends[:-1]] and ends[-1] <= capacity
        padding += capacity - ends[-1] if ends[-1] & (ends[-1] - 1) else 0
    assert set(pieces["doc_id"]) == set(ids_of)
    for i, g in pieces.sort_values("start").groupby("doc_id"):
        ids = ids_of[i]
        ends = g["length"].cumsum().tolist()
        assert g["start"].tolist() == [0, *ends[:-1]] and ends[-1] == len(ids) and set(g["doc_tokens"]) == {len(ids)}
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    return padding


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
