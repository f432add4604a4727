"""Language ID, packing and token counts."""

import random
import zlib

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from kindred.llm import bpe, langid, packing, wordpiece
from kindred.llm.queries import op6_token_counts, op7_language_id, op10_packing, word_bpe

from . import brute


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = pd.read_parquet(f"{sf}/documents.parquet").set_index("doc_id")
    got = op7_language_id(spark, sf).toPandas()
    assert len(got) == len(docs) and got["score"].between(0, 1).all()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got["doc_id"]]).all()
    held = got[got["held_out"]]
    assert len(held) > 100 and (held["lang_pred"].to_numpy() == docs.loc[held["doc_id"], "lang"].to_numpy()).mean() >= 0.98


def test_language_query_by_brute_force(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in docs["doc_id"]}
    profiles = brute.language_profiles([(t, lang) for i, t, lang in zip(docs["doc_id"], docs["text"], docs["lang"]) if not held[i]])
    got = {r.doc_id: r for r in op7_language_id(spark, sf).collect()}
    assert set(got) == set(docs["doc_id"])
    for i, t in zip(docs["doc_id"], docs["text"]):
        name, score = brute.language(t, profiles)
        assert (got[i].held_out, got[i].lang_pred) == (held[i], name) and abs(got[i].score - score) < 1e-12


def test_only_letters_make_words(spark):
    rows = [(1, "½ ² ① Ⅷ"), (2, "٣ 7 _ !"), (3, "x²y"), (4, "ʰ"), (5, "日本"), (6, "ab " * 400_000)]
    asked = spark.createDataFrame(rows, "doc_id long, text string")
    profiles = langid.learn(spark.createDataFrame([("ab xy", "a"), ("cd", "b")], "text string, lang string"))
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(asked, profiles).collect()}
    assert got[1] == got[2] == ("und", 0.0) and got[3][0] == "a" and got[4][0] != "und" and got[5] == ("a", 0.0) and got[6][0] == "a"
    assert langid.words_of("A x²y ½b") == ["a", "x", "y", "b"]


def test_words_of_all_languages_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(f"wort{i} mot{i % 7}", f"l{i % 5}") for i in range(200)], "text string, lang string").coalesce(1)
    whole = langid.learn(docs)
    monkeypatch.setattr(langid, "MOST_WORDS", 10)
    parts = langid.learn(docs)
    assert parts.languages == whole.languages and (parts.grams == whole.grams).all() and (parts.ranks == whole.ranks).all()
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 4)
    monkeypatch.setattr(langid, "PROFILE", 3)
    with pytest.raises(ValueError):
        langid.learn(docs, size=3)


def test_keep_known(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en"), (2, "der hund und die katze", "de"), (3, "the cat", None), (4, "zzz qqq", None), (5, "12", "en")], "doc_id long, text string, lang string")
    profiles = langid.learn(docs.where("doc_id < 3"))
    kept = lambda **options: {r.doc_id: r.lang for r in langid.keep_known(docs, profiles, **options).collect()}
    assert kept(least=0.3) == {1: "en", 2: "de", 3: "en"}
    assert kept(least=0.3, languages=["de"]) == {2: "de"}
    assert set(kept()) == {1, 2, 3, 4}
    nothing = langid.learn(docs.limit(0))
    assert langid.least_score(docs, nothing) == 0 and {r.doc_id: r.lang for r in langid.keep_known(docs, nothing).collect()} == {1: "en", 2: "de", 3: None, 4: None}


def test_prediction_knows_only_text(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat", "en", "x"), (2, "der hund und die katze", "de", "y"), (3, None, "de", "z"), (5, "und und und", None, "w")], "doc_id long, text string, lang string, score string")
    profiles = langid.learn(docs)
    assert profiles.languages == ["de", "en"]
    rows = [(7, "the cat", "de"), (8, None, "de"), (9, "123 !?", "en"), (None, "die katze", None), (7, "the cat", "de")]
    asked = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in langid.identify(asked, profiles).collect())
    assert got == [(0, "de"), (7, "en"), (7, "en"), (8, "und"), (9, "und")]
    nothing = langid.learn(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(asked, nothing).collect()} == {"und"}
    assert langid.identify(asked.limit(0), profiles).count() == 0


def test_counts_by_hand():
    words = ["ab", "é", "ab", "b", "日本語x"]
    expected = langid.Counter()
    for w in words:
        padded = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                gram = padded[i : i + n]
                if gram != " ":
                    code = 0
                    for c in gram:
                        code = code << 21 | ord(c)
                    expected[code] += 1
    for grams, counts in (langid.text_counts(words), langid.gram_counts(langid.Counter(words))):
        assert dict(zip(grams.tolist(), counts.tolist())) == expected and (grams[1:] > grams[:-1]).all()


def test_ranks_and_distance():
    grams, counts = langid.text_counts(["ab", "ab", "b"])
    code = lambda g: sum(ord(c) << 21 * n for n, c in enumerate(reversed(g)))
    top = langid.ranked(grams, counts, 3).tolist()
    assert top == [code("b"), code("b "), code("a")]  # 3 of each of the first, then 2, the shorter first
    p = langid.Profiles(["x"], np.sort(np.array(top)), np.array([[2, 0, 1]]), 3)
    assert p.predict(["ab", "ab", "b"]) == ("x", 1.0)
    swapped = langid.Profiles(["x"], np.sort(np.array(top)), np.array([[0, 2, 1]]), 3)
    assert swapped.predict(["ab", "ab", "b"]) == ("x", 1 - 4 / 9)


@pytest.mark.parametrize("capacity", [1, 2, 7, 64, 2048])
def test_harmonic_bins(capacity):
    rng = random.Random(capacity)
    lengths = [rng.choice([1, 1, 2, 3, capacity, capacity + 1, rng.randint(1, 3 * capacity)]) for _ in range(400)]
    packer, made = packing.Packer(capacity), []
    for i, n in enumerate(lengths):
        held = [p for k in packer.open.values() for p in k] + packer.filling * bool(packer.gap)
        assert all(len(b) < k and all(capacity // p[2] == k for p in b) for k, b in packer.open.items())
        assert sum(p[2] for p in held) <= capacity * (len(packer.open) + 1)
        made += packer.add(i, bytes(range(4)) * n)
    early = len(made)
    made += packer.finish()
    assert all(sum(p[2] for p in s) == capacity for s in made[:early])
    sizes = [sum(p[2] for p in s) for s in made]
    short = [n for n in sizes if n < capacity]
    assert len(set(short)) == len(short) and all(n & (n - 1) == 0 for n in short) and sum(sizes) == sum(lengths)
    at = dict.fromkeys(range(len(lengths)), 0)
    for key, start, length, ids, total in sorted(p for s in made for p in s):
        assert start == at[key] and total == lengths[key] and len(ids) == 4 * length
        at[key] += length
    assert list(at.values()) == lengths


def test_whole_documents_are_cut_only_to_fill():
    packer = packing.Packer(100)
    assert list(packer.add("a", bytes(4 * 40))) == [] and list(packer.add("b", bytes(4 * 40))) == []  # class 2, 20 left
    (bin_,) = packer.add("c", bytes(4 * 60))
    assert [(p[0], p[1], p[2]) for p in bin_] == [("a", 0, 40), ("b", 0, 40), ("c", 0, 20)]
    assert [(p[0], p[1], p[2]) for p in packer.open[2]] == [("c", 20, 40)]


def test_packing_query(spark, sf):
    library = Tokenizer.from_file(word_bpe())
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    ids = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in zip(docs["doc_id"], docs["text"])}
    packed = op10_packing(spark, sf)
    assert brute.check_packing(packed.toPandas(), ids) == 0
    told = packing.report(packed).first()
    assert (told.documents, told.tokens, told.padding) == (len(ids), sum(map(len, ids.values())), 0)
    assert told.pieces <= told.documents + 2 * told.sequences


def test_packing_odd_rows(spark):
    rows = [(1, None, 0), (2, "", 1), (3, "a " * 5000, 2), (4, "b", 3), (4, "b", 3), (None, "c", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    for capacity in (64, 1000):
        got = packing.pack(df, word_bpe(), keep_ids=True, capacity=capacity).toPandas()
        codec = bpe.codec(word_bpe())
        once = got[got["doc_id"].isin([1, 2, 3])]
        ids = {i: [*np.frombuffer(codec.encode(t), "<u4").tolist(), 1] for i, t, _ in rows[:3]}
        for i, g in once.sort_values("start").groupby("doc_id"):
            assert np.frombuffer(b"".join(g["ids"]), "<u4").tolist() == ids[i]
        assert (got["doc_id"] == 4).sum() >= 2 and got["doc_id"].isna().sum() >= 1
        assert got["length"].sum() == sum(map(len, ids.values())) + 6
        assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got.itertuples())
        sizes = got.groupby("sequence_id")["length"].sum()
        assert all(n == capacity or n & (n - 1) == 0 for n in sizes)
    assert packing.pack(df.limit(0), word_bpe()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, word_bpe(), capacity=0)


def greedy(word: bytes, pieces: set) -> int | None:
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if (word[at:e], e == len(word)) in pieces or (e < len(word) and (word[at:e], False) in pieces)), None)
        if end is None:
            return None
        at, n = end, n + 1
    return n


def test_automaton_against_greedy():
    import itertools
    import random

    rng = random.Random(6)
    for _ in range(60):
        pieces = {(bytes(rng.choices(b"abc", k=rng.choice([1, 1, 2, 3, 4]))), rng.random() < 0.5) for _ in range(rng.randrange(1, 14))}
        automaton = wordpiece.LongestMatch(pieces)
        for n in range(1, 7):
            for word in map(bytes, itertools.product(b"abc", repeat=n)):
                assert automaton.count(word) == greedy(word, pieces)


def test_token_counts(spark, sf):
    codec = bpe.codec(word_bpe())
    symbols = {b: c for c, b in bpe.byte_of_symbol().items()}
    names = set(codec.names)

    def pieces(word):
        s = [symbols[b] for b in word]
        s[-1] += "</w>"
        at = n = 0
        while at < len(s):
            at = next(e for e in range(len(s), at, -1) if "".join(s[at:e]) in names)
            n += 1
        return n

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()}
    got = {r.doc_id: r.n_tokens for r in op6_token_counts(spark, sf).collect()}
    for i, t in docs.items():
        assert got[i] == sum(1 if isinstance(w, int) else pieces(w) for c in t.split() for w in codec.split_words(c))
    odd = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert [r.n_tokens for r in wordpiece.token_counts(odd, word_bpe()).collect()] == [0, 0]


def test_least_score_is_fitted_on_every_labelled_row(spark):
    """60,000 rows of one text whose hash lies above the part that a sample of 50,000 would take."""
    texts = spark.createDataFrame([(f"the cat sat on mat {'x' * i}",) for i in range(40)], "text string")
    text = texts.where("pmod(xxhash64(text), 1 << 30) >= (1 << 30) / 6 * 5").orderBy("text").first().text
    docs = spark.range(60_000).selectExpr(f"'{text}' AS text", "'en' AS lang")
    profiles = langid.learn(docs)
    assert langid.least_score(docs, profiles) == pytest.approx(langid.PART * 60_000 / (60_000 + langid.TRUST))
