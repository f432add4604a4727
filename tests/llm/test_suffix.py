import random

import numpy as np
import pandas as pd
import pytest

from kindred.llm import suffix
from kindred.llm.queries import op9_suffix_dedup
from kindred.llm.storage import Scratch

from . import brute


def check(df, docs, scratch, **options):
    expected = brute.cut_repeats(docs)
    got = suffix.repeated_spans(df, scratch, **options).collect()
    assert len(got) == len(docs)
    for r in got:
        data, spans, kept = expected[r.doc_id]
        assert r.n_bytes == len(data)
        assert [(s.begin, s.end) for s in r.spans] == spans
        assert bytes(r.kept) == kept


@pytest.mark.parametrize("letters,chunk", [("ab", 400), ("abcdefghij é", 900), ("a", 300), ("xyz", 10**6)])
def test_random_texts(spark, letters, chunk):
    rng = random.Random(letters)
    passages = ["".join(rng.choices(letters, k=rng.choice([49, 50, 51, 80, 200]))) for _ in range(4)]
    docs = {}
    for i in rng.sample(range(1000), 40):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choices(letters, k=rng.choice([0, 5, 60]))) for _ in range(rng.randrange(5))]
        docs[i] = "".join(parts)
    docs[2000] = None
    docs[2001] = docs[min(docs)]
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    check(df, docs, Scratch(spark), chunk_bytes=chunk)


def test_blocks_of_a_long_text(spark):
    rng = random.Random(9)
    long = "".join(rng.choices("abcdef ", k=3 * suffix._BLOCK + 17))
    docs = {1: long, 2: "x" * 70 + long[suffix._BLOCK - 60 : suffix._BLOCK + 60] + "y", 3: long + "!", 4: long[100:]}
    check(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), docs, Scratch(spark), chunk_bytes=20_000)


def test_odd_rows(spark):
    text = "the same passage of more than fifty bytes in every row of this table"
    rows = [(5, text, "a"), (5, text, "b"), (None, text, "c"), (7, text, "d"), (1, None, None), (2, "short", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string")
    got = suffix.repeated_spans(df, Scratch(spark), carry=["chunk"]).collect()
    assert {(r.rest.chunk, sum(s.end - s.begin for s in r.spans)) for r in got} == {("a", 0), ("b", 0), ("c", 0), ("d", len(text)), (None, 0), ("e", 0)}
    assert suffix.repeated_spans(df.limit(0), Scratch(spark)).count() == 0
    kept = suffix.without_repeats(df, Scratch(spark))
    assert kept.columns == df.columns and kept.count() == 5


def test_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    expected = brute.cut_repeats(dict(zip(docs["doc_id"], docs["text"])))
    for r in op9_suffix_dedup(spark, sf).collect():
        data, spans, kept = expected[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), len(data) - len(kept), len(spans), brute.sha(kept))


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_pointers_are_equal_for_equal_strings_only(letters):
    rng = random.Random(letters)
    for n in (50, 51, 200, 3000):
        text = "".join(rng.choices(letters, k=n)).encode()
        if n > 200:
            text = text[:900] + text[:900] + text[300:]
        pointer = suffix.refine(np.frombuffer(text, np.uint8))
        strings = [text[i : i + 50] for i in range(len(text) - 49)]
        by = {}
        for s, p in zip(strings, pointer.tolist()):
            assert by.setdefault(s, p) == p
        assert len(set(by.values())) == len(by)
        assert [s for s, _ in sorted(by.items())] == [s for s, _ in sorted(by.items(), key=lambda x: x[1])]


def test_equal_sums_of_other_texts_stay_apart(monkeypatch):
    monkeypatch.setattr(suffix, "_PLACE", np.zeros(100, np.uint64))  # every sum is the same
    data = np.frombuffer(b"abcabdabcxyabcab", np.uint8)
    first, size = np.array([0, 3, 6, 9, 11, 14]), np.array([3, 3, 3, 2, 3, 2])
    number, one = suffix.distinct(data, first, size)
    text = [bytes(data[a : a + n]) for a, n in zip(first, size)]
    assert [text[one[n]] for n in number] == text and len(one) == len(set(text)) == 4


@pytest.mark.parametrize("size", [100, 1000, 30_000])
def test_chunks_are_cut_by_bytes(spark, size):
    rng = random.Random(size)
    rows = [(i // 2 if i < 60 else i * i, "x" * rng.choice([0, 3, 400, 2500])) for i in range(300)] + [(None, "y" * 900)] * 9
    texts = spark.createDataFrame(rows, "key long, text string").selectExpr("key", "cast(text as binary) text")
    placed, _ = suffix.chunked(texts, Scratch(spark), size)
    got = placed.selectExpr("chunk", "key", "octet_length(text) n").toPandas()
    assert len(got) == len(rows) and (got[got["key"].isna()]["chunk"] < 0).all()
    got = got[got["key"].notna()]
    assert got.groupby("key")["chunk"].nunique().max() == 1
    bounds = got.groupby("chunk").agg(low=("key", "min"), high=("key", "max"), n=("n", "sum"), most=("n", "max")).sort_index()
    assert (bounds["low"].to_numpy()[1:] > bounds["high"].to_numpy()[:-1]).all()
    assert (bounds["n"] <= size + 2 * bounds["most"]).all()
