import random

import pytest

import corpus_pipeline
from kindred.llm import nearcopies
from kindred.llm.storage import Scratch

from . import brute


def planted() -> dict:
    """Texts with copies of one to eight changed words, chains of copies, and strangers."""
    rng, docs = random.Random(7), {}
    for base in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((4, 12, 60, 200, 3000)))]
        for copy in range(4):
            docs[len(docs)] = " ".join(words)
            words = list(words)
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return docs


def test_stage_drops_planted_near_copies(spark, sf):
    docs = planted()
    expected = brute.first_of_near_copies(docs)
    assert len(expected) < len(docs) - 40
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, df, sf).collect()} == expected


def test_stage_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    df = spark.read.parquet(f"{sf}/documents.parquet").where("text rlike '[a-z]'")
    docs = {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}
    assert {r.doc_id for r in corpus_pipeline.near_copies(spark, df, sf).collect()} == brute.first_of_near_copies(docs)


@pytest.mark.parametrize("share", [2, 512])
def test_shares(spark, share):
    docs = {i: " ".join([*(f"w{n}" for n in range(100)), f"x{i}"]) for i in range(12)}
    df, scratch = spark.createDataFrame(list(docs.items()), "doc_id long, text string"), Scratch(spark)
    made = nearcopies.sketches(df).selectExpr("fp", "sim", "doc_id as first", "bands")
    edges = nearcopies.links(df, made, words=5, least=nearcopies.LEAST, key="doc_id", text="text", scratch=scratch, share=share).collect()
    number = {r.fp: n for n, r in enumerate(made.collect())}
    assert set(brute.components(12, [(number[e.src], number[e.dst]) for e in edges])) == {0}


def test_odd_rows(spark):
    long = " ".join(f"w{n}" for n in range(100))
    rows = [(3, None, 1), (1, "", 2), (2, long, 3), (4, long.upper() + " x", 4), (None, long + " y", 5), (4, long, 4), (5, "w1 w2 w3", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = nearcopies.near_copies(df, Scratch(spark)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 2), (1, 1), (2, 2), (3, 1), (4, 2), (4, 2), (5, 5)]
    assert sorted(r.doc_id or 0 for r in nearcopies.first_of_each(df, Scratch(spark)).collect()) == [0, 1, 2, 5]
    assert nearcopies.first_of_each(df.limit(0), Scratch(spark)).count() == 0
    with pytest.raises(ValueError):
        nearcopies.near_copies(df, Scratch(spark), least=nearcopies.LEAST / 2)


def test_fingerprints_alone_bring_candidates(spark, monkeypatch):
    """Without a common band, sets still meet at the anchors, and are still counted."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(10**6)}" for _ in range(4000)]
    docs = {1: " ".join(words), 2: " ".join([*words[:-1], "other"]), 3: "wholly " * 3 + "different text of some words"}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    made = nearcopies.sketches(df).selectExpr("fp", "sim", "doc_id as first", "transform(bands, b -> xxhash64(b, fp)) as bands")
    fps = {r.first: r for r in made.collect()}
    assert (fps[1].sim ^ fps[2].sim).bit_count() <= 2
    assert not set(fps[1].bands) & set(fps[2].bands)
    edges = nearcopies.links(df, made, words=5, least=nearcopies.LEAST, key="doc_id", text="text", scratch=Scratch(spark)).collect()
    assert [{e.src, e.dst} for e in edges] == [{fps[1].fp, fps[2].fp}]
