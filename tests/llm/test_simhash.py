import pandas as pd
import pytest

from kindred.llm import simhash
from kindred.llm.components import connected_components
from kindred.llm.queries import op5_simhash
from kindred.llm.storage import Scratch

from . import brute


def test_masks_reach_every_near_anchor():
    columns = range(1, 32)
    for s, masks in enumerate(simhash._masks()):
        for m in masks:
            found = 0
            for i in columns:
                found ^= i * (m >> (i - 1) & 1)
            assert found == s and m.bit_count() <= 2
        assert len(masks) == (16 if s else 1) and masks[0].bit_count() <= 1


def test_fingerprints():
    for text in (None, "", "one", "one two", "One\ttwo\x0bTHREE four five ÉÀ", "a b c " * 300):
        assert simhash.fingerprint(text) == brute.simhash(text)


@pytest.mark.parametrize("block", [2, 2048])
def test_links_of_planted_fingerprints(spark, block):
    base = [0x0123456789ABCDEF, 0, 0xFFFFFFFFFFFFFFFF, 0x00000000FFFFFFFF]
    fps = set(base)
    for b in base:
        for i, j in ((0, 1), (31, 63), (30, 31), (62, 63), (5, 40), (32, 33), (7, 7)):
            fps.add(b ^ (1 << i | 1 << j))
            fps.add(b ^ (1 << i | 1 << j | 1 << 20 | 1 << 50))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2]
    label = brute.components(len(fps), pairs)
    expected = {frozenset(signed[i] for i in range(len(fps)) if label[i] == c) for c in set(label)}
    scratch = Scratch(spark)
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = connected_components(simhash.links(df, block=block, scratch=scratch), scratch).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.component, set()).add(r.node)
    alone = set(signed) - {r.node for r in found}
    assert {frozenset(g) for g in groups.values()} | {frozenset([x]) for x in alone} == expected


def test_query(spark, sf):
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    expected = brute.simhash_groups(dict(zip(docs["doc_id"], docs["text"])))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in op5_simhash(spark, sf).collect()}
    assert got == expected


def test_odd_rows(spark):
    rows = [(3, None, 1), (1, "", 2), (2, "the quick brown fox", 3), (4, "the quick brown fox", 4), (None, "the quick brown fox", 5), (4, "the quick brown fox", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df, Scratch(spark)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 2), (1, 1), (2, 2), (3, 1), (4, 2), (4, 2)]
    assert simhash.near_duplicates(df.limit(0), Scratch(spark)).count() == 0
    assert sorted(r.doc_id or 0 for r in simhash.first_of_each(df, Scratch(spark)).collect()) == [0, 1, 2]
