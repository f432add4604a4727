"""Ratios of many pairs at once against difflib, and pairs that come with their records."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from kindred.functions.similarity import LONG, matched_ratios
from kindred.operators import blocking, features
from kindred.plans import catalog


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "aé \U0001f600ब्", "".join(map(chr, range(97, 497)))])
def test_ratios_by_difflib(letters):
    draw = random.Random(len(letters))
    word = lambda most: "".join(draw.choices(letters, k=draw.randint(0, most)))
    pairs = [(word(most), word(most)) for most in (3, 10, 63, 70, LONG + 20) for _ in range(150)]
    pairs += [(x + a, x + b + a[:5]) for a, b in pairs[:200] for x in ["or nd of ouble"]]
    expected = [SequenceMatcher(None, a, b, autojunk=False).ratio() for a, b in pairs]
    assert list(matched_ratios([a for a, _ in pairs], [b for _, b in pairs])) == expected
    assert list(matched_ratios([], [])) == []


@pytest.mark.parametrize("config", [catalog.CAP, catalog.K.DEFAULT])
def test_candidates_come_with_their_records(spark, sf, config, monkeypatch):
    monkeypatch.setattr(features, "MEET", 3)
    r = catalog._records(spark, sf).cache()
    pairs = blocking.two_arms(r, config)
    by_pairs = features.featurize(pairs, r)
    together = features.vectors(features.candidates_with_records(r, config, arms=True), pairs.columns)
    assert together.columns == by_pairs.columns and together.count() == by_pairs.count() > 0
    assert together.exceptAll(by_pairs).count() == 0


def test_pairs_are_not_shuffled(spark, tmp_path):
    """Pairs are made once each; no aggregate by pair makes them distinct afterwards."""
    rows = [(i, f"Alpha Beta Gamma Limited of the northern harbour 1 Long Street {i % 9}", "en", "web", 70) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("pair_features_full", "linkage_features"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert "Join" in plan and "keys=[ref_source" not in plan
        assert df.where(F.col("ref_id").isNotNull()).count() == 20 * 40
