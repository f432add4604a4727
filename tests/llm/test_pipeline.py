"""The pipeline's stages and run() against plain Python on a small table."""

import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from kindred.llm.queries import word_bpe

from . import brute


#: Rows that the language stage must reject, and one of a known language without a label.
PLANTED = [
    (900_001, "Все люди рождаются свободными и равными в своем достоинстве и правах", None, "x", 68),
    (900_002, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan", None, "x", 76),
    (900_003, "xkqzj wvbqx zzxkq " * 30, "en", "x", 540),
    (900_004, "½ ² ① Ⅷ 12 !?", "de", "x", 13),
    (900_005, None, None, "x", 0),
]


def plain_language(docs: pd.DataFrame) -> dict:
    """doc_id -> language of the documents that stay."""
    labelled = [(t, lang) for t, lang in zip(docs["text"], docs["lang"]) if t is not None and lang is not None]
    profiles = brute.language_profiles(labelled)
    least = brute.least_language_score(labelled, profiles)
    found = {i: brute.language(t, profiles) for i, t in zip(docs["doc_id"], docs["text"])}
    return {i: name for i, (name, score) in found.items() if name != "und" and score >= least}


def plain_run(docs: pd.DataFrame) -> dict:
    known = plain_language(docs)
    texts = {i: t for i, t in zip(docs["doc_id"], docs["text"]) if i in known}
    first = brute.first_of_near_copies(texts)
    cut = brute.cut_repeats({i: t for i, t in texts.items() if i in first})
    return {i: kept.decode("utf-8", "ignore") for i, (data, _, kept) in cut.items() if kept or not data}


@pytest.fixture(scope="module")
def expected(sf):
    return plain_run(pd.read_parquet(f"{sf}/documents.parquet"))


def test_stages_return_documents(spark, sf, expected):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
    got = docs.toPandas()
    assert dict(zip(got["doc_id"], got["text"])) == expected
    assert (got["n_chars"] == got["text"].str.len()).all()


def test_run(spark, sf, expected):
    library = Tokenizer.from_file(word_bpe())
    ids = {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in expected.items()}
    assert brute.check_packing(corpus_pipeline.run(spark, sf).toPandas(), ids) == 0


def test_language_stage_rejects_what_fits_no_profile(spark, sf):
    labelled = spark.read.parquet(f"{sf}/documents.parquet")
    rows = PLANTED + [(900_006, labelled.where("lang = 'fr'").orderBy("doc_id").first()["text"], None, "x", 1)]
    docs = labelled.unionByName(spark.createDataFrame(rows, labelled.schema))
    frame = docs.toPandas().astype(object).where(lambda f: f.notna(), None)
    expected = plain_language(frame)
    got = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs, sf).collect()}
    assert got == expected
    assert not set(got) & {r[0] for r in PLANTED} and got[900_006] == "fr"
    assert set(got) >= {r.doc_id for r in labelled.select("doc_id").collect()}  # clean documents stay


def test_run_leaves_session_and_tables(spark, sf):
    import os

    from kindred.llm.storage import shared_root

    root, name = shared_root(spark), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, session = set(os.listdir(root)), spark.conf.get(name)
    assert corpus_pipeline.run(spark, sf).count() > 0
    assert spark.conf.get(name) == session
    (new,) = set(os.listdir(root)) - before
    assert [n for n in os.listdir(f"{root}/{new}") if not n.startswith(".")] == ["0004-packing"]


def test_odd_rows(spark, sf):
    rows = [(1, "the cat and the dog " * 5, "en", 3), (2, None, None, None), (None, "un chat et un chien", "fr", 1), (3, "", "en", 0), (4, "12 !?", None, 9), (5, "the cat and the dog " * 5, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "score"]
    assert {r.doc_id for r in docs.collect()} == {1, None}
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
