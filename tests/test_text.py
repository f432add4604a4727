"""Golden values of the normaliser, and agreement of its two paths."""

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import text as T

GOLDEN = [
    ("McDonald's India Pvt. Ltd.", "mcdonalds india pvt ltd"),
    ("Café & Co.", "cafe and co"),
    ("N.A.", "n a"),
    ("n/a", "n a"),
    ("Na!", "na"),
    ("***", ""),
    ("NA Foods", "na foods"),
    ("O’Brien_Sons", "obrien sons"),
    ("Straße ™ №5", "strasse TM No5"),
    ("İstanbul", "istanbul"),
    ("पिज़्ज़ा हट", unicodedata.normalize("NFC", "पिज़्ज़ा हट")),
    ("Ａ＆Ｂ", "a b"),
    ("① ² Main", "1 2 main"),
    ("A­B", "a b"),
    ("x́̂y", "xy"),
    ("ﬁne ς", "fine σ"),
    ("the and of", "the and of"),
    ("Private Ltd", "private ltd"),
    (None, ""),
    ("", ""),
    (" \t ", ""),
]


def test_canonical():
    for raw, want in GOLDEN:
        assert T.canonical(raw) == want


def test_column_agrees(spark):
    rows = [(i, raw, want) for i, (raw, want) in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "i int, raw string, want string")
    assert df.where(T.normalize_text(F.col("raw")) != F.col("want")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_canonical_is_stable(text):
    once = T.canonical(text)
    assert once == " ".join(once.split())
    assert all(unicodedata.category(c)[0] in "LNM" or c == " " for c in once)


def test_native_path_equals_python(spark):
    import random

    rng = random.Random(3)
    rows = [("".join(rng.choices("aBz09 &'_-./\t\x00", k=rng.randrange(20))),) for _ in range(300)]
    got = spark.createDataFrame(rows, "raw string").select("raw", T.normalize_text(F.col("raw")).alias("n")).collect()
    assert all(r.n == T.canonical(r.raw) for r in got)


def test_records(spark):
    rows = [
        ("S1", "S1-1", 1, "Blue Sky Restaurant", "12 MG Road, Bengaluru", "India"),
        ("S1", "S1-2", 2, "Café & Co.", "N.A.", "France"),
        ("S1", "S1-3", 3, "Private Ltd", None, ""),
        ("S1", "S1-4", 4, "null", "፩ ab", "NA"),
        ("S1", "S1-5", 5, None, "Flat 0012 of १२ ab1", None),
    ]
    df = spark.createDataFrame(rows, "source string, entity_id string, ord long, business_name string, business_address string, country string")
    got = {r.entity_id: r for r in T.normalize_records(df).collect()}
    assert got["S1-1"].name_core == ["blue", "sky", "restaurant"] and got["S1-1"].house_number == "12" and got["S1-1"].address_alpha_tokens == ["road", "bengaluru"]
    assert got["S1-2"].name_core == ["cafe"] and got["S1-2"].address == "" and got["S1-2"].address_is_missing
    assert got["S1-3"].name == "private ltd" and got["S1-3"].name_core == [] and not got["S1-3"].name_is_missing and got["S1-3"].country == ""
    assert got["S1-4"].name == "" and got["S1-4"].name_is_missing and got["S1-4"].country == "na" and got["S1-4"].house_number == "፩"
    assert got["S1-5"].house_number == "0012" and got["S1-5"].country == ""


@pytest.mark.parametrize("name,want", [("", "empty"), ("abc 1", "latin"), ("हट", "devanagari"), ("தமிழ்", "tamil"), ("ñandú x", "latin+marks"), ("漢字", "cjk"), ("カナ", "cjk"), ("عربي", "arabic"), ("мир", "cyrillic"), ("λόγος", "greek"), ("ไทย", "other-script"), ("é हट", "devanagari")])
def test_script(spark, name, want):
    assert spark.createDataFrame([(name,)], "n string").select(T.script_class(F.col("n"))).first()[0] == want


def test_ids(spark):
    df = spark.createDataFrame([("S2-681",), ("x",), ("-1",), ("a-b-c",)], "i string")
    assert [r[0] for r in df.select(T.source_of(F.col("i"))).collect()] == ["S2", "", "", "a"]
    df = spark.createDataFrame([("   x y　\t",)], "i string")
    assert df.select(T.strip(F.col("i"))).first()[0] == "x y"
