"""Names, addresses and countries in a canonical form that keeps every script.

ASCII rows stay in the JVM. Only rows with other characters reach the Arrow function: it is
fed null for ASCII rows and hands nulls back, since Spark evaluates a Python function for
every row, whatever condition stands around it.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What stands for "no value", what carries no meaning in a name, what is deleted.
PLACEHOLDERS = ("", "-", "--", "?", "n/a", "na", "nan", "null")
LEGAL_TOKENS = (
    "inc", "llc", "ltd", "co", "corp", "company", "plc", "gmbh", "sa", "sas", "pvt",
    "private", "limited", "llp", "lp", "the", "and", "of", "center", "services", "group", "enterprises",
)
APOSTROPHES = "'’ʼ＇"
MIN_ALPHA_LENGTH = 3
#: Canonical forms of the placeholders.
MISSING_FORMS = ("", "n a", "na", "nan", "null")


def canonical(value: str | None) -> str:
    """Case-folded text without Latin accents, with one blank between runs of letters, digits and marks."""
    if not value:
        return ""
    folded = value.casefold().replace("&", " and ").translate(dict.fromkeys(map(ord, APOSTROPHES)))
    kept, latin = [], False
    for c in unicodedata.normalize("NFKD", folded):
        mark = unicodedata.category(c) == "Mn"
        if mark and latin:
            continue
        if not mark:
            latin = c.isascii() and c.isalpha()
        kept.append(c)
    text = unicodedata.normalize("NFC", "".join(kept))
    return " ".join("".join(c if unicodedata.category(c)[0] in "LNM" else " " for c in text).split())


def first_number(address: str | None) -> str | None:
    """First token made of digits in any script."""
    return next((t for t in (address or "").split() if t.isdigit()), None)


@F.pandas_udf(StringType())
def _canonical_udf(values: pd.Series) -> pd.Series:
    return values.map(lambda v: None if v is None else canonical(v))


@F.pandas_udf(StringType())
def _first_number_udf(values: pd.Series) -> pd.Series:
    return values.map(first_number)


def is_ascii(c: Column) -> Column:
    return c.rlike(r"\A[\x00-\x7F]*\z")


def normalize_text(c: Column) -> Column:
    """canonical() as a column; null gives ''."""
    c = F.coalesce(c, F.lit(""))
    plain = F.replace(F.replace(F.lower(c), F.lit("&"), F.lit(" and ")), F.lit("'"), F.lit(""))
    native = F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))
    return F.coalesce(F.when(is_ascii(c), native), _canonical_udf(F.when(~is_ascii(c), c)))


def is_missing(normalized: Column) -> Column:
    """Whether the canonical form is that of no value."""
    return normalized.isin(*MISSING_FORMS)


def blank_if_missing(normalized: Column) -> Column:
    return F.when(is_missing(normalized), "").otherwise(normalized)


def tokens(normalized: Column) -> Column:
    return F.filter(F.split(normalized, " "), lambda t: t != "")


def core_tokens(normalized: Column) -> Column:
    """Tokens without legal forms and generic words, in order, duplicates kept."""
    return F.filter(F.split(normalized, " "), lambda t: (t != "") & ~t.isin(*LEGAL_TOKENS))


def alpha_tokens(address_tokens: Column, least: int = MIN_ALPHA_LENGTH) -> Column:
    return F.filter(address_tokens, lambda t: (F.length(t) >= least) & t.rlike(r"\p{L}"))


def house_number(address: Column, address_tokens: Column) -> Column:
    native = F.get(F.filter(address_tokens, lambda t: t.rlike(r"\A[0-9]+\z")), 0)
    return F.when(is_ascii(address), native).otherwise(_first_number_udf(F.when(~is_ascii(address), address)))


def source_of(entity_id: Column) -> Column:
    """What stands before the first hyphen, '' without one."""
    return F.when(F.instr(entity_id, "-") > 0, F.substring_index(entity_id, "-", 1)).otherwise("")


def strip(c: Column) -> Column:
    """Without any Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def script_class(name: Column) -> Column:
    """Script of a name by fixed precedence: empty, latin, devanagari, tamil, latin+marks, cjk, ..."""
    only_latin = ~name.rlike(r"[\p{L}&&[^\p{IsLatin}]]") & name.rlike(r"\p{IsLatin}")
    return (
        F.when(name == "", "empty")
        .when(is_ascii(name), "latin")
        .when(name.rlike(r"\p{IsDevanagari}"), "devanagari")
        .when(name.rlike(r"\p{IsTamil}"), "tamil")
        .when(only_latin, "latin+marks")
        .when(name.rlike(r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"), "cjk")
        .when(name.rlike(r"\p{IsArabic}"), "arabic")
        .when(name.rlike(r"\p{IsCyrillic}"), "cyrillic")
        .when(name.rlike(r"\p{IsGreek}"), "greek")
        .otherwise("other-script")
    )


def with_words(records: DataFrame) -> DataFrame:
    """The columns of canonical records that follow from name and address."""
    rows = records.withColumns({"name_core": core_tokens(F.col("name")), "address_tokens": tokens(F.col("address")), "name_is_missing": F.col("name") == "", "address_is_missing": F.col("address") == ""})
    return rows.withColumn("address_alpha_tokens", alpha_tokens(F.col("address_tokens")))


def normalize_records(df: DataFrame, *keep: str) -> DataFrame:
    """(source, entity_id, ord, business_name, business_address, country) -> canonical records, with the columns keep.

    One projection; the columns that pair features reuse are made here, once for each
    record, rather than for each pair.
    """
    first = df.select(
        *keep,
        "source",
        "entity_id",
        "ord",
        normalize_text(F.col("country")).alias("country"),
        normalize_text(F.col("business_name")).alias("raw_name"),
        normalize_text(F.col("business_address")).alias("raw_address"),
    )
    named = first.select(
        *keep,
        "source",
        "entity_id",
        "ord",
        "country",
        blank_if_missing(F.col("raw_name")).alias("name"),
        blank_if_missing(F.col("raw_address")).alias("address"),
        is_missing(F.col("raw_name")).alias("name_is_missing"),
        is_missing(F.col("raw_address")).alias("address_is_missing"),
    )
    split = named.withColumns({"name_core": core_tokens(F.col("name")), "address_tokens": tokens(F.col("address"))})
    return split.select(
        *keep,
        "source",
        "entity_id",
        "ord",
        "country",
        "name",
        "name_core",
        "address",
        "address_tokens",
        alpha_tokens(F.col("address_tokens")).alias("address_alpha_tokens"),
        house_number(F.col("address"), F.col("address_tokens")).alias("house_number"),
        "name_is_missing",
        "address_is_missing",
    )
