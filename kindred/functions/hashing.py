"""Keyed hashes that sample and split entities the same way everywhere."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BUCKETS = 10_000


def keyed_hash(value: str, key: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), key=key.encode(), digest_size=8).digest(), "big")


def bucket_of(value: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}\0{value}".encode(), digest_size=8).digest(), "big") % BUCKETS


def sampled(entity_id: Column, key: str, modulus: int) -> Column:
    """Whether the keyed hash of the id is divisible by modulus."""

    @F.pandas_udf("boolean")
    def udf(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: None if i is None else keyed_hash(i, key) % modulus == 0)

    return udf(entity_id)


def split_bucket(entity_id: Column, salt: str = "v1") -> Column:
    """0 to 9999; use it on distinct ids and join back."""

    @F.pandas_udf("int")
    def udf(ids: pd.Series) -> pd.Series:
        return ids.map(lambda i: None if i is None else bucket_of(i, salt)).astype("Int32")

    return udf(entity_id)
