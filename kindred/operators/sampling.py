"""Deterministic subsets of entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import sampled


def first_sampled(records: DataFrame, n: int, *, key: str = "exp20k-s1", modulus: int = 110) -> DataFrame:
    """The first n records, in order of ord, whose keyed id hash is divisible by modulus."""
    return records.where(sampled(F.col("entity_id"), key, modulus)).orderBy("ord", "entity_id").limit(n)


def restrict_pool(pool: DataFrame, matched: DataFrame, chosen: Column, per_source: int) -> DataFrame:
    """Pool rows that matched(source, entity_id) names, and per source the first per_source others that chosen admits."""
    ids = matched.select("source", "entity_id").distinct()
    named = pool.join(ids, ["source", "entity_id"], "left_semi")
    arrival = Window.partitionBy("source").orderBy("ord", "entity_id")
    others = pool.join(ids, ["source", "entity_id"], "left_anti").where(chosen).withColumn("_n", F.row_number().over(arrival)).where(F.col("_n") <= per_source).drop("_n")
    return named.unionByName(others)
