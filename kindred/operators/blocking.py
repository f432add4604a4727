"""The capped inverted index as a DataFrame, and candidate pairs by equi-join on its keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K

PAIR = ["ref_source", "ref_id", "cand_source", "cand_id"]
#: Caps up to this become group limits before the ranking shuffle (Spark's default threshold).
GROUP_LIMIT = 1000
#: Tasks that share a key under a greater cap.
PARTS = 64


def keyed(records: DataFrame, keys: Column | None = None, config: K.BlockingConfig = K.DEFAULT) -> DataFrame:
    """(key, source, entity_id, ord), a row for each key of each record."""
    return records.select(F.explode(K.blocking_keys(config) if keys is None else keys).alias("key"), "source", "entity_id", "ord")


def build_index(records: DataFrame, config: K.BlockingConfig = K.DEFAULT, *, keys: Column | None = None, per_source: bool = False, probing: DataFrame | None = None) -> DataFrame:
    """(key, source, entity_id, ord, rn): the first max_group_size arrivals under each key.

    Records arrive in order of (source, ord). per_source caps each source for itself.
    probing(key) keeps only keys that something will ask for; since the cap is for each key,
    dropping the others first changes nothing, and it is done before the ranking shuffle.
    The rank filter becomes a group limit before that shuffle for caps up to GROUP_LIMIT;
    under a greater cap a key is first ranked in PARTS parts, so no task sorts all of it.
    """
    rows = keyed(records, keys, config)
    if probing is not None:
        rows = rows.join(probing.select("key").distinct(), "key", "left_semi")
    group = ["key", "source"] if per_source else ["key"]
    if config.max_group_size > GROUP_LIMIT:
        parts = rows.withColumn("part", F.pmod(F.xxhash64("source", "entity_id"), F.lit(PARTS)))
        rows = _first(parts, [*group, "part"], config.max_group_size).drop("part", "rn")
    return _first(rows, group, config.max_group_size)


def _first(rows: DataFrame, group: list[str], most: int) -> DataFrame:
    """The first arrivals of each group, with their rank rn."""
    arrival = Window.partitionBy(*group).orderBy("source", "ord", "entity_id")
    return rows.withColumn("rn", F.row_number().over(arrival)).where(F.col("rn") <= most)


def retrieve(probes: DataFrame, index: DataFrame) -> DataFrame:
    """Pairs of probes(key, source, entity_id) and index rows that share a key; one row for each key they share."""
    left = probes.select("key", F.col("source").alias("ref_source"), F.col("entity_id").alias("ref_id"))
    right = index.select("key", F.col("source").alias("cand_source"), F.col("entity_id").alias("cand_id"))
    return left.join(right, "key").select(*PAIR)


def generate_candidates(references: DataFrame, index: DataFrame, config: K.BlockingConfig = K.DEFAULT, *, keys: Column | None = None) -> DataFrame:
    """Distinct pairs of a reference and an indexed record, without a record's pair with itself."""
    pairs = retrieve(keyed(references, keys, config), index)
    return pairs.where(~((F.col("ref_source") == F.col("cand_source")) & (F.col("ref_id") == F.col("cand_id")))).distinct()


def candidates(records: DataFrame, config: K.BlockingConfig = K.DEFAULT, *, reference: str = "S1", keys: Column | None = None) -> DataFrame:
    """Index of all sources but the reference one, probed by the reference's keys alone."""
    refs, pool = records.where(F.col("source") == reference), records.where(F.col("source") != reference)
    index = build_index(pool, config, keys=keys, probing=keyed(refs, keys, config))
    return generate_candidates(refs, index, config, keys=keys)


def index_stats(records: DataFrame, config: K.BlockingConfig = K.DEFAULT, *, keys: Column | None = None) -> DataFrame:
    """One row: indexed and keyless records, distinct keys, largest group kept, capped groups, references kept."""
    made = K.blocking_keys(config) if keys is None else keys
    kinds = records.select(F.size(made).alias("n")).agg(F.count_if(F.col("n") > 0).alias("indexed_records"), F.count_if(F.col("n") == 0).alias("keyless_records"))
    cap = F.lit(config.max_group_size)
    groups = keyed(records, keys, config).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    sums = groups.agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.coalesce(F.max(F.least("n", cap)), F.lit(0)).cast("long").alias("largest_group"),
        F.count_if(F.col("n") > cap).alias("capped_groups"),
        F.coalesce(F.sum(F.least("n", cap)), F.lit(0)).cast("long").alias("stored_references"),
    )
    return kinds.crossJoin(sums)  # one row each


def capped_keys(records: DataFrame, config: K.BlockingConfig = K.DEFAULT) -> DataFrame:
    """(key, bucket): keys that more records wanted than the cap lets in."""
    return keyed(records, None, config).groupBy("key").agg(F.count(F.lit(1)).alias("bucket")).where(F.col("bucket") > config.max_group_size)


def two_arms(records: DataFrame, config: K.BlockingConfig = K.DEFAULT, *, reference: str = "S1", single_token: bool = False) -> DataFrame:
    """Union of production and A2 candidates, is_prod true where production alone finds the pair."""
    production = candidates(records, config, reference=reference).withColumn("is_prod", F.lit(True))
    added = candidates(records, config, reference=reference, keys=F.array_compact(F.array(K.a2_key(config.name_prefix, single_token)))).withColumn("is_prod", F.lit(False))
    return production.unionByName(added).groupBy(*PAIR).agg(F.max("is_prod").alias("is_prod"))


def added_pairs(arms: DataFrame) -> DataFrame:
    """Pairs that only A2 finds."""
    return arms.where(~F.col("is_prod")).select(*PAIR)


def pair_faults(arms: DataFrame, sources: tuple[str, ...] = ("S2", "S3")) -> DataFrame:
    """One row: repeated pairs, pairs of a record with itself, candidates of unexpected sources."""
    return arms.agg(
        (F.count(F.lit(1)) - F.count_distinct(*PAIR)).alias("repeated"),
        F.count_if((F.col("ref_source") == F.col("cand_source")) & (F.col("ref_id") == F.col("cand_id"))).alias("self_pairs"),
        F.count_if(~F.col("cand_source").isin(*sources)).alias("foreign_candidates"),
    )
