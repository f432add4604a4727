"""Why true pairs are not candidates, and what other key families would recover."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions.similarity import strict_bigram_jaccard
from ..functions.text import script_class
from .blocking import capped_keys, keyed

# The flags' and categories' names, and where a similarity counts as low.
LOW_SIMILARITY = 0.4
EXAMPLES = 6
FLAGS = (
    "name_missing_either", "name_no_core_token_either", "name_key_differs", "name_1tok_vs_multi",
    "name_core_count_differs", "name_prefix4_differs", "script_differs", "latin_both_low_similarity",
    "addr_missing_either", "addr_no_key_either", "addr_key_differs", "house_absent_either", "house_differs",
    "street_prefix_differs", "country_disagrees", "country_only_blocker", "both_name_and_addr_weak",
    "SHARED_KEY_BUT_MISSED", "shared_key_was_capped",
)
CATEGORIES = {
    "unavailable": "record unavailable",
    "capped": "shared key truncated by cap={cap}",
    "no_key": "no usable key on either side",
    "no_name": "name unusable (address keys exist)",
    "country": "country blocks an otherwise matching key",
    "both": "both name and address keys differ",
    "single_token": "1-token vs multi-token name (no padding)",
    "script": "name key differs: different script",
    "prefix": "name key differs: token/prefix mismatch",
    "house": "address key differs: house number",
    "street": "address key differs: street prefix",
    "other": "other",
}
_RECORD = ("country", "name", "name_core", "address", "address_tokens", "address_alpha_tokens", "house_number", "name_is_missing", "address_is_missing")


def missed_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """True (ref_id, cand_id) that are not among the candidate pairs."""
    return edges.select("ref_id", "cand_id").distinct().join(pairs.select("ref_id", "cand_id").distinct(), ["ref_id", "cand_id"], "left_anti")


def prefixes() -> Column:
    return F.slice(F.transform(F.sort_array("name_core"), lambda t: F.substring(t, 1, 4)), 1, 2)


def described(records: DataFrame, config: K.BlockingConfig, *more: str) -> DataFrame:
    """What the flags need of a record, and the columns more."""
    words = F.array_distinct(F.transform("address_alpha_tokens", lambda w: F.substring(w, 1, config.address_prefix)))
    return records.select(
        *more,
        *_RECORD,
        K.name_key(config).alias("name_key"),
        K.address_keys(config).alias("address_keys"),
        K.blocking_keys(config).alias("keys"),
        K.addresses_without_country().alias("free_keys"),
        K.name_without_country().alias("free_name"),
        words.alias("street"),
        prefixes().alias("prefixes"),
        script_class(F.col("name")).alias("script"),
        (F.size(K.address_keys(config)) == 0).alias("no_keys"),
        F.col("house_number").isNull().alias("no_house"),
    )


def _sided(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))


def _no(c: Column) -> Column:
    return ~F.coalesce(c, F.lit(False))


def flag_columns(a: Callable[[str], Column], b: Callable[[str], Column], *, address: Column, free: Column, house: Column, street: Column, shared: Column, capped: Column, similarity: Column) -> dict[str, Column]:
    """The flags of a pair from its sides' columns and from what their addresses and keys have in common.

    address and free: whether keys of the address are shared, with and without country;
    house: whether two numbers differ; street: whether two sets of words have none in common;
    shared and capped: whether a key is shared, and one that was over-full.
    """
    either = lambda test: test(a) | test(b)
    core_a, core_b = F.size(a("name_core")), F.size(b("name_core"))
    shorter = F.least(core_a, core_b, F.lit(2))
    same_start = F.slice(a("prefixes"), 1, shorter) == F.slice(b("prefixes"), 1, shorter)
    latin = lambda s: s("script").isin("latin", "latin+marks")
    named = (a("name") != "") & (b("name") != "")
    name_differs = _no(a("name_key") == b("name_key"))
    no_key = either(lambda s: s("no_keys"))
    addr_differs = ~no_key & ~address
    both_houses = ~a("no_house") & ~b("no_house")
    countries = a("country") != b("country")
    meet_without = F.coalesce(a("free_name") == b("free_name"), F.lit(False)) | free
    return {
        "name_missing_either": either(lambda s: s("name_is_missing")),
        "name_no_core_token_either": (core_a == 0) | (core_b == 0),
        "name_key_differs": name_differs,
        "name_1tok_vs_multi": ((core_a == 1) & (core_b > 1)) | ((core_b == 1) & (core_a > 1)),
        "name_core_count_differs": core_a != core_b,
        "name_prefix4_differs": (core_a > 0) & (core_b > 0) & ~same_start,
        "script_differs": named & (latin(a) != latin(b)),
        "latin_both_low_similarity": named & (a("script") == "latin") & (b("script") == "latin") & (similarity < LOW_SIMILARITY),
        "addr_missing_either": either(lambda s: s("address_is_missing")),
        "addr_no_key_either": no_key,
        "addr_key_differs": addr_differs,
        "house_absent_either": ~both_houses,
        "house_differs": both_houses & house,
        "street_prefix_differs": street,
        "country_disagrees": countries,
        "country_only_blocker": countries & meet_without,
        "both_name_and_addr_weak": name_differs & addr_differs,
        "SHARED_KEY_BUT_MISSED": shared,
        "shared_key_was_capped": capped,
    }


def flagged(missed: DataFrame, records: DataFrame, config: K.BlockingConfig = K.DEFAULT, *, pool: DataFrame | None = None) -> DataFrame:
    """missed pairs with 19 flags, their shared keys, and one category each.

    Flags overlap; the category is the first that fits, in a fixed order. A pair with a
    record that records lacks has no flag and the category 'record unavailable'. pool is
    what was indexed (all but S1 by default); its over-full keys are the capped ones.
    """
    pool = records.where("source <> 'S1'") if pool is None else pool
    d = described(records, config, "entity_id")
    both = missed.join(_sided(d, "a"), F.col("ref_id") == F.col("a_entity_id"), "left").join(_sided(d, "b"), F.col("cand_id") == F.col("b_entity_id"), "left")
    full = capped_keys(pool, config).select("key")
    asked = both.select("ref_id", "cand_id", F.explode(F.array_intersect("a_keys", "b_keys")).alias("key"))
    capped = asked.join(full, "key").groupBy("ref_id", "cand_id").agg(F.lit(True).alias("capped"))
    both = both.join(capped, ["ref_id", "cand_id"], "left")
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    street = (F.size(a("street")) > 0) & (F.size(b("street")) > 0) & ~F.arrays_overlap(a("street"), b("street"))
    made = flag_columns(
        a,
        b,
        address=F.arrays_overlap(a("address_keys"), b("address_keys")),
        free=F.arrays_overlap(a("free_keys"), b("free_keys")),
        house=a("house_number") != b("house_number"),
        street=(a("address") != "") & (b("address") != "") & street,
        shared=F.arrays_overlap(a("keys"), b("keys")),
        capped=F.col("capped"),
        similarity=strict_bigram_jaccard(a("name"), b("name")),
    )
    here = a("entity_id").isNotNull() & b("entity_id").isNotNull()
    out = both.select("ref_id", "cand_id", here.alias("available"), F.array_intersect("a_keys", "b_keys").alias("shared_keys"), *((here & F.coalesce(made[n], F.lit(False))).alias(n) for n in FLAGS))
    return out.withColumn("category", category(config))


def category(config: K.BlockingConfig, c: Callable[[str], Column] = F.col) -> Column:
    """The first category that fits, from the flags and available."""
    unusable = c("name_missing_either") | c("name_no_core_token_either")
    name, address = c("name_key_differs"), c("addr_key_differs")
    tests = {
        "unavailable": ~c("available"),
        "capped": c("SHARED_KEY_BUT_MISSED"),
        "no_key": unusable & (c("addr_no_key_either") | c("addr_missing_either")),
        "no_name": unusable,
        "country": c("country_only_blocker"),
        "both": name & address,
        "single_token": name & c("name_1tok_vs_multi"),
        "script": name & c("script_differs"),
        "prefix": name,
        "house": address & c("house_differs"),
        "street": address,
    }
    return F.coalesce(*(F.when(test, CATEGORIES[k].format(cap=config.max_group_size)) for k, test in tests.items()), F.lit(CATEGORIES["other"]))


def categories(flags: DataFrame) -> DataFrame:
    return flags.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def flag_counts(flags: DataFrame) -> DataFrame:
    """(flag, n) for every flag, zeros included."""
    sums = flags.agg(*(F.count_if(F.col(n)).alias(n) for n in FLAGS))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("flag"), F.col(n).alias("n")) for n in FLAGS))).alias("r")).select("r.*")


def examples(flags: DataFrame, k: int = EXAMPLES) -> DataFrame:
    """Up to k pairs of each category, in order of ids."""
    order = Window.partitionBy("category").orderBy("ref_id", "cand_id")
    return flags.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("category", "rn", "ref_id", "cand_id")


def capped_key_report(flags: DataFrame, pool: DataFrame, config: K.BlockingConfig = K.DEFAULT, k: int = 12) -> DataFrame:
    """The k keys that missed pairs share most: how many share them, records that wanted the key, whether it was capped."""
    return key_report(flags.select(F.explode("shared_keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("missed")), pool, config, k)


def key_report(shared: DataFrame, pool: DataFrame, config: K.BlockingConfig = K.DEFAULT, k: int = 12) -> DataFrame:
    """capped_key_report from the counts (key, missed)."""
    sizes = keyed(pool, None, config).join(shared.select("key"), "key", "left_semi").groupBy("key").agg(F.count(F.lit(1)).alias("bucket"))
    return shared.join(sizes, "key", "left").select("key", "missed", F.coalesce("bucket", F.lit(0)).alias("bucket"), (F.coalesce("bucket", F.lit(0)) > config.max_group_size).alias("was_capped")).orderBy(F.desc("missed"), "key").limit(k)


def recovery(missed: DataFrame, records: DataFrame, families: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """missed pairs with hits, the sorted names of families under which both records share a key."""
    families = families or K.FAMILIES
    made = records.select("entity_id", *(f().alias(n) for n, f in families.items()))
    both = missed.join(_sided(made, "a"), F.col("ref_id") == F.col("a_entity_id")).join(_sided(made, "b"), F.col("cand_id") == F.col("b_entity_id"))
    hits = F.array_compact(F.array(*(F.when(F.arrays_overlap(f"a_{n}", f"b_{n}"), F.lit(n)) for n in sorted(families))))
    return both.select("ref_id", "cand_id", hits.alias("hits"))


def recovery_counts(recovered: DataFrame) -> DataFrame:
    """(family, n): distinct missed pairs that a family reaches, and 'any' for all families together.

    A row of recovered with a column n stands for n pairs.
    """
    n = F.sum("n") if "n" in recovered.columns else F.count(F.lit(1))
    families = F.concat("hits", F.when(F.size("hits") > 0, F.array(F.lit("any"))).otherwise(F.array().cast("array<string>")))
    return recovered.withColumn("family", F.explode(families)).groupBy("family").agg(n.alias("n"))


def ranked_families(counts: DataFrame) -> DataFrame:
    """(rank, family, n) from recovery_counts without 'any', most pairs first; a row for each family."""
    order = Window.orderBy(F.desc("n"), "family")
    return counts.where("family <> 'any'").select(F.row_number().over(order).alias("rank"), "family", "n")


def recovery_combinations(recovered: DataFrame) -> DataFrame:
    """(combination, n): families that reach a pair together, NONE for pairs out of reach of all; n as in recovery_counts."""
    named = F.when(F.size("hits") > 0, F.array_join("hits", "+")).otherwise("NONE")
    return recovered.groupBy(named.alias("combination")).agg((F.sum("n") if "n" in recovered.columns else F.count(F.lit(1))).alias("n"))


def family_volume(references: DataFrame, pool: DataFrame, families: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """Per family: pool records that share a key with a reference, in all, on average, at most, and references without any.

    A pool record that shares two keys with a reference counts once for it. Keys of all
    families are made in one pass over either side, and counted by key before they are
    joined; only a family of several keys a record needs its pairs, to count them once.
    """
    made = families or K.FAMILIES
    several = [name for name in made if name == "addr_nocountry"]

    def keyed(side: DataFrame, ids: list[Column], names: list[str]) -> DataFrame:
        none = F.array().cast("array<string>")
        tag = lambda name: lambda k: F.struct(F.lit(name).alias("family"), k.alias("key"))
        tagged = [F.transform(F.coalesce(made[n](), none), tag(n)) for n in names]
        return side.select(*ids, F.explode(F.concat(*tagged)).alias("e")).select("*", "e.family", "e.key").drop("e")

    ref, one = F.col("entity_id").alias("ref_id"), [n for n in made if n not in several]
    counts = None
    if one:
        sizes = keyed(pool, [], one).groupBy("family", "key").agg(F.count(F.lit(1)).alias("n"))
        counts = keyed(references, [ref], one).join(sizes, ["family", "key"]).groupBy("family", "ref_id").agg(F.sum("n").alias("n"))
    if several:
        met = keyed(references, [ref], several).join(keyed(pool, [F.col("source").alias("s"), F.col("entity_id").alias("c")], several), ["family", "key"])
        pairs = met.select("family", "ref_id", "s", "c").distinct().groupBy("family", "ref_id").agg(F.count(F.lit(1)).alias("n"))
        counts = pairs if counts is None else counts.unionByName(pairs)
    every = references.select(ref, F.explode(F.array(*map(F.lit, made))).alias("family"))
    every = every.join(counts, ["family", "ref_id"], "left").select("family", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    found = every.groupBy("family").agg(F.sum("n").alias("total"), F.avg("n").alias("mean"), F.max("n").alias("largest"), F.count_if(F.col("n") == 0).alias("without"))
    named = references.sparkSession.createDataFrame([(n,) for n in made], "family string").join(found, "family", "left")
    return named.select("family", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("mean", F.lit(0.0)).alias("mean"), F.coalesce("largest", F.lit(0)).alias("largest"), F.coalesce("without", F.lit(0)).alias("without"))
