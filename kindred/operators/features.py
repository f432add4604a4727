"""The 24 similarity features of a pair, reference on the left, candidate on the right."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import compiled
from ..functions import keys as K
from ..functions import similarity as S
from ..functions import text as T
from ..sources.storage import Scratch
from . import blocking

# The features' order is part of a trained model.
FEATURE_NAMES = (
    "name_exact", "name_char_ratio", "name_bigram_jaccard", "name_len_ratio",
    "name_core_sorted_exact", "name_core_jaccard", "name_core_overlap", "name_core_token_ratio", "name_core_prefix4_equal",
    "address_exact", "address_char_ratio", "address_bigram_jaccard", "address_token_jaccard",
    "address_alpha_jaccard", "address_alpha_overlap", "address_token_ratio",
    "house_number_equal", "house_number_conflict", "country_equal", "country_present_either",
    "name_present_both", "address_present_both", "name_core_present_either", "address_alpha_present_either",
)
#: References of a key that meet its candidates in one part.
MEET = 128
RATIOS = {"name_char_ratio": "name", "address_char_ratio": "address"}
_SIDE = ("country", "name", "name_core", "address", "address_tokens", "house_number", "core_set", "core_sorted", "prefixes", "token_set", "alpha_set", "name_bigrams", "address_bigrams", "core_words", "alpha_words")


def prepared(records: DataFrame) -> DataFrame:
    """Canonical records with what every pair needs, made once for each record."""
    core = F.sort_array("name_core")
    return records.select(
        "*",
        F.array_distinct("name_core").alias("core_set"),
        core.alias("core_sorted"),
        F.transform(F.slice(core, 1, 2), lambda t: F.substring(t, 1, 4)).alias("prefixes"),
        F.array_distinct("address_tokens").alias("token_set"),
        F.array_distinct("address_alpha_tokens").alias("alpha_set"),
        S.bigrams(F.col("name")).alias("name_bigrams"),
        S.bigrams(F.col("address")).alias("address_bigrams"),
        F.array_join("name_core", " ").alias("core_words"),
        F.array_join("address_alpha_tokens", " ").alias("alpha_words"),
    )


def _side(records: DataFrame, prefix: str, source: str, entity: str, *more: str) -> DataFrame:
    columns = [*more, F.col("source").alias(source), F.col("entity_id").alias(entity)]
    return records.select(*columns, F.lit(True).alias(f"{prefix}_known"), *(F.col(c).alias(f"{prefix}_{c}") for c in _SIDE))


def with_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs with both records' columns as l_... and r_...; the run fails on a pair of an unknown record.

    unknown_records lists such records beforehand.
    """
    ready = prepared(records)
    left, right = _side(ready, "l", "ref_source", "ref_id"), _side(ready, "r", "cand_source", "cand_id")
    joined = pairs.join(left, ["ref_source", "ref_id"], "left").join(right, ["cand_source", "cand_id"], "left")
    for prefix, entity in (("l", "ref_id"), ("r", "cand_id")):
        missing = F.raise_error(F.concat(F.lit("a pair names a record that is not there: "), F.coalesce(F.col(entity), F.lit("null"))))
        joined = joined.withColumn(f"{prefix}_name", F.when(F.col(f"{prefix}_known"), F.col(f"{prefix}_name")).otherwise(missing)).drop(f"{prefix}_known")
    return joined


def candidates_with_records(records: DataFrame, config: K.BlockingConfig = K.DEFAULT, *, arms: bool = False, references: DataFrame | None = None) -> DataFrame:
    """blocking.candidates, or with arms blocking.two_arms, with both records' columns as with_records gives them.

    Pairs are made where their records meet under a key, and are never shuffled: a pair of
    several keys comes from the first that it was found by. references(ref_id, ...) adds columns of
    its own to all pairs of a reference. records are written to a scratch table; ids are unique.
    """
    spark = records.sparkSession
    stored, _ = Scratch(spark).put(records.select("source", "entity_id", "ord", "country", "name", "address", "house_number"), "records")
    stored = T.with_words(stored)
    refs, pool = stored.where("source = 'S1'"), stored.where("source <> 'S1'")
    made = {"production": K.blocking_keys(config)} | ({"added": F.array_compact(F.array(K.a2_key(config.name_prefix)))} if arms else {})
    index = None
    for keys in made.values():
        found = blocking.build_index(pool, config, keys=keys, probing=blocking.keyed(refs, keys, config)).select("source", "entity_id", "key")
        index = found if index is None else index.unionByName(found)
    kept = index.groupBy("source", "entity_id").agg(F.collect_list("key").alias("kept"))
    base = ["country", "name", "name_core", "address", "address_tokens", "address_alpha_tokens", "house_number"]
    left = refs.select("source", "entity_id", *base, made["production"].alias("production"), F.concat(*made.values()).alias("keys"))
    more = []
    if references is not None:
        more = [c for c in references.columns if c != "ref_id"]
        left = left.join(references.withColumnRenamed("ref_id", "entity_id"), "entity_id", "left")
    # production keys come first: a pair is one of production if the first key it was found by is
    left = left.select("*", F.posexplode("keys").alias("at", "key")).withColumns({"earlier": F.slice("keys", F.lit(1), F.col("at")), "is_prod": F.col("at") < F.size("production")}).drop("keys", "production", "at")
    right = pool.select("source", "entity_id", *base).join(kept, ["source", "entity_id"]).withColumn("key", F.explode("kept"))
    parts = blocking.keyed(refs, F.concat(*made.values()), config).groupBy("key").agg(F.ceil(F.count(F.lit(1)) / MEET).cast("int").alias("parts")).where("parts > 1")
    share = F.coalesce("parts", F.lit(1))
    left = left.join(parts, "key", "left").withColumn("part", F.pmod(F.xxhash64("entity_id"), share)).drop("parts")
    right = right.join(parts, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), share - 1))).drop("parts")
    # what pairs need of a record is made after the rows are dealt out, so it is not shuffled
    left, right = (prepared(side.repartition("key", "part")) for side in (left, right))
    left = _side(left, "l", "ref_source", "ref_id", "key", "part", "earlier", "is_prod", *more)
    joined = left.join(_side(right, "r", "cand_source", "cand_id", "key", "part", "kept"), ["key", "part"]).where((F.size("earlier") == 0) | ~F.arrays_overlap("earlier", "kept"))
    return joined.drop("key", "part", "earlier", "kept", "l_known", "r_known", *([] if arms else ["is_prod"]))


def unknown_records(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """(source, entity_id) that pairs name and records lack."""
    named = pairs.select(F.col("ref_source").alias("source"), F.col("ref_id").alias("entity_id")).union(pairs.select("cand_source", "cand_id"))
    return named.distinct().join(records, ["source", "entity_id"], "left_anti")


def _native() -> dict[str, Column]:
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))  # noqa: E741
    both_names = (l("name") != "") & (r("name") != "")
    both_addresses = (l("address") != "") & (r("address") != "")
    both_cores = (F.size(l("name_core")) > 0) & (F.size(r("name_core")) > 0)
    any_core = (F.size(l("name_core")) > 0) | (F.size(r("name_core")) > 0)
    both_alpha = (F.size(l("alpha_set")) > 0) & (F.size(r("alpha_set")) > 0)
    any_alpha = (F.size(l("alpha_set")) > 0) | (F.size(r("alpha_set")) > 0)
    both_numbers = l("house_number").isNotNull() & r("house_number").isNotNull()
    one = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    gated = lambda gate, value: F.when(gate, value).otherwise(F.lit(0.0))
    overlap = lambda c: F.size(F.array_intersect(l(c), r(c))).cast("double")
    return {
        "name_exact": one(both_names & (l("name") == r("name"))),
        "name_bigram_jaccard": gated(both_names, S.jaccard(l("name_bigrams"), r("name_bigrams"))),
        "name_len_ratio": gated(both_names, S.length_ratio(l("name"), r("name"))),
        "name_core_sorted_exact": one(any_core & (l("core_sorted") == r("core_sorted"))),
        "name_core_jaccard": gated(any_core, S.jaccard(l("core_set"), r("core_set"))),
        "name_core_overlap": gated(any_core, overlap("core_set")),
        "name_core_token_ratio": gated(both_cores, S.count_ratio(F.size(l("name_core")), F.size(r("name_core")))),
        "name_core_prefix4_equal": one(both_cores & (l("prefixes") == r("prefixes"))),
        "address_exact": one(both_addresses & (l("address") == r("address"))),
        "address_bigram_jaccard": gated(both_addresses, S.jaccard(l("address_bigrams"), r("address_bigrams"))),
        "address_token_jaccard": gated(both_addresses, S.jaccard(l("token_set"), r("token_set"))),
        "address_alpha_jaccard": gated(both_alpha, S.jaccard(l("alpha_set"), r("alpha_set"))),
        "address_alpha_overlap": gated(both_alpha, overlap("alpha_set")),
        "address_token_ratio": gated(both_addresses, S.count_ratio(F.size(l("address_tokens")), F.size(r("address_tokens")))),
        "house_number_equal": one(both_numbers & (l("house_number") == r("house_number"))),
        "house_number_conflict": one(both_numbers & (l("house_number") != r("house_number"))),
        "country_equal": one((l("country") != "") & (r("country") != "") & (l("country") == r("country"))),
        "country_present_either": one((l("country") != "") | (r("country") != "")),
        "name_present_both": one(both_names),
        "address_present_both": one(both_addresses),
        "name_core_present_either": one(any_core),
        "address_alpha_present_either": one(any_alpha),
    }


def native_features(joined: DataFrame, keep: list[str]) -> DataFrame:
    """The 22 features that need no Python, in the features' order."""
    made = _native()
    return joined.select(*keep, *(made[n].alias(n) for n in FEATURE_NAMES if n in made))


def featurize(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """pairs with 24 double columns, none null or NaN; absence is 0 and a presence flag.

    The character ratios are computed in Python, in one pass over the joined pairs: equal
    strings and gated pairs never get there.
    """
    return vectors(with_records(pairs, records), pairs.columns)


def vectors(joined: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of pairs with their records, and the 24 features.

    Python gets the two strings of a ratio and the finished features, not the records' words.
    """
    made, ratios, none = _native(), [], F.lit(None).cast("string")
    for name, column in RATIOS.items():
        a, b = F.col(f"l_{column}"), F.col(f"r_{column}")
        present = (a != "") & (b != "")
        differ = present & (a != b)
        made[name] = F.when(present & (a == b), 1.0).otherwise(0.0)
        ratios += [F.when(differ, a).otherwise(none).alias(f"l_{name}"), F.when(differ, b).otherwise(none).alias(f"r_{name}")]
    ready = joined.select(*keep, *(made[n].alias(n) for n in FEATURE_NAMES), *ratios)
    schema = ready.select(*keep, *FEATURE_NAMES).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns))
            for name in RATIOS:
                found = S.ratios(columns.pop(f"l_{name}").to_pylist(), columns.pop(f"r_{name}").to_pylist())
                columns[name] = pc.coalesce(pa.array(found, from_pandas=True), columns[name])
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return ready.mapInArrow(run, schema)


def packed(joined: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep of pairs with their records, and x, the 24 features as doubles in one value.

    vectors in a form for what reads all features of many pairs: no row goes through Python.
    """
    function = compiled.register(joined.sparkSession, "PairFeatures")
    sides = [f"{side}_{c}" for c in ("name", "core_words", "address", "alpha_words", "house_number", "country") for side in "lr"]
    return joined.select(*keep, F.call_function(function, *sides).alias("x"))


def vector() -> Column:
    """The features as one array, in order."""
    return F.array(*FEATURE_NAMES)


def health(features: DataFrame) -> DataFrame:
    """One row: rows, values that are not finite, rows of zeros only."""
    odd = sum((F.when(F.col(n).isNull() | F.isnan(n) | (F.abs(F.col(n)) == float("inf")), 1).otherwise(0) for n in FEATURE_NAMES), F.lit(0))
    zero = F.lit(True)
    for n in FEATURE_NAMES:
        zero &= F.col(n) == 0
    return features.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(odd), F.lit(0)).cast("long").alias("non_finite"), F.count_if(zero).alias("zero_rows"))
