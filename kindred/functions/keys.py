"""Blocking keys: short strings on which records of one entity are likely to meet.

A key is its parts joined by U+001F, its strategy first. Canonical text never holds that
character, and a missing country is '', so two keys are equal only if all parts are.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\u001f"


@dataclass(frozen=True)
class BlockingConfig:
    """How long keys are, and how many records one key may hold."""

    name_tokens: int = 2
    name_prefix: int = 4
    address_prefix: int = 3
    address_words: int = 2
    max_group_size: int = 1000

    def __post_init__(self):
        for name in ("name_tokens", "name_prefix", "address_prefix", "max_group_size"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if self.address_words < 0:
            raise ValueError("address_words must not be negative")


DEFAULT = BlockingConfig()


def _key(*parts: Column | str) -> Column:
    return F.concat_ws(SEPARATOR, *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _prefixes(items: Column, n: int) -> Column:
    return F.transform(items, lambda t: F.substring(t, 1, n))


def _joined(items: Column) -> Column:
    return F.array_join(items, SEPARATOR)


def _core() -> Column:
    return F.col("name_core")


def _country() -> Column:
    return F.col("country")


def _if_any(items: Column, key: Column, least: int = 1) -> Column:
    return F.when(F.size(items) >= least, key)


def name_key(config: BlockingConfig = DEFAULT) -> Column:
    """Prefixes of the first core tokens in order of the alphabet; null without core tokens."""
    taken = F.slice(F.sort_array(_core()), 1, config.name_tokens)
    return _if_any(_core(), _key("name_2tok", _country(), _joined(_prefixes(taken, config.name_prefix))))


def longest_words(count: int) -> Column:
    """The longest address words, earlier ones first among equals."""
    ranked = F.array_sort(F.transform(F.col("address_alpha_tokens"), lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w"))))
    return F.transform(F.slice(ranked, 1, count), lambda s: s["w"])


def address_keys(config: BlockingConfig = DEFAULT) -> Column:
    """A key for each long word beside the house number; none without the number."""
    none = F.array().cast("array<string>")
    if not config.address_words:
        return none
    made = F.transform(
        longest_words(config.address_words),
        lambda w, i: F.concat_ws(SEPARATOR, F.concat(F.lit("addr_ht"), i.cast("string")), _country(), F.col("house_number"), F.substring(w, 1, config.address_prefix)),
    )
    return F.when(F.col("house_number").isNotNull(), F.array_distinct(made)).otherwise(none)


def blocking_keys(config: BlockingConfig = DEFAULT) -> Column:
    return F.array_distinct(F.concat(F.array_compact(F.array(name_key(config))), address_keys(config)))


def a2_key(prefix: int = 4, single_token: bool = False) -> Column:
    """First two core tokens as they stand; with single_token also of one-token names."""
    taken = _prefixes(F.slice(_core(), 1, 2), prefix)
    return _if_any(_core(), _key("name_2tok_a2", _country(), _joined(taken)), 1 if single_token else 2)


def first_token() -> Column:
    return _if_any(_core(), _key("name_1tok", _country(), F.substring(F.get(_core(), F.lit(0)), 1, 4)))


def short_prefixes() -> Column:
    return _if_any(_core(), _key("name_2tok_p3", _country(), _joined(_prefixes(F.slice(F.sort_array(_core()), 1, 2), 3))))


def all_core() -> Column:
    return _if_any(_core(), _key("name_allcore", _country(), _joined(F.sort_array(_prefixes(_core(), 4)))))


def whole_address() -> Column:
    return F.when(F.col("address") != "", _key("addr_exact", _country(), F.col("address")))


def address_start() -> Column:
    return F.when(F.col("address") != "", _key("addr_prefix8", _country(), F.substring(F.col("address"), 1, 8)))


def all_words() -> Column:
    alpha = F.col("address_alpha_tokens")
    return F.when(F.col("house_number").isNotNull() & (F.size(alpha) > 0), _key("addr_ht_all", _country(), F.col("house_number"), _joined(F.sort_array(_prefixes(alpha, 3)))))


def name_without_country() -> Column:
    return _if_any(_core(), _key("name_nocountry", _joined(_prefixes(F.slice(F.sort_array(_core()), 1, 2), 4))))


def addresses_without_country() -> Column:
    """Up to two keys without country or position; empty without a number or words."""
    made = F.transform(longest_words(2), lambda w: F.concat_ws(SEPARATOR, F.lit("addr_nocountry"), F.col("house_number"), F.substring(w, 1, 3)))
    return F.when(F.col("house_number").isNotNull(), F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def _one(make: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: F.array_compact(F.array(make()))


#: Key families by name; each gives an array of keys. Callers may pass families of their own.
FAMILIES: dict[str, Callable[[], Column]] = {
    "name_1tok": _one(first_token),
    "name_2tok_order": _one(a2_key),
    "name_2tok_p3": _one(short_prefixes),
    "name_allcore": _one(all_core),
    "addr_exact": _one(whole_address),
    "addr_prefix8": _one(address_start),
    "addr_ht_all": _one(all_words),
    "name_nocountry": _one(name_without_country),
    "addr_nocountry": addresses_without_country,
}
