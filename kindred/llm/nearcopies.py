"""Near copies by the Jaccard similarity of word shingles: SimHash, MinHash bands, exact sets.

Candidates first meet at the anchors of simhash: sets whose fingerprints differ in two bits
at most. Copies at a similarity of 0.8 differ in some ten of 64 bits, and at a radius that
wide no split of 64 bits leaves keys that select, so more candidates meet in bands of MinHash
values. Every link is decided by counting common shingles. A pair at the least similarity
shares no band with a probability of 1.3e-7, a more similar one with less.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .arrows import whole_groups
from .components import connected_components
from .simhash import _LOWER, SEED, _edges, _Forest
from .storage import Scratch
from .workers import claim

LEAST = Fraction(4, 5)
#: A pair of similarity s shares none of the bands with probability (1 - s ** VALUES) ** BANDS.
BANDS, VALUES = 40, 5
#: Sets of a candidate group that a task holds twice at most.
SHARE = 512
#: Fingerprints that differ in no more bits make candidates; what the anchors are laid out for.
BITS = 2
#: Shingles that are hashed or looked up at once.
CHUNK = 1 << 11
LOOKED_UP = 1 << 20

_random = np.random.default_rng(SEED)
_XOR, _ODD = (_random.integers(0, 1 << 64, (BANDS * VALUES, 1), np.uint64) for _ in range(2))
_ODD |= np.uint64(1)
_MIX = _random.integers(0, 1 << 64, (BANDS, VALUES), np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words than a shingle are one."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    made = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[i:] for i in range(words))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, made, repeat(SEED)), np.uint64))


def bands(found: np.ndarray) -> np.ndarray:
    """A 64-bit name for each band of MinHash values of a set that is not empty."""
    least = np.full(BANDS * VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), CHUNK):
        np.minimum(least, ((found[at : at + CHUNK] ^ _XOR) * _ODD).min(axis=1), out=least)
    return (least.reshape(BANDS, VALUES) * _MIX).sum(axis=1, dtype=np.uint64)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows).view(np.int64)))


def _sims(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64))


def sketches(docs: DataFrame, *, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, sim, bands): fp names the set of shingles, sim is its SimHash; no band for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [shingles(t.as_py(), words) for t in batch.column(1)]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), _sims(sets), _lists([bands(s) if len(s) else s for s in sets])], [key, "fp", "sim", "bands"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, fp long, sim long, bands array<long>")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """docs(text) -> (fp, sim, bands, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = [shingles(t.as_py(), words) for t in batch.column(0)]
            fps = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), _sims(sets), _lists([bands(s) if len(s) else s for s in sets]), _lists(sets)], ["fp", "sim", "bands", "set"])

    return docs.mapInArrow(run, "fp long, sim long, bands array<long>, set array<long>")


def _verify(table: pa.Table, least: Fraction, forest: _Forest) -> None:
    """Joins the similar sets of one cell: those of two shares, or all of one."""
    own, fp, sim = table["own"].to_numpy(), table["fp"].to_numpy().view(np.uint64), table["sim"].to_numpy().view(np.uint64)
    band = table["bands"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
    sizes = pc.list_value_length(table["set"]).to_numpy().astype(np.int64)
    values, ends = table["set"].combine_chunks().flatten().to_numpy().view(np.uint64), np.cumsum(sizes)
    crossed = own.min() != own.max()
    part = np.arange(len(table))  # sets that are joined already need no comparison
    p, q = least.numerator, least.denominator
    for x in range(len(table) - 1):
        y = np.flatnonzero(part[x + 1 :] != part[x]) + x + 1
        if crossed:
            y = y[own[y] != own[x]]
        y = y[q * np.minimum(sizes[y], sizes[x]) >= p * np.maximum(sizes[y], sizes[x])]
        y = y[(np.bitwise_count(sim[y] ^ sim[x]) <= BITS) | (band[y] == band[x]).any(axis=1)]
        mine = values[ends[x] - sizes[x] : ends[x]]
        for some in np.split(y, np.flatnonzero(np.diff(np.cumsum(sizes[y]) // LOOKED_UP)) + 1):
            if not len(some):
                continue
            theirs = np.concatenate([values[ends[i] - sizes[i] : ends[i]] for i in some.tolist()])
            hit = mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            linked = some[q * common >= p * (sizes[x] + sizes[some] - common)]
            if len(linked):
                for i in linked.tolist():
                    forest.link(int(fp[x]), int(fp[i]))
                part[np.isin(part, part[linked])] = part[x]


def links(docs: DataFrame, nodes: DataFrame, *, words: int, least: Fraction, key: str, text: str, scratch: Scratch, share: int = SHARE) -> DataFrame:
    """Edges (src, dst) between distinct sets, nodes(fp, sim, first, bands), that span all links.

    Sets whose fingerprints link, or that share a band, are a candidate group, found by a
    forest of fingerprints and a star for each band and not by pairs. Only texts of such groups are read again, for their sets. A group of more than
    share sets is dealt over cells of two shares, and a task returns a forest.
    """
    named = nodes.select("fp", F.explode("bands").alias("band"))
    heads = named.groupBy("band").agg(F.min("fp").alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").select("band", "head")
    heads, _ = scratch.put(heads, "bands")
    stars = named.join(heads, "band").where("fp <> head").select(F.col("head").alias("src"), F.col("fp").alias("dst"))
    worded = nodes.where(F.size("bands") > 0)
    firsts, _ = scratch.put(worded.groupBy("sim").agg(F.min("fp").alias("head")), "sims")
    alike = simhash.links(firsts.select(F.col("sim").alias("fp")), limit=BITS, scratch=scratch)
    end = lambda side: firsts.select(F.col("sim").alias(side), F.col("head").alias(f"{side}_head"))
    stars = stars.unionByName(worded.join(firsts, "sim").where("fp <> head").select(F.col("head").alias("src"), F.col("fp").alias("dst")))
    stars = stars.unionByName(alike.join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_head").alias("src"), F.col("dst_head").alias("dst")))
    groups, _ = scratch.put(connected_components(stars, scratch).withColumnRenamed("component", "grp"), "groups")
    sizes = groups.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / share).cast("long").alias("shares"))
    wanted = nodes.join(groups.select(F.col("node").alias("fp")), "fp", "left_semi").select(F.col("first").alias("wanted")).distinct()
    texts = docs.join(wanted, docs[key].eqNullSafe(wanted["wanted"]), "left_semi").select(text)
    sets = _sets(texts, words).dropDuplicates(["fp"]).join(groups.withColumnRenamed("node", "fp"), "fp").join(sizes, "grp")
    sets = sets.withColumn("own", F.pmod(F.xxhash64("fp"), "shares"))
    cells = sets.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("other"), "own", "fp", "sim", "bands", "set")
    cells = cells.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", "sim", "bands", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        forest = _Forest()
        for table, at in whole_groups(batches, ["grp", "i", "j"]):
            for s, e in zip(at.tolist(), [*at[1:].tolist(), len(table)]):
                if e - s > 1:
                    _verify(table.slice(s, e - s), least, forest)
            if len(forest.edges) > 50_000:
                yield _edges(forest)
                forest = _Forest()
        yield _edges(forest)

    cell = ["grp", "i", "j"]
    return cells.repartition(*cell).sortWithinPartitions(*cell).mapInArrow(run, "src long, dst long")


def near_copies(docs: DataFrame, scratch: Scratch, *, words: int = 5, least: Fraction = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component_id): the least key that links reach.

    Two texts link if their sets of shingles have a Jaccard similarity of least or more;
    equal sets are one node, as are all texts without words. A null key stands behind
    every other. An empty table gives no row.
    """
    if least < LEAST:
        raise ValueError(f"the bands are laid out for similarities from {LEAST}")
    made, _ = scratch.put(sketches(docs, words=words, key=key, text=text), "sketches")
    nodes, _ = scratch.put(made.groupBy("fp").agg(F.min(key).alias("first"), F.first("sim").alias("sim"), F.first("bands").alias("bands")), "nodes")
    groups = connected_components(links(docs, nodes, words=words, least=least, key=key, text=text, scratch=scratch), scratch)
    member = nodes.select("fp", "first").join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    first = member.groupBy("component").agg(F.min("first").alias("component_id"))
    found, _ = scratch.put(member.join(first, "component").select("fp", "component_id"), "named")
    return made.select(key, "fp").join(found, "fp").select(key, "component_id")


def first_of_each(docs: DataFrame, scratch: Scratch, *, words: int = 5, least: Fraction = LEAST, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that a document of smaller key reaches by links; columns as they are.

    Rows that share a key are one document and stay or go together; rows without a key stay.
    """
    found = near_copies(docs, scratch, words=words, least=least, key=key, text=text)
    gone, _ = scratch.put(found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("gone")).distinct(), "gone")
    return docs.join(gone, docs[key] == gone["gone"], "left_anti")
