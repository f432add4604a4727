"""SimHash near-dedup by anchor-point covering.

Two fingerprints that differ in at most two bits differ in at most one bit in one of their
32-bit halves. For each half the anchors are the words of the [31, 26] Hamming code, which
covers every 31-bit string within radius one. A fingerprint goes to every anchor within
radius plus threshold (two) of its half; its own nearest anchor is its home. If two halves
differ in at most one bit, the home of either is an anchor of the other, so comparing the
homes at each anchor with all that came there finds every link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrows import whole_groups
from .components import connected_components
from .storage import Scratch
from .workers import claim

SEED = 42
#: Rows of an anchor that are compared at once.
BLOCK = 2048


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """64-bit SimHash: a bit is set if more than half of the shingles' hashes have it."""
    w = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not w:
        return 0
    if len(w) < words:
        shingles = [b" ".join(w)]
    else:
        shingles = map(b" ".join, zip(*(w[i:] for i in range(words))))
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """A bit is set if more than half of the hashes have it."""
    n, total = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


_LOWER = bytes(range(256)).lower()


def fingerprints(docs: DataFrame, *, words: int = 3, seed: int = SEED, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) with the fingerprint as a signed 64-bit integer; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), words, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, fp long")


def _masks() -> list[list[int]]:
    """By syndrome: what to flip to get each anchor within two bits, the nearest first.

    Bit i - 1 of a half stands for column i of the check matrix, 1 to 31.
    """
    out = []
    for s in range(32):
        near = [1 << (s - 1)] if s else [0]
        out.append(near + [1 << (i - 1) | 1 << ((i ^ s) - 1) for i in range(1, 32) if s and i < i ^ s])
    return out


def anchored(fps: DataFrame) -> DataFrame:
    """fps(fp) -> (anchor, home, fp): 1 or 16 rows for each half of each fingerprint."""
    checks = [sum(1 << (i - 1) for i in range(1, 32) if i >> j & 1) for j in range(5)]
    masks = F.array(*(F.array(*(F.lit(m).cast("long") for m in row)) for row in _masks()))
    halves = fps.select("fp", F.posexplode(F.array(F.col("fp").bitwiseAND(0x7FFFFFFF), F.shiftrightunsigned("fp", 32).bitwiseAND(0x7FFFFFFF))).alias("half", "x"))
    syndrome = sum((F.shiftleft(F.bit_count(F.col("x").bitwiseAND(c)) % 2, j) for j, c in enumerate(checks)), F.lit(0))
    flips = halves.select("fp", "half", "x", F.posexplode(F.element_at(masks, syndrome.cast("int") + 1)).alias("nth", "flip"))
    anchor = F.shiftleft(F.col("half").cast("long"), 31).bitwiseOR(F.col("x").bitwiseXOR(F.col("flip")))
    return flips.select(anchor.alias("anchor"), (F.col("nth") == 0).alias("home"), "fp")


class _Forest:
    """Union by least member; keeps the edges that join."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
            self.edges.append((a, b))


def _compare(homes: np.ndarray, others: np.ndarray, limit: int, forest: _Forest) -> None:
    """Joins every home with every other one that it links to, a block at a time."""
    step = max(1, (1 << 20) // max(len(others), 1))
    for i in range(0, len(homes), step):
        a, b = np.nonzero(np.bitwise_count(homes[i : i + step, None] ^ others[None, :]) <= limit)
        for x, y in zip(homes[i + a].tolist(), others[b].tolist()):
            if x != y:
                forest.link(x, y)


def links(fps: DataFrame, *, limit: int = 2, block: int = BLOCK, scratch: Scratch) -> DataFrame:
    """Edges (src, dst) between distinct fingerprints that span all links.

    A task returns a forest, never the pairs of a group. Anchors with more than block rows
    are spread: their homes over shares of at most block, each of which meets all that came
    there, dealt over shares likewise, so no task sees more than two shares at once.
    """
    if limit != 2:
        raise ValueError("the anchors are laid out for two differing bits")
    rows = anchored(fps.select("fp").distinct())
    sizes = rows.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    sizes, _ = scratch.put(sizes, "anchors")  # anchors with company; alone, nothing links
    shares = F.ceil(F.col("n") / block).cast("long")
    met = rows.join(sizes, "anchor").withColumn("shares", shares).withColumn("own", F.pmod(F.xxhash64("fp"), "shares"))
    # Cell (i, j) compares the homes of share i with everything in share j.
    as_home = met.where("home").select("anchor", F.col("own").alias("i"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("j"), "home", "fp")
    as_other = met.select("anchor", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("i"), F.col("own").alias("j"), F.lit(False).alias("home"), "fp")
    cells = as_home.unionByName(as_other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("simhash")
        forest = _Forest()
        for table, at in whole_groups(batches, ["anchor", "i", "j"]):
            home = table["home"].to_numpy()
            fp = table["fp"].to_numpy().view(np.uint64)
            ends = np.append(at[1:], len(table))
            some = np.add.reduceat(home.astype(np.int64), at)
            for s, e in zip(at[(some > 0) & (ends - at > some)].tolist(), ends[(some > 0) & (ends - at > some)].tolist()):
                h, f = home[s:e], fp[s:e]
                if e - s - int(h.sum()) < 2 and len(np.unique(f)) < 2:
                    continue
                _compare(f[h], f[~h], limit, forest)
            if len(forest.edges) > 50_000:
                yield _edges(forest)
                forest = _Forest()
        yield _edges(forest)

    key = ["anchor", "i", "j"]
    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "src long, dst long")


def _edges(forest: _Forest) -> pa.RecordBatch:
    pairs = np.array(forest.edges, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["src", "dst"])


def near_duplicates(docs: DataFrame, scratch: Scratch, *, words: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): the least key that links of at most two bits reach.

    Equal fingerprints are one node, so copies cost a row, not pairs. Null and wordless
    texts have fingerprint zero and link like any other; texts of fewer words than a
    shingle are one shingle. Rows that share a key share its component if their texts
    link; a null key stands behind every other. An empty table gives no row.
    """
    fps, _ = scratch.put(fingerprints(docs, words=words, key=key, text=text), "fingerprints")
    nodes, _ = scratch.put(fps.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    groups = connected_components(links(nodes, scratch=scratch), scratch)
    member = nodes.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named, _ = scratch.put(member.join(least, "component").select("fp", "component_id"), "named")
    return fps.join(named, "fp").select(key, "fp", "component_id")


def hex_of(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def first_of_each(docs: DataFrame, scratch: Scratch, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those that a document of smaller key reaches by links; columns as they are.

    Rows that share a key are one document and stay or go together; rows without a key stay.
    """
    found = near_duplicates(docs, scratch, key=key, text=text)
    gone, _ = scratch.put(found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("gone")).distinct(), "gone")
    return docs.join(gone, docs[key] == gone["gone"], "left_anti")
