"""Embedding near-dedup: sign hashes in several tables, exact cosine, connected components.

Hashing has two levels. Vectors of one label meet in cells of some CELL rows: the label itself
if it is no larger, else the buckets of a few coarse tables, so a vector travels once, or once
for each coarse table. Within a cell a task lays out the fine tables and compares the vectors
of each bucket.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrows import whole_groups
from .components import connected_components
from .storage import Scratch
from .vectors import matrix, usable

#: Rows of a cell that are wanted; a cell of more than twice as many is compared share by share.
CELL = 8192
#: Rows of a fine bucket that are wanted, and rows of it that are compared with all others at once.
BUCKET, ROWS = 64, 512
#: Probabilities that a pair at the threshold meets in no coarse, and in no fine table.
COARSE_MISS, FINE_MISS = 5e-4, 1e-5
#: Bits of a coarse table that are made; a label of 2 ** 24 cells would use them all.
MOST_BITS = 24


def tables_for(bits: int, threshold: float, miss: float) -> int:
    """Tables of so many bits in which a pair at the threshold is missed with this probability."""
    agree = 1 - math.acos(min(1.0, threshold)) / math.pi
    return 1 if not bits or agree == 1 else max(1, math.ceil(math.log(miss) / math.log1p(-(agree**bits))))


def coarse_layout(rows: int, threshold: float) -> tuple[int, int]:
    """(bits, tables) of the cells of a label with so many vectors."""
    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max(rows, 1) / CELL))))
    return bits, tables_for(bits, threshold, COARSE_MISS)


def fine_layout(rows: int, threshold: float) -> tuple[int, int]:
    bits = max(2, round(math.log2(max(rows, 1) / BUCKET)))
    return bits, tables_for(bits, threshold, FINE_MISS)


@lru_cache(maxsize=64)
def _planes(bits: int, tables: int, dim: int, *seed: int) -> np.ndarray:
    return np.random.default_rng([*seed, dim]).standard_normal((tables, bits, dim))


def codes(x: np.ndarray, bits: int, tables: int, seed: list[int]) -> np.ndarray:
    """row x table: the signs of random projections, as integers; fewer bits are a prefix's."""
    planes = _planes(bits, tables, x.shape[1], *seed)
    out = np.empty((len(x), tables), np.int32)
    for t in range(tables):
        out[:, t] = (x @ planes[t].T >= 0) @ (1 << np.arange(bits, dtype=np.int64))
    return out


def _coded(reps: DataFrame, tables: int, seed: int) -> DataFrame:
    """reps with the codes of the coarse tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("vector"))
            dims = np.diff(vectors.offsets.to_numpy())
            out = np.empty((batch.num_rows, tables), np.int32)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                out[at] = codes(matrix(vectors.take(pa.array(at))), MOST_BITS, tables, [seed, 0])
            made = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, tables, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "codes"])

    return reps.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in reps.schema)}, codes array<int>")


def _forest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member that links reach, with new links; label holds what was reached before."""
    while True:
        new, low = label.copy(), np.minimum(label[a], label[b])
        for end in (a, b, label[a], label[b]):
            np.minimum.at(new, end, low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def _pairs(x: np.ndarray, side: np.ndarray | None, threshold: float, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows at the threshold or above, each in the first fine table in which it meets.

    With side, only pairs of a row that has it and one that doesn't.
    """
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    bits, tables = fine_layout(len(x), threshold)
    sign = codes(x, bits, tables, [seed, 1])
    for t in range(tables):
        order = np.argsort(sign[:, t], kind="stable")
        starts = np.flatnonzero(np.diff(sign[order, t], prepend=-1))
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
            if e - s < 2:
                continue
            own = order[s:e]
            left, right = (own, own) if side is None else (own[side[own]], own[~side[own]])
            for at in range(0, len(left), ROWS):
                some = left[at : at + ROWS]
                near = (x[some] @ x[right].T) / (length[some, None] * length[None, right]) >= threshold
                a, b = np.nonzero(near)
                a, b = some[a], right[b]
                if side is None:
                    a, b = a[a < b], b[a < b]
                first = _unmet(sign, a, b, t)
                if first.any():
                    yield a[first], b[first]


def _unmet(sign: np.ndarray, a: np.ndarray, b: np.ndarray, tables: int) -> np.ndarray:
    """Whether pairs meet in none of the first tables."""
    out = np.ones(len(a), bool)
    for k in range(0, len(a) if tables else 0, 100_000):
        out[k : k + 100_000] = ~(sign[a[k : k + 100_000], :tables] == sign[b[k : k + 100_000], :tables]).any(axis=1)
    return out


def _compare(cells: DataFrame, threshold: float, seed: int) -> DataFrame:
    """Rows (src, dst, n): a forest's edges with n 0, and how many vectors src links to with dst null."""
    key = ["label", "dim", "nth", "code", "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        edges: list[np.ndarray] = []
        held = 0
        for table, at in whole_groups(batches, key):
            ids, copies, share = table["rep"].to_numpy(), table["copies"].to_numpy(), table["share"].to_numpy()
            i, j, nth, bits = (table[c].to_numpy() for c in ("i", "j", "nth", "bits"))
            for s, e in zip(at.tolist(), [*at[1:].tolist(), len(table)]):
                if e - s < 2:
                    continue
                x, side = matrix(table["vector"].slice(s, e - s)), None if i[s] == j[s] else share[s:e] == i[s]
                # A pair counts in the first coarse table in which it meets.
                before = codes(x, MOST_BITS, int(nth[s]), [seed, 0]) & (1 << int(bits[s])) - 1 if nth[s] else None
                label, met = np.arange(e - s), np.zeros(e - s, np.int64)
                for a, b in _pairs(x, side, threshold, seed):
                    first = _unmet(before, a, b, int(nth[s])) if nth[s] else slice(None)
                    a, b = a[first], b[first]
                    met += np.bincount(a, copies[s + b], e - s).astype(np.int64) + np.bincount(b, copies[s + a], e - s).astype(np.int64)
                    label = _forest(label, a, b)
                joined = np.flatnonzero(label != np.arange(e - s))
                edges.append(np.stack([ids[s + joined], ids[s + label[joined]]]))
                held += len(joined)
                for k in np.flatnonzero(met).tolist():
                    v = int(ids[s + k])
                    counts[v] = counts.get(v, 0) + int(met[k])
                if len(counts) > 50_000 or held > 50_000:
                    yield out(counts, edges)
                    counts, edges, held = {}, [], 0
        yield out(counts, edges)

    def out(counts, edges):
        pairs = np.unique(np.concatenate(edges, axis=1), axis=1) if edges else np.zeros((2, 0), np.int64)
        src = np.concatenate([pairs[0], np.fromiter(counts, np.int64, len(counts))])
        dst = pa.concat_arrays([pa.array(pairs[1].astype(np.int64)), pa.nulls(len(counts), pa.int64())])
        n = np.concatenate([np.zeros(pairs.shape[1], np.int64), np.fromiter(counts.values(), np.int64, len(counts))])
        return pa.RecordBatch.from_arrays([pa.array(src.astype(np.int64)), dst, pa.array(n)], ["src", "dst", "n"])

    return cells.repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "src long, dst long, n long")


def _layout_column(threshold: float, rows: Column, which: int) -> Column:
    """bits (0) or tables (1) of a label with so many rows, by the doublings of CELL that it takes."""
    out = F.lit(coarse_layout(1, threshold)[which])
    for bits in range(1, MOST_BITS + 1):
        out = F.when(rows > CELL << bits - 1, coarse_layout(CELL << bits, threshold)[which]).otherwise(out)
    return out


def near_duplicates(embeddings: DataFrame, scratch: Scratch, *, threshold: float = 0.93, seed: int = 2, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) of every row.

    Vectors of one label and dimension link if their cosine, in double precision, is at
    least threshold. Equal vectors are one node with a number of copies. Each pair is
    verified, and counted in the first table in which it shares a bucket; a cell of more
    than two CELL rows is dealt over shares, each pair of which is a cell of its own. A pair
    at the threshold is missed with a probability of COARSE_MISS + FINE_MISS, of FINE_MISS
    alone in a label of up to CELL vectors, and a closer pair with less.

    Vectors that are null, zero or hold null or non-finite components, and rows without
    label or key, link with nothing: n_links 0, component_id their own key. Rows that repeat
    key, label and vector are one vector. An empty table gives no row.
    """
    rows = embeddings.select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector")).withColumn("fine", usable("vector") & F.col("label").isNotNull() & F.col("id").isNotNull())
    fine = rows.where("fine")
    reps = fine.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies")).withColumn("dim", F.size("vector"))
    reps, _ = scratch.put(reps, "vectors")
    # Labels of more than a cell, and cells of more than two, are few: rows / CELL at most.
    large = reps.groupBy("label", "dim").count().where(F.col("count") > CELL)
    large, _ = scratch.put(large.select("label", "dim", *(_layout_column(threshold, F.col("count"), w).alias(c) for w, c in enumerate(("bits", "tables")))).coalesce(1), "labels")
    most = large.agg(F.max("tables")).first()[0] or 1
    met = reps.join(large, ["label", "dim"], "left").fillna({"bits": 0, "tables": 1})
    if most > 1:
        made = F.posexplode(F.slice("codes", 1, F.col("tables"))).alias("nth", "code")
        met = _coded(met, most, seed).select("label", "vector", "rep", "copies", "dim", "bits", made).withColumn("code", F.col("code").bitwiseAND(F.expr("shiftleft(1, bits) - 1")))
    else:
        met = met.select("label", "vector", "rep", "copies", "dim", "bits", F.lit(0).alias("nth"), F.lit(0).alias("code"))
    cell = ["label", "dim", "nth", "code"]
    full, _ = scratch.put(met.groupBy(cell).agg(F.ceil(F.count(F.lit(1)) / CELL).cast("long").alias("shares")).where("shares > 2").coalesce(1), "cells")
    met = met.join(full, cell, "left").fillna({"shares": 1}).withColumn("share", F.pmod(F.xxhash64("rep"), "shares"))
    part = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1), lambda o: F.struct(F.least("share", o).alias("i"), F.greatest("share", o).alias("j")))).alias("part")
    cells = met.select(*cell, "bits", "rep", "copies", "vector", "share", part).select("*", "part.i", "part.j").drop("part")
    found, _ = scratch.put(_compare(cells, threshold, seed), "links")
    groups = connected_components(found.where("dst is not null").select("src", "dst"), scratch)
    counts = found.where("dst is null").groupBy("src").agg(F.sum("n").alias("others"))
    nodes = reps.select("label", "vector", "rep", "copies").join(counts.withColumnRenamed("src", "rep"), "rep", "left").join(groups.withColumnRenamed("node", "rep"), "rep", "left")
    nodes = nodes.select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    linked = fine.join(nodes, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("id", "n", "c")
    alone = rows.where("not fine").select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("c"))
    return linked.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("id") == F.col("c"), F.lit(True)).alias("kept"))
