"""Approximate nearest neighbours by inner product: probed lists, adaptive dimension scan.

Inner products become distances by one more dimension, sqrt(longest**2 - |x|**2), zero for
a query. Lists are cells of a k-means over a bounded sample; every row is indexed. Vectors
are turned by a random rotation and read in blocks of columns. After each block a test asks
whether the distance can still come under the query's 20th best: of a turned difference, d
of D columns hold a Beta-distributed share of the whole with mean d / D, so a partial
distance above that share of the bound by SIGMA deviations abandons the candidate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrows import whole_groups
from .storage import Scratch
from .vectors import matrix, norm, usable

#: Rows that the lists and the number of probes are fitted on.
SAMPLE = 20_000
#: Share of true neighbours, of queries in the sample, that the probed lists must hold.
COVER = 0.97
MOST_LISTS = 1024
SIGMA = 2.5
COLUMNS = 16
#: Indexed rows and queries that meet in one task.
SHARD, QUERIES = 16_384, 4_096


@dataclass(frozen=True)
class Index:
    dim: int
    longest: float
    centres: np.ndarray
    rotation: np.ndarray
    probes: int

    def lift(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.longest**2 - np.einsum("ij,ij->i", x, x), 0))
        return np.hstack([x, rest[:, None]])

    def order(self, lifted: np.ndarray) -> np.ndarray:
        """Lists from the nearest centre to the farthest."""
        return np.argsort(np.einsum("ij,ij->i", self.centres, self.centres) - 2 * lifted @ self.centres.T, axis=1, kind="stable")

    def probed(self, lifted: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
        """query x list: the nearest ones, and more while they hold fewer than least rows."""
        order = self.order(lifted)
        before = np.cumsum(sizes[order], axis=1) - sizes[order]
        wanted = (np.arange(order.shape[1]) < self.probes) | (before < least)
        out = np.zeros(order.shape, bool)
        np.put_along_axis(out, order, wanted, axis=1)
        return out


def fit(sample: np.ndarray, rows: int, longest: float, k: int, seed: int = 3) -> Index:
    """Lists by k-means, and as many probes as the sample's own neighbours need."""
    rng = np.random.default_rng(seed)
    n, dim = sample.shape
    lists = max(1, min(MOST_LISTS, n, round(math.sqrt(rows) / 2)))
    index = Index(dim, longest, np.zeros((1, dim + 1)), np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0], 1)
    x = index.lift(sample)
    centres = x[rng.choice(n, lists, replace=False)]
    for _ in range(8):
        near = Index(dim, longest, centres, index.rotation, 1).order(x)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        sizes = np.bincount(near, minlength=lists)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], x[rng.choice(n, lists)])
    index = Index(dim, longest, centres, index.rotation, 1)
    near = index.order(x)[:, 0]
    asked = rng.choice(n, min(n, 256), replace=False)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-scores, axis=1)[:, : min(k, n - 1)]
    place = np.argsort(index.order(index.lift(sample[asked], query=True)), axis=1)
    needed = np.sort(np.take_along_axis(place, near[best], axis=1).ravel()) + 1
    probes = int(needed[min(len(needed) - 1, math.ceil(COVER * len(needed)))]) if len(needed) else 1
    return Index(dim, longest, centres, index.rotation, probes)


class Scan:
    """The k best of some queries over some rows."""

    def __init__(self, index: Index, queries: np.ndarray, query_ids: np.ndarray, k: int):
        self.index, self.queries, self.ids, self.k = index, queries, query_ids, k
        self.turned = index.lift(queries, query=True) @ index.rotation
        n = len(queries)
        self.score, self.found = np.full((n, k), -np.inf), np.full((n, k), -1, np.int64)
        width = index.dim + 1
        self.cuts = [*range(0, width, COLUMNS), width]
        share = np.array(self.cuts[1:]) / width
        self.allow = np.where(share < 1, share + SIGMA * np.sqrt(2 * share * (1 - share) / (width + 2)), 1 + 1e-9)
        self.square = np.einsum("ij,ij->i", queries, queries)

    def bound(self, q: np.ndarray) -> np.ndarray:
        """Squared distance of the k-th best so far."""
        return np.maximum(self.square[q] + self.index.longest**2 - 2 * self.score[q, -1], 0) + 1e-12

    def rows(self, x: np.ndarray, ids: np.ndarray, asking: np.ndarray) -> None:
        turned = self.index.lift(x) @ self.index.rotation
        for a in range(0, len(x), 1024):
            for b in range(0, len(asking), 256):
                self._block(x[a : a + 1024], turned[a : a + 1024], ids[a : a + 1024], asking[b : b + 256])

    def _block(self, x: np.ndarray, turned: np.ndarray, ids: np.ndarray, asking: np.ndarray) -> None:
        bound, mine = self.bound(asking), self.turned[asking]
        q = r = part = None
        dense = np.zeros((len(asking), len(x)))
        for lo, hi, allow in zip(self.cuts[:-1], self.cuts[1:], self.allow):
            own, theirs = mine[:, lo:hi], turned[:, lo:hi]
            if q is None:
                dense += np.einsum("ij,ij->i", own, own)[:, None] + np.einsum("ij,ij->i", theirs, theirs)[None, :] - 2 * own @ theirs.T
                stays = dense <= (allow * bound)[:, None]
                if hi == self.cuts[-1] or stays.mean() < 0.1:
                    q, r = np.nonzero(stays)
                    part = dense[q, r]
            else:
                part = part + ((own[q] - theirs[r]) ** 2).sum(axis=1)
                stays = part <= allow * bound[q]
                q, r, part = q[stays], r[stays], part[stays]
            if q is not None and not len(q):
                return
        other = self.ids[asking[q]] != ids[r]
        self._keep(asking[q[other]], ids[r[other]], np.einsum("ij,ij->i", self.queries[asking[q[other]]], x[r[other]]))

    def _keep(self, q: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(q)
        q = np.concatenate([np.repeat(touched, self.k), q])
        ids = np.concatenate([self.found[touched].ravel(), ids])
        score = np.concatenate([self.score[touched].ravel(), score])
        order = np.lexsort((ids, -score, q))
        q, ids, score = q[order], ids[order], score[order]
        begin = np.searchsorted(q, touched)
        take = begin[:, None] + np.arange(self.k)
        self.found[touched], self.score[touched] = ids[take], score[take]


def search(embeddings: DataFrame, is_query, scratch: Scratch, *, k: int = 20, seed: int = 3, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score): for each query the k rows of largest inner product found.

    is_query: condition on the rows; a query's own row is no candidate. Scores are inner
    products of the original vectors in double precision, ties go to the smaller key. Lists
    are fitted on SAMPLE rows (those of least hash); all rows are indexed. A list of more
    than SHARD rows is split, so no task grows with it. Probing goes on until the lists hold
    more than k rows, so only a table of k rows or fewer gives fewer results.

    Vectors that are null, zero, hold null or non-finite components, have no key, or another
    dimension than most of the sample take no part. Rows that repeat a key count once
    for each row. An empty table gives no row.
    """
    spark = embeddings.sparkSession
    rows = embeddings.where(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), is_query.alias("asks"))
    kept = rows.withColumn("h", F.xxhash64("id", F.lit(seed))).orderBy("h", "id").limit(SAMPLE).select("vector").toPandas()["vector"]
    if not len(kept):
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    dims = kept.map(len)
    dim = int(dims.mode().min())
    rows = rows.where(F.size("vector") == dim)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(norm("vector")).alias("longest")).first()
    index = fit(np.stack(kept[dims == dim].to_numpy()).astype(np.float64), facts["n"], facts["longest"], k, seed)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = index.order(index.lift(matrix(batch.column(1))))[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int64))], ["id", "vector", "asks", "list"])

    kind = rows.schema["vector"].dataType.simpleString()
    held, _ = scratch.put(rows.mapInArrow(assign, f"id long, vector {kind}, asks boolean, list long"), "lists")
    sizes = np.zeros(len(index.centres), np.int64)
    for r in held.groupBy("list").count().collect():  # at most MOST_LISTS rows
        sizes[r["list"]] = r["count"]
    first, parts, shard, room = [], [], -1, 0
    for size in sizes.tolist():
        need = max(1, math.ceil(size / SHARD))
        if need > 1 or size > room:
            shard, room = shard + 1, SHARD if need == 1 else 0
        first.append(shard)
        parts.append(need)
        shard, room = shard + need - 1, room - size if need == 1 else 0
    first_of, parts_of = np.array(first), np.array(parts)
    lookup = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("list").cast("int") + 1).cast("long")
    base = held.select("id", "vector", "list", (lookup(first) + F.pmod(F.xxhash64("id"), lookup(parts))).alias("shard"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wanted = index.probed(index.lift(matrix(batch.column(1)), query=True), sizes, k + 1)
            targets = []
            for row in wanted:
                at = np.flatnonzero(row & (sizes > 0))
                targets.append(np.unique(np.concatenate([first_of[at]] + [np.arange(first_of[l], first_of[l] + parts_of[l]) for l in at if parts_of[l] > 1])))
            src = np.repeat(np.arange(batch.num_rows), [len(t) for t in targets])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(src)), batch.column(1).take(pa.array(src)), pa.array(np.concatenate(targets).astype(np.int64))], ["id", "vector", "shard"])

    asked = held.where("asks").select("id", "vector").mapInArrow(probe, f"id long, vector {kind}, shard long")
    asked, _ = scratch.put(asked, "queries")
    blocks = asked.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("long").alias("blocks"))
    cells = (
        base.join(blocks, "shard")
        .select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "list", "id", "vector")
        .unionByName(asked.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("id"), "blocks").alias("block"), F.lit(-1).cast("long").alias("list"), "id", "vector"))
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, at in whole_groups(batches, ["shard", "block"]):
            for s, e in zip(at.tolist(), [*at[1:].tolist(), len(table)]):
                cell = table.slice(s, e - s)
                lists, ids, x = cell["list"].to_numpy(), cell["id"].to_numpy(), matrix(cell["vector"])
                asks = np.flatnonzero(lists < 0)
                if not len(asks):
                    continue
                work = Scan(index, x[asks], ids[asks], k)
                wanted = index.probed(index.lift(x[asks], query=True), sizes, k + 1)
                for l in np.unique(lists[lists >= 0]).tolist():
                    there = np.flatnonzero(lists == l)
                    work.rows(x[there], ids[there], np.flatnonzero(wanted[:, l]))
                q, r = np.nonzero(np.isfinite(work.score))
                yield pa.RecordBatch.from_arrays([pa.array(work.ids[q]), pa.array(work.found[q, r]), pa.array(work.score[q, r])], ["query_id", "id", "score"])

    order = ["shard", "block"]
    tasks = max(spark.sparkContext.defaultParallelism, shard + 1)  # by work, not by bytes
    found = cells.repartition(tasks, *order).sortWithinPartitions(*order).mapInArrow(scan, "query_id long, id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
