"""Connected components by repeated local contraction, DataFrame operations only.

Every round each node joins the neighbour (or itself) of smallest random priority, and
edges are rewritten between the chosen nodes. Priorities change by round, so that chains
shrink by a constant factor in expectation. No round gathers a component: the minimum is
combined before the shuffle, and the joins are plain equi-joins that adaptive execution
splits when one node holds many edges.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch

#: Edges for each file of a round; rounds shrink, and so should their number of files.
ROWS_PER_FILE = 200_000


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges(src, dst) of one ordered type -> (node, component), component the least node.

    Null ends and loops are ignored; repeated edges count once. Nodes without an edge are
    not returned. An empty input gives an empty result.
    """
    kind = edges.schema["src"].dataType
    live, path = scratch.put(
        edges.where("src is not null and dst is not null and src <> dst")
        .select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
        .distinct(),
        "edges",
    )
    hops: list[DataFrame] = []
    n = live.count()
    files = most = max(1, math.ceil(2 * n / ROWS_PER_FILE))
    while n:
        files = max(1, math.ceil(2 * n / ROWS_PER_FILE))  # a round makes at most two rows of an edge
        salt = F.lit(len(hops))
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        rank = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("n"))
        best = ends.groupBy("node").agg(F.min(rank("other")).alias("o"))
        hop, _ = scratch.put(best.select("node", F.least(rank("node"), F.col("o"))["n"].alias("head")).coalesce(files), "hop")
        hops.append(hop)
        left = hop.select(F.col("node").alias("a"), F.col("head").alias("ha"))
        right = hop.select(F.col("node").alias("b"), F.col("head").alias("hb"))
        new, new_path = scratch.put(
            live.join(left, "a").join(right, "b").where("ha <> hb").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct().coalesce(files),
            "edges",
        )
        scratch.drop(path)
        live, path, n = new, new_path, new.count()
    if not hops:
        return edges.sparkSession.createDataFrame([], f"node {kind.simpleString()}, component {kind.simpleString()}")
    found = hops[-1].select("node", F.col("head").alias("root"))
    for hop in reversed(hops[:-1]):
        up = found.select(F.col("node").alias("head"), F.col("root").alias("up"))
        found = hop.join(up, "head", "left").select("node", F.coalesce("up", "head").alias("root"))
    found, _ = scratch.put(found.coalesce(most), "roots")
    least = found.groupBy("root").agg(F.min("node").alias("component"))
    return found.join(least, "root").select("node", "component")
