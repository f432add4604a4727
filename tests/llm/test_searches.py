"""Nearest neighbours: recall on the embeddings table, ties across lists."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kindred.llm import ann
from kindred.llm.queries import op3_nearest_neighbours
from kindred.llm.storage import Scratch


def best_of(ids, x, k=20):
    """query id -> its k best ids, ties to the smaller."""
    out = {}
    for n in np.flatnonzero(ids % 20 == 0):
        scores = x @ x[n]
        scores[n] = -np.inf
        out[int(ids[n])] = ids[np.lexsort((ids, -scores))[: min(k, len(ids) - 1)]].tolist()
    return out


@pytest.mark.parametrize("sample", [20_000, 300])
def test_recall_on_the_embeddings_table(spark, monkeypatch, sample):
    """The smaller sample is a seventh of the rows: lists and probes are fitted on few of those that are searched."""
    monkeypatch.setattr(ann, "SAMPLE", sample)
    folder = "/root/testdata/sf0.1"
    rows = pd.read_parquet(f"{folder}/embeddings.parquet")
    usable = [v is not None and len(v) > 0 and bool(np.isfinite(np.asarray(v, float)).all()) and bool(np.any(v)) for v in rows["embedding"]]
    rows = rows[usable]
    truth = best_of(rows["vec_id"].to_numpy(), np.stack(rows["embedding"].to_numpy()).astype(np.float64))
    got = op3_nearest_neighbours(spark, folder).toPandas()
    assert (got.groupby("query_id").size() == 20).all() and set(got["query_id"]) == set(truth)
    found = got.groupby("query_id")["vec_id"].agg(set)
    recall = sum(len(found[i] & set(best)) for i, best in truth.items()) / sum(map(len, truth.values()))
    assert len(rows) > 1500 and recall >= 0.9


def test_ties_at_the_last_rank(spark, monkeypatch):
    """Thirty directions with one score: the twenty smallest ids, whatever list, shard or block holds them."""
    monkeypatch.setattr(ann, "COVER", 1.0)
    monkeypatch.setattr(ann, "SIGMA", 50.0)
    monkeypatch.setattr(ann, "SHARD", 8)
    monkeypatch.setattr(ann, "QUERIES", 1)
    axes = np.eye(16, dtype=np.float32)
    rows = [(0, axes[0]), (20, axes[0])]
    for j in range(1, 16):
        rows += [(2 * j + 1, 0.5 * axes[0] + axes[j]), (101 - 2 * j, 0.5 * axes[0] - axes[j])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<float>").repartition(5)
    truth = best_of(np.array([i for i, _ in rows]), np.stack([v for _, v in rows]).astype(float))
    got = ann.search(df, F.col("vec_id") % 20 == 0, Scratch(spark)).collect()
    for i, best in truth.items():
        assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == i] == best
