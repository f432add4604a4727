import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.llm import ann, embdedup
from kindred.llm.storage import Scratch

from . import brute

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, "clash") for i, v, l in rows], SCHEMA)


def planted(seed=0):
    """Random vectors of two labels with chains, a dense group and exact copies."""
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    for label in (1, 2):
        for _ in range(60):
            rows.append((i, rng.standard_normal(16), label))
            i += 3
        centre = rng.standard_normal(16)
        for _ in range(40):
            rows.append((i, centre + 0.12 * rng.standard_normal(16), label))
            i += 1
        for _ in range(12):
            rows.append((i, centre * 2, label))
            i += 1
    return [(i, np.float32(v), l) for i, v, l in rows]


def odd():
    v = np.float32(np.arange(1, 17))
    return [(9001, None, 1), (9002, np.zeros(16), 1), (9003, [None, *v[1:]], 1), (9004, [float("nan"), *v[1:]], 1), (9005, [float("inf"), *v[1:]], 1), (9006, v, None), (9007, v, None), (9008, [], 1)]


def expected_links(rows, threshold=0.93):
    ids = sorted(i for i, _, _ in rows)
    by = {i: (v, l) for i, v, l in rows}
    good = [i for i in ids if i < 9000]
    pairs = []
    for a in range(len(good)):
        x, l = np.float64(by[good[a]][0]), by[good[a]][1]
        for b in range(a):
            y, m = np.float64(by[good[b]][0]), by[good[b]][1]
            if l == m and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= threshold:
                pairs.append((a, b))
    label = brute.components(len(good), pairs)
    links = np.bincount(np.array(pairs).ravel(), minlength=len(good))
    out = {g: (int(links[n]), good[c], good[c] == g) for n, (g, c) in enumerate(zip(good, label))}
    return out | {i: (0, i, True) for i in ids if i >= 9000}


@pytest.mark.parametrize("cell", [8192, 64, 7])
def test_near_duplicates(spark, monkeypatch, cell):
    monkeypatch.setattr(embdedup, "CELL", cell)
    rows = planted() + odd()
    got = embdedup.near_duplicates(table(spark, rows), Scratch(spark)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == expected_links(rows) and len(got) == len(rows)


def test_layout_misses_little():
    agree = 1 - np.arccos(0.93) / np.pi
    for rows in (1, 10, 1000, 10**6, 10**9, 10**11):
        bits, tables = embdedup.coarse_layout(rows, 0.93)
        assert (bits == 0 and tables == 1) or (1 - agree**bits) ** tables <= embdedup.COARSE_MISS
        assert rows / 2**bits <= embdedup.CELL
        bits, tables = embdedup.fine_layout(min(rows, 2 * embdedup.CELL), 0.93)
        assert (1 - agree**bits) ** tables <= embdedup.FINE_MISS
    assert embdedup.coarse_layout(10**6, 0.93)[1] <= 20 and embdedup.coarse_layout(10**9, 0.93)[1] <= 70


def test_pairs_meet_once():
    rng = np.random.default_rng(5)
    x = np.concatenate([c + 0.15 * rng.standard_normal((60, 24)) for c in rng.standard_normal((5, 24))])
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = {(a, b) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.93)) if a < b}
    found = [(min(p), max(p)) for a, b in embdedup._pairs(x, None, 0.93, 2) for p in zip(a.tolist(), b.tolist())]
    assert len(found) == len(set(found)) and set(found) == near and len(near) > 1000
    side = rng.random(len(x)) < 0.3
    crossed = [(min(p), max(p)) for a, b in embdedup._pairs(x, side, 0.93, 2) for p in zip(a.tolist(), b.tolist())]
    assert sorted(crossed) == sorted((a, b) for a, b in near if side[a] != side[b])
    label = np.arange(6)
    for a, b in ((4, 5), (2, 3), (3, 4), (0, 1)):
        label = embdedup._forest(label, np.array([a]), np.array([b]))
    assert label.tolist() == [0, 0, 2, 2, 2, 2]


def test_no_rows(spark):
    empty = table(spark, odd()).limit(0)
    assert embdedup.near_duplicates(empty, Scratch(spark)).count() == 0
    assert ann.search(empty, F.col("vec_id") % 20 == 0, Scratch(spark)).count() == 0
    only_odd = table(spark, odd())
    assert ann.search(only_odd.where("vec_id < 9006"), F.col("vec_id") % 20 == 0, Scratch(spark)).count() == 0


def exact(rows, k=20):
    good = [(i, np.float64(v)) for i, v, _ in rows]
    ids, x = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    out = {}
    for i, v in good:
        if i % 20 == 0:
            s = x @ v
            order = [n for n in np.lexsort((ids, -s)) if ids[n] != i][:k]
            out[i] = [(int(ids[n]), float(s[n])) for n in order]
    return out


@pytest.mark.parametrize("shard,queries", [(16_384, 4_096), (50, 3)])
def test_search_finds_most(spark, monkeypatch, shard, queries):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "QUERIES", queries)
    rng = np.random.default_rng(5)
    rows = [(i, np.float32(rng.standard_normal(24) * (1 + (i % 7))), 1) for i in range(900)] + [(1000 + i, np.float32(np.ones(24)), 1) for i in range(30)]
    got = ann.search(table(spark, rows + [r for r in odd() if r[0] < 9006 or r[0] == 9008]), F.col("vec_id") % 20 == 0, Scratch(spark)).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    truth = exact(rows)
    assert set(found) == set(truth)
    score = {(i, j): s for i, best in exact(rows, 2000).items() for j, s in best}
    for i, best in found.items():
        assert len(best) == 20 and best == sorted(best, key=lambda p: (-p[1], p[0]))
        assert all(abs(score[i, j] - s) < 1e-9 for j, s in best)
    hits = sum(len({j for j, _ in found[i]} & {j for j, _ in truth[i]}) for i in truth)
    assert hits >= 0.9 * 20 * len(truth)


def test_few_rows_give_all(spark):
    rows = [(i * 10, np.float32([1, i]), 1) for i in range(6)]
    got = ann.search(table(spark, rows), F.col("vec_id") % 20 == 0, Scratch(spark)).collect()
    assert len(got) == 3 * 5 and all((r.query_id != r.vec_id) for r in got)
    by = exact(rows)
    for i, best in by.items():
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r.rank)] == best
