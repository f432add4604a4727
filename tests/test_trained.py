"""Pair features in Java against those in Spark and Python, and the fit over packed rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import text as T
from kindred.operators import blocking, features, matching, newton
from kindred.plans import catalog

ODD = [("", ""), ("a", "1"), ("b", "1 b"), ("\U0001f600 \U00010400bcde xyzzy", "12 \U0001f600 street street"), ("ａ ltd", "7 rue de é"), ("The and Co", "9 long long road x"), ("aa aa bb", "9 road long"), ("alpha beta", None), ("aaaa" * 40, "1 " + "ab " * 90)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(f"S{1 + k % 3}", f"S{1 + k % 3}-{k}-{c}", k, name, address, c) for k in range(6) for name, address in [ODD[k]] for c in ("", "en")]
    rows += [(s, f"{s}-{k}-x", k + 90, name, address, "fr") for s in ("S1", "S2") for k, (name, address) in enumerate(ODD)]
    return T.normalize_records(spark.createDataFrame(rows, "source string, entity_id string, ord long, business_name string, business_address string, country string"))


def assert_packed(joined):
    got = features.packed(joined, blocking.PAIR).collect()
    expected = {(r.ref_id, r.cand_id): [r[n] for n in features.FEATURE_NAMES] for r in features.vectors(joined, blocking.PAIR).collect()}
    assert got and {(r.ref_id, r.cand_id): np.frombuffer(bytes(r.x), "<f8").tolist() for r in got} == expected and len(got) == len(expected)


def test_packed_features(spark, sf, odd):
    left, right = (odd.where(c).select(F.col("source").alias(f"{p}_source"), F.col("entity_id").alias(f"{p}_id")) for c, p in (("source = 'S1'", "ref"), ("source <> 'S1'", "cand")))
    assert_packed(features.with_records(left.crossJoin(right), odd))
    assert_packed(features.candidates_with_records(catalog._records(spark, sf), arms=True))


def test_fit_reaches_its_optimum(spark, monkeypatch):
    monkeypatch.setattr(newton, "ROWS", 100)
    monkeypatch.setattr(newton, "START", 20)
    draw = np.random.default_rng(5)
    a = np.column_stack([draw.random((3000, 2)), np.ones(3000)])
    t = (a[:, 0] + a[:, 1] > 1.2).astype(int)
    df = spark.createDataFrame([(*map(float, x[:2]), int(y)) for x, y in zip(a, t)], "x double, y double, label int").repartition(5)
    m = matching.LogisticMatcher(max_iter=100, features=("x", "y")).fit(df)
    v = np.array([*m.model.coefficients, m.model.intercept])
    slope = a.T @ (1 / (1 + np.exp(-a @ v)) - t) + np.array([v[0], v[1], 0])
    assert m.summary.converged and m.summary.n_samples == 3000 and np.abs(slope).max() < 1e-6


def test_arms_as_by_columns(spark, sf):
    rows = catalog._trained(spark, sf)
    got = [tuple(r) for r in matching.run_arms(rows, label=catalog._alike).collect()]
    r = catalog._records(spark, sf)
    sides = matching.split_by_reference(catalog._refs(r))
    plain = features.vectors(features.candidates_with_records(r, arms=True, references=sides), ["is_prod", "is_validation"])
    plain = plain.withColumn("label", ((F.col("address_char_ratio") + F.col("name_char_ratio")) > 1.2).cast("int")).cache()
    assert got == [tuple(r) for r in matching.run_arms(plain).collect()]
    for arm, part in zip(got, (plain.where("is_prod"), plain)):
        m = matching.LogisticMatcher().fit(part.where("not is_validation"))
        best = matching.best_threshold(m.report(part.where("is_validation"))).first()
        assert arm[1:3] == (m.summary.n_samples, True) and arm[3:] == tuple(best)


def test_coefficients_are_those_of_the_optimum(spark, sf):
    found = {r.feature: r.weight for r in catalog.QUERIES["logistic_coefficients"](spark, sf).collect()}
    rows = features.vectors(features.candidates_with_records(catalog._records(spark, sf), arms=True), []).toPandas()[list(features.FEATURE_NAMES)].to_numpy()
    t, a, v = catalog._alike(rows).astype(float), np.column_stack([rows, np.ones(len(rows))]), np.zeros(25)
    own = np.append(np.ones(24), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ v))
        v -= np.linalg.lstsq(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(own), a.T @ (p - t) + own * v, rcond=1e-15)[0]
    expected = dict(zip(features.FEATURE_NAMES, v))
    assert len(found) == 8 and all(abs(w - expected[n]) < 1e-7 for n, w in found.items())
