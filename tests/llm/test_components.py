import random

import pytest

from kindred.llm.components import connected_components
from kindred.llm.storage import Scratch

from . import brute


def graphs():
    rng = random.Random(4)
    yield "path", [(i, i + 1) for i in range(60)]
    yield "star", [(500, i) for i in range(40)]
    yield "random", [(rng.randrange(80), rng.randrange(80)) for _ in range(60)]


@pytest.mark.parametrize("name,edges", list(graphs()))
def test_least_member(spark, name, edges):
    ids = sorted({x for e in edges for x in e if e[0] != e[1]})
    found = brute.components(len(ids), [(ids.index(a), ids.index(b)) for a, b in edges if a != b])
    df = spark.createDataFrame(edges + edges[:3] + [(7, None), (None, None), (9, 9)], "src long, dst long")
    got = {r.node: r.component for r in connected_components(df, Scratch(spark)).collect()}
    assert got == {i: ids[c] for i, c in zip(ids, found)}


def test_strings_and_nothing(spark):
    df = spark.createDataFrame([("b", "c"), ("c", "a")], "src string, dst string")
    assert {r.node: r.component for r in connected_components(df, Scratch(spark)).collect()} == {"a": "a", "b": "a", "c": "a"}
    assert connected_components(df.limit(0), Scratch(spark)).count() == 0
