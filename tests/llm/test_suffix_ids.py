import pytest

from kindred.llm import suffix
from kindred.llm.storage import Scratch

A = "a passage that two documents hold, of more than fifty bytes in all"
B = "quite another text beside it, also of more than fifty bytes, seen later"


@pytest.mark.parametrize("chunk", [100, 10**6])
def test_one_id_with_two_texts(spark, chunk):
    rows = [(1, A, "a"), (5, A, "b"), (5, B, "c"), (9, B, "d"), (-3, "short", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string")
    got = suffix.repeated_spans(df, Scratch(spark), carry=["row"], chunk_bytes=chunk).collect()
    assert {r.rest.row: sum(s.end - s.begin for s in r.spans) for r in got} == {"a": 0, "b": len(A), "c": 0, "d": len(B), "e": 0}
    kept = suffix.without_repeats(df, Scratch(spark), chunk_bytes=chunk).collect()
    assert {r.row for r in kept} == {"a", "c", "e"}
