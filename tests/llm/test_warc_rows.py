"""Archives of rows with clashing column names, and the query that reads headers alone."""

import duckdb
from pyspark.sql import functions as F

from kindred.llm import warc
from kindred.llm.queries import ORACLE_SQL, warc_headers
from kindred.llm.storage import Scratch

from ..oracle import assert_same


def connect_pages(folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    return con


def test_clashing_columns(spark):
    rows = [(1, "http://a/", "x" * 200), (2, "http://b/", "x" * 200), (2, "http://b/", "x" * 200), (3, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    clash = df.withColumns({c: F.lit("clash") for c in ("payload", "digest", "record_type", "payload_digest", "payload_bytes", "refers_to", "first", "n", "value")})
    found = []
    for pages in (df, clash):
        scratch = Scratch(spark)
        path = scratch.path("archive")
        warc.write_warc(pages, path, scratch)
        found.append(sorted((r.record_id, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to or "", bytes(r.payload or b"")) for r in warc.read_warc(spark, path).collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    assert [r[1] for r in found[1]] == ["response", "revisit", "revisit", "response"]


def test_headers_alone(spark, tmp_path):
    rows = [(1, "https://a/", "x" * 200), (2, "http://b/", "y" * 200), (3, "https://c/", "x" * 200), (4, "https://d/", "x" * 9), (5, None, "x" * 200), (6, "ftp://https://", "x" * 200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((r.page_id, r.record_type, r.payload_bytes, r.refers_to) for r in warc_headers(spark, str(tmp_path)).collect())
    assert got == [(1, "response", 200, None), (3, "revisit", 200, 1), (4, "response", 9, None)]
    assert_same(spark, connect_pages(tmp_path), warc_headers, ORACLE_SQL["warc_headers"], str(tmp_path))
