import gzip
import hashlib
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan

from kindred.llm import warc
from kindred.llm.queries import op8_warc
from kindred.llm.storage import Scratch

LONG = "x" * 120 + "\nWARC/1.1\r\n\r\nzzé"
ROWS = [(1, "http://a/\n?x", LONG), (2, None, LONG), (3, "http://b/", None), (4, "http://b/", ""), (5, "u", LONG), (6, "u", "short"), (7, "u", "short"), (None, "n", LONG), (0, "z", LONG + "q"), (1, "again", LONG)]


@pytest.fixture(scope="module")
def archive(spark):
    scratch = Scratch(spark)
    path = scratch.path("archive")
    warc.write_warc(spark.createDataFrame(ROWS, "page_id long, url string, html string"), path, scratch)
    return path


def test_round_trip(spark, archive):
    got = warc.read_warc(spark, archive).collect()
    assert len(got) == len(ROWS)
    for r in got:
        data = {i: (h or "").encode() for i, _, h in ROWS}[int(r.record_id[9:]) if r.record_id[9:] else None]
        assert r.payload_bytes == len(data) and r.payload_digest == "sha256:" + hashlib.sha256(data).hexdigest()
        assert r.payload == (None if r.record_type == "revisit" else data)
    assert {(r.record_id, r.refers_to) for r in got if r.record_type == "revisit"} == {("urn:page:2", "urn:page:1"), ("urn:page:5", "urn:page:1")}
    assert {r.target_uri for r in got if r.record_id == "urn:page:1"} == {"http://a/%0A?x", "again"}


def test_filters_and_headers_only(spark, archive):
    df = warc.read_warc(spark, archive)
    assert df.where("record_type = 'revisit'").count() == 2
    assert df.where(F.col("target_uri").startswith("http://b")).count() == 2
    assert df.where("record_type in ('response', 'revisit') and payload_bytes > 100").count() == 6
    assert df.where("refers_to is not null and target_uri = 'u'").count() == 1
    only = warc.read_warc(spark, archive, payload=False)
    assert only.where("payload is not null").count() == 0 and only.agg(F.sum("payload_bytes")).first()[0] == df.agg(F.sum("payload_bytes")).first()[0]
    assert df.where("record_type = 'revisit'").union(df.where("record_type = 'response'")).count() == len(ROWS)


def test_predicates_in_the_reader(spark, archive):
    read = lambda **options: warc.read_warc(spark, archive, **options)
    assert read(types=["revisit"]).count() == 2
    assert read(types=["revisit"], equal={"warc-target-uri": ["u", "z"]}).count() == 1
    assert read(begins={"warc-target-uri": "http://b"}).count() == 2
    assert read(equal={"warc-record-id": ["urn:page:0"]}).count() == 1
    assert read(pushdown=True).where("record_type = 'revisit' and payload_bytes > 100").count() == 2
    assert read(pushdown=True).where("refers_to is not null and target_uri = 'u'").count() == 1


def test_pushed_filters_skip_blocks():
    reader = warc.PushingWarcReader({"path": "/nowhere"})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "response"), GreaterThan(("payload_bytes",), 3)]))
    assert [type(f) for f in rest] == [GreaterThan]
    record = lambda kind, body: f"WARC/1.0\r\nWARC-Type: {kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    data = record("warcinfo", b"y" * 10) + record("response", b"abc") + record("metadata", b"WARC/1.0\r\n") + record("response", b"")
    assert [r[-1] for r in reader.records(io.BytesIO(data))] == [b"abc", b""]
    members = gzip.compress(data[: len(data) // 2]) + gzip.compress(data[len(data) // 2 :])
    assert [r[-1] for r in reader.records(gzip.GzipFile(fileobj=io.BytesIO(members)))] == [b"abc", b""]
    with pytest.raises(ValueError):
        list(reader.records(io.BytesIO(b"no record\r\n")))


def test_small_buffers():
    record = b"WARC/1.0\r\nWARC-Type: response\r\nX-Folded: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 3))

    rows = list(warc.WarcReader({"path": "/nowhere"}).records(Slow(record * 3)))
    assert [r[-1] for r in rows] == [b"hello"] * 3 and rows[0][6]["x-folded"] == "a b"


def test_no_rows(spark):
    scratch = Scratch(spark)
    path = scratch.path("empty")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path, scratch)
    assert warc.read_warc(spark, path).count() == 0


def test_query(spark, sf):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = op8_warc(spark, sf).collect()
    assert {(r.page_id, r.payload_bytes, r.payload_digest) for r in got} == {(i, len(h), hashlib.sha256(h).hexdigest()) for i, h in pages.items()}
