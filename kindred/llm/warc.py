"""WARC archives: written with Spark's text writer, read by a Python data source.

Records are plain WARC/1.1. A response holds an HTTP header and the payload; a revisit holds
the HTTP header alone and names the record with the same payload. The reader takes a file
for a partition, parses a record's header before anything else, and steps over the block of
a record that the predicates reject or whose payload isn't wanted.

Predicates reach the reader as options of read_warc, or, with pushdown=True, from Catalyst.
The latter is off by default: Spark 4.1 keeps pushed filters with the table, not with the
scan, so a DataFrame that is used twice, with other filters, would lose rows.
"""

from __future__ import annotations

import gzip
import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from .storage import Scratch

CRLF = "\r\n"
RECORD_ID = "urn:page:"
#: Payloads under this many bytes are stored again rather than referred to.
LEAST_REVISIT = 100
RECORDS_PER_FILE = 20_000
BATCH_BYTES = 4_000_000
SCHEMA = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
#: Column of the result -> WARC header that decides a pushed filter.
HEADER_OF = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}


def plan_revisits(pages: DataFrame, *, key: str = "page_id", html: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """(key, digest, refers_to) of the rows whose payload a row with a smaller key has, too."""
    sums = pages.select(F.col(key).alias("key"), _digest(html).alias("digest"), _size(html).alias("n")).where((F.col("n") >= least) & F.col("key").isNotNull())
    firsts = sums.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("last > first").select("digest", "first")
    return sums.join(firsts, "digest").where("key > first").select("key", "digest", F.col("first").alias("refers_to")).distinct()


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html), F.lit(""))


def _digest(html: str) -> Column:
    return F.sha2(_payload(html).cast("binary"), 256)


def _size(html: str) -> Column:
    return F.octet_length(_payload(html)).cast("long")


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line ends in a value are percent-encoded."""
    safe = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(CRLF)), F.lit(""))


def write_warc(pages: DataFrame, path: str, scratch: Scratch, *, key: str = "page_id", url: str = "url", html: str = "html", date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes one record for every row into WARC files below path, on any file system of Spark.

    Null html is an empty payload, a null url has no target header. Of rows with one payload
    of at least 100 bytes that with the least key is the response and the others revisit it;
    rows that share that key are all responses, as are rows with a null key. Only keys and
    digests are shuffled to find them. An empty table leaves an archive without records.
    """
    revisits, _ = scratch.put(plan_revisits(pages, key=key, html=html), "revisits")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), _payload(html).alias("payload"), _digest(html).alias("digest"), _size(html).alias("n"))
    rows = rows.join(revisits, ["key", "digest"], "left")
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(again, "").otherwise(F.col("payload")))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _header("WARC-Type", F.when(again, "revisit").otherwise("response")),
        _header("WARC-Record-ID", F.concat(F.lit(f"<{RECORD_ID}"), F.coalesce(F.col("key").cast("string"), F.lit("")), F.lit(">"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Refers-To", F.concat(F.lit(f"<{RECORD_ID}"), F.col("refers_to").cast("string"), F.lit(">"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
    )
    record = F.concat(head, F.lit(CRLF), block, F.lit(CRLF))
    rows.select(record.alias("value")).write.option("lineSep", CRLF).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


@dataclass
class FilePart(InputPartition):
    """Files that one task reads."""

    files: list[str]

    def __init__(self, files: list[str]):
        super().__init__(files)
        self.files = files


@dataclass
class _Wanted:
    """Header tests that a record must pass."""

    equal: dict[str, set[str]] = field(default_factory=dict)
    begins: dict[str, list[str]] = field(default_factory=dict)
    present: set[str] = field(default_factory=set)

    def admits(self, headers: dict[str, str]) -> bool:
        return (
            all(_plain(n, headers.get(n)) in values for n, values in self.equal.items())
            and all((_plain(n, headers.get(n)) or "").startswith(p) and n in headers for n, ps in self.begins.items() for p in ps)
            and all(n in headers for n in self.present)
        )


def _plain(name: str, value: str | None) -> str | None:
    """A header's value as the columns show it: ids without brackets."""
    if value is not None and name in ("warc-record-id", "warc-refers-to"):
        return value.removeprefix("<").removesuffix(">")
    return value


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.split = int(options.get("filebytes", 32_000_000))
        self.wanted = _Wanted()
        for option, value in options.items():
            kind, _, name = option.lower().partition(".")
            if kind == "equal":
                self.wanted.equal[name] = set(json.loads(value))
            elif kind == "begins":
                self.wanted.begins[name] = [value]

    def partitions(self) -> list[FilePart]:
        """Files in order of name, small ones together; a file is never split."""
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(root, recursive=True))
        parts, size = [], self.split
        for f in sorted((f for f in found if f.is_file and f.size and f.base_name[0] not in "._"), key=lambda f: f.path):
            if size + f.size > self.split:
                parts.append(FilePart([]))
                size = 0
            parts[-1].files.append(f.path)
            size += f.size
        return parts or [FilePart([])]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        rows, size = [], 0
        for path in partition.files:
            with fs.open_input_file(path) as raw:
                for row in self.records(gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw):
                    rows.append(row)
                    size += 500 + len(row[-1] or b"")
                    if size > BATCH_BYTES:
                        yield _batch(rows)
                        rows, size = [], 0
        if rows:
            yield _batch(rows)

    def records(self, stream) -> Iterator[tuple]:
        """Rows of the wanted records of one file; other blocks are stepped over."""
        lines = _Lines(stream)
        while (first := lines.line()) is not None:
            if not first:
                continue
            if not first.startswith(b"WARC/"):
                raise ValueError(f"no WARC record where one should begin: {first[:40]!r}")
            headers = _headers(lines)
            length = int(headers["content-length"])
            if not self.wanted.admits(headers):
                lines.skip(length)
                continue
            http, size, payload = "http" in headers.get("content-type", ""), length, None
            if http:
                before = lines.read_so_far
                lines.line()
                inner = _headers(lines)
                rest = length - (lines.read_so_far - before)
                size = int(inner["content-length"]) if headers.get("warc-type") == "revisit" and "content-length" in inner else rest
            else:
                rest = length
            if self.payload and headers.get("warc-type") != "revisit":
                payload = lines.take(rest)
            else:
                lines.skip(rest)
            named = {c: _plain(n, headers.get(n)) for c, n in HEADER_OF.items()}
            yield named["record_id"], named["record_type"], named["target_uri"], named["refers_to"], named["payload_digest"], size, headers, payload


class PushingWarcReader(WarcReader):
    """Takes filters from Catalyst, too."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = HEADER_OF.get(f.attribute[0]) if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted.equal[name] = self.wanted.equal.get(name, values) & values
            elif name and isinstance(f, StringStartsWith):
                self.wanted.begins.setdefault(name, []).append(f.value)
            elif name and isinstance(f, IsNotNull):
                self.wanted.present.add(name)
            else:
                yield f


class _Lines:
    """Buffered bytes of a file: lines, blocks, and steps over what isn't wanted."""

    def __init__(self, stream, size: int = 1 << 18):
        self.stream, self.size, self.held, self.at, self.read_so_far = stream, size, b"", 0, 0

    def _more(self) -> bool:
        new = self.stream.read(self.size)
        self.held, self.at = self.held[self.at :] + new, 0
        return bool(new)

    def line(self) -> bytes | None:
        begin = self.at
        while (end := self.held.find(b"\n", begin)) < 0:
            begin = len(self.held) - self.at
            if not self._more():
                if self.at == len(self.held):
                    return None
                end = len(self.held)
                break
        out = self.held[self.at : end]
        self.read_so_far += end + 1 - self.at
        self.at = min(end + 1, len(self.held))
        return out.removesuffix(b"\r")

    def take(self, n: int) -> bytes:
        parts, self.read_so_far = [], self.read_so_far + n
        while True:
            part = self.held[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
            if not n:
                return b"".join(parts)
            if not self._more():
                raise ValueError("a WARC record ends early")

    def skip(self, n: int) -> None:
        self.read_so_far += n
        there = min(n, len(self.held) - self.at)
        self.at += there
        n -= there
        if n:
            if not isinstance(self.stream, gzip.GzipFile) and self.stream.seekable():
                self.stream.seek(n, 1)
            else:
                while n:
                    got = len(self.stream.read(min(n, self.size)))
                    if not got:
                        raise ValueError("a WARC record ends early")
                    n -= got


def _headers(lines: _Lines) -> dict[str, str]:
    out: dict[str, str] = {}
    last = None
    while line := lines.line():
        if line[:1] in b" \t" and last:  # a folded line goes on
            out[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
    columns = list(zip(*rows))
    columns[6] = [list(h.items()) for h in columns[6]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in SCHEMA.split(", ")])


class WarcDataSource(DataSource):
    """spark.read.format("warc"). Options: path; payload=false reads headers only; filebytes: bytes of files for a task; see read_warc for the rest."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        pushing = self.options.get("pushdown", "false").lower() == "true"
        return PushingWarcReader(self.options) if pushing else WarcReader(self.options)


def read_warc(spark: SparkSession, path: str, *, payload: bool = True, types: list[str] | None = None, equal: dict[str, list[str]] | None = None, begins: dict[str, str] | None = None, pushdown: bool = False) -> DataFrame:
    """Records below path that the header predicates admit.

    types: record types; equal: header name -> values it may have; begins: header name ->
    how it begins (names in lower case, ids without brackets). payload=False reads headers
    only. pushdown lets Catalyst push filters on type, ids, digest and target as well; use
    such a DataFrame once.
    """
    spark.dataSource.register(WarcDataSource)
    reader = spark.read.format("warc").option("payload", str(payload).lower()).option("pushdown", str(pushdown).lower())
    for name, values in (({"warc-type": types} if types else {}) | (equal or {})).items():
        reader = reader.option(f"equal.{name}", json.dumps(list(values)))
    for name, value in (begins or {}).items():
        reader = reader.option(f"begins.{name}", value)
    if pushdown:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return reader.load(path)


def page_of(record: Column) -> Column:
    """The key in a record id that write_warc made; null for others."""
    return F.when(record.startswith(RECORD_ID), F.substring(record, len(RECORD_ID) + 1, 40).try_cast("long"))
