"""Where results go: partitioned Parquet, the two result files, reports, run manifests."""

from __future__ import annotations

import hashlib
import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.blocking import PAIR


def write_candidates(pairs: DataFrame, path: str) -> None:
    """Pairs by candidate source, sorted by candidate and reference within each file."""
    pairs.sortWithinPartitions("cand_source", "cand_id", "ref_id").write.mode("overwrite").partitionBy("cand_source").parquet(path)


def matching_results(references: DataFrame, matches: DataFrame) -> DataFrame:
    """(ref_id, matched): every reference once, its matches comma-joined in order, '' without any."""
    lists = matches.select("ref_id", "cand_id").distinct().groupBy("ref_id").agg(F.array_join(F.sort_array(F.collect_list("cand_id")), ",").alias("matched"))
    return references.select("ref_id").distinct().join(lists, "ref_id", "left").select("ref_id", F.coalesce("matched", F.lit("")).alias("matched"))


def write_matching_results(references: DataFrame, matches: DataFrame, path: str) -> None:
    """A line for each reference: id, tab, matches."""
    rows = matching_results(references, matches)
    rows.orderBy("ref_id").select(F.concat_ws("\t", "ref_id", "matched").alias("value")).write.mode("overwrite").text(path)


def write_candidate_pairs(pairs: DataFrame, matches: DataFrame, path: str) -> None:
    """Pairs that went to the matcher, tab-separated; a match that is no candidate is an error."""
    if not matches.join(pairs, PAIR, "left_anti").isEmpty():
        raise ValueError("a match is not among the candidate pairs")
    pairs.select("ref_id", "cand_id").distinct().orderBy("ref_id", "cand_id").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def fingerprint(config: dict) -> str:
    """Short digest of a run's settings."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


def table_digest(df: DataFrame) -> dict[str, str]:
    """Columns, number of rows and sum of row hashes: the same for the same rows in any order."""
    row = F.xxhash64(*df.columns).cast("decimal(38,0)")
    found = df.agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("sum")).first()
    return {"columns": df.schema.simpleString(), "rows": str(found["rows"]), "sum": found["sum"]}


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on any of Spark's file systems: written beside its place, then renamed over it.

    Where a file system has no rename that replaces, the old file is deleted just before.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, temporary = hadoop.Path(path), hadoop.Path(path + ".tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
        options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
        hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, target, options)
    except Py4JJavaError as e:
        if "UnsupportedFileSystem" not in e.java_exception.toString():
            raise
        fs.delete(target, False)
        if not fs.rename(temporary, target):
            raise OSError(f"{path} can't be put in place") from e


def read_text(spark: SparkSession, path: str) -> str | None:
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_report(spark: SparkSession, report: DataFrame, path: str) -> str:
    """(measure, value) rows, a few dozen, as path.json for programs and path.txt for readers; returns the text."""
    rows = {r["measure"]: r["value"] for r in report.select("measure", "value").collect()}
    width = max(map(len, rows), default=0)
    text = "".join(f"{m:<{width}}  {v:,.6g}\n" if v is not None else f"{m:<{width}}  -\n" for m, v in rows.items())
    write_text(spark, path + ".json", json.dumps(rows, indent=1, sort_keys=True))
    write_text(spark, path + ".txt", text)
    return text


class Stages:
    """Stage outputs as Parquet with a manifest; a stage of other settings or rows is made anew."""

    def __init__(self, spark: SparkSession, folder: str, config: dict, force: bool = False):
        self.spark, self.folder, self.config, self.force = spark, folder.rstrip("/"), config, force
        self.mark = fingerprint(config)

    def run(self, name: str, make) -> DataFrame:
        """Reads stage name if its manifest fits, else runs make() and writes both."""
        path, manifest = f"{self.folder}/{name}", f"{self.folder}/{name}.json"
        known = None if self.force else read_text(self.spark, manifest)
        if known:
            said = json.loads(known)
            if said["fingerprint"] == self.mark:
                df = self.spark.read.parquet(path)
                if df.count() == said["rows"]:
                    return df
        make().write.mode("overwrite").parquet(path)
        df = self.spark.read.parquet(path)
        write_text(self.spark, manifest, json.dumps({"fingerprint": self.mark, "config": self.config, "rows": df.count()}, sort_keys=True, default=str))
        return df
