"""Tab-separated sources and ground truth, and entity views over other tables."""

from __future__ import annotations

import os
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip

COLUMNS = ("entity_id", "business_name", "business_address", "country")
TRUTH_COLUMNS = ("source1_entity_id", "matched_entity_ids")
FILES = ("train_source1.tsv", "train_source2.tsv", "train_source3.tsv", "train_ground_truth.tsv")


def train_path(folder: str, name: str) -> str:
    """Path of a training file; refuses test files and names that lead out of the folder."""
    if "test" in name.lower():
        raise ValueError(f"{name} is a test file")
    root = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(root, name))
    if os.path.commonpath([root, path]) != root or path == root:
        raise ValueError(f"{name} lies outside of {folder}")
    return path


def find_train_dir(root: str) -> str:
    """First folder at or below root that holds all training files."""
    for folder, _, names in sorted(os.walk(root)):
        if set(FILES) <= set(names):
            return folder
    raise FileNotFoundError(f"no folder below {root} holds {', '.join(FILES)}")


def find_dataset_zip(roots: list[str], variable: str = "DATASET_ZIP") -> str:
    """Archive named by an environment variable, else the first one below the roots."""
    named = os.environ.get(variable)
    if named:
        if not os.path.isfile(named):
            raise FileNotFoundError(named)
        return named
    for root in roots:
        for folder, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.lower().endswith(".zip"):
                    return os.path.join(folder, name)
    raise FileNotFoundError(f"no archive below {', '.join(roots)}")


def safe_extract(archive: str, target: str) -> list[str]:
    """Unpacks an archive; refuses members that would land outside of target."""
    root = Path(target).resolve()
    with zipfile.ZipFile(archive) as z:
        for name in z.namelist():
            if root not in [p := (root / name).resolve(), *p.parents]:
                raise ValueError(f"{name} leads out of {target}")
        z.extractall(root)
        return z.namelist()


def _read_tsv(spark: SparkSession, path: str, wanted: tuple[str, ...], line_breaks: bool = True) -> DataFrame | None:
    """Columns by name, in any order; '' for what a short row or an empty field leaves out.

    Quotes and line ends inside quotes are as in CSV, so a file is one task. Without
    line_breaks no field may hold a line end, and a large file is split over tasks.
    """
    header = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    if not header:
        return None
    names = [h.strip().strip('"').lstrip("﻿") for h in header[0][0].rstrip("\r").split("\t")]
    if missing := [c for c in wanted if c not in names]:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    unique = [n if names.index(n) == i and n else f"_extra{i}" for i, n in enumerate(names)]
    schema = ", ".join(f"`{n}` string" for n in unique)
    rows = spark.read.options(sep="\t", header=True, quote='"', escape='"', multiLine=line_breaks, encoding="UTF-8", mode="PERMISSIVE", enforceSchema=True, nullValue="\u0000").schema(schema).csv(path)
    last = F.regexp_replace(F.coalesce(F.col(unique[-1]), F.lit("")), "\r$", "")
    return rows.select(*((last if c == unique[-1] else F.coalesce(F.col(c), F.lit(""))).alias(c) for c in wanted))


def read_source_tsv(spark: SparkSession, path: str, source: str, *, line_breaks: bool = True) -> DataFrame:
    """(source, entity_id, business_name, business_address, country, ord), ord the order in the file.

    Rows whose stripped id is blank are dropped; an empty file gives no rows; a missing
    column is a ValueError. line_breaks=False splits a large file, if no field holds a line end.
    """
    rows = _read_tsv(spark, path, COLUMNS, line_breaks)
    if rows is None:
        return spark.createDataFrame([], "source string, entity_id string, business_name string, business_address string, country string, ord long")
    return rows.select(F.lit(source).alias("source"), strip(F.col("entity_id")).alias("entity_id"), "business_name", "business_address", "country", F.monotonically_increasing_id().alias("ord")).where("entity_id <> ''")


def last_of_each(records: DataFrame) -> DataFrame:
    """One row for each (source, entity_id), the last to arrive."""
    arrival = Window.partitionBy("source", "entity_id").orderBy(F.desc("ord"))
    return records.withColumn("_n", F.row_number().over(arrival)).where("_n = 1").drop("_n")


def id_list(c: Column) -> Column:
    """Comma-separated ids as an array: stripped, none empty, none twice."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != ""))


def truth_of(rows: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids[, ord]) -> (source1_entity_id, matched_ids); the last row of an id counts."""
    rows = rows if "ord" in rows.columns else rows.withColumn("ord", F.monotonically_increasing_id())
    rows = rows.select(strip(F.col("source1_entity_id")).alias("source1_entity_id"), id_list(F.col("matched_entity_ids")).alias("matched_ids"), "ord").where("source1_entity_id <> ''")
    arrival = Window.partitionBy("source1_entity_id").orderBy(F.desc("ord"))
    return rows.withColumn("_n", F.row_number().over(arrival)).where("_n = 1").select("source1_entity_id", "matched_ids")


def read_truth_tsv(spark: SparkSession, path: str, wanted: DataFrame | None = None) -> DataFrame:
    """Ground truth; with wanted(source1_entity_id) only of those ids."""
    rows = _read_tsv(spark, path, TRUTH_COLUMNS)
    if rows is None:
        return spark.createDataFrame([], "source1_entity_id string, matched_ids array<string>")
    truth = truth_of(rows)
    return truth if wanted is None else truth.join(wanted.select("source1_entity_id").distinct(), "source1_entity_id", "left_semi")


def documents_as_entities(documents: DataFrame) -> DataFrame:
    """Entity view over documents: three sources by doc_id, name and address from the text."""
    source = F.concat(F.lit("S"), (1 + F.col("doc_id") % 3).cast("string"))
    return documents.select(
        source.alias("source"),
        F.concat(source, F.lit("-"), F.col("doc_id").cast("string")).alias("entity_id"),
        F.substring("text", 1, 40).alias("business_name"),
        F.concat((F.length("text") % 97).cast("string"), F.lit(" "), F.substring("text", 41, 60)).alias("business_address"),
        F.col("lang").alias("country"),
        F.col("doc_id").alias("ord"),
    )


def documents_truth(documents: DataFrame) -> DataFrame:
    """Truth for that view: S1 rows and the S2 and S3 rows that begin with the same 200 characters."""
    start = documents.select(F.col("doc_id"), (1 + F.col("doc_id") % 3).alias("s"), F.substring("text", 1, 200).alias("start"))
    name = F.concat(F.lit("S"), F.col("s").cast("string"), F.lit("-"), F.col("doc_id").cast("string"))
    left = start.where("s = 1").select(name.alias("source1_entity_id"), "start")
    right = start.where("s <> 1").select(name.alias("cand"), "start")
    found = left.join(right, "start", "left").groupBy("source1_entity_id").agg(F.sort_array(F.collect_set("cand")).alias("matched_ids"))
    return found.select("source1_entity_id", "matched_ids")


def parts_as_entities(part: DataFrame) -> DataFrame:
    """Entity view over part: few names under many brands, which fills keys up to the cap."""
    source = F.concat(F.lit("S"), (1 + F.col("p_partkey") % 3).cast("string"))
    return part.select(
        source.alias("source"),
        F.concat(source, F.lit("-"), F.col("p_partkey").cast("string")).alias("entity_id"),
        F.col("p_name").alias("business_name"),
        F.concat((F.col("p_size")).cast("string"), F.lit(" "), F.col("p_type")).alias("business_address"),
        F.col("p_brand").alias("country"),
        F.col("p_partkey").alias("ord"),
    )
