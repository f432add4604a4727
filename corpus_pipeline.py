"""From raw documents to packed sequences: language, near copies, repeated passages, packing.

Each stage takes all that the one before kept and returns documents (the last one pieces);
run() writes what a stage returns as Parquet and hands the reread table on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import langid, nearcopies, packing, suffix
from kindred.llm.queries import table, word_bpe
from kindred.llm.storage import Scratch


#: Documents that a Python worker holds at once; workers of several stages share an executor.
ROWS_PER_BATCH = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _small_batches(spark: SparkSession) -> None:
    """Holds while what a stage returns is written, so a stage leaves it set; run() doesn't."""
    spark.conf.set(_BATCH, ROWS_PER_BATCH)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Drops documents in none of the labelled languages and writes the language found into lang.

    Profiles and the least score are fitted on the labelled documents at hand. What goes: no
    text, no letter in it, or a rank order of n-grams that fits no profile.
    """
    _small_batches(spark)
    profiles = langid.learn(docs)
    return langid.keep_known(docs, profiles, least=langid.least_score(docs, profiles))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Keeps the document of smallest doc_id of each group of near copies.

    Near copies share 0.8 or more of their 5-word shingles, counted exactly. Candidates are
    those that SimHash links, and those that share a band of MinHash values.
    """
    _small_batches(spark)
    return nearcopies.first_of_each(docs, scratch or Scratch(spark))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Cuts every byte of a 50-byte string that starts in an earlier document, too."""
    _small_batches(spark)
    return suffix.without_repeats(docs, scratch or Scratch(spark))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Pieces of token sequences of at most 2048 tokens, without padding."""
    _small_batches(spark)
    return packing.pack(docs, word_bpe())


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("packing", packed),
]

#: SQL can express none of the four stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, reread from its table; tables that nothing reads any more are dropped."""
    before = spark.conf.get(_BATCH)
    stages, docs, last = Scratch(spark), table(spark, sf_dir, "documents"), None
    try:
        for name, stage in STAGES:
            own = Scratch(spark)
            docs, path = stages.put(stage(spark, docs, sf_dir, own), name.replace(" ", "-"))
            own.clear()
            if last:
                stages.drop(last)
            last = path
    finally:
        spark.conf.set(_BATCH, before)
    return docs
