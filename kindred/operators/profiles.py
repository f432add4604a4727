"""What sources, truth and candidate volumes look like."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import truth_edges


def source_profile(records: DataFrame) -> DataFrame:
    """Per source of raw records: rows, empty names and addresses with their share in percent, mean name length."""
    empty = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.count_if(empty(c)), F.count(F.lit(1)).cast("double")), F.lit(0.0))
    return records.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(empty("business_name")).alias("empty_names"),
        share("business_name").alias("empty_names_pct"),
        F.count_if(empty("business_address")).alias("empty_addresses"),
        share("business_address").alias("empty_addresses_pct"),
        F.avg(F.length(F.coalesce("business_name", F.lit("")))).alias("mean_name_length"),
    )


def top_countries(records: DataFrame, k: int = 10) -> DataFrame:
    return records.groupBy("country").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "country").limit(k)


def truth_profile(truth: DataFrame) -> DataFrame:
    """One row: references, singletons, pairs in all and by source, mean matches."""
    n = F.size("matched_ids")
    of = lambda s: F.coalesce(F.sum(F.size(F.filter("matched_ids", lambda i: i.startswith(s + "-")))), F.lit(0)).cast("long")
    return truth.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(n == 0).alias("singletons"),
        F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("total_pairs"),
        of("S2").alias("s2_pairs"),
        of("S3").alias("s3_pairs"),
        F.coalesce(F.avg(n), F.lit(0.0)).alias("mean_matches"),
    )


def multiplicity(truth: DataFrame) -> DataFrame:
    """How many references have k matches; 10 stands for ten or more."""
    return truth.groupBy(F.least(F.size("matched_ids"), F.lit(10)).alias("k")).agg(F.count(F.lit(1)).alias("n"))


def volume(references: DataFrame, pairs: DataFrame) -> DataFrame:
    """Candidates per reference(ref_id): total, mean, largest, upper median, references without any."""
    counts = references.select("ref_id").distinct().join(pairs.groupBy("ref_id").agg(F.count(F.lit(1)).alias("n")), "ref_id", "left").select(F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    # The upper median from a histogram, so no task holds all counts.
    sums = counts.agg(F.count(F.lit(1)).alias("n_references"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), F.coalesce(F.max("n"), F.lit(0)).cast("long").alias("largest"), F.count_if(F.col("n") == 0).alias("without"))
    groups = counts.groupBy("n").agg(F.count(F.lit(1)).alias("c")).agg(F.sort_array(F.collect_list(F.struct("n", "c"))).alias("h"))
    middle = F.expr("""aggregate(h, named_struct('seen', 0L, 'at', cast(null as bigint)),
        (s, x) -> named_struct('seen', s.seen + x.c, 'at', if(s.at is null and s.seen + x.c > n_references div 2, x.n, s.at)), s -> s.at)""")
    return sums.crossJoin(groups).select("n_references", "total", "mean", "largest", "without", F.coalesce(middle, F.lit(0)).cast("long").alias("upper_median"))


def recall(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: true pairs, how many of them are candidates, their share."""
    found = edges.select("ref_id", "cand_id").distinct().join(pairs.select("ref_id", "cand_id").distinct().withColumn("f", F.lit(1)), ["ref_id", "cand_id"], "left")
    share = F.coalesce(F.try_divide(F.count("f").cast("double"), F.count(F.lit(1)).cast("double")), F.lit(0.0))
    return found.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("f").alias("found_pairs"), share.alias("recall"))


def resolution(arms: DataFrame, edges: DataFrame) -> DataFrame:
    """True pairs by how they are reached: production, A2 alone, neither; the counts sum to all."""
    route = F.when(F.col("p").isNull(), "neither").when(F.col("p"), "production").otherwise("a2_only")
    best = arms.groupBy("ref_id", "cand_id").agg(F.max("is_prod").alias("p"))
    return edges.select("ref_id", "cand_id").distinct().join(best, ["ref_id", "cand_id"], "left").groupBy(route.alias("route")).agg(F.count(F.lit(1)).alias("n"))


def a2_yield(arms: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: pairs A2 adds, true ones among them, true per 10,000 added, added per true one."""
    known = edges.select("ref_id", "cand_id").distinct().withColumn("t", F.lit(1))
    added = arms.where("not is_prod").join(known, ["ref_id", "cand_id"], "left")
    n, t = F.count(F.lit(1)), F.count("t")
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return added.agg(n.alias("added"), t.alias("added_true"), ratio(10_000 * t, n).alias("true_per_10k"), ratio(n, t).alias("added_per_true"))


def extrapolated(counts: DataFrame, references: int, full: int = 2_206_821) -> DataFrame:
    """Every numeric column of a one-row report, scaled from references to full."""
    return counts.select(*((F.col(f.name) * (full / references)).alias(f.name) for f in counts.schema))


__all__ = ["a2_yield", "extrapolated", "multiplicity", "recall", "resolution", "source_profile", "top_countries", "truth_edges", "truth_profile", "volume"]
