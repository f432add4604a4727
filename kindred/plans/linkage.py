"""End to end: records and truth to features, two fitted arms, matches and reports."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import DEFAULT, BlockingConfig
from ..functions.text import normalize_records
from ..operators import blocking, features, matching, profiles
from ..sources.sinks import Stages, table_digest

STAGES = ("dataset", "candidates", "features", "model", "report")


def labelled_features(records: DataFrame, edges: DataFrame, config: BlockingConfig = DEFAULT, *, salt: str = "exp20k-split-v1") -> DataFrame:
    """Both arms' pairs with label, side of the split, is_prod and the 24 features, computed once."""
    sides = matching.split_by_reference(records.where("source = 'S1'").select(F.col("entity_id").alias("ref_id")), salt=salt)
    sides = sides.join(edges.groupBy("ref_id").agg(F.collect_set("cand_id").alias("true_ids")), "ref_id", "left")
    rows = features.candidates_with_records(records, config, arms=True, references=sides)
    rows = rows.withColumn("label", F.coalesce(F.array_contains("true_ids", F.col("cand_id")), F.lit(False)).cast("int"))
    return features.vectors(rows, [*blocking.PAIR, "is_prod", "label", "is_validation"])


class Linkage:
    """Staged run below a folder: each stage is Parquet with a manifest and is reused if it fits.

    The manifest names the settings and a digest of the rows that went in, so other records
    or another truth are worked on anew.
    """

    def __init__(self, spark: SparkSession, folder: str, config: BlockingConfig = DEFAULT, *, salt: str = "exp20k-split-v1", force: bool = False):
        self.spark, self.folder, self.config, self.salt, self.force = spark, folder, config, salt, force

    def run(self, raw: DataFrame, truth: DataFrame, until: str = "report") -> dict[str, DataFrame]:
        """Stages up to until: raw records and truth in, a DataFrame for each stage out."""
        if until not in STAGES:
            raise ValueError(f"until is one of {', '.join(STAGES)}")
        out: dict[str, DataFrame] = {}
        edges = matching.truth_edges(truth)
        steps = {
            "dataset": lambda: normalize_records(raw),
            "candidates": lambda: matching.label_candidates(blocking.two_arms(out["dataset"], self.config), edges),
            "features": lambda: features.featurize(matching.split_by_reference(out["candidates"], salt=self.salt), out["dataset"]),
            "model": lambda: matching.run_arms(out["features"]),
            "report": lambda: self._report(out, edges),
        }
        said = {"blocking": asdict(self.config), "salt": self.salt, "records": table_digest(raw), "truth": table_digest(truth)}
        stages = Stages(self.spark, self.folder, said, self.force)
        for name in STAGES[: STAGES.index(until) + 1]:
            out[name] = stages.run(name, steps[name])
        return out

    def _report(self, out: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
        """(measure, value) of volumes, recall and health."""
        refs = out["dataset"].where("source = 'S1'").select(F.col("entity_id").alias("ref_id"))
        parts = [
            ("production", profiles.volume(refs, out["candidates"].where("is_prod"))),
            ("union", profiles.volume(refs, out["candidates"])),
            ("recall_production", profiles.recall(out["candidates"].where("is_prod"), edges)),
            ("recall_union", profiles.recall(out["candidates"], edges)),
            ("a2", profiles.a2_yield(out["candidates"], edges)),
            ("health", features.health(out["features"])),
        ]
        rows = [df.select(F.explode(F.array(*(F.struct(F.lit(f"{name}.{c}").alias("measure"), F.col(c).cast("double").alias("value")) for c in df.columns))).alias("r")).select("r.*") for name, df in parts]
        report = rows[0]
        for r in rows[1:]:
            report = report.unionByName(r)
        return report
