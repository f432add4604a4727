"""Labels, entity-level split, threshold metrics and the logistic-regression matcher."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import BUCKETS, split_bucket
from . import newton
from .features import FEATURE_NAMES

BETA = 0.5
DEFAULT_THRESHOLDS = tuple(round(0.1 * i, 1) for i in range(1, 10))


def truth_edges(truth: DataFrame) -> DataFrame:
    """truth(source1_entity_id, matched_ids array) -> distinct (ref_id, cand_id)."""
    return truth.select(F.col("source1_entity_id").alias("ref_id"), F.explode("matched_ids").alias("cand_id")).distinct()


def label_candidates(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """pairs with label 1 where the truth holds (ref_id, cand_id), else 0."""
    known = edges.select("ref_id", "cand_id").distinct().withColumn("hit", F.lit(1))
    return pairs.join(known, ["ref_id", "cand_id"], "left").withColumn("label", F.coalesce("hit", F.lit(0))).drop("hit").select(*pairs.columns, "label")


def split_by_reference(pairs: DataFrame, *, fraction: float = 0.2, salt: str = "v1", entity: str = "ref_id") -> DataFrame:
    """pairs with is_validation, the same for all pairs of a reference; hashed once for each reference."""
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    sides = pairs.select(entity).distinct().withColumn("is_validation", split_bucket(F.col(entity), salt) < fraction * BUCKETS)
    return pairs.join(sides, entity).select(*pairs.columns, "is_validation")


def _metrics(rows: DataFrame, beta: float) -> DataFrame:
    """Adds precision, recall and f_beta to counts; an undefined ratio is 0."""
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn = "true_positives", "false_positives", "false_negatives"
    rows = rows.withColumn("precision", ratio(tp, F.col(tp) + F.col(fp))).withColumn("recall", ratio(tp, F.col(tp) + F.col(fn)))
    b = beta * beta
    top = (1 + b) * F.col("precision") * F.col("recall")
    return rows.withColumn("f_beta", F.coalesce(F.try_divide(top, b * F.col("precision") + F.col("recall")), F.lit(0.0)))


def _counts(label, hit) -> list:
    yes = label == 1
    count = lambda c: F.count_if(c)
    return [count(hit).alias("predicted_positives"), count(hit & yes).alias("true_positives"), count(hit & ~yes).alias("false_positives"), count(~hit & yes).alias("false_negatives")]


def precision_recall_fbeta(predicted: DataFrame, *, beta: float = BETA, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return _metrics(predicted.agg(*_counts(F.col(label), F.col(prediction) == 1)), beta)


def evaluate_thresholds(scored: DataFrame, thresholds=DEFAULT_THRESHOLDS, *, beta: float = BETA, label: str = "label", score: str = "score") -> DataFrame:
    """A row for each threshold, all counted in one pass over scored: score >= threshold is positive."""
    sums = scored.agg(*(F.struct(*_counts(F.col(label), F.col(score) >= t)).alias(f"t{i}") for i, t in enumerate(thresholds)))
    rows = sums.select(F.explode(F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("c")) for i, t in enumerate(thresholds)))).alias("r"))
    return _metrics(rows.select("r.threshold", "r.c.*"), beta)


def best_threshold(reports: DataFrame) -> DataFrame:
    """The report of largest f_beta, of equal ones that of the higher threshold."""
    return reports.orderBy(F.desc("f_beta"), F.desc("threshold")).limit(1)


def macro_fbeta(pairs: DataFrame, references: DataFrame, *, beta: float = BETA) -> DataFrame:
    """Mean f_beta over all references(ref_id); pairs(ref_id, label, prediction) hold each true or predicted pair.

    Our convention for references without a true match: 1 if nothing is predicted, else 0.
    """
    yes, hit = F.col("label") == 1, F.col("prediction") == 1
    sums = pairs.groupBy("ref_id").agg(F.count_if(yes & hit).alias("true_positives"), F.count_if(~yes & hit).alias("false_positives"), F.count_if(yes & ~hit).alias("false_negatives"))
    each = _metrics(references.select("ref_id").distinct().join(sums, "ref_id", "left").fillna(0), beta)
    nothing = (F.col("true_positives") + F.col("false_positives") + F.col("false_negatives")) == 0
    return each.agg(F.count(F.lit(1)).alias("n_references"), F.coalesce(F.avg(F.when(nothing, 1.0).otherwise(F.col("f_beta"))), F.lit(0.0)).alias("macro_f_beta"))


def class_counts(labelled: DataFrame) -> DataFrame:
    yes = F.count_if(F.col("label") == 1)
    n = F.count(F.lit(1))
    return labelled.agg(n.alias("n_samples"), yes.alias("n_positive"), (n - yes).alias("n_negative"), F.coalesce(F.try_divide(yes.cast("double"), n.cast("double")), F.lit(0.0)).alias("positive_rate"))


@dataclass(frozen=True)
class FitSummary:
    n_samples: int
    n_positive: int
    n_negative: int
    positive_rate: float
    class_weight: str | None
    n_iter: int
    converged: bool
    n_features: int


@dataclass(frozen=True)
class Model:
    coefficients: tuple[float, ...]
    intercept: float


class LogisticMatcher:
    """L2 logistic regression on unscaled features, penalty 1 / (C n) on the mean loss.

    Solved to its optimum by Newton's steps over all rows (operators/newton.py), max_iter at most.
    """

    def __init__(self, C: float = 1.0, class_weight: str | None = None, max_iter: int = 1000, features: tuple[str, ...] = FEATURE_NAMES, tol: float = 1e-6):
        if class_weight not in (None, "balanced"):
            raise ValueError("class_weight is None or 'balanced'")
        self.C, self.class_weight, self.max_iter, self.features, self.tol = C, class_weight, max_iter, tuple(features), tol
        self.model: Model | None = None
        self.summary: FitSummary | None = None

    def problem(self, n: int, positive: int, parts: set[int]) -> newton.Problem:
        """What is to be solved over n rows of parts, positive of them with label 1."""
        if not positive or positive == n:
            raise ValueError("both classes are needed")
        weights = (n / (2 * (n - positive)), n / (2 * positive)) if self.class_weight else (1.0, 1.0)
        return newton.Problem(parts, n, weights, 1 / (self.C * n))

    def solved(self, n: int, positive: int, beta: np.ndarray, n_iter: int, converged: bool) -> LogisticMatcher:
        self.model = Model(tuple(map(float, beta[:-1])), float(beta[-1]))
        self.summary = FitSummary(n, positive, n - positive, positive / n, self.class_weight, n_iter, converged, len(self.features))
        return self

    def fit(self, labelled: DataFrame, label: newton.Label | None = None) -> LogisticMatcher:
        """labelled: the features, or x, their doubles as bytes, with label; or label gives it from the features."""
        blocks = newton.Blocks(labelled.withColumn("part", F.lit(0)), self.features, label)
        try:
            counts = blocks.size({0})
            found = newton.fit(blocks, [self.problem(*counts, {0})], self.tol, self.max_iter)
            return self.solved(*counts, *(x[0] for x in found))
        finally:
            blocks.clear()

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """df with score, the probability of a match."""
        if self.model is None:
            raise RuntimeError("fit the matcher first")
        margin = F.lit(self.model.intercept)
        for name, weight in zip(self.features, self.model.coefficients):
            margin += F.lit(weight) * F.col(name)
        return df.withColumn("score", 1 / (1 + F.exp(-margin)))

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        return self.predict_proba(df).withColumn("prediction", (F.col("score") >= threshold).cast("int"))

    def coefficients(self) -> dict[str, float]:
        if self.model is None:
            raise RuntimeError("fit the matcher first")
        return dict(zip(self.features, self.model.coefficients))

    def report(self, df: DataFrame, thresholds=DEFAULT_THRESHOLDS) -> DataFrame:
        return evaluate_thresholds(self.predict_proba(df), thresholds)


def run_arms(features: DataFrame, *, class_weight: str | None = None, thresholds=DEFAULT_THRESHOLDS, label: newton.Label | None = None) -> DataFrame:
    """features(..., label, is_prod, is_validation) -> the best report of each arm.

    An arm is a share of the one feature table: production pairs, or all. Each is fitted on
    its training side and judged on its validation side; n_train says how many pairs it was
    fitted on. The table is read once and packed in blocks (operators/newton.py), both arms
    are fitted together. features and label may be as in LogisticMatcher.fit.
    """
    spark = features.sparkSession
    part = F.col("is_prod").cast("int") + 2 * F.col("is_validation").cast("int")
    blocks = newton.Blocks(features.withColumn("part", part), FEATURE_NAMES, label)
    try:
        arms = {"production": ({1}, {3}), "production_a2": ({0, 1}, {2, 3})}
        matchers = [LogisticMatcher(class_weight=class_weight) for _ in arms]
        counts = [blocks.size(train) for train, _ in arms.values()]
        problems = [m.problem(*c, train) for m, c, (train, _) in zip(matchers, counts, arms.values())]
        found = newton.fit(blocks, problems, matchers[0].tol, matchers[0].max_iter)
        betas = [m.solved(*c, *x) and x[0] for m, c, x in zip(matchers, counts, zip(*found))]
        least = np.array(thresholds)

        def judged(i: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
            hit = 1 / (1 + np.exp(-np.clip(betas[i] @ x, -700, 700))) >= least[:, None]
            return np.stack([hit.sum(axis=1), (hit & (y == 1)).sum(axis=1)])

        reports = []
        for arm, matcher, sums, (_, judge) in zip(arms, matchers, blocks.sums([v for _, v in arms.values()], judged), arms.values()):
            n_yes = blocks.size(judge)[1]
            hits = np.zeros((2, len(least))) if sums is None else sums.reshape(2, -1)
            rows = [(float(t), int(p), int(tp), int(p - tp), int(n_yes - tp)) for t, p, tp in zip(thresholds, *hits)]
            schema = "threshold double, predicted_positives long, true_positives long, false_positives long, false_negatives long"
            best = best_threshold(_metrics(spark.createDataFrame(rows, schema), BETA))
            reports.append(best.select(F.lit(arm).alias("arm"), F.lit(matcher.summary.n_samples).cast("long").alias("n_train"), F.lit(matcher.summary.converged).alias("converged"), "*"))
        return reports[0].unionByName(reports[1])
    finally:
        blocks.clear()


def recovered_recall(scored: DataFrame, threshold: float) -> DataFrame:
    """Of true validation pairs that only A2 found: how many there are and how many the threshold lets through."""
    rows = scored.where("is_validation and not is_prod and label = 1")
    return rows.agg(F.count(F.lit(1)).alias("valid"), F.count_if(F.col("score") >= threshold).alias("caught"))


def top_coefficients(rows: DataFrame, k: int = 8) -> DataFrame:
    """The k largest by absolute value of (feature, weight)."""
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.abs("weight")), "feature"))).where(F.col("rank") <= k)
