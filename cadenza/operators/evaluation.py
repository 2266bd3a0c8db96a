"""Evaluation reports: binary and class metrics of scores, decisions and decision sets, in one aggregate each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import number, optional, text
from .quantiles import exact_quantiles
from .metrics import confusion, derived, multiclass_report, pearson, ranking_metrics, ratio
from .thresholds import threshold_or_most_precise

# Review labels that count as errors, and the labels and decision that the headline rates name.
ERROR_LABELS = ("true_error", "pronunciation_error", "deletion", "insertion", "substitution")
ACCENT, MISALIGNED, ERROR, REVIEW = "acceptable_accent", "bad_alignment", "true_error", "uncertain_review"


def _grouped(df: DataFrame, keys: Sequence[str], aggregates: Sequence[Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def binary_report(df: DataFrame, label: str, decision: Column, keys: Sequence[str] = ()) -> DataFrame:
    """AG-60..62, AG-64..66, AG-69..72, AG-77: counts, the metrics of ``derived`` and the false positive rate; 0 where a rate has no rows.

    A null label or decision takes no part. Precision and recall of the error class (1) are never exchanged.
    """
    said = decision.cast("int")
    rows = df.where(F.col(label).isNotNull() & said.isNotNull())
    counted = derived(_grouped(rows, keys, confusion(F.col(label), said)))
    return counted.withColumn("fpr", F.round(ratio(F.col("fp"), F.col("fp") + F.col("tn")), 6))


def threshold_report(df: DataFrame, label: str, score: str, threshold: float, keys: Sequence[str] = ()) -> DataFrame:
    """AG-61, AG-62, AG-64, AG-70, AG-71: binary_report of score >= threshold with the area under the ranking curve and the average precision."""
    rows = df.where(F.col(score).isNotNull())
    report, ranks = binary_report(rows, label, F.col(score) >= threshold, keys), ranking_metrics(rows, score, label, keys)
    own = [c for c in ranks.columns if c not in report.columns or c in keys]
    return report.join(ranks.select(*own), list(keys)) if keys else report.crossJoin(F.broadcast(ranks.select(*own)))  # one row each


def objective_at(df: DataFrame, label: str, score: str, threshold: float, objective: str) -> DataFrame:
    """ML-54: balanced_accuracy or macro_f1 of a threshold."""
    return binary_report(df, label, F.col(score) >= threshold).select(objective)


def precise_threshold(df: DataFrame, score: str, label: str, least: float) -> DataFrame:
    """ML-20: the threshold of greatest error recall with error precision >= least, else the most precise; with the two quantities in their own columns."""
    return threshold_or_most_precise(df, score, label, least)


def class_report(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """AG-67, AG-68: precision, recall, f1 and support by class, and their plain means as the class macro."""
    by_class = multiclass_report(df, gold, predicted)
    means = [F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1")]
    return by_class.unionByName(by_class.agg(F.lit("macro").alias("label"), *means, F.sum("support").alias("support")), allowMissingColumns=True)


def decision_set_report(df: DataFrame, label: str, decision: str, positive: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """AG-73, AG-74, AG-75: binary_report where any decision of a set is an error; a null decision is none."""
    return binary_report(df, label, F.coalesce(F.col(decision).isin(*positive), F.lit(False)), keys)


def headline_rates(df: DataFrame, label: str = "manual_review_label", decision: str = "decision", quality: str = "alignment_quality") -> DataFrame:
    """AG-59, AG-76, FI-07: one row of counts and rates of reviewed predictions; rows whose alignment the reviewer rejects are not scored."""
    said, own = text(df, decision), text(df, label)
    scored, error, truth = own != MISALIGNED, said == ERROR, own.isin(*ERROR_LABELS)
    accent, bad = own == ACCENT, own == MISALIGNED
    found = df.agg(
        F.count(F.lit(1)).alias("matched_rows"), F.count_if(scored).alias("scored_rows"), F.count_if(bad).alias("bad_alignment_rows"),
        F.count_if(scored & truth & error).alias("tp"), F.count_if(scored & ~truth & error).alias("fp"), F.count_if(scored & truth & ~error).alias("fn"),
        F.count_if(bad & error).alias("bad_alignment_errors"), F.count_if(accent).alias("_accents"), F.count_if(accent & error).alias("accent_errors"),
        F.count_if(F.lower(text(df, quality)) == "bad").alias("_failed"), F.count_if(said == REVIEW).alias("_review"),
    )
    n, tp, fp, fn = (F.col(c) for c in ("matched_rows", "tp", "fp", "fn"))
    rates = {
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "accent_error_rate": ratio(F.col("accent_errors"), F.col("_accents")),
        "alignment_failure_rate": ratio(F.col("_failed"), n), "review_rate": ratio(F.col("_review"), n),
    }
    return found.withColumns({k: F.round(v, 6) for k, v in rates.items()}).drop("_accents", "_failed", "_review")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AG-59: how often each value of each column occurs; null is ''."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), text(df, c).alias("value")) for c in columns])
    return df.select(F.inline(each)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """AG-78: of each column the count, mean, deviation, least, quartiles (interpolated) and greatest of its numbers, and the rows without one."""
    each = F.array(*[F.struct(F.lit(c).alias("column"), number(c).alias("v")) for c in columns])
    quartiles = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    rows = df.select(F.inline(each))
    found = rows.groupBy("column").agg(
        F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.round(F.stddev_samp("v"), 6).alias("std"), F.min("v").alias("least"), F.max("v").alias("greatest"),
        F.count_if(F.col("v").isNull()).alias("without"),
    )
    both = found.join(exact_quantiles(rows, "v", quartiles, ["column"]), "column", "left").withColumns({c: F.round(c, 6) for c in quartiles})
    return both.select("column", "n", "mean", "std", "least", *quartiles, "greatest", "without")


def correlation(df: DataFrame, gold: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """AG-63: Pearson correlation, 0 where either is constant or there are fewer than two rows."""
    found = _grouped(df.where(F.col(gold).isNotNull() & F.col(predicted).isNotNull()), keys, [pearson(gold, predicted).alias("pcc")])
    return found.select(*keys, F.round(F.coalesce("pcc", F.lit(0.0)), 6).alias("pcc"))


def alarms_by(df: DataFrame, label: str, decision: Column, score: str, keys: Sequence[str]) -> DataFrame:
    """AG-81: false positives and their mean score by keys, without keys that have none."""
    return df.where((F.col(label) == 0) & decision).groupBy(*keys).agg(F.count(F.lit(1)).alias("fp"), F.round(F.avg(score), 6).alias("mean_score"))


def sanity_report(df: DataFrame, state: str, correct: str = "correct") -> DataFrame:
    """AG-79, AG-80: rows, their share outside of the state that all should have, and the rows in each state as a map."""
    counts = df.groupBy(F.col(state).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.map_from_entries(F.array_sort(F.collect_list(F.struct("s", "n")))).alias("counts")  # a state an entry
    wrong = F.sum(F.when(F.col("s") != correct, F.col("n")).otherwise(0))
    return counts.agg(F.sum("n").alias("rows"), F.round(ratio(wrong, F.sum("n")), 6).alias("false_alarm_rate"), listed)


def mean_of_valid(df: DataFrame, score: str, keys: Sequence[str], valid: Column | None = None) -> DataFrame:
    """AG-82: by word the mean of its valid, non-negative scores; -1 where it has none."""
    good = F.col(score) >= 0 if valid is None else valid & (F.col(score) >= 0)
    return df.groupBy(*keys).agg(F.coalesce(F.round(F.avg(F.when(good, F.col(score))), 6), F.lit(-1.0)).alias(score))


def split_counts(df: DataFrame, split: str, label: str) -> DataFrame:
    """AG-83: the rows of each split and label of a manifest."""
    return df.groupBy(split, optional(df, label, None).alias(label)).agg(F.count(F.lit(1)).alias("n"))
