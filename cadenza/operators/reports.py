"""Diagnostic tables: reviews, false alarms, boundaries, corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .metrics import case_types, ratio
from .quantiles import exact_quantiles

# Phones whose vowels are weak in fluent speech.
WEAK_VOWELS = ("AH", "IH", "ER", "R", "AX", "IX")


def review_table(df: DataFrame, key: str, label: str = "manual_review_label", error: str = "manual_is_error", score: str = "final_error_score") -> DataFrame:
    """AG-35: reviewed rows per group, true errors, precision, other verdicts and mean score."""
    n, hits = F.count(F.lit(1)), F.sum(F.col(error).cast("long"))
    rows = df.groupBy(key).agg(
        n.alias("reviewed_count"), hits.alias("manual_true_error_count"), (n - hits).alias("manual_non_error_count"),
        *[F.count_if(F.col(label) == v).alias(f"{v}_count") for v in ("acceptable_accent", "correct", "bad_alignment")],
        F.round(F.avg(F.coalesce(F.col(score).try_cast("double"), F.lit(0.0))), 6).alias("mean_final_error_score"),
    )
    return rows.withColumn("manual_precision", F.round(ratio(F.col("manual_true_error_count"), F.col("reviewed_count")), 6))


def downgrades(reviewed: DataFrame, key: str, least: int, precision: float) -> DataFrame:
    """AG-36: groups with enough reviews whose precision misses the target, and what to do."""
    low = reviewed.where((F.col("reviewed_count") >= least) & (F.col("manual_precision") < precision))
    return low.select(F.lit(key).alias("rule_type"), F.col(key).cast("string").alias("key"), "reviewed_count", "manual_precision", F.lit("downgrade_high_confidence_to_uncertain_review").alias("recommended_action"))


def false_alarms(df: DataFrame, keys: Sequence[str], alarm: Column) -> DataFrame:
    """AG-38, AG-43: alarms by group."""
    return df.where(alarm).groupBy(*keys).agg(F.count(F.lit(1)).alias("false_positive_count"))


def alarm_summary(df: DataFrame, alarm: Column, phone: str = "target_phone") -> DataFrame:
    """AG-43: alarms on weak vowels (rows, and distinct phones), on short phones, and on phones that the model holds correct."""
    weak = F.col(phone).isin(*WEAK_VOWELS)
    return df.where(alarm).agg(
        F.count(F.lit(1)).alias("false_positive_count"), F.count_if(weak).alias("weak_vowel_rows"), F.count_distinct(F.when(weak, F.col(phone))).alias("weak_vowel_phones"),
        F.count_if(F.col("duration_ms") < 50).alias("short_duration_count"), F.count_if(F.col("prob_correct") >= 0.75).alias("high_prob_correct_count"),
    )


def score_summary(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """AG-44, AG-58: a row per score: count, distinct values, least, quartiles, greatest, mean, and whether it is constant."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(name).alias("score"), F.col(name).try_cast("double").alias("x")) for name in scores])))
    found = each.groupBy("score").agg(
        F.count("x").alias("n"), F.count_distinct("x").alias("distinct_values"), F.min("x").alias("least"), F.max("x").alias("greatest"), F.round(F.avg("x"), 6).alias("mean")
    )
    quartiles = {"q25": 0.25, "median": 0.5, "q75": 0.75}
    rows = found.join(exact_quantiles(each, "x", quartiles, ["score"]), "score", "left").withColumns({c: F.round(c, 6) for c in quartiles})
    listed = rows.select("score", "n", "distinct_values", "least", *quartiles, "greatest", "mean")
    return listed.withColumn("constant", (F.col("distinct_values") == 1) & (F.col("n") > 1))


def duration_priors(df: DataFrame, phone: str, duration: str, fit: Column) -> DataFrame:
    """AG-49: exact median duration of each phone over the rows to fit on."""
    rows = df.where(fit)
    counts = rows.groupBy(F.col(phone).alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    medians = exact_quantiles(rows, duration, {"median_ms": 0.5}, [phone])
    return counts.join(medians, F.col("_p").eqNullSafe(F.col(phone)), "left").select(F.col("_p").alias(phone), "median_ms", "n")


def word_label_from_scores(df: DataFrame, keys: Sequence[str], score: str, missing_support: Column | None = None) -> DataFrame:
    """AG-53: a word's label by the bands of its phones' 0..2 scores; ``missing_support`` is evidence that it was not spoken."""
    s = F.col(score)
    rows = df.groupBy(*keys).agg(
        F.count(s).alias("n"), F.count_if(s >= 1.5).alias("good"), F.count_if((s >= 0.5) & (s < 1.5)).alias("fair"), F.count_if(s < 0.5).alias("poor"),
        F.bool_or(F.lit(False) if missing_support is None else missing_support).alias("missing"),
    )
    n, good, fair, poor = (F.col(c) for c in ("n", "good", "fair", "poor"))
    label = (
        F.when(n == 0, "alignment_issue").when(2 * good > n, "word_correct").when((2 * fair > n) & (poor == 0), "acceptable_accent")
        .when((poor > 0) & F.col("missing"), "deletion_or_missing").when(poor > 0, "mispronounced").when(good > 0, "word_correct").otherwise("acceptable_accent")
    )
    return rows.withColumn("word_label", label).drop("missing")


def boundary_errors(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """AG-56: median and nearest-rank 75th percentile of the absolute error, and the shares within 50 and 100 ms."""
    error = F.abs(F.col(predicted) - F.col(gold))
    rows = df.select(error.alias("e")).where("e IS NOT NULL")
    counts = rows.agg(
        F.count(F.lit(1)).alias("boundaries"), F.round(F.avg((F.col("e") <= 50).cast("double")), 6).alias("within_50_ms"),
        F.round(F.avg((F.col("e") <= 100).cast("double")), 6).alias("within_100_ms"),
    )
    found = exact_quantiles(rows, "e", {"median_ms": 0.5, "p75_ms": 0.75})
    both = counts.join(F.broadcast(found), F.lit(True), "left")  # one row each
    return both.select("boundaries", F.round("median_ms", 6).alias("median_ms"), F.round("p75_ms", 6).alias("p75_ms"), "within_50_ms", "within_100_ms")


def alignment_failures(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG-31, AG-57: failed, suspect and missing boundaries per group."""
    quality = F.lower(F.coalesce("alignment_quality", F.lit("")))
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(quality.isin("bad", "failed", "alignment_failed")).alias("failed"), F.count_if(quality == "suspect").alias("suspect"),
        F.count_if(F.col("start_ms").isNull() | F.col("end_ms").isNull()).alias("missing_boundaries"),
    )


def deletion_policies(df: DataFrame, gold: Column, policies: dict[str, Column]) -> DataFrame:
    """AG-47: hits, false alarms and misses of several policies, a row each, in one pass."""
    sums = df.agg(
        *[F.struct(F.count_if(gold & c).alias("tp"), F.count_if(~gold & c).alias("fp"), F.count_if(gold & ~c).alias("fn")).alias(n) for n, c in policies.items()]
    )
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("policy"), f"{n}.tp", f"{n}.fp", f"{n}.fn") for n in policies])).alias("x")).select("x.*")


def corpus_counts(df: DataFrame, split: str, speaker: str) -> DataFrame:
    """AG-26: rows and distinct speakers per split."""
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(speaker).alias("speakers"))


def worst_cases(df: DataFrame, label: str, decision: str, score: str, tie: Sequence[str], limit: int = 300) -> DataFrame:
    """AG-25, AG-27: the false alarms with the highest scores."""
    cases = df.withColumn("case_type", case_types(F.col(label), F.col(decision)))
    return cases.where("case_type = 'false_positive'").orderBy(F.desc(score), *tie).limit(limit)
