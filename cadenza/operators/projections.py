"""Fixed projections, defaults, comparisons of policies, and cascades of candidate scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import number, truthy
from .decisions import word_stats
from .metrics import pr_curve, ranking_metrics, ratio
from .quantiles import exact_quantiles
from .thresholds import threshold_or_most_precise


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """PR-02, PR-14, PR-24: absent columns added, nulls of present ones replaced."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def policies(df: DataFrame, keys: Sequence[str], pairs: Mapping[str, tuple[str, str]]) -> DataFrame:
    """PR-17: a row per policy with its decision and score, to compare them with one aggregate."""
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), F.col(d).cast("string").alias("policy_decision"), F.col(s).cast("double").alias("policy_score")) for n, (d, s) in pairs.items()])
    return df.select(*keys, F.inline(rows))


def translated(df: DataFrame, column: str, words: Mapping[str, str], name: str, override: Column | None = None, value: str = "") -> DataFrame:
    """PR-16, PR-20, PR-21: a column in another vocabulary, unknown words as they are; where ``override`` holds, ``value``."""
    pairs = [F.lit(x) for p in words.items() for x in p]
    found = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column).cast("string")), F.col(column).cast("string"))
    return df.withColumn(name, found if override is None else F.when(override, value).otherwise(found))


def view(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PR-22, PR-23: the columns in order as text, absent and null ones blank."""
    return df.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")).alias(c) for c in columns])


def cascade_scores(rows: DataFrame, candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-15..17: all rows with the verifier's scores of the candidates among them; others score 0."""
    own = candidates.select(*keys, F.lit(1).alias("candidate_label"), "verifier_score")
    joined = rows.join(own, list(keys), "left")
    score = F.coalesce(F.col("candidate_label") * F.col("verifier_score"), F.lit(0.0))
    return joined.withColumns({"candidate_label": F.coalesce("candidate_label", F.lit(0)), "cascade_score": score}).drop("verifier_score")


def with_word_flags(phones: DataFrame, keys: Sequence[str], mode: str = "deletion_only") -> DataFrame:
    """AG-14: what a word's figures say, on each of its phones; a possibly missing word makes its alignment suspect."""
    stats = word_stats(phones, keys, mode).select(*keys, "word_duration_ms", "missing_word_reason", "deletion_trigger_source", "possible_missing_word")
    rows = phones.drop(*[c for c in stats.columns if c in phones.columns and c not in keys]).join(stats, list(keys), "left")
    if "alignment_quality" in rows.columns:
        rows = rows.withColumn("alignment_quality", F.when(F.col("possible_missing_word"), "suspect").otherwise(F.col("alignment_quality")))
    return rows


def overridden_words(words: DataFrame, phones: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG-19, JN-23: words whose decision follows the flags of their phones."""
    flags = phones.groupBy(*keys).agg(
        F.bool_or(truthy("asr_missing_word")).alias("_missing"), F.count_if(F.col("decision") == "true_error").alias("_errors"),
        F.min(F.when(F.col("deletion_trigger_source") != "none", F.col("deletion_trigger_source"))).alias("_source"),
    )
    joined = words.join(flags, list(keys), "left")
    decision = F.when(F.col("_missing"), "true_error").when(F.col("_source").isNotNull(), "uncertain_review").otherwise(F.col("word_decision"))
    return joined.withColumns({"word_decision": decision, "deletion_trigger_source": F.coalesce("_source", F.lit("none")), "num_phone_true_error": F.coalesce("_errors", F.lit(0))}).drop("_missing", "_errors", "_source")


def group_pr_summary(df: DataFrame, key: str, score: str, label: str, least: float) -> DataFrame:
    """AG-28, AG-39: per group precision, recall and F1 at the threshold of a least precision, average precision, and acceptance."""
    at = threshold_or_most_precise(df, score, label, least, [key])
    area = ranking_metrics(df, score, label, [key]).select(key, "auc", "average_precision")
    p, r = F.col("precision"), F.col("recall")
    return at.join(area, key, "left").withColumns({"f1": F.round(ratio(2 * p * r, p + r), 6), "accepted": F.col("found") & (r >= 0.05)})


def operating_points(df: DataFrame, score: str, label: str, rates: Sequence[float]) -> DataFrame:
    """WN-12: greatest recall at each of several false positive rates, from one curve."""
    curve = pr_curve(df, score, label)
    listed = F.explode(F.array(*[F.lit(float(x)) for x in rates])).alias("most_fpr")
    best = F.max_by(F.struct("threshold", "recall", "fpr"), F.struct("recall", "threshold")).alias("x")
    return curve.select("*", listed).where("fpr <= most_fpr").groupBy("most_fpr").agg(best).select("most_fpr", "x.*")


def diverse_words(words: DataFrame, key: str, index: str, word: str, function_words: Sequence[str], limit: int) -> DataFrame:
    """SO-13: up to ``limit`` different words of each text, function words first, then in order."""
    from pyspark.sql import Window

    upper = F.upper(F.col(word))
    first = words.groupBy(key, upper.alias("_w")).agg(F.min(index).alias(index))
    order = Window.partitionBy(key).orderBy(F.when(F.col("_w").isin(*function_words), 0).otherwise(1), index)
    return first.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).select(key, index, F.col("_w").alias(word))


def candidate_scores(df: DataFrame, strategy: str = "gop_aggressive", name: str = "candidate_score") -> DataFrame:
    """ML-27: the score of a candidate, -gop_score or by how much the competitor's log likelihood exceeds the target's.

    A missing value is the exact median of the others, 0 if there are none.
    """
    if strategy == "gop_aggressive":
        value, sign = number("gop_score"), -1.0
    elif strategy == "gop_margin":
        value, sign = number("competitor_log_likelihood") - number("target_log_likelihood"), 1.0
    else:
        raise ValueError(f"unknown candidate strategy {strategy!r}")
    rows = df.withColumn("_value", value)
    middle = exact_quantiles(rows, "_value", {"_median": 0.5})
    filled = rows.join(F.broadcast(middle), F.lit(True), "left")  # one row
    return filled.withColumn(name, F.lit(sign) * F.coalesce("_value", "_median", F.lit(0.0))).drop("_value", "_median")
