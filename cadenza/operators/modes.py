"""The conservative and the hard-set decision modes, and the deletion fields both share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clip01, number, optional, reasons, text, truthy
from .cascade import Rule, decide, overwrite
from .decisions import phone_decisions

GOOD_ALIGNMENT = ("good", "pass", "ok")


@dataclass(frozen=True)
class Modes:
    correct: float = 0.75
    true_error: float = 0.90
    medium_error: float = 0.60
    confidence: float = 0.70
    most_correct: float = 0.40
    hardset_model: float = 0.05
    hardset_probability: float = 0.05
    hardset_confidence: float = 0.0
    deletion_is_error: bool = False


def _value(df: DataFrame, name: str, default: float) -> Column:
    return clip01(number(name, default)) if name in df.columns else F.lit(default)


def good_alignment(df: DataFrame) -> Column:
    return F.lower(F.trim(text(df, "alignment_quality"))).isin(*GOOD_ALIGNMENT)


def conservative(df: DataFrame, config: Modes = Modes()) -> DataFrame:
    """RU-04: errors only on strong agreeing evidence; later overwrites win."""
    right, sure = _value(df, "prob_correct", 0.5), _value(df, "confidence", 0.0)
    good, relation = good_alignment(df), text(df, "phonological_relation")
    correct = good & (right >= config.correct)
    wrong = _value(df, "manual_calibrated_error_probability", 0.5)
    model = _value(df, "model_error_score", 0.0) if "model_error_score" in df.columns else 1 - right
    wrong = F.when(correct, F.least(wrong, model)).otherwise(wrong)
    variant = relation == "acceptable_variant"
    error = (
        good & ~correct & ~variant & truthy(optional(df, "calibration_available", False)) & (wrong >= config.true_error) & (sure >= config.confidence)
        & (right <= config.most_correct) & (relation == "likely_true_error")
    )
    review = good & ~correct & ~error & ~variant & (wrong >= config.medium_error)
    marks = {"_good": good, "_correct": correct, "_variant": variant, "_error": error, "_review": review, "_wrong": wrong, "_missing": truthy(optional(df, "asr_missing_word", False))}
    rows = df.withColumns(marks | {"confidence": sure, "decision": F.lit("correct")})
    steps = [
        Rule(~F.col("_good"), {"decision": "uncertain_review"}),
        Rule(F.col("_good") & F.col("_variant"), {"decision": "acceptable_accent"}),
        Rule(F.col("_correct"), {"decision": "correct"}),
        Rule(F.col("_error"), {"decision": "true_error"}),
        Rule(F.col("_review"), {"decision": "uncertain_review"}),
        Rule(F.col("_missing"), {"decision": "true_error"}),
        Rule(~F.col("_good"), {"confidence": 0.0}),
    ]
    return error_fields(overwrite(rows, steps).withColumn("manual_calibrated_error_probability", F.col("_wrong")).drop(*marks), config)


def hardset(df: DataFrame, config: Modes = Modes()) -> DataFrame:
    """RU-05: permissive thresholds; all that isn't an error is an accepted accent."""
    good = good_alignment(df)
    error = (
        good & (_value(df, "model_error_score", 0.0) >= config.hardset_model) & (_value(df, "manual_calibrated_error_probability", 0.5) >= config.hardset_probability)
        & (_value(df, "confidence", 0.0) >= config.hardset_confidence)
    )
    decision = F.when(~good, "uncertain_review").when(error, "true_error").otherwise("acceptable_accent")
    return error_fields(df.withColumns({"decision": decision, "confidence": F.when(good, _value(df, "confidence", 0.0)).otherwise(0.0)}), config)


def error_fields(df: DataFrame, config: Modes = Modes()) -> DataFrame:
    """RU-06: error type, deletion score and confidence, and reasons."""
    missing, maybe, good = truthy(optional(df, "asr_missing_word", False)), truthy(optional(df, "possible_missing_word", False)), good_alignment(df)
    plain = ~good & ~maybe
    d = F.col("decision")
    kind = (
        F.when(missing, "deletion").when(maybe, "possible_deletion").when(plain, "bad_alignment").when(d == "true_error", "pronunciation_error")
        .when(d == "acceptable_accent", "acceptable_accent").when(d == "correct", "none").otherwise("uncertain")
    )
    lone = maybe & ~missing
    rows = df.withColumns({"error_type": kind, "_missing": missing, "_maybe": maybe, "_lone": lone, "_plain": plain})
    for name, default in (("deletion_score", F.lit(0.0)), ("deletion_confidence", F.lit("")), ("alignment_quality", F.lit("")), ("confidence", F.lit(0.0))):
        if name not in rows.columns:
            rows = rows.withColumn(name, default)
    m, b, one = F.col("_missing"), F.col("_maybe"), F.col("_lone")
    steps = [
        Rule(m, {"decision": "true_error", "deletion_score": 0.85, "deletion_confidence": "medium"}),
        Rule(m & b, {"deletion_score": 1.0, "deletion_confidence": "high"}),
        Rule(b, {"alignment_quality": "suspect"}),
        Rule(one, {"decision": "uncertain_review", "confidence": 0.0, "deletion_score": 0.5, "deletion_confidence": "low"}),
    ]
    if config.deletion_is_error:
        steps.append(Rule(one, {"decision": "true_error", "error_type": "deletion"}))
    rows = overwrite(rows, steps)
    why = F.concat(F.lit("possible_missing_word:"), F.coalesce(F.nullif(text(df, "missing_word_reason"), F.lit("")), F.lit("word_level_deletion_signal")))
    computed = (
        F.when(F.col("_missing"), "missing_in_asr_transcript").when(F.col("_maybe"), why).when(F.col("_plain"), "alignment_quality_bad;possible_text_audio_mismatch")
        .when(F.col("decision") == "uncertain_review", "insufficient_confidence").when(F.col("decision") == "true_error", "manual_calibrated_probability_above_threshold").otherwise("")
    )
    return rows.withColumn("review_reason", reasons(text(df, "review_reason"), computed)).drop("_missing", "_maybe", "_lone", "_plain")


def deletion_only(phones: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """RU-07, RU-20: phones are non-correct only where their word is deleted or badly aligned."""
    verdicts = words.select(*keys, F.col("word_decision").alias("_word"), F.col("error_type").alias("_kind"))
    joined = phones.drop("decision", "error_type").join(verdicts, keys, "left")
    bad = F.lower(text(phones, "alignment_quality")).isin("bad", "failed", "alignment_failed")
    decided = decide(
        joined,
        [
            Rule(F.col("_kind").isin("deletion", "possible_deletion"), {"decision": F.col("_word"), "error_type": F.col("_kind")}),
            Rule(bad, {"decision": "uncertain_review", "error_type": "bad_alignment"}),
        ],
        {"decision": "correct", "error_type": "none"},
    )
    return decided.drop("_word", "_kind")


def apply_mode(df: DataFrame, mode: str = "conservative", config: Modes = Modes()) -> DataFrame:
    """RU-03: dispatch; deletion_only needs words, see there."""
    known = {"phone_diagnosis": lambda: phone_decisions(df), "conservative": lambda: conservative(df, config), "hardset": lambda: hardset(df, config)}
    if mode not in known:
        raise ValueError(f"unknown mode {mode!r}")
    return known[mode]()
