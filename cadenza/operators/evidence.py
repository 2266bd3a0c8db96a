"""Verifier evidence, votes and consensus on phone rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import error_decision, error_score
from ..functions.scalars import CONFUSIONS, TENSE_LAX, clip01, group_key, lookup, number, optional, phone, phone_group, text
from .cascade import Rule, decide
from .windows import duration_outlier, median_ratio

NAMES = {
    "main_model_error_flag": "main", "attribute_error_flag": "attribute", "retrieval_error_flag": "retrieval", "oneclass_error_flag": "oneclass",
    "duration_outlier_flag": "duration", "alignment_review_flag": "alignment_review",
}
AUDIT = {
    "attribute_error_flag": "attribute_high_risk", "retrieval_error_flag": "retrieval_negative_margin", "oneclass_error_flag": "oneclass_anomaly",
    "duration_outlier_flag": "duration_outlier",
}


@dataclass(frozen=True)
class EvidenceConfig:
    attribute_risk: float = 0.55
    margin: float = 0.0
    anomaly: float = 0.55
    duration_z: float = 2.5


def _value(df: DataFrame, name: str) -> Column:
    return number(name, 0.0) if name in df.columns else F.lit(0.0)


def with_evidence(df: DataFrame, config: EvidenceConfig = EvidenceConfig()) -> DataFrame:
    """PR-10, PR-11, PR-12: flags, counts, pattern and audit reason of each row."""
    duration = next((c for c in ("duration_ms", "duration") if c in df.columns), None)
    flags = {
        "main_model_error_score": F.round(error_score(df), 6),
        "main_model_error_flag": error_decision(df),
        "attribute_error_flag": ((text(df, "attribute_verifier_decision") == "high_confidence_error") | (_value(df, "attribute_risk_score") >= config.attribute_risk)).cast("int"),
        "retrieval_error_flag": ((text(df, "retrieval_verifier_decision") == "likely_error") | (_value(df, "proto_margin") < config.margin)).cast("int"),
        "oneclass_error_flag": ((text(df, "oneclass_verifier_decision") == "high_confidence_error") | (_value(df, "oneclass_anomaly_score") >= config.anomaly)).cast("int"),
        "alignment_review_flag": (F.lower(text(df, "alignment_quality")) != "pass").cast("int") if "alignment_quality" in df.columns else F.lit(0),
    }
    out = df.withColumns(flags)
    if duration is None:
        out = out.withColumn("duration_outlier_flag", F.lit(0))
    else:
        out = duration_outlier(out, duration, "target_phone" if "target_phone" in df.columns else duration, config.duration_z)
    verifiers = sum((F.col(c) for c in list(NAMES)[1:5]), F.lit(0))
    pattern = F.concat_ws("+", *[F.when(F.col(c) == 1, name) for c, name in NAMES.items()])
    out = out.withColumns(
        {
            "verifier_evidence_count": verifiers,
            "evidence_count": verifiers + F.col("main_model_error_flag"),
            "evidence_pattern": F.when(pattern == "main", "main_only").when(pattern == "", "none").otherwise(pattern),
        }
    )
    return out.withColumn("audit_reason", audit_reason(out))


def audit_reason(df: DataFrame) -> Column:
    """PR-12: why a final decision stands."""
    decision, score = text(df, "final_decision"), F.col("main_model_error_score")
    parts = F.concat_ws(
        " + ", F.when((score >= 0.5) | (F.col("main_model_error_flag") == 1), "main_model_high_prob"), *[F.when(F.col(c) == 1, r) for c, r in AUDIT.items()]
    )
    few = F.col("verifier_evidence_count")
    return (
        F.when(decision == "high_confidence_error",
            F.when(few == 0, "main_model_only_no_verifier_support").when(((score < 0.35) & (few < 2)) | (parts == ""), "weak_evidence_but_marked_error").otherwise(parts))
        .when(decision == "uncertain_review", "weak_or_conflicting_verifier_evidence")
        .when(decision == "acceptable_accent", "non_error_with_moderate_error_score")
        .otherwise("likely_correct")
    )


def attribute_verifier(df: DataFrame, high: float = 0.55, weak: float = 0.30) -> DataFrame:
    """ML-07: risk by confusable phone, short final consonant, tense/lax vowel and main score, capped at 1."""
    name, score, error = phone("target_phone"), error_score(df), error_decision(df) == 1
    rows = median_ratio(df, "duration_ms", "target_phone", "_ratio")
    risky = F.coalesce(lookup(name, dict.fromkeys(CONFUSIONS, 1)), F.lit(0))
    short = (optional(df, "final_consonant_flag", 0) == 1) & (F.col("_ratio") < 0.55)
    tense = name.isin(*TENSE_LAX)
    risk = F.least(F.lit(1.0), 0.20 * risky + 0.35 * short.cast("int") + 0.20 * tense.cast("int") + 0.45 * score)
    rows = rows.withColumns(
        {"attribute_risk_score": F.round(risk, 6), "attribute_mismatch_count": risky + short.cast("int") + (tense & (score >= 0.25)).cast("int"), "_risk": risk}
    )
    decided = F.when(error & (F.col("_risk") >= high), "high_confidence_error").when(error & (F.col("_risk") < weak), "uncertain_review").when(
        error, "possible_error"
    ).otherwise("likely_correct")
    return rows.withColumn("attribute_verifier_decision", decided).drop("_ratio", "_risk")


def aggregate_votes(df: DataFrame, least_score: float = 0.35, least_votes: int = 2, accent: float = 0.20) -> DataFrame:
    """RU-14: votes of three verifiers, the weighted score, and the four-way decision."""
    main, error = error_score(df), error_decision(df) == 1
    votes = (
        (text(df, "attribute_verifier_decision") == "high_confidence_error").cast("int")
        + (text(df, "retrieval_verifier_decision") == "likely_error").cast("int")
        + (text(df, "oneclass_verifier_decision") == "high_confidence_error").cast("int")
    )
    score = clip01(
        0.55 * main + 0.20 * _value(df, "attribute_risk_score") + 0.15 * _value(df, "oneclass_anomaly_score") + 0.10 * clip01(0.5 - _value(df, "proto_margin"))
    )
    rows = df.withColumns({"main_model_error_score": F.round(main, 6), "main_model_error_decision": error.cast("int"), "verification_support_votes": votes, "_score": score, "_main": main})
    decided = decide(
        rows,
        [
            Rule((F.col("main_model_error_decision") == 1) & (F.col("_main") >= least_score) & (F.col("verification_support_votes") >= least_votes), {"final_decision": "high_confidence_error"}),
            Rule(F.col("main_model_error_decision") == 1, {"final_decision": "uncertain_review"}),
            Rule(F.col("_score") >= accent, {"final_decision": "acceptable_accent"}),
        ],
        {"final_decision": "correct"},
    )
    return with_binaries(decided.withColumn("final_error_score", F.round("_score", 6)).drop("_score", "_main"))


def with_binaries(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "final_binary_high_precision": (F.col("final_decision") == "high_confidence_error").cast("int"),
            "final_binary_review_as_error": F.col("final_decision").isin("high_confidence_error", "uncertain_review").cast("int"),
        }
    )


@dataclass(frozen=True)
class Consensus:
    """Thresholds of strict consensus; groups may have their own score and evidence."""

    score: float = 0.35
    evidence: int = 2
    accent: float = 0.20
    allow_review: bool = False
    require_main: bool = True
    groups: Mapping[str, tuple[float, int]] = field(default_factory=dict)
    enabled_groups: Sequence[str] = ()
    enabled_phones: Sequence[str] = ()


def strict_consensus(df: DataFrame, config: Consensus = Consensus()) -> DataFrame:
    """RU-15: a voted frame decided again by evidence counts and group thresholds."""
    rows = with_evidence(df)
    group = group_key("phone_group") if "phone_group" in df.columns else F.lit("")
    key = F.when((F.col("duration_outlier_flag") == 1) & (group != "vowel"), "final_consonant").otherwise(group)
    scores, counts = {g: float(s) for g, (s, _) in config.groups.items()}, {g: int(n) for g, (_, n) in config.groups.items()}

    def own(values, default):
        return F.coalesce(lookup(key, values), lookup(group, values), F.lit(default)) if values else F.lit(default)

    rows = rows.withColumns({"final_error_score_threshold": own(scores, config.score), "strict_min_evidence_count": own(counts, config.evidence)})
    threshold = F.col("final_error_score_threshold")
    main = (F.col("main_model_error_flag") == 1) | (F.col("main_model_error_score") >= threshold)
    agreed = (
        (main if config.require_main else F.lit(True))
        & (F.col("verifier_evidence_count") >= F.col("strict_min_evidence_count"))
        & (F.lit(config.allow_review) | (F.col("alignment_review_flag") == 0))
        & (F.upper(text(df, "target_phone")).isin(*[p.upper() for p in config.enabled_phones]) if config.enabled_phones else F.lit(True))
        & ((group.isin(*config.enabled_groups) | key.isin(*config.enabled_groups)) if config.enabled_groups else F.lit(True))
        & (F.col("final_error_score") >= threshold)
    )
    decided = decide(
        rows.drop("final_decision"),
        [
            Rule(agreed, {"final_decision": "high_confidence_error"}),
            Rule(F.col("main_model_error_flag") == 1, {"final_decision": "uncertain_review"}),
            Rule(F.col("final_error_score") >= config.accent, {"final_decision": "acceptable_accent"}),
        ],
        {"final_decision": "correct"},
    )
    return with_binaries(decided.withColumn("audit_reason", audit_reason(decided)))


def with_phone_groups(df: DataFrame) -> DataFrame:
    """FN-03 on a frame."""
    return df.withColumn("phone_group", phone_group("target_phone"))
