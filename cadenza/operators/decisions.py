"""Phone and word decisions: cascades over evidence columns and their roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import clip01, number, optional, reasons, text, truthy
from .cascade import Rule, decide
from .metrics import ratio

BAD_ALIGNMENT = ("bad", "failed", "alignment_failed")
SHORT_PHONE_MS, MULTI_PHONE = 30.0, 4


def phone_decisions(df: DataFrame) -> DataFrame:
    """RU-01, RU-02, PR-09: the first finite score of a row, and the decision it allows."""
    sources = [("model_error_score", False), ("prob_correct", True), ("phone_error_probability", False), ("manual_calibrated_error_probability", False)]
    there = [(n, 1 - number(n) if flip else number(n)) for n, flip in sources if n in df.columns]
    none = F.lit(None).cast("double")
    rows = df.withColumns(
        {
            "_p": clip01(F.coalesce(*[v for _, v in there], F.lit(0.5))),
            "_score": F.coalesce(*[v for _, v in there], none).isNotNull(),
            "phone_score_source": F.coalesce(*[F.when(v.isNotNull(), n) for n, v in there], F.lit("fallback")),
        }
    )
    p = F.col("_p")
    no_word = (F.lower(text(df, "g2p_status", "success")) == "failed") | (F.lower(text(df, "lexicon_status")) == "failed") | (F.upper(text(df, "target_phone")) == "<UNK>")
    bad = F.lower(F.trim(text(df, "alignment_quality"))).isin(*BAD_ALIGNMENT)

    def out(decision, kind, probability, confidence):
        return {"phone_decision": decision, "phone_error_type": kind, "_q": probability, "phone_confidence": confidence}

    decided = decide(
        rows,
        [
            Rule(no_word, out("uncertain_review", "g2p_issue", 0.5, 0.0)),
            Rule(bad, out("uncertain_review", "alignment_issue", F.greatest(p, F.lit(0.5)), 0.0)),
            Rule(~F.col("_score"), out("uncertain_review", "possible_mispronunciation", 0.5, 0.0)),
            Rule(p >= 0.75, out("true_error", "mispronunciation", p, p)),
            Rule(p >= 0.45, out("uncertain_review", "possible_mispronunciation", p, p)),
        ],
        out("correct", "", p, 1 - p),
    )
    return decided.withColumns(
        {"phone_error_probability": F.round("_q", 6), "phone_error_percent": F.round(F.round("_q", 6) * 100, 2), "phone_confidence": F.round("phone_confidence", 6)}
    ).drop("_p", "_q", "_score")


def worst_alignment(column: str = "alignment_quality") -> Column:
    """RU-17: bad, then suspect, then pass; else the least value."""
    value = F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return (
        F.when(F.bool_or(value == "bad"), "bad").when(F.bool_or(value == "suspect"), "suspect").when(F.bool_or(value.isin("good", "pass", "ok")), "pass").otherwise(F.min(value))
    )


def word_decision(column: str) -> Column:
    """RU-18: true_error, uncertain_review, acceptable_accent, correct, else blank."""
    found = None
    for value in ("true_error", "uncertain_review", "acceptable_accent", "correct"):
        holds = F.bool_or(F.col(column) == value)
        found = F.when(holds, value) if found is None else found.when(holds, value)
    return found.otherwise("")


def phone_summary(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AG-16: phone decisions rolled up to words."""
    p, decision = number("phone_error_probability"), F.col("phone_decision")
    errors, unsure = F.count_if(decision == "true_error"), F.count_if(decision == "uncertain_review")
    kind = F.when(errors > 0, "has_phone_error").when(unsure > 0, "needs_review").otherwise("correct")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("phone_count"), kind.alias("word_decision"), worst_alignment().alias("alignment_quality"),
        F.coalesce(F.max(p), F.lit(0.5)).alias("max_phone_error_probability"), F.round(F.coalesce(F.avg(p), F.lit(0.5)), 6).alias("avg_phone_error_probability"),
        errors.alias("num_phone_true_error"), unsure.alias("num_phone_uncertain"),
    )


def word_stats(df: DataFrame, keys: Sequence[str], mode: str = "deletion_only") -> DataFrame:
    """AG-13..15, RU-16, RU-21..23: duration and score ratios of each word and what they say about a missing word."""
    start, end = (number(c) if c in df.columns else F.lit(None).cast("double") for c in ("start_ms", "end_ms"))
    duration = number("duration_ms") if "duration_ms" in df.columns else end - start
    error, correct = (number(c, 0.5) if c in df.columns else F.lit(0.5) for c in ("manual_calibrated_error_probability", "prob_correct"))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    asr = truthy("asr_missing_word") if "asr_missing_word" in df.columns else F.lit(False)
    rows = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("phone_count"), F.round(F.coalesce(F.max(end) - F.min(start), F.lit(0.0)), 3).alias("word_duration_ms"),
        share(F.coalesce(duration, F.lit(0.0)) < SHORT_PHONE_MS).alias("short_phone_ratio"), share(error > 0.85).alias("high_error_ratio"),
        share(correct < 0.3).alias("low_prob_correct_ratio"), share(start.isNull() | end.isNull()).alias("missing_boundary_ratio"), F.bool_or(asr).alias("_asr"),
    )
    many, n = F.col("phone_count") >= MULTI_PHONE, F.col("phone_count")
    if mode == "deletion_only":
        found = [
            (F.col("_asr"), "asr_missing_word", "asr_missing_word"),
            (many & (F.col("missing_boundary_ratio") >= 0.8), "missing_boundary_ratio_ge_0.8", "missing_boundaries"),
            (many & (F.col("word_duration_ms") < F.greatest(F.lit(80.0), n * 20.0)), "extreme_word_duration_compression", "extreme_duration_compression"),
        ]
        reason = F.coalesce(*[F.when(c, r) for c, r, _ in found], F.lit(""))
        source = F.coalesce(*[F.when(c, s) for c, _, s in found], F.lit("none"))
    else:
        boundary = many & (F.col("missing_boundary_ratio") >= 0.5)
        found = [
            (many & (F.col("word_duration_ms") < 250.0), "word_duration_lt_250ms", "extreme_duration_compression"),
            (many & (F.col("short_phone_ratio") >= 0.5), "short_phone_ratio_ge_0.5", "short_phone_ratio"),
            (many & (F.col("high_error_ratio") >= 0.8), "high_error_ratio_ge_0.8", "high_error_ratio"),
            (boundary, "missing_boundary_ratio_ge_0.5", "missing_boundaries"),
        ]
        reason = F.concat_ws(";", *[F.when(c, r) for c, r, _ in found])
        source = F.coalesce(F.when(boundary, "missing_boundaries"), *[F.when(c, s) for c, _, s in found[:3]], F.lit("none"))
    debug = F.concat_ws(";", *[F.when(many & (F.col(c) >= t), f"debug_{c}_ge_{t}") for c, t in (("short_phone_ratio", 0.5), ("high_error_ratio", 0.8), ("low_prob_correct_ratio", 0.8))])
    return rows.withColumns({"missing_word_reason": reason, "deletion_trigger_source": source, "debug_reason": debug}).withColumn(
        "possible_missing_word", F.col("missing_word_reason") != ""
    ).drop("_asr")


def three_state_summary(df: DataFrame, keys: Sequence[str], state: str = "phone_state") -> DataFrame:
    """AG-17: words by the states of their phones."""
    s = F.col(state)
    count = {n: F.count_if(s == n).alias(f"num_{n}") for n in ("correct", "mispronounced", "deleted", "unavailable")}
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("phone_count"), *count.values())
    judged = F.col("phone_count") - F.col("num_unavailable")
    verdict = F.when(judged == 0, "unavailable").when(F.col("num_deleted") == F.col("phone_count"), "deleted").when(
        F.col("num_mispronounced") > 0, "mispronounced"
    ).when(F.col("num_deleted") > 0, "partial_deletion").otherwise("correct")
    return rows.withColumn("word_state", verdict)


def word_deletion(df: DataFrame) -> DataFrame:
    """RU-08: deletion decision and score of a word from fusion, recogniser, CTC and duration evidence."""
    n = number("phone_count", 0.0) if "phone_count" in df.columns else F.lit(0.0)
    d = F.coalesce(number("word_duration_ms"), F.lit(0.0)) if "word_duration_ms" in df.columns else F.lit(0.0)
    flag = lambda c: truthy(c) if c in df.columns else F.lit(False)
    value = lambda c: number(c) if c in df.columns else F.lit(None).cast("double")
    missing, greedy, ctc = flag("asr_missing_word"), flag("ctc_greedy_missing_word"), value("ctc_deletion_score")
    has_ctc = flag("ctc_deletion_available") & ctc.isNotNull()
    strength = F.coalesce(value("asr_missing_confidence"), F.when(missing, F.coalesce(value("asr_confidence"), F.lit(0.0)) * F.coalesce(value("asr_context_support"), F.lit(0.0))).otherwise(0.0))
    fused, q = flag("mandarin_deletion_model_available"), value("mandarin_deletion_probability")
    sure = F.coalesce(value("mandarin_deletion_threshold"), F.lit(0.80))
    maybe = F.coalesce(value("mandarin_possible_deletion_threshold"), F.lit(0.45))
    bad = F.lower(F.trim(text(df, "alignment_quality"))).isin(*BAD_ALIGNMENT)
    short_word = flag("is_function_word") & (n <= 1) & ~greedy & (~has_ctc | (ctc < 0.95))
    squeezed = (d > 0) & (d < F.greatest(F.lit(120.0), n * 30.0))
    tiny = (n >= MULTI_PHONE) & (d > 0) & (d < F.greatest(F.lit(80.0), n * 20.0))

    def out(decision, score):
        return {"deletion_decision": decision, "deletion_score": score}

    zero, at = F.lit(0.0), lambda x: F.lit(float(x))
    return decide(
        df,
        [
            Rule(F.lower(text(df, "lexicon_status")) == "failed", out("not_judged", zero)),
            Rule(fused & (q >= sure) & has_ctc & (missing | greedy) & ~short_word, out("deletion", q)),
            Rule(fused & (q >= maybe), out("possible_deletion", q)),
            Rule(fused & bad, out("alignment_issue", zero)),
            Rule(fused, out("correct", F.greatest(zero, q))),
            Rule(missing & has_ctc & (ctc >= 0.85), out("deletion", F.greatest(at(0.85), strength, ctc))),
            Rule(missing & (strength >= 0.55) & has_ctc & (ctc >= 0.65), out("deletion", F.greatest(strength, ctc))),
            Rule(missing & squeezed, out("deletion", F.greatest(at(0.85), strength))),
            Rule(missing, out("possible_deletion", F.greatest(at(0.60), strength))),
            Rule(has_ctc & (ctc >= 0.85) & squeezed, out("possible_deletion", ctc)),
            Rule(has_ctc & (ctc >= 0.92), out("possible_deletion", ctc)),
            Rule(bad, out("alignment_issue", zero)),
            Rule(tiny, out("possible_deletion", at(0.6))),
        ],
        out("correct", zero),
    )


def word_fusion(df: DataFrame) -> DataFrame:
    """RU-11, RU-12: one conservative result of the deletion and mispronunciation decisions of a word."""
    flag = lambda c: truthy(c) if c in df.columns else F.lit(False)
    p = lambda c: clip01(number(c, 0.0)) if c in df.columns else F.lit(0.0)
    deletion, spoken = F.lower(text(df, "deletion_decision", "correct")), F.lower(text(df, "mispronunciation_decision", "correct"))
    bad = F.lower(F.trim(text(df, "alignment_quality"))).isin(*BAD_ALIGNMENT)
    legacy = flag("asr_missing_word") & F.lit("deletion_decision" not in df.columns)

    def out(final, kind, probability, decision=None):
        return {"final_word_decision": final, "final_error_type": kind, "_p": probability, "final_decision": decision or final}

    floor = lambda c, x: F.greatest(p(c), F.lit(x))
    decided = decide(
        df,
        [
            Rule(F.lower(text(df, "lexicon_status")) == "failed", out("g2p_issue", "g2p_issue", F.lit(0.0), "uncertain_review")),
            Rule(legacy, out("deletion", "deletion", floor("text_audio_mismatch_score", 0.90))),
            Rule(deletion == "deletion", out("deletion", "deletion", floor("deletion_score", 0.85))),
            Rule((deletion == "possible_deletion") | flag("asr_missing_word"), out("possible_deletion", "possible_deletion", floor("deletion_score", 0.60))),
            Rule(flag("asr_substituted_word"), out("substituted_word", "text_audio_mismatch", floor("text_audio_mismatch_score", 0.80))),
            Rule((deletion == "alignment_issue") | bad, out("alignment_issue", "alignment_issue", F.lit(0.5), "uncertain_review")),
            Rule(spoken == "mispronounced", out("mispronounced", "mispronounced", floor("mispronunciation_score", 0.80))),
            Rule(spoken == "acceptable_accent", out("acceptable_accent", "acceptable_accent", p("mispronunciation_score"))),
            Rule(spoken == "uncertain_review", out("uncertain_review", "mispronunciation_uncertain", floor("mispronunciation_score", 0.50))),
        ],
        out("correct", "", F.lit(0.0)),
    )
    return decided.withColumns(
        {
            "final_error_probability": F.round("_p", 4),
            "final_error_percent": F.bround(F.round("_p", 4) * 100, 0).cast("int"),
            "evidence_summary": reasons(*[F.coalesce(optional(df, c, ""), F.lit("")) for c in ("deletion_evidence", "mispronunciation_evidence")]),
        }
    ).drop("_p")


def false_alarm_rate(df: DataFrame, gold: str, predicted: str, positive: str) -> DataFrame:
    """AG-33, AG-34, AG-45, AG-46: rate of a predicted class among rows that aren't of it."""
    other = F.col(gold) != positive
    return df.agg(F.count_if(other).alias("rows"), F.count_if(other & (F.col(predicted) == positive)).alias("alarms")).withColumn(
        "false_alarm_rate", F.round(ratio(F.col("alarms"), F.col("rows")), 6)
    )
