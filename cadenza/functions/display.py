"""Texts of a diagnosis for learners, as expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from .scalars import clip01, number, text

# The texts that a learner sees.
FINE, WRONG, MISSED, PERHAPS_MISSED, REVIEW, UNKNOWN_WORD, UNDECIDED = "正确", "发音错误", "漏读", "疑似漏读", "需复核", "单词暂未收录", "无法判断"
PERHAPS_MISSED_REVIEW, MISMATCH, ACCENT, MISALIGNED = "疑似漏读/需复核", "文本音频不一致", "可接受口音", "对齐失败"
STATES = {"correct": "读对", "mispronounced": "读错", "deleted": "漏读", "unavailable": "单词暂未收录"}
DECISIONS = {"correct": "正确", "true_error": "发音错误", "uncertain_review": "需复核"}
PHONE_ERRORS = {"mispronunciation": "读错", "deletion": "漏读", "possible_mispronunciation": "疑似错误", "alignment_issue": "对齐失败"}
FINAL_ERRORS = {"deletion": "漏读", "possible_deletion": "疑似漏读", "text_audio_mismatch": "文本音频不一致", "alignment_issue": "需复核"}
BAD_ALIGNMENT = ("bad", "failed", "alignment_failed")


def _among(value: Column, names: Mapping[str, str], default: str) -> Column:
    found = F.lit(default)
    for key, name in names.items():
        found = F.when(value == key, name).otherwise(found)
    return found


def percent(value: Column) -> Column:
    """A number of percent without digits after the point, halves to the even one."""
    return F.concat(F.bround(value, 0).cast("long").cast("string"), F.lit("%"))


def final_error(probability: Column, error_type: Column) -> Column:
    """FN-29: '80% <error>'; '0%' without an error; what can't be decided has no number."""
    error = F.trim(F.coalesce(error_type, F.lit("")))
    value = clip01(F.coalesce(probability, F.lit(0.0))) * 100
    return F.when(error == "g2p_issue", UNDECIDED).when(error == "", "0%").otherwise(F.trim(F.concat_ws(" ", percent(value), _among(error, FINAL_ERRORS, ""))))


def phone_error(percentage: Column, error_type: Column) -> Column:
    """FN-30: '80% <error>', without a name if the error has none; 50 if there is no number."""
    name = _among(F.trim(F.coalesce(error_type, F.lit(""))), PHONE_ERRORS, "")
    return F.trim(F.concat_ws(" ", percent(F.coalesce(percentage, F.lit(50.0))), name))


def phone_state(df: DataFrame) -> Column:
    """FN-31: '<state> 80%' by the probability of the state; a state without a probability column of its own can't be decided."""
    state = F.trim(text(df, "phone_state"))
    found = F.lit(UNDECIDED)
    for name in ("correct", "mispronounced", "deleted"):
        value = number(f"phone_probability_{name}", 0.0) if f"phone_probability_{name}" in df.columns else F.lit(0.0)
        found = F.when(state == name, F.concat_ws(" ", F.lit(STATES[name]), percent(value * 100))).otherwise(found)
    return found


def final_decision(decision: Column, error_type: Column) -> Column:
    """FN-32: the decision in words; the error's type goes first."""
    final, error = (F.trim(F.coalesce(c, F.lit(""))) for c in (decision, error_type))
    return (
        F.when((error == "deletion") | (final == "deletion"), MISSED).when((error == "possible_deletion") | (final == "possible_deletion"), PERHAPS_MISSED_REVIEW)
        .when((error == "text_audio_mismatch") | (final == "substituted_word"), MISMATCH).when((error == "g2p_issue") | (final == "g2p_issue"), UNKNOWN_WORD)
        .when((error == "alignment_issue") | (final == "uncertain_review"), REVIEW).when(final == "mispronounced", WRONG).when(final == "acceptable_accent", ACCENT).otherwise(FINE)
    )


def shown(df: DataFrame) -> Column:
    """FN-33: struct error_display, decision_display, align_display of a row.

    Rows that have a display column filled keep it, but for unknown words, missed words and failed alignments; other rows are told by decision and error type.
    """
    error, decision, align, kind = (text(df, c) for c in ("display_error", "display_decision", "display_align", "display_error_type"))
    own_align = F.when(align != "", align).otherwise(text(df, "alignment_quality"))
    said, own_kind, quality = text(df, "decision"), text(df, "error_type"), text(df, "alignment_quality")

    def out(a: Column | str, b: Column | str, c: Column | str) -> Column:
        a, b, c = (x if isinstance(x, Column) else F.lit(x) for x in (a, b, c))
        return F.struct(a.alias("error_display"), b.alias("decision_display"), c.alias("align_display"))

    filled = (
        F.when(kind == "g2p_issue", out(UNDECIDED, UNKNOWN_WORD, "bad")).when(kind == "deletion", out(MISSED, MISSED, "suspect")).when(kind == "possible_deletion", out(PERHAPS_MISSED, PERHAPS_MISSED_REVIEW, "suspect"))
        .when((kind == "alignment_issue") | F.lower(own_align).isin(*BAD_ALIGNMENT), out(MISALIGNED, REVIEW, "bad"))
        .otherwise(out(F.when(error == "", "0%").otherwise(error), F.when(decision == "", FINE).otherwise(decision), own_align))
    )
    told = (
        F.when(own_kind == "g2p_issue", out(UNDECIDED, UNKNOWN_WORD, "bad")).when((own_kind == "alignment_issue") | F.lower(quality).isin(*BAD_ALIGNMENT), out(MISALIGNED, REVIEW, "bad"))
        .when(said == "correct", out("0%", FINE, quality)).when((said == "uncertain_review") & (own_kind == "possible_deletion"), out(PERHAPS_MISSED, PERHAPS_MISSED_REVIEW, quality))
        .when((said == "true_error") & (own_kind == "deletion"), out(MISSED, MISSED, quality)).otherwise(out("0%", F.when(said == "uncertain_review", REVIEW).otherwise(said), quality))
    )
    return F.when((error != "") | (decision != "") | (align != ""), filled).otherwise(told)
