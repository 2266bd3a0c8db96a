"""Rows of a diagnosis for learners: phones with what their words say."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import display
from ..functions.scalars import number, text
from .joins import keep_last

# What a phone without a value shows, and the columns that a word adds.
DEFAULTS = {
    "word": "", "target_phone": "<UNK>", "start_ms": float("nan"), "end_ms": float("nan"), "alignment_quality": "bad", "phone_error_probability": 0.5, "phone_error_percent": 50.0,
    "phone_decision": "uncertain_review", "phone_error_type": "", "phone_confidence": 0.0, "evidence_summary": "Phone-level diagnosis is unavailable.",
}
RENAMED = {"alignment_quality": "word_alignment_quality", "error_type": "word_error_type", "evidence_summary": "word_evidence_summary"}
OF_WORDS = (
    "deletion_decision", "deletion_score", "final_word_decision", "final_error_type", "word_error_type", "word_alignment_quality", "asr_missing_word", "asr_missing_confidence",
    "ctc_deletion_score", "ctc_deletion_available", "word_evidence_summary",
)


def displayed_phones(phones: DataFrame, words: DataFrame | None = None, keys: Sequence[str] = ("word_index",), order: Sequence[str] = ()) -> DataFrame:
    """JN-24: every phone with the columns of its word, and display_decision, display_error, display_align, display_error_type.

    Words are joined by ``keys`` as texts; of several rows of a word the last by ``order`` counts (the order decides nothing where it is empty and rows are
    equal). Columns of the word replace those of the phone. A word that no lexicon knows shows that; a deleted one is shown as missed in all of its phones.
    """
    rows = phones
    for name, default in DEFAULTS.items():
        value = F.lit(default) if name not in rows.columns else F.coalesce(F.col(name), F.lit(default).cast(rows.schema[name].dataType))
        rows = rows.withColumn(name, value)
    if words is not None and set(keys) <= set(rows.columns):
        own = words.withColumnsRenamed({a: b for a, b in RENAMED.items() if a in words.columns})
        added = [c for c in OF_WORDS if c in own.columns]
        last = keep_last(own.withColumns({k: F.col(k).cast("string") for k in keys}), list(keys), list(order) or added).select(*keys, *added)
        rows = rows.drop(*added).withColumns({k: F.col(k).cast("string") for k in keys}).join(last, list(keys), "left")
    if "phone_state" in rows.columns:
        decision, error = display._among(text(rows, "phone_state"), display.STATES, display.UNKNOWN_WORD), display.phone_state(rows)
    else:
        decision, error = display._among(text(rows, "phone_decision"), display.DECISIONS, display.UNKNOWN_WORD), display.phone_error(number("phone_error_percent"), F.col("phone_error_type"))
    at = lambda c: F.trim(text(rows, c))
    final = at("final_error_type")
    unknown = (F.lower(at("g2p_status")) == "failed") | (F.lower(at("lexicon_status")) == "failed") | (F.upper(at("target_phone")) == "<UNK>") | (final == "g2p_issue")
    kind = F.when(final == "", at("word_error_type")).otherwise(final)
    gone = ~unknown & ((kind == "deletion") | (at("deletion_decision") == "deletion"))
    summary = at("word_evidence_summary")
    return rows.withColumns(
        {
            "display_decision": F.when(unknown, display.UNKNOWN_WORD).when(gone, display.MISSED).otherwise(decision),
            "display_error": F.when(unknown, display.UNDECIDED).when(gone, display.MISSED).otherwise(error),
            "display_align": F.when(gone, "suspect").otherwise(F.col("alignment_quality").cast("string")),
            "display_error_type": F.when(unknown, "g2p_issue").when(gone, "deletion").otherwise(F.col("phone_error_type").cast("string")),
            "evidence_summary": F.when((kind == "deletion") & (summary != ""), summary).otherwise(F.col("evidence_summary")),
        }
    )
