"""Correct, mispronounced or deleted: phone states from two recognisers' margins, and words from phones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import CONFUSIONS, PHONE_GROUPS, arpabet, clip01, number, optional, sigmoid, squashed_score, text, truthy
from .decisions import BAD_ALIGNMENT
from .joins import keep_last

# Pairs of phones that dictionaries and speakers exchange freely, both ways, and the gates' bounds.
EQUIVALENT = (("AA", "AO"), ("AH", "IH"), ("UH", "UW"))
REFERENCE_MARGIN, PRESENT_MARGIN, PRESENT_MS = 3.0, 3.0, 70.0
THRESHOLDS = {"deleted": 0.62, "mispronounced": 0.62}


def _margin(df: DataFrame, name: str, default: float | None = None) -> Column:
    if name not in df.columns:
        return F.lit(default).cast("double")
    return number(name, default)


def equivalence(df: DataFrame, recognised: str = "recognized_phone") -> Column:
    """FI-04: the recognised phone equals the target, or stands for it, or is the F of OF."""
    target, heard = arpabet("target_phone"), arpabet(optional(df, recognised, ""))
    pairs = [f"{a}|{b}" for x in EQUIVALENT for a, b in (x, x[::-1])]
    same = (heard == target) | F.concat_ws("|", target, heard).isin(*pairs) | ((F.upper(text(df, "word")) == "OF") & (target == "V") & (heard == "F"))
    return (heard != "") & same


def presence(df: DataFrame) -> Column:
    """FI-05: both recognisers hear the target, neither margin says deletion, and the phone is long enough."""
    both = truthy(optional(df, "primary_target_match", False)) & truthy(optional(df, "reference_target_match", False))
    close = (_margin(df, "ctc_deletion_margin") <= PRESENT_MARGIN) & (_margin(df, "reference_ctc_deletion_margin") <= PRESENT_MARGIN)
    return F.coalesce(both & close & (_margin(df, "duration_ms") >= PRESENT_MS), F.lit(False))


def with_agreement(df: DataFrame) -> DataFrame:
    """FN-23: whether each recogniser heard something, heard the target, and both heard the same; joint margins."""
    target, one, two = arpabet("target_phone"), arpabet(optional(df, "recognized_phone", "")), arpabet(optional(df, "reference_recognized_phone", ""))
    out = {
        "primary_recognized_available": one != "", "reference_recognized_available": two != "", "primary_target_match": (one != "") & (one == target),
        "reference_target_match": (two != "") & (two == target), "phone_models_recognized_same": (one != "") & (one == two),
    }
    out = {k: v.cast("double") for k, v in out.items()}
    for kind in ("deletion", "substitution"):
        a, b = _margin(df, f"ctc_{kind}_margin"), _margin(df, f"reference_ctc_{kind}_margin")
        out |= {f"{kind}_margin_min": F.least(a, b), f"{kind}_margin_max": F.greatest(a, b), f"{kind}_margin_gap": F.abs(a - b)}
    return df.withColumns(out)


def margin_probabilities(df: DataFrame) -> dict[str, Column]:
    """FN-22: probabilities of the three states from the margins, summing to 1."""
    deletion = sigmoid((_margin(df, "ctc_deletion_margin", -10.0) - 1.0) / 1.5)
    wrong = (sigmoid((_margin(df, "ctc_substitution_margin", -10.0) - 0.75) / 1.5) + sigmoid((-_margin(df, "ctc_logit_margin", 0.0) - 1.0) / 2.0)) / 2
    wrong = wrong * (1 - deletion)
    correct = F.greatest(1 - deletion - wrong, F.lit(0.0))
    total = correct + wrong + deletion
    total = F.when(total == 0, 1.0).otherwise(total)
    return {"correct": correct / total, "mispronounced": wrong / total, "deleted": deletion / total}


def phone_states(df: DataFrame, thresholds: Mapping[str, float] = THRESHOLDS, reference_gates: bool = True, probabilities: Mapping[str, str] | None = None) -> DataFrame:
    """RU-09, JN-20, JN-21: states after the gates.

    A deletion that the second recogniser or the presence guard rejects, and a
    substitution by an equivalent phone, give their probability to correct.
    ``probabilities`` names columns of a classifier in place of the margins.
    """
    own = {k: F.col(v) for k, v in probabilities.items()} if probabilities else margin_probabilities(df)
    second = truthy(optional(df, "reference_ctc_phone_model_available", False))
    guard = presence(df)
    if reference_gates:
        guard = guard | (second & F.coalesce(_margin(df, "reference_ctc_deletion_margin") < REFERENCE_MARGIN, F.lit(False)))
    same = equivalence(df)
    if reference_gates:
        same = same | equivalence(df, "reference_recognized_phone")
    rows = df.withColumns({f"_{k}": v for k, v in own.items()} | {"_guard": guard, "phone_equivalence_guard": same, "dual_phone_presence_guard": presence(df)})
    deleted = F.when(F.col("_guard"), 0.0).otherwise(F.col("_deleted"))
    wrong = F.when(F.col("phone_equivalence_guard"), 0.0).otherwise(F.col("_mispronounced"))
    moved = F.when(F.col("_guard"), F.col("_deleted")).otherwise(0.0) + F.when(F.col("phone_equivalence_guard"), F.col("_mispronounced")).otherwise(0.0)
    correct = F.least(F.col("_correct") + moved, F.lit(1.0))
    available = truthy(optional(df, "ctc_phone_model_available", False))
    state = (
        F.when(~available, "unavailable").when(deleted >= thresholds["deleted"], "deleted").when(wrong >= thresholds["mispronounced"], "mispronounced").otherwise("correct")
    )
    out = {
        "phone_state": state, "phone_probability_correct": F.when(available, F.round(correct, 6)).otherwise(0.5),
        "phone_probability_mispronounced": F.when(available, F.round(wrong, 6)).otherwise(0.5), "phone_probability_deleted": F.when(available, F.round(deleted, 6)).otherwise(0.0),
    }
    rows = rows.withColumns(out).drop("_guard", *[f"_{k}" for k in own])
    s = F.col("phone_state")
    error = F.round(clip01(F.col("phone_probability_mispronounced") + F.col("phone_probability_deleted")), 6)
    no_word = (text(df, "g2p_status", "success") == "failed") | (text(df, "target_phone") == "<UNK>")
    bad = F.lower(text(df, "alignment_quality")).isin(*BAD_ALIGNMENT)
    kind = (
        F.when(s == "mispronounced", "mispronunciation").when(s == "deleted", "deletion").when(s == "correct", "").when(no_word, "g2p_issue").when(bad, "alignment_issue")
        .otherwise("model_unavailable")
    )
    sure = F.when(s == "correct", F.col("phone_probability_correct")).when(s == "mispronounced", F.col("phone_probability_mispronounced")).when(
        s == "deleted", F.col("phone_probability_deleted")
    ).otherwise(0.0)
    return rows.withColumns(
        {
            "phone_error_probability": error, "phone_error_type": kind, "phone_confidence": sure,
            "phone_decision": F.when(s == "correct", "correct").when(s == "unavailable", "uncertain_review").otherwise("true_error"),
        }
    )


def with_second_evidence(phones: DataFrame, primary: DataFrame, reference: DataFrame | None, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """JN-20, JN-21: phones with the evidence of one recogniser and, under the prefix reference_, of another."""
    out = phones.join(keep_last(primary, keys, order).drop(*order), list(keys), "left")
    if reference is not None:
        last = keep_last(reference, keys, order).drop(*order)
        out = out.join(last.withColumnsRenamed({c: f"reference_{c}" for c in last.columns if c not in keys}), list(keys), "left")
    return out


def word_sequences(df: DataFrame, keys: Sequence[str], order: str, predicted: str | None = None, score: str | None = None) -> DataFrame:
    """AG-18, AG-54: target and predicted phones of a word in order, and mean and least normalised score."""

    def sequence(column: str | None) -> Column:
        if column is None:
            return F.lit("")
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order), arpabet(column).alias("p"))))
        return F.concat_ws(" ", F.filter(F.transform(ordered, lambda x: x["p"]), lambda p: p != ""))

    value = squashed_score(number(score)) if score else F.lit(None).cast("double")
    return df.groupBy(*keys).agg(
        sequence("target_phone").alias("target_phone_seq"), sequence(predicted).alias("predicted_phone_seq"), F.round(F.avg(value), 6).alias("avg_phone_score"),
        F.round(F.min(value), 6).alias("min_phone_score"), F.lit(score or "unavailable").alias("ctc_score_source"),
    )


def substitution_candidates(phone: str) -> list[str]:
    """FN-16: phones of the same class and confusable ones, sorted."""
    own = next((set(p) for g, p in PHONE_GROUPS.items() if phone in p and g != "silence"), set())
    return sorted((own | set(CONFUSIONS.get(phone, ()))) - {phone})
