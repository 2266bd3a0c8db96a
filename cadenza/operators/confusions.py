"""Confusions of Mandarin speakers as a table of rules, and mispronounced words."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalars import PHONE_GROUPS, number, text
from .cascade import Rule, decide
from .decisions import BAD_ALIGNMENT


@dataclass(frozen=True)
class Confusion:
    name: str
    severity: str
    intelligibility: bool
    targets: Sequence[str] = ()
    predictions: Sequence[str] = ()
    pairs: Sequence[tuple[str, str]] = ()
    positions: Sequence[str] = ()
    consonant: bool = False
    context: str = ""


# The rules in the order in which they are tried.
GONE = ("", "DEL", "SIL")
RULES = (
    Confusion("th_fronting_or_stopping", "medium", False, targets=("TH", "DH"), predictions=("S", "T", "F", "D", "Z")),
    Confusion("r_l_w_confusion", "medium", False, targets=("R",), predictions=("L", "W")),
    Confusion("final_dark_l_error", "high", True, targets=("L",), predictions=GONE, positions=("final",)),
    Confusion("v_w_f_confusion", "medium", True, targets=("V",), predictions=("W", "F")),
    Confusion("ih_iy_confusion", "low", False, pairs=(("IH", "IY"),)),
    Confusion("ae_eh_confusion", "low", False, pairs=(("AE", "EH"),)),
    Confusion("final_consonant_deletion", "high", True, predictions=GONE, positions=("final",), consonant=True),
    Confusion("consonant_cluster_reduction", "high", True, predictions=GONE, context="consonant_cluster"),
    Confusion("consonant_cluster_epenthesis", "medium", False, predictions=("AH", "IH", "AX"), context="consonant_cluster"),
    Confusion("voicing_confusion", "medium", True, pairs=(("P", "B"), ("T", "D"), ("K", "G"), ("F", "V"), ("S", "Z"), ("SH", "ZH"), ("CH", "JH"))),
)
SEVERITY = {"none": 0, "low": 1, "medium": 2, "high": 3}


def matches(rule: Confusion, target: Column, predicted: Column, position: Column, cluster: Column) -> Column:
    """FN-25."""
    parts = []
    if rule.positions:
        parts.append(position.isin(*rule.positions))
    if rule.context:
        parts.append(cluster)
    if rule.targets:
        parts.append(target.isin(*rule.targets))
    if rule.consonant:
        parts.append(~target.isin(*PHONE_GROUPS["vowel"]))
    if rule.predictions:
        parts.append(predicted.isin(*rule.predictions))
    if rule.pairs:
        parts.append(F.concat_ws("|", target, predicted).isin(*[f"{a}|{b}" for p in rule.pairs for a, b in (p, p[::-1])]))
    out = parts[0]
    for part in parts[1:]:
        out = out & part
    return out


def classify(target: Column, predicted: Column, position: Column, cluster: Column | None = None, rules: Sequence[Confusion] = RULES) -> Column:
    """FN-24: struct rank, confusion_type, severity, common, intelligibility of a pair of phones, by the first rule that matches."""

    def result(name: str, severity: str, common: bool, intelligibility: bool) -> Column:
        values = {"rank": SEVERITY[severity], "confusion_type": name, "severity": severity, "common": common, "intelligibility": intelligibility}
        return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])

    out = F.when(target == predicted, result("none", "none", False, False))
    for rule in rules:
        found = matches(rule, target, predicted, position, F.lit(False) if cluster is None else cluster)
        out = out.when(found, result(rule.name, rule.severity, True, rule.intelligibility))
    return out.otherwise(result("other_phone_difference", "medium", False, False))


def strongest(target: Column, predicted: Column) -> Column:
    """FN-26: the most severe confusion between two arrays of phones, place by place, of equal ones the first."""
    longest = F.greatest(F.size(target), F.size(predicted))
    places = F.when(longest > 0, F.sequence(F.lit(0), longest - 1)).otherwise(F.array().cast("array<int>"))

    def at(i: Column) -> Column:
        position = F.when(i == 0, "initial").when(i == longest - 1, "final").otherwise("medial")
        return classify(F.coalesce(F.get(target, i), F.lit("")), F.coalesce(F.get(predicted, i), F.lit("")), position)

    none = classify(F.lit(""), F.lit(""), F.lit("medial"))
    return F.aggregate(F.transform(places, at), none, lambda best, x: F.when(x["rank"] > best["rank"], x).otherwise(best))


def word_mispronunciation(df: DataFrame) -> DataFrame:
    """RU-10: mispronounced, acceptable accent, review or correct, from confusions, acoustic scores and the recogniser's operation."""

    def phones(name: str) -> Column:
        words = F.transform(F.split(F.upper(text(df, name)), r"\s+"), lambda w: F.regexp_replace(w, "[0-9]+$", ""))
        return F.filter(words, lambda w: w != "")

    value = lambda c: number(c) if c in df.columns else F.lit(None).cast("double")
    rows = df.withColumns({"_t": phones("target_phone_seq"), "_p": phones("predicted_phone_seq")})
    rows = rows.withColumns(
        {
            "_c": strongest(F.col("_t"), F.col("_p")), "_avg": F.coalesce(value("avg_phone_score"), value("ctc_gop_score")), "_min": value("min_phone_score"),
            "_op": F.lower(text(df, "asr_edit_op", "uncertain")), "_lex": F.lower(text(df, "lexicon_status", "custom")),
        }
    )
    differs = (F.size("_p") > 0) & (F.col("_t") != F.col("_p"))
    low = F.coalesce((F.col("_avg") < 0.45) & (F.col("_min").isNull() | (F.col("_min") < 0.30)), F.lit(False))
    moderate = F.coalesce(F.col("_avg") < 0.65, F.lit(False))
    replaced = F.col("_op").isin("substitute", "replace")
    common, hard, severity = F.col("_c.common"), F.col("_c.intelligibility"), F.col("_c.severity")
    bad = F.lower(text(df, "alignment_quality")).isin(*BAD_ALIGNMENT)

    def out(decision, score: float):
        return {"mispronunciation_decision": decision, "mispronunciation_score": F.lit(score)}

    decided = decide(
        rows,
        [
            Rule((F.col("_lex") == "failed") | bad | (F.col("_op") == "delete"), out("uncertain_review", 0.0)),
            Rule(F.col("_lex").isin("g2p_en", "phonemizer") & (differs | low | moderate | replaced), out("uncertain_review", 0.45)),
            Rule(common & (severity == "low") & low, out("uncertain_review", 0.5)),
            Rule(common & (severity == "low"), out("acceptable_accent", 0.25)),
            Rule(common & hard & low, out("mispronounced", 0.9)),
            Rule(differs & low, out("mispronounced", 0.85)),
            Rule(replaced & low, out("mispronounced", 0.8)),
            Rule(common & ~hard & low, out("uncertain_review", 0.55)),
            Rule(common & ~hard, out("acceptable_accent", 0.35)),
            Rule(differs | replaced | moderate, out("uncertain_review", 0.55)),
        ],
        out("correct", 0.0),
    )
    return decided.withColumns({"mandarin_confusion_type": F.col("_c.confusion_type"), "mandarin_confusion_severity": severity}).drop("_t", "_p", "_c", "_avg", "_min", "_op", "_lex")
