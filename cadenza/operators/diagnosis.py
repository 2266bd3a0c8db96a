"""Whole diagnoses: words from phones, phone hypotheses of a CTC model, tuned phone states, and the final columns of a prediction."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.scalars import arpabet, number, optional, text, truthy
from ..shipping import ship
from .confusions import word_mispronunciation
from .decisions import word_deletion, word_fusion
from .joins import keep_last
from .metrics import ratio
from .modes import Modes, apply_mode
from .sequences import ctc_best_path, ctc_log_probability, label_frames, path_log_probability
from .three_state import REFERENCE_MARGIN, substitution_candidates, word_sequences

# The columns of a final prediction, in order.
FINAL_COLUMNS = """utterance_id speaker_id word word_index target_phone phone_index start_ms end_ms duration_ms model_error_score prob_correct
manual_calibrated_error_probability phone_error_probability phone_error_percent phone_decision phone_error_type phone_confidence phone_score_source
decision confidence error_type alignment_quality review_reason g2p_source g2p_status g2p_error word_phone_index lexicon_status g2p_confidence
pronunciation_variant_id num_pronunciation_variants selected_pronunciation possible_missing_word missing_word_reason deletion_trigger_source debug_reason
debug_high_error_ratio debug_low_prob_correct_ratio debug_short_phone_ratio word_duration_ms short_phone_ratio high_error_ratio low_prob_correct_ratio
asr_transcript asr_word_status asr_missing_word asr_confidence alignment_op recognized_word deletion_score deletion_confidence asr_context_support
asr_missing_confidence ctc_deletion_score ctc_deletion_margin ctc_deletion_available ctc_deletion_model ctc_greedy_transcript ctc_deletion_error
phonological_relation evidence_summary""".split()
# Words that carry grammar, and the features of a deletion model that are read as flags and as numbers.
FUNCTION_WORDS = """A AN AND ARE AS AT BE BUT BY FOR FROM HE HER HIM HIS I IN IS IT ITS ME MY OF ON OR OUR SHE THAT THE THEIR THEM THEY THIS TO US WAS WE WERE
WITH YOU YOUR""".split()
FLAGS = "asr_missing_word asr_substituted_word ctc_deletion_available ctc_greedy_missing_word ctc_greedy_substituted_word".split()
NUMBERS = "asr_confidence asr_context_support asr_missing_confidence ctc_deletion_score ctc_deletion_margin ctc_greedy_context_support phone_count".split()
# Bounds of an alignment that passes (milliseconds, share of the audio), and of the threshold search.
SHORTEST, LONGEST, LEAST_SHARE, MOST_SHARE, CLIPPED_MARGIN = 20.0, 500.0, 0.35, 1.20, 30.0
FIRST, STEP, STEPS, MOST_ALARMS, MOST_SANITY, PENALTY = 0.30, 0.01, 70, 0.10, 0.05, 2.0
STATES = ("correct", "mispronounced", "deleted")


def alignment_quality(duration: Column, phones: Column, phones_ms: Column, audio_ms: Column, failed: Column | None = None) -> Column:
    """FI-06: pass or bad, by the duration of a phone and the share of the audio that all phones take; nulls are bad."""
    share = F.try_divide(phones_ms.cast("double"), audio_ms.cast("double"))
    good = (phones > 0) & duration.between(SHORTEST, LONGEST) & (audio_ms > 0) & (phones_ms > 0) & share.between(LEAST_SHARE, MOST_SHARE)
    if failed is not None:
        good = good & ~F.coalesce(failed, F.lit(False))
    return F.when(F.coalesce(good, F.lit(False)), "pass").otherwise("bad")


def deletion_trigger(df: DataFrame) -> Column:
    """FI-03: the recogniser misses the word, or some trigger is named."""
    named = ~F.lower(F.trim(text(df, "deletion_trigger_source", "none"))).isin("", "none", "nan")
    return truthy(optional(df, "asr_missing_word", False)) | named


def states_by_thresholds(
    deleted: Column, wrong: Column, deletion_at: Column | float, wrong_at: Column | float, *, present: Column | None = None, equivalent: Column | None = None,
    second: Column | None = None, second_margin: Column | None = None, second_equivalent: Column | None = None,
) -> Column:
    """ML-31, ML-68: deleted, else mispronounced, else correct.

    ``present`` forbids a deletion and ``equivalent`` a mispronunciation; where a ``second`` recogniser is available its
    margin must support a deletion, and its own equivalence counts too. Null guards hold nothing back.
    """
    no = lambda c: F.coalesce(c, F.lit(False)) if c is not None else F.lit(False)
    gone = F.coalesce(deleted >= deletion_at, F.lit(False)) & ~no(present)
    if second is not None and second_margin is not None:
        gone = gone & (~no(second) | F.coalesce(second_margin >= REFERENCE_MARGIN, F.lit(False)))
    bad = F.coalesce(wrong >= wrong_at, F.lit(False)) & ~no(equivalent) & ~no(second_equivalent)
    return F.when(gone, "deleted").when(bad, "mispronounced").otherwise("correct")


def _reached(value: Column, guard: Column) -> Column:
    """How many thresholds of the grid a probability reaches; none under a guard."""
    grid = F.array(*[F.lit(FIRST + STEP * i) for i in range(STEPS)])
    return F.when(F.coalesce(guard, F.lit(False)) | value.isNull(), 0).otherwise(F.size(F.filter(grid, lambda t: t <= value)))


def _state_counts(df: DataFrame, deleted: str, wrong: str, gold: str, present: str, equivalent: str) -> DataFrame:
    """(gold, i, j, state, n): the rows of each class in each state under the i-th deletion and j-th wrong threshold.

    The rows are counted once by the thresholds that they reach (at most 71 * 71 cells a class), and the cells are summed.
    """
    cells = df.select(F.col(gold).alias("gold"), _reached(F.col(deleted), F.col(present)).alias("d"), _reached(F.col(wrong), F.col(equivalent)).alias("w"))
    cells = cells.groupBy("gold", "d", "w").agg(F.count(F.lit(1)).alias("n"))
    every = F.array(*[F.lit(i) for i in range(STEPS)])
    by_wrong = cells.select("gold", "d", "n", "w", F.explode(every).alias("j")).groupBy("gold", "d", "j").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("w") > F.col("j"), F.col("n")).otherwise(0)).alias("m")
    )
    gone = F.col("d") > F.col("i")
    pairs = by_wrong.select("gold", "d", "j", "n", "m", F.explode(every).alias("i")).groupBy("gold", "i", "j").agg(
        F.sum("n").alias("rows"), F.sum(F.when(gone, F.col("n")).otherwise(0)).alias("deleted"), F.sum(F.when(gone, 0).otherwise(F.col("m"))).alias("mispronounced")
    )
    return pairs.withColumn("correct", F.col("rows") - F.col("deleted") - F.col("mispronounced"))


def tune_states(
    dev: DataFrame, deleted: str = "probability_deleted", wrong: str = "probability_mispronounced", gold: str = "gold_phone_state", present: str = "present",
    equivalent: str = "equivalent", sanity: DataFrame | None = None,
) -> DataFrame:
    """ML-30, AG-55: the pair of thresholds of greatest macro F1 less the penalised false alarms, in one pass over the rows.

    Pairs with too many alarms among the correct rows of ``sanity`` are out. Ties go to macro F1, fewer alarms, fewer
    sanity alarms, then to the lower deletion and the lower wrong threshold. No row if no pair is allowed.
    """
    counts = _state_counts(dev, deleted, wrong, gold, present, equivalent)
    sums = [F.sum(F.when(F.col("gold") == g, F.col(s)).otherwise(0)).alias(f"{g}_{s}") for g in STATES for s in STATES]
    table = counts.groupBy("i", "j").agg(*sums, *[F.sum(s).alias(f"all_{s}") for s in STATES])

    def f1(s: str) -> Column:
        return ratio(2 * F.col(f"{s}_{s}"), F.col(f"all_{s}") + sum(F.col(f"{s}_{t}") for t in STATES))

    own = sum(F.col(f"correct_{t}") for t in STATES)
    table = table.select("i", "j", F.round(sum(f1(s) for s in STATES) / 3, 9).alias("macro_f1"), F.round(ratio(own - F.col("correct_correct"), own), 9).alias("false_alarm"))
    if sanity is None:
        table = table.withColumn("sanity_false_alarm", F.lit(0.0))
    else:
        alarms = _state_counts(sanity, deleted, wrong, gold, present, equivalent).groupBy("i", "j").agg(F.sum("correct").alias("c"), F.sum("rows").alias("r"))
        table = table.join(alarms.select("i", "j", F.round(ratio(F.col("r") - F.col("c"), F.col("r")), 9).alias("sanity_false_alarm")), ["i", "j"], "left")
        table = table.withColumn("sanity_false_alarm", F.coalesce("sanity_false_alarm", F.lit(0.0))).where(F.col("sanity_false_alarm") <= MOST_SANITY)
    objective = F.round(F.col("macro_f1") - PENALTY * F.greatest(F.col("false_alarm") - MOST_ALARMS, F.lit(0.0)), 9)
    at = lambda c: F.round(F.lit(FIRST) + F.lit(STEP) * F.col(c), 2)
    best = table.withColumn("objective", objective).orderBy(F.desc("objective"), F.desc("macro_f1"), "false_alarm", "sanity_false_alarm", "i", "j").limit(1)  # of 70 * 70 rows
    return best.select(at("i").alias("deletion_threshold"), at("j").alias("wrong_threshold"), "objective", "macro_f1", "false_alarm", "sanity_false_alarm")


def deletion_features(df: DataFrame, key: str = "utterance_id") -> DataFrame:
    """ML-33: the 17 word features of a deletion model added to the rows; absent columns are false or null."""
    flags = {c: truthy(optional(df, c, False)).cast("double") for c in FLAGS}
    numbers = {c: number(c) if c in df.columns else F.lit(None).cast("double") for c in NUMBERS}
    margin = numbers["ctc_deletion_margin"]
    numbers["ctc_deletion_margin"] = F.when(margin.isNotNull(), F.greatest(F.least(margin, F.lit(CLIPPED_MARGIN)), F.lit(-CLIPPED_MARGIN)))
    place, word = number("word_index", 0.0) if "word_index" in df.columns else F.lit(0.0), F.upper(text(df, "word"))
    if key in df.columns:
        rows, last = df, F.max(place).over(Window.partitionBy(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    else:  # one utterance
        rows, last = df.join(F.broadcast(df.agg(F.max(place).alias("_last")))), F.col("_last")
    return rows.withColumns(
        {
            **flags, **numbers, "recognizer_deletion_agreement": flags["asr_missing_word"] * flags["ctc_greedy_missing_word"],
            "recognizer_substitution_disagreement": flags["asr_substituted_word"] * flags["ctc_greedy_missing_word"],
            "word_length": F.length(F.replace(word, F.lit("'"), F.lit(""))).cast("double"), "relative_word_position": place / F.greatest(last, F.lit(1.0)),
            "is_function_word": word.isin(*FUNCTION_WORDS).cast("double"),
        }
    ).drop("_last")


def _merged(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``left`` with the columns of ``right`` in place of its own; of several rows of a key the greatest counts."""
    right = right.drop("word")
    own = keep_last(right, list(keys), [c for c in right.columns if c not in keys])
    return left.drop(*[c for c in own.columns if c not in keys]).join(own, list(keys), "left")


def diagnose_words(phones: DataFrame, words: DataFrame, keys: Sequence[str], order: str = "phone_index", score: str | None = None, recogniser: DataFrame | None = None, ctc: DataFrame | None = None) -> DataFrame:
    """RU-13: the final decision of each word from its phones, its summary, the recogniser's comparison and CTC evidence.

    All tables are joined by ``keys``. Columns of phones stand under what ``words``, ``recogniser`` and ``ctc`` bring.
    """
    sequences = word_sequences(phones, keys, order, "recognized_phone" if "recognized_phone" in phones.columns else None, score)
    rows = _merged(words, sequences, keys)
    for more in (ctc, recogniser):
        if more is not None:
            rows = _merged(rows, more, keys)
    return word_fusion(word_mispronunciation(word_deletion(rows)))


def final_prediction(df: DataFrame, mode: str = "conservative", config: Modes = Modes()) -> DataFrame:
    """PR-15: decided rows in the final columns; columns that the frame lacks are blank, phones without pronunciation go to review."""
    rows = apply_mode(df, mode, config)
    failed = text(df, "g2p_status", "failed") == "failed" if "g2p_status" in df.columns else F.lit(False)
    rows = rows.withColumn("_failed", failed)
    kept = {"decision": "uncertain_review", "error_type": "g2p_issue", "alignment_quality": "bad", "review_reason": "g2p_failed", "confidence": 0.0}
    out = [F.when(F.col("_failed"), F.lit(kept[c])).otherwise(optional(rows, c, None)).alias(c) if c in kept else optional(rows, c, "").alias(c) for c in FINAL_COLUMNS]
    return rows.select(*out)


# ---------------------------------------------------------------- CTC hypotheses


def target_labels(phones: Sequence[str], words: Sequence[object], symbols: Mapping[str, Sequence[str]], vocabulary: Mapping[str, int]) -> tuple[list[int], list[tuple[int, int]], list[bool]]:
    """SQ-13: the labels of an utterance's phones, the span of each, and whether the vocabulary has all of its symbols; a blank stands between words."""
    labels: list[int] = []
    spans, available = [], []
    for i, (phone, word) in enumerate(zip(phones, words)):
        if i and word != words[i - 1] and " " in vocabulary:
            labels.append(vocabulary[" "])
        own = [vocabulary.get(s) for s in symbols.get(phone, ())]
        known = bool(own) and None not in own
        spans.append((len(labels), len(labels) + len(own) * known))
        available.append(known)
        labels += own if known else []
    return labels, spans, available


EVIDENCE = (
    "word_index int, phone_index int, target_phone string, recognized_phone string, ctc_reference_log_probability double, ctc_deletion_log_probability double, "
    "ctc_best_substitution_log_probability double, ctc_deletion_margin double, ctc_substitution_margin double, ctc_target_logit_score double, "
    "ctc_competing_logit_score double, ctc_logit_margin double, ctc_target_path_log_probability double, ctc_start_ms double, ctc_end_ms double, "
    "ctc_duration_ms double, ctc_phone_model_available boolean"
)


def phone_hypotheses(logits: np.ndarray, phones: Sequence[str], words: Sequence[object], symbols: Mapping[str, Sequence[str]], vocabulary: Mapping[str, int], frame_ms: float, blank: int = 0) -> list[dict]:
    """SQ-14: for each phone of an utterance how much likelier the sequence is without it or with a rival, where it lies, and what was heard.

    Margins are log likelihood ratios per label; NaN where a hypothesis can't be formed.
    """
    logs = logits - np.logaddexp.reduce(logits, axis=1, keepdims=True)
    labels, spans, available = target_labels(phones, words, symbols, vocabulary)
    nan = float("nan")
    whole = ctc_log_probability(logs, labels, blank) if labels else None
    states = ctc_best_path(logs, labels, blank) if labels else None
    out = []
    for phone, (start, stop), known in zip(phones, spans, available):
        size = max(1, stop - start)
        margin = lambda other: nan if other is None or whole is None else (other - whole) / size  # noqa: B023, E731
        rivals = {c: [vocabulary[s] for s in symbols[c]] for c in substitution_candidates(phone) if symbols.get(c) and all(s in vocabulary for s in symbols[c])}
        without = ctc_log_probability(logs, [*labels[:start], *labels[stop:]], blank) if known else None
        swapped = {c: ctc_log_probability(logs, [*labels[:start], *ids, *labels[stop:]], blank) for c, ids in rivals.items()} if known else {}
        swapped = {c: x for c, x in swapped.items() if x is not None}
        best = max(swapped, key=swapped.get, default="")
        frames = label_frames(states, start, stop) if states is not None else np.zeros(0, int)
        score = lambda ids: float(logits[frames][:, ids].max(axis=0).mean()) if len(frames) and ids else nan  # noqa: B023, E731
        target, others = score(labels[start:stop]), {c: score(ids) for c, ids in rivals.items()} if len(frames) else {}
        nearest = max(others, key=others.get, default="")
        rival = others.get(nearest, nan)
        path = path_log_probability(logs, states, labels, start, stop) if len(frames) else None
        low, high = (int(frames.min()), int(frames.max()) + 1) if len(frames) else (0, 0)
        heard = best if margin(swapped.get(best)) > 0 else nearest if target - rival < 0 else phone
        out.append(
            {
                "target_phone": phone, "recognized_phone": heard, "ctc_reference_log_probability": nan if whole is None else whole,
                "ctc_deletion_log_probability": nan if without is None else without, "ctc_best_substitution_log_probability": swapped.get(best, nan),
                "ctc_deletion_margin": margin(without), "ctc_substitution_margin": margin(swapped.get(best)), "ctc_target_logit_score": target,
                "ctc_competing_logit_score": rival, "ctc_logit_margin": target - rival, "ctc_target_path_log_probability": nan if path is None else path,
                "ctc_start_ms": round(low * frame_ms, 3), "ctc_end_ms": round(high * frame_ms, 3), "ctc_duration_ms": round((high - low) * frame_ms, 3),
                "ctc_phone_model_available": known and whole is not None,
            }
        )
    return out


def phones_ctc(emissions: DataFrame, phones: DataFrame, key: str, symbols: Mapping[str, Sequence[str]], vocabulary: Mapping[str, int], frame_ms: float = 20.0, blank: int = 0) -> DataFrame:
    """SQ-14 over tables: ``emissions`` (key, frame, logits array) and ``phones`` (key, word_index, phone_index, target_phone) meet by key, an utterance a task's group.

    Phones of an utterance without emissions have unavailable evidence.
    """
    ship(emissions.sparkSession)
    columns = [key, *[c.split()[0] for c in EVIDENCE.split(", ")]]

    def solve(identity, frames: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("phone_index")
        places = own[["word_index", "phone_index"]].to_dict("records")
        names = [str(p or "") for p in own["target_phone"]]
        if frames.empty:
            found = [{"target_phone": p, "recognized_phone": "", "ctc_phone_model_available": False} for p in names]
        else:
            logits = np.stack(frames.sort_values("frame")["logits"].to_list()).astype(float)
            found = phone_hypotheses(logits, names, own["word_index"].tolist(), symbols, vocabulary, frame_ms, blank)
        return pd.DataFrame([{key: identity[0], **place, **x} for place, x in zip(places, found)], columns=columns)

    named = phones.select(key, F.col("word_index").cast("int"), F.col("phone_index").cast("int"), arpabet("target_phone").alias("target_phone"))
    return emissions.groupBy(key).cogroup(named.groupBy(key)).applyInPandas(solve, f"{key} {dict(emissions.dtypes)[key]}, {EVIDENCE}")
