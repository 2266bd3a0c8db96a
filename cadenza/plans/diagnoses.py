"""Queries of the whole diagnoses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diagnosis
from .registry import _EVIDENCE, PHONES, _deletions, phones, query, table


@query("alignment_quality", """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity * 15 BETWEEN 20 AND 500 AND l_extendedprice > 0 AND l_extendedprice / 50000 BETWEEN 0.35 AND 1.2 AND l_tax > 0 THEN 'pass' ELSE 'bad' END AS alignment_quality FROM lineitem""")
def alignment_quality(spark, sf_dir):
    found = diagnosis.alignment_quality(F.col("l_quantity") * 15, F.col("l_linenumber"), F.col("l_extendedprice"), F.lit(50000.0), F.col("l_tax") <= 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", found.alias("alignment_quality"))


@query("deletion_trigger", "SELECT o_orderkey, o_orderstatus = 'F' OR o_orderpriority <> '5-LOW' AS triggered FROM orders")
def deletion_trigger(spark, sf_dir):
    named = F.when(F.col("o_orderpriority") == "5-LOW", " None ").otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("asr_missing_word"), named.alias("deletion_trigger_source"))
    return rows.select("o_orderkey", diagnosis.deletion_trigger(rows).alias("triggered"))


_STATES = f"""{PHONES}, p AS (SELECT target_phone, round(error_score * 0.97, 4) AS d, round(prob_correct * 0.95, 5) AS w, status = 'O' AS present, duration_ms < 10 AS equivalent, split,
    CASE WHEN gold = 1 AND error_score >= 0.5 THEN 'deleted' WHEN gold = 1 THEN 'mispronounced' ELSE 'correct' END AS gold FROM phones)"""


def _states(spark, sf_dir):
    error = F.col("gold") == 1
    return phones(spark, sf_dir).select(
        "target_phone", F.round(F.col("error_score") * 0.97, 4).alias("probability_deleted"), F.round(F.col("prob_correct") * 0.95, 5).alias("probability_mispronounced"), (F.col("status") == "O").alias("present"),
        (F.col("duration_ms") < 10).alias("equivalent"), "split", F.when(error & (F.col("error_score") >= 0.5), "deleted").when(error, "mispronounced").otherwise("correct").alias("gold_phone_state"),
    )


@query("states_by_thresholds", f"""WITH {_STATES}, s AS (SELECT target_phone, gold, CASE WHEN d >= 0.62 AND NOT present THEN 'deleted' WHEN w >= 0.5 AND NOT equivalent THEN 'mispronounced' ELSE 'correct' END AS state FROM p)
    SELECT target_phone, gold AS gold_phone_state, state, count(*) AS n FROM s GROUP BY ALL""")
def states_by_thresholds(spark, sf_dir):
    rows = _states(spark, sf_dir)
    state = diagnosis.states_by_thresholds(F.col("probability_deleted"), F.col("probability_mispronounced"), 0.62, 0.5, present=F.col("present"), equivalent=F.col("equivalent"))
    return rows.groupBy("target_phone", "gold_phone_state", state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


_F1 = "(CASE WHEN {s}_gold + {s}_all = 0 THEN 0.0 ELSE 2.0 * {s}_hit / ({s}_gold + {s}_all) END)"
_TALLY = ", ".join(f"sum(n) FILTER (gold = '{s}') AS {s}_gold, coalesce(sum(n) FILTER (state = '{s}'), 0) AS {s}_all, coalesce(sum(n) FILTER (gold = '{s}' AND state = '{s}'), 0) AS {s}_hit" for s in diagnosis.STATES)


@query("tune_states", f"""WITH {_STATES}, c AS (SELECT gold, split, CASE WHEN present THEN -1 ELSE d END AS d, CASE WHEN equivalent THEN -1 ELSE w END AS w, count(*) AS n FROM p GROUP BY ALL),
    g AS (SELECT i, j, gold, split, n, CASE WHEN d >= 0.30 + 0.01 * i THEN 'deleted' WHEN w >= 0.30 + 0.01 * j THEN 'mispronounced' ELSE 'correct' END AS state FROM c, range(70) a(i), range(70) b(j)),
    t AS (SELECT i, j, {_TALLY} FROM g WHERE split <> 0 GROUP BY 1, 2), y AS (SELECT i, j, round(sum(n) FILTER (state <> 'correct') / sum(n), 9) AS sanity_false_alarm FROM g WHERE split = 0 AND gold = 'correct' GROUP BY 1, 2),
    m AS (SELECT i, j, round(({' + '.join(_F1.format(s=s) for s in diagnosis.STATES)}) / 3, 9) AS macro_f1, round((correct_gold - correct_hit) / correct_gold, 9) AS false_alarm, coalesce(sanity_false_alarm, 0) AS sanity_false_alarm FROM t JOIN y USING (i, j))
    SELECT round(0.30 + 0.01 * i, 2)::DOUBLE AS deletion_threshold, round(0.30 + 0.01 * j, 2)::DOUBLE AS wrong_threshold, round(macro_f1 - 2 * greatest(false_alarm - 0.10, 0), 9) AS objective, macro_f1, false_alarm, sanity_false_alarm
    FROM m WHERE sanity_false_alarm <= 0.05 ORDER BY objective DESC, macro_f1 DESC, false_alarm, sanity_false_alarm, i, j LIMIT 1""")
def tune_states(spark, sf_dir):
    rows = _states(spark, sf_dir)
    return diagnosis.tune_states(rows.where("split <> 0"), sanity=rows.where("split = 0 AND gold_phone_state = 'correct'"))


@query("deletion_features", """WITH w AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS m, l_linestatus = 'O' AS g, l_quantity, l_extendedprice, CASE WHEN l_linestatus = 'O' THEN l_returnflag ELSE l_returnflag || chr(39) || l_linestatus END AS word FROM lineitem)
    SELECT l_orderkey, l_linenumber, m::INTEGER::DOUBLE AS asr_missing_word, g::INTEGER::DOUBLE AS ctc_greedy_missing_word, greatest(least(l_extendedprice / 1000 - 40, 30), -30) AS ctc_deletion_margin, (m AND g)::INTEGER::DOUBLE AS recognizer_deletion_agreement,
        length(replace(word, chr(39), ''))::DOUBLE AS word_length, round(l_linenumber / greatest(max(l_linenumber) OVER (PARTITION BY l_orderkey), 1), 9) AS relative_word_position, (word = 'A')::INTEGER::DOUBLE AS is_function_word FROM w""")
def deletion_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_orderkey").alias("utterance_id"), F.col("l_linenumber").alias("word_index"), F.when(F.col("l_linestatus") == "O", F.col("l_returnflag")).otherwise(F.concat_ws("'", "l_returnflag", "l_linestatus")).alias("word"),
        (F.col("l_returnflag") == "R").alias("asr_missing_word"), (F.col("l_linestatus") == "O").alias("ctc_greedy_missing_word"), (F.col("l_extendedprice") / 1000 - 40).alias("ctc_deletion_margin"),
    )
    kept = ("asr_missing_word", "ctc_greedy_missing_word", "ctc_deletion_margin", "recognizer_deletion_agreement", "word_length", "is_function_word")
    return diagnosis.deletion_features(rows).select("l_orderkey", "l_linenumber", *kept, F.round("relative_word_position", 9).alias("relative_word_position"))


@query("diagnose_words", f"""WITH {_EVIDENCE} SELECT o_orderkey, CASE WHEN lexicon_status = 'failed' THEN 'g2p_issue' WHEN deletion_decision = 'deletion' THEN 'deletion' WHEN deletion_decision = 'possible_deletion' OR asr_missing_word THEN 'possible_deletion'
    WHEN sub THEN 'substituted_word' WHEN deletion_decision = 'alignment_issue' OR alignment_quality = 'bad' THEN 'alignment_issue' ELSE 'correct' END AS final_word_decision FROM v""")
def diagnose_words(spark, sf_dir):
    words = _deletions(spark, sf_dir).drop("deletion_decision", "deletion_score")
    recogniser = words.select("o_orderkey", "asr_missing_word", "asr_missing_confidence", "asr_substituted_word")
    ctc = words.select("o_orderkey", "ctc_deletion_available", "ctc_deletion_score")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("phone_index"), F.lit("AH").alias("target_phone"))
    bare = words.drop("asr_missing_word", "asr_missing_confidence", "asr_substituted_word", "ctc_deletion_available", "ctc_deletion_score")
    return diagnosis.diagnose_words(rows, bare, ["o_orderkey"], recogniser=recogniser, ctc=ctc).select("o_orderkey", "final_word_decision")


@query("final_prediction", f"""WITH {PHONES}, i AS (SELECT utterance_id, word_index, NOT (status = 'F' AND duration_ms < 3) AS good, prob_correct AS r, error_score AS c, round(duration_ms / 50, 6) AS w, gold = 1 AS likely, status = 'O' AS variant, split = 1 AS failed FROM phones),
    j AS (SELECT *, good AND r >= 0.75 AS ok FROM i), k AS (SELECT *, good AND NOT ok AND NOT variant AND w >= 0.9 AND c >= 0.7 AND r <= 0.4 AND likely AS err FROM j)
    SELECT utterance_id, word_index, CASE WHEN failed THEN 'uncertain_review' WHEN NOT good THEN 'uncertain_review' WHEN err THEN 'true_error' WHEN good AND NOT ok AND NOT variant AND w >= 0.6 THEN 'uncertain_review' WHEN ok THEN 'correct' WHEN variant THEN 'acceptable_accent' ELSE 'correct' END AS decision,
        CASE WHEN failed OR NOT good THEN 'bad' ELSE 'pass' END AS alignment_quality, '' AS speaker_id, failed AND true AS g2p FROM k""")
def final_prediction(spark, sf_dir):
    relation = F.when(F.col("status") == "O", "acceptable_variant").when(F.col("gold") == 1, "likely_true_error").otherwise("")
    rows = phones(spark, sf_dir).select(
        "utterance_id", "word_index", F.when((F.col("status") == "F") & (F.col("duration_ms") < 3), "bad").otherwise("pass").alias("alignment_quality"), "prob_correct", F.col("error_score").alias("confidence"),
        F.round(F.col("duration_ms") / 50, 6).alias("manual_calibrated_error_probability"), F.lit(True).alias("calibration_available"), relation.alias("phonological_relation"),
        F.when(F.col("split") == 1, "failed").otherwise("success").alias("g2p_status"),
    )
    found = diagnosis.final_prediction(rows)
    return found.select("utterance_id", "word_index", "decision", "alignment_quality", "speaker_id", (F.col("review_reason") == "g2p_failed").alias("g2p"))


@query("phones_ctc")
def phones_ctc(spark, sf_dir):
    """Frames of 8 logits from the vectors; the vocabulary is a blank, a gap and six symbols."""
    rows = table(spark, sf_dir, "embeddings")
    emissions = rows.select((F.col("vec_id") % 40).alias("utterance"), F.col("vec_id").alias("frame"), F.slice("embedding", 1, 8).cast("array<double>").alias("logits"))
    own = spark.range(45).select(F.col("id").alias("utterance"), F.posexplode(F.array(*[F.lit(p) for p in ("TH", "IH", "S", "Z", "EY", "B")])).alias("phone_index", "target_phone"))
    rows = own.withColumn("word_index", (F.col("phone_index") / 3).cast("int"))
    vocabulary = {" ": 1, "θ": 2, "ɪ": 3, "s": 4, "z": 5, "b": 6, "e": 7}
    return diagnosis.phones_ctc(emissions, rows, "utterance", {"TH": ["θ"], "IH": ["ɪ"], "S": ["s"], "Z": ["z"], "EY": ["e", "ɪ"], "B": ["b"]}, vocabulary)
