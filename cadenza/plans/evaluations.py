"""Queries of the evaluation reports, of conformance, and of functions that no other query reaches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, scalars
from ..operators import conformance, evaluation
from .registry import COUNTS, DERIVED, PHONES, _ratio, curve, phones, query, table

_AUC = f"""a AS (SELECT round({_ratio('sum(pos * (2 * (negatives - fp) + neg))', '2 * max(positives) * max(negatives)', '0.5')}, 6) AS auc, round({_ratio('sum(pos::DOUBLE * tp / (tp + fp))', 'max(positives)')}, 6) AS average_precision FROM points)"""
_FPR = f"round({_ratio('fp', 'fp + tn')}, 6) AS fpr"


@query("binary_report", f"WITH {PHONES}, c AS (SELECT phone_group, {COUNTS} FROM phones GROUP BY 1) SELECT *, {DERIVED}, {_FPR} FROM c")
def binary_report(spark, sf_dir):
    return evaluation.binary_report(phones(spark, sf_dir), "gold", F.col("decision"), ["phone_group"])


@query("threshold_report", f"WITH {PHONES}, {curve()}, {_AUC}, c AS (SELECT {COUNTS.replace('decision = 1', 'error_score >= 0.7').replace('decision = 0', 'error_score < 0.7')}, sum(gold)::BIGINT AS positives, (count(*) - sum(gold))::BIGINT AS negatives FROM phones) SELECT c.*, {DERIVED}, {_FPR}, auc, average_precision FROM c, a")
def threshold_report(spark, sf_dir):
    return evaluation.threshold_report(phones(spark, sf_dir), "gold", "error_score", 0.7)


@query("objective_at", f"WITH {PHONES}, c AS (SELECT {COUNTS.replace('decision = 1', 'error_score >= 0.3').replace('decision = 0', 'error_score < 0.3')} FROM phones), d AS (SELECT {DERIVED} FROM c) SELECT macro_f1 FROM d")
def objective_at(spark, sf_dir):
    return evaluation.objective_at(phones(spark, sf_dir), "gold", "error_score", 0.3, "macro_f1")


_SIDES = "g AS (SELECT returnflag, l_returnflag AS gold, CASE WHEN l_quantity > 30 THEN 'A' WHEN l_quantity > 10 THEN 'N' ELSE 'R' END AS said FROM (SELECT *, l_returnflag AS returnflag FROM lineitem))"


@query("class_report", f"""WITH {_SIDES}, l AS (SELECT unnest(['A', 'N', 'R']) AS label), c AS (SELECT label, count(*) FILTER (gold = label) AS support, count(*) FILTER (said = label) AS n, count(*) FILTER (gold = label AND said = label) AS hit FROM g, l GROUP BY 1),
    m AS (SELECT label, round({_ratio('hit', 'n')}, 6) AS "precision", round({_ratio('hit', 'support')}, 6) AS recall, round({_ratio('2 * hit', 'n + support')}, 6) AS f1, support::BIGINT AS support FROM c)
    SELECT * FROM m UNION ALL SELECT 'macro', round(avg("precision"), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM m""")
def class_report(spark, sf_dir):
    said = F.when(F.col("l_quantity") > 30, "A").when(F.col("l_quantity") > 10, "N").otherwise("R")
    return evaluation.class_report(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("gold"), said.alias("said")), "gold", "said").select("label", "precision", "recall", "f1", "support")


@query("decision_set_report", f"WITH o AS (SELECT o_custkey % 2 AS gold, (o_orderpriority IN ('1-URGENT', '2-HIGH'))::INTEGER AS decision, o_orderstatus FROM orders), c AS (SELECT o_orderstatus, {COUNTS} FROM o GROUP BY 1) SELECT *, {DERIVED}, {_FPR} FROM c")
def decision_set_report(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("gold", F.col("o_custkey") % 2)
    return evaluation.decision_set_report(rows, "gold", "o_orderpriority", ["1-URGENT", "2-HIGH"], ["o_orderstatus"])


_REVIEWED = """r AS (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'bad_alignment' WHEN 1 THEN 'acceptable_accent' WHEN 2 THEN 'deletion' WHEN 3 THEN 'correct' ELSE 'true_error' END AS l,
    CASE WHEN o_orderpriority = '1-URGENT' THEN 'true_error' WHEN o_orderpriority = '5-LOW' THEN 'uncertain_review' ELSE 'correct' END AS d, o_orderstatus = 'F' AS failed FROM orders)"""


def _reviewed(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("bad_alignment", "acceptable_accent", "deletion", "correct", "true_error")])
    said = F.when(F.col("o_orderpriority") == "1-URGENT", "true_error").when(F.col("o_orderpriority") == "5-LOW", "uncertain_review").otherwise("correct")
    return table(spark, sf_dir, "orders").select(
        names[(F.col("o_orderkey") % 5).cast("int")].alias("manual_review_label"), said.alias("decision"), F.when(F.col("o_orderstatus") == "F", "Bad").otherwise("pass").alias("alignment_quality")
    )


@query("headline_rates", f"""WITH {_REVIEWED}, c AS (SELECT count(*) AS matched_rows, count(*) FILTER (l <> 'bad_alignment') AS scored_rows, count(*) FILTER (l = 'bad_alignment') AS bad_alignment_rows, count(*) FILTER (l IN ('deletion', 'true_error') AND d = 'true_error') AS tp,
    count(*) FILTER (l IN ('correct', 'acceptable_accent') AND d = 'true_error') AS fp, count(*) FILTER (l IN ('deletion', 'true_error') AND d <> 'true_error') AS fn, count(*) FILTER (l = 'bad_alignment' AND d = 'true_error') AS bad_alignment_errors,
    count(*) FILTER (l = 'acceptable_accent' AND d = 'true_error') AS accent_errors, count(*) FILTER (l = 'acceptable_accent') AS accents, count(*) FILTER (failed) AS failed, count(*) FILTER (d = 'uncertain_review') AS review FROM r)
    SELECT * EXCLUDE (accents, failed, review), round({_ratio('tp', 'tp + fp')}, 6) AS "precision", round({_ratio('tp', 'tp + fn')}, 6) AS recall, round({_ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1, round({_ratio('accent_errors', 'accents')}, 6) AS accent_error_rate,
        round({_ratio('failed', 'matched_rows')}, 6) AS alignment_failure_rate, round({_ratio('review', 'matched_rows')}, 6) AS review_rate FROM c""")
def headline_rates(spark, sf_dir):
    return evaluation.headline_rates(_reviewed(spark, sf_dir))


@query("value_counts", f"WITH {_REVIEWED} SELECT 'decision' AS \"column\", d AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'manual_review_label', l, count(*) FROM r GROUP BY 2")
def value_counts(spark, sf_dir):
    return evaluation.value_counts(_reviewed(spark, sf_dir), ["decision", "manual_review_label"])


def _described(c: str) -> str:
    q = ", ".join(f"round(quantile_cont({c}, {p}), 6) AS q{int(p * 100)}" for p in (0.25, 0.5, 0.75))
    return f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c})::DOUBLE AS least, {q}, max({c})::DOUBLE AS greatest, count(*) FILTER ({c} IS NULL) AS without FROM lineitem"


@query("describe", f"{_described('l_quantity')} UNION ALL {_described('l_discount')}")
def describe(spark, sf_dir):
    return evaluation.describe(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])


@query("correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS pcc FROM lineitem GROUP BY 1")
def correlation(spark, sf_dir):
    return evaluation.correlation(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])


@query("alarms_by", f"WITH {PHONES} SELECT target_phone, phone_group, count(*) AS fp, round(avg(error_score), 6) AS mean_score FROM phones WHERE gold = 0 AND error_score >= 0.8 GROUP BY 1, 2")
def alarms_by(spark, sf_dir):
    return evaluation.alarms_by(phones(spark, sf_dir), "gold", F.col("error_score") >= 0.8, "error_score", ["target_phone", "phone_group"])


@query("sanity_report", "SELECT count(*) AS rows, round(count(*) FILTER (o_orderstatus <> 'O')::DOUBLE / count(*), 6) AS false_alarm_rate, count(DISTINCT o_orderstatus) AS states FROM orders")
def sanity_report(spark, sf_dir):
    return evaluation.sanity_report(table(spark, sf_dir, "orders"), "o_orderstatus", "O").select("rows", "false_alarm_rate", F.size("counts").cast("long").alias("states"))


@query("mean_of_valid", "SELECT l_orderkey, coalesce(round(avg(l_discount - 0.05) FILTER (l_discount - 0.05 >= 0), 6), -1) AS score FROM lineitem GROUP BY 1")
def mean_of_valid(spark, sf_dir):
    return evaluation.mean_of_valid(table(spark, sf_dir, "lineitem").withColumn("score", F.col("l_discount") - 0.05), "score", ["l_orderkey"])


@query("split_counts", "SELECT o_custkey % 3 AS split, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2")
def split_counts(spark, sf_dir):
    return evaluation.split_counts(table(spark, sf_dir, "orders").withColumn("split", F.col("o_custkey") % 3), "split", "o_orderstatus")


# ---------------------------------------------------------------- conformance


@query("recogniser_columns", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'not_checked' ELSE o_orderpriority END AS asr_edit_op, false AS asr_missing_word, 0.0::DOUBLE AS asr_confidence, o_orderstatus AS asr_transcript, 'checked' AS text_audio_consistency_status FROM orders")
def recogniser_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("asr_edit_op", F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")))
    found = conformance.with_recogniser_columns(rows, F.col("o_orderstatus"), True)
    return found.select("o_orderkey", "asr_edit_op", "asr_missing_word", "asr_confidence", "asr_transcript", "text_audio_consistency_status")


@query("good_alignment", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, lower(CASE WHEN o_orderstatus = 'F' THEN o_orderpriority ELSE ' Pass ' END) = ' pass ' AS good FROM orders GROUP BY ALL")
def good_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("q", F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).otherwise(" Pass "))
    return rows.groupBy("o_orderstatus", "o_orderpriority", conformance.is_good_alignment("q").alias("good")).agg(F.count(F.lit(1)).alias("n"))


@query("not_checked", "SELECT o_orderkey, 0 AS word_index, 'BIG' AS word, 'not_checked' AS asr_edit_op, false AS text_audio_mismatch FROM orders UNION ALL SELECT o_orderkey, 1, o_orderkey::VARCHAR, 'not_checked', false FROM orders")
def not_checked(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" Big,"), F.col("o_orderkey").cast("string")).alias("said"))
    return conformance.not_checked(rows, "o_orderkey", "said").select("o_orderkey", "word_index", "word", "asr_edit_op", "text_audio_mismatch")


@query("row_key", "SELECT l_orderkey::VARCHAR || '||' || l_linestatus || '||||' || l_returnflag || '||' || printf('%.3f', l_quantity / 3) || '||' AS key FROM lineitem")
def row_key(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("utterance_id"), F.col("l_linestatus").alias("speaker_id"), F.col("l_returnflag").alias("target_phone"), (F.col("l_quantity") / 3).alias("start_ms"))
    return rows.select(conformance.row_key(rows).alias("key"))


@query("side_by_side", """WITH a AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS p FROM lineitem),
    b AS (SELECT l_orderkey, l_linenumber AS other, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) AS p FROM lineitem WHERE l_quantity > 10) SELECT l_orderkey, l_linenumber, other FROM a JOIN b USING (l_orderkey, p)""")
def side_by_side(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    right = rows.where("l_quantity > 10").select("l_orderkey", F.col("l_linenumber").alias("other"), "l_quantity")
    return conformance.side_by_side(rows.drop("l_quantity"), right, ["l_linenumber"], [F.desc("l_quantity"), "other"], ["l_orderkey"]).select("l_orderkey", "l_linenumber", "other")


@query("correct_rows", f"WITH {PHONES} SELECT target_phone, count(*) FILTER (gold = 0) AS n FROM phones GROUP BY 1")
def correct_rows(spark, sf_dir):
    rows = phones(spark, sf_dir).withColumnRenamed("gold", "label")
    return rows.groupBy("target_phone").agg(F.count_if(conformance.correct_rows(rows)).alias("n"))


@query("usable_phones", "SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AND l_quantity >= 12 AND l_linenumber <> 1 AS usable FROM lineitem")
def usable_phones(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumn("valid", F.col("l_linestatus") == "O")
    return rows.select("l_orderkey", "l_linenumber", conformance.usable_phones(rows, "valid", "l_linenumber", "l_quantity", 12.0).alias("usable"))


_PHONE_OF = ["TH", "R1", "aa0", "V*", "IH", "ZZ"]
_PHONE_CASE = "CASE l_partkey % 6 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(["TH", "R", "AA", "V", "IH", "ZZ"])) + " END"


def _phone_rows(spark, sf_dir):
    listed = F.array(*[F.lit(p) for p in _PHONE_OF])
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_tax", listed[(F.col("l_partkey") % 6).cast("int")].alias("target_phone"))


@query("phone_attributes", f"""WITH p AS (SELECT {_PHONE_CASE} AS p, l_linenumber = 1 AS last FROM lineitem), a AS (SELECT p, p = 'TH' AND last AS f, CASE p WHEN 'TH' THEN 'consonant' WHEN 'AA' THEN 'vowel' ELSE 'unknown' END AS c, CASE WHEN p = 'AA' THEN 'true' ELSE 'false' END AS voiced,
    CASE p WHEN 'AA' THEN 'ɑ' WHEN 'IH' THEN 'ɪ' ELSE '' END AS symbols FROM p) SELECT '{{"final_consonant":"' || f::VARCHAR || '","phone":"' || p || '","voiced":"' || voiced || '","vowel_consonant":"' || c || '"}}' AS attributes, symbols, count(*) AS n FROM a GROUP BY ALL""")
def phone_attributes(spark, sf_dir):
    known = {"TH": {"vowel_consonant": "consonant"}, "AA": {"vowel_consonant": "vowel", "voiced": "true"}}
    own = conformance.attributes("target_phone", known, ["voiced"], F.col("l_linenumber") == 1)
    symbols = F.array_join(conformance.phone_symbols("target_phone", {"AA": ["ɑ"], "IH": ["ɪ"]}), " ")
    rows = _phone_rows(spark, sf_dir).select(conformance.serialised(own).alias("attributes"), symbols.alias("symbols"))
    return rows.groupBy("attributes", "symbols").agg(F.count(F.lit(1)).alias("n"))


@query("confusable_phones", f"WITH p AS (SELECT {_PHONE_CASE} AS p FROM lineitem), c(p, n) AS (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {len(v)})' for k, v in scalars.CONFUSIONS.items())}) SELECT p AS phone, coalesce(max(c.n), 0)::INTEGER AS others FROM p LEFT JOIN c USING (p) GROUP BY 1")
def confusable_phones(spark, sf_dir):
    return _phone_rows(spark, sf_dir).select(scalars.phone("target_phone").alias("phone"), F.size(conformance.confusable("target_phone")).alias("others")).distinct()


@query("evidence_text", """SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' THEN 'Alignment failed; CTC phone model unavailable: none' WHEN l_linestatus = 'F' THEN 'none'
    ELSE 'state=deleted; recognized=' || l_returnflag || '; reference_recognized=; deletion_margin=' || printf('%.3f', l_quantity / 8) || '; reference_deletion_margin=nan; substitution_margin=nan; logit_margin=nan' END AS evidence FROM lineitem""")
def evidence_text(spark, sf_dir):
    failed = F.col("l_linestatus") == "F"
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(failed, "unavailable").otherwise("deleted").alias("phone_state"), F.col("l_returnflag").alias("recognized_phone"), (F.col("l_quantity") / 8).alias("ctc_deletion_margin"),
        F.when(F.col("l_returnflag") == "R", "alignment_issue").otherwise("").alias("phone_error_type"), F.lit("none").alias("ctc_phone_error"), F.lit(None).cast("double").alias("ctc_logit_margin"),
    )
    return rows.select("l_orderkey", "l_linenumber", conformance.evidence_text(rows).alias("evidence"))


@query("insertion_words", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber = 2 THEN 5 WHEN l_linenumber = 3 THEN 6 ELSE 9 END AS word FROM lineitem")
def insertion_words(spark, sf_dir):
    units = F.array(F.lit(5), F.lit(6), F.lit(9))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", conformance.insertion_word(F.col("l_linenumber") - 1, units).alias("word"))


@query("find_utterance", "SELECT count(*) AS n FROM customer WHERE c_custkey % 7 = 3")
def find_utterance(spark, sf_dir):
    path = F.concat(F.lit("/Data/"), (F.col("c_custkey") % 3).cast("string"), F.lit("/U"), (F.col("c_custkey") % 7).cast("string"), F.lit(".WAV"))
    rows = table(spark, sf_dir, "customer").select(path.alias("audio_path"), F.col("c_custkey").alias("utterance_id"))
    return conformance.find_utterance(rows, audio="/other/u3.wav").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- feature and label tables


@query("feature_frame", "SELECT vec_id, label::INTEGER AS label, round(embedding[1]::DOUBLE, 6) AS w2v_0, round(embedding[3]::DOUBLE, 6) AS w2v_2 FROM embeddings WHERE vec_id % 10 >= 4")
def feature_frame(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    meta = rows.select("vec_id", "label", (F.col("vec_id") % 10 / 10).alias("duration"))
    found = conformance.feature_frame(rows, meta, "vec_id", "embedding", 3, 0.4)
    return found.select("vec_id", "label", F.round("w2v_0", 6).alias("w2v_0"), F.round("w2v_2", 6).alias("w2v_2"))


@query("without_features", "SELECT l_orderkey, l_linenumber, 0.0::DOUBLE AS gop_score, 0.0::DOUBLE AS l_tax, l_discount FROM lineitem")
def without_features(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("gop_score"), "l_tax", "l_discount")
    return conformance.without_features(rows, ["l_tax"])


@query("imported_features", "SELECT o_orderkey, o_totalprice AS numeric, o_orderstatus AS mask FROM orders")
def imported_features(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    official = rows.select("o_orderkey", F.col("o_totalprice").alias("features"), F.col("o_orderstatus").alias("mask"))
    template = rows.select("o_orderkey", F.lit(0.0).alias("numeric"), F.lit("").alias("mask"))
    return conformance.imported_features(official, template, ["o_orderkey"], carried=["mask"])


@query("word_labels", """WITH w AS (SELECT l_orderkey, list(round(l_quantity / 25, 3) ORDER BY l_linenumber, l_quantity) AS s FROM lineitem GROUP BY 1)
    SELECT l_orderkey, array_to_string(list_transform(s, lambda x: printf('%.3f', x)), ' ') AS phone_scores, len(s)::INTEGER AS phone_count, len(list_filter(s, lambda x: x >= 1.5))::INTEGER AS score_2_count,
        len(list_filter(s, lambda x: x >= 0.5 AND x < 1.5))::INTEGER AS score_1_count, len(list_filter(s, lambda x: x < 0.5))::INTEGER AS score_0_count FROM w""")
def word_labels(spark, sf_dir):
    ordered = F.array_sort(F.collect_list(F.struct("l_linenumber", F.round(F.col("l_quantity") / 25, 3).alias("s"))))
    words = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(ordered, lambda x: x["s"]).alias("scores"))
    return conformance.word_labels(words).drop("scores")


@query("unlabelled_manifest", f"SELECT l_orderkey::VARCHAR AS utt_id, trim(upper({_PHONE_CASE.replace(chr(39) + 'R' + chr(39), chr(39) + 'R1' + chr(39)).replace(chr(39) + 'AA' + chr(39), chr(39) + 'AA0' + chr(39)).replace(chr(39) + 'V' + chr(39), chr(39) + 'V*' + chr(39))})) AS target_phone, round(l_quantity / 7, 6) AS duration, -1 AS label, 'predict' AS split, '' AS word FROM lineitem")
def unlabelled_manifest(spark, sf_dir):
    rows = _phone_rows(spark, sf_dir).withColumns({"start": F.col("l_tax"), "end": F.col("l_tax") + F.col("l_quantity") / 7})
    found = conformance.unlabelled_manifest(rows, F.col("l_orderkey").cast("string"), F.lit("s"), F.lit("a.wav"))
    return found.select("utt_id", "target_phone", F.round("duration", 6).alias("duration"), "label", "split", "word")


@query("equal_segments", "SELECT o_orderkey, i AS phone_index, ['TH', 'IH', 'S'][i + 1] AS target_phone, round(i * o_totalprice / 3, 3) AS start_ms, round((i + 1) * o_totalprice / 3, 3) AS end_ms FROM orders, (VALUES (0), (1), (2)) v(i)")
def equal_segments(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumn("p", F.lit("th, IH0,,S*"))
    return conformance.equal_segments(rows, "o_orderkey", "p", "o_totalprice").select("o_orderkey", "phone_index", "target_phone", "start_ms", "end_ms")


@query("chosen_thresholds", "SELECT CASE WHEN n_regionkey = 0 THEN 'global' ELSE 'target_phone' END AS level, CASE WHEN n_regionkey = 0 THEN '' ELSE n_nationkey::VARCHAR END AS key, n_nationkey / 100 AS threshold FROM nation WHERE n_nationkey % 2 = 0")
def chosen_thresholds(spark, sf_dir):
    level = F.when(F.col("n_regionkey") == 0, "global").otherwise("target_phone")
    rows = table(spark, sf_dir, "nation").select(level.alias("level"), F.col("n_nationkey").alias("key"), (F.col("n_nationkey") / 100).alias("threshold"), F.when(F.col("n_nationkey") % 2 == 0, "m").otherwise("x").alias("model"), F.lit("raw").alias("calibration"))
    return conformance.chosen_thresholds(rows, "m", "raw")


@query("candidates", f"WITH {PHONES} SELECT split, count(*) AS n, count(*) FILTER (error_score >= 0.6) AS chosen FROM phones GROUP BY 1")
def candidates(spark, sf_dir):
    rows = conformance.candidates(phones(spark, sf_dir).withColumnRenamed("error_score", "candidate_score"), 0.6, "aggressive")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("candidate_label") == 1).alias("chosen"))


@query("deletions_to_make", """WITH w AS (SELECT o_custkey, l_orderkey, l_linenumber AS word_index FROM lineitem JOIN orders ON l_orderkey = o_orderkey), u AS (SELECT DISTINCT o_custkey, l_orderkey FROM w QUALIFY dense_rank() OVER (PARTITION BY o_custkey ORDER BY sha256('7:' || l_orderkey), l_orderkey) <= 2)
    SELECT o_custkey, l_orderkey, word_index FROM w JOIN u USING (o_custkey, l_orderkey) QUALIFY row_number() OVER (PARTITION BY o_custkey, l_orderkey ORDER BY sha256('7:' || l_orderkey || ':' || word_index), word_index) <= 1""")
def deletions_to_make(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", F.col("l_linenumber").alias("word_index"))
    return conformance.deletions_to_make(rows, "o_custkey", "l_orderkey", 2, 1, 7)


# ---------------------------------------------------------------- functions


@query("phone_functions", f"""WITH p AS (SELECT {_PHONE_CASE} AS p, l_quantity FROM lineitem) SELECT p AS phone, CASE p WHEN 'AA' THEN 'vowel' WHEN 'IH' THEN 'vowel' WHEN 'TH' THEN 'fricative' WHEN 'V' THEN 'fricative' WHEN 'R' THEN 'liquid' ELSE 'other' END AS phone_group,
    count(*) AS n, round(sum(1 / (1 + exp(-greatest(least(l_quantity - 25, 30), -30)))), 5) AS s FROM p GROUP BY 1, 2""")
def phone_functions(spark, sf_dir):
    rows = _phone_rows(spark, sf_dir)
    return rows.groupBy(scalars.phone("target_phone").alias("phone"), scalars.phone_group("target_phone").alias("phone_group")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(scalars.sigmoid(F.col("l_quantity") - 25)), 5).alias("s"))


@query("vocabulary", "WITH v AS (SELECT DISTINCT p_brand AS token FROM part) SELECT '<pad>' AS token, 0 AS id UNION ALL SELECT '<unk>', 1 UNION ALL SELECT token, (row_number() OVER (ORDER BY token) + 1)::INTEGER FROM v")
def vocabulary(spark, sf_dir):
    return lexicon.vocabulary(table(spark, sf_dir, "part"), "p_brand")


@query("file_stems", "SELECT DISTINCT left(regexp_replace(p_name, '[^A-Za-z0-9.\\-]+', '_', 'g'), 80) AS stem FROM part")
def file_stems(spark, sf_dir):
    return table(spark, sf_dir, "part").select(scalars.file_stem("p_name").alias("stem")).distinct()
