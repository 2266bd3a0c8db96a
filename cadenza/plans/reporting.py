"""Queries of the diagnostic tables and of functions on labels, words and phones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels, scalars
from ..operators import decisions, metrics, projections, reports, thresholds
from .registry import COUNTS, DERIVED, PHONES, _ratio, phones, query, table

_REVIEWS = """r AS (SELECT o_orderpriority, o_orderstatus = 'F' AS e, CASE o_custkey % 4 WHEN 0 THEN 'acceptable_accent' WHEN 1 THEN 'correct' WHEN 2 THEN 'bad_alignment' ELSE 'true_error' END AS l, o_totalprice / 1e6 AS s FROM orders),
    t AS (SELECT o_orderpriority, count(*) AS reviewed_count, sum(e::INTEGER)::BIGINT AS manual_true_error_count, (count(*) - sum(e::INTEGER))::BIGINT AS manual_non_error_count, count(*) FILTER (l = 'acceptable_accent') AS acceptable_accent_count,
        count(*) FILTER (l = 'correct') AS correct_count, count(*) FILTER (l = 'bad_alignment') AS bad_alignment_count, round(avg(s), 6) AS mean_final_error_score, round(avg(e::INTEGER), 6) AS manual_precision FROM r GROUP BY 1)"""


def _reviews(spark, sf_dir):
    said = F.array(*[F.lit(x) for x in ("acceptable_accent", "correct", "bad_alignment", "true_error")])
    rows = table(spark, sf_dir, "orders").select(
        "o_orderpriority", (F.col("o_orderstatus") == "F").cast("int").alias("manual_is_error"), said[(F.col("o_custkey") % 4).cast("int")].alias("manual_review_label"), (F.col("o_totalprice") / 1e6).alias("final_error_score")
    )
    return reports.review_table(rows, "o_orderpriority")


@query("review_table", f"WITH {_REVIEWS} SELECT * FROM t")
def review_table(spark, sf_dir):
    return _reviews(spark, sf_dir)


@query("downgrades", f"WITH {_REVIEWS} SELECT 'o_orderpriority' AS rule_type, o_orderpriority AS key, reviewed_count, manual_precision, 'downgrade_high_confidence_to_uncertain_review' AS recommended_action FROM t WHERE reviewed_count >= 20 AND manual_precision < 0.5")
def downgrades(spark, sf_dir):
    return reports.downgrades(_reviews(spark, sf_dir), "o_orderpriority", 20, 0.5)


def _summary(c: str) -> str:
    return f"""SELECT '{c}' AS score, count({c}) AS n, count(DISTINCT {c}) AS distinct_values, min({c})::DOUBLE AS least, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75,
        max({c})::DOUBLE AS greatest, round(avg({c}), 6) AS mean, count(DISTINCT {c}) = 1 AND count({c}) > 1 AS "constant" FROM lineitem"""


@query("score_summary", f"{_summary('l_quantity')} UNION ALL {_summary('l_discount')}")
def score_summary(spark, sf_dir):
    return reports.score_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])


@query("duration_priors", f"WITH {PHONES} SELECT target_phone, median(duration_ms) AS median_ms, count(*) AS n FROM phones WHERE split = 0 GROUP BY 1")
def duration_priors(spark, sf_dir):
    return reports.duration_priors(phones(spark, sf_dir), "target_phone", "duration_ms", F.col("split") == 0)


@query("boundary_errors", """WITH e AS (SELECT abs(l_quantity * 3 - l_discount * 1000) AS e FROM lineitem) SELECT count(*) AS boundaries, round(median(e), 6) AS median_ms, round(quantile_cont(e, 0.75), 6) AS p75_ms,
    round(avg((e <= 50)::INTEGER), 6) AS within_50_ms, round(avg((e <= 100)::INTEGER), 6) AS within_100_ms FROM e""")
def boundary_errors(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") * 3).alias("a"), (F.col("l_discount") * 1000).alias("b"))
    return reports.boundary_errors(rows, "a", "b")


@query("alignment_failures", """SELECT l_returnflag, count(*) AS rows, count(*) FILTER (l_linestatus = 'F') AS failed, count(*) FILTER (l_linestatus <> 'F' AND l_quantity > 40) AS suspect, count(*) FILTER (l_tax = 0) AS missing_boundaries FROM lineitem GROUP BY 1""")
def alignment_failures(spark, sf_dir):
    quality = F.when(F.col("l_linestatus") == "F", "Failed").when(F.col("l_quantity") > 40, "suspect").otherwise("pass")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", quality.alias("alignment_quality"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("start_ms"), F.col("l_quantity").alias("end_ms"))
    return reports.alignment_failures(rows, ["l_returnflag"])


@query("deletion_policies", f"WITH {PHONES} SELECT p AS policy, count(*) FILTER (gold = 1 AND h) AS tp, count(*) FILTER (gold = 0 AND h) AS fp, count(*) FILTER (gold = 1 AND NOT h) AS fn FROM (SELECT 'score' AS p, gold, error_score >= 0.7 AS h FROM phones UNION ALL SELECT 'short', gold, duration_ms < 10 FROM phones) GROUP BY 1")
def deletion_policies(spark, sf_dir):
    return reports.deletion_policies(phones(spark, sf_dir), F.col("gold") == 1, {"score": F.col("error_score") >= 0.7, "short": F.col("duration_ms") < 10})


@query("corpus_counts", "SELECT o_orderstatus, count(*) AS rows, count(DISTINCT o_custkey) AS speakers FROM orders GROUP BY 1")
def corpus_counts(spark, sf_dir):
    return reports.corpus_counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


@query("worst_cases", f"WITH {PHONES} SELECT utterance_id, word_index, phone_index, error_score FROM phones WHERE gold = 0 AND decision = 1 ORDER BY error_score DESC, utterance_id, word_index, phone_index, duration_ms LIMIT 300")
def worst_cases(spark, sf_dir):
    found = reports.worst_cases(phones(spark, sf_dir), "gold", "decision", "error_score", ["utterance_id", "word_index", "phone_index", "duration_ms"])
    return found.select("utterance_id", "word_index", "phone_index", "error_score")


@query("decision_counts", f"WITH {PHONES}, c AS (SELECT phone_group, {COUNTS.replace('decision = 1', 'error_score >= 0.4').replace('decision = 0', 'error_score < 0.4')} FROM phones GROUP BY 1) SELECT *, {DERIVED} FROM c")
def decision_counts(spark, sf_dir):
    return thresholds.decision_counts(phones(spark, sf_dir), ["phone_group"], "gold", "error_score", 0.4)


@query("cascade_scores", "SELECT l_orderkey, l_linenumber, l_suppkey, max((l_quantity > 30)::INTEGER) AS candidate_label, max(CASE WHEN l_quantity > 30 THEN l_tax ELSE 0 END) AS cascade_score FROM lineitem GROUP BY ALL HAVING count(*) = 1")
def cascade_scores(spark, sf_dir):
    keys = ["l_orderkey", "l_linenumber", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem")
    single = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"), F.max("l_tax").alias("verifier_score")).where("n = 1")
    return projections.cascade_scores(single.select(*keys), single.where("q > 30"), keys)


@query("diverse_words", """WITH w AS (SELECT l_orderkey, upper(l_returnflag || l_linestatus) AS w, min(l_quantity) AS i FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN w = 'NO' THEN 0 ELSE 1 END, i, w) AS r FROM w)
    SELECT l_orderkey, count(*) AS n, count(*) FILTER (w = 'NO') AS first FROM r WHERE r <= 2 GROUP BY 1""")
def diverse_words(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.concat("l_returnflag", "l_linestatus").alias("word"))
    found = projections.diverse_words(rows, "l_orderkey", "l_quantity", "word", ["NO"], 2)
    return found.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("word") == "NO").alias("first"))


@query("word_verdicts", """SELECT l_orderkey, CASE WHEN bool_or(l_linestatus = 'F') THEN 'bad' WHEN bool_or(l_quantity > 45) THEN 'suspect' ELSE 'pass' END AS alignment_quality,
    CASE WHEN bool_or(l_returnflag = 'R') THEN 'true_error' WHEN bool_or(l_returnflag = 'A') THEN 'uncertain_review' ELSE 'correct' END AS word_decision FROM lineitem GROUP BY 1""")
def word_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linestatus") == "F", "BAD").when(F.col("l_quantity") > 45, "suspect").otherwise("good").alias("alignment_quality"),
        F.when(F.col("l_returnflag") == "R", "true_error").when(F.col("l_returnflag") == "A", "uncertain_review").otherwise("correct").alias("decision"),
    )
    return rows.groupBy("l_orderkey").agg(decisions.worst_alignment().alias("alignment_quality"), decisions.word_decision("decision").alias("word_decision"))


@query("label_functions", """SELECT CASE o_shippriority + o_custkey % 3 WHEN 2 THEN 'correct' WHEN 1 THEN 'acceptable_accent' ELSE 'error' END AS three, ((o_shippriority + o_custkey % 3) = 0)::INTEGER AS missed, ((o_shippriority + o_custkey % 3) <> 2)::INTEGER AS strict, (o_orderstatus = 'F')::INTEGER AS error, count(*) AS n
    FROM (SELECT *, 0 AS o_shippriority FROM orders) GROUP BY ALL""")
def label_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").withColumns({"s": F.col("o_custkey") % 3, "is_correct": F.when(F.col("o_orderstatus") == "F", "0").otherwise("1")})
    kinds = [scalars.score_label(F.col("s"), m).alias(n) for m, n in (("three_class", "three"), ("binary_recognition", "missed"), ("strict_standardness", "strict"))]
    return rows.groupBy(*kinds, labels.error_label(rows, "is_correct").alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("phone_labels", """SELECT 'TH' AS target, CASE WHEN l_linestatus = 'O' THEN 'S' ELSE 'TH' END AS perceived, CASE WHEN l_linestatus = 'F' THEN 'correct' WHEN l_returnflag = 'R' THEN 'substitution' WHEN l_returnflag = 'A' THEN 'addition' ELSE 'other' END AS error_type,
    'TH IH S' AS phones, count(*) AS n FROM lineitem GROUP BY ALL""")
def phone_labels(spark, sf_dir):
    code = F.when(F.col("l_returnflag") == "R", "s").when(F.col("l_returnflag") == "A", "a").otherwise("x")
    label = F.when(F.col("l_linestatus") == "F", "th0").otherwise(F.concat(F.lit("TH, s* ,"), code))
    rows = table(spark, sf_dir, "lineitem").select(scalars.phone_label(label).alias("l"), F.array_join(scalars.phone_sequence(F.lit("th0, ih1 S*")), " ").alias("phones"))
    return rows.groupBy("l.target", "l.perceived", "l.error_type", "phones").agg(F.count(F.lit(1)).alias("n"))


@query("group_keys", "SELECT CASE o_orderstatus WHEN 'F' THEN 'vowel' WHEN 'O' THEN 'final_consonant' ELSE 'other' END AS k, round((ascii('A') + ascii('b')) % 29 / 29.0, 9)::DOUBLE AS h, count(*) AS n FROM orders GROUP BY ALL")
def group_keys(spark, sf_dir):
    named = F.when(F.col("o_orderstatus") == "F", " Vowels").when(F.col("o_orderstatus") == "O", "final_consonants").otherwise("Other")
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(scalars.group_key(named).alias("k"), F.round(scalars.code_point_hash(F.lit("Ab")), 9).alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("expanded_words", "SELECT o_orderkey, unnest(CASE WHEN o_orderstatus = 'F' THEN ['GOING', 'TO', 'F'] ELSE ['X', o_orderstatus] END) AS unit, unnest(CASE WHEN o_orderstatus = 'F' THEN [0, 0, 1] ELSE [0, 1] END) AS word_index FROM orders")
def expanded_words(spark, sf_dir):
    words = F.array(F.when(F.col("o_orderstatus") == "F", "GONNA").otherwise("X"), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.inline(scalars.expand(words, {"GONNA": ["GOING", "TO"]})))


@query("calibration_rows", f"""WITH {PHONES}, c AS (SELECT split, prob_correct, 1 - gold AS good, calibration, (prob_correct >= t)::INTEGER AS said FROM phones, (VALUES ('global', 0.5::DOUBLE), ('group', 0.2::DOUBLE), ('none', 2.0::DOUBLE)) v(calibration, t)),
    m AS (SELECT split, calibration, {COUNTS.replace("gold", "good").replace("decision", "said")} FROM c GROUP BY 1, 2), d AS (SELECT *, {DERIVED} FROM m),
    s AS (SELECT split, prob_correct AS p, sum(1 - gold) AS pos, sum(gold) AS neg FROM phones GROUP BY 1, 2),
    a AS (SELECT split, round({_ratio("sum(CASE WHEN b.p < s.p THEN s.pos * b.neg WHEN b.p = s.p THEN 0.5 * s.pos * b.neg ELSE 0 END)", "sum(s.pos * b.neg)", "0.5")}, 6) AS auc FROM s JOIN s b USING (split) GROUP BY 1)
    SELECT split, calibration, support AS n, accuracy, balanced_accuracy, "precision" AS precision_correct_class, recall AS recall_correct_class, macro_f1, auc, round({_ratio("tn", "tn + fn")}, 6) AS error_precision,
        round({_ratio("tn", "tn + fp")}, 6) AS error_recall, round({_ratio("2 * tn", "2 * tn + fp + fn")}, 6) AS error_f1, tn AS tn_error_predicted_error, fp AS fp_correct_predicted_error, fn AS fn_error_predicted_correct, tp AS tp_correct_predicted_correct
    FROM d JOIN a USING (split)""")  # fmt: skip
def calibration_rows(spark, sf_dir):
    """Both classes occur in every split, so macro F1 is over both; one class is tested apart."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("calibration"), F.lit(t).alias("t")) for n, t in (("global", 0.5), ("group", 0.2), ("none", 2.0))])).alias("c")
    rows = phones(spark, sf_dir).select("split", "prob_correct", (1 - F.col("gold")).alias("good"), each)
    rows = rows.select("split", "prob_correct", "good", "c.calibration", (F.col("prob_correct") >= F.col("c.t")).cast("int").alias("said"))
    return metrics.calibration_rows(rows, ["split", "calibration"], "good", "said", "prob_correct")
