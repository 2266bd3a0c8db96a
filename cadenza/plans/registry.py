"""The operators as queries over the driver's tables, with the SQL that must give the same rows.

Rows of `lineitem` stand for phones (with `part` for the phone and its group), `orders` for utterances.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..operators import decisions, evidence, joins, metrics, retrieval, sampling, thresholds, windows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

PHONES = """phones AS (
    SELECT l_orderkey AS utterance_id, l_linenumber AS word_index, l_suppkey AS phone_index, p_brand AS target_phone, p_type AS phone_group,
        round(l_discount * 10, 2) AS error_score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS gold,
        CASE WHEN round(l_discount * 10, 2) >= 0.5 THEN 1 ELSE 0 END AS decision,
        l_quantity AS duration_ms, round(1 - l_tax / 0.08, 6) AS prob_correct, l_linestatus AS status, l_orderkey % 3 AS split
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""
COUNTS = """count(*) FILTER (gold = 1 AND decision = 1) AS tp, count(*) FILTER (gold = 0 AND decision = 1) AS fp,
    count(*) FILTER (gold = 1 AND decision = 0) AS fn, count(*) FILTER (gold = 0 AND decision = 0) AS tn, count(*) AS support"""


def _ratio(a: str, b: str, default: str = "0.0") -> str:
    return f"(CASE WHEN ({b}) = 0 THEN {default}::DOUBLE ELSE ({a})::DOUBLE / ({b})::DOUBLE END)"


_RECALL = f"(CASE WHEN tp + fn = 0 THEN {_ratio('tn', 'tn + fp')} ELSE {_ratio('tp', 'tp + fn')} END)"
_SPECIFIC = f"(CASE WHEN tn + fp = 0 THEN {_ratio('tp', 'tp + fn')} ELSE {_ratio('tn', 'tn + fp')} END)"
DERIVED = f"""round({_ratio('tp', 'tp + fp')}, 6) AS "precision", round({_ratio('tp', 'tp + fn')}, 6) AS recall, round({_ratio('2 * tp', '2 * tp + fp + fn')}, 6) AS f1,
    round({_ratio('tp + tn', 'tp + fp + fn + tn')}, 6) AS accuracy, round(({_RECALL} + {_SPECIFIC}) / 2, 6) AS balanced_accuracy,
    round(({_ratio('2 * tp', '2 * tp + fp + fn')} + {_ratio('2 * tn', '2 * tn + fp + fn')}) / 2, 6) AS macro_f1"""
CURVE = f"""distinct_scores AS (
    SELECT {{keys}} error_score AS score, count(*) FILTER (gold = 1) AS pos, count(*) FILTER (gold = 0) AS neg FROM phones GROUP BY ALL
), curve AS (
    SELECT {{keys}} score AS threshold, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER g AS positives, sum(neg) OVER g AS negatives
    FROM distinct_scores WINDOW w AS ({{by}} ORDER BY score DESC ROWS UNBOUNDED PRECEDING), g AS ({{by}} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
), points AS (
    SELECT *, round({_ratio('tp', 'tp + fp')}, 9) AS prec, round({_ratio('tp', 'positives')}, 9) AS rec, round({_ratio('fp', 'negatives')}, 9) AS fpr FROM curve
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(F.col("l_discount") * 10, 2)
    return table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("utterance_id"), F.col("l_linenumber").alias("word_index"), F.col("l_suppkey").alias("phone_index"),
        F.col("p_brand").alias("target_phone"), F.col("p_type").alias("phone_group"), score.alias("error_score"),
        (F.col("l_returnflag") == "R").cast("int").alias("gold"), (score >= 0.5).cast("int").alias("decision"), F.col("l_quantity").alias("duration_ms"),
        F.round(1 - F.col("l_tax") / 0.08, 6).alias("prob_correct"), F.col("l_linestatus").alias("status"), (F.col("l_orderkey") % 3).alias("split"),
    )


def query(name: str, sql: str | None = None):
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql
        return function

    return add


def curve(keys: str = "") -> str:
    return CURVE.format(keys=f"{keys}, " if keys else "", by=f"PARTITION BY {keys}" if keys else "")


@query("grouped_metrics", f"WITH {PHONES}, c AS (SELECT target_phone, {COUNTS}, round(avg(error_score), 6) AS mean_error_score FROM phones GROUP BY 1) SELECT *, {DERIVED} FROM c")
def grouped_metrics(spark, sf_dir):
    return metrics.grouped_metrics(phones(spark, sf_dir), ["target_phone"], "gold", "decision", ["error_score"])


@query(
    "core_metrics",
    f"WITH {PHONES}, c AS (SELECT target_phone, {COUNTS} FROM phones WHERE target_phone IN ('Brand#11', 'Brand#22', 'Brand#33') GROUP BY 1) SELECT *, {DERIVED} FROM c",
)
def core_metrics(spark, sf_dir):
    core = phones(spark, sf_dir).where(F.col("target_phone").isin("Brand#11", "Brand#22", "Brand#33"))
    return metrics.grouped_metrics(core, ["target_phone"], "gold", "decision")


@query(
    "metrics_by_each_dimension",
    f"""WITH {PHONES}, c AS (
        SELECT target_phone, phone_group, status, {COUNTS} FROM phones GROUP BY GROUPING SETS ((target_phone), (phone_group), (status), ()))
    SELECT tp, fp, fn, tn, support, {DERIVED}, CASE WHEN target_phone IS NOT NULL THEN 'target_phone' WHEN phone_group IS NOT NULL THEN 'phone_group'
        WHEN status IS NOT NULL THEN 'status' ELSE 'all' END AS dimension, coalesce(target_phone, phone_group, status, 'all') AS value FROM c""",
)
def metrics_by_each(spark, sf_dir):
    return metrics.metrics_by_each(phones(spark, sf_dir), ["target_phone", "phone_group", "status"], "gold", "decision")


_PATTERN = """CASE WHEN decision = 1 AND duration_ms < 10 THEN 'main+duration' WHEN decision = 1 THEN 'main_only' WHEN duration_ms < 10 THEN 'duration' ELSE 'none' END"""


@query(
    "pattern_metrics",
    f"""WITH {PHONES}, p AS (SELECT *, {_PATTERN} AS evidence_pattern FROM phones), t AS (SELECT greatest(sum(gold), 1) AS errors FROM p)
    SELECT evidence_pattern, count(*) AS sample_count, count(*) FILTER (decision = 1) AS predicted_error_count,
        count(*) FILTER (decision = 1 AND gold = 1) AS true_positive_count, count(*) FILTER (decision = 1 AND gold = 0) AS false_positive_count,
        round({_ratio('count(*) FILTER (decision = 1 AND gold = 1)', 'count(*) FILTER (decision = 1)')}, 6) AS "precision",
        round(count(*) FILTER (decision = 1 AND gold = 1)::DOUBLE / max(errors), 6) AS recall_contribution FROM p, t GROUP BY 1""",
)
def pattern_metrics(spark, sf_dir):
    rows = phones(spark, sf_dir).withColumn("evidence_pattern", F.expr(_PATTERN))
    return metrics.pattern_metrics(rows, "evidence_pattern", "gold", "decision")


@query("label_counts", f"""WITH {PHONES} SELECT phone_group, status, count(*) FILTER (gold = 0) AS n_0, count(*) FILTER (gold = 1) AS n_1, count(*) AS total,
    round(count(*) FILTER (gold = 1)::DOUBLE / count(*), 6) AS error_rate FROM phones GROUP BY 1, 2""")  # fmt: skip
def label_counts(spark, sf_dir):
    return metrics.label_counts(phones(spark, sf_dir), ["phone_group", "status"], "gold")


@query("score_histogram", f"""WITH {PHONES} SELECT least(floor(error_score * 50), 49)::INTEGER AS bin, count(*) FILTER (gold = 0) AS n_0,
    count(*) FILTER (gold = 1) AS n_1 FROM phones WHERE error_score BETWEEN 0 AND 1 GROUP BY 1""")  # fmt: skip
def score_histogram(spark, sf_dir):
    return metrics.score_histogram(phones(spark, sf_dir), "error_score", "gold")


@query("reliability_bins", f"""WITH {PHONES}, s AS (SELECT least(floor(error_score * 10), 9)::INTEGER AS bin, count(*) AS n, avg(error_score) AS m, avg(gold) AS e
        FROM phones WHERE error_score BETWEEN 0 AND 1 GROUP BY 1)
    SELECT i::INTEGER AS bin, coalesce(n, 0) AS n, round(m, 6) AS mean_score, round(e, 6) AS error_rate, round(abs(m - e), 6) AS gap FROM range(10) r(i) LEFT JOIN s ON i = bin""")  # fmt: skip
def reliability_bins(spark, sf_dir):
    return metrics.reliability(phones(spark, sf_dir), "error_score", "gold")


@query("calibration_error", f"""WITH {PHONES}, s AS (SELECT least(floor(error_score * 10), 9) AS bin, count(*) AS n, sum(error_score) AS s, sum(gold) AS e, sum((error_score - gold) ** 2) AS b
        FROM phones WHERE error_score BETWEEN 0 AND 1 GROUP BY 1)
    SELECT round(sum(abs(s - e)) / sum(n), 6) AS ece, round(sum(b) / sum(n), 6) AS brier FROM s""")  # fmt: skip
def calibration_error(spark, sf_dir):
    return metrics.calibration_error(phones(spark, sf_dir), "error_score", "gold")


@query("regression_metrics", f"""WITH {PHONES} SELECT phone_group, count(*) AS n, round(avg((duration_ms / 50 - prob_correct) ** 2), 6) AS mse,
    round(corr(duration_ms / 50, prob_correct), 6) AS pcc FROM phones GROUP BY 1""")  # fmt: skip
def regression_metrics(spark, sf_dir):
    return metrics.regression_metrics(phones(spark, sf_dir).withColumn("g", F.col("duration_ms") / 50), "g", "prob_correct", ["phone_group"])


@query("multiclass_report", f"""WITH x AS (SELECT l_returnflag AS g, CASE WHEN l_quantity < 17 THEN 'R' WHEN l_quantity < 34 THEN 'A' ELSE 'N' END AS p FROM lineitem), l AS (SELECT g AS label FROM x UNION SELECT p FROM x),
    s AS (SELECT label, (SELECT count(*) FROM x WHERE g = label) AS support, (SELECT count(*) FROM x WHERE p = label) AS pr, (SELECT count(*) FROM x WHERE g = label AND p = label) AS hit FROM l)
    SELECT label, support, round({_ratio('hit', 'pr')}, 6) AS "precision", round({_ratio('hit', 'support')}, 6) AS recall, round({_ratio('2 * hit', 'support + pr')}, 6) AS f1 FROM s""")  # fmt: skip
def multiclass_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.expr("CASE WHEN l_quantity < 17 THEN 'R' WHEN l_quantity < 34 THEN 'A' ELSE 'N' END").alias("p"))
    return metrics.multiclass_report(rows, "l_returnflag", "p")


@query("pr_curve", f"""WITH {PHONES}, {curve()} SELECT threshold, tp::BIGINT AS tp, fp::BIGINT AS fp, positives::BIGINT AS positives, negatives::BIGINT AS negatives, prec AS "precision", rec AS recall, fpr FROM points""")
def pr_curve(spark, sf_dir):
    return metrics.pr_curve(phones(spark, sf_dir), "error_score", "gold")


@query("ranking_metrics", f"""WITH {PHONES}, {curve('target_phone')} SELECT target_phone, max(positives)::BIGINT AS positives, max(negatives)::BIGINT AS negatives,
    round({_ratio('sum(pos * (2 * (negatives - fp) + neg))', '2 * max(positives) * max(negatives)', '0.5')}, 6) AS auc,
    round({_ratio('sum(pos::DOUBLE * tp / (tp + fp))', 'max(positives)')}, 6) AS average_precision FROM curve GROUP BY 1""")  # fmt: skip
def ranking_metrics(spark, sf_dir):
    return metrics.ranking_metrics(phones(spark, sf_dir), "error_score", "gold", ["target_phone"])


def _pick(where: str, order: str, extra: str = 'prec AS "precision", rec AS recall') -> str:
    return f"WITH {PHONES}, {curve('target_phone')} SELECT target_phone, threshold, {extra} FROM points WHERE {where} QUALIFY row_number() OVER (PARTITION BY target_phone ORDER BY {order}) = 1"


@query("recall_at_precision", f"""WITH best AS ({_pick('prec >= 0.34 AND positives > 0', 'rec DESC, threshold')}) SELECT p_brand AS target_phone, threshold, "precision", recall
    FROM (SELECT DISTINCT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey) LEFT JOIN best ON target_phone = p_brand""")  # fmt: skip
def recall_at_precision(spark, sf_dir):
    return thresholds.recall_at_precision(phones(spark, sf_dir), "error_score", "gold", 0.34, ["target_phone"])


@query("threshold_or_most_precise", _pick("positives > 0", "CASE WHEN prec >= 0.36 THEN 1 ELSE 0 END DESC, CASE WHEN prec >= 0.36 THEN rec ELSE prec END DESC, CASE WHEN prec >= 0.36 THEN -threshold ELSE rec END DESC", 'prec AS "precision", rec AS recall, prec >= 0.36 AS found'))
def threshold_or_most_precise(spark, sf_dir):
    return thresholds.threshold_or_most_precise(phones(spark, sf_dir), "error_score", "gold", 0.36, ["target_phone"])


@query("best_f1", _pick("true", f"round({_ratio('2 * tp', 'tp + fp + positives')}, 9) DESC, threshold", f"round({_ratio('2 * tp', 'tp + fp + positives')}, 9) AS f1"))
def best_f1(spark, sf_dir):
    return thresholds.best_f1(phones(spark, sf_dir), "error_score", "gold", ["target_phone"])


@query("precision_at_recall", _pick("rec >= 0.7", "prec DESC, threshold DESC"))
def precision_at_recall(spark, sf_dir):
    return thresholds.precision_at_recall(phones(spark, sf_dir), "error_score", "gold", 0.7, ["target_phone"])


@query("recall_at_fpr", _pick("fpr <= 0.3", "rec DESC, threshold DESC", "rec AS recall, fpr"))
def recall_at_fpr(spark, sf_dir):
    return thresholds.recall_at_fpr(phones(spark, sf_dir), "error_score", "gold", 0.3, ["target_phone"])


@query("best_on_grid", f"""WITH {PHONES}, c AS (SELECT target_phone, (i + 1) / 100.0::DOUBLE AS threshold, count(*) FILTER (gold = 1 AND error_score >= (i + 1) / 100.0::DOUBLE) AS tp,
        count(*) FILTER (gold = 0 AND error_score >= (i + 1) / 100.0::DOUBLE) AS fp, count(*) FILTER (gold = 1 AND error_score < (i + 1) / 100.0::DOUBLE) AS fn,
        count(*) FILTER (gold = 0 AND error_score < (i + 1) / 100.0::DOUBLE) AS tn FROM phones, range(99) r(i) GROUP BY 1, 2), d AS (SELECT target_phone, threshold, {DERIVED} FROM c)
    SELECT target_phone, threshold, macro_f1 FROM d QUALIFY row_number() OVER (PARTITION BY target_phone ORDER BY macro_f1 DESC, threshold) = 1""")  # fmt: skip
def best_on_grid(spark, sf_dir):
    return thresholds.best_on_grid(phones(spark, sf_dir), "error_score", "gold", [(i + 1) / 100 for i in range(99)], "macro_f1", ["target_phone"])


_ORDER = "CASE WHEN prec >= 0.36 THEN 1 ELSE 0 END DESC, CASE WHEN prec >= 0.36 THEN rec ELSE prec END DESC, CASE WHEN prec >= 0.36 THEN -threshold ELSE rec END DESC"


def _level(key: str) -> str:
    c = curve(key).replace("distinct_scores", f"d_{key}").replace("curve AS", f"c_{key} AS").replace("FROM curve", f"FROM c_{key}").replace("points AS", f"p_{key} AS")
    return c.replace("FROM phones", "FROM dev")


_HIERARCHY = f"""{PHONES}, dev AS (SELECT * FROM phones WHERE split = 0), {_level('target_phone')}, {_level('phone_group')},
    d_all AS (SELECT error_score AS score, count(*) FILTER (gold = 1) AS pos, count(*) FILTER (gold = 0) AS neg FROM dev GROUP BY 1),
    c_all AS (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS positives FROM d_all WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
    p_all AS (SELECT *, round({_ratio('tp', 'tp + fp')}, 9) AS prec, round({_ratio('tp', 'positives')}, 9) AS rec FROM c_all),
    thresholds AS (
        SELECT 'global' AS level, '' AS key, (SELECT threshold FROM p_all ORDER BY {_ORDER} LIMIT 1) AS threshold
        UNION ALL SELECT 'target_phone', target_phone, threshold FROM p_target_phone
            WHERE target_phone IN (SELECT target_phone FROM dev GROUP BY 1 HAVING count(*) >= 700 AND sum(gold) >= 10 AND count(*) > sum(gold)) QUALIFY row_number() OVER (PARTITION BY target_phone ORDER BY {_ORDER}) = 1
        UNION ALL SELECT 'phone_group', phone_group, threshold FROM p_phone_group
            WHERE phone_group IN (SELECT phone_group FROM dev GROUP BY 1 HAVING count(*) >= 700 AND sum(gold) >= 10 AND count(*) > sum(gold)) QUALIFY row_number() OVER (PARTITION BY phone_group ORDER BY {_ORDER}) = 1)"""


def _hierarchy(spark, sf_dir):
    dev = phones(spark, sf_dir).where("split = 0")
    return thresholds.hierarchical_thresholds(dev, "error_score", "gold", ["target_phone", "phone_group"], 0.36, 700, 10)


@query("hierarchical_thresholds", f"WITH {_HIERARCHY} SELECT * FROM thresholds")
def hierarchical_thresholds(spark, sf_dir):
    return _hierarchy(spark, sf_dir)


@query("apply_thresholds", f"""WITH {_HIERARCHY}, a AS (
        SELECT p.*, coalesce(t.threshold, g.threshold, (SELECT threshold FROM thresholds WHERE level = 'global')) AS threshold,
            CASE WHEN t.threshold IS NOT NULL THEN 'target_phone' WHEN g.threshold IS NOT NULL THEN 'phone_group' ELSE 'global' END AS threshold_source
        FROM phones p LEFT JOIN thresholds t ON t.level = 'target_phone' AND t.key = p.target_phone LEFT JOIN thresholds g ON g.level = 'phone_group' AND g.key = p.phone_group WHERE split <> 0)
    SELECT threshold_source, threshold, count(*) AS n, sum(CASE WHEN error_score >= threshold THEN 1 ELSE 0 END)::BIGINT AS errors FROM a GROUP BY 1, 2""")  # fmt: skip
def apply_thresholds(spark, sf_dir):
    applied = thresholds.apply_thresholds(phones(spark, sf_dir).where("split <> 0").drop("decision"), _hierarchy(spark, sf_dir), "error_score", ["target_phone", "phone_group"])
    return applied.groupBy("threshold_source", "threshold").agg(F.count(F.lit(1)).alias("n"), F.sum("decision").alias("errors"))


GRID = {
    "main_t": [0.1, 0.2, 0.3, 0.5, 0.7, 0.9], "correct_t": [0.2, 0.5, 0.8], "short_t": [5.0, 10.0, 20.0], "long_t": [30.0, 40.0, 45.0], "votes": [1.0, 2.0],
}
_VALUES = {k: ", ".join(f"({i}, {v}::DOUBLE)" for i, v in enumerate(vs)) for k, vs in GRID.items()}
_SWEEP = f"""{PHONES}, settings AS (SELECT (((a.i * 3 + b.i) * 3 + c.i) * 3 + d.i) * 2 + e.i AS setting, a.v AS main_t, b.v AS correct_t, c.v AS short_t, d.v AS long_t, e.v AS votes
        FROM (VALUES {_VALUES['main_t']}) a(i, v), (VALUES {_VALUES['correct_t']}) b(i, v), (VALUES {_VALUES['short_t']}) c(i, v), (VALUES {_VALUES['long_t']}) d(i, v), (VALUES {_VALUES['votes']}) e(i, v)),
    merged AS (SELECT error_score, prob_correct, duration_ms, gold, count(*) AS weight FROM phones GROUP BY ALL),
    c AS (SELECT setting, main_t, correct_t, short_t, long_t, votes, gold, weight,
        error_score >= main_t AND (prob_correct <= correct_t)::INTEGER + (duration_ms < short_t OR duration_ms > long_t)::INTEGER >= votes AS hit FROM merged, settings),
    s AS (SELECT setting, main_t, correct_t, short_t, long_t, votes, coalesce(sum(weight) FILTER (hit AND gold = 1), 0)::BIGINT AS tp, coalesce(sum(weight) FILTER (hit AND gold = 0), 0)::BIGINT AS fp,
        coalesce(sum(weight) FILTER (NOT hit AND gold = 1), 0)::BIGINT AS fn, coalesce(sum(weight) FILTER (NOT hit AND gold = 0), 0)::BIGINT AS tn FROM c GROUP BY ALL),
    swept AS (SELECT *, {DERIVED} FROM s)"""


def _swept(spark, sf_dir):
    def decide(row, s):
        votes = (row["prob_correct"] <= s["correct_t"]).cast("int") + ((row["duration_ms"] < s["short_t"]) | (row["duration_ms"] > s["long_t"])).cast("int")
        return (row["error_score"] >= s["main_t"]) & (votes >= s["votes"])

    return thresholds.sweep(phones(spark, sf_dir), GRID, decide, "gold", ["error_score", "prob_correct", "duration_ms"], {"error_score": ["main_t"], "prob_correct": ["correct_t"], "duration_ms": ["short_t", "long_t"]})


@query("grid_sweep_324", f"WITH {_SWEEP} SELECT * FROM swept")
def grid_sweep(spark, sf_dir):
    return _swept(spark, sf_dir)


@query("best_setting", f"WITH {_SWEEP} SELECT * FROM swept ORDER BY (CASE WHEN \"precision\" >= 0.34 THEN 1 ELSE 0 END) DESC, recall DESC, \"precision\" DESC, balanced_accuracy DESC, setting LIMIT 1")
def best_setting(spark, sf_dir):
    return thresholds.best_setting(_swept(spark, sf_dir), 0.34)


@query("duration_outlier", f"""WITH {PHONES}, z AS (SELECT target_phone, abs(coalesce((duration_ms - avg(duration_ms) OVER w) / nullif(stddev_samp(duration_ms) OVER w, 0), 0)) >= 1.6 AS f FROM phones WINDOW w AS (PARTITION BY target_phone))
    SELECT target_phone, count(*) AS n, count(*) FILTER (f) AS outliers FROM z GROUP BY 1""")  # fmt: skip
def duration_outlier(spark, sf_dir):
    flagged = windows.duration_outlier(phones(spark, sf_dir), "duration_ms", "target_phone", 1.6)
    return flagged.groupBy("target_phone").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("duration_outlier_flag") == 1).alias("outliers"))


@query("median_ratio", f"""WITH {PHONES}, m AS (SELECT target_phone, median(duration_ms) AS md FROM phones GROUP BY 1)
    SELECT target_phone, round(avg(coalesce(duration_ms / nullif(md, 0), 1)), 6) AS mean_ratio, count(*) FILTER (coalesce(duration_ms / nullif(md, 0), 1) < 0.55) AS short FROM phones JOIN m USING (target_phone) GROUP BY 1""")  # fmt: skip
def median_ratio(spark, sf_dir):
    r = windows.median_ratio(phones(spark, sf_dir), "duration_ms", "target_phone")
    return r.groupBy("target_phone").agg(F.round(F.avg("duration_ratio"), 6).alias("mean_ratio"), F.count_if(F.col("duration_ratio") < 0.55).alias("short"))


@query("final_flag", f"""WITH {PHONES}, f AS (SELECT status, word_index = max(word_index) OVER (PARTITION BY utterance_id) AND status = 'O' AS last FROM phones)
    SELECT status, count(*) AS n, count(*) FILTER (last) AS finals FROM f GROUP BY 1""")  # fmt: skip
def final_flag(spark, sf_dir):
    f = windows.last_in_group(phones(spark, sf_dir), ["utterance_id"], "word_index", F.col("status") == "O", "last")
    return f.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("last") == 1).alias("finals"))


@query("relative_position", f"""WITH {PHONES}, r AS (SELECT phone_group, word_index / max(word_index) OVER (PARTITION BY utterance_id) AS p FROM phones) SELECT phone_group, round(avg(p), 6) AS mean_position FROM r GROUP BY 1""")
def relative_position(spark, sf_dir):
    return windows.relative_position(phones(spark, sf_dir), "utterance_id", "word_index").groupBy("phone_group").agg(F.round(F.avg("relative_position"), 6).alias("mean_position"))


@query("train_normalised", f"""WITH {PHONES}, s AS (SELECT target_phone, avg(duration_ms) AS m, stddev_samp(duration_ms) AS d FROM phones WHERE split = 0 GROUP BY 1)
    SELECT split, target_phone, round(avg((duration_ms - m) / d), 6) AS mean_norm FROM phones JOIN s USING (target_phone) WHERE split <> 0 GROUP BY 1, 2""")  # fmt: skip
def train_normalised(spark, sf_dir):
    n = windows.normalised(phones(spark, sf_dir), "duration_ms", "target_phone", F.col("split") == 0)
    return n.where("split <> 0").groupBy("split", "target_phone").agg(F.round(F.avg("duration_ms_norm"), 6).alias("mean_norm"))


@query("event_runs", """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS s FROM events),
    b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS run_index FROM a)
    SELECT user_id, run_index::BIGINT AS run_index, event_type, count(*) AS length, bool_and(value > 10) AS all_flagged FROM b GROUP BY 1, 2, 3""")  # fmt: skip
def event_runs(spark, sf_dir):
    return windows.run_summary(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", F.col("value") > 10)


@query("neighbour_support", """WITH a AS (SELECT *, (length(text) > 200)::INTEGER AS m FROM conversations), b AS (SELECT conv_id, turn, lag(m) OVER w AS p, lead(m) OVER w AS n FROM a WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, CASE WHEN p IS NULL AND n IS NULL THEN 0.0::DOUBLE ELSE (coalesce(p, 0) + coalesce(n, 0))::DOUBLE / ((p IS NOT NULL)::INTEGER + (n IS NOT NULL)::INTEGER) END AS context_support FROM b""")  # fmt: skip
def neighbour_support(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return windows.neighbour_support(rows, "conv_id", ["turn"], F.length("text") > 200).select("conv_id", "turn", "context_support")


@query("keep_last", "SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def keep_last(spark, sf_dir):
    return joins.keep_last(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


@query("coverage_join", """WITH last AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 100000 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1)
    SELECT c_custkey AS o_custkey, c_mktsegment, coalesce(o_orderkey, -1) AS o_orderkey, coalesce(o_orderpriority, 'missing') AS o_orderpriority, o_orderkey IS NOT NULL AS covered FROM customer LEFT JOIN last ON c_custkey = o_custkey""")  # fmt: skip
def coverage_join(spark, sf_dir):
    expected = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    actual = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_custkey", "o_orderkey", "o_orderpriority")
    return joins.coverage_join(expected, actual, ["o_custkey"], ["o_orderkey"], {"o_orderkey": -1, "o_orderpriority": "missing"})


@query("evidence_join", """WITH last AS (SELECT l_orderkey, l_quantity, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
    SELECT o_orderkey AS l_orderkey, o_orderstatus, l_quantity, l_returnflag FROM orders LEFT JOIN last ON o_orderkey = l_orderkey""")  # fmt: skip
def evidence_join(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", F.lit(0.0).alias("l_quantity"))
    return joins.evidence_join(left, table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_quantity", "l_returnflag"])


@query("missing_rows", "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def missing_rows(spark, sf_dir):
    actual = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.missing_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), actual, ["c_custkey"])


@query("override_where", """SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) THEN 'deleted' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def override_where(spark, sf_dir):
    marked = table(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.override_where(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), marked, ["o_orderkey"], {"o_orderstatus": "deleted"})


@query("validated_join", "SELECT l.doc_id, l.quality, l.toxic, d.lang FROM labels l JOIN documents d USING (doc_id)")
def validated_join(spark, sf_dir):
    return joins.validated_join(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"]).select("doc_id", "quality", "toxic", "lang")


@query("labelled_join", """WITH p AS (SELECT event_id, user_id, event_type, printf('%.3f', value) AS v FROM events), l AS (SELECT event_id, user_id, printf('%.3f', value) AS v, event_type AS label FROM events WHERE event_type <> 'click')
    SELECT p.event_id, p.user_id, p.event_type, l.label FROM p JOIN l ON p.event_id = l.event_id AND p.user_id = l.user_id AND p.v = l.v""")  # fmt: skip
def labelled_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    found = joins.labelled(
        events.select("event_id", "user_id", "event_type", "value"), events.where("event_type <> 'click'").select("event_id", "user_id", "value", F.col("event_type").alias("label")),
        ["event_id", "user_id", "word"], ["value"], "label",
    )
    return found.select("event_id", "user_id", "event_type", "label")


_SPANS = "epoch(ts) AS start, epoch(ts) + value * 60 AS \"end\""


@query("overlap_argmax", f"""WITH e AS (SELECT event_id, user_id, event_type, {_SPANS} FROM events), a AS (SELECT * FROM e WHERE event_type = 'click'), b AS (SELECT event_id AS span_id, user_id, start AS s, "end" AS f FROM e WHERE event_type <> 'click')
    SELECT user_id, event_id, span_id, round(least("end", f) - greatest(start, s), 3) AS overlap FROM a JOIN b USING (user_id) WHERE least("end", f) > greatest(start, s)
    QUALIFY row_number() OVER (PARTITION BY user_id, event_id ORDER BY least("end", f) - greatest(start, s) DESC, s, span_id DESC) = 1""")  # fmt: skip
def overlap_argmax(spark, sf_dir):
    at = F.unix_micros(F.to_timestamp("ts")) / F.lit(1e6)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", at.alias("start"), (at + F.col("value") * 60).alias("end"))
    points, spans = rows.where("event_type = 'click'"), rows.where("event_type <> 'click'").withColumnRenamed("event_id", "span_id")
    found = joins.overlap_argmax(points, spans, ["user_id"], 3600.0, "event_id", "span_id")
    return found.withColumn("overlap", F.round("overlap", 3))


_ASKED = "q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), b AS (SELECT vec_id AS item, label, embedding AS e FROM embeddings)"
_SIMILAR = "round(list_cosine_similarity(q.embedding::DOUBLE[], b.e::DOUBLE[]), 6)"


@query("cosine_topk", f"""WITH {_ASKED}, s AS (SELECT q.vec_id, {_SIMILAR} AS sim FROM q JOIN b ON q.label = b.label AND q.vec_id <> b.item),
    r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC) <= 5)
    SELECT vec_id, max(sim) AS top1, round(avg(sim), 6) AS topk_mean FROM r GROUP BY 1""")  # fmt: skip
def cosine_topk(spark, sf_dir):
    """Every row whose id is divisible by 100 against all others of its label."""
    rows = table(spark, sf_dir, "embeddings")
    found = retrieval.top_similarities(rows.where("vec_id % 100 = 0"), rows.withColumnRenamed("vec_id", "item"), "vec_id", "item", "label", "embedding", 5, others_only=True)
    return found.select("vec_id", "top1", "topk_mean")


@query("retrieval_verifier", f"""WITH {_ASKED}, s AS (SELECT q.vec_id, q.label, b.label AS own, {_SIMILAR} AS sim FROM q JOIN b ON (b.label = q.label OR b.label = (q.label + 1) % 10) AND q.vec_id <> b.item),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id, own ORDER BY sim DESC) AS place FROM s WHERE own = label),
    t AS (SELECT vec_id, max(sim) AS a, round(avg(sim), 6) AS m FROM r WHERE place <= 5 GROUP BY 1), o AS (SELECT vec_id, max(sim) AS o FROM s WHERE own <> label GROUP BY 1),
    v AS (SELECT q.vec_id, q.label, q.vec_id % 300 = 0 AS err, coalesce(a, 0.0) AS a, coalesce(m, 0.0) AS m, coalesce(o, 0.0) AS o FROM q LEFT JOIN t USING (vec_id) LEFT JOIN o USING (vec_id))
    SELECT vec_id, label, a AS proto_same_sim_top1, m AS proto_same_sim_topk_mean, o AS proto_confusion_sim_top1, round(a - o, 6) AS proto_margin,
        CASE WHEN err AND o > a THEN 'likely_error' WHEN err AND a >= 0.15 AND a - o >= 0.03 THEN 'likely_correct' WHEN err THEN 'uncertain_review' WHEN a < 0.15 THEN 'candidate_error_for_review' ELSE 'likely_correct' END AS retrieval_verifier_decision FROM v""")  # fmt: skip
def retrieval_verifier(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    confusable = spark.range(10).select(F.col("id").cast("int").alias("label"), ((F.col("id") + 1) % 10).cast("int").alias("other"))
    asked = rows.where("vec_id % 100 = 0").withColumn("is_error", (F.col("vec_id") % 300 == 0).cast("int"))
    return retrieval.retrieval_verifier(asked, rows.withColumnRenamed("vec_id", "item"), confusable, "vec_id", "item", "label", "embedding", others_only=True)


@query("anomaly_verifier")
def anomaly_verifier(spark, sf_dir):
    rows = phones(spark, sf_dir).select("utterance_id", "word_index", "target_phone", "phone_group", "gold", "duration_ms", "error_score", "prob_correct")
    scored = retrieval.anomaly_verifier(rows.where("gold = 0"), rows, "target_phone", "phone_group", ["duration_ms", "error_score", "prob_correct"])
    return scored.select("utterance_id", "word_index", "target_phone", "anomaly_model", "anomaly_score", "oneclass_anomaly_score")


@query("priority_packet", """SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_quantity FROM lineitem ORDER BY (CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END), l_discount DESC, l_quantity, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 300""")
def priority_packet(spark, sf_dir):
    bucket = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    rows = sampling.priority_packet(
        table(spark, sf_dir, "lineitem"), [bucket, F.desc("l_discount"), F.col("l_quantity"), *[F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]], 300
    )
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity")


@query("first_per_split", """WITH u AS (SELECT o_orderstatus, o_custkey, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), k AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY f, o_custkey) <= 20)
    SELECT o_orderkey, o_orderstatus, o_custkey FROM orders SEMI JOIN k USING (o_orderstatus, o_custkey)""")  # fmt: skip
def first_per_split(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_custkey")
    return sampling.first_per_split(rows, "o_orderstatus", "o_custkey", 20, "o_orderkey")


@query("budgeted_units", """WITH u AS (SELECT l_orderkey, sum((l_discount >= 0.09)::INTEGER) AS errors FROM lineitem GROUP BY 1), r AS (SELECT *, (errors = 0)::INTEGER AS clean, row_number() OVER (PARTITION BY errors = 0 ORDER BY errors DESC, l_orderkey) AS k FROM u),
    t AS (SELECT *, CASE WHEN clean = 0 AND k <= 160 THEN 0 WHEN clean = 1 THEN 1 ELSE 2 END AS tier FROM r WHERE k <= 200)
    SELECT l_orderkey, errors::BIGINT AS errors, tier FROM t QUALIFY row_number() OVER (ORDER BY tier, k) <= 200""")  # fmt: skip
def budgeted_units(spark, sf_dir):
    return sampling.budgeted_units(table(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_discount") >= 0.09, 200)


@query("dev_units", """WITH u AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('42:' || o_custkey), o_custkey) AS k, count(*) OVER () AS n FROM u)
    SELECT o_custkey, k <= greatest(1, round_even(n * 0.2::DOUBLE, 0)) AS in_dev FROM r""")  # fmt: skip
def dev_units(spark, sf_dir):
    return sampling.dev_units(table(spark, sf_dir, "orders"), "o_custkey", 42)


@query("hashed_sample", "SELECT o_orderkey, o_custkey FROM orders ORDER BY sha256('7:' || o_orderkey), o_orderkey LIMIT 20")
def hashed_sample(spark, sf_dir):
    return sampling.hashed_sample(table(spark, sf_dir, "orders"), "o_orderkey", 7, 20).select("o_orderkey", "o_custkey")


@query("balanced_weights", "WITH c AS (SELECT toxic, count(*) AS n FROM labels GROUP BY 1) SELECT toxic, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM c")
def balanced_weights(spark, sf_dir):
    return sampling.balanced_weights(table(spark, sf_dir, "labels"), "toxic").groupBy("toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query("hard_negatives", f"""WITH {PHONES}, b AS (SELECT quantile_cont(duration_ms, 0.9) AS q FROM phones WHERE gold = 0) SELECT gold, CASE WHEN gold = 0 AND duration_ms >= q THEN 3.0 ELSE 1.0 END::DOUBLE AS weight, count(*) AS n FROM phones, b GROUP BY 1, 2""")
def hard_negatives(spark, sf_dir):
    return sampling.hard_negatives(phones(spark, sf_dir), "duration_ms", "gold", 0.1, 3.0).groupBy("gold", "weight").agg(F.count(F.lit(1)).alias("n"))


@query("union_by_name", "SELECT c_custkey AS key, c_name AS name, c_mktsegment, NULL::DOUBLE AS balance FROM customer UNION ALL BY NAME SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance FROM supplier")
def union_by_name(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_mktsegment")
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("reason_union", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'F;urgent;late' ELSE o_orderstatus || ';late' END AS reasons FROM orders""")
def reason_union(spark, sf_dir):
    status, extra = F.col("o_orderstatus"), F.when(F.col("o_orderstatus") == "F", " urgent; late;F").otherwise("late; ;")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.reasons(status, extra, F.lit(None).cast("string")).alias("reasons"))


@query("phone_text", """SELECT p_partkey, regexp_replace(replace(upper(trim(p_name)), '*', ''), '[0-9]+$', '') AS phone, regexp_replace(upper(p_brand), '[0-9]+$', '') AS arpabet FROM part""")
def phone_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.phone("p_name").alias("phone"), scalars.arpabet("p_brand").alias("arpabet"))


@query("word_tokens", """WITH t AS (SELECT item_id, trim(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'SS')), '[^A-Z0-9''\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM benchmark)
    SELECT item_id, len(list_filter(list_transform(string_split(t, ' '), lambda w: trim(w, '''')), lambda w: w <> ''))::INTEGER AS n_words FROM t""")  # fmt: skip
def word_tokens(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(scalars.tokens("text")).alias("n_words"))


@query("split_leakage", "SELECT o_custkey, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def split_leakage(spark, sf_dir):
    from ..operators.manifests import leaking

    return leaking(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "splits")


@query("manifest_errors", """SELECT 'interval' AS error, count(*) AS n FROM lineitem WHERE l_quantity * 10 <= l_discount * 1000 UNION ALL SELECT 'label', count(*) FROM lineitem WHERE l_returnflag NOT IN ('R', 'N') UNION ALL SELECT 'missing', count(*) FROM lineitem WHERE l_partkey IS NULL""")
def manifest_errors(spark, sf_dir):
    from ..operators.manifests import error_counts

    rows = table(spark, sf_dir, "lineitem")
    checks = {"interval": F.col("l_quantity") * 10 <= F.col("l_discount") * 1000, "label": ~F.col("l_returnflag").isin("R", "N"), "missing": F.col("l_partkey").isNull()}
    return error_counts(rows, checks)


_DECISIONS = f"""{PHONES}, d AS (SELECT *, CASE WHEN status = 'F' AND duration_ms < 3 THEN 'bad' ELSE 'pass' END AS alignment_quality, CASE WHEN duration_ms > 3 THEN 1 - prob_correct END AS p FROM phones),
    e AS (SELECT *, CASE WHEN alignment_quality = 'bad' THEN 'uncertain_review' WHEN p IS NULL THEN 'uncertain_review' WHEN p >= 0.75 THEN 'true_error' WHEN p >= 0.45 THEN 'uncertain_review' ELSE 'correct' END AS phone_decision,
        round(CASE WHEN alignment_quality = 'bad' THEN greatest(coalesce(p, 0.5), 0.5) WHEN p IS NULL THEN 0.5 ELSE p END, 6) AS probability FROM d)"""


def _decided(spark, sf_dir):
    rows = phones(spark, sf_dir).drop("decision").withColumns(
        {
            "alignment_quality": F.when((F.col("status") == "F") & (F.col("duration_ms") < 3), "bad").otherwise("pass"),
            "prob_correct": F.when(F.col("duration_ms") > 3, F.col("prob_correct")),
        }
    )
    return decisions.phone_decisions(rows)


@query("phone_decisions", f"WITH {_DECISIONS} SELECT phone_decision, alignment_quality, count(*) AS n, round(avg(probability), 5) AS mean_probability FROM e GROUP BY 1, 2")
def phone_decisions(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy("phone_decision", "alignment_quality").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("phone_error_probability"), 5).alias("mean_probability"))


@query("phone_summary", f"""WITH {_DECISIONS} SELECT utterance_id, word_index, count(*) AS phone_count, CASE WHEN bool_or(phone_decision = 'true_error') THEN 'has_phone_error' WHEN bool_or(phone_decision = 'uncertain_review') THEN 'needs_review' ELSE 'correct' END AS word_decision,
    CASE WHEN bool_or(alignment_quality = 'bad') THEN 'bad' ELSE 'pass' END AS alignment_quality, max(probability) AS max_phone_error_probability, count(*) FILTER (phone_decision = 'true_error') AS num_phone_true_error,
    count(*) FILTER (phone_decision = 'uncertain_review') AS num_phone_uncertain FROM e GROUP BY 1, 2""")  # fmt: skip
def phone_summary(spark, sf_dir):
    return decisions.phone_summary(_decided(spark, sf_dir), ["utterance_id", "word_index"]).drop("avg_phone_error_probability")


_WORDS = """w AS (SELECT l_orderkey, count(*) AS n, round(max(l_linenumber * 60 + l_quantity) - min(l_linenumber * 60), 3) AS d, round(avg((l_quantity < 30)::INTEGER), 6) AS s, round(avg((l_discount * 10 > 0.85)::INTEGER), 6) AS h,
    round(avg((l_tax < 0.03)::INTEGER), 6) AS c, round(avg((l_quantity > 48)::INTEGER), 6) AS b FROM lineitem GROUP BY 1)"""


def _word_rows(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_linenumber") * 60.0).alias("start_ms"), F.when(F.col("l_quantity") <= 48, F.col("l_linenumber") * 60 + F.col("l_quantity")).alias("end_ms"), F.col("l_quantity").alias("duration_ms"),
        (F.col("l_discount") * 10).alias("manual_calibrated_error_probability"), F.col("l_tax").alias("prob_correct"),
    )


@query("word_stats_legacy", """WITH w AS (SELECT l_orderkey, count(*) AS phone_count, round(coalesce(max(CASE WHEN l_quantity <= 48 THEN l_linenumber * 60 + l_quantity END) - min(l_linenumber * 60), 0), 3) AS word_duration_ms,
        round(avg((l_quantity < 30)::INTEGER), 6) AS short_phone_ratio, round(avg((l_discount * 10 > 0.85)::INTEGER), 6) AS high_error_ratio, round(avg((l_quantity > 48)::INTEGER), 6) AS missing_boundary_ratio FROM lineitem GROUP BY 1)
    SELECT *, concat_ws(';', CASE WHEN phone_count >= 4 AND word_duration_ms < 250 THEN 'word_duration_lt_250ms' END, CASE WHEN phone_count >= 4 AND short_phone_ratio >= 0.5 THEN 'short_phone_ratio_ge_0.5' END,
        CASE WHEN phone_count >= 4 AND high_error_ratio >= 0.8 THEN 'high_error_ratio_ge_0.8' END, CASE WHEN phone_count >= 4 AND missing_boundary_ratio >= 0.5 THEN 'missing_boundary_ratio_ge_0.5' END) AS missing_word_reason FROM w""")  # fmt: skip
def word_stats_legacy(spark, sf_dir):
    found = decisions.word_stats(_word_rows(spark, sf_dir), ["l_orderkey"], "legacy")
    return found.select("l_orderkey", "phone_count", "word_duration_ms", "short_phone_ratio", "high_error_ratio", "missing_boundary_ratio", "missing_word_reason")


_EVIDENCE = """d AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT % 7 AS phone_count, (floor(o_totalprice)::BIGINT % 300)::DOUBLE AS word_duration_ms, o_orderstatus = 'F' AS asr_missing_word, (o_custkey % 11) / 10.0::DOUBLE AS asr_missing_confidence,
    o_custkey % 3 <> 0 AS has_ctc, (o_orderkey % 101) / 100.0::DOUBLE AS ctc, CASE WHEN o_custkey % 17 = 0 THEN 'bad' ELSE 'pass' END AS alignment_quality, o_orderpriority = '1-URGENT' AS sub,
    CASE WHEN o_orderkey % 19 = 0 THEN 'failed' ELSE 'custom' END AS lexicon_status FROM orders),
  v AS (SELECT *, CASE WHEN lexicon_status = 'failed' THEN 'not_judged' WHEN asr_missing_word AND has_ctc AND ctc >= 0.85 THEN 'deletion' WHEN asr_missing_word AND asr_missing_confidence >= 0.55 AND has_ctc AND ctc >= 0.65 THEN 'deletion'
    WHEN asr_missing_word AND word_duration_ms > 0 AND word_duration_ms < greatest(120.0, phone_count * 30.0) THEN 'deletion' WHEN asr_missing_word THEN 'possible_deletion'
    WHEN has_ctc AND ctc >= 0.85 AND word_duration_ms > 0 AND word_duration_ms < greatest(120.0, phone_count * 30.0) THEN 'possible_deletion' WHEN has_ctc AND ctc >= 0.92 THEN 'possible_deletion'
    WHEN alignment_quality = 'bad' THEN 'alignment_issue' WHEN phone_count >= 4 AND word_duration_ms > 0 AND word_duration_ms < greatest(80.0, phone_count * 20.0) THEN 'possible_deletion' ELSE 'correct' END AS deletion_decision FROM d)"""


def _deletions(spark, sf_dir):
    price = F.floor("o_totalprice").cast("long")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", (price % 7).alias("phone_count"), (price % 300).cast("double").alias("word_duration_ms"), (F.col("o_orderstatus") == "F").alias("asr_missing_word"),
        ((F.col("o_custkey") % 11) / 10.0).alias("asr_missing_confidence"), (F.col("o_custkey") % 3 != 0).alias("ctc_deletion_available"), ((F.col("o_orderkey") % 101) / 100.0).alias("ctc_deletion_score"),
        F.when(F.col("o_custkey") % 17 == 0, "bad").otherwise("pass").alias("alignment_quality"), (F.col("o_orderpriority") == "1-URGENT").alias("asr_substituted_word"),
        F.when(F.col("o_orderkey") % 19 == 0, "failed").otherwise("custom").alias("lexicon_status"),
    )
    return decisions.word_deletion(rows)


@query("word_deletion", f"WITH {_EVIDENCE} SELECT o_orderkey, deletion_decision FROM v")
def word_deletion(spark, sf_dir):
    return _deletions(spark, sf_dir).select("o_orderkey", "deletion_decision")


@query("word_fusion", f"""WITH {_EVIDENCE} SELECT o_orderkey, CASE WHEN lexicon_status = 'failed' THEN 'g2p_issue' WHEN deletion_decision = 'deletion' THEN 'deletion' WHEN deletion_decision = 'possible_deletion' OR asr_missing_word THEN 'possible_deletion'
    WHEN sub THEN 'substituted_word' WHEN deletion_decision = 'alignment_issue' OR alignment_quality = 'bad' THEN 'alignment_issue' ELSE 'correct' END AS final_word_decision FROM v""")  # fmt: skip
def word_fusion(spark, sf_dir):
    return decisions.word_fusion(_deletions(spark, sf_dir)).select("o_orderkey", "final_word_decision")


_VOTES = f"""{PHONES}, a AS (SELECT *, CASE WHEN duration_ms < 12 THEN 'high_confidence_error' ELSE 'likely_correct' END AS av, CASE WHEN prob_correct < 0.3 THEN 'likely_error' ELSE 'likely_correct' END AS rv,
        round(duration_ms / 100, 6) AS risk, round(prob_correct - 0.5, 6) AS margin FROM phones),
    v AS (SELECT *, (av = 'high_confidence_error')::INTEGER + (rv = 'likely_error')::INTEGER AS votes, (error_score >= 0.5)::INTEGER AS err,
        least(greatest(0.55 * error_score + 0.20 * risk + 0.10 * least(greatest(0.5 - margin, 0), 1), 0), 1)::DOUBLE AS s FROM a)"""


def _votes(spark, sf_dir):
    rows = phones(spark, sf_dir).drop("decision").withColumns(
        {
            "prob_error": F.col("error_score"), "attribute_verifier_decision": F.when(F.col("duration_ms") < 12, "high_confidence_error").otherwise("likely_correct"),
            "retrieval_verifier_decision": F.when(F.col("prob_correct") < 0.3, "likely_error").otherwise("likely_correct"), "attribute_risk_score": F.round(F.col("duration_ms") / 100, 6),
            "proto_margin": F.round(F.col("prob_correct") - 0.5, 6),
        }
    )
    return evidence.aggregate_votes(rows)


@query("aggregate_votes", f"""WITH {_VOTES} SELECT CASE WHEN err = 1 AND error_score >= 0.35 AND votes >= 2 THEN 'high_confidence_error' WHEN err = 1 THEN 'uncertain_review' WHEN s >= 0.2 THEN 'acceptable_accent' ELSE 'correct' END AS final_decision,
    count(*) AS n, round(avg(s), 5) AS mean_score FROM v GROUP BY 1""")  # fmt: skip
def aggregate_votes(spark, sf_dir):
    return _votes(spark, sf_dir).groupBy("final_decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("final_error_score"), 5).alias("mean_score"))


@query("evidence_patterns")
def evidence_patterns(spark, sf_dir):
    return evidence.with_evidence(_votes(spark, sf_dir)).groupBy("evidence_pattern", "audit_reason").agg(F.count(F.lit(1)).alias("n"))


@query("strict_consensus")
def strict_consensus(spark, sf_dir):
    config = evidence.Consensus(groups={"standard": (0.45, 1), "economy": (0.3, 2)})
    return evidence.strict_consensus(_votes(spark, sf_dir), config).groupBy("phone_group", "final_decision").agg(F.count(F.lit(1)).alias("n"))


@query("hourly_events", """SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def hourly_events(spark, sf_dir):
    from ..streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value").select(F.col("start").alias("hour"), "event_type", "n", "total")


@query("user_sessions", """WITH a AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
    b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT user_id, min(ts) AS start, count(*) AS n FROM b GROUP BY user_id, k""")  # fmt: skip
def user_sessions(spark, sf_dir):
    from ..streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"]).select("user_id", "start", "n")


_STATES = """m AS (SELECT target_phone, status = 'F' AS available, (duration_ms - 25) / 5 AS d, error_score * 10 - 5 AS s, prob_correct * 8 - 4 AS g FROM phones),
    p AS (SELECT *, 1 / (1 + exp(-least(greatest((d - 1.0) / 1.5, -30), 30))) AS pd, (1 / (1 + exp(-least(greatest((s - 0.75) / 1.5, -30), 30))) + 1 / (1 + exp(-least(greatest((-g - 1.0) / 2.0, -30), 30)))) / 2 AS w FROM m),
    q AS (SELECT *, w * (1 - pd) AS pw FROM p)"""


@query("phone_states", f"""WITH {PHONES}, {_STATES} SELECT target_phone, CASE WHEN NOT available THEN 'unavailable' WHEN pd / (greatest(1 - pd - pw, 0) + pw + pd) >= 0.62 THEN 'deleted'
    WHEN pw / (greatest(1 - pd - pw, 0) + pw + pd) >= 0.62 THEN 'mispronounced' ELSE 'correct' END AS phone_state, count(*) AS n FROM q GROUP BY 1, 2""")  # fmt: skip
def phone_states(spark, sf_dir):
    from ..operators.three_state import phone_states as states

    rows = phones(spark, sf_dir).select(
        "target_phone", (F.col("status") == "F").alias("ctc_phone_model_available"), ((F.col("duration_ms") - 25) / 5).alias("ctc_deletion_margin"),
        (F.col("error_score") * 10 - 5).alias("ctc_substitution_margin"), (F.col("prob_correct") * 8 - 4).alias("ctc_logit_margin"),
    )
    return states(rows).groupBy("target_phone", "phone_state").agg(F.count(F.lit(1)).alias("n"))


@query("conservative_mode", f"""WITH {PHONES}, i AS (SELECT NOT (status = 'F' AND duration_ms < 3) AS good, prob_correct AS r, error_score AS c, round(duration_ms / 50, 6) AS w, gold = 1 AS likely, status = 'O' AS variant FROM phones),
    j AS (SELECT *, good AND r >= 0.75 AS ok FROM i), k AS (SELECT *, good AND NOT ok AND NOT variant AND w >= 0.9 AND c >= 0.7 AND r <= 0.4 AND likely AS err FROM j)
    SELECT CASE WHEN NOT good THEN 'uncertain_review' WHEN err THEN 'true_error' WHEN good AND NOT ok AND NOT variant AND w >= 0.6 THEN 'uncertain_review' WHEN ok THEN 'correct' WHEN variant THEN 'acceptable_accent' ELSE 'correct' END AS decision, count(*) AS n FROM k GROUP BY 1""")  # fmt: skip
def conservative_mode(spark, sf_dir):
    from ..operators.modes import apply_mode

    relation = F.when(F.col("status") == "O", "acceptable_variant").when(F.col("gold") == 1, "likely_true_error").otherwise("")
    rows = phones(spark, sf_dir).select(
        F.when((F.col("status") == "F") & (F.col("duration_ms") < 3), "bad").otherwise("pass").alias("alignment_quality"), "prob_correct", F.col("error_score").alias("confidence"),
        F.round(F.col("duration_ms") / 50, 6).alias("manual_calibrated_error_probability"), F.lit(True).alias("calibration_available"), relation.alias("phonological_relation"),
    )
    return apply_mode(rows).groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


@query("word_sequences", """WITH p AS (SELECT l_orderkey, l_linenumber, regexp_replace(upper(p_brand), '[0-9]+$', '') AS b FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey, string_agg(b, ' ' ORDER BY l_linenumber, b) AS target_phone_seq FROM p GROUP BY 1""")  # fmt: skip
def word_sequences(spark, sf_dir):
    from ..operators.three_state import word_sequences as sequences

    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_brand").alias("target_phone"))
    return sequences(rows, ["l_orderkey"], "l_linenumber").select("l_orderkey", "target_phone_seq")


@query("gaussian_models", f"""WITH {PHONES} SELECT target_phone, count(*) AS frames, round(avg(duration_ms), 6) AS mean_duration, round(greatest(var_pop(duration_ms), 0.25), 5) AS var_duration,
    round(greatest(var_pop(error_score), 0.25), 6) AS var_score FROM phones GROUP BY 1 HAVING count(*) >= 40""")  # fmt: skip
def gaussian_models(spark, sf_dir):
    from ..operators.sequences import fit_gaussians

    found = fit_gaussians(phones(spark, sf_dir), "target_phone", ["duration_ms", "error_score"])
    return found.select(
        "target_phone", "frames", F.round(F.col("mean")[0], 6).alias("mean_duration"), F.round(F.col("variance")[0], 5).alias("var_duration"), F.round(F.col("variance")[1], 6).alias("var_score")
    )


@query("error_manifest", """WITH m AS (SELECT user_id, (epoch_us(ts) % 100000) / 1000.0::DOUBLE AS s, value AS d, CASE WHEN event_type = 'click' THEN 0 ELSE 1 END AS gold FROM events WHERE event_type <> 'purchase')
    SELECT (1 - gold)::INTEGER AS label, count(*) AS n FROM m WHERE (s + d) / 1000 - s / 1000 > 0 GROUP BY 1""")  # fmt: skip
def error_manifest(spark, sf_dir):
    from ..operators.manifests import error_manifest as manifest

    start = (F.unix_micros(F.to_timestamp("ts")) % 100000) / F.lit(1000.0)
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("utterance_id"), F.lit("AH0").alias("target_phone"), start.alias("start_ms"), (start + F.col("value")).alias("end_ms"),
        (F.col("event_type") != "click").cast("int").alias("gold_binary"), F.when(F.col("event_type") == "purchase", "review").otherwise("PASS").alias("alignment_quality"),
    )
    return manifest(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("annotations_kept", """WITH last AS (SELECT l_orderkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) = 1)
    SELECT o_orderkey AS l_orderkey, l_returnflag FROM orders LEFT JOIN last ON o_orderkey = l_orderkey""")  # fmt: skip
def annotations_kept(spark, sf_dir):
    from ..sources.sinks import with_annotations

    packet = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    former = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return with_annotations(packet, former, ["l_orderkey"], ["l_returnflag"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@query("not_done", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)")
def not_done(spark, sf_dir):
    from ..sources.sinks import not_done as left

    done = table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(F.col("l_orderkey").alias("o_orderkey"))
    return left(table(spark, sf_dir, "orders").select("o_orderkey"), done, ["o_orderkey"])


@query("ratio_sample", "WITH c AS (SELECT count(*) FILTER (toxic = 1) AS m, count(*) FILTER (toxic <> 1) AS o FROM labels) SELECT 1::INTEGER AS toxic, m AS n FROM c UNION ALL SELECT 0, least(2 * m, o) FROM c")
def ratio_sample(spark, sf_dir):
    return sampling.ratio_sample(table(spark, sf_dir, "labels"), F.col("toxic") == 1, ["doc_id"], 2, 42).groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).withColumn("toxic", F.col("toxic").cast("int"))


@query("false_alarm_rate", f"""WITH {PHONES} SELECT count(*) FILTER (gold = 0) AS rows, count(*) FILTER (gold = 0 AND decision = 1) AS alarms,
    round(count(*) FILTER (gold = 0 AND decision = 1)::DOUBLE / count(*) FILTER (gold = 0), 6) AS false_alarm_rate FROM phones""")  # fmt: skip
def false_alarm_rate(spark, sf_dir):
    return decisions.false_alarm_rate(phones(spark, sf_dir), "gold", "decision", 1)


@query("sliding_events", """SELECT (w + INTERVAL 30 MINUTE * k)::TIMESTAMP AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE AS w, event_type FROM events), range(2) r(k) GROUP BY 1, 2""")
def sliding_events(spark, sf_dir):
    from ..streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], slide="30 minutes").select("start", "event_type", "n")


@query("word_mispronunciation")
def word_mispronunciation(spark, sf_dir):
    from ..operators.confusions import word_mispronunciation as mispronounced

    phones_of = F.array(*[F.lit(p) for p in ("TH", "R", "L", "V", "IH", "IY", "AE", "EH", "B", "P", "S", "Z")])
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat_ws(" ", phones_of[F.col("l_partkey") % 12], phones_of[F.col("l_suppkey") % 12]).alias("target_phone_seq"),
        F.concat_ws(" ", phones_of[F.col("l_orderkey") % 12], phones_of[F.col("l_suppkey") % 12]).alias("predicted_phone_seq"), (F.col("l_quantity") / 50).alias("avg_phone_score"),
        (F.col("l_quantity") / 100).alias("min_phone_score"),
    )
    return mispronounced(rows).groupBy("mispronunciation_decision", "mandarin_confusion_type").agg(F.count(F.lit(1)).alias("n"))


@query("text_comparison")
def text_comparison(spark, sf_dir):
    from ..operators.sequences import compare_texts

    items = table(spark, sf_dir, "benchmark")
    following = items.select((F.col("item_id") - 1).alias("item_id"), scalars.tokens("text").alias("heard"))
    pairs = items.select("item_id", scalars.tokens("text").alias("target")).join(following, "item_id")
    return compare_texts(pairs, "item_id", "target", "heard")


@query("target_words", """WITH m AS (SELECT item_id, regexp_extract_all(text, '[A-Za-z]+(?:[''’][A-Za-z]+)*') AS w, regexp_split_to_array(text, '[A-Za-z]+(?:[''’][A-Za-z]+)*') AS g FROM benchmark),
    p AS (SELECT item_id, i - 1 AS word_index, w[i] AS o, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS a FROM m, unnest(range(1, len(w) + 1)) AS r(i))
    SELECT item_id, word_index, upper(o) AS word, replace(upper(o), '’', chr(39)) AS normalized_word, o AS original_word, a::BIGINT AS char_start, (a + length(o))::BIGINT AS char_end FROM p""")  # fmt: skip
def target_words(spark, sf_dir):
    from ..functions.lexicon import target_words as words

    return words(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query("ctc_word_deletions")
def ctc_word_deletions(spark, sf_dir):
    from ..operators.sequences import word_deletions_ctc

    rows = table(spark, sf_dir, "embeddings")
    emissions = rows.select((F.col("vec_id") % 50).alias("utterance"), F.col("vec_id").alias("frame"), F.slice("embedding", 1, 8).cast("array<double>").alias("logits"))
    words = spark.range(60).select(F.col("id").alias("utterance"), F.posexplode(F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))).alias("word_index", "labels"))
    return word_deletions_ctc(emissions, words, "utterance")


@query("fusion_classifier")
def fusion_classifier(spark, sf_dir):
    from ..operators import models

    rows = phones(spark, sf_dir).select("utterance_id", "word_index", "split", "gold", "error_score", "prob_correct", "duration_ms", "phone_group")
    numeric, categorical = ["error_score", "prob_correct", "duration_ms"], ["phone_group"]
    model = models.fit(rows.where("split = 0"), "gold", numeric, categorical)
    return models.scored(model, rows.where("split <> 0"), numeric, categorical).select("utterance_id", "word_index", F.round("score", 6).alias("score"))


@query("review_table", f"""WITH {PHONES}, r AS (SELECT *, CASE WHEN gold = 1 THEN 'true_error' WHEN status = 'O' THEN 'acceptable_accent' ELSE 'correct' END AS l FROM phones WHERE decision = 1)
    SELECT target_phone, count(*) AS reviewed_count, sum(gold)::BIGINT AS manual_true_error_count, (count(*) - sum(gold))::BIGINT AS manual_non_error_count, count(*) FILTER (l = 'acceptable_accent') AS acceptable_accent_count,
        count(*) FILTER (l = 'correct') AS correct_count, 0::BIGINT AS bad_alignment_count, round(avg(error_score), 6) AS mean_final_error_score, round(sum(gold)::DOUBLE / count(*), 6) AS manual_precision FROM r GROUP BY 1""")  # fmt: skip
def review_table(spark, sf_dir):
    from ..operators.reports import review_table as reviews

    label = F.when(F.col("gold") == 1, "true_error").when(F.col("status") == "O", "acceptable_accent").otherwise("correct")
    rows = phones(spark, sf_dir).where("decision = 1").withColumns({"manual_review_label": label, "manual_is_error": F.col("gold"), "final_error_score": F.col("error_score")})
    return reviews(rows, "target_phone")


@query("alarm_summary", f"""WITH {PHONES} SELECT count(*) AS false_positive_count, 0::BIGINT AS weak_vowel_rows, 0::BIGINT AS weak_vowel_phones, count(*) FILTER (duration_ms < 50) AS short_duration_count,
    count(*) FILTER (prob_correct >= 0.75) AS high_prob_correct_count FROM phones WHERE decision = 1 AND gold = 0""")  # fmt: skip
def alarm_summary(spark, sf_dir):
    from ..operators.reports import alarm_summary as alarms

    return alarms(phones(spark, sf_dir), (F.col("decision") == 1) & (F.col("gold") == 0))


@query("score_summary", f"""WITH {PHONES} SELECT 'duration_ms' AS score, count(duration_ms) AS n, count(DISTINCT duration_ms) AS distinct_values, min(duration_ms) AS least, round(quantile_cont(duration_ms, 0.25), 6) AS q25,
    round(median(duration_ms), 6) AS median, round(quantile_cont(duration_ms, 0.75), 6) AS q75, max(duration_ms) AS greatest, round(avg(duration_ms), 6) AS mean, false AS constant FROM phones""")  # fmt: skip
def score_summary(spark, sf_dir):
    from ..operators.reports import score_summary as summary

    return summary(phones(spark, sf_dir), ["duration_ms"])


@query("duration_priors", f"WITH {PHONES} SELECT target_phone, median(duration_ms) AS median_ms, count(*) AS n FROM phones WHERE gold = 0 AND split = 0 GROUP BY 1")
def duration_priors(spark, sf_dir):
    from ..operators.reports import duration_priors as priors

    return priors(phones(spark, sf_dir), "target_phone", "duration_ms", F.expr("gold = 0 AND split = 0"))


@query("word_labels", """WITH w AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_discount * 20 >= 1.5) AS good, count(*) FILTER (l_discount * 20 >= 0.5 AND l_discount * 20 < 1.5) AS fair, count(*) FILTER (l_discount * 20 < 0.5) AS poor,
        bool_or(l_quantity < 3) AS missing FROM lineitem GROUP BY 1)
    SELECT l_orderkey, n, good, fair, poor, CASE WHEN 2 * good > n THEN 'word_correct' WHEN 2 * fair > n AND poor = 0 THEN 'acceptable_accent' WHEN poor > 0 AND missing THEN 'deletion_or_missing' WHEN poor > 0 THEN 'mispronounced'
        WHEN good > 0 THEN 'word_correct' ELSE 'acceptable_accent' END AS word_label FROM w""")  # fmt: skip
def word_labels(spark, sf_dir):
    from ..operators.reports import word_label_from_scores

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_discount") * 20).alias("s"), "l_quantity")
    return word_label_from_scores(rows, ["l_orderkey"], "s", F.col("l_quantity") < 3)


@query("boundary_errors", """WITH e AS (SELECT abs(l_extendedprice / 100 - l_quantity * 10) AS e FROM lineitem) SELECT count(*) AS boundaries, round(median(e), 6) AS median_ms, round(quantile_cont(e, 0.75), 6) AS p75_ms,
    round(avg((e <= 50)::INTEGER), 6) AS within_50_ms, round(avg((e <= 100)::INTEGER), 6) AS within_100_ms FROM e""")  # fmt: skip
def boundary_errors(spark, sf_dir):
    from ..operators.reports import boundary_errors as errors

    rows = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 100).alias("p"), (F.col("l_quantity") * 10).alias("g"))
    return errors(rows, "p", "g")


@query("deletion_policies", f"""WITH {PHONES} SELECT 'confirmed' AS policy, count(*) FILTER (gold = 1 AND error_score >= 0.8) AS tp, count(*) FILTER (gold = 0 AND error_score >= 0.8) AS fp, count(*) FILTER (gold = 1 AND error_score < 0.8) AS fn FROM phones
    UNION ALL SELECT 'possible', count(*) FILTER (gold = 1 AND error_score >= 0.5), count(*) FILTER (gold = 0 AND error_score >= 0.5), count(*) FILTER (gold = 1 AND error_score < 0.5) FROM phones""")  # fmt: skip
def deletion_policies(spark, sf_dir):
    from ..operators.reports import deletion_policies as policies

    return policies(phones(spark, sf_dir), F.col("gold") == 1, {"confirmed": F.col("error_score") >= 0.8, "possible": F.col("error_score") >= 0.5})


@query("corpus_counts", "SELECT o_orderstatus, count(*) AS rows, count(DISTINCT o_custkey) AS speakers FROM orders GROUP BY 1")
def corpus_counts(spark, sf_dir):
    from ..operators.reports import corpus_counts as counts

    return counts(table(spark, sf_dir, "orders"), "o_orderstatus", "o_custkey")


@query("false_alarms_by_phone", f"WITH {PHONES} SELECT target_phone, phone_group, count(*) AS false_positive_count FROM phones WHERE decision = 1 AND gold = 0 GROUP BY 1, 2")
def false_alarms_by_phone(spark, sf_dir):
    from ..operators.reports import false_alarms

    return false_alarms(phones(spark, sf_dir), ["target_phone", "phone_group"], (F.col("decision") == 1) & (F.col("gold") == 0))


@query("policy_comparison", f"""WITH {PHONES}, l AS (SELECT gold, unnest([{{'policy': 'main', 'd': decision, 's': error_score}}, {{'policy': 'short', 'd': (duration_ms < 10)::INTEGER, 's': duration_ms}}]) AS x FROM phones)
    SELECT x.policy AS policy, count(*) AS n, count(*) FILTER (x.d = 1) AS errors, count(*) FILTER (x.d = 1 AND gold = 1) AS hits, round(avg(x.s), 6) AS mean_score FROM l GROUP BY 1""")  # fmt: skip
def policy_comparison(spark, sf_dir):
    from ..operators.projections import policies

    rows = phones(spark, sf_dir).withColumn("short", (F.col("duration_ms") < 10).cast("int"))
    long = policies(rows, ["gold"], {"main": ("decision", "error_score"), "short": ("short", "duration_ms")})
    hit = F.col("policy_decision") == "1"
    return long.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("errors"), F.count_if(hit & (F.col("gold") == 1)).alias("hits"), F.round(F.avg("policy_score"), 6).alias("mean_score"))


@query("cascade_scores", """SELECT l_returnflag, count(*) AS n, count(*) FILTER (o_orderkey IS NOT NULL) AS candidates, round(sum(coalesce(o_totalprice, 0)), 2) AS total FROM lineitem
    LEFT JOIN (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F') ON o_orderkey = l_orderkey GROUP BY 1""")  # fmt: skip
def cascade_scores(spark, sf_dir):
    from ..operators.projections import cascade_scores as cascade

    candidates = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_totalprice").alias("verifier_score"))
    scored = cascade(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag"), candidates, ["l_orderkey"])
    return scored.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("candidate_label").cast("long").alias("candidates"), F.round(F.sum("cascade_score"), 2).alias("total"))


@query("group_pr_summary", f"""WITH {PHONES}, {curve('target_phone')}, a AS (SELECT target_phone, round({_ratio('sum(pos * (2 * (negatives - fp) + neg))', '2 * max(positives) * max(negatives)', '0.5')}, 6) AS auc,
        round({_ratio('sum(pos::DOUBLE * tp / (tp + fp))', 'max(positives)')}, 6) AS average_precision FROM curve GROUP BY 1),
    b AS (SELECT target_phone, threshold, prec, rec FROM points WHERE positives > 0 QUALIFY row_number() OVER (PARTITION BY target_phone ORDER BY {_ORDER}) = 1)
    SELECT target_phone, threshold, prec AS "precision", rec AS recall, prec >= 0.36 AS found, auc, average_precision, round({_ratio('2 * prec * rec', 'prec + rec')}, 6) AS f1, prec >= 0.36 AND rec >= 0.05 AS accepted FROM b JOIN a USING (target_phone)""")  # fmt: skip
def group_pr_summary(spark, sf_dir):
    from ..operators.projections import group_pr_summary as summary

    return summary(phones(spark, sf_dir), "target_phone", "error_score", "gold", 0.36)


@query("operating_points", f"""WITH {PHONES}, {curve()} SELECT m::DOUBLE AS most_fpr, threshold, rec AS recall, fpr FROM points, (VALUES (0.1), (0.3), (0.5)) v(m) WHERE fpr <= m
    QUALIFY row_number() OVER (PARTITION BY m ORDER BY rec DESC, threshold DESC) = 1""")  # fmt: skip
def operating_points(spark, sf_dir):
    from ..operators.projections import operating_points as points

    return points(phones(spark, sf_dir), "error_score", "gold", [0.1, 0.3, 0.5])


@query("word_flags", """WITH w AS (SELECT l_orderkey, count(*) AS n, max(l_linenumber * 60.0::DOUBLE + l_quantity) - min(l_linenumber * 60.0::DOUBLE) AS d FROM lineitem GROUP BY 1)
    SELECT n >= 4 AND d < greatest(80, n * 20) AS possible_missing_word, sum(n)::BIGINT AS phones FROM w GROUP BY 1""")  # fmt: skip
def word_flags(spark, sf_dir):
    from ..operators.projections import with_word_flags

    start = F.col("l_linenumber") * 60.0
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", start.alias("start_ms"), (start + F.col("l_quantity")).alias("end_ms"), F.col("l_quantity").alias("duration_ms"))
    return with_word_flags(rows, ["l_orderkey"]).groupBy("possible_missing_word").agg(F.count(F.lit(1)).alias("phones"))


@query("diverse_words", """WITH w AS (SELECT o_custkey, upper(o_orderpriority) AS w, min(o_orderkey) AS i FROM orders GROUP BY 1, 2)
    SELECT o_custkey, i AS o_orderkey, w AS o_orderpriority FROM w QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (CASE WHEN w = '5-LOW' THEN 0 ELSE 1 END), i) <= 2""")  # fmt: skip
def diverse_words(spark, sf_dir):
    from ..operators.projections import diverse_words as diverse

    return diverse(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderpriority", ["5-LOW"], 2)


@query("audit_view", "SELECT o_orderkey::VARCHAR AS o_orderkey, coalesce(o_orderstatus, '') AS o_orderstatus, '' AS notes FROM orders")
def audit_view(spark, sf_dir):
    from ..operators.projections import view

    return view(table(spark, sf_dir, "orders"), ["o_orderkey", "o_orderstatus", "notes"])


@query("translated_labels", "SELECT CASE WHEN o_totalprice < 50000 THEN 'bad_alignment' WHEN o_orderstatus = 'F' THEN 'true_error' WHEN o_orderstatus = 'O' THEN 'correct' ELSE o_orderstatus END AS e2e_label, count(*) AS n FROM orders GROUP BY 1")
def translated_labels(spark, sf_dir):
    from ..operators.projections import translated

    rows = translated(table(spark, sf_dir, "orders"), "o_orderstatus", {"F": "true_error", "O": "correct"}, "e2e_label", F.col("o_totalprice") < 50000, "bad_alignment")
    return rows.groupBy("e2e_label").agg(F.count(F.lit(1)).alias("n"))


from . import acoustics as _acoustics, diagnoses as _diagnoses, evaluations as _evaluations, exchange as _exchange, reporting as _reporting, training as _training  # noqa: E402, F401  register their queries here
