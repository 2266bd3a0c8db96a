"""Classification, ranking and regression metrics as aggregates.

Counts come from one ``groupBy`` with partial aggregation. Ranking metrics first
sum the rows to distinct scores; running counts over these are added up in two
steps (buckets of scores, then inside a bucket), so no task sorts a whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Buckets that one unit of the score is divided into.
BUCKETS = 1024


def ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    """a / b as a double, the default where b is 0."""
    return F.when(b == 0, F.lit(default)).otherwise(a.cast("double") / b.cast("double"))


def confusion(label: Column, decision: Column) -> list[Column]:
    """Counts tp, fp, fn, tn and support; label and decision are 0 or 1."""
    return [
        F.count_if((label == 1) & (decision == 1)).alias("tp"),
        F.count_if((label == 0) & (decision == 1)).alias("fp"),
        F.count_if((label == 1) & (decision == 0)).alias("fn"),
        F.count_if((label == 0) & (decision == 0)).alias("tn"),
        F.count(F.lit(1)).alias("support"),
    ]


def derived(df: DataFrame, digits: int = 6) -> DataFrame:
    """AG-01, AG-09: precision, recall, f1, accuracy, balanced_accuracy, macro_f1 of the counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    specificity = F.when(tn + fp == 0, ratio(tp, tp + fn)).otherwise(ratio(tn, tn + fp))
    recall_or = F.when(tp + fn == 0, ratio(tn, tn + fp)).otherwise(ratio(tp, tp + fn))
    f1, f1_other = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return df.withColumns(
        {
            "precision": F.round(ratio(tp, tp + fp), digits),
            "recall": F.round(ratio(tp, tp + fn), digits),
            "f1": F.round(f1, digits),
            "accuracy": F.round(ratio(tp + tn, tp + fp + fn + tn), digits),
            "balanced_accuracy": F.round((recall_or + specificity) / 2, digits),
            "macro_f1": F.round((f1 + f1_other) / 2, digits),
        }
    )


def grouped_metrics(df: DataFrame, keys: Sequence[str], label: str, decision: str, means: Sequence[str] = ()) -> DataFrame:
    """AG-02, AG-03, AG-05, AG-10, AG-12, AG-29, AG-37: counts and metrics per group, with means of score columns."""
    aggregates = [*confusion(F.col(label), F.col(decision)), *[F.round(F.avg(m), 6).alias(f"mean_{m}") for m in means]]
    return derived(df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates))


def metrics_by_each(df: DataFrame, keys: Sequence[str], label: str, decision: str) -> DataFrame:
    """AG-07, AG-08, AG-30, AG-42, AG-52: metrics by each key on its own and over all rows, in one pass (grouping sets)."""
    sets = [[F.col(k)] for k in keys] + [[]]
    grouped = df.groupingSets(sets, *keys).agg(F.grouping_id().alias("level"), *confusion(F.col(label), F.col(decision)))
    name = F.coalesce(*[F.when(F.col(k).isNotNull(), F.lit(k)) for k in keys], F.lit("all"))
    value = F.coalesce(*[F.col(k).cast("string") for k in keys], F.lit("all"))
    return derived(grouped.withColumns({"dimension": name, "value": value}).drop(*keys, "level"))


def pattern_metrics(df: DataFrame, pattern: str, label: str, decision: str) -> DataFrame:
    """AG-04: per pattern the predictions, hits, false alarms, precision and share of all errors found."""
    label, decision = F.col(label), F.col(decision)
    total = df.agg(F.greatest(F.sum(label.cast("long")), F.lit(1)).alias("errors"))
    by = df.groupBy(pattern).agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if(decision == 1).alias("predicted_error_count"),
        F.count_if((label == 1) & (decision == 1)).alias("true_positive_count"), F.count_if((label == 0) & (decision == 1)).alias("false_positive_count"),
    )
    return by.join(F.broadcast(total)).select(  # one row
        pattern, "sample_count", "predicted_error_count", "true_positive_count", "false_positive_count",
        F.round(ratio(F.col("true_positive_count"), F.col("predicted_error_count")), 6).alias("precision"),
        F.round(ratio(F.col("true_positive_count"), F.col("errors")), 6).alias("recall_contribution"),
    )


def running_counts(df: DataFrame, score: str, label: str | tuple[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Distinct scores of each group with pos, neg, and above_pos, above_neg: the rows of greater or equal score.

    ``label`` may be two columns of counts, of errors and of others, in a table with one row per group and score.
    Rows without a score or a label take no part.
    """
    if isinstance(label, tuple):
        own = df.where(F.col(score).isNotNull()).select(*keys, F.col(score).alias("score"), F.col(label[0]).alias("pos"), F.col(label[1]).alias("neg")).where("pos + neg > 0")
    else:
        rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        own = rows.groupBy(*keys, F.col(score).cast("double").alias("score")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    distinct = own.withColumn("bucket", F.floor(F.col("score") * BUCKETS))
    sums = distinct.groupBy(*keys, "bucket").agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    over = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    sums = sums.select(
        *keys, "bucket", F.coalesce(F.sum("p").over(over), F.lit(0)).alias("p_before"), F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n_before"),
        F.sum("p").over(whole).alias("positives"), F.sum("n").over(whole).alias("negatives"),
    )
    inside = Window.partitionBy(*keys, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    joined = distinct.join(sums, [*keys, "bucket"])
    return joined.select(
        *keys, "score", "pos", "neg", (F.col("p_before") + F.sum("pos").over(inside)).alias("above_pos"),
        (F.col("n_before") + F.sum("neg").over(inside)).alias("above_neg"), "positives", "negatives",
    )


def pr_curve(df: DataFrame, score: str, label: str | tuple[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """WN-08, WN-16, AG-23: precision and recall of the decision score >= threshold, a row per distinct score."""
    c = running_counts(df, score, label, keys)
    return c.select(
        *keys, F.col("score").alias("threshold"), F.col("above_pos").alias("tp"), F.col("above_neg").alias("fp"), "positives", "negatives",
        F.round(ratio(F.col("above_pos"), F.col("above_pos") + F.col("above_neg")), 9).alias("precision"),
        F.round(ratio(F.col("above_pos"), F.col("positives")), 9).alias("recall"),
        F.round(ratio(F.col("above_neg"), F.col("negatives")), 9).alias("fpr"),
    )


def ranking_metrics(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """AG-20, AG-21, AG-39: auc (0.5 for one class; ties count half) and average_precision."""
    c = running_counts(df, score, label, keys)
    below = F.col("negatives") - F.col("above_neg")
    gain = F.col("pos") * (2 * below + F.col("neg"))
    step = F.col("pos").cast("double") * F.col("above_pos") / (F.col("above_pos") + F.col("above_neg"))
    sums = [F.sum(gain).alias("g"), F.sum(step).alias("s"), F.max("positives").alias("positives"), F.max("negatives").alias("negatives")]
    found = c.groupBy(*keys).agg(*sums) if keys else c.agg(*sums)
    both = F.col("positives") * F.col("negatives")
    return found.select(
        *keys, "positives", "negatives", F.round(ratio(F.col("g"), 2 * both, 0.5), 6).alias("auc"),
        F.round(ratio(F.col("s"), F.col("positives")), 6).alias("average_precision"),
    )


def calibration_rows(df: DataFrame, keys: Sequence[str], label: str, prediction: str, score: str) -> DataFrame:
    """AG-24: a row of metrics per group of keys (split, model, calibration), where label 1 is a correct phone and 0 an error.

    The error class has precision, recall and F1 of its own; macro F1 is over the classes that occur. auc is 0.5 for one class. Rows with a null
    score count in all but auc; null keys are a group.
    """
    counts = df.groupBy(*keys).agg(*confusion(F.col(label), F.col(prediction)))
    ranks = ranking_metrics(df.where(F.col(score).isNotNull()), score, label, keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "auc")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    rows = derived(counts).join(ranks, same, "left").drop(*[f"_{k}" for k in keys])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    good, bad = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    macro = F.when(tp + fp + fn == 0, bad).when(tn + fp + fn == 0, good).otherwise((good + bad) / 2)
    return rows.select(
        *keys, F.col("support").alias("n"), "accuracy", "balanced_accuracy", F.col("precision").alias("precision_correct_class"), F.col("recall").alias("recall_correct_class"),
        F.round(macro, 6).alias("macro_f1"), F.coalesce("auc", F.lit(0.5)).alias("auc"), F.round(ratio(tn, tn + fn), 6).alias("error_precision"),
        F.round(ratio(tn, tn + fp), 6).alias("error_recall"), F.round(bad, 6).alias("error_f1"), tn.alias("tn_error_predicted_error"),
        fp.alias("fp_correct_predicted_error"), fn.alias("fn_error_predicted_correct"), tp.alias("tp_correct_predicted_correct"),
    )


def reliability(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """AG-32: a row per equal-width bin with its share of errors, mean score and gap, empty bins too."""
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    sums = df.where(F.col(score).between(0, 1)).groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col(score)).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("error_rate")
    )
    return spine.join(sums, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("mean_score", 6).alias("mean_score"), F.round("error_rate", 6).alias("error_rate"),
        F.round(F.abs(F.col("mean_score") - F.col("error_rate")), 6).alias("gap"),
    )


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """AG-32: expected calibration error and Brier score, one row."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    sums = df.where(F.col(score).between(0, 1)).groupBy(at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(score)).alias("s"), F.sum(F.col(label).cast("double")).alias("e"),
        F.sum(F.pow(F.col(score) - F.col(label), 2)).alias("b"),
    )
    return sums.agg(F.round(F.sum(F.abs(F.col("s") - F.col("e"))) / F.sum("n"), 6).alias("ece"), F.round(F.sum("b") / F.sum("n"), 6).alias("brier"))


def score_histogram(df: DataFrame, score: str, label: str, bins: int = 50) -> DataFrame:
    """AG-23: counts by bin of 0..1 and label; the last bin is closed."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")
    return df.where(F.col(score).between(0, 1)).groupBy(at.alias("bin")).agg(
        F.count_if(F.col(label) == 0).alias("n_0"), F.count_if(F.col(label) == 1).alias("n_1")
    )


def label_counts(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """AG-22, AG-25: counts by label, total and error rate per group."""
    return df.groupBy(*keys).agg(
        F.count_if(F.col(label) == 0).alias("n_0"), F.count_if(F.col(label) == 1).alias("n_1"), F.count(F.lit(1)).alias("total")
    ).withColumn("error_rate", F.round(ratio(F.col("n_1"), F.col("total")), 6))


def case_types(label: Column, decision: Column) -> Column:
    """AG-25: the four cases of a decision by name."""
    return F.when((label == 1) & (decision == 1), "true_positive").when((label == 0) & (decision == 1), "false_positive").when(
        (label == 1) & (decision == 0), "false_negative"
    ).otherwise("true_negative")


def pearson(a: str, b: str) -> Column:
    """Pearson correlation; null where either is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def regression_metrics(df: DataFrame, gold: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """AG-40, AG-41: mean squared error and Pearson correlation."""
    sums = [
        F.count(F.lit(1)).alias("n"), F.round(F.avg(F.pow(F.col(gold) - F.col(predicted), 2)), 6).alias("mse"), F.round(pearson(gold, predicted), 6).alias("pcc")
    ]
    return df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)


def multiclass_report(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """AG-55: per class precision, recall, f1 and support, from the confusion counts."""
    cells = df.groupBy(F.col(gold).alias("g"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    both = cells.select(F.explode(F.array(
        F.struct(F.col("g").alias("label"), F.col("n").alias("gold_n"), F.lit(0).cast("long").alias("pred_n"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("gold_n"), F.col("n").alias("pred_n"), F.lit(0).cast("long").alias("hit")),
    )).alias("x")).select("x.*")
    sums = both.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("gold_n", "pred_n", "hit")])
    hit, g, p = F.col("hit"), F.col("gold_n"), F.col("pred_n")
    return sums.select(
        "label", g.alias("support"), F.round(ratio(hit, p), 6).alias("precision"), F.round(ratio(hit, g), 6).alias("recall"), F.round(ratio(2 * hit, g + p), 6).alias("f1")
    )


def threshold_summary(df: DataFrame, keys: Sequence[str] = (), column: str = "threshold", most: int = 5) -> DataFrame:
    """AG-06: the least ``most`` distinct thresholds of a group, ascending, rounded to 6 digits and joined by ';'; '' without any.

    Distinct values are found by an aggregate and ranked by a window that keeps ``most`` of them, so a group with very many is not gathered.
    """
    value = F.expr(f"try_cast(`{column}` AS double)")
    each = df.select(*keys, F.when(~F.isnan(value), value).alias("_t"))
    least = each.where("_t IS NOT NULL").groupBy(*keys, "_t").agg(F.lit(1).alias("_1")).withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_1").orderBy("_t"))).where(F.col("_r") <= most)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("_t")), lambda t: F.round(t, 6).cast("string")), ";").alias("thresholds")  # ``most`` values
    found = least.groupBy(*keys).agg(listed) if keys else least.agg(listed)
    if not keys:
        return found.select(F.coalesce("thresholds", F.lit("")).alias("thresholds"))
    groups = each.select(*keys).distinct()
    same = [groups[k].eqNullSafe(found[k]) for k in keys]
    return groups.join(found, same, "left").select(*[groups[k] for k in keys], F.coalesce("thresholds", F.lit("")).alias("thresholds"))
