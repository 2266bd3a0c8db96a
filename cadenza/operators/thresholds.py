"""Threshold search, hierarchical calibration and parameter sweeps.

A curve is a table with a row per distinct score and group; every search is one
aggregate over it (``max_by`` of an ordered struct), for all groups at once.
Sweeps evaluate all settings in one pass over the data.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored
from .metrics import confusion, derived, pr_curve, ratio


def _best(curve: DataFrame, keys: Sequence[str], order: Sequence[Column], where: Column, outputs: Sequence[str]) -> DataFrame:
    """The row of each group that is greatest by ``order`` among those where ``where`` holds; null outputs if none."""
    rank = F.when(where, F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)]))
    chosen = F.max_by(F.struct(*outputs), rank).alias("x")
    found = curve.groupBy(*keys).agg(chosen, F.count_if(where).alias("n")) if keys else curve.agg(chosen, F.count_if(where).alias("n"))
    return found.select(*keys, *[F.when(F.col("n") > 0, F.col(f"x.{o}")).alias(o) for o in outputs])


POINT = ("threshold", "precision", "recall")


def recall_at_precision(df: DataFrame, score: str, label: str, least: float, keys: Sequence[str] = ()) -> DataFrame:
    """WN-08, WN-17..20, WN-22..24: greatest recall with precision >= least, of equal ones the lowest threshold; null if unreachable."""
    curve = pr_curve(df, score, label, keys)
    return _best(curve, keys, [F.col("recall"), -F.col("threshold")], (F.col("precision") >= least) & (F.col("positives") > 0), POINT)


def threshold_or_most_precise(df: DataFrame, score: str, label: str | tuple[str, str], least: float, keys: Sequence[str] = ()) -> DataFrame:
    """WN-09, ML-49: as recall_at_precision, falling back on the most precise point (then recall); found tells which."""
    curve = pr_curve(df, score, label, keys).where("positives > 0")
    met = F.col("precision") >= least
    order = [met.cast("int"), F.when(met, F.col("recall")).otherwise(F.col("precision")), F.when(met, -F.col("threshold")).otherwise(F.col("recall"))]
    found = _best(curve, keys, order, F.lit(True), POINT)
    return found.withColumn("found", F.coalesce(F.col("precision") >= least, F.lit(False)))


def best_f1(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """WN-10: the threshold of greatest F1, of equal ones the lowest."""
    curve = pr_curve(df, score, label, keys).withColumn("f1", F.round(ratio(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives")), 9))
    return _best(curve, keys, [F.col("f1"), -F.col("threshold")], F.lit(True), ("threshold", "f1"))


def precision_at_recall(df: DataFrame, score: str, label: str, target: float, keys: Sequence[str] = ()) -> DataFrame:
    """WN-11: the most precise point with recall >= target."""
    curve = pr_curve(df, score, label, keys)
    return _best(curve, keys, [F.col("precision"), F.col("threshold")], F.col("recall") >= target, POINT)


def recall_at_fpr(df: DataFrame, score: str, label: str, most: float, keys: Sequence[str] = ()) -> DataFrame:
    """WN-12, WN-21: greatest recall with a false positive rate <= most, of equal ones the highest threshold."""
    curve = pr_curve(df, score, label, keys)
    return _best(curve, keys, [F.col("recall"), F.col("threshold")], F.col("fpr") <= most, ("threshold", "recall", "fpr"))


def best_on_grid(df: DataFrame, score: str, label: str, candidates: Sequence[float], objective: str, keys: Sequence[str] = ()) -> DataFrame:
    """ML-10, ML-42..48: the candidate threshold of greatest objective, of equal ones the first.

    Scores are first counted by the last candidate that they reach, so the data are read once
    whatever the number of candidates.
    """
    grid = sorted(set(float(c) for c in candidates))
    listed = F.array(*[F.lit(c) for c in grid])
    reached = F.size(F.filter(listed, lambda c: c <= F.col(score)))
    cells = df.groupBy(*keys, reached.alias("reached")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    steps = F.posexplode(listed).alias("i", "threshold")
    counted = cells.select(*keys, "reached", "p", "n", steps).groupBy(*keys, "i", "threshold").agg(
        F.sum(F.when(F.col("reached") > F.col("i"), F.col("p")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("reached") > F.col("i"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("reached") <= F.col("i"), F.col("p")).otherwise(0)).alias("fn"),
        F.sum(F.when(F.col("reached") <= F.col("i"), F.col("n")).otherwise(0)).alias("tn"),
    )
    return _best(derived(counted), keys, [F.col(objective), -F.col("i")], F.lit(True), ("threshold", objective))


def hierarchical_thresholds(
    dev: DataFrame, score: str, label: str, levels: Sequence[str], least_precision: float, least_rows: int, least_positives: int
) -> DataFrame:
    """ML-11, ML-13, ML-14, ML-17: (level, key, threshold) for all rows and for every value of each level that has support.

    A value needs ``least_rows`` rows, ``least_positives`` errors and one correct row. The rows are counted once by
    levels and score; the counts, not the rows, are dealt to the levels, and one search serves all of them.
    """
    value = F.col(score).cast("double")
    counts = dev.groupBy(*levels, value.alias("_score")).agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    places = [F.struct(F.lit(level).alias("level"), F.col(level).cast("string").alias("key")) for level in levels]
    everywhere = F.struct(F.lit("global").alias("level"), F.lit("").alias("key"))
    dealt = counts.select("_score", "_n", "_pos", "_neg", F.inline(F.array(everywhere, *places))).groupBy("level", "key", "_score").agg(*[F.sum(c).alias(c) for c in ("_n", "_pos", "_neg")])
    whole = Window.partitionBy("level", "key")  # a row a score: as many as a value has distinct scores, already counted
    supported = dealt.withColumns({"_rows": F.sum("_n").over(whole), "_errors": F.sum("_pos").over(whole)})
    enough = (F.col("_rows") >= least_rows) & (F.col("_errors") >= least_positives) & (F.col("_rows") > F.col("_errors")) & F.col("key").isNotNull()
    kept = supported.where((F.col("level") == "global") | enough)
    found = threshold_or_most_precise(kept, "_score", ("_pos", "_neg"), least_precision, ["level", "key"]).select("level", "key", "threshold")
    found = stored(found, "thresholds")  # a row a value; the search runs once
    whole_table = dev.sparkSession.createDataFrame([("global", "")], "level string, key string")  # there with a null threshold, too
    return found.where("level <> 'global'").unionByName(whole_table.join(F.broadcast(found.where("level = 'global'")), ["level", "key"], "left"))


def apply_thresholds(df: DataFrame, thresholds: DataFrame, score: str, levels: Sequence[str]) -> DataFrame:
    """ML-12, ML-16, ML-50, ML-51: threshold and its source by the first level that has one, the decision, and confidence."""
    thresholds = stored(thresholds, "thresholds")  # read for each level
    out, sources, values = df, [], []
    for level in levels:
        own = thresholds.where(F.col("level") == level).select(F.col("key").alias(f"_{level}"), F.col("threshold").alias(f"_t_{level}"))
        out = out.join(own, F.col(level).cast("string") == F.col(f"_{level}"), "left").drop(f"_{level}")
        values.append(F.col(f"_t_{level}"))
        sources.append(F.when(F.col(f"_t_{level}").isNotNull(), level))
    everywhere = thresholds.where("level = 'global'").agg(F.first("threshold").alias("_t_global"))
    out = out.join(F.broadcast(everywhere))  # one row
    chosen = F.coalesce(*values, "_t_global")
    return out.withColumns(
        {
            "threshold": chosen,
            "threshold_source": F.coalesce(*sources, F.lit("global")),
            "decision": (F.col(score) >= chosen).cast("int"),
            "confidence": F.greatest(F.col(score), 1 - F.col(score)),
        }
    ).drop("_t_global", *[f"_t_{level}" for level in levels])


def settings(grid: Mapping[str, Sequence[float]]) -> list[dict[str, float]]:
    """ML-37, ML-40: every combination, the last parameter changing fastest."""
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def sweep(df: DataFrame, grid: Mapping[str, Sequence[float]], decide, label: str, inputs: Sequence[str], cells: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """ML-38, ML-39, ML-41: confusion counts and metrics of every setting, in one pass.

    ``decide(row, setting)`` gives the decision as a boolean column of ``inputs`` and
    of the parameters. ``cells`` names the parameters that an input is compared with (by >=, >, <= or <): the input is
    first replaced by one value of its cell between their values, so the settings multiply at
    most the cells of the grid, however many rows and distinct inputs there are. Inputs
    without an entry are merged by equal values.
    """
    merged = df.select(*[_cell(F.col(c), [v for p in cells[c] for v in grid[p]]).alias(c) if cells and c in cells else F.col(c) for c in inputs], label)
    merged = merged.groupBy(*inputs, label).agg(F.count(F.lit(1)).alias("weight"))
    table = F.array(*[F.struct(F.lit(i).alias("setting"), *[F.lit(float(v)).alias(k) for k, v in s.items()]) for i, s in enumerate(settings(grid))])
    each = merged.select("*", F.explode(table).alias("s")).select(*inputs, label, "weight", "s.*")
    hit = decide({c: F.col(c) for c in inputs}, {k: F.col(k) for k in grid})
    error, w = F.col(label) == 1, F.col("weight")
    counts = {"tp": hit & error, "fp": hit & ~error, "fn": ~hit & error, "tn": ~hit & ~error}
    summed = each.groupBy("setting", *grid).agg(*[F.sum(F.when(c, w).otherwise(0)).alias(k) for k, c in counts.items()])
    return derived(summed)


def _cell(value: Column, candidates: Sequence[float]) -> Column:
    """The candidate that the value equals, else a number between the candidates beside it; nulls stay."""
    at = sorted({float(c) for c in candidates})
    found = F.lit(at[0] - 1.0)
    for low, high in zip(at, [*at[1:], at[-1] + 2.0]):
        found = F.when(value == low, low).when(value > low, (low + high) / 2).otherwise(found)
    return F.when(value.isNotNull(), found)


def best_setting(swept: DataFrame, least_precision: float) -> DataFrame:
    """SO-03, SO-04, SO-11, SO-12, ML-69: of the settings that are precise enough, else of all, the best; ties by number."""
    met = (F.col("precision") >= least_precision).cast("int")
    return swept.orderBy(F.desc(met), F.desc("recall"), F.desc("precision"), F.desc("balanced_accuracy"), "setting").limit(1)


def decision_counts(df: DataFrame, keys: Sequence[str], label: str, score: str, threshold: float) -> DataFrame:
    """ML-15, ML-28: metrics of a fixed threshold per group."""
    return derived(df.groupBy(*keys).agg(*confusion(F.col(label), (F.col(score) >= threshold).cast("int"))))
