"""Window operators over groups: outliers, runs, neighbours and normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..storage import stored
from .quantiles import exact_quantiles


def duration_outlier(df: DataFrame, duration: str, key: str, z: float = 2.5) -> DataFrame:
    """WN-01: duration_outlier_flag, 1 where the duration is z sample deviations from the group's mean.

    The group's figures are an aggregate that is joined back, so a large group isn't held in one task.
    """
    value = F.coalesce(F.col(duration).cast("double"), F.lit(0.0))
    stats = df.groupBy(key).agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    score = F.abs(F.coalesce((value - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)), F.lit(0.0)))
    joined = df.withColumn("_key", F.col(key)).join(stats.withColumnRenamed(key, "_k"), F.col("_key").eqNullSafe(F.col("_k")))
    return joined.withColumn("duration_outlier_flag", (score >= z).cast("int")).drop("_key", "_k", "_m", "_s")


def last_in_group(df: DataFrame, keys: Sequence[str], index: str, condition: Column, name: str) -> DataFrame:
    """WN-02: 1 in the rows with the greatest index of their group, if the condition holds."""
    return df.withColumn(name, ((F.col(index) == F.max(index).over(Window.partitionBy(*keys))) & condition).cast("int"))


def median_ratio(df: DataFrame, value: str, key: str, name: str = "duration_ratio") -> DataFrame:
    """WN-03: value / exact median of its group; 1 where that is undefined."""
    medians = exact_quantiles(df, value, {"_median": 0.5}, [key])
    ratio = F.coalesce(F.col(value) / F.nullif(F.col("_median"), F.lit(0.0)), F.lit(1.0))
    return df.join(medians, key, "left").withColumn(name, ratio).drop("_median")


def relative_position(df: DataFrame, key: str, index: str) -> DataFrame:
    """WN-04: index / greatest index of the group."""
    most = F.max(index).over(Window.partitionBy(key))
    return df.withColumn("relative_position", F.when(most > 0, F.col(index) / most).otherwise(0.0))


def runs(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """WN-05, WN-06: run_index (from 0) of consecutive equal values within a group."""
    over = Window.partitionBy(key).orderBy(*order)
    starts = F.when(F.lag(value).over(over).eqNullSafe(F.col(value)) & (F.row_number().over(over) > 1), 0).otherwise(1)
    marked = df.withColumn("_start", starts)
    return marked.withColumn("run_index", F.sum("_start").over(over.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_start")


def run_summary(df: DataFrame, key: str, order: Sequence[str], value: str, flag: Column) -> DataFrame:
    """AG-48, WN-05: a row per run with its length and whether the flag holds in all of it."""
    return runs(df.withColumn("_flag", flag), key, order, value).groupBy(key, "run_index", value).agg(
        F.count(F.lit(1)).alias("length"), F.bool_and("_flag").alias("all_flagged")
    )


def neighbour_support(df: DataFrame, key: str, order: Sequence[str], matched: Column) -> DataFrame:
    """WN-07: context_support, the share of the existing neighbours (before and after) that match; 0 without neighbours."""
    over = Window.partitionBy(key).orderBy(*order)
    own = df.withColumn("_m", matched.cast("int"))
    before, after = F.lag("_m").over(over), F.lead("_m").over(over)
    there = before.isNotNull().cast("int") + after.isNotNull().cast("int")
    support = F.when(there == 0, 0.0).otherwise((F.coalesce(before, F.lit(0)) + F.coalesce(after, F.lit(0))) / there)
    return own.withColumn("context_support", support).drop("_m")


def normalised(df: DataFrame, value: str, key: str, fit: Column, population: bool = False) -> DataFrame:
    """WN-13..15, WN-25..28, AG-50: z-score by the group's mean and deviation over the rows to fit on.

    Groups unseen there, and those without spread, use the figures of all fitted rows.
    """
    spread = F.stddev_pop if population else F.stddev_samp
    train = df.where(fit)
    stats = train.groupBy(key).agg(F.avg(value).alias("_m"), spread(value).alias("_s"))
    whole = train.agg(F.avg(value).alias("_gm"), spread(value).alias("_gs"))
    joined = df.join(stats, key, "left").join(F.broadcast(whole))  # one row
    usable = F.col("_s") > 1e-6
    z = F.when(usable, (F.col(value) - F.col("_m")) / F.col("_s")).when(F.col("_gs") > 1e-6, (F.col(value) - F.col("_gm")) / F.col("_gs")).otherwise(0.0)
    return joined.withColumn(f"{value}_norm", z).drop("_m", "_s", "_gm", "_gs")


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """df with the place (long, from 1) of each row within its key, as row_number would give it, but no task orders a whole key.

    Rows are cut into ranges by key and order, so a key with very many rows lies in several ranges; a place is that in the range and the rows of the
    key in the ranges before it. Null keys are a key. Rows of equal order take neighbouring places, and stay in one range.
    """
    ranged = stored(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()), "places")
    sizes = ranged.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row per range of a key
    before = sizes.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(earlier, F.lit(0)).alias("_before"))
    own = ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order)))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    crossing = F.broadcast(before.where("_before > 0"))  # a row a range at most: only its first key can lie in an earlier one
    return own.join(crossing, same, "left").withColumn(name, F.col("_own") + F.coalesce("_before", F.lit(0))).select(*df.columns, name)
