"""Priority packets, budgets and reproducible samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .quantiles import exact_quantiles


def priority_packet(df: DataFrame, order: Sequence[Column], limit: int) -> DataFrame:
    """SO-01, SO-07: the first rows of an order; give it a tie breaker."""
    return df.orderBy(*order).limit(limit)


def first_per_split(df: DataFrame, split: str, unit: str, limit: int, order: str) -> DataFrame:
    """JN-27, JN-28, SO-14: the rows of the first ``limit`` units of each split, by a unit's first place in the order."""
    units = df.groupBy(split, unit).agg(F.min(order).alias("_first"))
    ranked = units.withColumn("_rank", F.row_number().over(Window.partitionBy(split).orderBy("_first", unit)))
    return df.join(ranked.where(F.col("_rank") <= limit).select(split, unit), [split, unit], "left_semi")


def budgeted_units(df: DataFrame, unit: str, error: Column, budget: int, share: float = 0.8, by: str | None = None) -> DataFrame:
    """FI-01, FI-02, SO-05, SO-06: units within a budget: a share of those with most errors, filled with clean ones, then with the other errors.

    With ``by``, each value of it has its own budget.
    """
    keys = [by] if by else []
    units = df.groupBy(*keys, unit).agg(F.sum(error.cast("int")).alias("errors"))
    clean = (F.col("errors") == 0).cast("int")
    ranked = units.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, clean).orderBy(F.desc("errors"), unit)))
    wanted = int(budget * share)
    tier = F.when((clean == 0) & (F.col("_rank") <= wanted), 0).when(clean == 1, 1).otherwise(2)
    placed = ranked.withColumn("_tier", tier).where(F.col("_rank") <= budget)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy("_tier", "_rank"))
    return placed.withColumn("_place", last).where(F.col("_place") <= budget).select(*keys, unit, "errors", F.col("_tier").alias("tier"))


def hashed_sample(df: DataFrame, key: str, seed: int, limit: int) -> DataFrame:
    """SO-08: the rows with the least hashes of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return df.orderBy(digest, key).limit(limit)


def dev_units(df: DataFrame, unit: str, seed: int, share: float = 0.2) -> DataFrame:
    """SO-10: in_dev for each unit; max(1, round half even of the share) units with the least sha256 of 'seed:unit'."""
    units = df.select(unit).distinct()
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(unit).cast("string")), 256)
    wanted = F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(share), 0).cast("int"))
    count = units.agg(wanted.alias("_wanted")).first()["_wanted"]  # one row
    chosen = units.orderBy(digest, unit).limit(int(count)).withColumn("in_dev", F.lit(True))
    return units.join(chosen, unit, "left").select(unit, F.coalesce("in_dev", F.lit(False)).alias("in_dev"))


def ratio_sample(df: DataFrame, minority: Column, key: Sequence[str], ratio: int, seed: int) -> DataFrame:
    """SO-09: all rows of the minority and ``ratio`` times as many of the others, by hash."""
    own = df.withColumn("_minor", minority.cast("int"))
    count = own.agg(F.sum("_minor").alias("n")).first()["n"] or 0  # one row
    others = own.where("_minor = 0").orderBy(F.xxhash64(F.lit(seed), *key), *key).limit(int(count) * ratio)
    return own.where("_minor = 1").unionByName(others).drop("_minor")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """AG-51: weight = rows / (classes * rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    weights = counts.join(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))  # one row
    return df.join(F.broadcast(weights), label)  # a row per class


def hard_negatives(df: DataFrame, score: str, label: str, share: float, weight: float) -> DataFrame:
    """ML-22: weight for the correct rows with the highest scores, 1 for all others; the share's boundary is an exact quantile."""
    bound = exact_quantiles(df.where(F.col(label) == 0), score, {"_bound": 1 - share})
    hard = (F.col(label) == 0) & (F.col(score) >= F.col("_bound"))
    return df.join(F.broadcast(bound), F.lit(True), "left").withColumn("weight", F.when(hard, weight).otherwise(1.0)).drop("_bound")  # one row
