"""Exact quantiles by selection: the values around a rank are narrowed down until few enough are left to order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..storage import stored

#: Values around a rank that one task may order, buckets that they are counted in, and passes before they are ordered anyway.
LIMIT, BUCKETS, PASSES = 1_000_000, 4_096, 64
#: How far the first bracket reaches beyond a quantile, and the accuracy of the sketch that places it.
MARGIN, ACCURACY = 0.0005, 10_000


def exact_quantiles(df: DataFrame, value: str, quantiles: Mapping[str, float], keys: Sequence[str] = (), limit: int = LIMIT) -> DataFrame:
    """A row per group of ``keys`` with a column per quantile, interpolated as Spark's percentile does.

    No task holds the values of a group. A group of more than ``limit`` values is bracketed by a sketch; the values below and inside of the bracket are
    counted, and it is cut into BUCKETS by value, again and again, until ``limit`` values or a single one are left. What is left is counted by value and
    ordered. Null and NaN values take no part; a group without others has no row; null keys are a group.
    """
    names = list(quantiles)
    key = F.struct(F.lit(0).alias("_"), *[F.col(k) for k in keys])  # structs with null fields are equal in a join
    rows = df.select(key.alias("_k"), F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    edges = [F.percentile_approx("_v", [max(0.0, q - MARGIN), min(1.0, q + MARGIN)], ACCURACY).alias(f"_e{i}") for i, q in enumerate(quantiles.values())]
    sized = rows.groupBy("_k").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), *edges)
    each = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(q)).alias("_q"), F.col(f"_e{i}").alias("_e")) for i, q in enumerate(quantiles.values())])
    place = F.col("_q") * (F.col("_n") - 1)
    state = sized.select("_k", "_n", "_min", "_max", F.inline(each)).withColumns({"_r0": F.floor(place), "_r1": F.ceil(place), "_pos": place})
    large = F.col("_n") > limit
    state = state.withColumns({"_lo": F.when(large, F.col("_e")[0]).otherwise(F.col("_min")), "_hi": F.when(large, F.col("_e")[1]).otherwise(F.col("_max"))})
    state = stored(state.drop("_e"), "quantiles")
    # how many values lie below the bracket and in it; a bracket that misses its rank is opened again
    seen = rows.join(_small(state), "_k").groupBy("_k", "_i").agg(F.count_if(F.col("_v") < F.col("_lo")).alias("_below"), F.count_if(F.col("_v").between(F.col("_lo"), F.col("_hi"))).alias("_inside"))
    state = state.join(seen, ["_k", "_i"])
    holds = (F.col("_below") <= F.col("_r0")) & (F.col("_r1") < F.col("_below") + F.col("_inside"))
    opened = {"_lo": F.col("_min"), "_hi": F.col("_max"), "_below": F.lit(0).cast("long"), "_inside": F.col("_n")}
    state = stored(state.withColumns({c: F.when(holds, F.col(c)).otherwise(v) for c, v in opened.items()}), "quantiles")
    for _ in range(PASSES):
        wide = (F.col("_inside") > limit) & (F.col("_hi") > F.col("_lo"))
        if state.where(wide).isEmpty():
            break
        state = stored(_narrowed(rows, state.where(wide)).unionByName(state.where(~wide)), "quantiles")
    inside = rows.join(_small(state), "_k").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    values = inside.groupBy("_k", "_i", "_v", "_below", "_r0", "_r1", "_pos").agg(F.count(F.lit(1)).alias("_c"))
    up_to = F.col("_below") + F.sum("_c").over(Window.partitionBy("_k", "_i").orderBy("_v"))
    at = values.withColumn("_cum", up_to).groupBy("_k", "_i").agg(
        F.min(F.when(F.col("_cum") > F.col("_r0"), F.col("_v"))).alias("_v0"), F.min(F.when(F.col("_cum") > F.col("_r1"), F.col("_v"))).alias("_v1"),
        F.first("_r0").alias("_r0"), F.first("_r1").alias("_r1"), F.first("_pos").alias("_pos"),
    )
    mixed = (F.col("_r1") - F.col("_pos")) * F.col("_v0") + (F.col("_pos") - F.col("_r0")) * F.col("_v1")
    found = at.select("_k", "_i", F.when(F.col("_v0") == F.col("_v1"), F.col("_v0")).otherwise(mixed).alias("_x"))
    wide = found.groupBy("_k").agg(*[F.max(F.when(F.col("_i") == i, F.col("_x"))).alias(name) for i, name in enumerate(names)])
    return wide.select(*[F.col(f"_k.{k}").alias(k) for k in keys], *names)


def _small(state: DataFrame) -> DataFrame:
    return state.select("_k", "_i", "_lo", "_hi", *[c for c in ("_below", "_r0", "_r1", "_pos") if c in state.columns])


def _narrowed(rows: DataFrame, state: DataFrame) -> DataFrame:
    """The brackets cut down to the buckets that hold the ranks, with what lies below and in them."""
    width = F.col("_hi") / 2 - F.col("_lo") / 2  # halves, so that the whole range of doubles fits
    bucket = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / width * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    inside = rows.join(_small(state), "_k").where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    counts = inside.withColumn("_b", bucket).groupBy("_k", "_i", "_b", "_below", "_r0", "_r1").agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_from"), F.max("_v").alias("_to"))
    cum = F.col("_below") + F.sum("_c").over(Window.partitionBy("_k", "_i").orderBy("_b"))  # BUCKETS rows at most
    held = counts.withColumn("_cum", cum).where((F.col("_cum") > F.col("_r0")) & (F.col("_cum") - F.col("_c") <= F.col("_r1")))
    new = held.groupBy("_k", "_i").agg(F.min("_from").alias("_lo"), F.max("_to").alias("_hi"), F.min(F.col("_cum") - F.col("_c")).alias("_below"), F.sum("_c").alias("_inside"))
    return state.drop("_lo", "_hi", "_below", "_inside").join(new, ["_k", "_i"]).select(*state.columns)
