"""Connected components by alternating star contraction.

The edges stay in DataFrames. Each round replaces them by edges to the least
neighbour; a hub is reduced by ``groupBy`` with partial aggregation, so no task
holds all neighbours of one node, and both joins are splittable by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import read_back, remove, store


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges`` has long columns a, b; returns (node, root), root the least node reachable.

    Self loops and repeated edges are allowed; rows with a null end are
    ignored; nodes without an edge do not appear. An empty table gives an
    empty table.
    """
    spark = edges.sparkSession
    start = (
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    path = store(start, "edges")
    current, seen = read_back(spark, path, start), None
    for _ in range(max_rounds):
        contracted = _small_star(_large_star(current))
        new_path = store(contracted, "edges")
        remove(spark, path)
        path, current = new_path, read_back(spark, new_path, contracted)
        state = current.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")
        ).first()
        if (state["n"], state["s"]) == seen:
            break
        seen = (state["n"], state["s"])
    else:
        raise RuntimeError("component labels did not settle")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
