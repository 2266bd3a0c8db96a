"""Joins that keep coverage: equi-joins on checked or merged right sides, and interval overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """SE-02, JN-01: one row per key, the last by ``order``; nulls in the order come first.

    Built as an aggregate (``max_by``), so a key with many rows is reduced before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*[F.struct(F.col(o).isNotNull(), F.col(o)) for o in order])).alias("x")
    return df.groupBy(*keys).agg(last).select(*keys, *[F.col(f"x.{c}").alias(c) for c in rest])


def evidence_join(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """JN-01..03, JN-09, JN-20, JN-30: left join on the last right row of each key; the right side wins where names collide."""
    wanted = [c for c in (columns or right.columns) if c in right.columns and c not in keys]
    last = keep_last(right, keys, order).select(*keys, *wanted)
    return left.drop(*[c for c in wanted if c in left.columns]).join(last, list(keys), "left")


def coverage_join(expected: DataFrame, actual: DataFrame, keys: Sequence[str], order: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """JN-04..06: every expected row, with the actual row or the defaults; ``covered`` tells which."""
    own = keep_last(actual, keys, order).withColumn("_covered", F.lit(True))
    joined = expected.drop(*[c for c in own.columns if c in expected.columns and c not in keys]).join(own, list(keys), "left")
    filled = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in joined.columns}
    added = {c: F.lit(v) for c, v in defaults.items() if c not in joined.columns}
    return joined.withColumns({**filled, **added, "covered": F.coalesce("_covered", F.lit(False))}).drop("_covered")


def missing_rows(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-29, SE-04: expected rows without an actual one."""
    return expected.join(actual.select(*keys).distinct(), list(keys), "left_anti")


def override_where(df: DataFrame, confirmed: DataFrame, keys: Sequence[str], values: Mapping[str, object]) -> DataFrame:
    """JN-07, JN-08, JN-22: columns overwritten in the rows whose key is confirmed."""
    marks = confirmed.select(*keys).distinct().withColumn("_confirmed", F.lit(True))
    joined = df.join(marks, list(keys), "left")
    return joined.withColumns({c: F.when(F.col("_confirmed"), F.lit(v)).otherwise(F.col(c) if c in df.columns else F.lit(None)) for c, v in values.items()}).drop("_confirmed")


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JN-18: one-to-one left join; a repeated key on either side, or a left key without partner, fails the job."""
    checked = []
    for side, name in ((left, "left"), (right, "right")):
        seen = F.count(F.lit(1)).over(Window.partitionBy(*keys))
        checked.append(side.withColumn("_n", seen).withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit(f"repeated key on the {name} side"))).where(F.col("_ok").isNull()).drop("_n", "_ok"))
    joined = checked[0].join(checked[1].withColumn("_there", F.lit(True)), list(keys), "left")
    return joined.withColumn("_ok", F.assert_true(F.col("_there").isNotNull(), F.lit("key without partner"))).where(F.col("_ok").isNull()).drop("_there", "_ok")


def label_key(df: DataFrame, parts: Sequence[str], times: Sequence[str]) -> Column:
    """JN-11: the parts trimmed, the times in milliseconds to three places, null as blank, between double bars."""
    own = [F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in parts]
    own += [F.coalesce(F.format_string("%.3f", F.col(c).cast("double")), F.lit("")) for c in times]
    return F.concat_ws("||", *own)


def labelled(predictions: DataFrame, labels: DataFrame, parts: Sequence[str], times: Sequence[str], label: str) -> DataFrame:
    """JN-10, JN-12..14, JN-19: inner join of predictions and non-blank labels on the keys that both have."""
    shared = lambda names: [c for c in names if c in predictions.columns and c in labels.columns]
    parts, times = shared(parts), shared(times)
    right = labels.where(F.trim(F.col(label).cast("string")) != "").select(label_key(labels, parts, times).alias("_key"), label)
    return predictions.withColumn("_key", label_key(predictions, parts, times)).join(right, "_key").drop("_key")


def overlap_argmax(points: DataFrame, spans: DataFrame, keys: Sequence[str], width: float, row: str, span: str) -> DataFrame:
    """JN-25: for each interval of ``points`` the interval of ``spans`` with the greatest overlap, if it is positive; ties go to the first start.

    Both have start and end. Intervals are dealt to the cells of a grid of
    ``width`` that they touch, so a pair meets on an equi-join of (keys, cell); it counts in the
    first cell that both touch only.
    """

    def cells(df: DataFrame) -> DataFrame:
        low, high = F.floor(F.col("start") / width).cast("long"), F.floor(F.col("end") / width).cast("long")
        return df.where("end > start").withColumns({"_low": low}).withColumn("_cell", F.explode(F.sequence(low, high)))

    a = cells(points.select(*keys, row, "start", "end"))
    b = cells(spans.select(*keys, span, "start", "end")).withColumnsRenamed({"start": "s_start", "end": "s_end", "_low": "_s_low"})
    met = a.join(b, [*keys, "_cell"]).where(F.col("_cell") == F.greatest("_low", "_s_low"))
    overlap = F.least("end", "s_end") - F.greatest("start", "s_start")
    best = F.max_by(F.struct(F.col(span).alias("span"), overlap.alias("overlap")), F.struct(overlap, -F.col("s_start"), F.col(span)))
    return met.where(overlap > 0).groupBy(*keys, row).agg(best.alias("x")).select(*keys, row, F.col("x.span").alias(span), F.col("x.overlap").alias("overlap"))
