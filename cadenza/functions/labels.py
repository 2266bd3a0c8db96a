"""Scores, decisions and labels whose source depends on the columns that a frame has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scalars import clip01, number

ERROR_WORDS = ("error", "mispronounced", "needs_attention")


def error_score(df: DataFrame) -> Column:
    """PR-05: the first error score that the frame has, 0..1.

    A score that was kept from the main model goes before a fused one.
    """
    for name in ("main_model_error_score", "main_model_error_probability", "final_error_score", "mispronounced_probability", "prob_error"):
        if name in df.columns:
            return clip01(number(name, 0.0))
    if "prob_correct" in df.columns:
        return clip01(1 - number("prob_correct", 1.0))
    if {"confidence", "prediction"} <= set(df.columns):
        sure = clip01(number("confidence", 0.5))
        return F.when(number("prediction", 1.0) == 0, sure).otherwise(1 - sure)
    return F.lit(0.0)


def error_decision(df: DataFrame) -> Column:
    """PR-06: 1 where the main model decides for an error; `prediction` is 0 for an error beside correctness columns."""
    if "main_model_error_decision" in df.columns:
        return F.col("main_model_error_decision").cast("int")
    if "prediction" in df.columns:
        wanted = 0 if {"prob_correct", "gold_binary"} & set(df.columns) else 1
        return (number("prediction", 1.0) == wanted).cast("int")
    return (error_score(df) >= 0.5).cast("int")


def error_label(df: DataFrame, column: str, error_value: str = "auto") -> Column:
    """PR-07: 1 for an error; the polarity follows the column's name, a given value, or the words it holds."""
    if column not in df.columns:
        raise ValueError(f"missing label column {column}")
    if error_value != "auto":
        return F.coalesce((F.col(column).cast("string") == str(error_value)).cast("int"), F.lit(0))
    name = column.lower()
    if name in ("gold_binary", "is_correct", "correct"):
        return F.coalesce((number(column) == 0).cast("int"), F.lit(0))
    by_number = F.coalesce((number(column) == 1).cast("int"), F.lit(0))
    if name in ("gold_label", "label", "error_label", "is_error"):
        return by_number
    word = F.coalesce(F.lower(F.col(column).cast("string")).isin(*ERROR_WORDS), F.lit(False))
    has_words = df.agg(F.coalesce(F.bool_or(word), F.lit(False)).alias("x")).first()["x"]  # one row
    return word.cast("int") if has_words else by_number
