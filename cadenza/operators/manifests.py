"""Manifests: conformance, conversion, integrity."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, NumericType, StringType, StructType

from ..functions.scalars import number, phone, text


def conform(df: DataFrame, schema: StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """The schema's columns in order: missing ones added, others cast where they can be, NaN as null, null text as ''."""
    defaults = defaults or {}

    def column(name: str, kind: DataType) -> Column:
        if name not in df.columns:
            value = F.lit(defaults.get(name)).cast(kind)
        elif isinstance(kind, NumericType):
            value = number(name).cast(kind)
        else:
            value = F.col(name).try_cast(kind)
        default = defaults.get(name, "" if isinstance(kind, StringType) else None)
        return (value if default is None else F.coalesce(value, F.lit(default).cast(kind))).alias(name)

    return df.select(*[column(f.name, f.dataType) for f in schema.fields])


def error_manifest(df: DataFrame, quality: str = "pass") -> DataFrame:
    """PR-01: the fixed 14 columns of aligned phones: seconds, label 1 for an error, rows without a usable interval or phone gone."""
    start, end = number("start_ms") / 1000, number("end_ms") / 1000
    gold = number("gold_binary", 1.0) if "gold_binary" in df.columns else F.lit(1.0)
    rows = df.where(F.lower(text(df, "alignment_quality", quality)) == quality.lower())
    return rows.select(
        text(df, "utterance_id").alias("utt_id"), text(df, "speaker_id").alias("speaker_id"), text(df, "audio_path").alias("wav_path"), text(df, "word").alias("word"),
        phone("target_phone").alias("target_phone"), text(df, "phone_group").alias("phone_group"), start.alias("start"), end.alias("end"), (end - start).alias("duration"),
        (1 - gold).cast("int").alias("label"), text(df, "split").alias("split"), text(df, "dataset_source").alias("dataset_source"),
        number("phone_index").cast("int").alias("phone_index") if "phone_index" in df.columns else F.lit(None).cast("int").alias("phone_index"),
        number("gop_score").alias("gop_score") if "gop_score" in df.columns else F.lit(None).cast("double").alias("gop_score"),
    ).where("start IS NOT NULL AND end IS NOT NULL AND label IS NOT NULL AND duration > 0 AND target_phone <> ''")


def leaking(df: DataFrame, unit: str, split: str, name: str = "splits") -> DataFrame:
    """FI-09, SE-03: units that occur in more than one split."""
    return df.groupBy(unit).agg(F.count_distinct(split).alias(name)).where(F.col(name) > 1)


def assert_isolated(df: DataFrame, unit: str, split: str) -> None:
    """FI-09: raise if a unit leaks."""
    found = leaking(df, unit, split).limit(5).collect()
    if found:
        raise ValueError(f"{unit} in several splits: {[r[unit] for r in found]}")


def error_counts(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """FI-08: how many rows each check finds wrong, in one pass; a null check finds nothing."""
    sums = df.agg(*[F.count_if(c).alias(n) for n, c in checks.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("error"), F.col(n).alias("n")) for n in checks])).alias("x")).select("x.*")
