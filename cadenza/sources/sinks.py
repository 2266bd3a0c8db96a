"""Writers: CSV, strict JSON, incremental appends and annotations that survive a new run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..operators.joins import keep_last


def write_csv(df: DataFrame, path: str) -> None:
    """IO-04: CSV with a header, quotes doubled as ``read_manifest`` expects them; an empty frame is an error."""
    if df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def strict(df: DataFrame) -> DataFrame:
    """IO-18: NaN and infinities as null."""
    def column(f) -> Column:
        if not isinstance(f.dataType, (DoubleType, FloatType)):
            return F.col(f.name)
        return F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name)

    return df.select(*[column(f) for f in df.schema.fields])


def json_rows(df: DataFrame) -> DataFrame:
    """IO-16, IO-17: a JSON object a row, nulls written out."""
    return strict(df).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def not_done(todo: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """IO-21, ST-02: what a former run has not written yet."""
    return todo.join(done.select(*keys).distinct(), list(keys), "left_anti")


def append(df: DataFrame, path: str) -> None:
    """IO-20: add the rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def with_annotations(packet: DataFrame, former: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """IO-22: the packet with the last non-blank annotations of a former one."""
    filled = former.where(F.coalesce(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in columns]).isNotNull())
    last = keep_last(filled.select(*keys, *columns, *[o for o in order if o not in columns and o not in keys]), keys, order).select(*keys, *columns)
    return packet.drop(*[c for c in columns if c in packet.columns]).join(last, list(keys), "left")
