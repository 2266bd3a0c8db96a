"""Decision tables: an ordered list of rules compiled to one conditional expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F


@dataclass(frozen=True)
class Rule:
    """Where ``condition`` holds, the outputs; values are columns or literals."""

    condition: Column
    outputs: Mapping[str, object]


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def decide(df: DataFrame, rules: Sequence[Rule], default: Mapping[str, object]) -> DataFrame:
    """Add the outputs of the first rule that holds (null counts as not); every rule sets what the default sets."""
    names = list(default)

    def pack(values: Mapping[str, object]) -> Column:
        return F.struct(*[as_column(values.get(n, default[n])).alias(n) for n in names])

    chosen = None
    for rule in rules:
        holds = F.coalesce(rule.condition, F.lit(False))
        chosen = F.when(holds, pack(rule.outputs)) if chosen is None else chosen.when(holds, pack(rule.outputs))
    chosen = pack(default) if chosen is None else chosen.otherwise(pack(default))
    return df.withColumn("_decided", chosen).withColumns({n: F.col(f"_decided.{n}") for n in names}).drop("_decided")


def overwrite(df: DataFrame, steps: Sequence[Rule]) -> DataFrame:
    """Sequential overwrites: a later step wins over an earlier one, output by output."""
    targets: dict[str, Column] = {}
    for step in steps:
        for name, value in step.outputs.items():
            before = targets.get(name, F.col(name) if name in df.columns else F.lit(None))
            targets[name] = F.when(F.coalesce(step.condition, F.lit(False)), as_column(value)).otherwise(before)
    return df.withColumns(targets)
