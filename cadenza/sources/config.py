"""Settings and reports on the driver."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame


def load_config(path: str) -> dict:
    """IO-15: a YAML or JSON file as a dict; an empty file is an empty dict."""
    text = Path(path).read_text(encoding="utf-8-sig")
    if path.endswith(".json"):
        return json.loads(text or "{}")
    import yaml

    return yaml.safe_load(text) or {}


def write_config(values: Mapping, path: str) -> None:
    """IO-25: a dict as YAML in its own order."""
    import yaml

    Path(path).write_text(yaml.safe_dump(dict(values), sort_keys=False, allow_unicode=True), encoding="utf-8")


def markdown_table(df: DataFrame, columns: Sequence[str] | None = None, limit: int = 50) -> str:
    """IO-23: the first rows of a small report as Markdown."""
    names = list(columns or df.columns)
    rows = df.select(*names).limit(limit).collect()
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|")
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join([*lines, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]])
