"""Sinks for rankings and chunks."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from .workspace import as_yaml, checked_format

TABLE_ROWS = 50


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet, partitioned by a column of few values if named."""
    (df.write.partitionBy(by) if by else df.write).mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_ranking(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A ranking as ``write_json`` left it, with the columns of ``like``."""
    return spark.read.schema(like.schema).json(path)


def as_markdown(df: DataFrame, rows: int = TABLE_ROWS) -> str:
    """The first rows as a pipe table; a report, so it is bounded."""
    lines = [f"| {' | '.join(df.columns)} |", f"|{' --- |' * len(df.columns)}"]
    lines += [f"| {' | '.join(str(v) for v in r)} |" for r in df.limit(rows).collect()]
    return "\n".join(lines) + "\n"


def write_report(df: DataFrame, path: str, rows: int = TABLE_ROWS) -> None:
    Path(path).write_text(as_markdown(df, rows))


def said(df: DataFrame, form: str, best: str | None = None) -> str:
    """A small result as json, yaml or a table; a table of a ranking shows the row that ``best`` marks only."""
    if checked_format(form) == "table":
        return as_markdown(df.where(best) if best else df)
    rows = [json.loads(r) for r in df.toJSON().collect()]
    return json.dumps(rows, indent=2) + "\n" if form == "json" else as_yaml(rows)
