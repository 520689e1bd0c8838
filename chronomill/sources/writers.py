"""Sinks: JSON lines logs and results, metrics, partitioned exports, upserts and Markdown tables."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _wire(df: DataFrame) -> DataFrame:
    """Infinite numbers as the text 'inf', which JSON can carry."""
    return df.withColumns(
        {c: F.when(F.col(c) == float("inf"), F.lit("inf")).otherwise(F.col(c).cast("string")) for c, t in df.dtypes if t == "double" and c == "valid_to"}
    )


def append_log(df: DataFrame, path: str) -> None:
    """Append writes to a JSON lines log."""
    _wire(df).write.mode("append").json(path)


def write_lines(df: DataFrame, path: str) -> None:
    """Replace a JSON lines result."""
    _wire(df).write.mode("overwrite").json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """A table of one row as one JSON document."""
    import json

    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("metrics are one row")
    Path(path).write_text(json.dumps(json.loads(rows[0]), indent=2, sort_keys=True) + "\n", encoding="utf-8")


def export_by(df: DataFrame, part: str, keep: Column, path: str) -> None:
    """Split rows into one folder per value of ``part``; rows that are not kept are left out."""
    df.where(keep).repartition(part, F.pmod(F.spark_partition_id(), F.lit(8))).write.mode("overwrite").partitionBy(part).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str, sequence: str) -> DataFrame:
    """Rows of both, the latest of each key."""
    both = old.unionByName(new)
    rest = [c for c in old.columns if c != key]
    return both.groupBy(key).agg(F.max_by(F.struct(*rest), sequence).alias("_r")).select(key, "_r.*")


def markdown(df: DataFrame, most_rows: int = 1000) -> str:
    """A small result as a Markdown table; larger ones are refused."""
    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]) + "\n"
