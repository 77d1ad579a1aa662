"""Parquet and CSV outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def report_csv(df: DataFrame, path: str) -> None:
    """A small report table as one file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def report_json(df: DataFrame, path: str) -> None:
    """A small report table as one file of JSON lines."""
    df.coalesce(1).write.mode("overwrite").json(path)


def markdown(df: DataFrame, columns: list[str] | None = None, most: int = 200) -> str:
    """A report table as text; more than ``most`` rows are an error, not a report."""
    rows = (df.select(*columns) if columns else df).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no report")
    names = columns or df.columns
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])
