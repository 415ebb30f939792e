"""Sinks (S12, S13)."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> str:
    """The table as CSV files with a header line (one file per partition)."""
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)
    return path


def write_report_csv(report: DataFrame, path: str, mode: str = "overwrite") -> str:
    """A small result table (tens of rows) as one CSV file."""
    report.coalesce(1).write.mode(mode).option("header", True).csv(path)
    return path


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).parquet(path)
    return path
