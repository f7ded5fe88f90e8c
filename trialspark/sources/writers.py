"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_accuracy(df: DataFrame, path: str, kind: str = "parquet", mode: str = "error") -> None:
    """Write the accuracy table by data source, as Parquet or as CSV with header."""
    if kind == "csv":
        df.write.mode(mode).csv(path, header=True, nullValue="NA")
    elif kind == "parquet":
        df.write.mode(mode).partitionBy("data_source").parquet(path)
    else:
        raise ValueError(f"unknown kind {kind}")


def write_report(report: DataFrame, path: str, mode: str = "error") -> None:
    """Write report lines as text in order; a report has one line per model parameter."""
    report.orderBy("line_no").coalesce(1).select("line").write.mode(mode).text(path)
