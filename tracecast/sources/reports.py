"""Sinks for prediction lines and run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_lines(lines: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Prediction lines; CSV has no arrays, so sequences become text there."""
    if fmt == "csv":
        arrays = {c: F.to_json(c) for c, t in lines.dtypes if t.startswith("array")}
        lines = lines.withColumns(arrays)
        lines.write.mode("overwrite").csv(path, header=True)
    else:
        lines.write.mode("overwrite").format(fmt).save(path)


def append_report(report: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Adds one run to the report table."""
    report.write.mode("append").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
