"""Small result tables as one CSV or text file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_metrics_csv(metrics: DataFrame, path: str) -> str:
    """Metric tables hold one row per model, so a single file is in order."""
    metrics.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_report(lines: DataFrame, path: str) -> str:
    """Write ``(line_no, line)`` in line order."""
    ordered = lines.repartition(1).sortWithinPartitions("line_no").select(F.coalesce("line", F.lit("")).alias("value"))
    ordered.write.mode("overwrite").text(path)
    return path
