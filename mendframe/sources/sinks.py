"""Table sinks of a run. Every write goes to its own folder, so a re-run replaces only its batch."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F


def write_clean_rows(rows: DataFrame, folder: str) -> str:
    return _write(rows, f"{folder}/clean_rows")


def write_anomalies(found: DataFrame, folder: str) -> str:
    """Anomalies, one folder per error type, so later reads prune."""
    path = f"{folder}/anomalies"
    found.write.mode("overwrite").partitionBy("error_type").parquet(path)
    return path


def write_audit_summary(summary: DataFrame, folder: str, name: str) -> str:
    """A one-row summary as JSON."""
    path = f"{folder}/{name}"
    summary.coalesce(1).write.mode("overwrite").json(path)
    return path


def write_sections(sections: Mapping[str, DataFrame], folder: str, generated_at: str) -> str:
    """One table per section of an artifact, each stamped with the time it was made."""
    for name, rows in sections.items():
        _write(rows.withColumn("generated_at_utc", F.lit(generated_at)), f"{folder}/{name}")
    return folder


def _write(rows: DataFrame, path: str) -> str:
    rows.write.mode("overwrite").parquet(path)
    return path
