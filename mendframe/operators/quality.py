"""Checks and records around a run: drift, row hashes, audit, re-check, metrics, review, replay."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

from mendframe.functions import tables, text as tx
from mendframe.operators import validation
from mendframe.settings import ValidationSpec


def schema_drift(rows: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """(column_name, expected_type, actual_type, drift) for every column of either side."""
    actual = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def drift(name: str) -> str:
        if name not in actual:
            return "missing_column"
        if name not in expected:
            return "unexpected_column"
        return "ok" if actual[name] == expected[name] else "type_mismatch"

    result = [
        (name, expected.get(name), actual.get(name), drift(name)) for name in sorted(set(actual) | set(expected))
    ]
    schema = "column_name string, expected_type string, actual_type string, drift string"
    return rows.sparkSession.createDataFrame(result, schema)


def value_drift(rows: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Schema drift with, per column, the rows that have a value and those that would not convert."""
    drift = schema_drift(rows, expected)
    present = [c for c in rows.columns]
    cells = F.array(*(
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"`{c}`").isNotNull().alias("filled"),
            (F.col(f"`{c}`").isNotNull() & F.col(f"`{c}`").cast("string").try_cast(expected[c]).isNull()
             if c in expected else F.lit(False)).alias("lost"),
        )
        for c in present
    ))
    counts = rows.select(F.inline(cells)).groupBy("column_name").agg(
        F.count_if("filled").alias("filled_rows"), F.count_if("lost").alias("unconvertible_rows")
    )
    return drift.join(counts, "column_name", "left").na.fill(0, ["filled_rows", "unconvertible_rows"])


def row_hash(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 over the sorted columns; NULL and empty text differ."""
    names = sorted(columns or rows.columns)
    return F.sha2(
        F.concat_ws("\u001f", *(
            F.coalesce(F.concat(F.lit("="), validation.cell_text(rows, c)), F.lit("-")) for c in names
        )), 256
    )


def unprocessed(rows: DataFrame, processed: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows whose hash is not among the processed ones, with the hash to record.

    ``processed`` is a written table with one ``row_hash`` per row. Equal rows
    share a hash, so a delivery of many copies is a hot key.
    """
    hashed = rows.withColumn("row_hash", row_hash(rows, columns))
    return tables.lookup(hashed, processed.select("row_hash"), ["row_hash"], "left_anti")


def audit_trail(staged: DataFrame, remediations: DataFrame, recorded_at: str) -> DataFrame:
    """Old value, new value and reason of every staged change."""
    why = remediations.select("cluster_id", "reasoning", "code", "model_used", "confidence_score")
    return tables.lookup(staged, why, ["cluster_id"], "left").select(
        "member_id", "cluster_uid", "target_column",
        F.col("original_value").alias("old_value"), F.col("transformed_value").alias("new_value"),
        (~F.col("original_value").eqNullSafe(F.col("transformed_value"))).alias("changed"),
        "reasoning", "code", "model_used", "confidence_score",
        F.lit(recorded_at).alias("recorded_at"),
    )


def recheck(
    staged: DataFrame, spec: ValidationSpec, columns: list[str], business_rules: Mapping[str, str] | None = None
) -> DataFrame:
    """Validate the after-images of staged rows again.

    Adds ``still_invalid`` for the repaired column, ``remaining_errors`` for
    the whole row and one boolean per business rule (a SQL condition).
    """
    image = F.col("source_row_after")
    row = staged.select(*(image[c].alias(c) for c in columns), F.struct(*staged.columns).alias("_staged"))
    found = validation.row_anomalies(row.drop("_staged"), spec)
    checked = row.select("*", found.alias("_found"))
    return checked.select(
        "_staged.*",
        F.exists("_found", lambda a: a["column_name"] == F.col("_staged.target_column")).alias("still_invalid"),
        F.size("_found").alias("remaining_errors"),
        *(F.coalesce(F.expr(rule), F.lit(False)).alias(name) for name, rule in (business_rules or {}).items()),
    )


def recheck_summary(checked: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Pass and fail counts per cluster."""
    return checked.groupBy("cluster_id", "target_column").agg(
        F.count("*").alias("checked_rows"),
        F.count_if(~F.col("still_invalid")).alias("passed"),
        F.count_if("still_invalid").alias("failed"),
        *(F.count_if(~F.col(r)).alias(f"{r}_failed") for r in (rules or [])),
    )


def dashboard_metrics(summary: DataFrame, execution: DataFrame, promoted: DataFrame) -> DataFrame:
    """(metric, value) from the one-row summaries of a run."""
    def pick(rows: DataFrame, names: Mapping[str, str]) -> DataFrame:
        pairs = F.array(*(
            F.struct(F.lit(shown).alias("metric"), F.col(c).cast("double").alias("value")) for c, shown in names.items()
        ))
        return rows.select(F.inline(pairs))

    return (
        pick(summary, {"input_rows": "processed_rows", "clean_rows": "clean_rows", "bad_rows": "bad_rows",
                       "anomalies": "anomalies"})
        .unionByName(pick(execution, {"total": "remediations", "staged": "staged_remediations",
                                      "quarantined": "quarantined_remediations", "applied_rows": "applied_rows"}))
        .unionByName(pick(promoted, {"promoted_clusters": "promoted_clusters", "promoted_rows": "promoted_rows"}))
    )


def anomaly_rate(validated: DataFrame, time: str, width: str) -> DataFrame:
    """Rows, bad rows and their share per time window; works on batches and streams."""
    kind = validated.schema[time].dataType
    at = F.col(time).cast("timestamp") if isinstance(kind, T.TimestampNTZType) else F.col(time)
    return (
        validated.groupBy(F.window(at, width).alias("w"))
        .agg(F.count("*").alias("rows"), F.count_if("_bad").alias("bad_rows"))
        .select(F.col("w.start").alias("window_start"), "rows", "bad_rows",
                F.round(F.col("bad_rows") / F.col("rows"), 4).alias("anomaly_rate"))
    )


def fix_success_rate(runs: DataFrame, time: str, width: str) -> DataFrame:
    """Share of promoted among staged changes per time window."""
    return (
        runs.groupBy(F.window(F.col(time).cast("timestamp"), width).alias("w"))
        .agg(F.sum("staged").alias("staged"), F.sum("promoted").alias("promoted"))
        .select(F.col("w.start").alias("window_start"), "staged", "promoted",
                F.when(F.col("staged") > 0, F.round(F.col("promoted") / F.col("staged"), 4))
                .otherwise(F.lit(0.0)).alias("success_rate"))
    )


def review_quarantine(quarantined: DataFrame, reviews: DataFrame) -> DataFrame:
    """Quarantined members with the reviewer's decision applied.

    ``reviews``: member_id, decision (approve or reject), new_value and, where
    members are reviewed more than once, reviewed_at: the newest review counts,
    of equally new ones the last in the order of decision and value. An approval
    without a new value keeps the old one; an unreviewed member stays pending.
    """
    age = F.col("reviewed_at") if "reviewed_at" in reviews.columns else F.lit(0)
    newest = reviews.groupBy("member_id").agg(
        F.max_by(F.struct("decision", "new_value"), F.struct(age, "decision", "new_value")).alias("_review")
    )
    joined = quarantined.join(newest.select("member_id", "_review.*"), "member_id", "left")
    status = (
        F.when(F.col("decision") == "approve", F.lit("approved"))
        .when(F.col("decision") == "reject", F.lit("rejected"))
        .otherwise(F.lit("pending"))
    )
    approved = F.col("decision") == "approve"
    return joined.select(
        *quarantined.columns,
        status.alias("review_status"),
        F.when(approved, F.coalesce("new_value", "value")).alias("reviewed_value"),
        F.coalesce(approved & F.col("new_value").isNotNull(), F.lit(False)).alias("edited"),
    )


def replay_rows(batch: DataFrame, promoted: DataFrame, key: str = "member_id") -> DataFrame:
    """Staged rows of a stored batch that were not promoted yet."""
    return batch.join(promoted.select(key).distinct(), key, "left_anti")


def filled_profile(rows: DataFrame) -> DataFrame:
    """(column_name, rows, missing) over all columns."""
    cells = F.array(*(
        F.struct(F.lit(c).alias("column_name"), tx.is_missing(validation.cell_text(rows, c)).alias("missing"))
        for c in rows.columns
    ))
    return rows.select(F.inline(cells)).groupBy("column_name").agg(
        F.count("*").alias("rows"), F.count_if("missing").alias("missing")
    )
