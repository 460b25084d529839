"""Promotion of approved repairs, or a block of the whole batch."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from mendframe import settings as S
from mendframe.functions import tables


def promotion_state(
    summary: DataFrame,
    policy: Mapping[str, Any] | None = None,
    report_written: bool = True,
    candidates: Column | None = None,
) -> DataFrame:
    """One row: counts, blockers and status, from a guardrail summary."""
    policy = S.merge_policy(S.PROMOTION_POLICY, policy)
    ready = F.col("approved") if candidates is None else candidates

    def on(name: str) -> Column:
        return F.lit(bool(policy.get(name, True)))

    blockers = F.array_compact(F.array(
        F.when(on("require_phase5_completed") & (F.col("status") != "completed"), F.lit("phase5_not_completed")),
        F.when(on("require_guardrail_artifact") & F.lit(not report_written),
               F.lit("missing_phase5_guardrail_artifact")),
        F.when(on("require_zero_review_items") & (F.col("review_required") > 0), F.lit("guardrail_review_pending")),
        F.when(on("require_zero_quarantined_items") & (F.col("quarantined") > 0),
               F.lit("guardrail_quarantine_pending")),
        F.when((F.col("approved") > 0) & (ready == 0), F.lit("approved_without_promotion_candidates")),
    ))
    return summary.select(
        F.col("approved").alias("approved_inputs"),
        F.col("review_required").alias("review_pending"),
        F.col("quarantined").alias("quarantined_pending"),
        ready.alias("promotion_candidates"),
        blockers.alias("blockers"),
    ).withColumn("promotion_blocked", F.size("blockers") > 0).withColumn(
        "status", F.when(F.col("promotion_blocked"), F.lit("blocked")).otherwise(F.lit("completed"))
    )


def promoted_clusters(decisions: DataFrame, blocked: bool) -> DataFrame:
    """Approved clusters, none when the batch is blocked."""
    return decisions.where((F.col("guardrail_status") == "approved") & F.lit(not blocked)).select(
        "cluster_id", "cluster_uid", F.lit("promoted").alias("promotion_status"), "affected_rows", "confidence_score"
    )


def promoted_rows(staged: DataFrame, clusters: DataFrame) -> DataFrame:
    """Staged rows of the promoted clusters."""
    approved = clusters.select("cluster_uid").where("cluster_uid IS NOT NULL").distinct()
    return tables.lookup(staged, approved, ["cluster_uid"], "left_semi").select(
        "member_id", "cluster_id", "cluster_uid", "target_column",
        F.col("transformed_value").alias("promoted_value"),
        "source_row_after",
        F.lit("promoted").alias("promotion_status"),
    )


def promotion_summary(state: DataFrame, clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: the state with the promoted counts."""
    counts = clusters.agg(F.count("*").alias("promoted_clusters")).withColumn("_k", F.lit(1)).join(
        rows.agg(F.count("*").alias("promoted_rows")).withColumn("_k", F.lit(1)), "_k"
    )
    return state.withColumn("_k", F.lit(1)).join(counts, "_k").select(
        "status", "approved_inputs", "review_pending", "quarantined_pending", "promotion_candidates",
        "promoted_clusters", "promoted_rows", "promotion_blocked",
        F.array_join("blockers", ",").alias("blockers"),
    )
