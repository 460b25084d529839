"""Per-cluster decisions and the batch circuit breaker."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from mendframe import settings as S


def safe_ratio(part: Column, whole: Column) -> Column:
    """Rounded ratio, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole, 4)).otherwise(F.lit(0.0))


def risk_snapshot(summary: DataFrame, found: DataFrame, execution: DataFrame) -> DataFrame:
    """One row of batch risk; several anomalies of one row count as one bad row.

    The three inputs are an ingestion summary, the anomalies and an execution
    summary; both summaries have one row.
    """
    bad = found.agg(F.countDistinct(F.col("id").cast("string")).alias("unique_bad_rows"))
    one = summary.select(F.lit(1).alias("_k"), "input_rows", "anomalies")
    two = execution.select(F.lit(1).alias("_k"), "total", "quarantined", "execution_failed")
    joined = one.join(two, "_k", "full_outer").join(bad.withColumn("_k", F.lit(1)), "_k", "full_outer")

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    return joined.select(
        number("input_rows").alias("input_rows"),
        number("anomalies").alias("anomalies"),
        number("unique_bad_rows").alias("unique_bad_rows"),
        safe_ratio(number("unique_bad_rows"), number("input_rows")).alias("bad_row_ratio"),
        number("total").alias("execution_total"),
        safe_ratio(number("quarantined"), number("total")).alias("quarantine_ratio"),
        safe_ratio(number("execution_failed"), number("total")).alias("execution_failure_ratio"),
    )


def circuit_breaker(snapshot: DataFrame, policy: Mapping[str, Any] | None = None) -> DataFrame:
    """Add ``circuit_breaker_active`` and its reasons; limits must be exceeded, not met."""
    policy = S.merge_policy(S.GUARDRAIL_POLICY, policy)
    tests = [
        ("quarantine_ratio", "max_quarantine_ratio", "quarantine_ratio_exceeded"),
        ("execution_failure_ratio", "max_execution_failure_ratio", "execution_failure_ratio_exceeded"),
        ("bad_row_ratio", "max_bad_row_ratio", "bad_row_ratio_exceeded"),
    ]
    reasons = F.array_compact(F.array(*(
        F.when(F.col(ratio) > float(policy[limit]), F.lit(reason)) for ratio, limit, reason in tests
    )))
    return snapshot.withColumn("circuit_breaker_reasons", reasons).withColumn(
        "circuit_breaker_active", F.size("circuit_breaker_reasons") > 0
    )


def decide(
    plan: DataFrame, breaker_active: bool, policy: Mapping[str, Any] | None = None
) -> DataFrame:
    """One decision per execution record; the first rule that applies wins."""
    policy = S.merge_policy(S.GUARDRAIL_POLICY, policy)

    def given(name: str, default: Any, kind: str) -> Column:
        if name not in plan.columns:
            return F.lit(default).cast(kind)
        return F.coalesce(F.col(name).cast(kind), F.lit(default).cast(kind))

    status = given("execution_status", "unknown", "string")
    confidence = given("confidence_score", 0.0, "double")
    risk = given("risk_level", "unknown", "string")
    review = given("requires_human_review", False, "boolean")
    affected = given("affected_rows", 0, "bigint")
    unmatched = given("unmatched_count", 0, "bigint")
    unmatched_ratio = safe_ratio(unmatched, given("member_count", 0, "bigint"))
    high_risk = (F.lower(risk) == "high") & F.lit(bool(policy.get("block_high_risk", True)))
    rules = [
        (F.lit(bool(breaker_active)), "review_required", F.lit("circuit_breaker_active")),
        (status.isin("invalid_contract", "execution_failed", "quarantined"), "quarantined",
         F.concat(F.lit("execution_status="), status)),
        (status != "staged", "quarantined", F.lit("unknown_execution_state")),
        (affected <= 0, "quarantined", F.lit("no_rows_affected")),
        (unmatched_ratio > float(policy["max_unmatched_member_ratio"]), "quarantined",
         F.lit("unmatched_member_ratio_exceeded")),
        (high_risk, "quarantined", F.lit("high_risk_blocked")),
        (confidence < float(policy["min_confidence_for_review_pass"]), "quarantined",
         F.lit("confidence_below_guardrail_floor")),
        (review, "review_required", F.lit("human_review_required")),
        (confidence < float(policy["min_confidence_for_promotion"]), "review_required",
         F.lit("confidence_below_promotion_threshold")),
        (F.lit(True), "approved", F.lit("all_guardrail_checks_passed")),
    ]
    verdict = None
    for condition, outcome, reason in rules:
        pair = F.struct(F.lit(outcome).alias("outcome"), reason.alias("reason"))
        verdict = F.when(condition, pair) if verdict is None else verdict.when(condition, pair)
    rows = plan.withColumn("_verdict", verdict)
    outcome = F.col("_verdict.outcome")
    return rows.select(
        given("cluster_id", "unknown", "string").alias("cluster_id"),
        given("cluster_uid", "unknown", "string").alias("cluster_uid"),
        status.alias("execution_status"),
        outcome.alias("guardrail_status"),
        (outcome == "approved").alias("promotion_ready"),
        ((outcome != "approved") | review).alias("requires_human_review"),
        risk.alias("risk_level"),
        given("guardrail_action", "unknown", "string").alias("guardrail_action"),
        confidence.alias("confidence_score"),
        affected.alias("affected_rows"),
        F.array("_verdict.reason").alias("reasons"),
        unmatched.alias("unmatched_count"),
        (F.coalesce("validation_checks", F.array().cast("array<string>"))
         if "validation_checks" in plan.columns else F.array().cast("array<string>")).alias("validation_checks"),
    )


def with_status(decisions: DataFrame, status: str) -> DataFrame:
    """Decisions of one outcome: approved, review_required or quarantined."""
    return decisions.where(F.col("guardrail_status") == status)


def guardrail_summary(decisions: DataFrame, breaker_active: bool, breaker_reasons: list[str]) -> DataFrame:
    """One row: status and counts per outcome."""
    def times(status: str) -> Column:
        return F.count_if(F.col("guardrail_status") == status)

    total = F.count("*")
    return decisions.agg(
        F.when(total == 0, F.lit("no_execution_plan")).otherwise(F.lit("completed")).alias("status"),
        total.alias("total"),
        times("approved").alias("approved"),
        times("review_required").alias("review_required"),
        times("quarantined").alias("quarantined"),
        F.lit(breaker_active).alias("circuit_breaker_active"),
        F.lit(",".join(breaker_reasons)).alias("circuit_breaker_reasons"),
    )
