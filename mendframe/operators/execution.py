"""Staging repairs: contract check, row transform, all-or-nothing per cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mendframe import settings as S
from mendframe.functions import tables
from mendframe.functions.expressions import apply_codes, code_error


def missing_contract_fields(columns: list[str]) -> list[str]:
    """Contract fields a remediation table lacks. Members live in their own table."""
    return sorted(set(S.CONTRACT_FIELDS) - {"member_ids"} - set(columns))


def check_contracts(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Add ``missing_fields``, ``is_valid`` and the record defaults to raw JSON remediations.

    A field counts as present even when it is null.
    """
    keys = F.json_object_keys(F.col(payload))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, S.CONTRACT_FIELDS)), keys))
    # arrays and scalars have no keys
    missing = F.coalesce(missing, F.array(F.lit("<non-dict remediation>")))
    valid = F.size(missing) == 0

    def field(name: str) -> Column:
        return F.coalesce(F.get_json_object(payload, f"$.{name}"), F.lit("unknown"))

    def guarded(name: str, forced: str) -> Column:
        return F.when(valid, F.get_json_object(payload, f"$.{name}")).otherwise(F.lit(forced))

    checked = payloads.select(
        "*",
        missing.alias("missing_fields"),
        valid.alias("is_valid"),
        field("cluster_id").alias("cluster_id"),
        field("cluster_uid").alias("cluster_uid"),
        guarded("transformation_type", "quarantine").alias("transformation_type"),
        guarded("guardrail_action", "quarantine").alias("guardrail_action"),
        guarded("risk_level", "high").alias("risk_level"),
        F.when(valid, F.get_json_object(payload, "$.requires_human_review") == "true")
        .otherwise(F.lit(True)).alias("requires_human_review"),
    )
    status = F.when(~F.col("is_valid"), F.lit("invalid_contract")).otherwise(_base_status())
    return checked.withColumn("execution_status", status).withColumn(
        "ready_for_guardrails", F.col("execution_status") == "staged"
    )


_CONTRACT_TYPES = {
    "confidence_score": "double", "size": "bigint", "cache_hit": "boolean", "requires_human_review": "boolean",
    "validation_checks": "array<string>",
}


def _with_contract(remediations: DataFrame) -> DataFrame:
    """Remediations with every contract column, their ``missing_fields`` and ``_status``."""
    lacking = missing_contract_fields(remediations.columns)
    missing = F.array(*map(F.lit, lacking)).cast("array<string>")
    if "missing_fields" in remediations.columns:
        named = F.coalesce("missing_fields", F.array().cast("array<string>"))
        missing = F.array_sort(F.array_union(named, missing))
    rows = remediations.withColumns({c: F.lit(None).cast(_CONTRACT_TYPES.get(c, "string")) for c in lacking})
    rows = rows.withColumn("missing_fields", missing)
    broken = F.size("missing_fields") > 0
    forced = {
        "cluster_id": F.when(broken, F.coalesce("cluster_id", F.lit("unknown"))).otherwise(F.col("cluster_id")),
        "cluster_uid": F.when(broken, F.coalesce("cluster_uid", F.lit("unknown"))).otherwise(F.col("cluster_uid")),
        "requires_human_review": broken | F.col("requires_human_review"),
        "risk_level": F.when(broken, F.lit("high")).otherwise(F.col("risk_level")),
        "transformation_type": F.when(broken, F.lit("quarantine")).otherwise(F.col("transformation_type")),
        "guardrail_action": F.when(broken, F.lit("quarantine")).otherwise(F.col("guardrail_action")),
    }
    status = F.when(broken, F.lit("invalid_contract")).otherwise(_base_status())
    return rows.withColumns(forced).withColumn("_status", status)


def _base_status() -> Column:
    held = (F.col("transformation_type") == "quarantine") | (F.col("guardrail_action") == "quarantine")
    return F.when(held, F.lit("quarantined")).otherwise(F.lit("staged"))


def id_candidates(member: Column) -> Column:
    """The id itself, then the id without its prefix."""
    return F.array_compact(F.array(
        member,
        F.when(member.startswith("anomaly_"), F.substring(member, F.lit(9), F.length(member))),
        F.when(member.startswith("row_"), F.substring(member, F.lit(5), F.length(member))),
    ))


def anomaly_index(found: DataFrame, payload: list[str], position: str = "row_ord") -> DataFrame:
    """(lookup_key, anomaly): uid and id keys of every anomaly, the last one wins."""

    def both(column: str, prefix: str) -> list[Column]:
        if column not in found.columns:
            return []
        filled = F.col(column).cast("string")
        usable = filled.isNotNull() & (filled != "") if column == "anomaly_uid" else filled.isNotNull()
        return [F.when(usable, filled), F.when(usable, F.concat(F.lit(prefix), filled))]

    keys = F.array_compact(F.array(*both("anomaly_uid", "anomaly_"), *both("id", "row_")))
    order = [F.col(position)] + ([F.col("pos")] if "pos" in found.columns else [])
    return (
        found.select(F.explode(keys).alias("lookup_key"), F.struct(*order).alias("_at"), F.struct(*payload).alias("a"))
        .groupBy("lookup_key")
        .agg(F.max_by("a", "_at").alias("anomaly"))
    )


def match_members(
    members: DataFrame, found: DataFrame, position: str = "row_ord"
) -> tuple[DataFrame, DataFrame]:
    """Matched and unmatched members of (cluster_id, member_id), by the first id candidate that hits."""
    payload = [c for c in ("column_name", "value", "source_row") if c in found.columns]
    index = tables.cut(anomaly_index(found, payload, position), "index")
    tried = members.select("cluster_id", "member_id", F.posexplode(id_candidates(F.col("member_id"))).alias("try", "lookup_key"))
    hits = tables.lookup(tried, index, ["lookup_key"], "inner")
    # a member has at most two candidates
    best = hits.groupBy("cluster_id", "member_id").agg(F.min_by("anomaly", "try").alias("a"))
    best = tables.cut(best, "matches")
    matched = best.select("cluster_id", "member_id", *(F.col(f"a.{c}").alias(c) for c in payload))
    keys = ["cluster_id", "member_id"]
    return matched, members.join(best.select(*keys), keys, "left_anti")


def after_image(image: Column, target: Column, value: Column) -> Column:
    """Row image with one column replaced."""
    return F.when(
        image.isNotNull(),
        F.when(
            F.coalesce(target != "", F.lit(False)),
            F.map_concat(F.map_filter(image, lambda k, _: k != target), F.create_map(target, value)),
        ).otherwise(image),
    )


STAGED_COLUMNS = (
    "member_id", "cluster_id", "cluster_uid", "target_column", "original_value", "transformed_value",
    "fallback_value", "source_row_before", "source_row_after", "apply_status",
)


def stage(
    remediations: DataFrame, members: DataFrame, unmatched: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(execution plan, staged rows).

    ``members`` are anomalies with ``cluster_id`` and ``member_id``. A cluster
    whose code is refused or fails on any row stages nothing. So does a record
    that breaks the contract: one that names ``missing_fields``, as raw payloads do
    after ``check_contracts``, or any record of a table that lacks a column.
    """
    checked = _with_contract(remediations)
    checked = checked.withColumn("_code_error", F.when(F.col("_status") == "staged", code_error(F.col("code"))))
    checked = tables.cut(checked, "checked")
    runnable = checked.where("_status = 'staged' AND _code_error IS NULL")
    plan_side = runnable.select("cluster_id", "cluster_uid", "code", "fallback_value")
    image = "source_row" in members.columns
    rows = members.select("member_id", "cluster_id", "column_name", "value", *(["source_row"] if image else []))
    rows = tables.lookup(rows, plan_side, ["cluster_id"], "inner")
    applied, can_fail = apply_codes(rows, runnable.select("code", "size"))
    if can_fail:
        applied = tables.cut(applied, "applied")
        failures = tables.cut(
            applied.where("error IS NOT NULL").groupBy("cluster_id").agg(F.min("error").alias("_row_error")),
            "failures",
        )
        applied = tables.lookup(applied, failures.select("cluster_id"), ["cluster_id"], "left_anti")
        checked = checked.join(failures, "cluster_id", "left")
    else:
        checked = checked.withColumn("_row_error", F.lit(None).cast("string"))
    before = F.col("source_row") if image else F.lit(None).cast("map<string,string>")
    staged = applied.select(
        "member_id", "cluster_id", "cluster_uid",
        F.col("column_name").alias("target_column"),
        F.col("value").alias("original_value"),
        "transformed_value", "fallback_value",
        before.alias("source_row_before"),
        after_image(before, F.col("column_name"), F.col("transformed_value")).alias("source_row_after"),
        F.lit("applied").alias("apply_status"),
    )
    staged = tables.cut(staged, "staged")
    counts = staged.groupBy("cluster_id").agg(F.count("*").alias("affected_rows"))
    lost = unmatched.groupBy("cluster_id").agg(F.count("*").alias("unmatched_count")) if unmatched is not None else None
    plan = checked.join(counts, "cluster_id", "left")
    plan = plan.withColumn("unmatched_count", F.lit(0)) if lost is None else plan.join(lost, "cluster_id", "left")
    error = F.coalesce("_code_error", "_row_error")
    failed = error.isNotNull()

    def forced(column: str, value) -> Column:
        return F.when(failed, F.lit(value)).otherwise(F.col(column)).alias(column)

    changed = ("guardrail_action", "risk_level", "requires_human_review")
    kept = [c for c in checked.columns if c not in (*changed, "missing_fields") and not c.startswith("_")]
    status = F.when(failed, F.lit("execution_failed")).otherwise(F.col("_status"))
    plan = plan.select(
        *kept,
        forced("guardrail_action", "quarantine"), forced("risk_level", "high"), forced("requires_human_review", True),
        status.alias("execution_status"),
        (status == "staged").alias("ready_for_guardrails"),
        F.coalesce("affected_rows", F.lit(0)).cast("bigint").alias("affected_rows"),
        F.col("size").cast("bigint").alias("member_count"),
        F.coalesce("unmatched_count", F.lit(0)).cast("bigint").alias("unmatched_count"),
        "missing_fields",
        error.alias("execution_error"),
    )
    return plan, staged


def execution_summary(plan: DataFrame) -> DataFrame:
    """One row. A failed execution also counts as quarantined, a broken contract only as itself."""
    def times(*statuses: str) -> Column:
        return F.count_if(F.col("execution_status").isin(*statuses))

    total = F.count("*")
    return plan.agg(
        F.when(total == 0, F.lit("no_remediations")).otherwise(F.lit("completed")).alias("status"),
        total.alias("total"),
        times("staged").alias("staged"),
        times("quarantined", "execution_failed").alias("quarantined"),
        times("invalid_contract").alias("invalid_contract"),
        times("execution_failed").alias("execution_failed"),
        F.coalesce(F.sum("affected_rows"), F.lit(0)).cast("bigint").alias("applied_rows"),
    )
