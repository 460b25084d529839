"""The whole run: validate, group, repair, stage, guard, promote."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from mendframe.functions import tables, vectors
from mendframe.operators import clustering, execution, guardrails, promotion, remediation, retrieval, validation
from mendframe.settings import ValidationSpec
from mendframe.sources import sinks, state


@dataclass
class RunResult:
    """Named tables of one run."""

    validated: DataFrame
    summary: DataFrame
    anomalies: DataFrame
    members: DataFrame
    clusters: DataFrame
    registry: DataFrame
    remediations: DataFrame
    plan: DataFrame
    staged: DataFrame
    snapshot: DataFrame
    decisions: DataFrame
    guard_summary: DataFrame
    promoted_clusters: DataFrame
    promoted_rows: DataFrame
    promotion: DataFrame
    cluster_vectors: DataFrame
    context: DataFrame | None
    prompts: DataFrame
    extra: dict[str, Any] = field(default_factory=dict)

    def save_state(self, folder: str, recorded_at: str) -> None:
        """Leave the registry, the remediation log and the vectors for later runs."""
        records = tables.cut(remediation.memory_records(self.remediations, recorded_at), "records")
        documents = remediation.memory_document(records).withColumn("vector", vectors.hash_vector(F.col("document")))
        state.save_table(state.upsert_vectors(self.cluster_vectors, documents), f"{folder}/vectors")
        state.append_memory(records, f"{folder}/memory")
        state.save_table(self.registry, f"{folder}/registry")

    @property
    def clean_rows(self) -> DataFrame:
        return validation.clean_rows(self.validated)

    def write(self, folder: str, generated_at: str) -> dict[str, str]:
        """Write every lane and artifact of the run."""
        return {
            "clean_rows": sinks.write_clean_rows(self.clean_rows, folder),
            "anomalies": sinks.write_anomalies(self.anomalies, folder),
            "audit": sinks.write_audit_summary(self.summary, folder, "ingestion_summary"),
            "execution": sinks.write_sections(
                {"plan": self.plan, "summary": execution.execution_summary(self.plan), "staged_rows": self.staged,
                 "quarantined": self.plan.where("execution_status <> 'staged'")},
                f"{folder}/execution", generated_at),
            "guardrails": sinks.write_sections(
                {"decisions": self.decisions, "summary": self.guard_summary, "snapshot": self.snapshot},
                f"{folder}/guardrails", generated_at),
            "promotion": sinks.write_sections(
                {"clusters": self.promoted_clusters, "rows": self.promoted_rows, "summary": self.promotion},
                f"{folder}/promotion", generated_at),
        }


def run(
    rows: DataFrame,
    spec: ValidationSpec | None = None,
    *,
    order_by: str | Column | None = None,
    text: Column | None = None,
    embed: clustering.Embedder | None = None,
    threshold: float = 0.85,
    distinct_patterns: bool = True,
    registry: DataFrame | None = None,
    pattern_cache: DataFrame | None = None,
    memory: DataFrame | None = None,
    responses: DataFrame | None = None,
    rules: DataFrame | None = None,
    cluster_memory: DataFrame | None = None,
    stand_in: bool = False,
    guardrail_policy: Mapping[str, Any] | None = None,
    promotion_policy: Mapping[str, Any] | None = None,
    seen_at: str = "1970-01-01T00:00:00+00:00",
    report: str | None = None,
) -> RunResult:
    """Run all stages in order and return their tables.

    The judged rows are written once, bad and clean apart, and both lanes are read
    from there; so are stage results of anomaly scale. Later stages neither recompute
    them nor depend on an executor. Errors raise; nothing is swallowed.

    ``rules`` (doc_ord, id, source, text, source_weight) gives every cluster its rule
    context, together with ``memory`` and ``cluster_memory``, the stored vectors.
    With ``stand_in``, clusters without an answer of their own in ``responses`` get
    the fixed answer of their family.

    With ``report``, the guardrail report is written to that folder before promotion is
    decided, and a report that is not there then blocks it; else the written decisions
    are the report. Approved clusters count as candidates only if they can be promoted.
    """
    spec = spec or ValidationSpec()
    validated = tables.cut(validation.lean(validation.validate(rows, spec, order_by)), "judged", by=["_bad"])
    found = tables.cut(validation.anomalies(validated), "anomalies")
    summary = tables.one_row(validation.summarize_found(validated, found, spec))
    members, groups = clustering.assign_members(found, text, embed, threshold)
    members = tables.cut(members, "members")
    clusters = clustering.build_clusters(members, groups, distinct_patterns)
    clusters, new_registry = clustering.assign_uids(clusters, registry, seen_at)
    profiled = tables.cut(remediation.with_profile(clustering.mark_cache_hits(clusters, pattern_cache)), "clusters")
    documents = clustering.cluster_documents(profiled)
    cluster_vectors = tables.cut(state.upsert_vectors(cluster_memory, documents), "vectors")
    context = None if rules is None else _context(profiled, rules, memory, cluster_vectors)
    prompts = retrieval.prompt_payloads(profiled, context)
    if stand_in:
        responses = _with_stand_ins(profiled, context, responses)
    remediations = tables.cut(remediation.remediate(profiled, memory, responses), "remediations")
    plan, staged = execution.stage(remediations, members)
    plan = tables.cut(plan, "plan")
    snapshot = guardrails.circuit_breaker(
        guardrails.risk_snapshot(summary, found, execution.execution_summary(plan)), guardrail_policy
    )
    snapshot = tables.one_row(snapshot)
    breaker = snapshot.first()  # one row
    decisions = tables.cut(guardrails.decide(plan, breaker.circuit_breaker_active, guardrail_policy), "decisions")
    guard_summary = tables.one_row(guardrails.guardrail_summary(
        decisions, breaker.circuit_breaker_active, breaker.circuit_breaker_reasons
    ))
    reported = True
    if report is not None:
        parts = {"decisions": decisions, "summary": guard_summary, "snapshot": snapshot}
        sinks.write_sections(parts, f"{report}/guardrails", seen_at)
        reported = all(tables.exists(rows.sparkSession, f"{report}/guardrails/{part}/_SUCCESS") for part in parts)
    candidates = promotion.promoted_clusters(decisions, False).where("cluster_uid IS NOT NULL").count()
    judged = tables.one_row(promotion.promotion_state(guard_summary, promotion_policy, reported, F.lit(candidates)))
    ready = promotion.promoted_clusters(decisions, judged.first().promotion_blocked)
    promoted = promotion.promoted_rows(staged, ready)
    return RunResult(
        validated=validated, summary=summary, anomalies=found, members=members, clusters=profiled,
        registry=new_registry, remediations=remediations, plan=plan, staged=staged, snapshot=snapshot,
        decisions=decisions, guard_summary=guard_summary, promoted_clusters=ready, promoted_rows=promoted,
        promotion=promotion.promotion_summary(judged, ready, promoted), cluster_vectors=cluster_vectors,
        context=context, prompts=prompts, extra={"groups": groups},
    )


def _context(profiled: DataFrame, rules: DataFrame, memory: DataFrame | None, stored: DataFrame) -> DataFrame:
    """Rule context of every cluster; the extra documents are at most k per cluster and kind."""
    numbered = tables.cut(tables.ranked(stored, ["id"], "doc_ord"), "stored")
    extra = [retrieval.cluster_memory_documents(retrieval.with_queries(profiled), numbered)]
    if memory is not None:
        extra.append(retrieval.historical_documents(profiled, memory))
    found = retrieval.retrieve(profiled, rules, [tables.cut(documents, "extra") for documents in extra])
    return tables.cut(retrieval.rule_context(found), "context")


def _with_stand_ins(profiled: DataFrame, context: DataFrame | None, responses: DataFrame | None) -> DataFrame:
    """Answers with a fixed one for every pattern that has none."""
    if context is not None:
        profiled = profiled.join(context.select("cluster_id", "top_rule"), "cluster_id", "left")
    fixed = remediation.static_answers(profiled)
    if responses is None:
        return fixed
    fresh = fixed.join(responses.select("pattern_key").distinct(), "pattern_key", "left_anti")
    return responses.unionByName(fresh, allowMissingColumns=True)


def run_with_state(
    rows: DataFrame, spec: ValidationSpec | None, folder: str, seen_at: str, **options: Any
) -> RunResult:
    """A run that knows what earlier runs left in ``folder`` and leaves its own there.

    ``options`` are those of ``run``. The state is saved after all stages are done, so a
    run that fails leaves the state as it was.
    """
    spark = rows.sparkSession
    result = run(
        rows, spec, seen_at=seen_at,
        registry=state.load_registry(spark, f"{folder}/registry"),
        memory=state.scan_memory(spark, f"{folder}/memory"),
        cluster_memory=state.load_table(spark, f"{folder}/vectors", state.VECTORS),
        **options,
    )
    result.save_state(folder, seen_at)
    return result


def run_summary(result: RunResult) -> DataFrame:
    """(phase, status, metric, value): what the six phases did."""

    def lines(phase: int, table: DataFrame, status: Column, **metrics: Column) -> DataFrame:
        pairs = F.array(*(
            F.struct(F.lit(name).alias("metric"), value.cast("string").alias("value")) for name, value in metrics.items()
        ))
        return table.select(F.lit(f"phase{phase}").alias("phase"), status.alias("status"), F.inline(pairs))

    c = F.col
    metrics = clustering.cluster_metrics(result.clusters)
    repaired = remediation.remediation_summary(result.remediations)
    executed = execution.execution_summary(result.plan)
    parts = [
        lines(1, result.summary, c("status"), rows=c("input_rows"), clean=c("clean_rows"), anomalies=c("anomalies")),
        lines(2, metrics, c("status"), anomalies=c("input_anomalies"), clusters=c("clusters_formed")),
        lines(3, repaired, c("status"), remediations=c("total"), quarantined=c("quarantined")),
        lines(4, executed, c("status"), staged=c("staged"), quarantined=c("quarantined"), applied_rows=c("applied_rows")),
        lines(5, result.guard_summary, c("status"), approved=c("approved"), review=c("review_required"),
              circuit_breaker=c("circuit_breaker_active")),
        lines(6, result.promotion, c("status"), promoted_clusters=c("promoted_clusters"),
              promoted_rows=c("promoted_rows"), blocked=c("promotion_blocked")),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged
