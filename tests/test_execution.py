import pytest
from pyspark.sql import functions as F

from mendframe import settings as S
from mendframe.functions import expressions as E
from mendframe.operators import execution as X, guardrails as G, promotion as T, quality

VALUES = [None, "", "null", "abc", " A,b ", "1,200.50", "12", "-7", "n/a", "a@b", "ééß"]
CODES = [
    "lambda x: x", S.KEEP_NULL_CODE, S.STRIP_COMMAS_CODE, "lambda x: x.lower() if x else 'none'",
    "lambda x: x or 'empty'", "lambda x: x and x.upper()", "lambda x: not x", "lambda x: x is None",
    "lambda x: len(x)", "lambda x: x[1:3] + '-' + x[-2:]", "lambda x: 'y' if 'b' in x else 'n'",
    "lambda x: x in ('abc', None)", "lambda x: str(x) + '!'", "lambda x: x == 'abc' or x == '12'",
    "lambda x: float(x) * 2", "lambda x: int(x) % 5", "lambda x: float('nan')", "lambda x: 1 / 0",
    "lambda x: max(len(x), 3)", "lambda x: {'12': 'dozen'}[x]", "lambda x: round(abs(float(x.replace(',', ''))), 1)",
    "lambda x, sep=',': x.replace(sep, ';')", "lambda x: x.strip('a')", "lambda x: x * 2", "lambda x: y",
]
REFUSED = [
    "lambda x: __import__('os')", "lambda x: x.__class__", "lambda x: x.format()", "[1]", "lambda x: [y for y in x]",
    "lambda x: x < 3", "lambda x: x // 2", "lambda x: x.replace(',', count=1)", "not python(", "lambda x: open('f')",
]


def reference(code, value):
    value = None if value in S.MISSING_INPUT else value
    try:
        result = eval(code, {})(value)
    except Exception:
        return None, True
    if result is None or (isinstance(result, float) and result != result):
        return None, False
    return str(result), False


def test_repairs_equal_python(spark):
    rows = spark.createDataFrame([(c, v) for c in CODES for v in VALUES], "code string, value string")
    counted = rows.groupBy("code").agg(F.count("*").alias("size"))
    applied, can_fail = E.apply_codes(rows, counted)
    assert can_fail
    for r in applied.collect():
        assert (r.transformed_value, r.error is not None) == reference(r.code, r.value), (r.code, r.value)


@pytest.mark.parametrize("code", REFUSED)
def test_refused_repairs(code):
    with pytest.raises(E.Rejected):
        E.parse(code)


def remediations(spark, rows):
    schema = (
        "cluster_id string, cluster_uid string, transformation_type string, code string, confidence_score double, reasoning string, "
        "fallback_value string, inferred_anomaly_type string, model_used string, size bigint, cache_hit boolean, pattern_key string, "
        "guardrail_action string, risk_level string, requires_human_review boolean, validation_checks array<string>, raw_response string"
    )
    full = [(c, f"u_{c}", kind, code, 0.95, "r", "null", "type_cast", "m", n, False, "p", "auto_apply_with_audit", "low", False, ["x"], None)
            for c, kind, code, n in rows]
    return spark.createDataFrame(full, schema)


def members(spark, rows):
    return spark.createDataFrame(rows, "cluster_id string, member_id string, column_name string, value string, source_row map<string,string>")


def test_stage_is_all_or_nothing(spark):
    plan, staged = X.stage(
        remediations(spark, [("a", "lambda", S.STRIP_COMMAS_CODE, 1), ("b", "lambda", "lambda x: float(x)", 2),
                             ("c", "lambda", "lambda x: __import__('os')", 1), ("d", "quarantine", "lambda x: x", 1)]),
        members(spark, [("a", "m1", "amount", "1,200.50", {"id": "1", "amount": "1,200.50"}), ("b", "m2", "amount", "1", None),
                        ("b", "m3", "amount", "x", None), ("c", "m4", "amount", "1", None), ("d", "m5", "amount", "1", None)]),
    )
    status = {r.cluster_id: r for r in plan.collect()}
    assert {c: r.execution_status for c, r in status.items()} == {
        "a": "staged", "b": "execution_failed", "c": "execution_failed", "d": "quarantined"}
    assert "cannot call" in status["c"].execution_error and status["b"].risk_level == "high"
    (row,) = staged.collect()
    assert (row.transformed_value, row.source_row_after) == ("1200.50", {"id": "1", "amount": "1200.50"})
    summary = X.execution_summary(plan).first()
    assert (summary.staged, summary.quarantined, summary.execution_failed, summary.applied_rows) == (1, 3, 2, 1)


def test_two_anomalies_of_a_row_give_two_images(spark):
    image = {"a": "null", "b": "x"}
    _, staged = X.stage(remediations(spark, [("c", "rule", "lambda x: x", 2)]),
                        members(spark, [("c", "m1", "a", "null", image), ("c", "m2", "b", "x", image)]))
    assert {r.member_id: r.source_row_after for r in staged.collect()} == {"m1": {"a": None, "b": "x"}, "m2": {"a": "null", "b": "x"}}


def test_member_names(spark):
    found = spark.createDataFrame([(1, "1", "1:amount:e", "amount", "v1"), (2, "1", "1:b:e", "b", "v2"), (3, "9", "", "c", "v3")],
                                  "row_ord bigint, id string, anomaly_uid string, column_name string, value string")
    asked = spark.createDataFrame([("c", m) for m in ("anomaly_1:amount:e", "row_1", "9", "row_9:c:e", "nobody")], "cluster_id string, member_id string")
    matched, lost = X.match_members(asked, found)
    assert {r.member_id: r.value for r in matched.collect()} == {"anomaly_1:amount:e": "v1", "row_1": "v2", "9": "v3"}
    assert {r.member_id for r in lost.collect()} == {"row_9:c:e", "nobody"}


def decided(spark, **fields):
    base = dict(cluster_id="c", cluster_uid="u", execution_status="staged", confidence_score=0.95, risk_level="low",
                requires_human_review=False, affected_rows=2, member_count=2, unmatched_count=0) | fields
    row = G.decide(spark.createDataFrame([base]), fields.get("breaker", False)).first()
    return row.guardrail_status, row.reasons[0]


def test_decisions(spark):
    assert decided(spark) == ("approved", "all_guardrail_checks_passed")
    assert decided(spark, confidence_score=0.82) == ("review_required", "confidence_below_promotion_threshold")
    assert decided(spark, risk_level="High") == ("quarantined", "high_risk_blocked")
    assert decided(spark, affected_rows=0) == ("quarantined", "no_rows_affected")
    assert decided(spark, unmatched_count=1) == ("quarantined", "unmatched_member_ratio_exceeded")
    assert decided(spark, breaker=True, execution_status="invalid_contract") == ("review_required", "circuit_breaker_active")


def test_breaker_counts_rows_once_and_needs_more_than_the_limit(spark):
    found = spark.createDataFrame([(str(i),) for i in (1, 1, 1, 2, 2)], "id string")
    execution = spark.createDataFrame([(2, 0, 0)], "total bigint, quarantined bigint, execution_failed bigint")
    summary = spark.createDataFrame([(10, 5)], "input_rows bigint, anomalies bigint")
    row = G.circuit_breaker(G.risk_snapshot(summary, found, execution)).first()
    assert (row.unique_bad_rows, row.bad_row_ratio, row.circuit_breaker_active) == (2, 0.2, False)
    assert not G.circuit_breaker(G.risk_snapshot(summary, found, execution), {"max_bad_row_ratio": 0.2}).first().circuit_breaker_active


def test_promotion_blockers(spark):
    def blockers(status, approved, review, quarantined, **kw):
        summary = spark.createDataFrame([(status, approved, review, quarantined)], "status string, approved bigint, review_required bigint, quarantined bigint")
        return T.promotion_state(summary, **kw).first().blockers

    assert blockers("completed", 1, 0, 0) == []
    assert blockers("completed", 1, 1, 1) == ["guardrail_review_pending", "guardrail_quarantine_pending"]
    assert blockers("no_execution_plan", 0, 0, 0, report_written=False) == ["phase5_not_completed", "missing_phase5_guardrail_artifact"]
    assert blockers("completed", 1, 0, 0, candidates=F.lit(0)) == ["approved_without_promotion_candidates"]


def test_reviews(spark):
    held = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "member_id string, value string")
    reviews = spark.createDataFrame([("a", "approve", "9"), ("b", "reject", None)], "member_id string, decision string, new_value string")
    rows = {r.member_id: (r.review_status, r.reviewed_value) for r in quality.review_quarantine(held, reviews).collect()}
    assert rows == {"a": ("approved", "9"), "b": ("rejected", None), "c": ("pending", None)}


def test_stage_marks_records_that_break_the_contract(spark):
    """A table that lacks a column has no valid record; nothing is staged and nothing raises."""
    rows = spark.createDataFrame(
        [("c1", "u1", "rule", "lambda x: x", 2), (None, None, "rule", "lambda x: x", 1)],
        "cluster_id string, cluster_uid string, transformation_type string, code string, size bigint",
    )
    whole = rows.withColumns({
        "confidence_score": F.lit(0.9), "reasoning": F.lit(""), "fallback_value": F.lit("null"), "cache_hit": F.lit(False),
        "inferred_anomaly_type": F.lit("type_cast"), "model_used": F.lit("m"), "pattern_key": F.lit("p"),
        "guardrail_action": F.lit("auto_apply_with_audit"), "risk_level": F.lit("low"),
        "requires_human_review": F.lit(False), "validation_checks": F.array(F.lit("schema_check")),
    })
    members = spark.createDataFrame(
        [("m1", "c1", "a", "1"), ("m2", "c1", "a", None)], "member_id string, cluster_id string, column_name string, value string"
    )
    plan, staged = X.stage(whole.drop("code", "risk_level"), members)
    assert staged.count() == 0
    found = {(r.cluster_id, r.execution_status, tuple(r.missing_fields), r.risk_level, r.requires_human_review) for r in plan.collect()}
    assert found == {(c, "invalid_contract", ("code", "risk_level"), "high", True) for c in ("c1", "unknown")}
    plan, staged = X.stage(whole.where("cluster_id = 'c1'"), members)
    assert [(r.execution_status, list(r.missing_fields), r.affected_rows) for r in plan.collect()] == [("staged", [], 2)]
    summary = X.execution_summary(X.stage(whole.drop("code"), members)[0]).first()
    assert (summary.total, summary.invalid_contract, summary.quarantined, summary.applied_rows) == (2, 2, 0, 0)


def test_a_run_names_every_blocker(spark, monkeypatch, tmp_path):
    """A report that was not written and approved clusters that cannot be promoted block a run, too."""
    from mendframe.operators import guardrails, promotion
    from mendframe.plans import run as runs
    from mendframe.plans.catalog import RELAXED_GUARD, RELAXED_PROMOTION

    from mendframe.plans.samples import dirty_orders, orders_spec

    rows, spec = dirty_orders(spark, "/root/testdata/sf0.001").where("CAST(id AS BIGINT) < 600"), orders_spec()
    options = {"order_by": F.col("id").cast("bigint"), "guardrail_policy": RELAXED_GUARD, "promotion_policy": RELAXED_PROMOTION}

    def blockers(result):
        return result.promotion.first().blockers

    with monkeypatch.context() as m:
        m.setattr(runs.sinks, "write_sections", lambda *a: {})
        lost = runs.run(rows, spec, report=str(tmp_path / "lost"), **options)
        assert blockers(lost) == "missing_phase5_guardrail_artifact" and lost.promoted_rows.count() == 0
    with monkeypatch.context() as m:
        decide = guardrails.decide
        m.setattr(guardrails, "decide", lambda *a: decide(*a).withColumn("cluster_uid", F.lit(None).cast("string")))
        nameless = runs.run(rows, spec, report=str(tmp_path / "kept"), **options)
        assert spark.read.parquet(str(tmp_path / "kept" / "guardrails" / "decisions")).count() == nameless.decisions.count()
        assert blockers(nameless) == "approved_without_promotion_candidates" and nameless.promotion.first().promotion_candidates == 0
