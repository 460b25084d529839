import pytest

import __spark_entry__ as contract
from compare import check_engine, compare
from inputs import SF
from mendframe.plans import samples
from mendframe.settings import ValidationSpec
from mendframe.streaming import lanes


def test_every_check_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", [
    "column_type_profile", "validate_rows_anomalies", "declared_schema_validation", "typed_column_validation",
    "json_record_documents", "jsonl_source_validation", "vector_upsert", "row_text_and_member_id", "pattern_keys_full_text",
    "registry_upsert", "blended_retrieval", "parse_model_responses", "contract_check", "repair_expressions", "member_lookup",
    "execution_failures", "guardrail_decisions", "run_summary", "row_hash_incremental", "stream_validate_events",
    "stream_anomaly_rate",
])
def test_query_equals_its_check(spark, name):
    con = check_engine(SF)
    assert compare(spark, con, SF, name, contract.queries()[name], contract.oracle_sql()[name]) is None


def test_row_filter_is_compiled_and_columns_are_pruned(spark):
    validated = samples.validated_orders(spark, SF)
    plan = validated.where("NOT _bad").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "lambda" not in plan


def test_stream_refuses_nothing_it_can_do(spark, tmp_path):
    rows = spark.readStream.schema("id string, amount string").json(str(tmp_path))
    assert lanes.validate_stream(rows, ValidationSpec.build(required_columns=["amount"]), "id").isStreaming
    with pytest.raises(ValueError, match="windowed_duplicates"):
        lanes.validate_stream(rows, samples.orders_spec(), "id")
