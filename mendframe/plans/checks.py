"""The same results in plain SQL, for the check engine.

Each text reads the driver tables only and repeats none of the library code.
"""

from __future__ import annotations

from mendframe.plans.samples import DIRTY_ORDERS_SQL


def _missing(x: str) -> str:
    return f"({x} IS NULL OR lower(trim({x})) IN ('', 'null', 'none', 'nan', 'n/a', 'na'))"


EMAIL = r"'^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$'"
DATE = r"'^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})$'"
NUMBER = r"'^-?\d+(\.\d+)?$'"


def _email(x: str) -> str:
    return f"regexp_matches(trim({x}), {EMAIL})"


def _date(x: str) -> str:
    return f"regexp_matches(trim({x}), {DATE})"


def _number(x: str) -> str:
    return f"regexp_matches(replace(trim({x}), ',', ''), {NUMBER})"


def _hex(d: str, at: int) -> str:
    return f"CAST('0x' || substr({d}, {at}, 15) AS BIGINT)"


def _pattern(text: str) -> str:
    """Key of a group whose members share one text."""
    d = f"sha256(lower(trim({text})))"
    return f"sha256('1|' || {_hex(d, 1)} || '|' || {_hex(d, 16)} || '|' || {_hex(d, 31)} || '|' || {_hex(d, 46)})"


IDENTITY = "lambda x: x"
STRIP = "lambda x: None if x is None else str(x).replace('','', '''').strip()"
KEEP = "lambda x: x if x is not None else None"

BASE = f"""
WITH RECURSIVE dirty AS ({DIRTY_ORDERS_SQL.format(orders="orders")}),
cells AS (
  SELECT id, CAST(id AS BIGINT) AS ord, 1 AS slot, 'amount' AS column_name, amount AS value, 'numeric' AS kind FROM dirty
  UNION ALL SELECT id, CAST(id AS BIGINT), 2, 'customer_email', customer_email, 'email' FROM dirty
  UNION ALL SELECT id, CAST(id AS BIGINT), 3, 'order_date', order_date, 'date' FROM dirty
),
judged AS (
  SELECT *, CASE WHEN {_missing("value")} THEN 'null_block_error'
    WHEN kind = 'numeric' AND NOT {_number("value")} THEN 'numeric_format_error'
    WHEN kind = 'email' AND NOT {_email("value")} THEN 'email_format_error'
    WHEN kind = 'date' AND NOT {_date("value")} THEN 'date_format_error' END AS error_type
  FROM cells
),
refs AS (SELECT lower(trim(order_ref)) AS k FROM dirty GROUP BY 1 HAVING count(*) > 1),
errors AS (
  SELECT id, ord, slot, column_name, value, error_type FROM judged WHERE error_type IS NOT NULL
  UNION ALL
  SELECT id, CAST(id AS BIGINT), 4, 'order_ref', order_ref, 'duplicate_value_error' FROM dirty
  WHERE lower(trim(order_ref)) IN (SELECT k FROM refs)
),
found AS (
  SELECT id, ord, CAST(row_number() OVER (PARTITION BY id ORDER BY slot) - 1 AS INTEGER) AS pos,
    id || ':' || column_name || ':' || error_type AS anomaly_uid, column_name, value, error_type,
    CASE error_type WHEN 'null_block_error' THEN 'value is missing or sentinel null'
      WHEN 'numeric_format_error' THEN 'amount contains numeric separator noise'
      WHEN 'email_format_error' THEN 'email token malformed address'
      WHEN 'date_format_error' THEN 'date token format mismatch'
      ELSE 'duplicate value detected in unique column' END AS anomaly_hint
  FROM errors
),
grouped AS (
  SELECT column_name, error_type, anomaly_hint, count(*) AS size, min(ord * 100 + pos) AS first
  FROM found GROUP BY ALL
),
clusters AS (
  SELECT *, row_number() OVER (ORDER BY first) AS cluster_ord,
    'cluster_' || row_number() OVER (ORDER BY first) AS cluster_id,
    printf('family_%05d', row_number() OVER (ORDER BY first)) AS cluster_uid,
    {_pattern("'column_name=' || column_name || ' error_type=' || error_type")} AS pattern_key
  FROM grouped
),
members AS (
  SELECT f.*, c.cluster_id, c.cluster_uid, c.cluster_ord, 'anomaly_' || f.anomaly_uid AS member_id
  FROM found f JOIN clusters c USING (column_name, error_type)
),
sampled AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY ord, pos) AS rn FROM members QUALIFY rn <= 5
),
valued AS (SELECT cluster_id, value, min(rn) AS seen FROM sampled GROUP BY ALL),
listed AS (SELECT cluster_id, list(value ORDER BY seen) AS vals FROM valued GROUP BY cluster_id),
hits AS (
  SELECT cluster_id, vals,
    list_filter(vals, lambda x: lower(x) NOT IN ('none', 'nan', 'null', '')) AS present,
    len(list_filter(vals, lambda x: regexp_matches(x, '[0-9]{{1,4}}[-/.][0-9]{{1,2}}[-/.][0-9]{{1,4}}|[A-Za-z]+ [0-9]{{1,2}} [0-9]{{4}}'))) AS dates,
    len(list_filter(vals, lambda x: regexp_matches(replace(replace(x, ',', ''), ' ', ''), '^-?[0-9]+([.,][0-9]+)?$'))) AS numbers
  FROM listed
),
profiled AS (
  SELECT c.*, h.vals, h.present,
    CASE WHEN len(h.present) = 0 THEN 'null_fill'
      WHEN h.dates >= greatest(1, ceil(len(h.present) * 0.6)) THEN 'date_format'
      WHEN h.numbers >= greatest(1, ceil(len(h.present) * 0.6)) THEN 'type_cast'
      WHEN len(h.present) < len(h.vals) THEN 'null_fill' ELSE 'string_corrupt' END AS family,
    c.error_type = 'duplicate_value_error' AS is_duplicate
  FROM clusters c JOIN hits h USING (cluster_id)
),
rules AS (
  SELECT * FROM (VALUES
    ('duplicate', 'rule', '{IDENTITY}', 0.93, 'Detected duplicate-value cluster and selected a no-mutation deterministic hold rule.', true, 'deterministic/duplicate_hold'),
    ('date_format', 'rule', '{IDENTITY}', 0.91, 'Detected date-format cluster and selected a deterministic staging rule for guarded downstream handling.', true, 'deterministic/date_format'),
    ('type_cast', 'lambda', '{STRIP}', 0.92, 'Detected numeric formatting noise and selected deterministic string normalization.', false, 'deterministic/type_cast'),
    ('null_fill', 'rule', '{KEEP}', 0.9, 'Detected null-heavy cluster and selected a null-preserving deterministic rule.', false, 'deterministic/null_fill'),
    ('string_corrupt', 'quarantine', '{IDENTITY}', 0.0, 'Provider failure: no response for this pattern', false, 'none')
  ) AS t(rule, transformation_type, code, confidence_score, reasoning, uses_sample, model_used)
),
decided AS (
  SELECT p.*, r.transformation_type, r.code, CAST(r.confidence_score AS DOUBLE) AS confidence_score, r.reasoning,
    r.model_used, CASE WHEN r.uses_sample THEN p.vals[1] ELSE 'null' END AS fallback_value,
    CASE WHEN r.transformation_type = 'quarantine' THEN 'quarantine' ELSE 'auto_apply_with_audit' END AS guardrail_action,
    CASE WHEN r.transformation_type = 'quarantine' THEN 'high' ELSE 'low' END AS risk_level,
    r.transformation_type = 'quarantine' AS requires_human_review
  FROM profiled p JOIN rules r ON r.rule = CASE WHEN p.is_duplicate THEN 'duplicate' ELSE p.family END
),
staged AS (
  SELECT m.*, d.fallback_value, d.code, d.model_used, d.confidence_score, d.transformation_type,
    CASE WHEN m.value IN ('null', 'None', 'none', 'NULL', 'N/A', 'n/a', '') THEN NULL ELSE m.value END AS input
  FROM members m JOIN decided d USING (cluster_id) WHERE d.transformation_type <> 'quarantine'
),
forced AS (
  SELECT m.*, CASE WHEN value IN ('null', 'None', 'none', 'NULL', 'N/A', 'n/a', '') THEN NULL ELSE value END AS input
  FROM members m
),
forced_rows AS (
  SELECT *, CASE cluster_ord WHEN 1 THEN NOT regexp_matches(replace(input, ',', ''), '^[-+ ]*[0-9.]+ *$')
      WHEN 2 THEN input IS NULL WHEN 3 THEN true WHEN 4 THEN input IS NULL WHEN 5 THEN input IS NULL ELSE false END AS bad,
    CASE cluster_ord WHEN 2 THEN lower(input) WHEN 4 THEN right(input, 3) WHEN 6 THEN coalesce(input, 'none') END AS output
  FROM forced
),
forced_plan AS (
  SELECT cluster_id, cluster_ord, bool_or(coalesce(bad, true)) AS failed, count(*) AS members,
    max(output) AS largest FROM forced_rows GROUP BY ALL
),
forced_totals AS (
  SELECT count(*) AS total, count(*) FILTER (failed) AS failed, sum(CASE WHEN failed THEN 0 ELSE members END) AS applied
  FROM forced_plan
)
"""

QUARANTINED = "('invalid_contract', 'execution_failed', 'quarantined')"
RECORDS = """
WITH records AS (
  SELECT printf('cluster_%d', c_custkey) AS cluster_id, printf('family_%05d', c_custkey) AS cluster_uid,
    ['staged','staged','staged','staged','staged','quarantined','execution_failed','invalid_contract','paused'][c_custkey % 9 + 1] AS execution_status,
    round(0.7::DOUBLE + (c_custkey % 30) / 100.0::DOUBLE, 2) AS confidence_score,
    CASE WHEN c_custkey % 8 = 0 THEN 'HIGH' WHEN c_custkey % 8 = 1 THEN 'unknown' ELSE 'low' END AS risk_level,
    c_custkey % 6 = 0 AS review, c_custkey % 10 AS affected_rows, c_custkey % 10 + c_custkey % 4 AS member_count,
    c_custkey % 4 AS unmatched_count
  FROM customer
),
judged AS (
  SELECT *, CASE
    WHEN execution_status IN ('invalid_contract', 'execution_failed', 'quarantined') THEN 'execution_status=' || execution_status
    WHEN execution_status <> 'staged' THEN 'unknown_execution_state'
    WHEN affected_rows <= 0 THEN 'no_rows_affected'
    WHEN member_count > 0 AND round(unmatched_count / member_count, 4) > 0.2 THEN 'unmatched_member_ratio_exceeded'
    WHEN {high} AND lower(risk_level) = 'high' THEN 'high_risk_blocked'
    WHEN confidence_score < 0.75 THEN 'confidence_below_guardrail_floor'
    WHEN review THEN 'human_review_required'
    WHEN confidence_score < 0.9 THEN 'confidence_below_promotion_threshold'
    ELSE 'all_guardrail_checks_passed' END AS reason
  FROM records
),
outcomes AS (
  SELECT *, CASE WHEN reason = 'all_guardrail_checks_passed' THEN 'approved'
    WHEN reason IN ('human_review_required', 'confidence_below_promotion_threshold') THEN 'review_required'
    ELSE 'quarantined' END AS outcome FROM judged
)
"""

CHECKS: dict[str, str] = {}


def _orders(name: str, sql: str) -> None:
    CHECKS[name] = BASE + sql


CHECKS["null_like_profile"] = f"WITH dirty AS ({DIRTY_ORDERS_SQL.format(orders='orders')}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) AS rows, count(*) FILTER ({_missing(c)}) AS missing FROM dirty"
    for c in ("id", "order_ref", "order_date", "customer_email", "amount")
)
for _name, _column, _check in (
    ("email_format_errors", "customer_email", _email),
    ("date_format_errors", "order_date", _date),
    ("numeric_format_errors", "amount", _number),
):
    CHECKS[_name] = (
        f"WITH dirty AS ({DIRTY_ORDERS_SQL.format(orders='orders')}) SELECT id, {_column} AS value FROM dirty "
        f"WHERE NOT {_missing(_column)} AND NOT {_check(_column)}"
    )
CHECKS["column_type_profile"] = f"WITH dirty AS ({DIRTY_ORDERS_SQL.format(orders='orders')}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{t}' AS expected_type, '{e}' AS error_type, "
    f"count(*) FILTER (NOT {_missing(c)}) AS checked, count(*) FILTER (NOT {_missing(c)} AND NOT {ok}) AS failed FROM dirty"
    for c, t, e, ok in (
        ("id", "any", "none", "true"),
        ("order_ref", "any", "none", "true"),
        ("order_date", "date", "date_format_error", _date("order_date")),
        ("customer_email", "email", "email_format_error", _email("customer_email")),
        ("amount", "numeric", "numeric_format_error", _number("amount")),
    )
)
CHECKS["duplicate_values"] = f"WITH dirty AS ({DIRTY_ORDERS_SQL.format(orders='orders')}) " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, lower(trim({c})) AS dup_key, count(*) AS n FROM dirty "
    f"WHERE NOT {_missing(c)} GROUP BY 2 HAVING count(*) > 1"
    for c in ("order_ref", "customer_email")
)
CHECKS["duplicate_flags_hot_values"] = """
WITH n AS (SELECT event_type, count(*) OVER (PARTITION BY lower(trim(event_type))) AS a,
    count(*) OVER (PARTITION BY lower(trim(props))) AS b, count(*) OVER (PARTITION BY user_id) AS c,
    event_type IS NULL AS na, props IS NULL AS nb, user_id IS NULL AS nc FROM events)
SELECT event_type, concat_ws('|', CASE WHEN a > 1 AND NOT na THEN 'event_type' END,
  CASE WHEN b > 1 AND NOT nb THEN 'props' END, CASE WHEN c > 1 AND NOT nc THEN 'user_id' END) AS duplicate_columns,
  count(*) AS rows FROM n GROUP BY ALL"""
CHECKS["row_identifiers"] = """
SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'C' || c_custkey WHEN 1 THEN 'R' || c_custkey
  WHEN 2 THEN 'X' || c_custkey ELSE CAST(c_custkey + 1 AS VARCHAR) END AS row_identifier FROM customer"""
_orders("validate_rows_anomalies", """
SELECT f.id, pos, anomaly_uid, column_name, value, error_type, anomaly_hint, 'phase1_ingestion' AS source_phase,
  d.order_ref AS source_order_ref FROM found f JOIN dirty d USING (id)""")
_orders("clean_rows", "SELECT d.* FROM dirty d WHERE id NOT IN (SELECT id FROM found)")
_BREAKDOWN = "SELECT column_name, error_type, count(*) AS anomalies FROM found GROUP BY ALL"
for _name in ("anomaly_breakdown", "csv_source_validation", "jsonl_source_validation", "anomaly_directory_scan"):
    _orders(_name, _BREAKDOWN)
_orders("anomaly_directory_skipped", """
SELECT CASE ord % 5 WHEN 0 THEN 'parquet' WHEN 2 THEN 'jsonl' WHEN 3 THEN 'json' ELSE 'csv' END AS suffix, 'read' AS reason, count(*) AS n
FROM found GROUP BY ALL UNION ALL SELECT 'parquet', 'no readable footer', 1 UNION ALL SELECT 'csv', 'no header', 1""")
CHECKS["csv_quoted_rows"] = """
SELECT CAST(c_custkey AS VARCHAR) AS id, 'said "' || c_name || '",' || chr(10) || 'then left' || chr(10) || c_mktsegment AS note,
  CAST(c_nationkey AS VARCHAR) AS nation FROM customer"""
CHECKS["csv_malformed_rows"] = """
SELECT CAST(c_custkey AS VARCHAR) AS id, true AS malformed FROM customer WHERE (c_custkey % 7 = 0) <> (c_custkey % 10 = 3)"""
CHECKS["csv_ragged_validation"] = """
WITH c AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_custkey % 7 = 0 AS short, c_custkey % 10 = 3 AS long,
    CASE WHEN c_custkey % 5 = 0 THEN 'two' || chr(10) || ',"lines" of ' || c_mktsegment ELSE c_mktsegment END AS segment,
    CASE WHEN c_custkey % 5 = 0 THEN '"two' || chr(10) || ',""lines"" of ' || c_mktsegment || '"' ELSE c_mktsegment END AS raw,
    CASE WHEN c_custkey % 3 = 0 THEN '1x' ELSE CAST(c_nationkey AS VARCHAR) END AS amount
  FROM customer
), cells AS (
  SELECT *, CASE WHEN short THEN amount ELSE segment END AS second, CASE WHEN NOT short THEN amount WHEN long THEN 'EXTRA' END AS third,
    id || CASE WHEN short THEN '' ELSE ',' || raw END || ',' || amount || CASE WHEN long THEN ',EXTRA' ELSE '' END AS record, short <> long AS malformed
  FROM c
), bad AS (SELECT *, coalesce(NOT regexp_matches(third, '^-?[0-9]+([.][0-9]+)?$'), false) AS noise FROM cells)
SELECT id, 0 AS pos, '' AS column_name, record AS value, 'malformed_row_error' AS error_type, second AS segment FROM bad WHERE malformed
UNION ALL
SELECT id, CASE WHEN malformed THEN 1 ELSE 0 END, 'amount', third, 'numeric_format_error', second FROM bad WHERE noise"""
_orders("validate_aggregated_input", """
SELECT count(*) AS rows, (SELECT count(DISTINCT id) FROM found) AS bad_rows, CAST(1 AS BIGINT) AS first_ord, count(*) AS last_ord,
  count(*) AS ordinals, count(*) - (SELECT count(DISTINCT id) FROM found) AS clean_rows FROM dirty""")
_orders("null_text_clusters", """
SELECT coalesce(CASE WHEN error_type <> 'null_block_error' THEN value END, '') AS text, count(*) AS size, count(*) AS members
FROM found GROUP BY 1""")
_orders("null_order_clusters", """
SELECT column_name AS target_column, count(*) AS size, CAST(least(count(*), 5) AS INT) AS samples
FROM found GROUP BY column_name, error_type""")
_orders("ingestion_summary", """
SELECT 'completed' AS status, (SELECT count(*) FROM dirty) AS input_rows,
  (SELECT count(*) FROM dirty) - count(DISTINCT id) AS clean_rows, count(DISTINCT id) AS bad_rows, count(*) AS anomalies,
  'date,duplicate,email,numeric,required' AS validation_rules_applied,
  'order_date,customer_email,amount' AS required_columns,
  count(*) FILTER (error_type = 'date_format_error') AS date_format_error,
  count(*) FILTER (error_type = 'duplicate_value_error') AS duplicate_value_error,
  count(*) FILTER (error_type = 'email_format_error') AS email_format_error,
  count(*) FILTER (error_type = 'null_block_error') AS null_block_error,
  count(*) FILTER (error_type = 'numeric_format_error') AS numeric_format_error FROM found""")
_orders("ingestion_statuses", """,
whole AS (SELECT (SELECT count(*) FROM dirty) AS input_rows, count(DISTINCT id) AS bad_rows, count(*) AS anomalies FROM found)
SELECT input, status, coalesce(input_rows, 0) AS input_rows, coalesce(bad_rows, 0) AS bad_rows, coalesce(anomalies, 0) AS anomalies,
  status = 'error' AS failed
FROM (VALUES ('table', 'completed'), ('lines', 'completed'), ('empty', 'no_input'), ('nothing', 'no_input'), ('broken', 'error'),
  ('absent', 'error'), ('unsupported', 'error')) AS t(input, status) LEFT JOIN whole ON status = 'completed'""")
CHECKS["declared_schema_validation"] = f"""
SELECT * FROM (
  SELECT 'c_mktsegment' AS column_name, 'email_format_error' AS error_type, count(*) AS anomalies FROM customer
    WHERE NOT {_missing("c_mktsegment")} AND NOT {_email("c_mktsegment")}
  UNION ALL SELECT 'c_nationkey', 'date_format_error', count(*) FROM customer WHERE c_nationkey IS NOT NULL
  UNION ALL SELECT 'c_nationkey', 'duplicate_value_error', count(*) FROM customer
    WHERE c_nationkey IN (SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'c_name', 'null_block_error', count(*) FROM customer WHERE {_missing("c_name")}
  UNION ALL SELECT 'c_name', 'duplicate_value_error', count(*) FROM customer
    WHERE NOT {_missing("c_name")} AND lower(trim(c_name)) IN (SELECT lower(trim(c_name)) FROM customer GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'c_phone', 'null_block_error', count(*) FROM customer
) WHERE anomalies > 0"""
CHECKS["typed_column_validation"] = """
SELECT * FROM (
  SELECT 'l_extendedprice' AS column_name, 'numeric_format_error' AS error_type, count(*) AS anomalies FROM lineitem WHERE l_orderkey % 97 = 0
  UNION ALL SELECT 'l_extendedprice', 'null_block_error', count(*) FROM lineitem WHERE l_orderkey % 97 = 1 OR (l_orderkey % 97 > 1 AND l_extendedprice IS NULL)
  UNION ALL SELECT 'l_shipdate', 'null_block_error', count(*) FROM lineitem WHERE l_shipdate IS NULL
) WHERE anomalies > 0"""
CHECKS["json_events_validation"] = """
WITH k AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events),
t AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN k || 'x' WHEN 1 THEN 'n/a' ELSE k END AS v FROM k)
SELECT CAST(event_id AS VARCHAR) AS id, 'k_total' AS column_name, v AS value,
  CASE WHEN v IS NULL OR event_id % 7 = 1 THEN 'null_block_error' ELSE 'numeric_format_error' END AS error_type
FROM t WHERE v IS NULL OR event_id % 7 IN (0, 1) OR NOT regexp_matches(v, '^-?[0-9]+([.][0-9]+)?$')"""
CHECKS["json_record_documents"] = """
SELECT role, conv_id % 3 AS shape, sum(CASE WHEN conv_id % 3 = 1 THEN 2 ELSE 1 END)::BIGINT AS objects FROM conversations GROUP BY ALL"""
_orders("artifact_sections", """
SELECT 'audit_input_rows' AS section, count(*) AS rows FROM dirty
UNION ALL SELECT 'clean_rows', count(*) FROM dirty WHERE id NOT IN (SELECT id FROM found)
UNION ALL SELECT 'anomalies', count(*) FROM found
UNION ALL SELECT 'execution_plan', count(*) FROM decided
UNION ALL SELECT 'execution_staged_rows', count(*) FROM staged
UNION ALL SELECT 'execution_quarantined', count(*) FROM decided WHERE transformation_type = 'quarantine'
UNION ALL SELECT 'guardrail_decisions', count(*) FROM decided
UNION ALL SELECT 'promoted_clusters', count(*) FROM decided WHERE transformation_type <> 'quarantine'
UNION ALL SELECT 'promoted_rows', count(*) FROM staged""")
CHECKS["vector_upsert"] = """
SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN vec_id % 3 = 0 THEN 'v2-' || vec_id WHEN vec_id % 2 = 0 THEN 'v1-' || vec_id
  ELSE 'v0-' || label END AS document, CAST(label AS VARCHAR) AS label, round(embedding[1]::DOUBLE, 4) AS v0 FROM embeddings
UNION ALL SELECT vec_id || 'n', 'v2-' || vec_id, CAST(label AS VARCHAR), round(embedding[1]::DOUBLE, 4) FROM embeddings WHERE vec_id % 3 = 0"""
_TEXT = ("'anomaly_hint=' || anomaly_hint || ' anomaly_uid=' || anomaly_uid || ' column_name=' || column_name || ' error_type=' || "
         "error_type || ' id=' || id || ' source_phase=phase1_ingestion value=' || coalesce(value, 'None')")
_orders("row_text_and_member_id", f"""
SELECT anomaly_uid, sha256({_TEXT}) AS text_digest, 'anomaly_' || anomaly_uid AS member_id,
  'row_' || anomaly_uid AS id_without_uid, 'row_' || id AS id_without_names,
  'row_' || substr(sha256({_TEXT}), 1, 16) AS id_by_digest FROM found""")
CHECKS["hash_embedding"] = """
SELECT c_custkey, CAST(i AS INTEGER) AS pos, round(CAST('0x' || substr(sha256(c_name), i * 2 + 1, 2) AS INTEGER) / 255.0::DOUBLE, 6) AS value
FROM customer, range(32) AS r(i)"""
CHECKS["text_vectors"] = r"""
SELECT doc_id, 256::INTEGER AS dimensions, CASE WHEN regexp_matches(text, '[\p{L}\p{N}_]') THEN 1.0 ELSE 0.0 END::DOUBLE AS squared_length FROM documents"""
CHECKS["cosine_topk"] = """
WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id,
    round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS score FROM embeddings a, embeddings b)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 4"""
CHECKS["cluster_centroids"] = """
WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)
SELECT label, CAST(pos AS INTEGER) AS pos, round(avg(x), 4) + 0.0 AS mean FROM u GROUP BY ALL"""
CHECKS["leader_assignment"] = """
WITH RECURSIVE near AS (
  SELECT b.vec_id AS b, list(a.vec_id ORDER BY a.vec_id) AS before FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
  AND list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3 GROUP BY 1
),
steps AS (SELECT e.vec_id, coalesce(n.before, []::BIGINT[]) AS before, row_number() OVER (ORDER BY e.vec_id) AS step
  FROM embeddings e LEFT JOIN near n ON n.b = e.vec_id),
walk AS (
  SELECT 0::BIGINT AS step, []::BIGINT[] AS leaders
  UNION ALL
  SELECT s.step, CASE WHEN list_has_any(s.before, w.leaders) THEN w.leaders ELSE list_append(w.leaders, s.vec_id) END
  FROM walk w JOIN steps s ON s.step = w.step + 1
),
final AS (SELECT leaders FROM walk ORDER BY step DESC LIMIT 1)
SELECT s.vec_id AS item, coalesce(list_min(list_intersect(s.before, f.leaders)), s.vec_id) AS leader FROM steps s, final f"""
_orders("signature_clusters", """
SELECT cluster_id, cluster_uid, size, column_name AS target_column, pattern_key, false AS cache_hit,
  CAST(least(size, 5) AS INTEGER) AS samples FROM clusters""")
_orders("sample_rows_topk", "SELECT cluster_id, CAST(rn - 1 AS INTEGER) AS pos, anomaly_uid, value FROM sampled")
_D = "sha256(lower(trim(column_name || ' ' || error_type || ' ' || value)))"
_orders("pattern_keys_full_text", f"""
SELECT cluster_id, sha256(concat_ws('|', count(*), sum({_hex(_D, 1)}::HUGEINT), sum({_hex(_D, 16)}::HUGEINT),
  sum({_hex(_D, 31)}::HUGEINT), sum({_hex(_D, 46)}::HUGEINT))) AS pattern_key FROM members GROUP BY cluster_id""")
_orders("cluster_documents", """,
docs AS (
  SELECT c.cluster_uid AS id, c.size, json_object('cluster_uid', c.cluster_uid, 'runtime_cluster_id', c.cluster_id,
    'pattern_key', c.pattern_key, 'size', c.size, 'target_column', c.column_name,
    'sample_values', (SELECT list(value ORDER BY rn) FROM sampled s WHERE s.cluster_id = c.cluster_id))::VARCHAR AS document
  FROM clusters c
)
SELECT id, document, round(CAST('0x' || substr(sha256(document), 1, 2) AS INTEGER) / 255.0::DOUBLE, 6) AS v0,
  CAST(size AS VARCHAR) AS size FROM docs""")
_orders("cluster_metrics", """
SELECT 'completed' AS status, sum(size)::BIGINT AS input_anomalies, count(*) AS clusters_formed,
  round(sum(size) / count(*), 2) AS compression_ratio FROM clusters""")
_SHAPES = f"""
shaped AS (SELECT *, column_name || ' ' || error_type || ' ' || regexp_replace(value, '[0-9]', '9', 'g') AS shape FROM found),
shape_groups AS (
  SELECT shape, ord % 2 AS odd, count(*) AS size, min(column_name) AS column_name, min(ord * 100 + pos) AS first
  FROM shaped GROUP BY 1, 2
),
batches AS (
  SELECT *, row_number() OVER (PARTITION BY odd ORDER BY first) AS n, {_pattern("shape")} AS pattern_key FROM shape_groups
),
b1 AS (SELECT * FROM batches WHERE odd = 1),
b2 AS (SELECT * FROM batches WHERE odd = 0)
"""
_orders("registry_upsert", f""",{_SHAPES},
fresh AS (SELECT shape, row_number() OVER (ORDER BY n) AS r FROM b2 WHERE shape NOT IN (SELECT shape FROM b1))
SELECT coalesce(b1.pattern_key, b2.pattern_key) AS pattern_key,
  printf('family_%05d', coalesce(b1.n, f.r + (SELECT count(*) FROM b1))) AS cluster_uid,
  coalesce(b1.n, f.r + (SELECT count(*) FROM b1)) AS number,
  CASE WHEN b1.n IS NOT NULL THEN '2024-01-01' ELSE '2024-01-02' END AS first_seen,
  CASE WHEN b2.n IS NOT NULL THEN '2024-01-02' ELSE '2024-01-01' END AS last_seen,
  CAST((b1.n IS NOT NULL)::INT + (b2.n IS NOT NULL)::INT AS BIGINT) AS seen_count,
  'cluster_' || coalesce(b2.n, b1.n) AS latest_cluster_id
FROM b1 FULL OUTER JOIN b2 ON b1.shape = b2.shape LEFT JOIN fresh f ON f.shape = b2.shape""")
_orders("cache_hits", f""",{_SHAPES}
SELECT 'cluster_' || n AS cluster_id, size, column_name AS target_column, shape IN (SELECT shape FROM b1) AS cache_hit FROM b2""")
_orders("anomaly_family", """
SELECT cluster_id, column_name AS target_column, array_to_string(vals, '|') AS sample_values, family AS inferred_anomaly_type FROM profiled""")
_orders("cluster_profile", """
SELECT cluster_id, size, CAST(least(size, 5) AS INTEGER) AS sample_count, 1.0::DOUBLE AS unique_sample_ratio,
  round(1.0::DOUBLE - len(present) / len(vals), 3) AS null_ratio,
  CASE WHEN size >= 25 THEN 'high' WHEN size >= 10 OR family IN ('string_corrupt', 'date_format') THEN 'medium' ELSE 'low' END AS estimated_severity,
  is_duplicate, is_duplicate OR family IN ('date_format', 'type_cast', 'null_fill') AS is_fast_path,
  array_to_string(list_sort([error_type || '=' || least(size, 5), anomaly_hint || '=' || least(size, 5)]), '|') AS hints FROM profiled""")
CHECKS["token_jaccard"] = """
WITH d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(CASE WHEN doc_id % 13 = 1 THEN '' ELSE text END), '[a-z0-9_]+')) AS t
  FROM documents),
q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(CASE WHEN item_id % 11 IN (3, 5) THEN '' ELSE text END), '[a-z0-9_]+')) AS t
  FROM benchmark),
de AS (SELECT doc_id, unnest(t) AS w FROM d), qe AS (SELECT item_id, unnest(t) AS w FROM q),
shared AS (SELECT item_id, doc_id, count(*) AS n FROM de JOIN qe USING (w) GROUP BY ALL),
s AS (SELECT q.item_id, d.doc_id, round(coalesce(n, 0) / greatest(len(q.t) + len(d.t) - coalesce(n, 0), 1), 6) AS overlap
  FROM q CROSS JOIN d LEFT JOIN shared h ON h.item_id = q.item_id AND h.doc_id = d.doc_id)
SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY overlap DESC, doc_id) AS rank FROM s QUALIFY rank <= 3"""
_MEMORY = f""",
memory AS (
  SELECT c_custkey AS mem_ord, printf('rem_%d', c_custkey) AS memory_id,
    ['date_format','type_cast','null_fill','string_corrupt'][c_custkey * 5 % 4 + 1] AS family,
    ['order_date','customer_email','amount'][c_custkey % 3 + 1] AS target,
    ['rule','lambda','quarantine','other'][c_custkey * 3 % 4 + 1] AS transformation_type,
    round(0.6::DOUBLE + (c_custkey % 40) / 100.0::DOUBLE, 2) AS confidence_score, c_name AS reasoning,
    coalesce(k.pattern_key, 'other_' || (c_custkey * 7 % 9)) AS pattern_key
  FROM customer LEFT JOIN clusters k ON k.cluster_ord = c_custkey * 7 % 9
)
"""
_HISTORY = f"""{_MEMORY},
scored AS (
  SELECT p.cluster_id, m.memory_id, m.mem_ord, m.transformation_type, m.confidence_score, m.reasoning,
    round(0.7 * (m.pattern_key = p.pattern_key)::INT + 0.2 * (m.family = p.family)::INT
      + 0.1 * (m.target = p.column_name)::INT, 4)::DOUBLE AS score
  FROM profiled p, memory m
),
history AS (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, mem_ord) AS rank FROM scored
  WHERE score > 0 QUALIFY rank <= 5
)
"""
_orders("history_scoring", _HISTORY + "SELECT cluster_id, memory_id AS id, score AS source_weight, rank FROM history")
_REUSE = f"""{_MEMORY},
reuse_scored AS (
  SELECT p.cluster_id, m.*, (1.0 * (m.pattern_key = p.pattern_key)::INT + 0.2 * (m.family = p.family)::INT
      + 0.2 * (m.target = p.column_name)::INT) AS score
  FROM profiled p JOIN memory m ON {{keep}}
),
best AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, mem_ord) AS rank FROM reuse_scored QUALIFY rank = 1),
reused AS (SELECT * FROM best WHERE score >= 1.0 AND confidence_score >= 0.75 AND transformation_type IN ('lambda', 'rule', 'quarantine'))
"""
_orders("memory_reuse", _REUSE.format(keep="true") + """
SELECT d.cluster_id, coalesce(r.transformation_type, d.transformation_type) AS transformation_type,
  coalesce(r.confidence_score, d.confidence_score) AS confidence_score, coalesce(r.reasoning, d.reasoning) AS reasoning,
  CASE WHEN r.cluster_id IS NULL THEN d.fallback_value ELSE 'null' END AS fallback_value,
  CASE WHEN r.cluster_id IS NULL THEN d.model_used ELSE 'cache/remediation_memory' END AS model_used,
  r.cluster_id IS NOT NULL AS cache_hit,
  CASE WHEN coalesce(r.transformation_type, d.transformation_type) = 'quarantine' THEN 'quarantine'
    WHEN coalesce(r.confidence_score, d.confidence_score) < 0.85 THEN 'staging_only' ELSE 'auto_apply_with_audit' END AS guardrail_action,
  CASE WHEN coalesce(r.transformation_type, d.transformation_type) = 'quarantine' THEN 'high'
    WHEN coalesce(r.confidence_score, d.confidence_score) < 0.85 THEN 'medium' ELSE 'low' END AS risk_level
FROM decided d LEFT JOIN reused r USING (cluster_id)""")


def _vector(text: str) -> str:
    return f"list_transform(range(32), lambda i: CAST('0x' || substr(sha256({text}), CAST(i * 2 + 1 AS INTEGER), 2) AS INTEGER) / 255.0::DOUBLE)"


_ASKED = f""",
asked AS (
  SELECT *, trim(concat_ws(' ', pattern_key, column_name, family, array_to_string(vals, ' '))) AS memory_text,
    trim(concat_ws(' ', cluster_uid, cluster_id, pattern_key, family, column_name, array_to_string(vals, ' '))) AS query_text
  FROM profiled
)
"""
_orders("cluster_memory_search", _ASKED + f""",
q AS (SELECT cluster_id, {_vector("memory_text")} AS v FROM asked),
d AS (SELECT doc_id, {_vector("text")} AS v FROM documents),
s AS (SELECT cluster_id, doc_id, list_sum(list_transform(list_zip(q.v, d.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance FROM q, d)
SELECT cluster_id, 'd' || doc_id AS id, round(greatest(0.0, 1.0 - least(1.0, distance)), 4) AS source_weight,
  row_number() OVER (PARTITION BY cluster_id ORDER BY distance, doc_id) AS rank FROM s QUALIFY rank <= 5""")
_CHOSEN = _HISTORY + _ASKED + f""",
stored AS (
  SELECT c.cluster_uid AS id, c.cluster_ord AS doc_ord, json_object('cluster_uid', c.cluster_uid, 'runtime_cluster_id', c.cluster_id,
    'pattern_key', c.pattern_key, 'size', c.size, 'target_column', c.column_name,
    'sample_values', (SELECT list(value ORDER BY rn) FROM sampled s WHERE s.cluster_id = c.cluster_id))::VARCHAR AS text
  FROM clusters c
),
gaps AS (
  SELECT a.cluster_id, s.id, s.text, s.doc_ord,
    list_sum(list_transform(list_zip({_vector("a.memory_text")}, {_vector("s.text")}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS distance
  FROM asked a, stored s
),
near AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY distance, doc_ord) AS rank FROM gaps QUALIFY rank <= 5),
docs AS (
  SELECT a.cluster_id, 'rule_' || (b.item_id + 1) AS id, 'rules.txt' AS source, b.text, 0.3::DOUBLE AS w, 0 AS tier, b.item_id AS doc_ord
  FROM asked a, benchmark b
  UNION ALL SELECT cluster_id, id, 'cluster_memory', text, round(greatest(0.0, 1.0 - least(1.0, distance)), 4), 1, rank FROM near
  UNION ALL SELECT cluster_id, memory_id, 'historical_remediation_memory',
    json_object('previous_action', transformation_type, 'confidence', confidence_score, 'code', 'lambda x: x', 'reasoning', reasoning)::VARCHAR,
    score, 2, rank FROM history
),
measured AS (
  SELECT d.*, list_distinct(regexp_extract_all(lower(a.query_text), '[a-z0-9_]+')) AS qt,
    list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9_]+')) AS dt,
    list_cosine_similarity({_vector("a.query_text")}, {_vector("d.text")}) AS c,
    a.is_duplicate OR a.family IN ('date_format', 'type_cast', 'null_fill') AS fast
  FROM docs d JOIN asked a USING (cluster_id)
),
blended AS (
  SELECT *, round(0.2::DOUBLE * w + 0.3::DOUBLE * len(list_intersect(qt, dt)) / greatest(len(qt) + len(dt) - len(list_intersect(qt, dt)), 1)
    + 0.5::DOUBLE * c, 4) AS score FROM measured
),
chosen AS (
SELECT cluster_id, rank, id, source, score FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY score DESC, tier, doc_ord) AS rank FROM blended WHERE NOT fast
) WHERE rank <= 5
UNION ALL
SELECT cluster_id, rank, id, source, 0.3 FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY doc_ord) AS rank FROM measured WHERE fast AND tier = 0
) WHERE rank <= 2
)
"""
_orders("blended_retrieval", _CHOSEN + "SELECT * FROM chosen")
_orders("rule_context", _CHOSEN + """
SELECT cluster_id, string_agg(id, '|' ORDER BY rank) AS rules, string_agg(DISTINCT source, '|' ORDER BY source) AS sources,
  count(*) AS documents FROM chosen GROUP BY cluster_id""")
_orders("two_run_memory", """,
runs AS (SELECT *, run = 2 AND confidence_score >= 0.75 AS known FROM decided, (VALUES (1), (2)) AS r(run))
SELECT run, cluster_uid, transformation_type, confidence_score, CAST(run AS BIGINT) AS seen_count, known AS cache_hit,
  CASE WHEN known THEN 'cache/remediation_memory' WHEN model_used = 'none' THEN 'mock/static' ELSE model_used END AS model_used,
  (SELECT count(*) FROM decided) * run AS log_entries, (SELECT count(*) FROM decided) * (run + 1) AS stored_vectors
FROM runs""")
_orders("run_invalid_contract", """
SELECT cluster_id, CASE WHEN cluster_ord % 2 = 0 THEN 'code|size' ELSE '' END AS missing_fields,
  CASE WHEN cluster_ord % 2 = 0 THEN 'invalid_contract' WHEN transformation_type = 'quarantine' THEN 'quarantined' ELSE 'staged' END AS execution_status,
  CASE WHEN cluster_ord % 2 = 0 OR transformation_type = 'quarantine' THEN 'quarantine' ELSE transformation_type END AS transformation_type,
  CASE WHEN cluster_ord % 2 = 0 OR transformation_type = 'quarantine' THEN 0 ELSE size END AS affected_rows,
  cluster_ord % 2 = 0 OR requires_human_review AS requires_human_review
FROM decided""")
_orders("fast_path_remediation", """
SELECT cluster_id, cluster_uid, transformation_type, code, confidence_score, reasoning, fallback_value,
  family AS inferred_anomaly_type, model_used, size, guardrail_action, risk_level, requires_human_review,
  CASE WHEN transformation_type = 'quarantine' THEN 'schema_check|null_safety_check|manual_approval'
    ELSE 'schema_check|determinism_check' END AS validation_checks, column_name AS target_column FROM decided""")
_orders("static_answer_remediation", f"""
SELECT cluster_id, family AS inferred_anomaly_type,
  CASE WHEN family = 'string_corrupt' THEN 'quarantine' WHEN family = 'type_cast' THEN 'lambda' ELSE 'rule' END AS transformation_type,
  CASE family WHEN 'null_fill' THEN '{KEEP}' ELSE '{IDENTITY}' END AS code,
  CASE family WHEN 'date_format' THEN 0.82 WHEN 'null_fill' THEN 0.78 ELSE 0.0 END::DOUBLE AS confidence_score,
  CASE family WHEN 'date_format' THEN 'Detected mixed date-like values and selected a conservative rule.'
    WHEN 'null_fill' THEN 'Detected mostly null-like values and chose a null-preserving rule.'
    ELSE 'Low confidence remediation (0.40).' END AS reasoning, 'mock/static' AS model_used FROM profiled""")
_DROP = STRIP.replace(".strip()", "")
CHECKS["parse_model_responses"] = f"""
WITH t AS (SELECT conv_id, turn, CAST((conv_id * 31 + turn) % 10 AS INTEGER) AS shape FROM conversations),
r AS (
  SELECT conv_id, turn, CASE WHEN shape IN (0, 1) THEN 'lambda' WHEN shape IN (2, 7) THEN 'rule' ELSE 'quarantine' END AS transformation_type,
    CASE WHEN shape IN (0, 1) THEN '{_DROP}' ELSE '{IDENTITY}' END AS code,
    CASE WHEN shape IN (0, 1) THEN 0.95 WHEN shape IN (2, 7) THEN 0.8 WHEN shape = 8 THEN 0.99 ELSE 0.0 END::DOUBLE AS confidence_score,
    CASE shape WHEN 3 THEN 'Low confidence remediation (0.50).' WHEN 4 THEN 'Invalid transformation_type: script'
      WHEN 5 THEN 'Invalid code format: lambda expression required.' WHEN 6 THEN 'Parse error: no JSON object in response'
      WHEN 9 THEN 'Parse error: no JSON object in response' ELSE '' END AS problem FROM t
)
SELECT conv_id, turn, transformation_type, code, confidence_score, 'null' AS fallback_value, problem,
  CASE WHEN transformation_type = 'quarantine' THEN 'quarantine' WHEN confidence_score < 0.85 THEN 'staging_only' ELSE 'auto_apply_with_audit' END AS guardrail_action,
  CASE WHEN transformation_type = 'quarantine' THEN 'high' WHEN confidence_score < 0.85 THEN 'medium' ELSE 'low' END AS risk_level,
  transformation_type = 'quarantine' OR confidence_score < 0.85 AS requires_human_review FROM r"""
_orders("remediation_routing", _REUSE.format(keep="true") + """,
kinds AS (
  SELECT d.family, coalesce(r.transformation_type,
    CASE WHEN d.transformation_type <> 'quarantine' THEN d.transformation_type ELSE 'quarantine' END) AS kind,
    coalesce(r.confidence_score, d.confidence_score) AS confidence
  FROM decided d LEFT JOIN reused r USING (cluster_id)
)
SELECT 'completed' AS status, count(*) AS total, count(*) FILTER (kind <> 'quarantine') AS remediated,
  count(*) FILTER (kind = 'quarantine') AS quarantined,
  count(*) FILTER (kind = 'quarantine' OR (confidence < 0.85 AND family = 'string_corrupt')) AS requires_human_review,
  'mock' AS provider FROM kinds""")
_orders("prompt_payloads", """
SELECT cluster_id, family AS anomaly_type, vals[1] AS first_value, CAST(size AS VARCHAR) AS size,
  CASE WHEN size >= 25 THEN 'high' WHEN size >= 10 OR family IN ('string_corrupt', 'date_format') THEN 'medium' ELSE 'low' END AS severity,
  '0.75' AS confidence_threshold, pattern_key FROM profiled""")
_orders("remediation_memory_log", """
SELECT 'rem_' || day || '_' || cluster_uid AS memory_id, cluster_id, family AS inferred_anomaly_type, transformation_type,
  confidence_score, risk_level FROM decided, (VALUES ('20240101000000'), ('20240102000000')) AS t(day)""")
CHECKS["contract_check"] = """
WITH c AS (
  SELECT c_custkey AS k, c_custkey % 17 = 0 AS bad, concat_ws('|', CASE WHEN c_custkey % 5 = 0 THEN 'cluster_uid' END,
    CASE WHEN c_custkey % 13 = 0 THEN 'code' END) AS lost FROM customer
),
s AS (
  SELECT *, CASE WHEN bad OR lost <> '' THEN 'invalid_contract' WHEN k % 7 = 0 OR k % 11 = 0 THEN 'quarantined' ELSE 'staged' END AS status FROM c
)
SELECT k AS c_custkey, CASE WHEN bad THEN '<non-dict remediation>' ELSE lost END AS missing_fields,
  CASE WHEN bad THEN 'unknown' ELSE 'cluster_' || k END AS cluster_id,
  CASE WHEN bad OR k % 5 = 0 THEN 'unknown' ELSE 'uid_' || k END AS cluster_uid, status AS execution_status,
  CASE WHEN status = 'invalid_contract' OR k % 7 = 0 THEN 'quarantine' ELSE 'rule' END AS transformation_type,
  CASE WHEN status = 'invalid_contract' THEN 'high' ELSE 'low' END AS risk_level,
  status = 'invalid_contract' AS requires_human_review, status = 'staged' AS ready_for_guardrails FROM s"""
_orders("repair_expressions", r""",
each AS (SELECT id, CAST(CAST(id AS BIGINT) % 8 AS INTEGER) AS code_no, value,
    CASE WHEN value IN ('null', 'None', 'none', 'NULL', 'N/A', 'n/a', '') THEN NULL ELSE value END AS x
  FROM cells WHERE kind <> 'date'),
tested AS (
  SELECT *, CASE code_no WHEN 3 THEN x IS NULL WHEN 5 THEN x IS NULL OR NOT regexp_matches(replace(x, ',', ''), '^[0-9]+([.][0-9]+)?$')
    WHEN 6 THEN true WHEN 7 THEN x IS NULL ELSE false END AS failed FROM each
)
SELECT id, code_no, value, CASE WHEN failed THEN NULL ELSE CASE code_no
    WHEN 0 THEN x WHEN 1 THEN trim(replace(x, ',', '')) WHEN 2 THEN CASE WHEN x IS NULL THEN 'EMPTY' ELSE upper(trim(x)) END
    WHEN 3 THEN left(x, 4) || '~' || right(x, 2) WHEN 4 THEN CAST(coalesce(length(x), 0) AS VARCHAR)
    WHEN 5 THEN CAST(TRY_CAST(replace(x, ',', '') AS DOUBLE) * 2 AS VARCHAR)
    WHEN 7 THEN CASE WHEN contains(x, '@') OR x = 'a' THEN 'yes' ELSE CASE WHEN x = 'b' THEN 'True' ELSE 'False' END END END END AS transformed_value,
  failed FROM tested""")
CHECKS["repair_nodes"] = """
WITH v AS (
  SELECT c_custkey, c_custkey % 10 AS g, c_custkey % 9 AS digit, CAST(CAST(c_acctbal AS DECIMAL(18, 2)) AS VARCHAR) AS x,
    CAST(trunc(CAST(c_acctbal AS DECIMAL(18, 2))) AS BIGINT) AS n FROM customer
), r AS (
  SELECT *, CASE g WHEN 5 THEN x[1] NOT IN ('1', '2') WHEN 7 THEN n % 2 = 0 WHEN 8 THEN digit > 2 ELSE false END AS failed FROM v
)
SELECT c_custkey, x AS value, CASE WHEN failed THEN NULL ELSE CASE g WHEN 1 THEN replace(x, '.', CAST(c_custkey AS VARCHAR))
    WHEN 2 THEN CAST((n % 7 + 7) % 7 AS VARCHAR) WHEN 3 THEN CAST(greatest(length(x), digit) AS VARCHAR) WHEN 4 THEN CAST(c_custkey - abs(n) AS VARCHAR)
    WHEN 5 THEN CASE x[1] WHEN '1' THEN 'one' ELSE 'two' END WHEN 6 THEN substr(reverse(x), 2, 3) || substr(reverse(x), 2, 3)
    WHEN 7 THEN '1.0' WHEN 8 THEN ['a', 'b', 'c'][digit + 1]
    WHEN 9 THEN CASE WHEN x = '0.00' THEN NULL ELSE CAST((n - 5) * (n - 5) * (n - 5) AS VARCHAR) END END END AS transformed_value, failed FROM r"""
_orders("staged_rows", """
SELECT s.member_id, s.cluster_id, s.cluster_uid, s.column_name AS target_column, s.value AS original_value,
  s.input AS transformed_value, s.fallback_value, d.order_date AS date_before,
  CASE WHEN s.column_name = 'customer_email' THEN s.input ELSE d.customer_email END AS email_after,
  CASE WHEN s.column_name = 'order_ref' THEN s.input ELSE d.order_ref END AS ref_after, 'applied' AS apply_status
FROM staged s JOIN dirty d USING (id)""")
_orders("member_lookup", """,
last_of AS (SELECT id, column_name, value FROM found QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1),
named AS (
  SELECT CASE ord % 6 WHEN 0 THEN 'anomaly_' || anomaly_uid WHEN 1 THEN anomaly_uid WHEN 2 THEN 'row_' || id WHEN 3 THEN id
      WHEN 4 THEN 'row_' || anomaly_uid ELSE 'row_lost_' || anomaly_uid END AS member_id, *
  FROM found
)
SELECT DISTINCT n.member_id, CASE WHEN ord % 6 = 5 THEN NULL WHEN ord % 6 IN (2, 3) THEN l.column_name ELSE n.column_name END AS column_name,
  CASE WHEN ord % 6 = 5 THEN NULL WHEN ord % 6 IN (2, 3) THEN l.value ELSE n.value END AS value, ord % 6 <> 5 AS matched
FROM named n JOIN last_of l USING (id)""")
_orders("execution_plan", """
SELECT cluster_id, cluster_uid, CASE WHEN transformation_type = 'quarantine' THEN 'quarantined' ELSE 'staged' END AS execution_status,
  transformation_type <> 'quarantine' AS ready_for_guardrails, transformation_type, guardrail_action, risk_level, requires_human_review,
  CASE WHEN transformation_type = 'quarantine' THEN 0 ELSE size END AS affected_rows, size AS member_count, 0::BIGINT AS unmatched_count
FROM decided""")
_orders("execution_failures", """
SELECT cluster_id, CASE WHEN failed THEN 'execution_failed' ELSE 'staged' END AS execution_status,
  CASE WHEN failed THEN 'quarantine' ELSE 'auto_apply_with_audit' END AS guardrail_action,
  CASE WHEN failed THEN 'high' ELSE 'low' END AS risk_level, failed AS requires_human_review,
  CASE WHEN failed THEN 0 ELSE members END AS affected_rows, CASE WHEN failed THEN 0 ELSE members END AS staged_rows,
  CASE WHEN failed THEN NULL ELSE largest END AS largest_value FROM forced_plan""")
_orders("execution_summary", """
SELECT 'completed' AS status, total, total - failed AS staged, failed AS quarantined, 0::BIGINT AS invalid_contract,
  failed AS execution_failed, applied::BIGINT AS applied_rows FROM forced_totals""")
_SNAPSHOT = """,
snapshot AS (
  SELECT (SELECT count(*) FROM orders) AS input_rows, (SELECT count(*) FROM found) AS anomalies,
    (SELECT count(DISTINCT id) FROM found) AS unique_bad_rows,
    round((SELECT count(DISTINCT id) FROM found) / (SELECT count(*) FROM orders), 4) AS bad_row_ratio,
    total AS execution_total, round(failed / total, 4) AS quarantine_ratio, round(failed / total, 4) AS execution_failure_ratio
  FROM forced_totals
)
"""
_orders("risk_snapshot", _SNAPSHOT + "SELECT * FROM snapshot")
_orders("circuit_breaker", _SNAPSHOT + """,
limits AS (SELECT * FROM (VALUES ('default', 0.4, 0.15, 0.6), ('strict_rows', 0.4, 0.15, 0.1), ('open', 1.0, 1.0, 0.6),
  ('met_not_exceeded', 0.5, 0.5, 0.6)) AS t(policy, q, f, b)),
reasons AS (SELECT policy, concat_ws('|', CASE WHEN quarantine_ratio > q THEN 'quarantine_ratio_exceeded' END,
  CASE WHEN execution_failure_ratio > f THEN 'execution_failure_ratio_exceeded' END,
  CASE WHEN bad_row_ratio > b THEN 'bad_row_ratio_exceeded' END) AS reasons FROM snapshot, limits)
SELECT policy, reasons <> '' AS circuit_breaker_active, reasons FROM reasons""")
CHECKS["guardrail_decisions"] = RECORDS.replace("{high}", "true") + """
SELECT cluster_id, cluster_uid, execution_status, outcome AS guardrail_status, outcome = 'approved' AS promotion_ready,
  outcome <> 'approved' OR review AS requires_human_review, risk_level, confidence_score, affected_rows, unmatched_count,
  reason AS reasons FROM outcomes"""
CHECKS["guardrail_summary"] = RECORDS.replace("{high}", "false") + """
SELECT 'completed' AS status, count(*) AS total, count(*) FILTER (outcome = 'approved') AS approved,
  count(*) FILTER (outcome = 'review_required') AS review_required, count(*) FILTER (outcome = 'quarantined') AS quarantined,
  false AS circuit_breaker_active, '' AS circuit_breaker_reasons FROM outcomes
UNION ALL SELECT 'completed', count(*), 0, count(*), 0, true, 'bad_row_ratio_exceeded' FROM records"""
_orders("order_decisions", """
SELECT cluster_id, CASE WHEN transformation_type = 'quarantine' THEN 'quarantined' ELSE 'staged' END AS execution_status,
  'review_required' AS guardrail_status, CASE WHEN transformation_type = 'quarantine' THEN 0 ELSE size END AS affected_rows,
  'circuit_breaker_active' AS reasons FROM decided""")
CHECKS["promotion_blockers"] = RECORDS.replace("{high}", "true") + """,
counts AS (SELECT count(*) FILTER (outcome = 'approved') AS a, count(*) FILTER (outcome = 'review_required') AS r,
  count(*) FILTER (outcome = 'quarantined') AS q FROM outcomes),
cases AS (SELECT * FROM (VALUES ('default', true, true, true, true), ('no_report', true, true, true, false),
  ('quarantine_allowed', true, false, true, true), ('all_allowed', false, false, true, true),
  ('report_optional', false, true, false, false)) AS t(policy, zero_review, zero_quarantine, need_report, written)),
b AS (SELECT policy, a, r, q, concat_ws('|', CASE WHEN need_report AND NOT written THEN 'missing_phase5_guardrail_artifact' END,
  CASE WHEN zero_review AND r > 0 THEN 'guardrail_review_pending' END,
  CASE WHEN zero_quarantine AND q > 0 THEN 'guardrail_quarantine_pending' END) AS blockers FROM counts, cases)
SELECT policy, CASE WHEN blockers = '' THEN 'completed' ELSE 'blocked' END AS status, blockers, a AS approved_inputs,
  r AS review_pending, q AS quarantined_pending FROM b"""
_orders("promoted_rows", """
SELECT s.member_id, s.cluster_id, s.cluster_uid, s.column_name AS target_column, s.input AS promoted_value,
  d.amount AS amount_after, 'promoted' AS promotion_status FROM staged s JOIN dirty d USING (id)""")
_orders("promoted_clusters", """
SELECT cluster_id, cluster_uid, 'promoted' AS promotion_status, size AS affected_rows, confidence_score FROM decided
WHERE transformation_type <> 'quarantine'""")
_orders("promotion_summary", """,
n AS (SELECT count(*) AS total, count(*) FILTER (transformation_type = 'quarantine') AS q, (SELECT count(*) FROM staged) AS rows FROM decided)
SELECT 'blocked' AS status, 0::BIGINT AS approved_inputs, total AS review_pending, 0::BIGINT AS quarantined_pending,
  0::BIGINT AS promotion_candidates, 0::BIGINT AS promoted_clusters, 0::BIGINT AS promoted_rows, true AS promotion_blocked,
  'guardrail_review_pending' AS blockers FROM n
UNION ALL SELECT 'completed', total - q, 0, q, total - q, total - q, rows, false, '' FROM n""")
_orders("run_summary", """,
n AS (SELECT count(*) AS k, count(*) FILTER (transformation_type = 'quarantine') AS q, (SELECT count(*) FROM staged) AS rows,
  (SELECT count(*) FROM dirty) AS input, (SELECT count(*) FROM found) AS found, (SELECT count(DISTINCT id) FROM found) AS bad FROM decided)
SELECT t.phase, 'completed' AS status, t.metric, CAST(t.value AS VARCHAR) AS value FROM n, LATERAL (VALUES
  ('phase1', 'rows', CAST(input AS VARCHAR)), ('phase1', 'clean', CAST(input - bad AS VARCHAR)), ('phase1', 'anomalies', CAST(found AS VARCHAR)),
  ('phase2', 'anomalies', CAST(found AS VARCHAR)), ('phase2', 'clusters', CAST(k AS VARCHAR)),
  ('phase3', 'remediations', CAST(k AS VARCHAR)), ('phase3', 'quarantined', CAST(q AS VARCHAR)),
  ('phase4', 'staged', CAST(k - q AS VARCHAR)), ('phase4', 'quarantined', CAST(q AS VARCHAR)), ('phase4', 'applied_rows', CAST(rows AS VARCHAR)),
  ('phase5', 'approved', CAST(k - q AS VARCHAR)), ('phase5', 'review', '0'), ('phase5', 'circuit_breaker', 'false'),
  ('phase6', 'promoted_clusters', CAST(k - q AS VARCHAR)), ('phase6', 'promoted_rows', CAST(rows AS VARCHAR)), ('phase6', 'blocked', 'false')
) AS t(phase, metric, value)""")
CHECKS["schema_drift"] = """
SELECT 'c_custkey' AS column_name, 'bigint' AS expected_type, 'bigint' AS actual_type, 'ok' AS drift, count(c_custkey) AS filled_rows, 0::BIGINT AS unconvertible_rows FROM customer
UNION ALL SELECT 'c_name', 'bigint', 'string', 'type_mismatch', count(c_name), count(*) FILTER (c_name IS NOT NULL AND TRY_CAST(c_name AS BIGINT) IS NULL) FROM customer
UNION ALL SELECT 'c_acctbal', 'int', 'double', 'type_mismatch', count(c_acctbal), count(*) FILTER (c_acctbal IS NOT NULL AND NOT regexp_matches(CAST(c_acctbal AS VARCHAR), '^-?[0-9]+$')) FROM customer
UNION ALL SELECT 'c_mktsegment', 'string', 'string', 'ok', count(c_mktsegment), 0 FROM customer
UNION ALL SELECT 'c_nationkey', NULL, 'int', 'unexpected_column', count(c_nationkey), 0 FROM customer
UNION ALL SELECT 'c_phone', 'string', NULL, 'missing_column', 0, 0"""
CHECKS["row_hash_incremental"] = """
WITH h AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 10 = 1 THEN NULL ELSE o_orderstatus END AS o_orderstatus,
    o_orderkey % 3 <> 0 AND (o_orderkey % 10 <> 1 OR o_orderstatus IS NULL) AS done FROM orders
)
SELECT o_orderkey, o_custkey, o_orderstatus, sha256(concat_ws(chr(31), coalesce('=' || o_custkey, '-'), coalesce('=' || o_orderkey, '-'),
  coalesce('=' || o_orderstatus, '-'))) AS row_hash FROM h WHERE NOT done"""
_orders("audit_trail", """
SELECT member_id, column_name AS target_column, value AS old_value, input AS new_value, value IS DISTINCT FROM input AS changed,
  model_used, confidence_score, '2024-01-01T00:00:00' AS recorded_at FROM staged""")
_orders("recheck_after_fix", """,
again AS (SELECT cluster_id, column_name, CASE column_name WHEN 'order_ref' THEN false ELSE true END AS bad,
  column_name = 'order_ref' AND input IS NULL AS no_ref FROM staged)
SELECT cluster_id, column_name AS target_column, count(*) AS checked_rows, count(*) FILTER (NOT bad) AS passed,
  count(*) FILTER (bad) AS failed, count(*) FILTER (no_ref) AS has_ref_failed FROM again GROUP BY ALL""")
_orders("dashboard_metrics", """,
n AS (SELECT count(*) AS k, count(*) FILTER (transformation_type = 'quarantine') AS q, (SELECT count(*) FROM staged) AS rows,
  (SELECT count(*) FROM dirty) AS input, (SELECT count(*) FROM found) AS found, (SELECT count(DISTINCT id) FROM found) AS bad FROM decided)
SELECT t.metric, CAST(t.value AS DOUBLE) AS value FROM n, LATERAL (VALUES ('processed_rows', input), ('clean_rows', input - bad),
  ('bad_rows', bad), ('anomalies', found), ('remediations', k), ('staged_remediations', k - q), ('quarantined_remediations', q),
  ('applied_rows', rows), ('promoted_clusters', k - q), ('promoted_rows', rows)) AS t(metric, value)""")
CHECKS["fix_success_rate"] = """
WITH w AS (
  SELECT floor(epoch(o_orderdate) / (90 * 86400))::BIGINT AS slot, sum(o_orderkey % 7)::BIGINT AS staged,
    sum(least(o_orderkey % 7, o_custkey % 5))::BIGINT AS promoted FROM orders GROUP BY 1
)
SELECT strftime(make_timestamp(slot * 90 * 86400 * 1000000), '%Y-%m-%d') AS window_start, staged, promoted,
  CASE WHEN staged > 0 THEN round(promoted / staged, 4) ELSE 0.0 END::DOUBLE AS success_rate FROM w"""
_EVENTS = """
WITH e AS (SELECT event_id, ts, event_type, CASE event_id % 11 WHEN 0 THEN 'numeric_format_error' WHEN 1 THEN 'null_block_error' END AS error FROM events)
"""
CHECKS["stream_validate_events"] = _EVENTS + """
SELECT 'clean' AS lane, event_type AS kind, count(*) AS rows FROM e WHERE error IS NULL GROUP BY ALL
UNION ALL SELECT 'anomaly', error, count(*) FROM e WHERE error IS NOT NULL GROUP BY ALL"""
_CLOSED = "WHERE d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
CHECKS["stream_anomaly_rate"] = _EVENTS + f""",
w AS (SELECT date_trunc('day', ts) AS d, count(*) AS rows, count(error) AS bad_rows FROM e GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS window_start, rows, bad_rows, round(bad_rows / rows, 4) AS anomaly_rate FROM w {_CLOSED}"""
CHECKS["stream_window_duplicates"] = f"""
WITH w AS (SELECT date_trunc('day', ts) AS d, CAST(user_id AS VARCHAR) AS dup_key, count(*) AS n FROM events WHERE user_id IS NOT NULL
  GROUP BY ALL HAVING count(*) > 1)
SELECT strftime(d, '%Y-%m-%d') AS window_start, dup_key, n FROM w {_CLOSED}"""
CHECKS["stream_duplicate_flags"] = """
WITH e AS (
  SELECT event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE CAST(CAST(value AS DECIMAL(18, 2)) AS VARCHAR) END AS dup_key FROM events
), g AS (SELECT dup_key FROM e WHERE dup_key IS NOT NULL GROUP BY 1 HAVING count(*) > 1)
SELECT dup_key, CAST(event_id AS VARCHAR) AS row_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM e JOIN g USING (dup_key)"""
CHECKS["batch_anomaly_rate"] = _EVENTS + """
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS rows, count(error) AS bad_rows,
  round(count(error) / count(*), 4) AS anomaly_rate FROM e GROUP BY 1"""
_orders("quarantine_review", """
SELECT member_id, cluster_id, value, CASE WHEN ord % 4 < 2 THEN 'approved' WHEN ord % 4 = 2 THEN 'rejected' ELSE 'pending' END AS review_status,
  CASE ord % 4 WHEN 0 THEN value WHEN 1 THEN 'fixed-' || ord END AS reviewed_value, ord % 4 = 1 AS edited
FROM members WHERE cluster_id IN (SELECT cluster_id FROM decided WHERE transformation_type = 'quarantine')""")
_orders("replay_batch", """
SELECT member_id, cluster_id, column_name AS target_column, input AS transformed_value FROM staged WHERE ord % 5 <> 0""")
_orders("resumed_batch", """
SELECT 'one' AS batch_id, member_id, column_name AS target_column, input AS promoted_value FROM staged""")
