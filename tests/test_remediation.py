import random

import pytest
from pyspark.sql import functions as F

from mendframe import settings as S
from mendframe.operators import remediation as R, retrieval


def profile(spark, values, size=4, error="e", cluster_id="cluster_1", pattern="p"):
    rows = [{"value": v, "error_type": error, "anomaly_hint": "h"} for v in values]
    table = spark.createDataFrame(
        [(cluster_id, "", rows, size, pattern, "col", False)],
        "cluster_id string, cluster_uid string, sample_rows array<map<string,string>>, size bigint, pattern_key string, "
        "target_column string, cache_hit boolean",
    )
    return R.with_profile(table)


@pytest.mark.parametrize("values,family", [
    (["07-08-2021", "2021/08/07", "August 7 2021", "07-Aug-2021"], "date_format"),
    (["ann@", "bob@@post", "homepost.org", "eve post.org"], "string_corrupt"),
    (["3,400.75", " 88.10 ", "12,34,567", "6 100"], "type_cast"),
    ([None, "NULL", "N/A", ""], "null_fill"),
    (["N/A"], "string_corrupt"),
])
def test_families(spark, values, family):
    row = profile(spark, values).first()
    assert row.inferred_anomaly_type == family and row.cluster_uid == "cluster_1"


def test_profile_numbers(spark):
    row = profile(spark, ["x", None, "x"], size=12).first()
    assert (row.sample_values, row.null_ratio, row.estimated_severity) == (["x", "None"], 0.5, "medium")
    assert row.hint_distribution == {"e": 3, "h": 3}


def test_routes(spark):
    duplicate = R.remediate(profile(spark, ["a", "b"], error="duplicate_value_error")).first()
    assert (duplicate.confidence_score, duplicate.fallback_value, duplicate.model_used) == (0.93, "a", "deterministic/duplicate_hold")
    held = R.remediate(profile(spark, ["abc"])).first()
    assert (held.transformation_type, held.risk_level, held.requires_human_review) == ("quarantine", "high", True)
    answers = spark.createDataFrame([("p", '{"transformation_type":"rule","code":"lambda x: x","confidence_score":0.8}')], "pattern_key string, raw string")
    answered = R.remediate(profile(spark, ["abc"]), responses=answers).first()
    assert (answered.guardrail_action, answered.requires_human_review) == ("staging_only", True)


def test_response_shapes(spark):
    cases = {
        '```json\n{"transformation_type":"rule","code":"lambda x: x","confidence_score":"0.9"}\n```': ("rule", 0.9),
        'say {"a":{"b":{"c":1}},"confidence_score":0.8} done }': ("rule", 0.8),
        '{"confidence_score":0.95,"code":"x"}': ("quarantine", 0.0),
        '{"confidence_score":null}': ("quarantine", 0.0),
        "[1, 2]": ("quarantine", 0.0),
        "": ("quarantine", 0.0),
        "{ broken": ("quarantine", 0.0),
        '{"confidence_score":0.9,"transformation_type":"quarantine"}': ("quarantine", 0.9),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "raw string").withColumn("model_used", F.lit("m")).withColumn("cache_hit", F.lit(False))
    for r in R.parse_responses(rows).collect():
        assert (r.parsed.transformation_type, r.parsed.confidence_score) == cases[r.raw], r.raw


@pytest.mark.parametrize("large", [False, True])
def test_memory_search_equals_brute_force(spark, large, request):
    if large:
        request.getfixturevalue("shuffled")
    random.seed(1)
    pick = lambda *options: random.choice(options)
    memory = [
        (i, f"m{i}", pick("p", "p", "q"), pick("date_format", "type_cast"), pick("a", "b", "c"), "rule", "lambda x: x", 0.9, "r")
        for i in range(300)
    ]
    names = ["mem_ord", "memory_id", "pattern_key", "inferred_anomaly_type", "target_column", "transformation_type", "code",
             "confidence_score", "reasoning"]
    table = spark.createDataFrame(memory, "mem_ord bigint, memory_id string, pattern_key string, inferred_anomaly_type string, "
                                  "target_column string, transformation_type string, code string, confidence_score double, reasoning string")
    asked = [(f"c{i}", pick("p", "z"), pick("date_format", "null_fill"), pick("a", "z")) for i in range(8)]
    clusters = spark.createDataFrame(asked, "cluster_id string, pattern_key string, inferred_anomaly_type string, target_column string")
    got = {}
    for r in R.best_memories(clusters, table, S.HISTORY_WEIGHTS, 5).collect():
        got.setdefault(r.cluster_id, []).append((r.score, r.mem_ord))
    for cluster, pattern, family, target in asked:
        want = []
        for row in memory:
            m = dict(zip(names, row))
            score = 0.7 * (m["pattern_key"] == pattern) + 0.2 * (m["inferred_anomaly_type"] == family) + 0.1 * (m["target_column"] == target)
            if score > 0:
                want.append((-round(score, 4), m["mem_ord"]))
        assert sorted((-s, o) for s, o in got.get(cluster, [])) == sorted(want)[:5]


def test_memory_search_sorts_a_bounded_number_of_rows_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(R.S, "MEMORY_ROWS", 50)
    rows = [(i, f"p{i % 3}" if i % 7 else None, "a", f"t{i % 2}") for i in range(500)]
    table = spark.createDataFrame(rows, "mem_ord bigint, pattern_key string, inferred_anomaly_type string, target_column string").coalesce(1)
    asked = spark.createDataFrame([("c0", "p0", "a", "t1"), ("c1", None, "z", "t0")], "cluster_id string, pattern_key string, inferred_anomaly_type string, target_column string")
    sorted_in, first = [], R.tables.first_per_key

    def spy(rows, *rest):
        if "combo" in rows.columns:
            sorted_in.append([r["n"] for r in rows.groupBy(R.F.spark_partition_id().alias("p")).agg(R.F.count("*").alias("n")).collect()])
        return first(rows, *rest)

    monkeypatch.setattr(R.tables, "first_per_key", spy)
    found = R.best_memories(asked, table, S.HISTORY_WEIGHTS, 3).collect()
    assert len(sorted_in[0]) > 5 and sum(sorted_in[0]) == 500 * 7 and max(sorted_in[0]) < 250 * 7
    monkeypatch.setattr(R.S, "MEMORY_ROWS", 10_000)
    whole = R.best_memories(asked, table, S.HISTORY_WEIGHTS, 3).collect()
    assert sorted((r.cluster_id, r.score, r.mem_ord) for r in found) == sorted((r.cluster_id, r.score, r.mem_ord) for r in whole)


def test_reuse_needs_the_pattern_and_a_usable_best_row(spark):
    base = "mem_ord bigint, pattern_key string, inferred_anomaly_type string, target_column string, transformation_type string, code string, confidence_score double, reasoning string"
    weak_first = [(1, "p", "date_format", "col", "rule", "lambda x: x", 0.5, "weak"), (2, "p", "x", "y", "rule", "lambda x: x", 0.9, "good")]
    asked = profile(spark, ["2024/01/02"])
    assert R.remediate(asked, memory=spark.createDataFrame(weak_first, base)).first().model_used == "deterministic/date_format"
    hit = R.remediate(asked, memory=spark.createDataFrame(weak_first[1:], base)).first()
    assert (hit.model_used, hit.cache_hit, hit.fallback_value) == ("cache/remediation_memory", True, "null")


def test_rule_context_and_prompt(spark):
    rules = spark.createDataFrame([(i, f"r_{i}", "rules.txt", t, 0.3) for i, t in enumerate(["user mail cleanup", "dates", "numbers"])],
                                  "doc_ord bigint, id string, source string, text string, source_weight double")
    fast, slow = profile(spark, ["2024/01/02"], cluster_id="f"), profile(spark, ["user mail"], cluster_id="s")
    both = fast.unionByName(slow)
    found = retrieval.retrieve(both, rules, [])
    by = {}
    for r in found.orderBy("cluster_id", "rank").collect():
        by.setdefault(r.cluster_id, []).append((r.id, r.score))
    assert by["f"] == [("r_0", 0.3), ("r_1", 0.3)] and len(by["s"]) == 3
    payload = retrieval.prompt_payloads(both, retrieval.rule_context(found)).where("cluster_id = 'f'").first().payload
    assert '"quarantine_if_ambiguous":true' in payload and '"retrieval_sources":["rules.txt"]' in payload


def test_newest_answer_counts(spark):
    def answer(code):
        return '{"transformation_type": "lambda", "confidence_score": 0.9, "code": "%s"}' % code

    rows = [("p", answer("lambda x: 'new'"), 3), ("p", answer("lambda x: 'a'"), 1), ("p", answer("lambda x: 'z'"), 2)]
    answers = spark.createDataFrame(rows, "pattern_key string, raw string, answered_at bigint")
    assert R.remediate(profile(spark, ["abc"]), responses=answers).first().code == "lambda x: 'new'"
