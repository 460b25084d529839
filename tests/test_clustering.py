import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from inputs import SF
from mendframe.functions import blocks, tables, vectors
from mendframe.operators import clustering as C, leaders, validation as V
from mendframe.operators.leaders import leader_clusters
from mendframe.plans import samples


def sequential(matrix, threshold):
    leaders, result = [], []
    for i, row in enumerate(matrix):
        hit = next((j for j in leaders if float(row @ matrix[j]) >= threshold), None)
        if hit is None:
            leaders.append(i)
            hit = i
        result.append(hit)
    return result


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(
        F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vector")
    )


@pytest.mark.parametrize("threshold,batch", [(0.85, 512), (0.3, 16), (0.3, 200)])
def test_leaders_equal_the_sequential_rule(embeddings, threshold, batch):
    rows = sorted(embeddings.collect())
    matrix = np.array([r.vector for r in rows])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    want = sequential(matrix, threshold)
    got = {r.item: r.leader for r in leader_clusters(embeddings.repartition(5), threshold, batch).collect()}
    assert [got[r.item] for r in rows] == [rows[j].item for j in want]


def test_rounds_do_not_follow_the_leaders(spark, monkeypatch):
    """Vectors that are near nothing all lead in the first round; missing ones lead, too."""
    rows = [(i, [float(i == j) for j in range(150)]) for i in range(150)] + [(150, None), (151, [])]
    asked = []
    earliest = leaders._earliest
    monkeypatch.setattr(leaders, "_earliest", lambda *a: asked.append(1) or earliest(*a))
    items = spark.createDataFrame(rows, "item bigint, vector array<double>")
    got = leader_clusters(items, 0.85, batch=10).collect()
    assert sorted((r.item, r.leader) for r in got) == [(i, i) for i in range(152)]
    assert len(asked) == 4  # three in the only round, one for the members
    assert leader_clusters(items.limit(0)).count() == 0


def test_block_search_equals_brute_force(embeddings, monkeypatch):
    rows = sorted(embeddings.collect())
    matrix = np.array([r.vector for r in rows])
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    scores = matrix @ matrix.T
    found = blocks.top_k(
        embeddings.withColumnRenamed("item", "query_id"), embeddings.withColumnRenamed("item", "doc_id"),
        blocks.vector_scores(), 3, block_rows=90,
    ).collect()
    assert len(found) == 3 * len(rows)
    for r in found:
        want = np.sort(scores[r.query_id])[::-1][r["rank"] - 1]
        assert abs(r.score - want) < 1e-9


def test_token_scores_by_hand(spark):
    q = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "query_id bigint, tokens array<string>")
    d = spark.createDataFrame([(1, ["b", "c"]), (2, ["a", "b"]), (3, [])], "doc_id bigint, tokens array<string>")
    rows = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in blocks.top_k(q, d, blocks.token_scores(), 2, cells="tokens").collect()}
    assert rows[(1, 1)] == (2, 1.0) and rows[(1, 2)] == (1, pytest.approx(1 / 3)) and rows[(2, 1)] == (1, 0.0)


def test_hash_vector_and_cosine(spark):
    row = spark.createDataFrame([("héllo",)], "t string").select(
        vectors.hash_vector(F.col("t")).alias("v"),
        vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
    ).first()
    assert row.v == [b / 255.0 for b in hashlib.sha256("héllo".encode()).digest()] and row.zero == 0.0


def test_embedder_hook_is_normalised(spark):
    embed = vectors.embed_with(lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    row = embed(spark.createDataFrame([("abc",)], "t string"), "t").first()
    assert np.linalg.norm(row.vector) == pytest.approx(1.0)


def anomalies(spark, rows):
    return spark.createDataFrame(
        rows, "row_ord bigint, pos int, id string, anomaly_uid string, column_name string, value string, "
        "error_type string, anomaly_hint string"
    )


def test_three_errors_of_one_row_stay_apart(spark):
    rows = [(1, i, "7", f"7:{c}:e", c, "v", "e", "h") for i, c in enumerate("abc")]
    members, _ = C.assign_members(anomalies(spark, rows))
    assert {r.member_id for r in members.collect()} == {f"anomaly_7:{c}:e" for c in "abc"}
    assert {r.cluster_id for r in members.collect()} == {"cluster_1", "cluster_2", "cluster_3"}


def test_samples_skip_repeats_however_many(spark):
    rows = [(i, 0, "1", "1:c:e", "c", "same", "e", "h") for i in range(40)]
    rows += [(100 + i, 0, str(i), f"{i}:c:e", "c", f"v{i}", "e", "h") for i in range(9)]
    members, groups = C.assign_members(anomalies(spark, rows))
    for ahead in (10, 1000):
        sampled = C.sample_rows(members, ahead=ahead).first().sample_rows
        assert [r["value"] for r in sampled] == ["same", "v0", "v1", "v2", "v3"]
    assert C.build_clusters(members, groups).first().target_column == "c"


def test_pattern_key_ignores_order_and_counts_repeats(spark):
    def key(texts, **kw):
        rows = spark.createDataFrame([("c", t) for t in texts], "cluster_id string, text string").repartition(3)
        return C.pattern_keys(rows, **kw).first().pattern_key

    assert key(["a", "B ", "c"]) == key(["c", "b", "A"])
    assert key(["a", "a"]) != key(["a"])
    assert key(["a", "a"], distinct_texts=True) == key(["a"], distinct_texts=True)


def test_every_member_has_one_cluster_in_vector_mode(spark):
    found = tables.cut(V.anomalies(samples.validated_orders(spark, SF)))
    members, groups = C.assign_members(found, C.full_text(found), vectors.embed_hash)
    members = tables.cut(members)
    assert members.count() == found.count() == members.select("member_id").distinct().count()
    sizes = {r.cluster_id: r["count"] for r in members.groupBy("cluster_id").count().collect()}
    clusters = C.build_clusters(members, groups, distinct_texts=False)
    assert {r.cluster_id: r["size"] for r in clusters.collect()} == sizes
