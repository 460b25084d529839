"""Rule retrieval for clusters that need an outside answer."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mendframe import settings as S
from mendframe.functions import blocks, tables, text as tx, vectors
from mendframe.operators.remediation import best_memories


def joined_text(*parts: str) -> Column:
    """Columns and the sample values, space-joined and stripped."""
    return tx.strip(F.concat_ws(" ", *(F.coalesce(p, F.lit("")) for p in parts), F.array_join("sample_values", " ")))


def with_queries(profiled: DataFrame) -> DataFrame:
    """Add ``query_text`` (rule search) and ``memory_text`` (cluster-memory search)."""
    return profiled.withColumn(
        "query_text",
        joined_text("cluster_uid", "cluster_id", "pattern_key", "inferred_anomaly_type", "target_column"),
    ).withColumn("memory_text", joined_text("pattern_key", "target_column", "inferred_anomaly_type"))


def blended_score(weight: Column, query_tokens: Column, tokens: Column, query_vector: Column, vector: Column) -> Column:
    w = S.BLEND_WEIGHTS
    return F.round(
        w["source"] * weight + w["keyword"] * tx.jaccard(query_tokens, tokens)
        + w["vector"] * vectors.cosine(query_vector, vector),
        4,
    )


def _blended_blocks(queries: pd.DataFrame, docs: pd.DataFrame) -> np.ndarray:
    w = S.BLEND_WEIGHTS
    return (
        w["source"] * docs["source_weight"].to_numpy()[None, :]
        + w["keyword"] * blocks.token_scores()(queries, docs)
        + w["vector"] * blocks.vector_scores()(queries, docs)
    )


def static_candidates(queries: DataFrame, rules: DataFrame, k: int = S.RETRIEVAL_TOP_K) -> DataFrame:
    """Best ``k`` rule documents per query, by blocks.

    ``queries``: cluster_id, query_text. ``rules``: doc_ord, id, source, text, source_weight.
    """
    numbered = tables.cut(
        tables.ranked(
            tables.cut(queries.select("cluster_id", "query_text"), "asked"), ["cluster_id"], "query_id"
        ), "queries"
    )
    asked = vectors.embed_hash(numbered, "query_text").select(
        "query_id", "vector", tx.tokens(F.col("query_text")).alias("tokens")
    )
    offered = vectors.embed_hash(rules, "text").select(
        F.col("doc_ord").alias("doc_id"), "vector", tx.tokens(F.col("text")).alias("tokens"), "source_weight"
    )
    best = tables.cut(blocks.top_k(asked, offered, _blended_blocks, k, digits=4, cells="tokens"), "best")
    named = tables.lookup(
        best, rules.select(F.col("doc_ord").alias("doc_id"), "id", "source", "text"), ["doc_id"], "inner"
    )
    return tables.lookup(named, numbered.select("query_id", "cluster_id"), ["query_id"], "inner").select(
        "cluster_id", "id", "source", "text", "score", F.lit(0).alias("tier"), F.col("doc_id").alias("doc_ord")
    )


def cluster_memory_documents(profiled: DataFrame, memory: DataFrame, k: int = S.RETRIEVAL_TOP_K) -> DataFrame:
    """Nearest ``k`` cluster documents per query, weighted by closeness.

    ``memory``: doc_ord bigint, id, document, vector. The weight is one minus
    the squared distance, not below zero.
    """
    numbered = tables.cut(
        tables.ranked(
            tables.cut(profiled.select("cluster_id", "memory_text"), "asked"), ["cluster_id"], "query_id"
        ), "queries"
    )
    asked = vectors.embed_hash(numbered, "memory_text").select("query_id", "vector")
    offered = memory.select(F.col("doc_ord").alias("doc_id"), "vector")
    near = tables.cut(blocks.top_k(asked, offered, blocks.squared_distances(), k), "near")
    named = tables.lookup(
        near, memory.select(F.col("doc_ord").alias("doc_id"), "id", F.col("document").alias("text")),
        ["doc_id"], "inner",
    )
    distance = -F.col("score")
    return tables.lookup(named, numbered.select("query_id", "cluster_id"), ["query_id"], "inner").select(
        "cluster_id", "id", F.lit("cluster_memory").alias("source"), "text",
        F.round(F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), distance)), 4).alias("source_weight"),
        F.lit(1).alias("tier"), F.col("rank").cast("bigint").alias("doc_ord"),
    )


def historical_documents(profiled: DataFrame, memory: DataFrame, k: int = S.RETRIEVAL_TOP_K) -> DataFrame:
    """Best ``k`` earlier remediations per cluster by shared pattern, family and target."""
    best = best_memories(profiled, memory, S.HISTORY_WEIGHTS, k)
    row = F.col("memory")
    summary = F.to_json(F.struct(
        row["transformation_type"].alias("previous_action"),
        row["confidence_score"].alias("confidence"),
        row["code"].alias("code"),
        row["reasoning"].alias("reasoning"),
    ), {"ignoreNullFields": "false"})
    rank = F.row_number().over(tables.Window.partitionBy("cluster_id").orderBy(F.desc("score"), "mem_ord"))
    return best.select(
        "cluster_id", row["memory_id"].alias("id"), F.lit("historical_remediation_memory").alias("source"),
        summary.alias("text"), F.col("score").alias("source_weight"), F.lit(2).alias("tier"),
        rank.cast("bigint").alias("doc_ord"),
    )


def retrieve(
    profiled: DataFrame, rules: DataFrame, extra: list[DataFrame], k: int = S.RETRIEVAL_TOP_K
) -> DataFrame:
    """(cluster_id, rank, id, source, text, score): rule context of every cluster.

    Fast-path clusters take the first two rule documents with their weight.
    All others rank rule documents, which are reduced to the best ``k`` per
    query by blocks, together with the few documents that ``extra`` holds for
    the cluster.
    """
    asked = tables.cut(with_queries(profiled), "asked")
    slow = asked.where(~F.col("is_fast_path"))
    found = static_candidates(slow, rules, k)
    for documents in extra:
        own = tables.lookup(documents, slow.select("cluster_id", "query_text"), ["cluster_id"], "inner")
        scored = blended_score(
            F.col("source_weight"), tx.tokens(F.col("query_text")), tx.tokens(F.col("text")),
            vectors.hash_vector(F.col("query_text")), vectors.hash_vector(F.col("text")),
        )
        found = found.unionByName(
            own.withColumn("score", scored).select("cluster_id", "id", "source", "text", "score", "tier", "doc_ord")
        )
    order = tables.Window.partitionBy("cluster_id").orderBy(F.desc("score"), "tier", "doc_ord")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    ranked = ranked.select("cluster_id", "rank", "id", "source", "text", "score")
    # the first two rules are one small array on every fast-path cluster
    head = rules.orderBy("doc_ord").limit(2).agg(
        F.array_sort(F.collect_list(F.struct("doc_ord", "id", "source", "text", "source_weight"))).alias("head")
    )
    fast = (
        asked.where("is_fast_path")
        .select("cluster_id", F.lit(1).alias("_k"))
        .join(F.broadcast(head.withColumn("_k", F.lit(1))), "_k")
        .select("cluster_id", F.posexplode("head").alias("pos", "d"))
        .select("cluster_id", (F.col("pos") + 1).alias("rank"), "d.id", "d.source", "d.text",
                F.round("d.source_weight", 4).alias("score"))
    )
    return fast.unionByName(ranked)


def rule_context(retrieved: DataFrame) -> DataFrame:
    """(cluster_id, retrieved_rules, retrieval_sources, top_rule); at most k rules per cluster."""
    return retrieved.groupBy("cluster_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "id", "source", "text", "score"))),
            lambda d: F.struct(d["id"].alias("id"), d["source"].alias("source"),
                               d["text"].alias("text"), d["score"].alias("score")),
        ).alias("retrieved_rules"),
        F.array_sort(F.collect_set("source")).alias("retrieval_sources"),
        F.min_by("text", "rank").alias("top_rule"),
    )


def prompt_payloads(profiled: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(cluster_id, pattern_key, payload): one JSON document per cluster for an outside model."""
    rows = profiled
    if context is not None:
        rows = rows.join(context, "cluster_id", "left")
    else:
        kind = "array<struct<id:string,source:string,text:string,score:double>>"
        rows = rows.withColumn("retrieved_rules", F.array().cast(kind)).withColumn(
            "retrieval_sources", F.array().cast("array<string>")
        )
    payload = F.to_json(F.struct(
        "cluster_id", "cluster_uid", "sample_values",
        F.col("inferred_anomaly_type").alias("anomaly_type"),
        "size", "pattern_key", "target_column",
        F.struct(
            "sample_count", "unique_sample_ratio", "null_ratio", "hint_distribution", "estimated_severity"
        ).alias("cluster_profile"),
        F.struct(
            "retrieved_rules", F.col("pattern_key").alias("cluster_pattern_key"), "cache_hit", "target_column",
            "retrieval_sources",
        ).alias("rule_context"),
        F.struct(
            F.lit(S.CONFIDENCE_FLOOR).alias("confidence_threshold"), F.lit(True).alias("quarantine_if_ambiguous")
        ).alias("guardrails"),
    ))
    return rows.select("cluster_id", "pattern_key", payload.alias("payload"))
