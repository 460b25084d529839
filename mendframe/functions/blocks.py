"""Exact top-k matching of two tables by blocks.

Both sides are cut into hash blocks of bounded size; every (query block,
document block) pair is one cogrouped task that scores its block as one numpy
product and returns only k rows per query. The global top k is then taken per
query. No pair table is ever produced and nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mendframe import settings as S
from mendframe.functions import tables

Scorer = Callable[[pd.DataFrame, pd.DataFrame], np.ndarray]
PICKED = 16  # so many places are picked one by one; for more, rows are sorted


def vector_scores(query: str = "vector", doc: str = "vector") -> Scorer:
    """Cosine similarity of two vector columns."""

    def score(queries: pd.DataFrame, docs: pd.DataFrame) -> np.ndarray:
        return cosines(queries[query], docs[doc])

    def prepare(docs: pd.DataFrame) -> Callable[[pd.DataFrame], np.ndarray]:
        width = _width(docs[doc])
        units = _unit(docs[doc], width).T

        def against(queries: pd.DataFrame) -> np.ndarray:
            wider = _width(queries[query]) > width
            return score(queries, docs) if wider else _unit(queries[query], width) @ units

        return against

    score.prepare = prepare  # docs that meet many slices of queries become a matrix once
    return score


def token_scores(query: str = "tokens", doc: str = "tokens") -> Scorer:
    """Jaccard overlap of two token-set columns."""

    def score(queries: pd.DataFrame, docs: pd.DataFrame) -> np.ndarray:
        sizes = docs[doc].map(len).to_numpy()
        flat = np.concatenate(docs[doc].tolist()) if sizes.sum() else np.array([], dtype=object)
        postings = pd.Series(np.repeat(np.arange(len(docs)), sizes)).groupby(flat, sort=False).indices
        owners = np.repeat(np.arange(len(docs)), sizes)
        result = np.zeros((len(queries), len(docs)))
        for i, words in enumerate(queries[query]):
            found = [owners[postings[w]] for w in words if w in postings]
            if not found:
                continue
            shared = np.bincount(np.concatenate(found), minlength=len(docs))
            result[i] = shared / np.maximum(sizes + len(words) - shared, 1)
        return result

    return score


def squared_distances(query: str = "vector", doc: str = "vector") -> Scorer:
    """Negative squared Euclidean distance, so that the nearest ranks first."""

    def score(queries: pd.DataFrame, docs: pd.DataFrame) -> np.ndarray:
        a, b = np.stack(queries[query].tolist()), np.stack(docs[doc].tolist())
        gaps = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
        return -np.maximum(gaps, 0.0)

    return score


def cosines(left: pd.Series, right: pd.Series) -> np.ndarray:
    """Cosine similarity of every vector with every other; missing and zero vectors are near nothing."""
    width = max(_width(left), _width(right))
    return _unit(left, width) @ _unit(right, width).T


def _width(vectors: pd.Series) -> int:
    return max((0 if v is None else len(v) for v in vectors), default=0)


def _unit(vectors: pd.Series, width: int) -> np.ndarray:
    matrix = np.zeros((len(vectors), width))
    for row, vector in zip(matrix, vectors):
        if vector is not None and len(vector):
            row[:] = vector
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(lengths == 0, 1.0, lengths)


def first_places(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each row, highest first, of equal ones the leftmost first.

    A few places are picked one by one, which is less work than to sort the row.
    """
    if k == 1:
        return scores.argmax(axis=1)[:, None]
    if k > PICKED or k >= scores.shape[1] or not np.isfinite(scores).all():
        return np.argsort(-scores, axis=1, kind="stable")[:, :k]
    rest, rows, order = scores.copy(), np.arange(len(scores)), np.empty((len(scores), k), np.int64)
    for place in range(k):
        order[:, place] = rest.argmax(axis=1)
        rest[rows, order[:, place]] = -np.inf
    return order


def _blocks(rows: DataFrame, cells: str, block_rows: int) -> int:
    count, elements = rows.agg(F.count("*"), F.coalesce(F.sum(F.greatest(F.size(cells), F.lit(0))), F.lit(0))).first()
    return max(1, -(-count // block_rows), -(-elements // S.BLOCK_CELLS))


def top_k(
    queries: DataFrame,
    docs: DataFrame,
    score: Scorer,
    k: int,
    digits: int | None = None,
    block_rows: int = S.KNN_BLOCK_ROWS,
    cells: str = "vector",
    at_least: float | None = None,
) -> DataFrame:
    """Best ``k`` docs per query as (query_id bigint, doc_id bigint, score, rank).

    ``queries`` has ``query_id`` and ``docs`` has ``doc_id``, both bigint, plus
    what the scorer reads. Ties go to the lower doc_id. ``digits`` rounds the
    score before ranking. A block is bounded in rows and in elements of the
    array column ``cells``. Scores below ``at_least`` are no matches.
    """
    doc_blocks, query_blocks = (_blocks(side, cells, block_rows) for side in (docs, queries))
    spread_docs = docs.withColumn("_db", F.pmod(F.xxhash64("doc_id"), F.lit(doc_blocks))).withColumn(
        "_qb", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)).cast("array<bigint>"))
    )
    spread_queries = queries.withColumn(
        "_qb", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks))
    ).withColumn("_db", F.explode(F.sequence(F.lit(0), F.lit(doc_blocks - 1)).cast("array<bigint>")))

    def best(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or ds.empty:
            return pd.DataFrame({"query_id": [], "doc_id": [], "score": []})
        ds = ds.sort_values("doc_id", ignore_index=True)
        ids, parts = ds["doc_id"].to_numpy(), []
        step = max(1, 4_000_000 // len(ds))  # rows of the score matrix held at once
        against = score.prepare(ds) if hasattr(score, "prepare") else lambda some: score(some, ds)
        for start in range(0, len(qs), step):
            some = qs.iloc[start:start + step]
            scores = against(some)
            if digits is not None:
                scores = np.floor(scores * 10**digits + 0.5) / 10**digits
            order = first_places(scores, k)
            parts.append(pd.DataFrame({
                "query_id": np.repeat(some["query_id"].to_numpy(), order.shape[1]),
                "doc_id": ids[order].ravel(),
                "score": np.take_along_axis(scores, order, axis=1).ravel(),
            }))
        found = pd.concat(parts)
        return found if at_least is None else found[found["score"] >= at_least]

    local = spread_queries.groupBy("_qb", "_db").cogroup(spread_docs.groupBy("_qb", "_db")).applyInPandas(
        best, "query_id bigint, doc_id bigint, score double"
    )
    numbered = F.row_number().over(
        tables.Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    )
    return local.withColumn("rank", numbered).where(F.col("rank") <= k)


def top_k_tokens(queries: DataFrame, docs: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """Best ``k`` docs per query by Jaccard overlap of ``tokens``, as (query_id, doc_id, score, rank).

    An equi-join on the token: work follows shared tokens, not queries times docs. The
    query side is broadcast after its size was checked; otherwise a token is an ordinary
    shuffle key. Where fewer than ``k`` docs share a token, the lowest doc ids fill up with
    score 0. Missing tokens count as none; ties go to the lower doc_id.
    """
    def sized(rows: DataFrame, key: str, size: str) -> DataFrame:
        return rows.select(key, F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")).withColumn(
            size, F.size("tokens")
        )

    asked = tables.cut(sized(queries, "query_id", "n_query"), "asked")
    words = asked.select("query_id", "n_query", F.explode("tokens").alias("token"))
    words = F.broadcast(words) if tables.is_small(asked) else words
    held = sized(docs, "doc_id", "n_doc").select("doc_id", "n_doc", F.explode("tokens").alias("token"))
    shared = held.join(words, "token").groupBy("query_id", "doc_id", "n_query", "n_doc").agg(F.count("*").alias("n"))
    scored = shared.select(
        "query_id", "doc_id", F.round(F.col("n") / (F.col("n_query") + F.col("n_doc") - F.col("n")), digits).alias("score")
    )
    lowest = docs.select("doc_id").orderBy("doc_id").limit(k)  # k rows
    fill = asked.select("query_id").crossJoin(F.broadcast(lowest)).withColumn("score", F.lit(0.0))
    every = scored.unionByName(fill).groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(tables.Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))
    return every.withColumn("rank", rank).where(F.col("rank") <= k)
