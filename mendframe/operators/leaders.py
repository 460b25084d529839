"""Threshold clustering against fixed leaders.

A vector joins the first leader, in item order, whose cosine similarity
reaches the threshold; a vector that meets no earlier leader becomes one. Leaders
do not move while items join them, so the result does not depend on partitioning.

Undecided items are decided in rounds of two steps. One task settles a bounded
number of the earliest, which is all it takes where texts form families. Then all
others are decided side by side: an item without an earlier undecided neighbour
leads. After each step, whatever a new leader reaches is settled, too. Neighbours
are tested block against block, and a block pair gives out one row per item at most,
so neither pairs nor vectors pass through the driver. Rounds follow the longest
chain of items that each wait for an earlier one, not the number of leaders.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from mendframe import settings as S
from mendframe.functions import blocks, tables


def _first_fit(parts: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """The leaders among a bounded number of rows, item by item."""
    held = list(parts)
    if not held:
        return
    rows = pd.concat(held).sort_values("item", ignore_index=True)
    similar = blocks.cosines(rows["vector"], rows["vector"]) >= threshold
    leaders: list[int] = []
    for row in range(len(rows)):
        if not similar[row, leaders].any():
            leaders.append(row)
    yield rows.loc[leaders, ["item", "vector"]]


def _earliest(items: DataFrame, others: DataFrame, threshold: float) -> DataFrame:
    """(item, near): the earliest of ``others`` before an item that reaches the threshold; written."""

    def near(queries: pd.DataFrame, docs: pd.DataFrame) -> np.ndarray:
        similar = blocks.cosines(queries["vector"], docs["vector"]) >= threshold
        earlier = docs["doc_id"].to_numpy()[None, :] < queries["query_id"].to_numpy()[:, None]
        return (similar & earlier).astype(float)

    best = blocks.top_k(
        items.withColumnRenamed("item", "query_id"), others.withColumnRenamed("item", "doc_id"), near, 1, at_least=1.0
    )
    return tables.cut(best.select(F.col("query_id").alias("item"), F.col("doc_id").alias("near")), "near")


def leader_clusters(
    items: DataFrame, threshold: float = S.SIMILARITY_THRESHOLD, batch: int = S.LEADER_BATCH
) -> DataFrame:
    """(item, leader) of (item bigint, vector): the ``item`` value of each item's leader.

    ``item`` is unique and gives the order. ``batch`` is the number of items one
    task may hold at the end; it does not change the result. A zero or missing
    vector is near no other unless the threshold is zero or less. No items: no rows.
    """
    every = tables.cut(items.select("item", F.coalesce("vector", F.array().cast("array<double>")).alias("vector")), "items")
    found, settled, unsure = [], [], []

    def first_fit(rows: DataFrame) -> DataFrame:
        return rows.repartition(1).mapInPandas(partial(_first_fit, threshold=threshold), every.schema)

    def settle(rows: DataFrame, heads: DataFrame, earliest: bool) -> DataFrame:
        """What new leaders leave undecided. If they are the earliest rows, no later leader comes before them."""
        found.append(tables.cut(heads, "heads"))
        rest = tables.cut(tables.lookup(rows, found[-1].select("item"), ["item"], "left_anti"), "rest")
        reached = _earliest(rest, found[-1], threshold)
        settled.append(reached)
        if not earliest:
            unsure.append(tables.lookup(rest, reached.select("item"), ["item"], "left_semi"))
        return tables.cut(tables.lookup(rest, reached.select("item"), ["item"], "left_anti"), "undecided")

    undecided = every
    while undecided.count() > batch:
        undecided = settle(undecided, first_fit(undecided.orderBy("item").limit(batch)), True)
        if undecided.count() > batch:
            waiting = _earliest(undecided, undecided, threshold).select("item")
            undecided = settle(undecided, tables.lookup(undecided, waiting, ["item"], "left_anti"), False)
    leaders = tables.cut(reduce(DataFrame.unionByName, found, first_fit(undecided)), "leaders")
    # leaders of later steps may be the earlier items for these
    again = tables.cut(reduce(DataFrame.unionByName, unsure, undecided), "unsure")
    joined = reduce(DataFrame.unionByName, settled, _earliest(again, leaders, threshold))
    first = tables.cut(joined.groupBy("item").agg(F.min("near").alias("near")), "first")
    own = leaders.select("item", F.col("item").alias("_own"))
    placed = tables.lookup(tables.lookup(every.select("item"), own, ["item"]), first, ["item"])
    return placed.select("item", F.coalesce("_own", "near", "item").alias("leader"))
