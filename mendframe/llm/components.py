"""Connected components of a link table by contraction; every round is a written table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mendframe.functions import tables


def components(links: DataFrame) -> DataFrame:
    """(node, root): one root for all nodes that links (a, b) join, directly or not.

    Each round points a node at the neighbour of smallest random rank, follows
    the pointers to their ends, and contracts the links to those ends. Every
    node that is not the smallest among its neighbours vanishes, at least half
    of them, so the rounds grow with the logarithm of the nodes whatever the
    shape of the groups; pointer chains are short because ranks are random.
    Aggregations combine map-side and joins go to a table with one row per
    node, so a group of any size is never in one task. Links of a node to
    itself and repeated links are ignored. No links: no rows.
    """
    spark = links.sparkSession
    edges = tables.cut(_clean(links.select("a", "b")), "links")
    roots: DataFrame | None = None
    level = 0
    while not edges.isEmpty():
        parents = _roots(tables.cut(_smallest_neighbour(edges, level), "parents"))
        if roots is None:
            roots = parents
        else:
            step = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            roots = tables.cut(
                tables.lookup(roots, step, ["root"], small=False).select(
                    "node", F.coalesce("_up", "root").alias("root")
                ),
                "roots",
            )
        ends = edges
        for end in ("a", "b"):
            up = parents.select(F.col("node").alias(end), F.col("root").alias(f"_{end}"))
            ends = tables.lookup(ends, up, [end], small=False)
        edges = tables.cut(_clean(ends.select(F.col("_a").alias("a"), F.col("_b").alias("b"))), "links")
        level += 1
    if roots is None:
        return spark.createDataFrame([], "node long, root long")
    return roots


def _clean(links: DataFrame) -> DataFrame:
    return (
        links.where("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _ranked(node: Column, level: int) -> Column:
    return F.struct(F.xxhash64(node, F.lit(level)).alias("rank"), node.alias("node"))


def _smallest_neighbour(edges: DataFrame, level: int) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))))
    best = both.groupBy("a").agg(F.min(_ranked(F.col("b"), level)).alias("best"))
    return best.select(
        F.col("a").alias("node"), F.least("best", _ranked(F.col("a"), level)).getField("node").alias("root")
    )


def _roots(parents: DataFrame) -> DataFrame:
    """Follow (node, root) pointers, doubling their reach, until none moves."""
    while True:
        upper = parents.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        jumped = tables.cut(
            tables.lookup(parents, upper, ["root"], small=False).select(
                "node", F.coalesce("_up", "root").alias("root"), (F.col("_up") != F.col("root")).alias("moved")
            ),
            "parents",
        )
        parents = jumped.select("node", "root")
        if jumped.where("moved").isEmpty():
            return parents
