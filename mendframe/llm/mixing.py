"""Mix sources to target weights: entropy balancing, then rounding into copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mendframe.functions import tables
from mendframe.llm.common import packed, word_count

WEIGHTS = (5, 2, 1)  # of the sources in code-point order, repeating
MOST_COPIES = 3  # a target is at most this many times its source
BUCKETS = 4_096  # steps in which the rounding order is summed up first
TOLERANCE = 1e-12  # of a dual gradient, relative to its target
MAX_ITERATIONS = 200


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) per source of (source, size) rows.

    Sources in code-point order, NULL last, take ``weights`` in turn and share
    the total size. Where a share exceeds ``most`` times the source, it stops
    there and the excess goes to the others by weight, until none is above:
    target = least(most * size, level * weight), where the level is found by
    filling sources in the order of how soon they are full. The windows run
    over one row per source.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = F.col("source_size") * most
    by_level = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weighed = (
        sizes.withColumn("weight", weight)
        .withColumn("_total", F.sum("source_size").over(everything))
        .withColumn("_weights", F.sum("weight").over(everything))
        .withColumn("_full", F.coalesce(F.sum(full).over(before), F.lit(0)))
        .withColumn("_taken", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_taken")))
    )
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_level = F.first(F.when(F.col("_level") <= full / F.col("weight"), F.col("_level")), ignorenulls=True).over(whole)
    return weighed.withColumn("_open", open_level).select(
        "source", "source_size",
        F.least(full.cast("double"), F.coalesce(F.col("_open") * F.col("weight"), full.cast("double"))).alias("target"),
    )


def balanced_rates(mass: DataFrame, targets: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(source, source_size, target, rate): rates of least relative entropy that meet every target.

    ``mass`` has (source, size) rows. Among document rates r that satisfy, for each
    source, sum(size * r) = target, the one that minimises sum(size * (r log r - r))
    is r = exp(lambda): one multiplier per token constraint. The multipliers minimise
    the convex dual sum(size * exp(lambda)) - lambda * target, by Newton steps: each
    iteration sums gradient and curvature over all rows of ``mass``, one aggregation
    with map-side sums, and moves every source's multiplier at once. From zero the
    steps converge for every target: downwards they are shorter than one, and after
    a step upwards the rest of the way is monotone. A target of zero has rate zero.
    """
    duals = targets.select(
        _source_key().alias("key"), "source", "source_size", "target", F.lit(0.0).alias("dual"), F.lit(False).alias("done")
    )
    mass = tables.cut(
        mass.groupBy(_source_key().alias("key"), "size").agg(F.count("*").alias("rows")), "mass"
    )
    for _ in range(MAX_ITERATIONS):
        duals = tables.cut(duals, "duals")
        if duals.where(~F.col("done") & (F.col("target") > 0)).isEmpty():
            break
        taken = F.sum(F.col("size") * F.col("rows") * F.exp("dual")).alias("taken")
        sums = tables.lookup(mass, duals, ["key"], how="inner").groupBy("key", "source", "source_size", "target", "dual").agg(taken)
        gradient = F.col("taken") - F.col("target")
        step = F.when(F.col("taken") > 0, -gradient / F.col("taken")).otherwise(F.lit(0.0))
        duals = sums.select(
            "key", "source", "source_size", "target",
            F.when(F.col("target") > 0, F.col("dual") + step).otherwise(F.col("dual")).alias("dual"),
            (F.abs(gradient) <= tolerance * F.col("target")).alias("done"),
        )
    else:
        raise RuntimeError("the dual did not converge")
    return duals.select(
        "source", "source_size", "target",
        F.when(F.col("target") > 0, F.exp("dual")).otherwise(F.lit(0.0)).alias("rate"),
    )


def _draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 2**60) that depends on the id alone."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 0) -> DataFrame:
    """``docs`` plus ``_size``, ``_source_size``, ``_target`` and ``_copies``; needs doc_id, text, source.

    Every document gets the whole part of its rate in copies. What its source
    still lacks of the rounded target goes, one more copy each, to its documents
    in the order of a draw from the id, as long as their sizes fit: the taken
    words of a source miss its target by less than one document. The order is
    summed per bucket of draws first; only the bucket in which a source's rest
    runs out is looked at row by row, by groups of equal draw and size.

    NULL texts have size zero; a NULL source is one more source. Repeated rows
    (same id, size and source) get the same copies. Documents of size zero take
    part with their whole copies and, where the rest reaches them, one more.
    Reruns agree. An empty table stays empty.
    """
    sized = packed(
        docs, source=F.col("source"), size=word_count(F.col("text")), draw=_draw(F.col("doc_id"), seed), key=_source_key()
    )
    keys = tables.cut(sized.select("source", "size", "draw"), "sizes")
    targets = tables.cut(source_targets(keys, weights, most), "targets")
    rates = tables.cut(
        balanced_rates(keys, targets)
        .withColumn("whole", F.least(F.floor("rate"), F.lit(most)).cast("long"))
        .withColumn("rest", F.round("target").cast("long") - F.col("whole") * F.col("source_size"))
        .withColumn("key", _source_key()),
        "rates",
    )
    width = (1 << 60) // BUCKETS
    bucket = F.floor(F.col("draw") / width).cast("int")
    keyed = keys.withColumn("key", _source_key()).withColumn("bucket", bucket)
    steps = keyed.groupBy("key", "bucket").agg(F.sum("size").alias("size"))
    running = Window.partitionBy("key").orderBy("bucket")
    limits = steps.withColumn("upto", F.sum("size").over(running)).join(
        F.broadcast(rates.select("key", "rest")) if tables.is_small(rates) else rates.select("key", "rest"), "key"
    )
    # the first bucket whose running sum exceeds the rest; what lies before it fits
    split = tables.cut(
        limits.where(F.col("upto") > F.col("rest")).groupBy("key")
        .agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("before"), "rest"), "bucket").alias("at"))
        .select("key", "at.*"),
        "split",
    )
    inside = tables.lookup(keyed, split.select("key", F.col("bucket").alias("_b"), "before", "rest"), ["key"], how="inner")
    ties = inside.where("bucket = _b").groupBy("key", "draw", "size", "before", "rest").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("key").orderBy("draw", "size")
    fitting = (
        ties.withColumn("upto", F.col("before") + F.sum(F.col("size") * F.col("n")).over(ordered))
        .where("upto <= rest").groupBy("key").agg(F.max(F.struct("draw", "size")).alias("last"))
    )
    marks = (
        rates.select("key", "source_size", "target", "whole")
        .join(split.select("key", "bucket"), "key", "left")
        .join(fitting, "key", "left")
    )
    known = tables.lookup(sized.drop("source"), tables.cut(marks, "marks"), ["key"])
    own = F.floor(F.col("draw") / width).cast("int")
    extra = F.col("bucket").isNull() | (own < F.col("bucket")) | (
        (own == F.col("bucket")) & F.coalesce(F.struct("draw", "size") <= F.col("last"), F.lit(False))
    )
    copies = F.least(F.col("whole") + F.when(extra, 1).otherwise(0), F.lit(most))
    return known.select(
        "_in.*", F.col("size").alias("_size"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"),
        copies.cast("long").alias("_copies"),
    )


def _source_key() -> Column:
    """A source as a key that is never NULL."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))


def mix_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document under the production weights."""
    mixed = mix(docs.select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every document as often as its copies say."""
    columns = [c for c in mixed.columns if c not in ("_size", "_source_size", "_target", "_copies")]
    return mixed.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select(*columns)
