"""Grouping anomalies into failure families, with identity across runs.

The default text of an anomaly is its failure signature (column and error
type), for which grouping is an exact aggregation. ``embed`` switches to
vector clustering of the distinct texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from mendframe import settings as S
from mendframe.functions import tables, text as tx, vectors
from mendframe.operators.leaders import leader_clusters

Embedder = Callable[..., DataFrame]
_ROW_FIELDS = ("anomaly_hint", "anomaly_uid", "column_name", "error_type", "id", "source_phase", "value")


def order_key() -> Column:
    """Position of an anomaly in the input as one number (row, then place in the row); unknown ones come last."""
    known = (F.col("row_ord").cast("decimal(30,0)") * F.lit(65536) + F.col("pos")).cast("decimal(38,0)")
    return F.coalesce(known, F.lit("9" * 38).cast("decimal(38,0)"))


def _image_text() -> Column:
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries("source_row"))))


def full_text(found: DataFrame) -> Column:
    """``k=v`` over all sorted fields of an anomaly, row image included."""
    values = {c: F.col(c) for c in _ROW_FIELDS if c in found.columns}
    if "source_row" in found.columns:
        values["source_row"] = _image_text()
    return tx.key_value_text(values)


def signature_text(found: DataFrame) -> Column:
    """``k=v`` of the column and the error type: what failed, not where."""
    return tx.key_value_text({c: F.col(c) for c in ("column_name", "error_type") if c in found.columns})


def member_id(found: DataFrame, text: Column | None = None) -> Column:
    """Stable id of an anomaly: by uid, else by row, column and error, else by text digest."""

    def has(column: str) -> Column:
        return F.coalesce(F.col(column) != "", F.lit(False)) if column in found.columns else F.lit(False)

    def shown(column: str) -> Column:
        return F.coalesce(F.col(column), F.lit("None")) if column in found.columns else F.lit("None")

    text = full_text(found) if text is None else text
    by_digest = F.concat(F.lit("row_"), F.substring(F.sha2(text, 256), 1, 16))
    result = by_digest
    if "id" in found.columns:
        row = F.concat(F.lit("row_"), F.coalesce(F.col("id").cast("string"), F.lit("None")))
        result = F.when(
            has("column_name") | has("error_type"),
            F.concat(row, F.lit(":"), shown("column_name"), F.lit(":"), shown("error_type")),
        ).otherwise(row)
    if "anomaly_uid" in found.columns:
        result = F.when(has("anomaly_uid"), F.concat(F.lit("anomaly_"), "anomaly_uid")).otherwise(result)
    return result


def assign_members(
    found: DataFrame,
    text: Column | None = None,
    embed: Embedder | None = None,
    threshold: float = S.SIMILARITY_THRESHOLD,
) -> tuple[DataFrame, DataFrame]:
    """Anomalies with their ``cluster_id``, and the table of groups.

    A NULL text counts as empty. Equal texts are collapsed first, so only distinct texts are embedded,
    clustered and numbered. Cluster numbers follow the first anomaly.
    """
    text = signature_text(found) if text is None else text
    keyed = found.withColumn("_text", F.coalesce(text, F.lit("")))
    texts = keyed.groupBy("_text").agg(F.min(order_key()).alias("_first"), F.count("*").alias("_weight"))
    named = F.format_string("cluster_%d", "cluster_ord")
    numbered = tables.ranked(tables.cut(texts, "texts"), ["_first", "_text"], "item")
    if embed is None:
        groups = numbered.withColumn("cluster_ord", F.col("item")).withColumn("cluster_id", named)
    else:
        embedded = tables.cut(embed(numbered, "_text", "vector"), "vectors")
        leaders = tables.cut(leader_clusters(embedded, threshold), "leaders")
        led = tables.cut(tables.lookup(embedded, leaders, ["item"], "inner"), "led")
        # a leader is the earliest text of its cluster
        heads = tables.ranked(led.where("item = leader").select("leader"), ["leader"], "cluster_ord")
        heads = tables.cut(heads, "heads")
        groups = tables.cut(tables.lookup(led, heads, ["leader"], "inner").withColumn("cluster_id", named), "groups")
    members = tables.lookup(keyed, groups.select("_text", "cluster_id", "cluster_ord"), ["_text"], "inner")
    return members.withColumn("member_id", member_id(found)).withColumnRenamed("_text", "text"), groups


def centroids(groups: DataFrame) -> DataFrame:
    """(cluster_id, centroid): mean of all member vectors of each cluster."""
    return vectors.mean_vectors(groups, "cluster_id", "vector", F.col("_weight"))


def row_map(found: DataFrame) -> Column:
    """An anomaly as ``map<string,string>``, row image as JSON."""
    pairs = [x for c in _ROW_FIELDS if c in found.columns for x in (F.lit(c), F.col(c).cast("string"))]
    if "source_row" in found.columns:
        pairs += [F.lit("source_row"), _image_text()]
    return F.create_map(*pairs).cast("map<string,string>")


def _distinct_rows(members: DataFrame) -> DataFrame:
    """(cluster_id, fields, _at): equal anomalies once, at their first position."""
    fields = [c for c in _ROW_FIELDS if c in members.columns]
    image = [_image_text().alias("source_row")] if "source_row" in members.columns else []
    rows = members.select("cluster_id", order_key().alias("_at"), *fields, *image)
    return rows.groupBy(*(c for c in rows.columns if c != "_at")).agg(F.min("_at").alias("_at"))


def sample_rows(members: DataFrame, k: int = S.SAMPLE_ROWS, ahead: int = S.SAMPLE_LOOKAHEAD) -> DataFrame:
    """(cluster_id, sample_rows): first ``k`` distinct anomalies of each cluster.

    Only the first ``ahead`` positions of a cluster are compared, so the rows
    themselves are not shuffled. A cluster that repeats itself so much that
    this leaves fewer than ``k`` distinct rows is compared in full.
    """
    placed = members.withColumn("_at", order_key())
    keys = ["cluster_id", "_at"]
    heads = tables.cut(tables.first_per_key(placed.select(*keys), ["cluster_id"], ["_at"], ahead).distinct(), "heads")
    near = tables.lookup(placed, heads, keys, "left_semi").drop("_at")
    distinct = tables.cut(_distinct_rows(near), "distinct")
    full = heads.groupBy("cluster_id").count().where(F.col("count") >= ahead)
    enough = distinct.groupBy("cluster_id").count().where(F.col("count") >= k)
    short = full.join(enough, "cluster_id", "left_anti").select("cluster_id")
    if not short.isEmpty():
        short = tables.cut(short, "short")
        rest = _distinct_rows(tables.lookup(members, short, ["cluster_id"], "left_semi"))
        distinct = distinct.join(short, "cluster_id", "left_anti").unionByName(rest)
    columns = [c for c in distinct.columns if c not in keys]
    kept = tables.first_per_key(distinct, ["cluster_id"], ["_at", *columns], k)
    pairs = F.create_map(*(x for c in columns for x in (F.lit(c), F.col(c).cast("string"))))
    row = F.to_json(pairs).alias("row")  # maps have no order, so they are sorted as text
    # at most k rows per cluster are left here
    return kept.groupBy("cluster_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("_at", row))),
            lambda s: F.from_json(s["row"], "map<string,string>"),
        ).alias("sample_rows")
    )


def target_column(rows: Column) -> Column:
    """Column a group is about, taken from its first non-empty sample row."""
    first = F.filter(rows, lambda r: r.isNotNull() & (F.size(F.map_keys(r)) > 0))[0]
    keys = F.map_keys(first)
    named = F.coalesce(*(F.nullif(F.element_at(first, k), F.lit("")) for k in S.TARGET_COLUMN_KEYS))
    other = F.filter(keys, lambda k: k != "value")[0]
    fallback = F.when(F.array_contains(keys, "value") & (F.size(keys) > 1), other).otherwise(keys[0])
    return F.coalesce(named, fallback, F.lit(""))


def pattern_keys(texts: DataFrame, distinct_texts: bool = False, weight: str | None = None) -> DataFrame:
    """(cluster_id, pattern_key): order-free digest of the member texts.

    Texts are reduced to sums of SHA-256 slices, so the key costs one partial
    aggregation and no list of members. ``weight`` names a column that counts
    how often a text occurs. With ``distinct_texts`` repeats do not count, so
    that a family keeps its key from batch to batch.
    """
    digest = F.sha2(F.lower(tx.strip(F.col("text"))), 256)
    times = F.col(weight) if weight else F.lit(1)
    rows = texts.select("cluster_id", digest.alias("_d"), times.cast("decimal(18,0)").alias("_n"))
    if distinct_texts:
        rows = rows.select("cluster_id", "_d").distinct().withColumn("_n", F.lit(1).cast("decimal(18,0)"))
    sums = [
        F.sum(tx.text_number(F.substring("_d", at, 15)).cast("decimal(19,0)") * F.col("_n")).cast("string")
        for at in (1, 16, 31, 46)
    ]
    return rows.groupBy("cluster_id").agg(
        F.sha2(F.concat_ws("|", F.sum("_n").cast("string"), *sums), 256).alias("pattern_key")
    )


def build_clusters(members: DataFrame, groups: DataFrame, distinct_texts: bool = True) -> DataFrame:
    """One row per cluster: size, samples, target column and pattern key (written once).

    Sizes and keys come from the distinct texts; only the samples read members.
    """
    sizes = groups.groupBy("cluster_id", "cluster_ord").agg(F.sum("_weight").alias("size"))
    keys = pattern_keys(groups.withColumnRenamed("_text", "text"), distinct_texts, "_weight")
    clusters = sizes.join(sample_rows(members), "cluster_id").join(keys, "cluster_id")
    return tables.cut(clusters.withColumn("target_column", target_column(F.col("sample_rows"))), "clusters")


REGISTRY = "pattern_key string, cluster_uid string, number bigint, first_seen string, last_seen string, " \
    "seen_count bigint, latest_cluster_id string"


def assign_uids(
    clusters: DataFrame, registry: DataFrame | None, seen_at: str, prefix: str = "family_"
) -> tuple[DataFrame, DataFrame]:
    """Clusters with their durable uid, and the next version of the registry.

    A known pattern keeps its uid and is bumped once per cluster; new patterns
    are numbered after the highest number in use, in cluster order.
    """
    seen = clusters.groupBy("pattern_key").agg(
        F.min("cluster_ord").alias("_first"),
        F.count("*").alias("_times"),
        F.max_by("cluster_id", "cluster_ord").alias("_latest"),
    )
    if registry is None:
        fresh, highest = seen, 0
        registry = clusters.sparkSession.createDataFrame([], REGISTRY)
    else:
        fresh = seen.join(registry.select("pattern_key"), "pattern_key", "left_anti")
        highest = registry.agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]
    fresh = tables.ranked(fresh.select("pattern_key", "_first"), ["_first", "pattern_key"], "_rank")
    merged = (
        registry.join(seen, "pattern_key", "full_outer")
        .join(fresh.select("pattern_key", "_rank"), "pattern_key", "left")
        .withColumn("number", F.coalesce("number", F.col("_rank") + F.lit(highest)))
        .select(
            "pattern_key",
            F.coalesce("cluster_uid", F.format_string(f"{prefix}%05d", "number")).alias("cluster_uid"),
            "number",
            F.coalesce("first_seen", F.lit(seen_at)).alias("first_seen"),
            F.when(F.col("_times").isNotNull(), F.lit(seen_at)).otherwise(F.col("last_seen")).alias("last_seen"),
            (F.coalesce("seen_count", F.lit(0)) + F.coalesce("_times", F.lit(0))).alias("seen_count"),
            F.coalesce("_latest", "latest_cluster_id").alias("latest_cluster_id"),
        )
    )
    merged = tables.cut(merged, "registry")
    return tables.lookup(clusters, merged.select("pattern_key", "cluster_uid"), ["pattern_key"]), merged


def mark_cache_hits(clusters: DataFrame, cache: DataFrame | None) -> DataFrame:
    """Add ``cache_hit``: the pattern is in the caller's cache or came earlier in this run."""
    earlier = F.row_number().over(Window.partitionBy("pattern_key").orderBy("cluster_ord")) > 1
    if cache is None:
        return clusters.withColumn("cache_hit", earlier)
    known = cache.select("pattern_key").distinct().withColumn("_known", F.lit(True))
    return (
        clusters.join(known, "pattern_key", "left")
        .withColumn("cache_hit", F.coalesce("_known", F.lit(False)) | earlier)
        .drop("_known")
    )


def cluster_documents(clusters: DataFrame) -> DataFrame:
    """(id, document, vector) of every cluster, for later similarity search."""
    values = F.transform(
        F.filter("sample_rows", lambda r: F.map_contains_key(r, "value")),
        lambda r: F.coalesce(r["value"], F.lit("None")),
    )
    document = F.to_json(
        F.struct(
            "cluster_uid",
            F.col("cluster_id").alias("runtime_cluster_id"),
            "pattern_key",
            "size",
            "target_column",
            F.slice(values, 1, S.SAMPLE_VALUES).alias("sample_values"),
        )
    )
    return clusters.select(
        F.col("cluster_uid").alias("id"),
        document.alias("document"),
        vectors.hash_vector(document).alias("vector"),
        F.create_map(
            F.lit("pattern_key"), F.col("pattern_key"),
            F.lit("target_column"), F.col("target_column"),
            F.lit("size"), F.col("size").cast("string"),
        ).alias("metadata"),
    )


def cluster_metrics(clusters: DataFrame) -> DataFrame:
    """One row: status, anomalies, clusters and how many anomalies one cluster stands for."""
    total, count = F.coalesce(F.sum("size"), F.lit(0)), F.count("*")
    return clusters.agg(
        F.when(count == 0, F.lit("no_anomalies")).otherwise(F.lit("completed")).alias("status"),
        total.alias("input_anomalies"),
        count.alias("clusters_formed"),
        F.round(total / F.greatest(count, F.lit(1)), 2).alias("compression_ratio"),
    )
