"""URL filters with dated list entries: every capture against the entries active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window

from mendframe.functions import tables

ERA = 30 * 86_400  # seconds by which captures and intervals are cut for the join
FOREVER = (1 << 62) - 1
KINDS = ("domain", "host", "path")  # from general to specific

_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#]*@)?([^/?#:@]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot; NULL where there is none."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(".")), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def match_keys(url: Column) -> Column:
    """Array of (kind, key) that an entry must have to match: domains above the host, the host, path prefixes.

    A domain matches itself and what lies below; a path entry ``host/a/b`` matches
    that path and what lies below it, at whole segments.
    """
    host = host_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    paths = F.transform(
        F.when(F.size(segments) > 0, F.sequence(F.lit(1), F.size(segments))).otherwise(F.array().cast("array<int>")),
        lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i), "/")),
    )

    def typed(kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key")))

    every = F.concat(typed("domain", domains), typed("host", F.array(host)), typed("path", paths))
    return F.when(host.isNotNull(), every).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))


def validity_intervals(events: DataFrame) -> DataFrame:
    """(list, policy, kind, key, valid_from, valid_to): when each entry was on its list, in epoch seconds.

    ``events``: (list, policy, kind, key, at, action) with action ``add`` or ``remove``.
    An entry is on from an add until the next event of the same entry; of events at the
    same second an add is the last. Repeated events count once. Events without key or
    time are no events. A last add holds for ever.
    """
    entry = ("list", "policy", "kind", "key")
    states = (
        events.where("key is not null and at is not null and action in ('add', 'remove')")
        .groupBy(*entry, "at").agg(F.max((F.col("action") == "add").cast("int")).alias("on"))
    )
    following = F.lead("at").over(Window.partitionBy(*entry).orderBy("at"))
    return (
        states.withColumn("valid_to", F.coalesce(following, F.lit(FOREVER))).where("on = 1")
        .select(*entry, F.col("at").alias("valid_from"), "valid_to")
    )


def filter_captures(captures: DataFrame, events: DataFrame, era: int = ERA) -> DataFrame:
    """Verdict of each capture (page_id, url, fetched_at) under the entries active at its time.

    Gives page_id, url, host, fetched_at, n_active, blocked, and list, kind, key and
    valid_from of the entry that decides: the most specific kind, then the longest key,
    then block before allow, then the list's name. Without an active entry nothing is
    blocked and these are NULL. A capture without host or time matches nothing; repeated
    captures stay.

    The as-of join is an equi-join on (kind, key, era): an interval is listed in each era
    that it shares with the captures, so a key's entries per era are those of a month,
    and a hot host is looked up without meeting in one task. Only active matches are
    grouped by capture.
    """
    rows = tables.cut(
        captures.select(F.monotonically_increasing_id().alias("_row"), "page_id", "url", F.col("fetched_at").cast("long")),
        "captures",
    )
    first, last = rows.agg(F.min("fetched_at"), F.max("fetched_at")).first()
    first, last = first or 0, last or 0
    listed = (
        validity_intervals(events).where((F.col("valid_from") <= last) & (F.col("valid_to") > first))
        .withColumn("_era", F.explode(F.sequence(
            F.floor(F.greatest("valid_from", F.lit(first)) / era), F.floor((F.least("valid_to", F.lit(last + 1)) - 1) / era)
        )))
        .groupBy("kind", "key", "_era")
        .agg(F.sort_array(F.collect_list(F.struct("valid_from", "valid_to", "list", "policy"))).alias("entries"))
    )
    wanted = rows.where("fetched_at is not null").select(
        "_row", "fetched_at", F.floor(F.col("fetched_at") / era).alias("_era"), F.inline(match_keys(F.col("url")))
    )
    active = (
        tables.lookup(wanted, tables.cut(listed, "listed"), ["kind", "key", "_era"], how="inner")
        .select("_row", "fetched_at", "kind", "key", F.inline("entries"))
        .where("valid_from <= fetched_at and fetched_at < valid_to")
    )
    rank = F.struct(
        -F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), -F.length("key"), F.col("policy") != "block", "list",
        "policy", "valid_from",
    )
    best = active.groupBy("_row").agg(
        F.count("*").alias("n_active"),
        F.min_by(F.struct("policy", "list", "kind", "key", "valid_from"), rank).alias("best"),
    )
    return tables.lookup(rows, tables.cut(best, "active"), ["_row"]).select(
        "page_id", "url", host_of(F.col("url")).alias("host"), "fetched_at",
        F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.coalesce(F.col("best.policy") == "block", F.lit(False)).alias("blocked"),
        F.col("best.list").alias("list"), F.col("best.kind").alias("kind"), F.col("best.key").alias("key"),
        F.col("best.valid_from").alias("valid_from"),
    )
