"""Registered queries: every operator over the driver tables.

Each query takes (spark, sf_dir), reads whole tables and returns flat columns.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mendframe import settings as S
from mendframe.functions import blocks, tables, text as tx, vectors
from mendframe.functions.expressions import apply_codes
from mendframe.operators import (
    clustering,
    execution,
    guardrails,
    promotion,
    quality,
    remediation,
    retrieval,
    validation,
)
from mendframe.operators.leaders import leader_clusters
from mendframe.plans import batches, run as runs
from mendframe.plans.samples import dirty_orders, orders_spec, table, validated_orders
from mendframe.settings import ValidationSpec
from mendframe.sources import readers, sinks, state
from mendframe.streaming import duplicates, lanes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# -- shared stages -------------------------------------------------------------


def found_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.cut(validation.anomalies(validated_orders(spark, sf_dir)), "anomalies")


def order_groups(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(members, groups) of dirty orders by failure signature."""
    members, groups = clustering.assign_members(found_orders(spark, sf_dir))
    return tables.cut(members, "members"), groups


def order_clusters(members: DataFrame, groups: DataFrame) -> DataFrame:
    clusters, _ = clustering.assign_uids(clustering.build_clusters(members, groups), None, "2024-01-01")
    return tables.cut(remediation.with_profile(clustering.mark_cache_hits(clusters, None)), "profiled")


def joined(column: str) -> Column:
    return F.array_join(column, "|")


RELAXED_GUARD = {"max_quarantine_ratio": 0.6}
RELAXED_PROMOTION = {"require_zero_quarantined_items": False}


def order_run(spark: SparkSession, sf_dir: str, relaxed: bool) -> runs.RunResult:
    return runs.run(
        dirty_orders(spark, sf_dir),
        orders_spec(),
        order_by=F.col("id").cast("bigint"),
        guardrail_policy=RELAXED_GUARD if relaxed else None,
        promotion_policy=RELAXED_PROMOTION if relaxed else None,
    )


def order_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(remediations, plan, staged) of dirty orders by the deterministic rules."""
    members, groups = order_groups(spark, sf_dir)
    remediations = tables.cut(remediation.remediate(order_clusters(members, groups)), "remediations")
    plan, staged = execution.stage(remediations, members)
    return remediations, tables.cut(plan, "plan"), staged


# -- validation ----------------------------------------------------------------


@query
def null_like_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.filled_profile(dirty_orders(spark, sf_dir))


def _format_errors(column: str, check: Callable[[Column], Column]) -> Query:
    def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
        value = F.col(column)
        return dirty_orders(spark, sf_dir).where(~tx.is_missing(value) & ~check(value)).select("id", value.alias("value"))

    return errors


QUERIES["email_format_errors"] = _format_errors("customer_email", tx.is_email)
QUERIES["date_format_errors"] = _format_errors("order_date", tx.is_date_shape)
QUERIES["numeric_format_errors"] = _format_errors("amount", tx.is_number)


@query
def column_type_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of every column by declaration or name, with rows checked and failed."""
    rows, spec = dirty_orders(spark, sf_dir), orders_spec()

    def entry(column: str) -> Column:
        logical = spec.logical_type(column)
        value, valid = validation.cell_text(rows, column), validation.is_valid(rows, column, logical)
        present = ~tx.is_missing(value)
        return F.struct(
            F.lit(column).alias("column_name"),
            F.lit(logical or "any").alias("expected_type"),
            F.lit(S.type_error(logical)[0] if logical else "none").alias("error_type"),
            present.alias("present"),
            (F.lit(False) if valid is None else present & ~valid).alias("bad"),
        )

    cells = rows.select(F.inline(F.array(*map(entry, rows.columns))))
    return cells.groupBy("column_name", "expected_type", "error_type").agg(
        F.count_if("present").alias("checked"), F.count_if("bad").alias("failed")
    )


@query
def duplicate_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.duplicate_keys(dirty_orders(spark, sf_dir), ("order_ref", "customer_email"))


@query
def duplicate_flags_hot_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows flagged on columns where a few values hold most rows."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "props")
    flagged = validation.mark_duplicates(events, ("event_type", "user_id", "props"))
    return flagged.groupBy("event_type", joined("_duplicates").alias("duplicate_columns")).agg(
        F.count("*").alias("rows")
    )


@query
def row_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity from id, row_id, record_id or the row number."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(key % 4 == 0, F.concat(F.lit("C"), key)).when(key % 4 == 1, F.lit("")).alias("id"),
        F.when(key % 4 == 1, F.concat(F.lit("R"), key)).alias("row_id"),
        F.when(key % 4 == 2, F.concat(F.lit("X"), key)).alias("record_id"),
    )
    numbered = tables.with_ordinal(rows)
    return numbered.select("c_custkey", validation.row_identifier(numbered, F.col("row_ord")).alias("row_identifier"))


@query
def validate_rows_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.anomalies(validated_orders(spark, sf_dir)).select(
        "id", "pos", "anomaly_uid", "column_name", "value", "error_type", "anomaly_hint", "source_phase",
        F.col("source_row")["order_ref"].alias("source_order_ref"),
    )


@query
def clean_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.clean_rows(validated_orders(spark, sf_dir))


@query
def anomaly_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.anomaly_breakdown(
        validation.anomalies(validated_orders(spark, sf_dir)), "column_name", "error_type"
    )


@query
def ingestion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.summarize(validated_orders(spark, sf_dir), orders_spec())


@query
def ingestion_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of whole, empty, absent, unsupported and broken inputs, all made of the orders."""
    rows = dirty_orders(spark, sf_dir)
    folder = tables.scratch_path(spark, "statuses")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(f"{folder}/whole.jsonl")
    rows.select(F.substring(F.to_json(F.struct(*rows.columns)), 1, 9).alias("value")).write.text(f"{folder}/broken.jsonl")
    sources = {
        "table": rows, "lines": {"source_file": f"{folder}/whole.jsonl"}, "empty": rows.where("id IS NULL"),
        "nothing": {"input_path": ""}, "broken": {"input_path": f"{folder}/broken.jsonl"},
        "absent": {"dataset_path": f"{folder}/none.csv"}, "unsupported": {"input_path": f"{folder}/rows.xml"},
    }
    order = F.col("id").cast("bigint")
    parts = [
        validation.load(spark, source, orders_spec(), order)[1].select(
            F.lit(name).alias("input"), "status", "input_rows", "bad_rows", "anomalies", F.col("error").isNotNull().alias("failed")
        )
        for name, source in sources.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)


@query
def declared_schema_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared types beat names; flags, and a required column the table lacks."""
    spec = ValidationSpec.build({"columns": {
        "c_mktsegment": {"type": "Email"},
        "c_nationkey": {"type": "date", "unique": True},
        "c_acctbal": {"type": "string"},
        "c_name": {"required": True, "unique": True},
        "c_phone": {"required": True},
    }})
    validated = validation.validate(table(spark, sf_dir, "customer"), spec, order_by="c_custkey")
    return validation.anomaly_breakdown(validation.anomalies(validated), "column_name", "error_type")


@query
def typed_column_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers and timestamps that carry a Spark type; NaN is missing, infinity is no number."""
    key = F.col("l_orderkey")
    price = F.when(key % 97 == 0, F.lit(float("inf"))).when(key % 97 == 1, F.lit(float("nan"))).otherwise(
        F.col("l_extendedprice")
    )
    rows = table(spark, sf_dir, "lineitem").withColumn("l_extendedprice", price)
    spec = ValidationSpec.build(required_columns=["l_extendedprice", "l_shipdate"])
    validated = validation.validate(rows, spec, order_by="l_orderkey")
    return validation.anomaly_breakdown(validation.anomalies(validated), "column_name", "error_type")


# -- sources and sinks -----------------------------------------------------------


@query
def json_events_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON text cells to columns, then validation."""
    events = table(spark, sf_dir, "events")
    key = F.get_json_object("props", "$.k")
    at = F.col("event_id") % 7
    faulty = F.when(at == 0, F.concat(key, F.lit("x"))).when(at == 1, F.lit("n/a")).otherwise(key)
    lines = events.select(
        "event_id",
        F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), faulty.alias("k_total"), "event_type")).alias("doc"),
    )
    rows = readers.widen(readers.json_objects(lines, "doc").drop("pos"), ["id", "k_total", "event_type"])
    validated = validation.validate(rows, ValidationSpec.build(required_columns=["k_total"]), order_by="event_id")
    return validation.anomalies(validated).select("id", "column_name", "value", "error_type")


@query
def json_record_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays, single objects and ``records`` documents, with non-objects inside."""
    turn = F.struct("conv_id", "turn", "role")
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.to_json(turn).alias("j")
    )
    at = F.col("conv_id") % 3
    documents = turns.select(
        F.when(at == 0, F.concat(F.lit("[1,"), "j", F.lit(',"x",null]')))
        .when(at == 1, F.concat(F.lit('{"records":['), "j", F.lit(",7,"), "j", F.lit("]}")))
        .otherwise(F.col("j")).alias("doc")
    )
    rows = readers.widen(readers.json_objects(documents, "doc"), ["conv_id", "turn", "role"])
    return rows.groupBy("role", (F.col("conv_id").cast("bigint") % 3).alias("shape")).agg(F.count("*").alias("objects"))


def _breakdown_of(rows: DataFrame) -> DataFrame:
    validated = validation.validate(rows, orders_spec(), order_by=F.col("id").cast("bigint"))
    return validation.anomaly_breakdown(validation.anomalies(validated), "column_name", "error_type")


@query
def csv_source_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that went through a CSV file validate the same."""
    path = tables.scratch_path(spark, "input") + ".csv"
    dirty_orders(spark, sf_dir).write.csv(path, header=True)
    return _breakdown_of(readers.resolve_input(spark, {"input_path": path}))


@query
def csv_quoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with line breaks, quotes and commas inside quotes come back whole."""
    path = tables.scratch_path(spark, "quoted") + ".csv"
    note = F.concat(F.lit('said "'), "c_name", F.lit('",\nthen left\n'), "c_mktsegment")
    table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("string").alias("id"), note.alias("note"), F.col("c_nationkey").cast("string").alias("nation")
    ).write.csv(path, header=True, escape='"')
    return readers.resolve_input(spark, {"input_path": path, "multiline": True}).drop(S.MALFORMED)


@query
def csv_malformed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a cell too many or too few, by the number of cells that the header has."""
    path = tables.scratch_path(spark, "malformed") + ".csv"
    key = F.col("c_custkey")
    line = F.concat_ws(
        ",", key.cast("string"), F.when(key % 7 != 0, F.col("c_mktsegment")), F.col("c_nationkey").cast("string"),
        F.when(key % 10 == 3, F.lit("EXTRA")),
    )
    lines = table(spark, sf_dir, "customer").select(line.alias("id,segment,nation"))
    lines.write.csv(path, header=True, sep="\x01")  # one column, so that lines are written as they are
    return readers.flag_long_rows(spark, path).where("malformed").select("id", "malformed")


@query
def csv_ragged_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of a CSV file some of whose records have a cell too many or too few, or line breaks in a cell."""
    path = tables.scratch_path(spark, "ragged") + ".csv"
    key = F.col("c_custkey")
    segment = F.when(key % 7 != 0, F.when(key % 5 == 0, F.concat(F.lit('"two\n,""lines"" of '), "c_mktsegment", F.lit('"'))).otherwise(F.col("c_mktsegment")))
    line = F.concat_ws(
        ",", key.cast("string"), segment, F.when(key % 3 == 0, F.lit("1x")).otherwise(F.col("c_nationkey").cast("string")),
        F.when(key % 10 == 3, F.lit("EXTRA")),
    )
    table(spark, sf_dir, "customer").select(line.alias("id,segment,amount")).write.text(path + "-lines")
    # the header stands at the head of every file, as a text writer leaves it out
    lines = spark.read.text(path + "-lines", wholetext=True)
    lines.select(F.concat(F.lit("id,segment,amount\n"), "value")).write.text(path)
    spec = ValidationSpec.build({"columns": {"amount": {"type": "numeric"}}})
    validated, _ = validation.load(spark, {"input_path": path, "multiline": True}, spec, F.col("id").cast("bigint"))
    found = validation.anomalies(validated)
    return found.select("id", "pos", "column_name", "value", "error_type", F.col("source_row")["segment"].alias("segment"))


@query
def validate_aggregated_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that come out of a shuffle keep their number, are all judged, and count up without gaps."""
    rows = dirty_orders(spark, sf_dir)
    grouped = rows.groupBy("id").agg(*(F.max(c).alias(c) for c in rows.columns if c != "id"))
    judged = validation.validate(grouped, orders_spec())
    lanes_total = validation.clean_rows(judged).agg(F.count("*").alias("clean_rows"))
    found = judged.agg(
        F.count("*").alias("rows"), F.count_if("_bad").alias("bad_rows"), F.min("_row_ord").alias("first_ord"),
        F.max("_row_ord").alias("last_ord"), F.countDistinct("_row_ord").alias("ordinals"),
    )
    return found.crossJoin(F.broadcast(lanes_total))  # one row each


@query
def null_text_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies without a text form a group of their own and none is lost."""
    text = F.when(F.col("error_type") != "null_block_error", F.col("value"))
    members, groups = clustering.assign_members(found_orders(spark, sf_dir), text)
    sizes = groups.groupBy("_text").agg(F.sum("_weight").alias("size"))
    counted = members.groupBy(F.col("text").alias("_text")).agg(F.count("*").alias("members"))
    return sizes.join(counted, "_text").withColumnRenamed("_text", "text")


@query
def null_order_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies whose row has no known position keep their clusters, sizes and samples."""
    found = found_orders(spark, sf_dir).withColumn("row_ord", F.lit(None).cast("bigint"))
    clusters = clustering.build_clusters(*clustering.assign_members(found))
    return clusters.select("target_column", "size", F.size("sample_rows").alias("samples"))


@query
def jsonl_source_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines with blank and non-object lines between the rows."""
    path = tables.scratch_path(spark, "input") + ".jsonl"
    rows = dirty_orders(spark, sf_dir)
    line = F.to_json(F.struct(*rows.columns))
    rows.select(F.explode(F.array(line, F.lit("  "), F.lit("[1, 2]"), F.lit('"text"'))).alias("value")).write.text(path)
    return _breakdown_of(readers.read_rows(spark, path, rows.columns))


def anomaly_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder of anomaly files of four formats, CSV with two headers, and files that are damaged."""
    folder = tables.scratch_path(spark, "anomaly-files")
    found = found_orders(spark, sf_dir).select("row_ord", *readers.ANOMALY_FIELDS)
    line = F.to_json(F.struct(*readers.ANOMALY_FIELDS))
    fifth = [found.where(F.col("row_ord") % 5 == part) for part in range(5)]
    # a document holds the anomalies of 2000 rows
    documents = fifth[3].groupBy(F.floor(F.col("row_ord") / 2000)).agg(F.collect_list(line).alias("lines"))
    documents = documents.select(F.concat(F.lit("["), F.array_join("lines", ","), F.lit("]")).alias("value"))
    parts = {(n, suffix): f"{folder}-{n}" for n, suffix in enumerate(("parquet", "csv", "jsonl", "json", "csv", "parquet", "csv"))}
    made = dict(zip(range(7), parts.values()))
    fifth[0].drop("row_ord").write.parquet(made[0])
    fifth[1].drop("row_ord").write.csv(made[1], header=True)
    fifth[2].select(line.alias("value")).write.text(made[2])
    documents.write.option("maxRecordsPerFile", 1).text(made[3])
    fifth[4].select(*readers.ANOMALY_FIELDS[::-1]).write.csv(made[4], header=True)
    # no proper Parquet and no header, each made of rows of the table
    found.limit(3).coalesce(1).select("id").write.text(made[5])
    found.limit(1).coalesce(1).select(F.lit("").alias("value")).write.text(made[6])
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    system = hadoop.Path(folder).getFileSystem(conf)
    system.mkdirs(hadoop.Path(folder))
    for (n, suffix), source in parts.items():
        for status in system.listStatus(hadoop.Path(source)):
            name = status.getPath().getName()
            if name.startswith("part-"):
                system.rename(status.getPath(), hadoop.Path(f"{folder}/{n}-{name.rsplit('.', 1)[0]}.{suffix}"))
    return folder


@query
def anomaly_directory_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly files of four formats in one folder; damaged files are left out."""
    rows, _ = readers.read_anomaly_folder(spark, anomaly_files(spark, sf_dir))
    rows = readers.widen(rows, list(readers.ANOMALY_FIELDS))
    return rows.groupBy("column_name", "error_type").agg(F.count("*").alias("anomalies"))


@query
def anomaly_directory_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why files of the folder were left out, and how many rows came from each kind of file."""
    rows, skipped = readers.read_anomaly_folder(spark, anomaly_files(spark, sf_dir))
    suffix = F.element_at(F.split("file", r"\."), -1)
    read = rows.groupBy(suffix.alias("suffix"), F.lit("read").alias("reason")).agg(F.count("*").alias("n"))
    return read.unionByName(skipped.groupBy(suffix.alias("suffix"), "reason").agg(F.count("*").alias("n")))


@query
def artifact_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every written lane and artifact section."""
    folder = tables.scratch_path(spark, "artifacts")
    written = order_run(spark, sf_dir, relaxed=True).write(folder, "2024-01-01T00:00:00+00:00")
    sections = {
        "clean_rows": written["clean_rows"],
        "anomalies": written["anomalies"],
        "execution_plan": f"{folder}/execution/plan",
        "execution_staged_rows": f"{folder}/execution/staged_rows",
        "execution_quarantined": f"{folder}/execution/quarantined",
        "guardrail_decisions": f"{folder}/guardrails/decisions",
        "promoted_clusters": f"{folder}/promotion/clusters",
        "promoted_rows": f"{folder}/promotion/rows",
    }
    counts = [
        spark.read.parquet(path).agg(F.count("*").alias("rows")).select(F.lit(name).alias("section"), "rows")
        for name, path in sections.items()
    ]
    audit = spark.read.json(written["audit"]).select(F.lit("audit_input_rows").alias("section"), F.col("input_rows").alias("rows"))
    merged = audit
    for part in counts:
        merged = merged.unionByName(part)
    return merged


@query
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last write per id over a stored vector table and two waves of changes."""
    base = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("id"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.concat(F.lit("v0-"), "label").alias("document"),
        F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"),
        F.lit(0).alias("wave"),
    )
    key = F.col("id").cast("bigint")
    waves = base.where(key % 2 == 0).withColumn("document", F.concat(F.lit("v1-"), "id")).withColumn("wave", F.lit(1))
    waves = waves.unionByName(
        base.where(key % 3 == 0).withColumn("document", F.concat(F.lit("v2-"), "id")).withColumn("wave", F.lit(2))
    )
    fresh = waves.where("wave = 2").withColumn("id", F.concat("id", F.lit("n")))
    merged = state.upsert_vectors(base.drop("wave"), waves.unionByName(fresh), order="wave")
    return merged.select("id", "document", F.col("metadata")["label"].alias("label"), F.round(F.col("vector")[0], 4).alias("v0"))


# -- grouping ------------------------------------------------------------------------


@query
def row_text_and_member_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of an anomaly and its stable id with and without uid, column and id."""
    found = validation.anomalies(validated_orders(spark, sf_dir)).drop("source_row")
    text = clustering.full_text(found)
    bare = found.drop("anomaly_uid")
    nameless = bare.drop("column_name", "error_type")
    return found.select(
        "anomaly_uid",
        F.sha2(text, 256).alias("text_digest"),
        clustering.member_id(found).alias("member_id"),
        clustering.member_id(bare).alias("id_without_uid"),
        clustering.member_id(nameless).alias("id_without_names"),
        clustering.member_id(nameless.drop("id"), text).alias("id_by_digest"),
    )


@query
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.embed_hash(table(spark, sf_dir, "customer"), "c_name")
    return rows.select("c_custkey", F.posexplode("vector").alias("pos", "x")).select(
        "c_custkey", "pos", F.round("x", 6).alias("value")
    )


@query
def text_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Term vectors of whole documents; equal texts have equal vectors."""
    rows = vectors.embed_terms(table(spark, sf_dir, "documents"), "text")
    return rows.select(
        "doc_id",
        F.size("vector").alias("dimensions"),
        F.round(vectors.dot(F.col("vector"), F.col("vector")), 6).alias("squared_length"),
    )


@query
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four nearest vectors of every vector, itself included."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    best = blocks.top_k(
        rows.withColumnRenamed("vec_id", "query_id"), rows.withColumnRenamed("vec_id", "doc_id"),
        blocks.vector_scores(), 4, digits=4,
    )
    return best.select("query_id", "doc_id", F.round("score", 4).alias("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def cluster_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = vectors.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return means.select("label", F.posexplode("centroid").alias("pos", "x")).select(
        "label", "pos", (F.round("x", 4) + 0.0).alias("mean")  # no negative zero
    )


@query
def leader_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("vector")
    )
    return leader_clusters(rows, threshold=0.3)


@query
def vector_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of whole anomaly texts by vector similarity, with sizes and centroid length."""
    found = found_orders(spark, sf_dir)
    text = clustering.full_text(found.drop("source_row", "anomaly_uid", "id"))
    members, groups = clustering.assign_members(found, text, vectors.embed_terms)
    centroids = clustering.centroids(groups)
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"), F.countDistinct("column_name").alias("columns"))
    return sizes.join(centroids, "cluster_id").select(
        "cluster_id", "size", "columns",
        F.round(F.sqrt(vectors.dot(F.col("centroid"), F.col("centroid"))), 3).alias("centroid_length"),
    )


@query
def signature_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_clusters(*order_groups(spark, sf_dir)).select(
        "cluster_id", "cluster_uid", "size", "target_column", "pattern_key", "cache_hit",
        F.size("sample_rows").alias("samples"),
    )


@query
def sample_rows_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = clustering.sample_rows(order_groups(spark, sf_dir)[0])
    return samples.select("cluster_id", F.posexplode("sample_rows").alias("pos", "row")).select(
        "cluster_id", "pos", F.col("row")["anomaly_uid"].alias("anomaly_uid"), F.col("row")["value"].alias("value")
    )


@query
def pattern_keys_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pattern key over all member texts, repeats counted."""
    found = found_orders(spark, sf_dir)
    members, _ = clustering.assign_members(found)
    texts = members.withColumn("text", F.concat_ws(" ", "column_name", "error_type", "value"))
    return clustering.pattern_keys(texts, distinct_texts=False)


@query
def cluster_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = clustering.cluster_documents(order_clusters(*order_groups(spark, sf_dir)))
    return documents.select("id", "document", F.round(F.col("vector")[0], 6).alias("v0"), F.col("metadata")["size"].alias("size"))


@query
def cluster_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster_metrics(clustering.build_clusters(*order_groups(spark, sf_dir)))


def _shape_text() -> Column:
    return F.concat_ws(" ", "column_name", "error_type", F.regexp_replace("value", "[0-9]", "9"))


@query
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durable cluster uids over two batches that share some value shapes."""
    found = found_orders(spark, sf_dir)
    folder, registry = tables.scratch_path(spark, "registry"), None
    for day, odd in (("2024-01-01", 1), ("2024-01-02", 0)):
        batch = found.where(F.col("row_ord") % 2 == odd)
        members, groups = clustering.assign_members(batch, _shape_text())
        clusters = clustering.build_clusters(tables.cut(members, "members"), groups)
        _, registry = clustering.assign_uids(clusters, state.load_registry(spark, folder), day)
        state.save_table(registry, folder)
    return state.load_registry(spark, folder)


@query
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the second batch whose pattern the first batch had."""
    found = found_orders(spark, sf_dir)
    first, _ = clustering.assign_members(found.where("row_ord % 2 = 1"), _shape_text())
    second, groups = clustering.assign_members(found.where("row_ord % 2 = 0"), _shape_text())
    cache = clustering.pattern_keys(first, distinct_texts=True)
    clusters = clustering.build_clusters(tables.cut(second, "members"), groups)
    return clustering.mark_cache_hits(clusters, cache).select("cluster_id", "size", "target_column", "cache_hit")


# -- remediation ---------------------------------------------------------------------


@query
def anomaly_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_clusters(*order_groups(spark, sf_dir)).select(
        "cluster_id", "target_column", joined("sample_values").alias("sample_values"), "inferred_anomaly_type"
    )


@query
def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    hints = F.array_sort(F.transform(F.map_entries("hint_distribution"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return order_clusters(*order_groups(spark, sf_dir)).select(
        "cluster_id", "size", "sample_count", "unique_sample_ratio", "null_ratio", "estimated_severity",
        "is_duplicate", "is_fast_path", F.array_join(hints, "|").alias("hints"),
    )


@query
def token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents with the highest token overlap for every benchmark item; some texts are NULL or empty."""
    key = F.col("item_id")
    item = F.when(key % 11 == 3, F.lit(None)).when(key % 11 == 5, F.lit("")).otherwise(F.col("text"))
    items = table(spark, sf_dir, "benchmark").select(key.alias("query_id"), tx.tokens(item).alias("tokens"))
    text = F.when(F.col("doc_id") % 13 != 1, F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.tokens(text).alias("tokens"))
    best = blocks.top_k_tokens(items, docs, 3)
    return best.select(
        F.col("query_id").alias("item_id"), "doc_id", F.round("score", 6).alias("overlap"), F.col("rank").cast("bigint").alias("rank")
    )


def benchmark_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items in the role of rule documents."""
    return table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_ord"),
        F.concat(F.lit("rule_"), F.col("item_id") + 1).alias("id"),
        F.lit("rules.txt").alias("source"),
        "text",
        F.lit(S.STATIC_RULE_WEIGHT).alias("source_weight"),
    )


def customer_memory(spark: SparkSession, sf_dir: str, profiled: DataFrame) -> DataFrame:
    """One earlier remediation per customer; a ninth of them share each known pattern."""
    key = F.col("c_custkey")
    families = F.array(*(F.lit(f) for f in ("date_format", "type_cast", "null_fill", "string_corrupt")))
    targets = F.array(*(F.lit(t) for t in ("order_date", "customer_email", "amount")))
    kinds = F.array(*(F.lit(t) for t in ("rule", "lambda", "quarantine", "other")))
    rows = table(spark, sf_dir, "customer").select(
        key.alias("mem_ord"),
        (key * 7 % 9).alias("cluster_ord"),
        F.format_string("rem_%d", key).alias("memory_id"),
        families[(key * 5 % 4).cast("int")].alias("inferred_anomaly_type"),
        targets[(key % 3).cast("int")].alias("target_column"),
        kinds[(key * 3 % 4).cast("int")].alias("transformation_type"),
        F.lit(S.IDENTITY_CODE).alias("code"),
        F.round(F.lit(0.6) + (key % 40) / 100.0, 2).alias("confidence_score"),
        F.col("c_name").alias("reasoning"),
    )
    known = profiled.select("cluster_ord", "pattern_key")
    return (
        rows.join(known, "cluster_ord", "left")
        .withColumn("pattern_key", F.coalesce("pattern_key", F.concat(F.lit("other_"), F.col("cluster_ord"))))
        .drop("cluster_ord")
    )


@query
def history_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = order_clusters(*order_groups(spark, sf_dir))
    memory = tables.cut(customer_memory(spark, sf_dir, profiled), "memory")
    return retrieval.historical_documents(profiled, memory).select(
        "cluster_id", "id", "source_weight", F.col("doc_ord").alias("rank")
    )


@query
def memory_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = order_clusters(*order_groups(spark, sf_dir))
    memory = tables.cut(customer_memory(spark, sf_dir, profiled), "memory")
    return remediation.remediate(profiled, memory=memory).select(
        "cluster_id", "transformation_type", "confidence_score", "reasoning", "fallback_value", "model_used",
        "cache_hit", "guardrail_action", "risk_level",
    )


@query
def cluster_memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest stored documents of every cluster over whole document texts."""
    profiled = retrieval.with_queries(order_clusters(*order_groups(spark, sf_dir)))
    memory = vectors.embed_hash(
        table(spark, sf_dir, "documents").select(
            F.col("doc_id").alias("doc_ord"), F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("document")
        ), "document",
    )
    return retrieval.cluster_memory_documents(profiled, tables.cut(memory, "memory")).select(
        "cluster_id", "id", "source_weight", F.col("doc_ord").alias("rank")
    )


def retrieved_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, earlier remediations and stored clusters together."""
    profiled = order_clusters(*order_groups(spark, sf_dir))
    memory = tables.cut(customer_memory(spark, sf_dir, profiled), "memory")
    asked = retrieval.with_queries(profiled)
    stored = clustering.cluster_documents(profiled).join(profiled.select(F.col("cluster_uid").alias("id"), "cluster_ord"), "id")
    stored = tables.cut(stored.withColumnRenamed("cluster_ord", "doc_ord"), "stored")
    extra = [
        retrieval.cluster_memory_documents(asked, stored),
        retrieval.historical_documents(profiled, memory),
    ]
    extra = [tables.cut(e, "extra") for e in extra]
    return retrieval.retrieve(profiled, tables.cut(benchmark_rules(spark, sf_dir), "rules"), extra)


@query
def blended_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved_rules(spark, sf_dir).select(
        "cluster_id", F.col("rank").cast("bigint").alias("rank"), "id", "source", F.round("score", 4).alias("score")
    )


@query
def rule_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = retrieval.rule_context(retrieved_rules(spark, sf_dir))
    return context.select(
        "cluster_id", joined("retrieved_rules.id").alias("rules"), joined("retrieval_sources").alias("sources"),
        F.size("retrieved_rules").cast("bigint").alias("documents"),
    )


@query
def fast_path_remediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remediation.remediate(order_clusters(*order_groups(spark, sf_dir))).select(
        "cluster_id", "cluster_uid", "transformation_type", "code", "confidence_score", "reasoning", "fallback_value",
        "inferred_anomaly_type", "model_used", "size", "guardrail_action", "risk_level", "requires_human_review",
        joined("validation_checks").alias("validation_checks"), "target_column",
    )


@query
def static_answer_remediation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in answers parsed for every cluster, as if nothing were known."""
    profiled = order_clusters(*order_groups(spark, sf_dir))
    answers = remediation.static_answers(profiled)
    rows = profiled.select("cluster_id", "cache_hit", "pattern_key", "inferred_anomaly_type").join(answers, "pattern_key")
    return remediation.parse_responses(rows).select(
        "cluster_id", "inferred_anomaly_type", "parsed.transformation_type", "parsed.code", "parsed.confidence_score",
        "parsed.reasoning", "parsed.model_used",
    )


def raw_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw answer per conversation turn in ten shapes, most of them faulty in some way."""
    at = (F.col("conv_id") * 31 + F.col("turn")) % 10

    def answer(kind: str, code: str, confidence: Column) -> Column:
        return F.to_json(F.struct(
            F.lit(kind).alias("transformation_type"), F.lit(code).alias("code"),
            confidence.alias("confidence_score"), F.col("text").alias("reasoning"),
        ))

    good = answer("lambda", S.DROP_COMMAS_CODE, F.lit(0.95))
    raw = (
        F.when(at == 0, good)
        .when(at == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```")))
        .when(at == 2, F.lit('Sure: {"transformation_type":"rule","code":"lambda x: x","confidence_score":0.8,"meta":{"a":{}}} ok'))
        .when(at == 3, answer("rule", S.IDENTITY_CODE, F.lit(0.5)))
        .when(at == 4, answer("script", S.IDENTITY_CODE, F.lit(0.9)))
        .when(at == 5, answer("rule", "x.strip()", F.lit(0.9)))
        .when(at == 6, F.concat(F.lit("no object here "), F.translate("text", "{}", "")))
        .when(at == 7, answer("rule", S.IDENTITY_CODE, F.lit("0.8")))
        .when(at == 8, answer("quarantine", S.IDENTITY_CODE, F.lit(0.99)))
        .otherwise(F.lit('{"transformation_type":"rule","code":"lambda x: x", "confidence_score":'))
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", raw.alias("raw"), F.lit("external").alias("model_used"), F.lit(False).alias("cache_hit")
    )


@query
def parse_model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = remediation.parse_responses(raw_responses(spark, sf_dir)).select("conv_id", "turn", "parsed.*")
    plan = remediation.guardrail_plan(F.col("transformation_type"), F.col("confidence_score"), F.lit("string_corrupt"))
    return rows.select(
        "conv_id", "turn", "transformation_type", "code", "confidence_score", "fallback_value",
        F.when(F.col("confidence_score") > 0, F.lit("")).otherwise(F.col("reasoning")).alias("problem"),
        *(plan[c].alias(c) for c in ("guardrail_action", "risk_level", "requires_human_review")),
    )


@query
def remediation_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory, rule, answer and quarantine side by side, as counts."""
    profiled = order_clusters(*order_groups(spark, sf_dir))
    memory = tables.cut(customer_memory(spark, sf_dir, profiled), "memory")
    answers = remediation.static_answers(profiled)
    routed = tables.cut(remediation.remediate(profiled, memory, answers), "routed")
    return remediation.remediation_summary(routed, "mock")


@query
def prompt_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    payloads = retrieval.prompt_payloads(order_clusters(*order_groups(spark, sf_dir)))

    def part(path: str, name: str) -> Column:
        return F.get_json_object("payload", path).alias(name)

    return payloads.select(
        "cluster_id", part("$.anomaly_type", "anomaly_type"), part("$.sample_values[0]", "first_value"),
        part("$.size", "size"), part("$.cluster_profile.estimated_severity", "severity"),
        part("$.guardrails.confidence_threshold", "confidence_threshold"),
        part("$.rule_context.cluster_pattern_key", "pattern_key"),
    )


@query
def remediation_memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs appended to the log, one broken line between them, then scanned."""
    profiled = order_clusters(*order_groups(spark, sf_dir))
    decided = tables.cut(remediation.remediate(profiled), "decided")
    folder = tables.scratch_path(spark, "memory-log")
    for day in ("2024-01-01T00:00:00", "2024-01-02T00:00:00"):
        state.append_memory(remediation.memory_records(decided, day), folder)
    profiled.select(F.concat(F.lit('{"memory_id": "broken'), "cluster_id").alias("value")).write.mode("append").text(folder)
    return state.scan_memory(spark, folder).select(
        "memory_id", "cluster_id", "inferred_anomaly_type", "transformation_type", "confidence_score", "risk_level"
    )


# -- execution -----------------------------------------------------------------------


@query
def contract_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw remediation payloads per customer, some incomplete, some no object."""
    key = F.col("c_custkey")
    fields = {name: F.lit("v") for name in S.CONTRACT_FIELDS} | {
        "cluster_id": F.concat(F.lit("cluster_"), key),
        "cluster_uid": F.when(key % 5 != 0, F.concat(F.lit("uid_"), key)),
        "transformation_type": F.when(key % 7 == 0, F.lit("quarantine")).otherwise(F.lit("rule")),
        "guardrail_action": F.when(key % 11 == 0, F.lit("quarantine")).otherwise(F.lit("auto_apply_with_audit")),
        "code": F.when(key % 13 != 0, F.lit(S.IDENTITY_CODE)),
        "risk_level": F.lit("low"),
        "requires_human_review": F.lit("false"),
    }
    # a NULL field is left out of the text
    full = F.to_json(F.struct(*(v.alias(n) for n, v in fields.items())), {"ignoreNullFields": "true"})
    payload = F.when(key % 17 == 0, F.lit("[1, 2]")).otherwise(full)
    checked = execution.check_contracts(table(spark, sf_dir, "customer").select("c_custkey", payload.alias("payload")))
    return checked.select(
        "c_custkey", joined("missing_fields").alias("missing_fields"), "cluster_id", "cluster_uid", "execution_status",
        "transformation_type", "risk_level", "requires_human_review", "ready_for_guardrails",
    )


# codes by position; the fixed result of each is written out in the check
REPAIR_CODES = (
    S.IDENTITY_CODE,
    S.STRIP_COMMAS_CODE,
    "lambda x: x.strip().upper() if x else 'EMPTY'",
    "lambda x: x[:4] + '~' + x[-2:]",
    "lambda x: len(x) if x is not None else 0",
    "lambda x: float(x.replace(',', '')) * 2",
    "lambda x: __import__('os')",
    "lambda x: 'yes' if '@' in x or x in ('a', None) else str(x == 'b')",
)


@query
def repair_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight repairs over all amounts and emails; each row uses one of them."""
    rows = dirty_orders(spark, sf_dir)
    key = F.col("id").cast("bigint")
    codes = F.array(*(F.lit(c) for c in REPAIR_CODES))
    cells = rows.select(
        "id", F.explode(F.array("amount", "customer_email")).alias("value"), (key % 8).cast("int").alias("code_no")
    ).withColumn("code", codes[F.col("code_no")])
    counted = cells.groupBy("code").agg(F.count("*").alias("size"))
    applied, _ = apply_codes(cells, counted)
    return applied.select(
        "id", "code_no", "value", "transformed_value", F.col("error").isNotNull().alias("failed")
    )


@query
def repair_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arithmetic, calls, subscripts, NaN and infinity over all balances; every customer has a code of its own in some groups."""
    key = F.col("c_custkey").cast("string")
    digit = (F.col("c_custkey") % 9).cast("string")
    codes = (
        F.lit("lambda x: float('nan') if '-' in x else float('inf')"),
        F.concat(F.lit("lambda x: x.replace('.', '"), key, F.lit("')")),
        F.lit("lambda x: int(float(x)) % 7"),
        F.concat(F.lit("lambda x: max(len(x), "), digit, F.lit(")")),
        F.concat(F.lit("lambda x: -abs(int(float(x))) + "), key),
        F.lit("lambda x: {'1': 'one', '2': 'two'}[x[0]]"),
        F.lit("lambda x: x[::-1][1:4] * 2"),
        F.lit("lambda x: 1 / (int(float(x)) % 2)"),
        F.concat(F.lit("lambda x: ['a', 'b', 'c']["), digit, F.lit("]")),
        F.lit("lambda x: (int(float(x)) - 5) ** 3 if x not in ('0.00', None) else None"),
    )
    cells = table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_acctbal").cast("decimal(18,2)").cast("string").alias("value"),
        F.get(F.array(*codes), (F.col("c_custkey") % len(codes)).cast("int")).alias("code"),
    )
    applied, _ = apply_codes(cells, cells.select("code", F.lit(1).alias("size")))
    return applied.select("c_custkey", "value", "transformed_value", F.col("error").isNotNull().alias("failed"))


@query
def staged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, staged = order_plan(spark, sf_dir)
    return staged.select(
        "member_id", "cluster_id", "cluster_uid", "target_column", "original_value", "transformed_value",
        "fallback_value", F.col("source_row_before")["order_date"].alias("date_before"),
        F.col("source_row_after")["customer_email"].alias("email_after"),
        F.col("source_row_after")["order_ref"].alias("ref_after"), "apply_status",
    )


@query
def member_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members named by uid, by bare uid, by row, by number, and by an unknown name."""
    found = found_orders(spark, sf_dir)
    at = F.col("row_ord") % 6
    members = found.select(
        F.lit("c").alias("cluster_id"),
        F.when(at == 0, F.concat(F.lit("anomaly_"), "anomaly_uid"))
        .when(at == 1, F.col("anomaly_uid"))
        .when(at == 2, F.concat(F.lit("row_"), "id"))
        .when(at == 3, F.col("id"))
        .when(at == 4, F.concat(F.lit("row_"), "anomaly_uid"))
        .otherwise(F.concat(F.lit("row_lost_"), "anomaly_uid")).alias("member_id"),
    ).distinct()
    matched, unmatched = execution.match_members(members, found)
    return matched.select("member_id", "column_name", "value", F.lit(True).alias("matched")).unionByName(
        unmatched.select(
            "member_id", F.lit(None).cast("string").alias("column_name"), F.lit(None).cast("string").alias("value"),
            F.lit(False).alias("matched"),
        )
    )


@query
def execution_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, plan, _ = order_plan(spark, sf_dir)
    return plan.select(
        "cluster_id", "cluster_uid", "execution_status", "ready_for_guardrails", "transformation_type",
        "guardrail_action", "risk_level", "requires_human_review", "affected_rows", "member_count", "unmatched_count",
    )


def failing_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Dirty orders with given codes: some refused, some failing on a row, some fine."""
    members, groups = order_groups(spark, sf_dir)
    decided = remediation.remediate(order_clusters(members, groups))
    codes = {
        1: "lambda x: float(x.replace(',', ''))",  # fails on some rows
        2: "lambda x: x.lower()",  # never NULL here
        3: "lambda x: __import__('os')",  # refused
        4: "lambda x: x[-3:]",
        5: "lambda x: x.strip()",  # every value is missing
        6: "lambda x: 'none' if x is None else x",
    }
    code, kind = F.col("code"), F.lit("lambda")
    for number, text in codes.items():
        code = F.when(F.col("cluster_ord") == number, F.lit(text)).otherwise(code)
    open_plan = decided.withColumn("code", code).withColumn("transformation_type", kind).withColumn(
        "guardrail_action", F.lit("auto_apply_with_audit")
    ).withColumn("risk_level", F.lit("low")).withColumn("requires_human_review", F.lit(False)).withColumn(
        "confidence_score", F.lit(0.95)
    )
    plan, staged = execution.stage(open_plan, members)
    return members, tables.cut(plan, "plan"), staged


@query
def execution_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-or-nothing per cluster: a refused code or one failing row stages nothing."""
    _, plan, staged = failing_plan(spark, sf_dir)
    shown = staged.groupBy("cluster_id").agg(
        F.count("*").alias("staged_rows"), F.max("transformed_value").alias("largest_value")
    )
    return plan.join(shown, "cluster_id", "left").select(
        "cluster_id", "execution_status", "guardrail_action", "risk_level", "requires_human_review", "affected_rows",
        F.coalesce("staged_rows", F.lit(0)).alias("staged_rows"), "largest_value",
    )


@query
def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, plan, _ = failing_plan(spark, sf_dir)
    return execution.execution_summary(plan)


# -- guardrails and promotion ------------------------------------------------------------


def order_snapshot(spark: SparkSession, sf_dir: str, found: DataFrame, plan: DataFrame) -> DataFrame:
    summary = validation.summarize_found(table(spark, sf_dir, "orders"), found, orders_spec())
    return guardrails.risk_snapshot(summary, found, execution.execution_summary(plan))


@query
def risk_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, plan, _ = failing_plan(spark, sf_dir)
    return order_snapshot(spark, sf_dir, members, plan)


@query
def circuit_breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker under four policies."""
    members, plan, _ = failing_plan(spark, sf_dir)
    snapshot = tables.one_row(order_snapshot(spark, sf_dir, members, plan))
    policies = {
        "default": {},
        "strict_rows": {"max_bad_row_ratio": 0.1},
        "open": {"max_quarantine_ratio": 1.0, "max_execution_failure_ratio": 1.0},
        "met_not_exceeded": {"max_quarantine_ratio": 0.5, "max_execution_failure_ratio": 0.5},
    }
    result = None
    for name, policy in policies.items():
        part = guardrails.circuit_breaker(snapshot, policy).select(
            F.lit(name).alias("policy"), "circuit_breaker_active", joined("circuit_breaker_reasons").alias("reasons")
        )
        result = part if result is None else result.unionByName(part)
    return result


def varied_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An execution record per customer that runs through every decision rule."""
    key = F.col("c_custkey")
    statuses = F.array(*(F.lit(s) for s in ("staged", "staged", "staged", "staged", "staged", "quarantined",
                                            "execution_failed", "invalid_contract", "paused")))
    return table(spark, sf_dir, "customer").select(
        F.format_string("cluster_%d", key).alias("cluster_id"),
        F.format_string("family_%05d", key).alias("cluster_uid"),
        statuses[(key % 9).cast("int")].alias("execution_status"),
        F.round(F.lit(0.7) + (key % 30) / 100.0, 2).alias("confidence_score"),
        F.when(key % 8 == 0, F.lit("HIGH")).when(key % 8 == 1, F.lit(None)).otherwise(F.lit("low")).alias("risk_level"),
        (key % 6 == 0).alias("requires_human_review"),
        F.when(key % 10 != 0, key % 10).alias("affected_rows"),
        (key % 10 + key % 4).alias("member_count"),
        (key % 4).alias("unmatched_count"),
        F.lit("auto_apply_with_audit").alias("guardrail_action"),
    )


@query
def guardrail_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guardrails.decide(varied_records(spark, sf_dir), False).select(
        "cluster_id", "cluster_uid", "execution_status", "guardrail_status", "promotion_ready", "requires_human_review",
        "risk_level", "confidence_score", "affected_rows", "unmatched_count", joined("reasons").alias("reasons"),
    )


@query
def guardrail_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes with the breaker off and on."""
    records = varied_records(spark, sf_dir)
    off = guardrails.guardrail_summary(guardrails.decide(records, False, {"block_high_risk": False}), False, [])
    on = guardrails.guardrail_summary(guardrails.decide(records, True), True, ["bad_row_ratio_exceeded"])
    return off.unionByName(on)


@query
def order_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on dirty orders by default policy: the breaker sends all to review."""
    return order_run(spark, sf_dir, relaxed=False).decisions.select(
        "cluster_id", "execution_status", "guardrail_status", "affected_rows", joined("reasons").alias("reasons")
    )


@query
def promotion_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blockers of one batch under several policies."""
    summary = tables.cut(
        guardrails.guardrail_summary(guardrails.decide(varied_records(spark, sf_dir), False), False, []), "summary"
    )
    cases = {
        "default": ({}, True),
        "no_report": ({}, False),
        "quarantine_allowed": ({"require_zero_quarantined_items": False}, True),
        "all_allowed": ({"require_zero_quarantined_items": False, "require_zero_review_items": False}, True),
        "report_optional": ({"require_guardrail_artifact": False, "require_zero_review_items": False}, False),
    }
    result = None
    for name, (policy, written) in cases.items():
        part = promotion.promotion_state(summary, policy, written).select(
            F.lit(name).alias("policy"), "status", joined("blockers").alias("blockers"), "approved_inputs",
            "review_pending", "quarantined_pending",
        )
        result = part if result is None else result.unionByName(part)
    return result


@query
def promoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_run(spark, sf_dir, relaxed=True).promoted_rows.select(
        "member_id", "cluster_id", "cluster_uid", "target_column", "promoted_value",
        F.col("source_row_after")["amount"].alias("amount_after"), "promotion_status",
    )


@query
def promoted_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_run(spark, sf_dir, relaxed=True).promoted_clusters


@query
def promotion_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch under default and relaxed policies."""
    strict, relaxed = (order_run(spark, sf_dir, flag).promotion for flag in (False, True))
    return strict.unionByName(relaxed)


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_summary(order_run(spark, sf_dir, relaxed=True))


@query
def two_run_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One delivery twice: the second run knows the families and reuses what the first decided."""
    folder = tables.scratch_path(spark, "state")
    rules = tables.cut(benchmark_rules(spark, sf_dir), "rules")
    done = []
    for number, day in ((1, "2024-01-01T00:00:00+00:00"), (2, "2024-01-02T00:00:00+00:00")):
        result = runs.run_with_state(
            dirty_orders(spark, sf_dir), orders_spec(), folder, day, order_by=F.col("id").cast("bigint"), rules=rules, stand_in=True
        )
        entries = state.scan_memory(spark, f"{folder}/memory").agg(F.count("*").alias("log_entries"))
        vectors_held = state.load_table(spark, f"{folder}/vectors", state.VECTORS).agg(F.count("*").alias("stored_vectors"))
        totals = tables.one_row(entries.join(vectors_held, F.lit(True)))  # one row each
        seen = result.remediations.join(result.registry.select("pattern_key", "seen_count"), "pattern_key")
        done.append(seen.join(F.broadcast(totals), F.lit(True)).select(
            F.lit(number).alias("run"), "cluster_uid", "transformation_type", "confidence_score", "seen_count", "cache_hit",
            "model_used", "log_entries", "stored_vectors",
        ))
    return done[0].unionByName(done[1])


@query
def run_invalid_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan over remediations of which half break the contract."""
    members, groups = order_groups(spark, sf_dir)
    decided = remediation.remediate(order_clusters(members, groups))
    broken = F.when(F.col("cluster_ord") % 2 == 0, F.array(F.lit("size"), F.lit("code")))
    plan, _ = execution.stage(tables.cut(decided.withColumn("missing_fields", broken), "decided"), members)
    return plan.select(
        "cluster_id", joined("missing_fields").alias("missing_fields"), "execution_status", "transformation_type",
        "affected_rows", "requires_human_review",
    )


# -- checks, records and streams ------------------------------------------------------------


@query
def schema_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer against an expected schema, with values that would not convert."""
    expected = {"c_custkey": "bigint", "c_name": "bigint", "c_acctbal": "int", "c_mktsegment": "string", "c_phone": "string"}
    return quality.value_drift(table(spark, sf_dir, "customer"), expected)


@query
def row_hash_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a second delivery that were not processed before."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    processed = tables.cut(
        orders.where("o_orderkey % 3 <> 0").select(quality.row_hash(orders).alias("row_hash")), "processed"
    )
    changed = orders.withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 10 == 1, F.lit(None)).otherwise(F.col("o_orderstatus"))
    )
    return quality.unprocessed(changed, processed)


@query
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    remediations, _, staged = order_plan(spark, sf_dir)
    return quality.audit_trail(staged, remediations, "2024-01-01T00:00:00").select(
        "member_id", "target_column", "old_value", "new_value", "changed", "model_used", "confidence_score", "recorded_at"
    )


@query
def recheck_after_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staged rows validated again, with one business rule."""
    _, _, staged = order_plan(spark, sf_dir)
    spec = ValidationSpec.build(required_columns=["order_date", "customer_email", "amount"])
    columns = ["id", "order_ref", "order_date", "customer_email", "amount"]
    checked = quality.recheck(staged, spec, columns, {"has_ref": "order_ref like 'ORD-%'"})
    return quality.recheck_summary(checked, ["has_ref"])


@query
def dashboard_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = order_run(spark, sf_dir, relaxed=True)
    return quality.dashboard_metrics(result.summary, execution.execution_summary(result.plan), result.promotion)


@query
def fix_success_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of promoted changes per quarter year, over one record per order."""
    runs_log = table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("at"), (F.col("o_orderkey") % 7).alias("staged"),
        F.least(F.col("o_orderkey") % 7, F.col("o_custkey") % 5).alias("promoted"),
    )
    return quality.fix_success_rate(runs_log, "at", "90 days").withColumn(
        "window_start", F.date_format("window_start", "yyyy-MM-dd")
    )


def event_rows(events: DataFrame) -> DataFrame:
    at = F.col("event_id") % 11
    return events.select(
        F.col("event_id").cast("string").alias("id"),
        "ts",
        F.when(at == 0, F.lit("bad")).when(at == 1, F.lit("")).otherwise(F.col("value").cast("decimal(18,2)").cast("string")).alias("amount"),
        "event_type",
    )


EVENT_SPEC = ValidationSpec.build(required_columns=["amount"])


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return lanes.validate_stream(event_rows(rows), EVENT_SPEC, F.col("id").cast("bigint"))


@query
def stream_validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lanes of a streamed validation, counted."""
    folder = tables.scratch_path(spark, "lanes")
    running = lanes.start_lanes(event_stream(spark, sf_dir), f"{folder}/clean", f"{folder}/bad", f"{folder}/state")
    running.awaitTermination()
    clean = spark.read.parquet(f"{folder}/clean").groupBy("event_type").agg(F.count("*").alias("rows"))
    bad = spark.read.parquet(f"{folder}/bad").groupBy("error_type").agg(F.count("*").alias("rows"))
    return clean.select(F.lit("clean").alias("lane"), F.col("event_type").alias("kind"), "rows").unionByName(
        bad.select(F.lit("anomaly").alias("lane"), F.col("error_type").alias("kind"), "rows")
    )


def _streamed(spark: SparkSession, rows: DataFrame) -> DataFrame:
    folder = tables.scratch_path(spark, "stream")
    lanes.start_table(rows, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query
def stream_anomaly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomaly rate of the closed windows of a stream (all but those the watermark still holds open)."""
    rates = _streamed(spark, lanes.anomaly_rate_stream(event_stream(spark, sf_dir), "ts", "1 day", "1 hour"))
    return rates.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query
def stream_window_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen more than once within a closed day."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    found = _streamed(spark, lanes.windowed_duplicates(rows, "user_id", "ts", "1 day", "1 hour"))
    return found.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


@query
def stream_duplicate_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every member of every group of equal values of a stream, as a batch over the whole table flags them."""
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    value = F.when(F.col("event_id") % 3 == 0, F.lit(" Hot ")).otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    rows = rows.withColumn("value", value)
    found = _streamed(spark, duplicates.duplicate_flags(rows, "value", "event_id", "ts", "4000 days", "4000 days"))
    return found.select("dup_key", "row_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query
def batch_anomaly_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    validated = validation.validate(event_rows(table(spark, sf_dir, "events")), EVENT_SPEC, F.col("id").cast("bigint"))
    rates = quality.anomaly_rate(validated, "ts", "1 hour")
    return rates.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


@query
def quarantine_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarantined members with reviews: a third approved, a third edited, some rejected, rest open."""
    members, groups = order_groups(spark, sf_dir)
    decided = remediation.remediate(order_clusters(members, groups))
    plan, _ = execution.stage(tables.cut(decided, "decided"), members)
    held = plan.where("execution_status = 'quarantined'").select("cluster_id")
    held_members = tables.lookup(members, tables.cut(held, "held"), ["cluster_id"], "left_semi").select(
        "member_id", "cluster_id", "value", "row_ord"
    )
    at = F.col("row_ord") % 4
    reviews = held_members.where(at < 3).select(
        "member_id",
        F.when(at == 2, F.lit("reject")).otherwise(F.lit("approve")).alias("decision"),
        F.when(at == 1, F.concat(F.lit("fixed-"), F.col("row_ord"))).alias("new_value"),
    )
    return quality.review_quarantine(held_members.drop("row_ord"), reviews)


@query
def replay_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replay of a stored batch after a partial promotion."""
    _, _, staged = order_plan(spark, sf_dir)
    folder = tables.scratch_path(spark, "batch")
    sinks.write_sections({"staged_rows": staged}, folder, "2024-01-01")
    batch = spark.read.parquet(f"{folder}/staged_rows")
    done = batch.where(F.col("source_row_before")["id"].cast("bigint") % 5 == 0)
    return quality.replay_rows(batch, done).select("member_id", "cluster_id", "target_column", "transformed_value")


@query
def resumed_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Promoted rows of two batches: one stopped after staging and replayed twice, one that shares rows with it."""
    folder = tables.scratch_path(spark, "batches")
    rows = dirty_orders(spark, sf_dir)
    policies = {"guardrail_policy": RELAXED_GUARD, "promotion_policy": RELAXED_PROMOTION}
    settings = {"spec": orders_spec(), "folder": folder, "seen_at": "2024-01-01T00:00:00+00:00", "order_by": "CAST(id AS BIGINT)"}
    batches.run_batch(rows, batch_id="one", stop_before="decisions", **settings, **policies)
    for _ in range(2):
        batches.replay(spark, folder, "one", **policies)
    batches.run_batch(rows, batch_id="two", **settings, **policies)
    lane = batches.promoted_lane(spark, folder)
    return lane.select("batch_id", "member_id", "target_column", "promoted_value")
