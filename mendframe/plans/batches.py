"""Batches that survive a break: a journal of finished steps, resuming, replay.

A batch owns a folder. Its input is stored first, with a digest; after that every stage
table that a run cuts is written there under its number, and a rerun of the batch reads
the tables that are complete and goes on from the first that is not. Promoted rows go to
a lane with one folder per batch, which a rerun replaces.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mendframe.functions import tables
from mendframe.operators import quality
from mendframe.plans.run import RunResult, run
from mendframe.settings import ValidationSpec


def _digest(rows: DataFrame) -> str:
    """Equal for the same rows in any order and any partitions."""
    row = F.xxhash64(F.to_json(F.struct(*(f"`{c}`" for c in rows.columns)), {"ignoreNullFields": "false"}))
    found = rows.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return "/".join(map(str, [*found, *rows.columns]))


def _manifest(spark: SparkSession, folder: str) -> dict[str, Any] | None:
    path = f"{folder}/manifest.json"
    return json.loads(spark.read.text(path, wholetext=True).first()[0]) if tables.exists(spark, path) else None


def _open(rows: DataFrame, spec: ValidationSpec, folder: str, batch_id: str, order_by: str | None, seen_at: str) -> None:
    """Store the input of a new batch and its settings; a known batch has to be the same again."""
    spark = rows.sparkSession
    known = _manifest(spark, folder)
    if known is not None:
        if known["digest"] != _digest(rows):
            raise ValueError(f"batch {batch_id} was begun with other rows")
        return
    rows.write.mode("overwrite").parquet(f"{folder}/input")  # what a break left there was never named by a manifest
    stored = spark.read.schema(rows.schema).parquet(f"{folder}/input")
    settings = {
        "batch_id": batch_id, "digest": _digest(stored), "order_by": order_by, "seen_at": seen_at, "schema": rows.schema.json(),
        "spec": {"types": dict(spec.types), "required": spec.required, "unique": spec.unique, "unique_listed": spec.unique_listed},
    }
    tables.create_file(spark, f"{folder}/manifest.json", json.dumps(settings))


def _continue(spark: SparkSession, folder: str, batch_id: str, stop_before: str | None, options: Mapping[str, Any]) -> RunResult | None:
    home = f"{folder}/batches/{batch_id}"
    known = _manifest(spark, home)
    if known is None:
        raise ValueError(f"there is no batch {batch_id}")
    rows = spark.read.schema(T.StructType.fromJson(json.loads(known["schema"]))).parquet(f"{home}/input")
    spec = ValidationSpec(known["spec"]["types"], *(tuple(known["spec"][n]) for n in ("required", "unique")), known["spec"]["unique_listed"])
    order = None if known["order_by"] is None else F.expr(known["order_by"]).cast("bigint")
    with tables.journal(f"{home}/steps", stop_before) as steps:
        try:
            result = run(rows, spec, order_by=order, seen_at=known["seen_at"], **options)
            _promote(result, folder, batch_id)
        except tables.Stopped:
            return None
    result.extra["journal"] = list(steps.done)
    return result


def _promote(result: RunResult, folder: str, batch_id: str) -> None:
    """Put the batch's promoted rows into the lane, but those that another batch has put there."""
    spark = result.promoted_rows.sparkSession
    fresh = result.promoted_rows
    others = promoted_lane(spark, folder)
    if others is not None:
        fresh = quality.replay_rows(fresh, others.where(F.col("batch_id") != batch_id))
    fresh = tables.cut(fresh, "promoted")
    fresh.write.mode("overwrite").parquet(f"{folder}/promoted/batch_id={batch_id}")
    path = f"{folder}/batches/{batch_id}/committed"
    if not tables.exists(spark, path):
        tables.create_file(spark, path, "")


def promoted_lane(spark: SparkSession, folder: str) -> DataFrame | None:
    """Promoted rows of all batches, with ``batch_id``; None before the first."""
    path = f"{folder}/promoted"
    if not tables.exists(spark, path):
        return None
    return spark.read.option("basePath", path).parquet(path).withColumn("batch_id", F.col("batch_id").cast("string"))


def run_batch(
    rows: DataFrame, spec: ValidationSpec, folder: str, batch_id: str, seen_at: str,
    order_by: str | None = None, stop_before: str | None = None, **options: Any,
) -> RunResult | None:
    """Run a batch, or go on with one that a break ended; ``options`` are those of ``run``.

    ``order_by`` is an SQL expression of the row order. A batch begun with other rows
    raises. With ``stop_before``, the name of a stage table, the run ends before it
    writes that table and gives None, as a break there would.
    """
    _open(rows, spec, f"{folder}/batches/{batch_id}", batch_id, order_by, seen_at)
    return _continue(rows.sparkSession, folder, batch_id, stop_before, options)


def replay(spark: SparkSession, folder: str, batch_id: str, **options: Any) -> RunResult:
    """Run a stored batch again: steps that are finished are read, the rest is done; promoted rows appear once."""
    return _continue(spark, folder, batch_id, None, options)


def batch_journal(spark: SparkSession, folder: str) -> DataFrame:
    """(batch_id, seen_at, committed) of all batches of the folder."""
    path = f"{folder}/batches"
    found = []
    for batch_id in tables.folder_names(spark, path):
        known = _manifest(spark, f"{path}/{batch_id}")
        if known is not None:
            found.append((batch_id, known["seen_at"], tables.exists(spark, f"{path}/{batch_id}/committed")))
    return spark.createDataFrame(found, "batch_id string, seen_at string, committed boolean")
