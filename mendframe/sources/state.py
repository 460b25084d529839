"""State that outlives a run: cluster registry, remediation memory, vector table.

A stored table is a folder of numbered versions. A new version is written in
full under its own number and becomes current when Spark's commit marker
appears, so a failed write is never read.
"""

from __future__ import annotations

import re
import warnings

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from mendframe.operators.clustering import REGISTRY

DAMAGED = re.compile(r"CANNOT_READ_FILE_FOOTER|FAILED_READ_FILE|is not a Parquet file|UNABLE_TO_INFER_SCHEMA")
MEMORY = (
    "memory_id string, timestamp_utc string, cluster_id string, cluster_uid string, pattern_key string, "
    "target_column string, inferred_anomaly_type string, transformation_type string, code string, "
    "confidence_score double, reasoning string, guardrail_action string, risk_level string"
)
VECTORS = "id string, vector array<double>, document string, metadata map<string,string>"


def _located(spark: SparkSession, folder: str) -> tuple:
    """A folder and its file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, folder: str) -> bool:
    path, system = _located(spark, folder)
    return system.exists(path)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    path, system = _located(spark, folder)
    if not system.exists(path):
        return []
    done = []
    for status in system.listStatus(path):
        name = status.getPath().getName()
        marker = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        if name.startswith("v") and name[1:].isdigit() and system.exists(marker):
            done.append(int(name[1:]))
    return sorted(done)


def load_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Newest whole version, or an empty table; only files that are damaged make it go back a version."""
    for version in reversed(_versions(spark, folder)):
        try:
            rows = spark.read.schema(schema).parquet(f"{folder}/v{version}")
            rows.limit(1).collect()
            return rows
        except Exception as problem:
            if not DAMAGED.search(str(problem)):
                raise
            warnings.warn(f"{folder}/v{version} is damaged and left out", stacklevel=2)
    return spark.createDataFrame([], schema)


def save_table(rows: DataFrame, folder: str) -> str:
    """Write the next version and return its path."""
    versions = _versions(rows.sparkSession, folder)
    path = f"{folder}/v{(versions[-1] if versions else 0) + 1}"
    rows.write.mode("overwrite").parquet(path)
    return path


def load_registry(spark: SparkSession, folder: str) -> DataFrame:
    return load_table(spark, folder, REGISTRY)


def append_memory(records: DataFrame, folder: str) -> None:
    """Append remediation records to the JSON log."""
    records.write.mode("append").json(folder)


def scan_memory(spark: SparkSession, folder: str) -> DataFrame:
    """Remediation log in append order (``mem_ord``), empty before its first entry; bad lines are skipped.

    A memory id starts with its time, so time and id give the order.
    """
    if not _exists(spark, folder):
        return spark.createDataFrame([], f"{MEMORY}, mem_ord string")
    rows = spark.read.schema(MEMORY).json(folder, mode="DROPMALFORMED").where("memory_id IS NOT NULL")
    order = F.concat_ws("|", F.coalesce("timestamp_utc", F.lit("")), "memory_id")
    return rows.withColumn("mem_ord", order)


def upsert_vectors(current: DataFrame | None, changes: DataFrame, order: str | None = None) -> DataFrame:
    """Vector table with the changes applied: the last write of an id wins.

    ``order`` ranks several changes of one id.
    """
    columns = ["id", "vector", "document", "metadata"]
    seq = F.col(order).cast("bigint") if order else F.lit(0).cast("bigint")
    fresh = changes.select(*columns, F.struct(F.lit(1).alias("new"), seq.alias("seq")).alias("_v"))
    if current is not None:
        fresh = current.select(
            *columns, F.struct(F.lit(0).alias("new"), F.lit(0).cast("bigint").alias("seq")).alias("_v")
        ).unionByName(fresh)
    # a write log may name one id very often: keep one row per id in each map task first
    newest = Window.partitionBy("id").orderBy(F.desc("_v"))
    return fresh.withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").select(*columns)
