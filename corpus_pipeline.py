"""Documents to training shards: quality, near duplicates, benchmarks, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mendframe.functions import tables
from mendframe.functions.shipping import ship
from mendframe.llm import decontamination, mixing, quality, sharding, simhash
from mendframe.llm.common import table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and every cutoff that the labels prove safe."""
    ship(spark)
    return quality.judge(docs, table(spark, sf_dir, "labels"), whole_rows=True).where("kept").select("_in.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles SimHash finds similar to 0.8 or more."""
    ship(spark)
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    ship(spark)
    flagged = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return flagged.where(~F.col("_contaminated")).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: every document as often as its source's target asks."""
    ship(spark)
    return mixing.repeated(mixing.mix(docs)).select(*docs.columns)


def feistel_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and its slot there, by a permutation of all row numbers."""
    ship(spark)
    order = [F.col("doc_id"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))]
    placed = sharding.shard(docs, order)
    return placed.select(*docs.columns, F.col("_shard").alias("shard"), F.col("_slot").alias("slot"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("feistel_sharding", feistel_sharding),
]

ORACLE_SQL = None  # fingerprints, edit distances and the permutation are beyond SQL; tests compare with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each over the written result of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = tables.cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
