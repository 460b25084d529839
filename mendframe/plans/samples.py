"""Derived inputs over the driver tables, shared by queries, bench and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mendframe.operators import validation
from mendframe.settings import ValidationSpec

# One SQL text runs unchanged in Spark and in the check engine.
DIRTY_ORDERS_SQL = """
SELECT CAST(o_orderkey AS STRING) AS id,
  'ORD-' || CAST(CASE WHEN o_orderkey % 101 = 1 THEN o_orderkey - 1 ELSE o_orderkey END AS STRING) AS order_ref,
  CASE o_orderkey % 23
    WHEN 0 THEN replace(iso, '-', '/')
    WHEN 1 THEN substr(iso, 9, 2) || '-' || substr(iso, 6, 2) || '-' || substr(iso, 1, 4)
    WHEN 2 THEN 'N/A'
    WHEN 3 THEN replace(iso, '-', '.')
    ELSE iso END AS order_date,
  CASE o_orderkey % 19
    WHEN 0 THEN 'user' || cust || '@' WHEN 1 THEN '' WHEN 2 THEN 'user mail.com'
    ELSE 'user' || cust || '@example.com' END AS customer_email,
  CASE o_orderkey % 31
    WHEN 0 THEN amt || 'x' WHEN 1 THEN '7 500' WHEN 2 THEN '1,200.50'
    ELSE amt END AS amount
FROM (SELECT o_orderkey,
        substr(CAST(o_orderdate AS STRING), 1, 10) AS iso,
        CAST(o_custkey AS STRING) AS cust,
        CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) AS amt
      FROM {orders}) t
"""

ORDERS_SCHEMA = {
    "columns": {
        "order_date": {"required": True},
        "customer_email": {"required": True},
        "amount": {"required": True},
    },
    "unique_columns": ["order_ref"],
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as loose text with faults placed by key arithmetic."""
    return spark.sql(DIRTY_ORDERS_SQL, orders=table(spark, sf_dir, "orders"))


def validated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty orders with their anomalies, in numeric key order."""
    return validation.validate(
        dirty_orders(spark, sf_dir), orders_spec(), order_by=F.col("id").cast("bigint")
    )


def orders_spec() -> ValidationSpec:
    return ValidationSpec.build(ORDERS_SCHEMA)
