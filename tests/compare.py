"""Compare queries with their SQL checks: python tests/compare.py SF_DIR [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if hasattr(value, "as_tuple"):
        return round(float(value), 6)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r)
    )


def check_engine(sf_dir):
    import duckdb

    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir, name, query, sql):
    """Problem text, or None when both sides agree."""
    result = query(spark, sf_dir)
    got = rows_of(result.columns, [tuple(r) for r in result.collect()])
    if sql is None:
        return None if got else "no rows"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(result.columns):
        return f"columns {sorted(result.columns)} against {sorted(columns)}"
    want = rows_of(columns, cursor.fetchall())
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:3]
    lost = [r for r in want if r not in set(got)][:3]
    return f"{len(got)} rows against {len(want)}; only here {extra}; only there {lost}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as contract

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    sf, names = sys.argv[1], sys.argv[2:]
    con, checks = check_engine(sf), contract.oracle_sql()
    bad = 0
    for name, query in contract.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf, name, query, checks.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        note = "" if name in checks else " (rows only)"
        print(f"{'ok  ' if problem is None else 'BAD '} {time.time() - start:6.1f}s {name}{note} {problem or ''}", flush=True)
    print(f"{bad} problems")
