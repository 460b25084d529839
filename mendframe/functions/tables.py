"""Table helpers for scale: cut lineage, ordinals, skew-safe lookups, first k per key."""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from mendframe import settings as S


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="mendframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _file_system(spark, path)
    return system.exists(place)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    system, place = _file_system(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory()) if system.exists(place) else []


def create_file(spark: SparkSession, path: str, text: str) -> None:
    """Write a small new file; one that is there already raises, so that one of two writers wins."""
    system, place = _file_system(spark, path)
    out = system.create(place, False)
    out.write(bytearray(text.encode()))
    out.close()


class Stopped(Exception):
    """The run was asked to end before this table."""


class Journal:
    """Numbers the cut tables of a run and keeps them in one folder, so that a rerun finds those that are complete."""

    def __init__(self, folder: str, stop_before: str | None) -> None:
        self.folder, self.stop_before, self.steps = folder, stop_before, 0
        self.done: list[tuple[str, bool]] = []  # (name, read from an earlier run)

    def place(self, spark: SparkSession, name: str) -> tuple[str, bool]:
        if name == self.stop_before:
            raise Stopped(name)
        path = f"{self.folder}/{self.steps:04d}-{name}"
        self.steps += 1
        complete = exists(spark, f"{path}/_SUCCESS")
        self.done.append((name, complete))
        return path, complete


_journal: contextvars.ContextVar[Journal | None] = contextvars.ContextVar("journal", default=None)


@contextlib.contextmanager
def journal(folder: str, stop_before: str | None = None) -> Iterator[Journal]:
    """Within this, ``cut`` writes to numbered places and reads what an earlier run completed there.

    It is for runs that cut the same tables in the same order over the same input.
    """
    held = Journal(folder, stop_before)
    token = _journal.set(held)
    try:
        yield held
    finally:
        _journal.reset(token)


def cut(rows: DataFrame, name: str = "stage", by: Sequence[str] = ()) -> DataFrame:
    """Write a table to the shared folder and go on from the written copy.

    The copy survives lost executors, is columnar, and gives later joins real
    sizes to plan with. ``by`` names columns of few values that become folders,
    so that a filter on them reads only its part.
    """
    spark = rows.sparkSession
    active = _journal.get()
    path, complete = (scratch_path(spark, name), False) if active is None else active.place(spark, name)
    if not complete:
        writer = rows.write.mode("error" if active is None else "overwrite")  # a broken attempt left no mark of success
        (writer.partitionBy(*by) if by else writer).parquet(path)
    written = spark.read.schema(rows.schema).parquet(path)
    return written.select(*(f"`{c}`" for c in rows.columns)) if by else written


def one_row(rows: DataFrame) -> DataFrame:
    """A one-row result, computed once."""
    kept = rows.limit(2).collect()
    if len(kept) != 1:
        raise ValueError(f"expected one row, got {len(kept)} or more")
    return rows.sparkSession.createDataFrame([tuple(kept[0])], rows.schema)


def is_small(rows: DataFrame) -> bool:
    """Checked bound for a broadcast; pass a written table or columns of one.

    The size of the written files settles most cases without a job, anything
    larger is measured.
    """
    if int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= S.TRUSTED_FILE_BYTES:
        return True
    sized = rows.select(F.length(F.to_json(F.struct(*rows.columns))).alias("n"))
    count, size = sized.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    return count <= S.BROADCAST_MAX_ROWS and size <= S.BROADCAST_MAX_BYTES


def with_partition_position(rows: DataFrame) -> DataFrame:
    """Add ``_part`` and ``_at``: where a row sits in its scan."""
    position = F.monotonically_increasing_id()
    return rows.withColumn("_part", F.shiftright(position, 33)).withColumn(
        "_at", position.bitwiseAND(F.lit((1 << 33) - 1))
    )


def number_positions(rows: DataFrame, output: str) -> DataFrame:
    """Turn ``_part``/``_at`` of a written table into contiguous 1-based numbers.

    Only one count per partition is collected into a running total, so the
    broadcast side is bounded by the number of partitions.
    """
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    return (
        rows.join(F.broadcast(starts), "_part")
        .withColumn(output, F.col("_start") + F.col("_at") + 1)
        .drop("_part", "_at", "_start", "_n")
    )


def with_ordinal(rows: DataFrame, output: str = "row_ord") -> DataFrame:
    """Contiguous 1-based row numbers in the order of the partitions.

    Counts and rows are read from one written copy: a plan that is evaluated
    twice may be cut into other partitions the second time.
    """
    return number_positions(cut(with_partition_position(rows), "positions"), output)


def ranked(rows: DataFrame, order: Sequence[str | Column], output: str = "rank") -> DataFrame:
    """Contiguous 1-based ranks of a written table in a global order.

    A counted, small table is ranked by one task. A larger one is
    range-partitioned by the order, written, and numbered by partition offsets.
    """
    if rows.count() <= S.ONE_TASK_ROWS:
        return rows.withColumn(output, F.row_number().over(Window.orderBy(*order)).cast("bigint"))
    return number_positions(cut(with_partition_position(rows.orderBy(*order)), "ranked"), output)


def first_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int) -> DataFrame:
    """First ``k`` rows per key.

    ``row_number() <= k`` lets Spark keep at most k rows per key in every map
    task before the shuffle, so a hot key never reaches one task whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(window)).where(F.col("_rn") <= k).drop("_rn")


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.MapType):
        return False
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return True


def heaviest(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys with most rows, a fixed number of them, from (keys, n)."""
    return counts.orderBy(F.desc("n"), *keys).limit(S.HOT_KEYS).select(*keys)


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    small: bool | None = None,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join rows to a table that has one row per key, safe against hot keys.

    A right side of checked size is broadcast. Beyond the bound, the heaviest
    keys of the left side (a fixed number of them) are served from a broadcast
    of just their right rows and leave the shuffle with a spread-out salt; all
    other keys take an ordinary shuffle join. ``hot`` names those keys, at most
    ``HOT_KEYS`` rows, where the caller has counted already. ``how``: left,
    inner, left_semi or left_anti.
    """
    keys = list(keys)
    if small is None:
        small = is_small(right)
    if small:
        return left.join(F.broadcast(right), keys, how)

    if hot is None:
        hot = heaviest(left.groupBy(*keys).agg(F.count("*").alias("n")), keys)
    payload = [c for c in right.columns if c not in keys]
    packed = right.select(*keys, F.struct(F.lit(True).alias("_hit"), *payload).alias("_row"))
    hot_rows = F.broadcast(
        F.broadcast(hot).join(packed, keys, "left").select(
            *keys, F.lit(True).alias("_hot"), F.col("_row").alias("_hot_row")
        )
    )
    cold_rows = packed.withColumnRenamed("_row", "_cold_row").withColumn("_salt", F.lit(0))
    spread = [f.name for f in left.schema.fields if _hashable(f.dataType)]
    unmatched = F.col("_hot").isNotNull()
    for key in keys:
        unmatched = unmatched | F.col(key).isNull()
    salted = left.join(hot_rows, keys, "left").withColumn(
        "_salt",
        F.when(unmatched, 1 + F.pmod(F.xxhash64(*spread), F.lit(S.SALTS)).cast("int")).otherwise(F.lit(0)),
    )
    joined = salted.join(cold_rows, [*keys, "_salt"], "left").withColumn(
        "_row", F.coalesce("_hot_row", "_cold_row")
    )
    hit = F.col("_row").isNotNull()
    if how == "left_anti":
        return joined.where(~hit).select(*left.columns)
    if how == "left_semi":
        return joined.where(hit).select(*left.columns)
    if how == "inner":
        joined = joined.where(hit)
    return joined.select(*left.columns, *(F.col("_row")[c].alias(c) for c in payload))
