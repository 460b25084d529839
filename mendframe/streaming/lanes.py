"""Streaming validation: clean rows flow on while anomalies go to their own lane."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from mendframe.functions import text as tx
from mendframe.operators import quality, validation
from mendframe.settings import ValidationSpec


def validate_stream(rows: DataFrame, spec: ValidationSpec, order_by: str | Column) -> DataFrame:
    """The stateless rules on a stream.

    Finding every member of a duplicate group needs all rows, so unique columns
    are refused; on a stream use ``windowed_duplicates`` instead.
    """
    if spec.unique:
        raise ValueError(f"unique columns {sorted(spec.unique)} need all rows; use windowed_duplicates on a stream")
    return validation.validate(rows, spec, order_by=order_by)


def start_lanes(
    validated: DataFrame, clean_path: str, anomaly_path: str, checkpoint: str, available_now: bool = True
) -> StreamingQuery:
    """Write both lanes per micro-batch.

    Every batch owns one folder per lane and overwrites it, so a batch that is
    retried after a failure leaves no duplicates.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            validation.clean_rows(kept).write.mode("overwrite").parquet(f"{clean_path}/batch_id={batch_id}")
            validation.anomalies(kept).write.mode("overwrite").parquet(f"{anomaly_path}/batch_id={batch_id}")
        finally:
            kept.unpersist()

    writer = validated.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def event_time(rows: DataFrame, time: str) -> DataFrame:
    """Watermarks need a timestamp with zone; a zone-less one is read in the session zone."""
    kind = rows.schema[time].dataType
    return rows.withColumn(time, F.col(time).cast("timestamp")) if isinstance(kind, T.TimestampNTZType) else rows


def anomaly_rate_stream(validated: DataFrame, time: str, width: str, lateness: str) -> DataFrame:
    """Anomaly rate per closed window; rows later than ``lateness`` are left out."""
    return quality.anomaly_rate(event_time(validated, time).withWatermark(time, lateness), time, width)


def windowed_duplicates(rows: DataFrame, column: str, time: str, width: str, lateness: str) -> DataFrame:
    """Values seen more than once inside one time window."""
    timed = event_time(rows, time).withWatermark(time, lateness)
    key = tx.dedup_key(validation.cell_text(rows, column))
    return (
        timed.where(key.isNotNull())
        .groupBy(F.window(time, width).alias("w"), key.alias("dup_key"))
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("w.start").alias("window_start"), "dup_key", "n")
    )


def start_table(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to a parquet table and stop when the input is used up."""
    return (
        rows.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
