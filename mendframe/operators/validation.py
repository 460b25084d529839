"""Cell validation, duplicate detection and the clean / anomaly split.

``validate`` adds four columns to any table: ``_row_id``, ``_row_ord``,
``_bad`` (plain condition, all compiled code) and ``_anomalies`` (array of
structs, empty for a clean row). Filtering on ``_bad`` first means the array is
only ever built for bad rows. All rules are chosen once from the schema, so a
row only pays for the checks its columns need.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from mendframe import settings as S
from mendframe.functions import tables, text as tx
from mendframe.settings import ValidationSpec
from mendframe.sources import readers

ANOMALY = "struct<column_name:string,value:string,error_type:string,anomaly_hint:string>"
INTERNAL = ("_row_id", "_row_ord", "_bad", "_anomalies", "_duplicates", S.MALFORMED)

_NUMBERS = (T.NumericType,)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def cell_text(rows: DataFrame, column: str) -> Column:
    """A cell as text; a column the table lacks is NULL everywhere."""
    if column not in rows.columns:
        return F.lit(None).cast("string")
    kind = rows.schema[column].dataType
    name = F.col(f"`{column}`")
    return F.to_json(name) if isinstance(kind, _NESTED) else name.cast("string")


def _is_text(rows: DataFrame, column: str) -> bool:
    return column in rows.columns and isinstance(rows.schema[column].dataType, T.StringType)


def is_valid(rows: DataFrame, column: str, logical: str | None) -> Column | None:
    """Format check for a column, or None when nothing can fail.

    Columns that already carry the right Spark type are judged on the typed
    value: text of a double or timestamp would be rejected for its notation.
    """
    if logical not in tx.FORMAT_CHECKS:
        return None
    kind = rows.schema[column].dataType if column in rows.columns else T.StringType()
    if logical == "numeric" and isinstance(kind, _NUMBERS):
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return F.abs(F.col(f"`{column}`")) != F.lit(float("inf"))
        return None
    if logical == "date" and isinstance(kind, _TIMES):
        return None
    return tx.FORMAT_CHECKS[logical](cell_text(rows, column))


def _anomaly(column: str, value: Column, error: tuple[str, str]) -> Column:
    return F.struct(
        F.lit(column).alias("column_name"),
        value.alias("value"),
        F.lit(error[0]).alias("error_type"),
        F.lit(error[1]).alias("anomaly_hint"),
    )


def _checks(rows: DataFrame, spec: ValidationSpec) -> list[tuple[str, Column, Column | None, bool]]:
    """(column, text, format check, required) of every column that can fail, in name order."""
    columns = [c for c in rows.columns if c not in INTERNAL]
    checks = []
    for column in sorted(set(columns) | set(spec.required)):
        valid, required = is_valid(rows, column, spec.logical_type(column)), column in spec.required
        if required or valid is not None:
            checks.append((column, cell_text(rows, column), valid, required))
    return checks


def row_fails(rows: DataFrame, spec: ValidationSpec) -> Column:
    """True when a row has any null or format error.

    A value of the right format is never missing, so good cells are settled by
    the format check alone.
    """
    bad = F.lit(False)
    for column, value, valid, required in _checks(rows, spec):
        missing = tx.is_missing(value)
        if valid is None:
            fails = missing
        elif required and _is_text(rows, column):
            fails = F.coalesce(~valid, F.lit(True))
        elif required:
            fails = missing | ~valid
        else:
            fails = F.coalesce(~valid & ~missing, F.lit(False))
        bad = bad | fails
    return bad


def row_anomalies(rows: DataFrame, spec: ValidationSpec) -> Column:
    """Null and format errors of one row, in column-name order.

    A missing required cell stops the checks of that column; a missing
    optional cell is skipped.
    """
    found = []
    for column, value, valid, required in _checks(rows, spec):
        missing = tx.is_missing(value)
        format_error = None if valid is None else _anomaly(column, value, S.type_error(spec.logical_type(column)))
        if required:
            check = F.when(missing, _anomaly(column, value, S.NULL_ERROR))
            found.append(check if format_error is None else check.when(~valid, format_error))
        else:
            found.append(F.when(~missing & ~valid, format_error))
    if not found:
        return F.array().cast(f"array<{ANOMALY}>")
    return F.array_compact(F.array(*found)).cast(f"array<{ANOMALY}>")


def row_identifier(rows: DataFrame, ordinal: Column | None) -> Column:
    """First non-empty of id, row_id, record_id, else the ordinal."""
    candidates = [F.nullif(cell_text(rows, c), F.lit("")) for c in S.ROW_ID_COLUMNS if c in rows.columns]
    if ordinal is not None:
        candidates.append(ordinal.cast("string"))
    return F.coalesce(*candidates)


def duplicate_keys(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(column_name, dup_key, n) of every value that occurs at least twice.

    Counting is combined map-side, so a hot value costs one row per map task.
    """
    present = [c for c in columns if c in rows.columns]
    pairs = F.array(
        *(F.struct(F.lit(c).alias("column_name"), tx.dedup_key(cell_text(rows, c)).alias("dup_key"))
          for c in present)
    )
    return (
        rows.select(F.inline(pairs))
        .where(F.col("dup_key").isNotNull())
        .groupBy("column_name", "dup_key")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
    )


def _flag_duplicates(rows: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """Add a boolean (or NULL) per unique column; return the table and the flag names by column."""
    present = sorted({c for c in columns if c in rows.columns})
    if not present:
        return rows, {}
    repeated = tables.cut(duplicate_keys(rows, tuple(present)), "duplicates")
    flags = {}
    for i, column in enumerate(present):
        key, flag = f"_key{i}", f"_dup{i}"
        counted = repeated.where(F.col("column_name") == column).select(F.col("dup_key").alias(key), "n")
        rows = tables.lookup(
            rows.withColumn(key, tx.dedup_key(cell_text(rows, column))),
            counted.select(key, F.lit(True).alias(flag)),
            [key],
            hot=tables.heaviest(counted, [key]),
        ).drop(key)
        flags[column] = flag
    return rows, flags


def mark_duplicates(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Add ``_duplicates``: sorted names of unique columns whose value repeats."""
    marked, flags = _flag_duplicates(rows, columns)
    if not flags:
        return marked.withColumn("_duplicates", F.array().cast("array<string>"))
    names = F.array_compact(F.array(*(F.when(F.col(flag), F.lit(column)) for column, flag in flags.items())))
    return marked.withColumn("_duplicates", names).drop(*flags.values())


def validate(rows: DataFrame, spec: ValidationSpec, order_by: str | Column | None = None) -> DataFrame:
    """Input columns plus ``_row_id``, ``_row_ord``, ``_bad`` and ``_anomalies``.

    A row that its reader marked in ``S.MALFORMED`` has an anomaly for that, ahead of
    those of its cells and under no column's name.

    ``order_by`` is an integer column or expression that gives the row order;
    without it rows are numbered in scan order.
    """
    columns = rows.columns
    if order_by is None:
        rows = tables.with_ordinal(rows, "_row_ord")
    else:
        order = F.col(order_by) if isinstance(order_by, str) else order_by
        rows = rows.withColumn("_row_ord", order.cast("bigint"))
    marked, flags = _flag_duplicates(rows, spec.unique)
    base = marked.select(*(f"`{c}`" for c in columns))
    bad, found = row_fails(base, spec), row_anomalies(base, spec)
    if flags:
        repeats = [
            F.when(F.col(flag), _anomaly(column, cell_text(base, column), S.DUPLICATE_ERROR))
            for column, flag in flags.items()
        ]
        found = F.concat(found, F.array_compact(F.array(*repeats)).cast(f"array<{ANOMALY}>"))
        for flag in flags.values():
            bad = bad | F.coalesce(F.col(flag), F.lit(False))
    if S.MALFORMED in columns:
        broken = F.when(F.col(S.MALFORMED).isNotNull(), _anomaly("", F.col(S.MALFORMED), S.MALFORMED_ERROR))
        found = F.concat(F.array_compact(F.array(broken)).cast(f"array<{ANOMALY}>"), found)
        bad = bad | F.col(S.MALFORMED).isNotNull()
    return marked.select(
        *(f"`{c}`" for c in columns),
        row_identifier(base, F.col("_row_ord")).alias("_row_id"),
        "_row_ord",
        bad.alias("_bad"),
        found.alias("_anomalies"),
    )


def lean(validated: DataFrame) -> DataFrame:
    """The same rows for writing: errors are built for bad rows only."""
    return validated.withColumn("_anomalies", F.when(F.col("_bad"), F.col("_anomalies")))


def clean_rows(validated: DataFrame) -> DataFrame:
    """Rows without any anomaly, in their input shape."""
    return validated.where(~F.col("_bad")).drop("_row_id", "_row_ord", "_bad", "_anomalies", S.MALFORMED)


def anomalies(validated: DataFrame) -> DataFrame:
    """One row per (row, column, error).

    The row image is built after the filter, so clean rows never pay for it.
    """
    columns = [c for c in validated.columns if c not in INTERNAL]
    image = F.create_map(
        *(x for c in columns for x in (F.lit(c), cell_text(validated, c)))
    ).cast("map<string,string>")
    return (
        validated.where("_bad")
        .select(
            F.col("_row_id").alias("id"),
            F.col("_row_ord").alias("row_ord"),
            image.alias("source_row"),
            F.posexplode("_anomalies").alias("pos", "a"),
        )
        .select(
            "id",
            "row_ord",
            "pos",
            F.concat_ws(":", "id", "a.column_name", "a.error_type").alias("anomaly_uid"),
            "a.column_name",
            "a.value",
            "a.error_type",
            "a.anomaly_hint",
            F.lit(S.SOURCE_PHASE).alias("source_phase"),
            "source_row",
        )
    )


def anomaly_breakdown(found: DataFrame, *by: str) -> DataFrame:
    """Anomaly counts per error type (or the given columns)."""
    return found.groupBy(*(by or ("error_type",))).agg(F.count("*").alias("anomalies"))


def _error_kinds(malformed: bool = False) -> list[str]:
    """Error types that a table can have; only some readers mark malformed rows."""
    usual = [S.NULL_ERROR[0], S.DUPLICATE_ERROR[0], *(e for e, _ in S.TYPE_ERRORS.values())]
    return sorted([*usual, S.MALFORMED_ERROR[0]] if malformed else usual)


def _summary(base: DataFrame, spec: ValidationSpec) -> DataFrame:
    """Summary row from one row of counts, where an absent count is zero."""

    def number(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)).cast("bigint")

    total, bad = number("input_rows"), number("bad_rows")
    return base.select(
        F.when(total == 0, F.lit("no_input")).otherwise(F.lit("completed")).alias("status"),
        total.alias("input_rows"),
        (total - bad).alias("clean_rows"),
        bad.alias("bad_rows"),
        number("anomalies").alias("anomalies"),
        F.lit(",".join(spec.rule_names())).alias("validation_rules_applied"),
        F.lit(",".join(spec.required)).alias("required_columns"),
        *(number(kind).alias(kind) for kind in _error_kinds(True) if kind in base.columns),
    )


def summarize(validated: DataFrame, spec: ValidationSpec) -> DataFrame:
    """One row: status, input, clean and bad rows, anomalies, rules and breakdown.

    One pass: rows are first counted per list of error types they carry.
    """
    errors = F.when(F.col("_bad"), F.transform("_anomalies", lambda a: a["error_type"]))
    errors = F.coalesce(errors, F.array().cast("array<string>"))
    per_pattern = validated.groupBy(errors.alias("errors")).agg(F.count("*").alias("n"))

    def times(kind: str) -> Column:
        return F.sum(F.size(F.filter("errors", lambda e: e == kind)) * F.col("n"))

    counts = per_pattern.agg(
        F.sum("n").alias("input_rows"),
        F.sum(F.when(F.size("errors") > 0, F.col("n"))).alias("bad_rows"),
        F.sum(F.size("errors") * F.col("n")).alias("anomalies"),
        *(times(kind).alias(kind) for kind in _error_kinds(S.MALFORMED in validated.columns)),
    )
    return _summary(counts, spec)


def summarize_found(rows: DataFrame, found: DataFrame, spec: ValidationSpec) -> DataFrame:
    """The same summary from the input and its written anomalies.

    The input is only counted, which a columnar file answers from its footer;
    a bad row is known by its first anomaly.
    """
    counts = found.agg(
        F.count_if(F.col("pos") == 0).alias("bad_rows"),
        F.count("*").alias("anomalies"),
        *(F.count_if(F.col("error_type") == kind).alias(kind) for kind in _error_kinds(S.MALFORMED in rows.columns)),
    )
    total = rows.agg(F.count("*").alias("input_rows"))
    return _summary(total.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k"), spec)


def load(
    spark: SparkSession, source: DataFrame | Mapping[str, Any], spec: ValidationSpec, order_by: str | Column | None = None
) -> tuple[DataFrame | None, DataFrame]:
    """(validated rows or None, summary row with ``error``) of a table or path setting.

    An input that cannot be read gives status ``error`` and the message, as does one that
    turns out unreadable while its rows are judged; no input and an empty one give
    ``no_input``.
    """
    try:
        rows = readers.resolve_input(spark, source)
        if rows is not None:
            validated = validate(rows, spec, order_by)
            summary = tables.one_row(summarize(validated, spec))
            return validated, summary.withColumn("error", F.lit(None).cast("string"))
    except (PySparkException, Py4JJavaError, OSError, ValueError) as problem:  # of reading and parsing, not of this code
        return None, _unread(spark, spec, "error", str(problem))
    return None, _unread(spark, spec, "no_input", None)


def _unread(spark: SparkSession, spec: ValidationSpec, status: str, message: str | None) -> DataFrame:
    """Summary row where there are no rows to judge."""
    empty = spark.range(1).select(
        *(F.lit(0).alias(c) for c in ("input_rows", "bad_rows", "anomalies", *_error_kinds()))
    )
    return _summary(empty, spec).withColumn("status", F.lit(status)).withColumn("error", F.lit(message).cast("string"))
