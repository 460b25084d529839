"""Readers that give loose rows: every cell is text, absent keys are NULL."""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from functools import reduce
from pathlib import PurePosixPath
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from mendframe import settings as S
from mendframe.functions import tables, text as tx
from mendframe.sources import csv_records

BOM = "\ufeff"
PATH_KEYS = ("input_path", "source_file", "dataset_path")


def read_csv(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """Header CSV, all text; a byte-order mark and blank lines are dropped.

    Rows with more or fewer cells than the header keep their text in the column
    ``S.MALFORMED``, from which validation makes an anomaly. Line breaks inside quotes
    need ``multiline``, which splits files into tasks, too, but reads their lines twice.
    """
    if multiline:
        return csv_records.read_csv_records(spark, path)
    columns = spark.read.csv(path, header=True, inferSchema=False, escape='"').columns
    fields = [T.StructField(c, T.StringType()) for c in (*columns, S.MALFORMED)]
    counted = spark.read.schema(T.StructType(fields)).option("columnPruning", False)  # else cells beyond the wanted ones are not seen
    return counted.csv(
        path, header=True, mode="PERMISSIVE", encoding="UTF-8", escape='"', columnNameOfCorruptRecord=S.MALFORMED
    )


def flag_long_rows(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV rows with ``malformed``: more or fewer cells than the columns, by default those of the header."""
    columns = spark.read.csv(path, header=True, inferSchema=False).columns if columns is None else columns
    fields = [T.StructField(c, T.StringType()) for c in columns]
    schema = T.StructType([*fields, T.StructField("_corrupt_record", T.StringType())])
    counted = spark.read.schema(schema).option("columnPruning", False)
    rows = counted.csv(path, header=True, mode="PERMISSIVE", enforceSchema=True, escape='"')
    return rows.withColumn("malformed", F.col("_corrupt_record").isNotNull())


def read_json(spark: SparkSession, path: str | list[str], unwrap: bool = True) -> DataFrame:
    """Objects of JSON documents as maps. One file is one task by nature; large inputs are JSON lines."""
    documents = spark.read.text(path, wholetext=True).withColumn("file", _file_name())
    return json_objects(documents.withColumn("doc", F.ltrim("value", F.lit(BOM))).drop("value"), "doc", unwrap)


def json_objects(documents: DataFrame, doc: str, unwrap: bool = True) -> DataFrame:
    """Objects of JSON text documents as ``row`` maps with ``pos``.

    A document is an array, one object, or ``{"records": [...]}``; elements
    that are not objects are dropped. Without ``unwrap``, an object that has
    ``records`` is one row like any other.
    """
    others = [c for c in documents.columns if c != doc]
    strict = {"mode": "FAILFAST"}
    rows = documents.withColumn("_body", tx.strip(F.col(doc)))
    body = F.col("_body")
    rows = rows.withColumn("_top", F.from_json(F.when(body.startswith("{"), body), "map<string,string>", strict))
    records = tx.strip(F.col("_top")["records"])
    elements = (
        F.when(body.startswith("["), F.from_json(body, "array<string>", strict))
        .when(F.lit(unwrap) & records.startswith("["), F.from_json(records, "array<string>", strict))
        .when(body.startswith("{"), F.array(body))
    )
    items = rows.select(*others, F.posexplode(elements).alias("pos", "item"))
    return items.where(F.ltrim("item").startswith("{")).select(
        *others, "pos", F.from_json("item", "map<string,string>", strict).alias("row")
    )


def read_jsonl(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Objects of JSON lines as maps; blank and non-object lines are skipped, a bad line fails."""
    lines = spark.read.text(path).select(
        _file_name().alias("file"), tx.strip(F.ltrim("value", F.lit(BOM))).alias("line")
    )
    bad = F.raise_error(F.concat(F.lit("malformed JSON line: "), F.substring("line", 1, 80)))
    is_object = F.when(F.try_parse_json("line").isNull(), bad.cast("boolean")).otherwise(
        F.col("line").startswith("{")
    )
    return lines.where(F.col("line") != "").where(is_object).select(
        "file", F.from_json("line", "map<string,string>").alias("row")
    )


def widen(rows: DataFrame, columns: Sequence[str] | None = None, column: str = "row") -> DataFrame:
    """Maps to columns. Without names, the distinct keys are looked up first."""
    if columns is None:
        found = rows.select(F.explode(F.map_keys(column)).alias("k")).distinct()
        columns = sorted(r.k for r in found.collect())  # one name per column of the table
    others = [c for c in rows.columns if c != column]
    return rows.select(*others, *(F.col(column)[c].alias(c) for c in columns))


def read_rows(
    spark: SparkSession, path: str, columns: Sequence[str] | None = None, multiline: bool = False
) -> DataFrame:
    """Table of any supported input file, chosen by suffix; ``multiline`` is for CSV with quoted line breaks."""
    suffix = PurePosixPath(path).suffix.lower()
    if suffix == ".csv":
        return read_csv(spark, path, multiline)
    if suffix == ".json":
        return widen(read_json(spark, path), columns).drop("pos", "file")
    if suffix == ".jsonl":
        return widen(read_jsonl(spark, path), columns).drop("file")
    raise ValueError(f"Unsupported input format: {suffix}")


def resolve_input(spark: SparkSession, source: DataFrame | Mapping[str, Any]) -> DataFrame | None:
    """A given table beats a path; the first path setting that is filled wins.

    ``multiline`` in the source allows quoted line breaks in CSV. None when nothing is given. A missing file raises.
    """
    if isinstance(source, DataFrame):
        return source
    rows = source.get("raw_rows")
    if isinstance(rows, DataFrame):
        return rows
    path = next((source[k] for k in PATH_KEYS if source.get(k)), None)
    return None if path is None else read_rows(spark, str(path), multiline=bool(source.get("multiline")))


def load_schema(spark: SparkSession, inline: Mapping[str, Any] | None = None, path: str | None = None) -> dict[str, Any]:
    """Validation schema: an inline one beats a file; anything unusable is empty."""
    if isinstance(inline, Mapping):
        return dict(inline)
    if path is None:
        return {}
    document = spark.read.text(path, wholetext=True).first()
    loaded = json.loads(document[0].lstrip(BOM)) if document else {}
    return loaded if isinstance(loaded, dict) else {}


ANOMALY_FIELDS = ("id", "anomaly_uid", "column_name", "value", "error_type", "anomaly_hint")


SKIPPED = "file string, reason string"
_DAMAGED_FOOTER = ("is not a Parquet file", "can not read class", "corrupted file")  # texts of the Parquet reader


def read_anomaly_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, skipped) of all anomaly files of a folder.

    rows: (file, at, row), a map of texts per object or line; by ``file`` and ``at`` they
    stand in the order of names and of places in a file. .json, .jsonl and .csv take one
    scan each, whatever the number of files and their headers, .parquet one per schema.
    A JSON document is an array or one object; bad JSON fails. A CSV record with cells too
    many or too few keeps its text under ``S.MALFORMED``, too.

    skipped: (file, reason) of the files left out: CSV without a header and Parquet
    without a readable footer. Any other trouble, such as a store that does not answer, raises.
    """
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().toString() for s in system.listStatus(path) if s.isFile())
    by_suffix = {x: [n for n in names if n.lower().endswith(x)] for x in (".json", ".jsonl", ".csv", ".parquet")}
    parts = [spark.createDataFrame([], "file string, at bigint, row map<string,string>")]
    if by_suffix[".json"]:
        parts.append(read_json(spark, by_suffix[".json"], unwrap=False).select("file", F.col("pos").cast("bigint").alias("at"), "row"))
    if by_suffix[".jsonl"]:
        parts.append(read_jsonl(spark, by_suffix[".jsonl"]).select("file", F.monotonically_increasing_id().alias("at"), "row"))
    skipped = []
    if by_suffix[".csv"]:
        rows, headed = _read_keyed_csv(spark, by_suffix[".csv"])
        parts.append(rows)
        known = {r.file for r in headed.select("file").collect()}  # names of files that are listed here anyway
        skipped += [(n, "no header") for n in map(_base, by_suffix[".csv"]) if n not in known]
    schemas, damaged = _parquet_schemas(spark, by_suffix[".parquet"])
    skipped += damaged
    for files in schemas.values():
        rows = spark.read.parquet(*files)
        pairs = [x for c in rows.columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))]
        row = F.create_map(*pairs).cast("map<string,string>")
        parts.append(rows.select(_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), row.alias("row")))
    return reduce(DataFrame.unionByName, parts), spark.createDataFrame(sorted(skipped), SKIPPED)


def read_anomaly_directory(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of ``read_anomaly_folder``; files left out are named in a warning."""
    rows, skipped = read_anomaly_folder(spark, folder)
    for file, reason in skipped.collect():
        warnings.warn(f"{file} is left out: {reason}", stacklevel=2)
    return rows


def _base(path: str) -> str:
    return path.rsplit("/", 1)[-1]


def _parquet_schemas(spark: SparkSession, files: Sequence[str]) -> tuple[dict[str, list[str]], list[tuple[str, str]]]:
    """Files by the text of their schema, and those without a readable footer. Reads footers only."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    schemas: dict[str, list[str]] = {}
    damaged = []
    for file in files:
        try:
            source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf)
            footer = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
        except Py4JJavaError as problem:
            text = str(problem.java_exception.getMessage())
            if not any(known in text for known in _DAMAGED_FOOTER):
                raise
            damaged.append((_base(file), "no readable footer"))
            continue
        try:
            schemas.setdefault(footer.getFileMetaData().getSchema().toString(), []).append(file)
        finally:
            footer.close()
    return schemas, damaged


def _cell_count(record: Column) -> Column:
    """Cells of a CSV record, by its commas outside quotes."""
    return F.size(F.split(F.regexp_replace(record, '"[^"]*"', ""), ","))


def _read_keyed_csv(spark: SparkSession, files: list[str]) -> tuple[DataFrame, DataFrame]:
    """((file, at, row), (file, header)) of CSV files that differ in their headers; quoted line breaks are kept."""
    lines = csv_records.read_lines(spark, files)
    first = lines.where((F.col("block") == 0) & (F.trim("line") != "")).groupBy("file").agg(F.min_by("line", "at").alias("header"))
    headers = tables.cut(first.withColumn("width", _cell_count(F.col("header"))), "headers")
    most = headers.agg(F.max("width")).first()[0] or 1
    schema = ", ".join(f"_{n} string" for n in range(most))
    cells = lambda text: F.array(*(F.from_csv(F.regexp_replace(text, "\r$", ""), schema, {"escape": '"', "maxCharsPerColumn": "-1"})[f"_{n}"] for n in range(most)))
    named = headers.select("file", "width", cells(F.col("header")).alias("names"))
    rows = tables.lookup(csv_records.logical_records(lines), named, ["file"], "inner").withColumn("cells", cells(F.col("record")))
    fields = F.filter(
        F.arrays_zip(F.col("names"), F.col("cells")), lambda f, n: f["names"].isNotNull() & (F.array_position("names", f["names"]) == n + 1)
    )
    row = F.map_from_entries(F.transform(fields, lambda f: F.struct(f["names"], f["cells"])))
    odd = ~F.col("whole") | (_cell_count(F.col("record")) != F.col("width"))
    marked = F.when(odd, F.map_concat(row, F.create_map(F.lit(S.MALFORMED), "record"))).otherwise(row)
    name = F.element_at(F.split("file", "/"), -1)
    return rows.select(name.alias("file"), "at", marked.alias("row")), headers.select(name.alias("file"), "header")


def _file_name() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


def read_rule_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(doc_id, source, text, source_weight): every non-blank line of the rule files.

    The id is the file stem and the line's number among the non-blank ones.
    """
    files = spark.read.text(paths, wholetext=True).select(_file_name().alias("source"), "value")
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda v: tx.strip(v)), lambda v: v != "")
    return files.select("source", F.posexplode(lines).alias("pos", "text")).select(
        F.concat(F.regexp_replace("source", r"\.[^.]*$", ""), F.lit("_"), (F.col("pos") + 1).cast("string")).alias("id"),
        "source",
        "text",
        F.lit(S.STATIC_RULE_WEIGHT).alias("source_weight"),
        "pos",
    )
