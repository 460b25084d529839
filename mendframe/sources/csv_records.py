"""CSV with line breaks inside quotes, split into many tasks like any other text.

Whether a physical line begins a record depends on all quotes before it in its file. A line
maps "a quoted cell is open before it" to the same after it; such maps have two inputs, so
they compose like numbers add up: first within blocks of a file, then over the blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from mendframe import settings as S
from mendframe.functions import tables

MAX_LINES = 10_000  # lines of one record; a cell that never closes would take the rest of its file

_OUT, _IN, _CLOSED = range(3)


def ends_open(line: Column, begins_open: bool) -> Column:
    """Whether a quoted cell is open behind a line, given whether one is before it.

    A quote opens a cell at its beginning only, closes an open one, and stands for itself
    as a pair in a cell and anywhere else in an unquoted cell.
    """
    parts = F.split(line, '"')

    def after_quote(state: Column, text: Column) -> Column:
        """State behind a quote, from the text between it and the quote before."""
        at, first = state["at"], state["first"]
        opens = text.endswith(",") | (text == "") & ((at == _CLOSED) | (first & (at == _OUT)))
        after = F.when(at == _IN, _CLOSED).when(opens, _IN).otherwise(_OUT)
        return F.struct(after.alias("at"), F.lit(False).alias("first"))

    start = F.struct(F.lit(_IN if begins_open else _OUT).alias("at"), F.lit(True).alias("first"))
    walked = F.aggregate(F.slice(parts, 1, F.size(parts) - 1), start, after_quote, lambda s: s["at"] == _IN)
    return F.when(line.contains('"'), walked).otherwise(F.lit(begins_open))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, block, at, line): physical lines with their file, its split, and a number that grows along each split."""
    lines = spark.read.text(path, lineSep="\n")
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"), F.ltrim("value", F.lit("﻿")).alias("line"),
    )


def _running(rows: DataFrame, keys: Sequence[str], order: str, closed: str, opened: str) -> DataFrame:
    """Add ``_swaps`` and ``_fixed`` of all rows before the current one, see ``_state``."""
    window = Window.partitionBy(*keys).orderBy(order)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col(closed) & ~F.col(opened)).cast("int")
    numbered = rows.withColumn("_upto", F.sum(swap).over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    settled = F.when(F.col(closed) == F.col(opened), F.struct(F.col(closed).alias("open"), F.col("_upto").alias("swaps")))
    return numbered.withColumns({
        "_swaps": F.coalesce(F.lag("_upto").over(window), F.lit(0)),
        "_fixed": F.last(settled, ignorenulls=True).over(earlier),
    }).drop("_upto")


def _state(start: Column) -> Column:
    """Whether a cell is open before a row: the last row that ends the same either way decides, swaps count since then."""
    since = F.col("_swaps") - F.coalesce(F.col("_fixed.swaps"), F.lit(0))
    return F.coalesce(F.col("_fixed.open"), start) != (since % 2 == 1)


def logical_records(lines: DataFrame, max_lines: int = MAX_LINES) -> DataFrame:
    """(file, at, record, whole) of physical lines; headers and blank lines outside quotes are left out.

    A record of several lines is put together from the few lines that are part of one. Each
    line of a record of more than ``max_lines`` lines is a record of its own that is not ``whole``.
    """
    split = ["file", "block"]
    judged = lines.withColumns({"closed": ends_open(F.col("line"), False), "opened": ends_open(F.col("line"), True)})
    judged = _running(judged, split, "at", "closed", "opened").withColumn(
        "header", (F.col("block") == 0) & (F.col("at") == F.min(F.when(F.trim(F.col("line")) != "", F.col("at"))).over(Window.partitionBy(*split)))
    )
    judged = tables.cut(judged, "lines")

    def after(start: bool) -> Column:
        return F.when(_state(F.lit(start)), F.col("opened")).otherwise(F.col("closed"))

    ends = judged.groupBy(*split).agg(
        F.max_by(after(False), "at").alias("closed"), F.max_by(after(True), "at").alias("opened")
    )
    starts = tables.cut(_running(ends, ["file"], "block", "closed", "opened").select(*split, _state(F.lit(False)).alias("start")), "starts")
    known = tables.lookup(judged, starts, split, "inner").withColumn("open", _state(F.col("start"))).select(
        *split, "at", "line", "open", F.when(F.col("open"), F.col("opened")).otherwise(F.col("closed")).alias("stays"), "header"
    )
    single = known.where(~F.col("open") & ~F.col("stays") & ~F.coalesce("header", F.lit(False)) & (F.trim("line") != ""))
    several = tables.cut(known.where(F.col("open") | F.col("stays")), "several")
    begins = F.when(~F.col("open"), F.struct("at", F.coalesce("header", F.lit(False)).alias("header")))
    in_block = Window.partitionBy(*split).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = several.withColumn("own", F.last(begins, ignorenulls=True).over(in_block))
    last = several.groupBy(*split).agg(F.max(begins).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = tables.cut(last.select(*split, F.last("last", ignorenulls=True).over(before).alias("carried")), "carried")
    placed = tables.lookup(placed, carried, split, "inner").select(
        "file", "block", "at", "line", F.coalesce("own", "carried").alias("first")
    ).where(~F.col("first.header"))
    placed = tables.cut(placed, "placed")
    sizes = placed.groupBy("file", "first").agg(F.count("*").alias("n"))
    endless = tables.cut(sizes.where(F.col("n") > max_lines).select("file", "first"), "endless")
    bounded = tables.lookup(placed, endless, ["file", "first"], "left_anti")
    joined = bounded.groupBy("file", "first").agg(F.array_sort(F.collect_list(F.struct("block", "at", "line"))).alias("l")).select(
        "file", F.col("first.at").alias("at"), F.array_join("l.line", "\n").alias("record"), F.lit(True).alias("whole")
    )
    loose = tables.lookup(placed, endless, ["file", "first"], "left_semi").select("file", "at", F.col("line").alias("record"), F.lit(False).alias("whole"))
    return single.select("file", "at", F.col("line").alias("record"), F.lit(True).alias("whole")).unionByName(joined).unionByName(loose)


def parse_records(records: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The cells of (record, whole) under the columns, with the text of malformed records in ``S.MALFORMED``."""
    fields = [T.StructField(f"_{n}", T.StringType()) for n in range(len(columns))]
    schema = T.StructType([*fields, T.StructField(S.MALFORMED, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": S.MALFORMED, "escape": '"', "maxCharsPerColumn": "-1"}
    bare = F.regexp_replace("record", "\r$", "")
    cells = F.from_csv(bare, schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options)
    return records.withColumn("_cells", cells).select(
        *(F.col(f"_cells._{n}").alias(c) for n, c in enumerate(columns)),
        F.when(~F.col("whole") | F.col(f"_cells.{S.MALFORMED}").isNotNull(), F.col("record")).alias(S.MALFORMED),
    )


def read_csv_records(
    spark: SparkSession, path: str | list[str], columns: Sequence[str] | None = None, max_lines: int = MAX_LINES
) -> DataFrame:
    """Header CSV as text cells, in tasks of bounded size whatever the files and their quoted line breaks.

    ``S.MALFORMED`` holds the text of a record with more or fewer cells than the header,
    or of a line from a cell that does not close within ``max_lines`` lines; no line is dropped.
    Line breaks inside quotes are kept as they are. A header must not have line breaks.
    """
    if columns is None:
        columns = spark.read.csv(path, header=True, inferSchema=False, escape='"').columns
    return parse_records(logical_records(read_lines(spark, path), max_lines), columns)
