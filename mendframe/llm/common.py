"""Shared pieces: words, folds, sizes, Python-side batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BLANKS = "\t\n\x0b\x0c\r "  # what separates words
LOWER_ASCII = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BATCH_ROWS = 1_000  # rows of text per Arrow batch; bounds a Python worker's memory


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(rows: DataFrame, **named: Column) -> DataFrame:
    """The columns of ``rows`` in one struct ``_in``, beside named expressions over them.

    Operators work on their own names only, so no column of the caller can clash.
    """
    return rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_in"), *(e.alias(n) for n, e in named.items()))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+``; NULL text gives none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), BLANKS, " " * len(BLANKS))
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a NULL id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts).cast("int")


def ascii_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lower-cased.

    ``bytes.split`` separates at exactly 0x20 and 0x09-0x0D.
    """
    return text.encode().translate(LOWER_ASCII).split() if text else []


def flat_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts one after another, and how many each text has; NULL has none."""
    split = pc.ascii_split_whitespace(texts)  # at 0x20 and 0x09-0x0D; blanks at an end leave an empty word
    flat, lengths = split.flatten(), pc.fill_null(split.value_lengths(), 0).to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)
    upto = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    edges = np.concatenate(([0], np.cumsum(lengths)))
    return flat.filter(real), np.diff(upto[edges])


def map_batches(rows: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | T.StructType) -> DataFrame:
    """Apply a function to every Arrow batch, cut to a bounded number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                made = function(batch.slice(start, BATCH_ROWS))
                if made is not None and made.num_rows:
                    yield made

    return rows.mapInArrow(run, schema)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every bit (constants of SplitMix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
