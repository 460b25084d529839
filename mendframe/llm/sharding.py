"""Reproducible shuffle into shards: a Feistel permutation over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from mendframe.functions import tables
from mendframe.llm.common import mixed, packed

SHARDS = 24
SEED = 20_240_101
ROUNDS = 6  # even, so that both halves end at their own width


def _halves(rows: int) -> tuple[int, int]:
    bits = max(2, (rows - 1).bit_length())
    return bits // 2, bits - bits // 2


def _round(half: np.ndarray, number: int, seed: int, width: int) -> np.ndarray:
    key = np.uint64((seed * ROUNDS + number) * 0x9E3779B97F4A7C15 % (1 << 64))
    with np.errstate(over="ignore"):
        return mixed(half + key) & np.uint64((1 << width) - 1)


def _network(x: np.ndarray, rows: int, seed: int, backwards: bool) -> np.ndarray:
    """One pass of the Feistel network over [0, 2**bits), the smallest such range that holds all rows."""
    left_bits, right_bits = _halves(rows)
    left, right = x >> np.uint64(right_bits), x & np.uint64((1 << right_bits) - 1)
    for number in range(ROUNDS):
        if backwards:
            width = right_bits if number % 2 == 0 else left_bits
            left, right = right ^ _round(left, ROUNDS - 1 - number, seed, width), left
        else:
            width = left_bits if number % 2 == 0 else right_bits
            left, right = right, left ^ _round(right, number, seed, width)
    return (left << np.uint64(right_bits)) | right


def permute(numbers: np.ndarray, rows: int, seed: int = SEED, backwards: bool = False) -> np.ndarray:
    """Where the permutation of [0, rows) takes each number; ``backwards`` undoes it.

    Cycle walking: a result outside the range goes through the network again
    until it falls inside. The network's range is below twice the rows, so two
    passes are expected at most.
    """
    x = np.asarray(numbers, np.int64).astype(np.uint64)
    waiting = np.arange(len(x))
    while len(waiting):
        x[waiting] = _network(x[waiting], rows, seed, backwards)
        waiting = waiting[x[waiting] >= np.uint64(rows)]
    return x.astype(np.int64)


def place(number: int, rows: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """(shard, slot) of a global row number, without touching the data."""
    return divmod(int(permute(np.array([number]), rows, seed)[0]), shards)[::-1]


def row_at(shard: int, slot: int, rows: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The global row number that lies in a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), rows, seed, backwards=True)[0])


def stored_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus eight for its length field; NULL is no bytes."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shard(docs: DataFrame, order: list[Column], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` plus ``_row`` (global row number from 0), ``_shard`` and ``_slot``.

    Rows are numbered in the order of the ``order`` columns (NULLs first), so
    a rerun over the same rows agrees whatever their partitions; rows equal in
    all of them are interchangeable and spread over tasks. Row number n goes to
    permuted place p, shard ``p % shards``, slot ``p // shards``: shard sizes
    are at most one row apart and slots have no gaps. An empty table stays
    empty; with fewer rows than shards some shards have no row.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    keys = {f"key{i}": column for i, column in enumerate(order)}
    ordered = packed(docs, **keys).orderBy(*keys, F.monotonically_increasing_id()).drop(*keys)
    numbered = tables.number_positions(tables.cut(tables.with_partition_position(ordered), "ordered"), "_row")
    rows = docs.count()

    @F.pandas_udf("long")
    def place_of(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), rows, seed))

    return (
        numbered.withColumn("_row", F.col("_row") - 1)
        .withColumn("_place", place_of("_row"))
        .withColumn("_shard", (F.col("_place") % shards).cast("int"))
        .withColumn("_slot", F.floor(F.col("_place") / shards).cast("long"))
        .select("_in.*", "_row", "_shard", "_slot")
    )


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    NULL texts count as no bytes, with the checksum of no bytes. Rows are
    ordered by id, then checksum and size; rows that agree in all three get
    neighbouring numbers, in any order. ``law`` is ``rows``; a permutation of
    all row numbers says nothing about one more shard, so ``grown_shard`` is NULL.
    """
    keyed = docs.select(
        "doc_id",
        stored_size(F.col("text")).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard(keyed, [F.col("doc_id"), F.col("text_crc32"), F.col("size")], shards, seed)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
