"""Vector expressions over ``array<double>`` and text encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

HASH_DIMENSIONS = 32  # one per digest byte


def hash_vector(text: Column) -> Column:
    """Deterministic vector of the 32 SHA-256 digest bytes scaled to 0..1."""
    # the outer one-element transform binds the digest once per row
    return F.transform(
        F.array(F.sha2(text, 256)),
        lambda digest: F.transform(
            F.sequence(F.lit(0), F.lit(HASH_DIMENSIONS - 1)),
            lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / F.lit(255.0),
        ),
    )[0]


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(
        F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")),
        F.lit(0.0),
        lambda total, item: total + item,
    )


def norm(vector: Column) -> Column:
    """Euclidean length, with 1.0 standing in for a zero vector."""
    length = F.sqrt(dot(vector, vector))
    return F.when(length == 0.0, F.lit(1.0)).otherwise(length)


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / (norm(left) * norm(right))


def mean_vectors(rows: DataFrame, key: str, vector: str, weight: Column | None = None) -> DataFrame:
    """(Weighted) mean vector per key as ``centroid``.

    Sums are taken per (key, position), so a hot key is combined map-side and
    only one value per key and position is shuffled.
    """
    weight = F.lit(1.0) if weight is None else weight.cast("double")
    cells = rows.select(key, weight.alias("_w"), F.posexplode(vector).alias("_pos", "_x"))
    means = cells.groupBy(key, "_pos").agg(
        (F.sum(F.col("_x").cast("double") * F.col("_w")) / F.sum("_w")).alias("_mean")
    )
    # one entry per dimension: the collected list is as long as a vector
    return means.groupBy(key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_pos", "_mean"))), lambda cell: cell["_mean"]
        ).alias("centroid")
    )


def embed_hash(rows: DataFrame, text: str, output: str = "vector") -> DataFrame:
    """Add the digest vector of a text column."""
    return rows.withColumn(output, hash_vector(F.col(text)))


def embed_terms(rows: DataFrame, text: str, output: str = "vector", dimensions: int = 256) -> DataFrame:
    """Add an L2-normalised hashed term vector (words and word pairs).

    Hashing needs no fitted vocabulary, so equal texts get equal vectors in
    every run and batch.
    """
    steps = ("_raw", "_words", "_pairs", "_terms", "_counts", "_unit")
    words = RegexTokenizer(inputCol="_raw", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+")
    pairs = NGram(n=2, inputCol="_words", outputCol="_pairs")
    counts = HashingTF(inputCol="_terms", outputCol="_counts", numFeatures=dimensions)
    unit = Normalizer(inputCol="_counts", outputCol="_unit")
    split = pairs.transform(words.transform(rows.withColumn("_raw", F.coalesce(F.col(text), F.lit("")))))
    terms = split.withColumn("_terms", F.concat("_words", "_pairs"))
    return unit.transform(counts.transform(terms)).withColumn(output, vector_to_array("_unit")).drop(*steps)


def embed_with(load_encoder: Callable[[], Callable[[list[str]], np.ndarray]]) -> Callable[..., DataFrame]:
    """Embedder around a caller's batch encoder.

    ``load_encoder`` runs once per Python worker task and returns a function
    from a list of texts to a matrix; rows come back L2-normalised.
    """

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load_encoder()
        for texts in batches:
            matrix = np.asarray(encoder(texts.fillna("").tolist()), dtype=float)
            lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
            yield pd.Series(list(matrix / np.where(lengths == 0, 1.0, lengths)))

    def embed(rows: DataFrame, text: str, output: str = "vector") -> DataFrame:
        return rows.withColumn(output, encode(F.col(text)))

    return embed
