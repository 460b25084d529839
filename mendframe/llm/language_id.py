"""Language identification by hyperdimensional profiles."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from mendframe.llm.common import fold, map_batches, mixed

DIMENSIONS = 4_096
UNKNOWN = "und"
FOLDS, HELD_OUT = 4, 2
BUNDLE = 512  # n-gram vectors that are expanded at once
MEMO = 1 << 20  # n-grams whose similarities a worker remembers
MERGE_AT = 1 << 21  # n-grams that a worker gathers before it sums up repeats

_letters: np.ndarray | None = None
_vectors: dict[int, np.ndarray] = {}
_memo: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _is_letter(codes: np.ndarray) -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters[codes]


def letter_vector(code: int) -> np.ndarray:
    """Random +1/-1 vector of a letter, the same in every process."""
    found = _vectors.get(code)
    if found is None:
        words = mixed(np.arange(DIMENSIONS // 64, dtype=np.uint64) + np.uint64((code + 1) << 32))
        found = _vectors[code] = np.unpackbits(mixed(words).view(np.uint8)).astype(np.int8) * 2 - 1
    return found


def trigrams(text: str | None) -> np.ndarray:
    """Letter trigrams of the lower-case text, 21 bits a letter; what is no letter is one gap (0)."""
    if not text:
        return np.zeros(0, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(_is_letter(codes), codes, 0)
    if not codes.any():
        return np.zeros(0, np.int64)
    codes = np.concatenate(([0], codes, [0]))
    codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
    return (codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:]


def bound(grams: np.ndarray) -> np.ndarray:
    """n-gram vectors: letters permuted by their place and bound by multiplication."""
    made = np.ones((len(grams), DIMENSIONS), np.int8)
    for place in range(3):
        codes, at = np.unique((grams >> (21 * (2 - place))) & 0x1FFFFF, return_inverse=True)
        made *= np.stack([np.roll(letter_vector(int(c)), 2 - place) for c in codes])[at]
    return made


def bundle(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of n-gram vectors; whole numbers, so the order of adding does not matter."""
    total = np.zeros(DIMENSIONS)
    for at in range(0, len(grams), BUNDLE):
        total += counts[at : at + BUNDLE].astype(float) @ bound(grams[at : at + BUNDLE]).astype(float)
    return total


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """Prototype per language: the bundle of all its texts; docs has text and lang.

    A task sums its n-gram counts per language and bundles them once. Rows without
    language or letters teach nothing. The result is one vector per language.
    """

    def prototypes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def merge() -> None:
            for lang, parts in waiting.items():
                grams, counts = held.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                new, times = np.unique(np.concatenate(parts), return_counts=True)
                every, at = np.unique(np.concatenate((grams, new)), return_inverse=True)
                held[lang] = every, np.bincount(at, np.concatenate((counts, times)), len(every)).astype(np.int64)
            waiting.clear()

        def bundled() -> pa.RecordBatch:
            rows = {lang: bundle(*found).astype(np.int64) for lang, found in held.items()}
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.string()), pa.array([v.tolist() for v in rows.values()], pa.list_(pa.int64()))],
                ["lang", "vector"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                grams = trigrams(text.as_py())
                if len(grams):
                    waiting.setdefault(lang.as_py(), []).append(grams)
                    size += len(grams)
                if size > MERGE_AT:
                    merge()
                    size = 0
                    if sum(len(g) for g, _ in held.values()) > MERGE_AT:
                        yield bundled()
        merge()
        if held:
            yield bundled()

    partial = docs.where("lang is not null").select("lang", "text").mapInArrow(prototypes, "lang string, vector array<long>")
    summed = partial.select("lang", F.posexplode("vector").alias("at", "value")).groupBy("lang", "at").agg(F.sum("value").alias("value"))
    model: dict[str, np.ndarray] = {}
    for row in summed.collect():  # languages times DIMENSIONS numbers
        model.setdefault(row["lang"], np.zeros(DIMENSIONS))[row["at"]] = row["value"]
    return dict(sorted(model.items()))


def similarities(grams: np.ndarray, prototypes: np.ndarray, model_id: str) -> np.ndarray:
    """Inner product of each n-gram vector with each unit prototype; remembered per worker."""
    known, values = _memo.get(model_id, (np.zeros(0, np.int64), np.zeros((0, len(prototypes)), np.float64)))
    at = np.searchsorted(known, grams)
    missing = np.ones(len(grams), bool) if not len(known) else known[np.minimum(at, len(known) - 1)] != grams
    if missing.any():
        if len(known) > MEMO:
            known, values = known[:0], values[:0]
            missing = np.ones(len(grams), bool)
        new = grams[missing]
        made = np.concatenate([
            bound(new[i : i + BUNDLE]).astype(np.float64) @ prototypes.T for i in range(0, len(new), BUNDLE)
        ])
        known, values = np.concatenate((known, new)), np.concatenate((values, made))
        order = np.argsort(known)
        known, values = known[order], values[order]
        _memo.clear()
        _memo[model_id] = known, values
        at = np.searchsorted(known, grams)
    return values[at]


def cosines(text: str | None, prototypes: np.ndarray, model_id: str) -> np.ndarray | None:
    """Cosine of a document's bundle with each unit prototype; None without letters.

    The bundle is a sum, so its inner product is the sum of those of its n-grams.
    Its length follows from the counts: random n-gram vectors are orthogonal but
    for noise, so it is sqrt(DIMENSIONS * sum of squared counts). The length is the
    same for every language and does not touch their order.
    """
    grams = trigrams(text)
    if not len(grams):
        return None
    grams, counts = np.unique(grams, return_counts=True)
    length = np.sqrt(DIMENSIONS * float(counts.astype(float) @ counts))
    return counts @ similarities(grams, prototypes, model_id) / length


def predict(docs: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; only its text is looked at.

    ``score`` is the cosine with the nearest prototype, cut to 0..1. A text that is
    NULL or has no letter is ``und`` with score 0, and so is every text when nothing
    was learned; of equal cosines the first language in code-point order wins.
    """
    langs = list(model)
    model_id = uuid.uuid4().hex
    units = np.array([v / (np.linalg.norm(v) or 1.0) for v in model.values()]).reshape(len(langs), DIMENSIONS)
    sent = docs.sparkSession.sparkContext.broadcast(units)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        preds, scores = [], []
        for text in batch.column(2):
            found = cosines(text.as_py(), sent.value, model_id) if langs else None
            if found is None:
                preds.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(np.argmax(found))
                preds.append(langs[best])
                scores.append(float(min(1.0, max(0.0, found[best]))))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(scores, pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )

    rows = docs.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "text")
    return map_batches(rows, judged, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents outside the held-out fold, then predict all of them."""
    return predict(docs, learn(docs.where(fold(F.col("doc_id"), FOLDS) != HELD_OUT)))
