"""Blocks of the top-k search."""

import numpy as np
import pandas as pd

from mendframe.functions import blocks


def test_first_places_equal_a_stable_sort():
    rng = np.random.default_rng(3)
    for k in (1, 2, 4, 16, 17, 40):
        scores = rng.integers(0, 6, (50, 40)).astype(float)  # many ties
        assert np.array_equal(blocks.first_places(scores, k), np.argsort(-scores, axis=1, kind="stable")[:, :k])
    odd = np.array([[1.0, np.nan, 2.0], [-np.inf, 0.0, -np.inf]])
    assert np.array_equal(blocks.first_places(odd, 2), np.argsort(-odd, axis=1, kind="stable")[:, :2])


def test_docs_are_prepared_once_for_all_slices_of_queries(monkeypatch):
    rng = np.random.default_rng(4)
    docs = pd.DataFrame({"vector": [*rng.normal(size=(30, 5)), None, np.zeros(5)]})
    queries = pd.DataFrame({"vector": [*rng.normal(size=(8, 5)), None]})
    made, unit = [], blocks._unit
    monkeypatch.setattr(blocks, "_unit", lambda vectors, width: made.append(len(vectors)) or unit(vectors, width))
    score = blocks.vector_scores()
    against = score.prepare(docs)
    parts = [against(queries.iloc[i : i + 3]) for i in range(0, 9, 3)]
    assert made == [32, 3, 3, 3]
    assert np.array_equal(np.concatenate(parts).round(12), score(queries, docs).round(12))
