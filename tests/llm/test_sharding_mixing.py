import zlib
from collections import defaultdict

import numpy as np
import pytest

from mendframe.llm import mixing, sharding

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("rows", [1, 2, 3, 24, 25, 1000, 4097])
def test_permutation_is_one_and_can_be_undone(rows):
    numbers = np.arange(rows)
    moved = sharding.permute(numbers, rows, 3)
    assert sorted(moved) == list(range(rows))
    assert (sharding.permute(moved, rows, 3, backwards=True) == numbers).all()
    for n in range(0, rows, 97):
        assert sharding.row_at(*sharding.place(n, rows), rows) == n


def test_shards_are_even_gapless_and_independent_of_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sharding.shard_documents(docs).collect()
    again = sharding.shard_documents(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)
    slots = defaultdict(list)
    texts = {d.doc_id: d.text for d in docs.collect()}
    for r in rows:
        slots[r.shard].append(r.slot)
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots[i]) for i in range(24)]
    assert max(counts) - min(counts) <= 1
    by_id = sorted(r.doc_id for r in rows)
    placed = {r.doc_id: (r.shard, r.slot) for r in rows}
    assert all(placed[d] == sharding.place(n, len(by_id)) for n, d in enumerate(by_id))


def test_sharding_odd_rows(spark, documents):
    rows = [(1, None), (1, None), (None, ""), (None, "é"), (2, "x" * 100_000)]
    found = sharding.shard_documents(documents(rows, extra=True), shards=2).collect()
    assert sorted((r.shard, r.slot) for r in found) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]
    assert sharding.shard_documents(documents([])).count() == 0


def fair_targets(sizes, weights=(5, 2, 1), most=3):
    """The contract's rule, literally: stop, reshare the excess by weight, repeat."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    names += [None] if None in sizes else []
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, full = sum(sizes.values()), dict.fromkeys(names, 0.0), set()
    rest = float(total)
    while rest > 1e-9 * max(1, total) and len(full) < len(names):
        share = rest / sum(weight[s] for s in names if s not in full)
        rest = 0.0
        for s in names:
            if s not in full:
                target[s] += share * weight[s]
                if target[s] >= most * sizes[s]:
                    rest += target[s] - most * sizes[s]
                    target[s] = float(most * sizes[s])
                    full.add(s)
    return target


def check_mix(rows):
    sizes, sums = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += r.size
        sums[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = fair_targets(dict(sizes))
    longest = defaultdict(int)
    for r in rows:
        longest[r.source] = max(longest[r.source], r.size)
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
    for s in sizes:
        assert abs(sums[s] - want[s]) <= longest[s] + 1


def with_source(docs):
    from pyspark.sql import functions as F

    mixed = mixing.mix(docs)
    return mixed.select("source", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken")).collect()


def test_mixture_reaches_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_mix(with_source(docs))
    first = sorted(map(tuple, mixing.mix_documents(docs).collect()))
    assert first == sorted(map(tuple, mixing.mix_documents(docs.repartition(5)).collect()))
    copies = mixing.repeated(mixing.mix(docs))
    assert copies.columns == docs.columns
    words = sum(len((r.text or "").split()) for r in copies.select("text").collect())
    assert abs(words - sum(r[4] for r in first)) < 50  # str.split knows more blanks than the contract


def test_mixture_of_odd_sources(spark, documents):
    rows = [(i, "w " * (i % 40), "en", "tiny" if i < 3 else "Z" if i < 20 else "big" if i % 3 else None) for i in range(400)]
    rows += [(500, None, "en", "empty"), (501, "", "en", "empty"), (7, "a b", "en", "Z"), (7, "a b", "en", "Z"), (None, "c d", None, None)]
    found = with_source(documents(rows, extra=True))
    assert len(found) == len(rows)
    repeats = [r.taken for r in found if r.source == "Z" and r.size == 2]
    assert len(set(repeats[-2:])) == 1
    sizes = defaultdict(int)
    for r in found:
        sizes[r.source] += r.size
    want = fair_targets(dict(sizes))
    for r in found:
        assert r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6) and r.taken <= 3 * r.size
    assert with_source(documents([])) == []
    assert [r.taken for r in with_source(documents([(1, None, "en", "a")]))] == [0]


def test_one_hot_source_and_boundary_rows(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKETS", 4)
    rows = [(i, "w " * (1 + i * 7 % 90), "en", "hot" if i % 3 else f"s{i % 7}") for i in range(600)]
    check_mix(with_source(documents(rows)))
