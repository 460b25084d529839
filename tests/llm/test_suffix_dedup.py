import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendframe.llm import suffix_dedup

SF = "/root/testdata/sf0.001"


def slow_cover(texts, span):
    """Per text a mask of the bytes under a string of ``span`` bytes that starts at two places or more."""
    starts = defaultdict(list)
    for n, data in enumerate(texts):
        for i in range(len(data) - span + 1):
            starts[data[i : i + span]].append((n, i))
    masks = [np.zeros(len(data), bool) for data in texts]
    for places in starts.values():
        if len(places) > 1:
            for n, i in places:
                masks[n][i : i + span] = True
    return masks


def slow_rows(rows, span):
    texts = [(t or "").encode() for _, t in rows]
    out = []
    for (doc_id, _), data, mask in zip(rows, texts, slow_cover(texts, span)):
        kept = bytes(np.frombuffer(data, np.uint8)[~mask])
        spans = int((np.diff(np.concatenate([[0], mask.astype(int)])) == 1).sum())
        out.append((doc_id, len(data), int(mask.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def judged(docs, span, gram):
    rows = suffix_dedup.without_repeated(docs, F.col("text"), span, gram).collect()
    out = []
    for r in rows:
        assert all(a["end"] < b["start"] for a, b in zip(r.spans, r.spans[1:]))
        removed = sum(s["end"] - s["start"] for s in r.spans)
        assert removed + len(r.kept) == r.n_bytes
        out.append((r["_in"]["doc_id"], r.n_bytes, removed, len(r.spans), hashlib.sha256(bytes(r.kept)).hexdigest()))
    return sorted(out, key=str)


def test_order_of_suffixes():
    rng = random.Random(21)
    for _ in range(200):
        pieces = [bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcd\x00\xc3") for _ in range(rng.randrange(8, 40))) for _ in range(9)]
        data = np.frombuffer(b"".join(p + b"\xff" for p in pieces), np.uint8)
        whole, depth, at, wanted = bytes(data), 8, 0, []
        for p in pieces:
            wanted += range(at, at + len(p) - depth + 1)
            at += len(p) + 1
        order = suffix_dedup.suffix_order(data, np.array(wanted), depth)
        assert sorted(order.tolist()) == wanted
        strings = [whole[i : i + depth] for i in order.tolist()]
        assert strings == sorted(strings)
        common = suffix_dedup.common_prefixes(data, order, depth, step=3)
        for a, b, n in zip(strings, strings[1:], common.tolist()):
            assert n == next((i for i in range(depth) if a[i] != b[i]), depth)


def test_only_rising_suffixes_are_sorted_directly():
    data = np.frombuffer(b"cbaabbc\xff", np.uint8)
    want = [bytes(data[i:]) < bytes(data[i + 1 :]) for i in range(len(data))]
    want[-1] = False
    assert suffix_dedup._rises(data).tolist() == want


def test_windows_of_pieces():
    rng = random.Random(22)
    for _ in range(60):
        unit = bytes(rng.choice(b"abc") for _ in range(60))
        pieces = [unit[rng.randrange(20) : rng.randrange(40, 60)] + bytes(rng.choice(b"xyz") for _ in range(rng.randrange(20))) for _ in range(8)]
        pieces = list(dict.fromkeys(p for p in pieces if len(p) >= 20))
        places = defaultdict(list)
        for n, p in enumerate(pieces):
            for i in range(len(p) - 19):
                places[p[i : i + 20]].append((n, i))
        want = sorted(x for xs in places.values() if len(xs) > 1 for x in xs)
        got = suffix_dedup.repeated_windows(pieces, 20)
        assert [(n, i) for n, hits in enumerate(got) for i in hits.tolist()] == want


def test_anchors_depend_on_content_alone(monkeypatch):
    rng = random.Random(23)
    shared = bytes(rng.randrange(97, 123) for _ in range(300))
    a, b = b"q" * 77 + shared + b"w" * 50, bytes(rng.randrange(97, 123) for _ in range(131)) + shared

    def per_window(data):
        return {s: (place - s, gram) for place, first, past, gram in suffix_dedup.anchors(data, 60, 20) for s in range(first, past - 59)}

    for read in (1 << 18, 50):
        monkeypatch.setattr(suffix_dedup, "READ", read)
        suffix_dedup._powers.cache_clear()
        x, y = per_window(a), per_window(b)
        assert sorted(x) == list(range(len(a) - 59)) and sorted(y) == list(range(len(b) - 59))
        assert all(x[77 + i] == y[131 + i] for i in range(241))
    suffix_dedup._powers.cache_clear()


def made_texts(rng, n, passage):
    """Texts with shared passages in different company, copies, near copies and periodic stretches."""
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(passage) for _ in range(4)]
    texts = []
    for i in range(n):
        kind = i % 8
        if kind < 4:
            texts.append(prose(rng.randrange(30)) + shared[kind] + prose(rng.randrange(30)))
        elif kind == 4:
            texts.append(rng.choice([prose(40), "ab" * rng.randrange(60), "x" * 90, shared[0][:50]]))
        elif kind == 5 and texts:
            old = rng.choice(texts)
            at = rng.randrange(len(old) + 1)
            texts.append(old[:at] + rng.choice(["", "-", "neu "]) + old[at + rng.randrange(2) :])
        elif kind == 6 and texts:
            texts.append(rng.choice(texts))
        else:
            texts.append(shared[1] + prose(3) + shared[1] + shared[2])
    return texts


@pytest.mark.parametrize("pieces, big", [(1_024, False), (3, False), (2, True)])
def test_against_every_window(documents, monkeypatch, request, pieces, big):
    """Also where grams have too many pieces, down to single windows, and where tables are too large to broadcast."""
    if big:
        request.getfixturevalue("shuffled")
    monkeypatch.setattr(suffix_dedup, "PIECES", pieces)
    rows = list(enumerate(made_texts(random.Random(24), 70 if big else 130, 14)))
    got = judged(documents(rows), 40, 16)
    want = slow_rows(rows, 40)
    assert got == want
    assert sum(r[2] > 0 for r in want) > len(rows) / 3 and any(0 < r[2] < r[1] for r in want)


def test_pieces_split_to_single_windows(documents, monkeypatch):
    """One passage in different company in every text: any two share it and nothing beyond."""
    monkeypatch.setattr(suffix_dedup, "PIECES", 1)
    rng = random.Random(25)
    letters = lambda k: "".join(rng.choice("abcdefgh") for _ in range(k))
    passage = letters(45)
    rows = [(i, letters(30) + passage + letters(30)) for i in range(12)]
    rows += [(20 + i, rows[i][1][:50] + letters(40)) for i in range(6)]
    assert judged(documents(rows), 40, 16) == slow_rows(rows, 40)


def test_odd_rows(documents):
    long_text = " ".join(str(i) for i in range(60_000))
    rows = [(1, None), (2, ""), (3, "x" * 39), (4, "y" * 40), (5, "y" * 40), (5, "z" * 41), (None, "é" * 30), (None, None)]
    rows += [(6, "ab" * 19 + "c"), (7, "ab" * 19 + "c"), (8, "ab" * 19 + "d")]
    docs = documents(rows, extra=True).withColumn("spans", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("text2", F.lit(2))
    assert judged(docs, 40, 16) == slow_rows(rows, 40)
    assert judged(documents([]), 40, 16) == []
    assert suffix_dedup.digest_repeated(documents([])).collect() == []
    tail = [(1, long_text), (2, "head " + long_text[100_000:200_000]), (3, long_text[-500:])]
    got = {r[0]: r[1:4] for r in judged(documents(tail), 400, 160)}
    assert got[1] == (len(long_text), 100_500, 2)
    assert got[2][1] in range(100_000, 100_002) and got[3] == (500, 500, 1)
    with pytest.raises(ValueError):
        suffix_dedup.without_repeated(documents([]), F.col("text"), 100, 100)


def test_query_against_every_window(spark):
    from mendframe.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in QUERIES["op12_suffix_array_dedup"](spark, SF).collect()), key=str)
    assert got == slow_rows(rows, 400)
    assert sum(r[2] for r in got) > 10_000
