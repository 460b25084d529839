import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from mendframe.llm import periodic_runs

SF = "/root/testdata/sf0.001"


def slow_runs(x, exponent=4, shortest=6):
    """Every maximal stretch of every period, the smallest period of a place first."""
    found, n = {}, len(x)
    for q in range(1, n // exponent + 1):
        start = 0
        while start + q < n:
            end = start + q
            while end < n and x[end] == x[end - q]:
                end += 1
            if end - start >= max(shortest, exponent * q):
                found.setdefault((start, end), q)
            start = max(end - q + 1, start + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def slow_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = slow_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(left).hexdigest(),
    )


def sequences():
    rng = random.Random(11)
    for _ in range(250):
        yield [rng.randrange(rng.choice([1, 2, 3, 30])) for _ in range(rng.randrange(0, 90))]
    for _ in range(250):  # periodic stretches side by side, some over a shared edge
        made = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.randrange(4) for _ in range(rng.randrange(1, 12))]
            made += (unit * 9)[: rng.randrange(1, 9 * len(unit))]
        yield made
    yield [0] * 500
    yield [0, 0, 1] * 200 + [0] * 300


def test_runs_against_every_period():
    total = 0
    for x in sequences():
        want = slow_runs(x)
        assert periodic_runs.runs_of([str(w).encode() for w in x]) == want
        total += len(want)
    assert total > 300


def test_words_appended_piece_by_piece():
    """Runs are right after every piece, and go on when the next piece extends them."""
    rng = random.Random(12)
    for x in list(sequences())[::7]:
        catcher, known = periodic_runs.SquareCatcher(), 0
        while known < len(x):
            more = rng.randrange(1, 40)
            catcher.append(np.array(x[known : known + more]))
            known = min(len(x), known + more)
            assert catcher.runs() == slow_runs(x[:known])


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(periodic_runs, "APPENDED", 13)
    for x in list(sequences())[::5]:
        assert periodic_runs.runs_of([str(w).encode() for w in x]) == slow_runs(x)


def test_a_wrong_polynomial_is_noticed(monkeypatch):
    """With all polynomials equal to begin with, the words decide and another polynomial is taken."""
    right = periodic_runs.SquareCatcher._hashes

    def wrong(self, at, length):
        return right(self, at, length) * (self.attempt > 1)

    monkeypatch.setattr(periodic_runs.SquareCatcher, "_hashes", wrong)
    x = [0, 1, 2] * 6 + [5, 6, 7, 8] + [3] * 9 + [1, 4]
    assert periodic_runs.runs_of([str(w).encode() for w in x]) == slow_runs(x)


def test_other_limits():
    for x in list(sequences())[::9]:
        words = [str(w).encode() for w in x]
        assert periodic_runs.runs_of(words, 3, 2) == slow_runs(x, 3, 2)
        assert periodic_runs.runs_of(words, 5, 20) == slow_runs(x, 5, 20)
    with pytest.raises(ValueError):
        periodic_runs.SquareCatcher(exponent=2)


def test_query_against_brute_force(spark):
    from mendframe.llm.queries import QUERIES

    got = {r["doc_id"]: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    planted = 0
    for doc_id, text in rows:
        if len((text or "").split()) > 1500:
            continue  # too slow for brute force
        assert got[doc_id] == slow_row(doc_id, text)
        planted += zlib.crc32(str(doc_id).encode()) % 10 == 0
    assert planted > 5


def test_odd_rows(spark, documents):
    long_text = "x y z " * 30_000 + "end"
    texts = [None, "", " \n\t", "a", "a a a a a a", "a a a a a", "b b b b b b\x0bü", "A a A a A a A a", long_text]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "q q q q q q q"), (4, "a a a a a a"), (4, "other words")]
    docs = documents(rows, extra=True).withColumn("runs", F.lit("x")).withColumn("a.b", F.lit(1))
    got = sorted((tuple(r) for r in periodic_runs.digest_runs(docs, F.col("text")).collect()), key=str)

    def plain(doc_id, text):
        words = (text or "").split()
        runs = [(0, 90_000, 3)] if len(words) > 100 else slow_runs(words)  # the long text repeats "x y z" to its end
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in runs)]
        best = max(runs, key=lambda r: Fraction(r[1], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
                hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(" ".join(kept).encode()).hexdigest())

    assert got == sorted((plain(*r) for r in rows), key=str)
    assert periodic_runs.digest_runs(documents([]), F.col("text")).collect() == []
    planted = documents(rows).select("doc_id", "text", periodic_runs.with_planted_tails(F.col("text"), F.col("doc_id")).alias("t"))
    assert all(len((r.t or "").split()) == len((r.text or "").split()) for r in planted.collect())
