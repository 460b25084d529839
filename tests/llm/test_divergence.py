import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from mendframe.llm import divergence

SF = "/root/testdata/sf0.001"


def slow_audit(rows, min_documents=30, top=50):
    """Rows of the audit from (text, lang, source), in exact arithmetic."""
    uses, documents, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups[lang].add(source)
        uses[lang, source].update(terms)
        documents[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in documents[lang].items() if n >= min_documents]

        def share(counts):
            total = sum(counts[t] for t in kept)
            return {t: 1 + int(Fraction(10**9 * (counts[t] + 5), total + 5 * len(kept))) for t in kept}

        whole = share(sum((uses[lang, s] for s in sources), Counter()))
        shares = {s: share(uses[lang, s]) for s in sources}
        for s, p in shares.items():
            pairs = [(-sum(abs(p[t] - q[t]) for t in kept), o.encode()) for o, q in shares.items() if o != s]
            terms = [(whole[t] - p[t], t.encode()) for t in kept if uses[lang, s][t] and p[t] > whole[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item.decode(), -v, n) for n, (v, item) in enumerate(found, 1)]
    return sorted(out)


def made_rows(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"{'Ab' if i % 7 else 'é'}{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "de", None, ""])
        source = rng.choice(["s1", "s2", "s3", "é", "z" * 30, None] if lang != "de" else ["only"])
        words = [vocabulary[min(299, int(rng.expovariate(0.02)))] for _ in range(rng.randrange(40))]
        rows.append((rng.choice([" ", "1", "\x00", "_-", "\x7f"]).join(words) if rng.random() < 0.95 else None, lang, source))
    return rows


def frame(documents, rows, extra=False):
    return documents([(i, *r) for i, r in enumerate(rows)], extra)


@pytest.mark.parametrize("groups_a_block, terms_a_block", [(64, 4096), (2, 4096), (2, 11), (1, 50)])
def test_every_cut_of_the_cube_against_brute_force(documents, groups_a_block, terms_a_block):
    rows = made_rows(400, 5)
    docs = frame(documents, rows)
    got = sorted(tuple(r) for r in divergence.audit(docs, 8, 20, groups_a_block, terms_a_block).collect())
    want = slow_audit(rows, 8, 20)
    assert got == want
    assert {r[2] for r in want} == {"pair", "term"} and len(want) > 100


def test_large_tables_take_shuffles(documents, shuffled, monkeypatch):
    monkeypatch.setattr(divergence, "PENDING", 7)
    rows = made_rows(200, 6)
    got = sorted(tuple(r) for r in divergence.audit(frame(documents, rows), 5, 10, 2, 20).collect())
    assert got == slow_audit(rows, 5, 10)


def test_odd_tables(documents):
    assert divergence.audit(documents([])).collect() == []
    rows = [(None, "en", "a"), ("", "en", "b"), ("12 3", "en", "b"), ("word", None, None), ("word " * 50_000, "en", "c")]
    docs = frame(documents, rows, extra=True).withColumn("part", F.lit("x")).withColumn("term", F.lit(1)).withColumn("a.b", F.lit(1))
    for least in (1, 30):  # without any kept term all pairs are there, at distance 0
        assert sorted(tuple(r) for r in divergence.audit(docs, least).collect()) == slow_audit(rows, least)
    same = [("equal words here", "en", s) for s in ("b", "a", "c")] * 40  # ties: by item
    assert sorted(tuple(r) for r in divergence.audit(frame(documents, same)).collect()) == slow_audit(same)


def test_shares_stay_exact_for_huge_counts(spark):
    big = 10**17 - 3
    row = spark.createDataFrame([(big, 3 * big + 1, 12_345)], "n long, total long, kept long")
    got = row.select(divergence._scaled(F.col("n"), F.col("total"), F.col("kept"))).first()[0]
    assert got == 1 + 10**9 * (big + 5) // (3 * big + 1 + 5 * 12_345)


def test_query_against_brute_force(spark):
    from mendframe.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()]
    assert sorted(tuple(r) for r in QUERIES["op13_source_divergence"](spark, SF).collect()) == slow_audit(rows)
