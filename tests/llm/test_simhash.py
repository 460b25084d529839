import random

import pytest
import xxhash

from mendframe.llm import simhash
from mendframe.llm.components import components


def slow_fingerprint(text, k=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(values, distance):
    """Brute force: smallest member that single links reach."""
    label = {v: v for v in values}

    def find(v):
        while label[v] != v:
            v = label[v]
        return v

    values = sorted(values)
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {v: find(v) for v in values}


def test_fingerprint_of_odd_texts():
    rng = random.Random(1)
    texts = [None, "", " \t\n", "one", "Two WORDS", "a b c d", "É é A a  x", "x " * 70_000]
    texts += [" ".join(rng.choice("aBcdé") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))) for _ in range(100)]
    for text in texts:
        assert simhash.fingerprint(text) == slow_fingerprint(text)
    assert simhash.fingerprint(None) == 0


@pytest.mark.parametrize("distance", [0, 1, 2, 4, 6])
def test_links_join_what_brute_force_joins(spark, distance):
    rng = random.Random(distance)
    values = {0, 1, (1 << 64) - 1}
    for _ in range(60):  # chains and dense balls
        v = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            values.add(v)
            for _ in range(rng.randint(0, distance + 1)):
                v ^= 1 << rng.randrange(64)
    ball = rng.getrandbits(64)
    values |= {ball ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(200)}
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), distance)
    pairs = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links.collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in pairs)
    roots = {r.node % (1 << 64): r.root for r in components(links).collect()}
    want = groups(values, distance)
    same = {}
    for v in values:
        same.setdefault(roots.get(v, ("alone", v)), set()).add(v)
    expected = {}
    for v, w in want.items():
        expected.setdefault(w, set()).add(v)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, expected.values()))


def test_crowded_keys_are_dealt_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 16)
    rng = random.Random(7)
    ball = rng.getrandbits(63)
    values = {ball ^ (1 << rng.randrange(30)) ^ (1 << rng.randrange(30)) for _ in range(300)} | {rng.getrandbits(63) for _ in range(50)}
    links = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 4)
    roots = {r.node: r.root for r in components(links).collect()}
    want = groups(values, 4)
    assert len({roots.get(v, v) for v in values}) == len(set(want.values()))


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(300)] + [(5000, 5000), (7, 8), (8, 7)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[i] for i in range(301)}) == 1 and len({found[1000 + i] for i in range(301)}) == 1
    assert found[0] != found[1000] and 5000 not in found
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_with_odd_rows(spark, documents):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(5, text), (3, text), (9, text.upper()), (4, None), (2, ""), (2, ""), (None, " "), (8, "alone in here"), (None, "no id at all")]
    found = simhash.near_duplicates(documents(rows, extra=True)).collect()
    got = {}
    for r in found:
        got.setdefault(r.fingerprint, set()).add((r.doc_id, r.component_id))
    assert len(found) == len(rows)
    assert {(5, 3), (3, 3), (9, 3)} in got.values()
    assert got["0" * 16] == {(4, 2), (2, 2), (None, 2)}
    assert {(None, None)} in got.values()
    kept = simhash.keep_first(documents(rows, extra=True)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 2), (False, 3), (False, 8), (True, 0)]
    assert simhash.near_duplicates(documents([])).count() == 0 and simhash.keep_first(documents([])).count() == 0


def test_whole_table_against_brute_force(spark):
    from mendframe.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    prints = {d.doc_id: slow_fingerprint(d.text) for d in docs}
    want = groups(set(prints.values()), 4)
    first = {}
    for doc, fp in prints.items():
        first[want[fp]] = min(doc, first.get(want[fp], doc))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op1_simhash_near_dedup"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {doc: (f"{fp:016x}", first[want[fp]]) for doc, fp in prints.items()}


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_similar_documents_are_those_of_high_jaccard(spark, documents):
    rng = random.Random(11)
    rows, pairs = [], []
    for i in range(60):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        near, far = list(words), list(words)
        for at in rng.sample(range(300), rng.randint(0, 3)):
            near[at] = f"n{rng.randrange(10**6)}"
        for at in rng.sample(range(300), 60):
            far[at] = f"f{rng.randrange(10**6)}"
        rows += [(10 * i, " ".join(words)), (10 * i + 1, " ".join(near)), (10 * i + 2, " ".join(far))]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(rows, extra=True)).collect()}
    texts = dict(rows)

    def jaccard(a, b):
        x, y = shingles(texts[a]), shingles(texts[b])
        return len(x & y) / len(x | y)

    near = [10 * i for i in range(60) if jaccard(10 * i, 10 * i + 1) >= 0.9]
    assert len(near) > 50 and sum(found[i] == found[i + 1] for i in near) >= 0.98 * len(near)
    for i in range(60):
        for a, b in ((0, 1), (0, 2), (1, 2)):
            assert simhash.jaccard(texts[10 * i + a], texts[10 * i + b]) == jaccard(10 * i + a, 10 * i + b)
        apart = all(jaccard(10 * i + a, 10 * i + 2) < 0.8 for a in (0, 1))
        assert not (apart and found[10 * i + 2] != 10 * i + 2)


def test_no_group_without_links_at_the_similarity(spark):
    """Each group is what exact links of 0.8 or more join, or a part of it; nine of ten links are found."""
    docs = {d.doc_id: d.text for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(frame).collect()}
    sets, at = {i: shingles(t) for i, t in docs.items()}, {}
    for i, grams in sets.items():
        for gram in grams:
            at.setdefault(gram, []).append(i)
    links = set()
    for i, grams in sets.items():
        shared = {}
        for gram in grams:
            for j in at[gram]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        links |= {(j, i) for j, n in shared.items() if n >= 0.8 * (len(grams) + len(sets[j]) - n)}
    roots = {i: i for i in docs}

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for a, b in sorted(links):
        roots[max(root(a), root(b))] = min(root(a), root(b))
    blank = [i for i, grams in sets.items() if not grams]
    assert all(root(i) == root(c) for i, c in found.items() if i not in blank)
    assert links and sum(found[a] == found[b] for a, b in links) >= 0.9 * len(links)


@pytest.mark.parametrize("chunk", [3, 8_192])
def test_exact_check_of_crowded_candidates(spark, monkeypatch, chunk):
    """A star of candidates with true and false ones: only true ones join, however the node is dealt."""
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    base = [f"w{i}" for i in range(200)]
    texts = {0: " ".join(base)}
    for i in range(1, 40):
        other = list(base)
        for at in range(0, 200, 60 if i % 3 else 4):
            other[at] = f"x{i}"
        texts[i] = " ".join(other)
    pairs = [(0, i) for i in range(1, 40)] + [(i, i + 1) for i in range(1, 39)]
    joined = simhash._checked(
        spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(texts.items()), "node long, text string"), 5, 0.8
    )
    roots = {r.node: r.root for r in joined.collect()}
    together = {i for i in texts if roots.get(i) == roots[0]}
    assert together == {i for i in texts if i == 0 or i % 3}
    nothing = spark.createDataFrame([], "a long, b long")
    assert simhash._checked(nothing, spark.createDataFrame([], "node long, text string"), 5, 0.8).count() == 0


def test_radius_of_candidates():
    assert simhash.most_bits(1.0) == 0 and simhash.most_bits(0.8) == 39 and simhash.jaccard(None, " ") == 1.0


def test_pairs_in_a_family_with_a_template(spark, documents):
    """Near copies among many pages that share a template (Jaccard 0.74 among all) are found, and nothing else."""
    rng = random.Random(5)
    shared, rows = [f"t{i}" for i in range(300)], []
    for i in range(500):
        own = [f"o{rng.randrange(10**9)}" for _ in range(52)]
        near = [f"n{rng.randrange(10**9)}" if at in (10, 20, 30) else w for at, w in enumerate(own)]
        rows += [(2 * i, " ".join(shared + own)), (2 * i + 1, " ".join(shared + near))]
    sets = [shingles(text) for _, text in rows]
    assert len(sets[0] & sets[1]) > 0.9 * len(sets[0] | sets[1]) and len(sets[0] & sets[2]) < 0.75 * len(sets[0] | sets[2])
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(rows)).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(500)) == 500
    assert all(found[2 * i] == 2 * i for i in range(500))


@pytest.mark.parametrize("most", [50, 1 << 18])
def test_exact_check_of_families_in_parts(spark, monkeypatch, most):
    """However a family is dealt, its documents join as brute force joins them."""
    monkeypatch.setattr(simhash, "VERIFIED", most, raising=False)
    rng, texts = random.Random(3), {}
    shared = [f"t{i}" for i in range(20)]
    for i in range(40):
        own = [f"o{i % 13}-{j}" for j in range(20)]
        own[rng.randrange(20)] = f"x{i}"
        texts[i] = " ".join(shared + own)
    pairs = [(i, i + 1) for i in range(39)]
    joined = simhash._checked(
        spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame(list(texts.items()), "node long, text string"), 5, 0.7
    )
    got, label = {r.node: r.root for r in joined.collect()}, {i: i for i in texts}
    sets = {i: shingles(t) for i, t in texts.items()}
    for i in texts:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.7 * len(sets[i] | sets[j]):
                old, new = label[i], label[j]
                label = {k: new if v == old else v for k, v in label.items()}
    assert 1 < len(set(label.values())) < 40
    for i in texts:
        for j in range(i):
            assert (got.get(i, ("alone", i)) == got.get(j, ("alone", j))) == (label[i] == label[j])


def test_repeated_passages_count_once(spark, documents):
    """Sets decide: a passage that stands eight times keeps a pair, a line that fills two texts makes none."""
    rng = random.Random(17)
    rows = []
    for i in range(50):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:100] + words[80:100] * 7 + words[100:]))]
    found = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(rows)).collect()}
    assert sum(found[2 * i + 1] == 2 * i for i in range(50)) == 50
    spam = [(i, "spam " * 100 + " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(10)]
    assert all(r.doc_id == r.component_id for r in simhash.similar_documents(documents(spam)).collect())


def test_rows_with_one_id_and_different_texts(spark, documents):
    """One row of each group stays, also where its id stands on rows of other groups."""
    rng = random.Random(23)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(4))
    rows = [(5, b), (5, a), (3, b + " more"), (7, c), (7, d), (7, d), (None, c), (None, "x y z"), (None, "x y z")]
    for order in (rows, rows[::-1]):
        kept = simhash.keep_first(documents(order, extra=True)).collect()
        want = [(5, a), (3, b + " more"), (7, c), (7, d), (None, "x y z")]
        assert sorted((str(r.doc_id), r.text) for r in kept) == sorted((str(i), t) for i, t in want)
