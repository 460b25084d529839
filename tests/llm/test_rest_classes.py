"""Classes of the words outside the most frequent."""

import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from mendframe.llm import brown_lm
from mendframe.llm.common import ascii_words, flat_words


def likelihood(table):
    held = table[table > 0]
    sums = table.sum(axis=0)
    return float((held * np.log(held)).sum() - (sums[sums > 0] * np.log(sums[sums > 0])).sum())


def test_words_outside_the_head_choose_their_class(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "CLUSTERED", 5)  # the end, x, y, p, q
    monkeypatch.setattr(brown_lm, "LONGEST", 4)  # longer words are in no dictionary
    rng = random.Random(5)
    texts = []
    for _ in range(60):
        pairs = [("x", "p"), ("y", "q")] * 5 + [("x", rng.choice(["l1", "l2", "left-and-long"])), ("y", rng.choice(["r1", "r2", "right-and-long"]))]
        rng.shuffle(pairs)
        texts.append((" ".join(w for pair in pairs for w in pair),))
    texts.append(("x once",))
    frame = spark.createDataFrame(texts, "text string")
    model = brown_lm.learn(frame)
    head = dict(zip([w.decode() for w in model.words], model.classes.tolist()))
    placed = {r.word: (r.c, r["class"]) for r in model.placed.collect()}
    assert set(placed) == {"l1", "l2", "left-and-long", "r1", "r2", "right-and-long", "once"}
    assert {placed[w][1] for w in ("l1", "l2", "left-and-long", "once")} == {head["p"]}
    assert {placed[w][1] for w in ("r1", "r2", "right-and-long")} == {head["q"]}
    tokens = [t[0].split() for t in texts]
    assert model.transitions.sum() == sum(len(t) + 1 for t in tokens)
    for word, (c, _) in placed.items():
        assert c == sum(t.count(word) for t in tokens)
    assert (model.unseen.sum(), model.lone_types.sum()) == (1, 1)
    again = brown_lm.learn(frame.repartition(3))
    assert {r.word: (r.c, r["class"]) for r in again.placed.collect()} == placed

    parts = frame.withColumn("doc_id", brown_lm.F.monotonically_increasing_id())
    scored = brown_lm.score(parts, model).collect()
    steps, shared = model.log_transitions(), model.class_log()
    counts = {w.decode(): n for w, n in zip(model.words, model.counts.tolist())} | {w: c for w, (c, _) in placed.items()}
    classes = head | {w: k for w, (_, k) in placed.items()}
    by_id = {r.doc_id: r.score for r in scored}
    for row in parts.collect():
        before, want = brown_lm.CLASSES, 0.0
        for word in [*row.text.split(), "\n"]:
            want += steps[before, classes[word]] + np.log10(counts[word]) - shared[classes[word]]
            before = head.get(word) if word in ("x", "y", "p", "q") else brown_lm.CLASSES + 1 + brown_lm.shape(word.encode())
        assert abs(by_id[row.doc_id] - want) < 1e-6


def test_choices_against_brute_force():
    rng = np.random.default_rng(7)
    words = [np.unique(rng.integers(0, brown_lm.LETTERS, rng.integers(1, 9))) for _ in range(25)]
    counts = [rng.integers(1, 90, len(w)) for w in words]
    own = rng.integers(0, brown_lm.CLASSES, len(words))
    table = rng.integers(0, 9, (brown_lm.LETTERS, brown_lm.CLASSES)).astype(float)
    for cells, n, k in zip(words, counts, own):
        table[cells, k] += n
    sizes = np.array([n.sum() for n in counts])
    starts = np.cumsum([0, *(len(w) for w in words[:-1])])
    flat = np.concatenate(words), np.concatenate(counts), starts, sizes
    best, first = brown_lm._Choice(table).again(own, *flat), brown_lm._Choice(table).first(*flat)
    for at, (cells, n) in enumerate(zip(words, counts)):
        def with_word(without, k):
            moved = without.copy()
            moved[cells, k] += n
            return likelihood(moved)

        without = table.copy()
        without[cells, own[at]] -= n
        assert best[at] == max(range(brown_lm.CLASSES), key=lambda k: with_word(without, k))
        assert first[at] == max(range(brown_lm.CLASSES), key=lambda k: with_word(table, k))


def test_texts_are_read_twice_to_learn_and_contexts_add_up(spark, monkeypatch):
    """Counted and encoded; contexts come from the encoded texts, also of words that share a hash, over many small batches."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["a", "b", "c", *(f"w{rng.randrange(90)}" for _ in range(3))]) for _ in range(rng.randrange(40))) for _ in range(80)]
    seen = spark.sparkContext.accumulator(0)

    def look(text):
        seen.add(1)
        return text

    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(3)
    monkeypatch.setattr(brown_lm, "CLUSTERED", 4)
    monkeypatch.setattr(brown_lm, "FLUSH", 20)
    monkeypatch.setattr(brown_lm, "BATCH_ROWS", 7)
    model = brown_lm.learn(frame.select(brown_lm.F.udf(look, "string")("text").alias("text")), rounds=1)
    assert seen.value == 2 * len([*texts, None])

    monkeypatch.setattr(brown_lm.F, "xxhash64", lambda word: brown_lm.F.crc32(word) % 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        head = [brown_lm.END, *(w.encode() for w in "abc")]
        classes = np.concatenate(([brown_lm.CLASSES], range(3), np.arange(brown_lm.CLASSES + 1, brown_lm.LETTERS))).astype(np.int64)
        found = brown_lm._contexts(brown_lm._encoded(frame, head), 4, classes).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for text in texts:
        before = brown_lm.CLASSES
        for word in text.encode().split():
            number = head.index(word) if word in head else 4 + brown_lm.shape(word)
            if number >= 4:
                cells = want.setdefault(word.decode(), {})
                cells[before] = cells.get(before, 0) + 1
            before = int(classes[number])
    got = {r.word: dict(zip(r.cells, np.frombuffer(r.counts, np.int64).tolist())) for r in found}
    assert len(found) == len(got) and got == want
    assert {r.word for r in model.placed.collect()} | {w.decode() for w in model.words[:4]} == {*want, "\n", "a", "b", "c"}


def test_flat_words_are_those_of_the_plain_split():
    """Every ASCII character between words, blanks at the ends, NULL and empty texts, slices."""
    texts = [None, "", " ", *(f"{chr(i)}A{chr(i)}{chr(i)}bÄ {chr(i)}" for i in range(128)), "  x\x1c\x85y", "Z", None]
    for part in (pa.array(texts), pa.array(["drop me", *texts, "and me"]).slice(1, len(texts)), pa.array([None, None], pa.string()), pa.array([], pa.string())):
        flat, lengths = flat_words(pc.ascii_lower(part))
        want = [ascii_words(t) for t in part.to_pylist()]
        assert [w.encode() for w in flat.to_pylist()] == [w for words in want for w in words]
        assert lengths.tolist() == [len(words) for words in want]


def test_shapes_of_many_words_at_once():
    words = ["a", "abcdefg", "abcdefgh", "twelveletter", "thirteenchars", "end.", "b,", "x!", "9", "é", "straße.", "日本語", "aé日-", "."]

    def plain(word):
        data = word.encode()
        last = data[-1]
        ending = 0 if last > 127 or chr(last).isalnum() else 1 if last == ord(".") else 2 if last == ord(",") else 3
        foreign = next((1 + (b * 31 + data[i + 1]) % 7 for i, b in enumerate(data) if b > 127), 0)
        return ending * 24 + foreign * 3 + (len(data) > 7) + (len(data) > 12)

    assert brown_lm.shapes(pa.array(words)).tolist() == [plain(w) for w in words]
    assert brown_lm.shapes(pa.array(words).slice(3, 9)).tolist() == [plain(w) for w in words[3:12]]
    assert brown_lm.shapes(pa.array([], pa.string())).tolist() == []


def test_units_do_not_depend_on_the_pieces_looked_at(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "c", "dé", "rest."]) for _ in range(rng.randrange(30))) for _ in range(50)]
    texts[7] = texts[20] = None
    known = pa.array(["\n", "a", "b"])

    def units():
        return [
            (first + row, part.tolist())
            for first, lengths, at, _ in brown_lm._tokens(pa.array(texts), known)
            for row, part in enumerate(np.split(at, np.cumsum(lengths)[:-1]))
        ]

    numbers = {"a": 1, "b": 2}
    want = [
        (row, [*(numbers.get(w, 3 + brown_lm.shape(w.encode())) for w in (t or "").lower().split()), 0]) for row, t in enumerate(texts)
    ]
    assert units() == want
    for name, value in (("CHUNK", 64), ("LOOKED_UP", 20), ("BATCH_ROWS", 7)):
        monkeypatch.setattr(brown_lm, name, value)
        assert units() == want


def test_a_round_reads_the_encoded_texts_once(spark):
    """The counts that choose the moves also give the transitions of the classes."""
    frame = spark.createDataFrame([("x p y q x p",), ("y q",), (None,), ("once x p",)], "text string").repartition(2)
    head = [brown_lm.END, b"x", b"y", b"p", b"q"]
    classes = np.concatenate(([brown_lm.CLASSES, 0, 1, 2, 3], np.arange(brown_lm.CLASSES + 1, brown_lm.LETTERS))).astype(np.int64)
    counted = brown_lm._counted(brown_lm._encoded(frame, head), classes)
    assert counted.count() == counted.select("block").distinct().count()
    found = brown_lm._transitions(counted, classes)
    end, rest = brown_lm.CLASSES, brown_lm.CLASSES + 1 + brown_lm.shape(b"once")
    want = np.zeros_like(found)
    for pair in ((end, 0), (0, 2), (2, 1), (1, 3), (3, 0), (0, 2), (2, end), (end, 1), (1, 3), (3, end), (end, end), (end, rest), (rest, 0), (0, 2), (2, end)):
        want[pair] += 1
    assert np.array_equal(found, want)
