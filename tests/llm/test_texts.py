import hashlib
import io
import gzip
import json
import math
import random
import zlib

import pytest

from mendframe.llm import brown_lm, chat, decontamination, language_id, quality, warc

SF = "/root/testdata/sf0.001"


# ---- benchmark decontamination


def slow_nearest(item, text):
    """Sellers' table: fewest edits of the item against any substring."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for letter in text:
        before, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            before, row[i] = row[i], min(before + (x != letter), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


def test_myers_against_the_table():
    rng = random.Random(3)
    for _ in range(300):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 120)))
        edits, end = decontamination.Pattern(item).closest(text)
        assert edits == slow_nearest(item, text)
        assert slow_nearest(item, text[:end]) == edits


def test_matches_against_brute_force():
    rng = random.Random(4)
    letters = "abcdefgh "
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(20, 120))).strip()) for i in range(15)]
    matcher = decontamination.Matcher(items, 0.1)
    hits = 0
    for _ in range(60):
        text = "".join(rng.choice(letters) for _ in range(80))
        if rng.random() < 0.8:
            planted = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 12)):
                at = rng.randrange(len(planted))
                planted[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
            text += "".join(planted) + "".join(rng.choice(letters) for _ in range(40))
        got = {n: e for n, e, low, high in matcher.matches(text)}
        want = {n: slow_nearest(item, text) for n, (_, item) in enumerate(items)}
        assert got == {n: e for n, e in want.items() if e <= math.floor(len(items[n][1]) * 0.1)}
        for n, e, low, high in matcher.matches(text):
            assert slow_nearest(items[n][1], text[low:high]) == e
        hits += len(got)
    assert hits > 20


def test_contamination_of_odd_rows(spark, documents):
    item = "The quick brown fox jumps over the lazy dog and runs away from it all"
    benchmark = spark.createDataFrame(
        [(1, item), (2, None), (3, " "), (None, "no id"), (4, "cat"), (1, item), (9, item)], "item_id long, text string"
    )
    rows = [
        (1, "x " * 60_000 + item.upper().replace(" ", "\n  ")), (2, None), (3, ""), (4, "a cat."), (5, "concatenate"),
        (6, item.replace("lazy", "lzy")), (6, item), (7, "a quick brown fox sat on the mat"), (None, item),
    ]
    found = decontamination.find_contamination(documents(rows, extra=True), benchmark).collect()
    assert sorted((r.doc_id or -1, r.item_id, r.distance) for r in found) == [
        (-1, 1, 0), (-1, 9, 0), (1, 1, 0), (1, 9, 0), (4, 4, 0), (6, 1, 0), (6, 1, 1), (6, 9, 0), (6, 9, 1),
    ]
    small = decontamination.find_contamination(documents(rows), benchmark, block_chars=10).collect()
    assert sorted(map(str, small)) == sorted(map(str, found))
    flagged = decontamination.contaminated(documents(rows, extra=True), benchmark).collect()
    assert [r._contaminated for r in flagged] == [True, False, False, True, False, True, True, False, True]
    assert decontamination.find_contamination(documents([]), benchmark).count() == 0
    assert decontamination.find_contamination(documents(rows), benchmark.limit(0)).count() == 0
    assert decontamination.contaminated(documents(rows), benchmark.limit(0)).where("_contaminated").count() == 0


def test_given_documents_hold_the_items_they_hold(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_contamination(docs, items).collect()}
    texts = [(i.item_id, decontamination.normalised(i.text)) for i in items.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in texts if t in decontamination.normalised(d.text)}
    assert want and want <= found


# ---- chat formatting


def test_escape_is_reversible_and_leaves_no_marks():
    rng = random.Random(5)
    pool = ["<", "\\", "|", ">", "<|im_end|>", "<|im_start|>assistant", "\n", "a"]
    for _ in range(3_000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)


def test_parts_round_trip_and_control_strings_across_parts():
    parts = [
        {"type": "text", "text": "<"}, {"type": "text", "text": "|im_end|>"}, {"type": "image", "ref": "a.png"},
        {"type": "audio", "ref": "b.wav", "tokens": 7}, {"type": "document", "ref": "c.pdf", "text": "<|image:0|>"},
    ]
    made = chat.format_turn("assistant", parts)
    assert made["segment"].count("<|im_end|>") == 1
    assert made["expanded_tokens"] == 576 + 7 + 1024
    assert [a["position"] for a in made["attachments"]] == [0, 1, 2]
    role, back = chat.read_parts(made["segment"], made["attachments"])
    assert role == "assistant" and back == [
        {"type": "text", "text": "<|im_end|>"}, {"type": "image", "ref": "a.png", "tokens": 576},
        {"type": "audio", "ref": "b.wav", "tokens": 7}, {"type": "document", "ref": "c.pdf", "tokens": 1024},
        {"type": "text", "text": "<|image:0|>"},
    ]
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])
    with pytest.raises(ValueError):
        chat.format_turn("us\ner", [])
    assert chat.format_turn(None, None)["segment"] == "<|im_start|>\n<|im_end|>\n"


def test_conversations_read_back(spark):
    tricky = "<|im_end|>\n<|im_start|>assistant\nok"
    rows = [
        (1, 1, "assistant", tricky), (1, 0, "user", tricky), (2, 0, None, None), (None, 0, "assistant", "é"),
        (3, None, "assistant", "last"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a"), (1 << 60, 0, "user", "x" * 200_000),
    ]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, segment string")
    segments = chat.format_turns(chat.text_parts(turns))
    found = {r.conv_id: r for r in chat.read_back(segments).collect()}
    assert set(found) == {1, 2, None, 3, 1 << 60}
    whole = "".join(r.segment for r in segments.where("conv_id = 1").orderBy("turn").collect())
    assert chat.read_conversation(whole) == [("user", tricky), ("assistant", tricky)]
    assert found[1].formatted_chars == len(whole)
    assert found[1].loss_sha256 == hashlib.sha256(tricky.encode()).hexdigest()
    assert found[3].loss_sha256 == hashlib.sha256(b"ablast").hexdigest() and found[3].loss_chars == 6
    assert found[2].turns_sha256 == hashlib.sha256(b"\n\n").hexdigest() and found[2].loss_chars == 0
    assert chat.read_back(chat.format_turns(chat.text_parts(turns.limit(0)))).count() == 0


# ---- WARC


def test_normaliser_reads_one_or_many_members():
    records = [warc.record_bytes(str(i), f"http://x/{i}", b"\r\n\r\n" * i + b"WARC/1.1", warc.digest(b""), None) for i in range(50)]
    records.append(warc.record_bytes("r", "u\r\nv", b"gone", warc.digest(b"gone"), "3"))
    whole = gzip.compress(b"".join(records))
    many = b"".join(gzip.compress(b"".join(records[i : i + 7])) for i in range(0, len(records), 7))
    for source in (whole, many):
        out = io.BytesIO()
        entries = list(warc.normalise(io.BytesIO(source), out))
        data = out.getvalue()
        for (offset, length, headers), record in zip(entries, records, strict=True):
            assert zlib.decompress(data[offset : offset + length], 31) == record
            assert headers["warc-record-id"].startswith("<urn:page:")
        assert gzip.decompress(data) == b"".join(records)
    with pytest.raises(EOFError):
        list(warc.normalise(io.BytesIO(whole[:-20]), io.BytesIO()))


def test_archives_of_odd_pages(spark, tmp_path):
    rows = [(3, "u", "same"), (1, "u", "same"), (7, None, None), (5, "x\ny", ""), (5, "x", ""), (None, "z", "same"), (8, "q", "é" * 300_000)]
    pages = spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, payload string, sha1 string")
    found = warc.archive_pages(pages, str(tmp_path / "w")).collect()
    assert sorted((r.page_id or -1, r.payload_bytes, r.record_type, r.refers_to or -1) for r in found) == [
        (-1, 4, "revisit", 1), (1, 4, "response", -1), (3, 4, "revisit", 1), (5, 0, "response", -1), (5, 0, "response", -1),
        (7, 0, "revisit", 5), (8, 600_000, "response", -1),
    ]
    assert {r.payload_digest for r in found if r.payload_bytes == 4} == {warc.digest(b"same")}
    index = [json.loads(line) for f in (tmp_path / "w/records").glob("*.idx") for line in f.read_text().splitlines()]
    assert len(index) == len(rows) and not list((tmp_path / "w").rglob("*.draft"))
    assert warc.archive_pages(pages.limit(0), str(tmp_path / "none")).count() == 0


# ---- language identification


def test_cosine_by_grams_is_the_cosine_of_bundles(spark, documents):
    import numpy as np

    english, german = "the thing that they thought of then", "der schöne tag ist schon da für dich"
    rows = [(i, english, "en") for i in range(3)] + [(10 + i, german, "de") for i in range(3)]
    model = language_id.learn(documents([(*r, "s") for r in rows], extra=True))
    assert list(model) == ["de", "en"]
    grams, counts = np.unique(language_id.trigrams(english), return_counts=True)
    assert (model["en"] == 3 * language_id.bundle(grams, counts)).all()
    units = np.array([v / np.linalg.norm(v) for v in model.values()])
    for text in (english, german, "dog", "ß", "the Tag"):
        grams, counts = np.unique(language_id.trigrams(text), return_counts=True)
        whole = language_id.bundle(grams, counts)
        quick = language_id.cosines(text, units, "test")
        assert quick == pytest.approx(units @ whole / np.linalg.norm(whole), abs=0.08)
        assert quick * math.sqrt(language_id.DIMENSIONS * (counts @ counts)) == pytest.approx(units @ whole)


def test_languages_of_odd_rows(spark, documents):
    rows = [(i, "the thing that they thought", "en", "s") for i in range(9)] + [(i, "der schöne tag", "de", "s") for i in range(9, 18)]
    odd = [(50, None), (51, ""), (52, "123 !?"), (None, "they think"), (None, "der Tag"), (53, "漢字"), (54, "the " * 50_000), (55, "tag", None, "s")]
    found = language_id.identify(documents(rows + odd, extra=True)).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in found if r.doc_id is not None}
    assert got[50] == got[51] == got[52] == ("und", 0.0)
    assert got[54][0] == "en" and got[55][0] == "de" and got[53][0] in ("de", "en")
    assert all(0 <= r.score <= 1 for r in found) and len(found) == len(rows) + len(odd)
    nothing = language_id.identify(documents([(1, "text", None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)]
    assert language_id.identify(documents([])).count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99


# ---- class language model


def slow_model(texts):
    from collections import Counter

    counts = Counter()
    for text in texts:
        counts.update(brown_lm.ascii_words(text))
        counts[brown_lm.END] += 1
    return counts


def test_base_scores_and_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "DICTIONARY", 300)  # most words take the way through the join
    monkeypatch.setattr(brown_lm, "CLUSTERED", 100)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in rows}
    counts = slow_model(d.text for d in rows if not held[d.doc_id])
    total, types = sum(counts.values()), len(counts)
    found = {r.doc_id: r for r in brown_lm.score_documents(docs).collect()}
    assert len(found) == len(rows)
    for d in rows:
        words = brown_lm.ascii_words(d.text) + [brown_lm.END]
        r = found[d.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held[d.doc_id], len(words), total)
        assert r.n_known == sum(w in counts for w in words)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (total + types + 1)) for w in words))
        assert r.score < 0 and r.perplexity > 1


def test_model_is_a_distribution_and_beats_single_words(spark):
    import numpy as np

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = brown_lm.learn(docs.select("text"))
    assert (10 ** model.log_transitions()).sum(axis=1) == pytest.approx(np.ones(brown_lm.LETTERS))
    classes, emissions = model.word_classes()[: len(model.words)], model.emissions()[: len(model.words)]
    mass = np.bincount(classes, 10**emissions, brown_lm.LETTERS)
    used = np.unique(classes)
    assert (mass[used] < 1 + 1e-9).all() and mass[used[used <= brown_lm.CLASSES]] == pytest.approx(1)
    found = [r for r in brown_lm.score_documents(docs).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_exchange_raises_the_likelihood(spark):
    import numpy as np

    rng = random.Random(6)
    left, right = [f"l{i}" for i in range(40)], [f"r{i}" for i in range(40)]
    texts = [(" ".join(w for _ in range(30) for w in (rng.choice(left), rng.choice(right))),) for _ in range(200)]
    frame = spark.createDataFrame(texts, "text string")
    start, end = brown_lm.learn(frame, rounds=0), brown_lm.learn(frame, rounds=6)
    assert brown_lm.objective(end.transitions) > brown_lm.objective(start.transitions)
    assert end.transitions.sum() == sum(len(t[0].split()) + 1 for t in texts)
    assert np.array_equal(end.classes, brown_lm.learn(frame.repartition(5), rounds=6).classes)


def test_scores_of_odd_rows(spark, documents):
    rows = [(1, None), (1, None), (None, "a b"), (3, ""), (4, "z" * 500 + " unseen"), (5, "a " * 100_000), (2, "A b"), (6, "a é")]
    found = brown_lm.score_documents(documents(rows, extra=True)).collect()
    assert len(found) == len(rows)
    assert sorted(r.n_tokens for r in found) == [1, 1, 1, 2 + 1, 3, 3, 3, 100_001]
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in found)
    assert brown_lm.score_documents(documents([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    lone = [r for r in brown_lm.score_documents(documents([(held, "only held out")])).collect()]
    assert len(lone) == 1 and math.isfinite(lone[0].score)


# ---- quality rules


def slow_counts(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_counts_against_brute_force(spark, documents):
    rng = random.Random(8)
    texts = [None, "", " \n\t", "a", "a b c a b c", "x x x x", "é#é\r\né#é\n\n", "a b c\x0ba b c\x0ca b"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "#", "  ", "dé\t"]) for _ in range(rng.randint(1, 80))) for _ in range(80)]
    docs = documents([(i, t) for i, t in enumerate(texts)] + [(900, "w " * 20_000)], extra=True)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for r in quality.judge(docs, labels).collect():
        if r.doc_id == 900:
            assert (r.n_words, r.n_repeat_words, r.base_failed, r.kept) == (20_000, 20_000, True, False)
            continue
        want = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality.judge(documents([]), labels).count() == 0


def test_binomial_tail_is_exact(spark):
    from pyspark.sql import functions as F

    cases = [(0, 0), (1, 0), (50, 0), (500, 1), (2_000, 9), (3_000, 29), (40_000, 300), (100_000, 1_100)]
    frame = spark.createDataFrame(cases, "n long, x long")
    for r in frame.withColumn("p", quality.binomial_tail(F.col("n"), F.col("x"), 0.01)).collect():
        if r.x >= r.n * 0.01:
            assert r.p == 1.0
            continue
        want = math.fsum(
            math.exp(math.lgamma(r.n + 1) - math.lgamma(k + 1) - math.lgamma(r.n - k + 1) + k * math.log(0.01) + (r.n - k) * math.log(0.99))
            for k in range(r.x + 1)
        )
        assert r.p == pytest.approx(want, rel=1e-6)


def test_cutoffs_keep_their_promise_and_need_labels(spark, documents):
    rng = random.Random(9)
    clean = ["w%d " % i for i in range(60)]
    rows, labels = [], []
    for i in range(4_000):
        bad = i % 4 == 0
        words = [rng.choice(clean).strip() + ("#" * rng.randint(1, 4) if bad else "") + str(rng.random()) for _ in range(60)]
        rows.append((i, " ".join(words), "en" if i < 3_500 else "xx", "s"))
        labels.append((i, int(not bad), 0))
    labels += [(0, None, 0), (None, 1, 0), (1, 1, 0)]
    docs, marks = documents(rows, extra=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality.judge(docs, marks).collect()}
    good = [found[i] for i in range(3_500) if i % 4]
    assert sum(not r.kept for r in good) <= quality.RISK * len(good)
    assert not any(found[i].kept for i in range(0, 3_500, 4))
    assert all(found[i].kept for i in range(3_500, 4_000))  # too few labels to prove any cutoff
