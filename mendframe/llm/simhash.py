"""SimHash near-duplicates: fingerprints, a pigeonring index, links, components."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from mendframe.functions import tables
from mendframe.llm.common import ascii_words, mixed, packed
from mendframe.llm.components import components

BITS = 64
SEED = 42
SHINGLE_WORDS = 4
MAX_DISTANCE = 4
WIDE_WORDS = 5  # 64-bit words of the wide sketch; each has index keys of its own
COMPARED_WORDS = 3  # words of it that travel with the keys and are compared
WIDE_SHINGLE_WORDS = 5
WIDE_SIMILARITY = 0.8  # of the shingle sets (Jaccard)
SPREAD = 2.0  # standard deviations above the expected distance that still make a candidate
FIRST_CHECKS = 2  # candidates per document whose texts are compared first
CHUNK = 8_192  # fingerprints of one index key that meet at most once in a task, beside another chunk
SHORT_RUN = 16  # runs of a key up to this length are compared all at once
VERIFIED = 1 << 18  # shingles of one family of candidates that meet at most once in a task, beside another chunk


def _shingle_hashes(text: str | None, shingle_words: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, repeats included, in pieces; the whole sequence if it is shorter."""
    found = ascii_words(text)
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(found) > shingle_words:
        starts, ends = starts[: 1 - shingle_words or None], ends[shingle_words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 65_536):
        spans = zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist())
        yield np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64)


def _majority(pieces: Iterator[np.ndarray], words: int) -> list[int]:
    """Bits that are one in over half the hashes, as 64-bit words; word i takes the hashes mixed with i."""
    ones, total = np.zeros(words * BITS, np.int64), 0
    for hashes in pieces:
        each = [hashes if not i else mixed(hashes ^ np.uint64(i)) for i in range(words)]
        data = np.stack(each, axis=1).astype(">u8")
        ones += np.unpackbits(data.view(np.uint8).reshape(len(hashes), -1), axis=1).sum(axis=0, dtype=np.int64)
        total += len(hashes)
    packed_bits = np.packbits(ones * 2 > total).tobytes()
    return [int.from_bytes(packed_bits[8 * i : 8 * i + 8], "big") for i in range(words)]


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """SimHash of a text's word shingles, repeats included; 0 without words."""
    return _majority(_shingle_hashes(text, shingle_words), 1)[0]


def fingerprints(docs: DataFrame, text: str = "text", output: str = "fp", shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """Add the fingerprint of the whole text as a (signed) long."""

    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        found = np.fromiter((fingerprint(x, shingle_words) for x in texts), np.uint64, len(texts))
        return pd.Series(found.view(np.int64))

    return docs.withColumn(output, hashed(F.col(text)))


def _segments(max_distance: int) -> list[tuple[int, int]]:
    """(offset, width) of max_distance + 1 segments that cover the bits, a ring."""
    count = max_distance + 1
    edges = [BITS * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _keys(fp: Column, max_distance: int, first_tag: int = 0) -> Column:
    """Array of index keys of a fingerprint: the first segment of each chain, equal, and either half of the second.

    Pigeonring: fingerprints at most d bits apart, cut into d + 1 segments, have
    a segment from which every chain of j segments differs in at most
    floor(j * d / (d + 1)) bits. So its first segment is equal and its second
    differs in one bit at most, so one of that segment's halves is equal, too.
    """
    segments = _segments(max_distance)
    keys = []
    for i, (offset, width) in enumerate(segments):
        turned = fp if not offset else F.shiftleft(fp, offset).bitwiseOR(F.shiftrightunsigned(fp, BITS - offset))
        following = segments[(i + 1) % len(segments)][1]
        first = F.shiftrightunsigned(turned, BITS - width)
        half = following // 2
        for which, (skip, take) in enumerate(((width, half), (width + half, following - half))):
            part = F.shiftrightunsigned(F.shiftleft(turned, skip), BITS - take) if take else F.lit(0).cast("long")
            tag = F.lit(first_tag + 2 * i + which).cast("long")
            keys.append(F.shiftleft(tag, 56).bitwiseOR(F.shiftleft(first, take)).bitwiseOR(part))
    return F.array(*keys)


def _chain_masks(max_distance: int) -> tuple[np.ndarray, list[int]]:
    """masks[i][j]: bits of the chain of j + 2 segments from segment i; and the budget of each length."""
    segments = _segments(max_distance)
    count = len(segments)
    bits = [((1 << width) - 1) << (BITS - offset - width) for offset, width in segments]
    masks = np.zeros((count, max(0, count - 2)), np.uint64)
    for i in range(count):
        for j in range(count - 2):
            masks[i, j] = sum(bits[(i + k) % count] for k in range(j + 2))
    return masks, [(j + 2) * max_distance // count for j in range(count - 2)]


Test = Callable[[np.ndarray, np.ndarray], np.ndarray]  # (differences, keys) -> positions that link


def _chain_test(max_distance: int) -> Test:
    """Positions whose chains stay within every budget, then within the whole distance."""
    masks, budgets = _chain_masks(max_distance)

    def test(difference: np.ndarray, keys: np.ndarray) -> np.ndarray:
        difference, chain = difference[:, 0], keys >> 57
        left = np.arange(len(difference))
        for j, budget in enumerate(budgets):
            left = left[np.bitwise_count(difference[left] & masks[chain[left], j]) <= budget]
        return left[np.bitwise_count(difference[left]) <= max_distance]

    return test


def _wide_test(most: int) -> Test:
    """Positions within ``most`` bits of the compared words."""

    def test(difference: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.bitwise_count(difference).sum(axis=1, dtype=np.int64) <= most)

    return test


def _run_links(run: np.ndarray, key: int, test: Test) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among one key's fingerprints, by breadth first, as positions."""
    found, rest = [], np.arange(len(run))
    while len(rest) > 1:
        waiting, rest = [rest[0]], rest[1:]
        while waiting and len(rest):
            node = waiting.pop()
            hits = test(run[rest] ^ run[node], np.full(len(rest), key))
            if len(hits):
                reached = rest[hits]
                found.append((np.full(len(hits), node), reached))
                waiting.extend(reached)
                rest = np.delete(rest, hits)
    return found


def _linked_runs(keyed: DataFrame, words: list[str], test: Test) -> DataFrame:
    """(a, b) links among rows (key, node, words...) that share a key and pass the test.

    A key's rows are compared in one sorted run, and of its links a spanning forest is
    given out, so the output is linear in the index. Keys with more than ``CHUNK`` rows
    are dealt in chunks, and each pair of chunks is a run of its own: no task holds more
    than two chunks, and no pair is left out.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            new = [*new[:3], np.stack(new[3:], axis=1).view(np.uint64)]
            held = new if held is None else [np.concatenate(pair) for pair in zip(held, new)]
            key, part = held[:2]
            last = int(np.argmax((key == key[-1]) & (part == part[-1])))
            if last:
                yield from edges(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if held is not None:
            yield from edges(*held)

    def edges(key: np.ndarray, part: np.ndarray, node: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(key) < 2:
            return
        heads = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (part[1:] != part[:-1]))))
        lengths = np.diff(np.append(heads, len(key)))
        run = np.repeat(np.arange(len(heads)), lengths)
        short = np.repeat(lengths <= SHORT_RUN, lengths)
        found = []
        for step in range(1, min(SHORT_RUN, int(lengths.max()))):
            at = np.flatnonzero(short[:-step] & (run[step:] == run[:-step]))
            hits = at[test(bits[at] ^ bits[at + step], key[at])]
            found.append((hits, hits + step))
        for head, length in zip(heads[lengths > SHORT_RUN].tolist(), lengths[lengths > SHORT_RUN].tolist()):
            for left, right in _run_links(bits[head : head + length], int(key[head]), test):
                found.append((left + head, right + head))
        if sum(len(left) for left, _ in found):
            a, b = (node[np.concatenate(side)] for side in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    crowded = tables.cut(
        keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
        .select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")),
        "crowded",
    )
    others = F.array_remove(F.sequence(F.lit(0), F.col("chunks") - 1).cast("array<long>"), F.col("own"))
    dealt = (
        tables.lookup(keyed, crowded, ["key"])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.coalesce("chunks", F.lit(1))))
        .withColumn("other", F.explode(F.when(F.col("chunks") > 1, others).otherwise(F.array(F.lit(0).cast("long")))))
        .select("key", (F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).alias("part"), "node", *words)
    )
    # another order for each key, so that the forests of a group differ
    runs = dealt.repartition("key", "part").sortWithinPartitions("key", "part", F.xxhash64("node", "key"))
    return runs.mapInArrow(compare, "a long, b long")


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b) links that join all fingerprints at ``max_distance`` bits or fewer; one row per ``fp``."""
    keyed = distinct.select(F.explode(_keys(F.col("fp"), max_distance)).alias("key"), F.col("fp").alias("node"), "fp")
    return _linked_runs(keyed, ["fp"], _chain_test(max_distance))


def _named(hashed: DataFrame, distinct: DataFrame, joined: DataFrame, node: str) -> DataFrame:
    """``hashed`` plus ``component_id``: the smallest id of all rows whose nodes are joined."""
    joined = joined.select(F.col("node").alias(node), "root")
    members = tables.lookup(distinct.select(node, "rep"), joined, [node], how="inner")
    smallest = members.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = tables.lookup(joined, tables.cut(smallest, "smallest"), ["root"]).select(node, "component_id")
    classes = tables.cut(
        tables.lookup(distinct.select(node, "rep"), tables.cut(named, "named"), [node]).select(
            node, F.coalesce("component_id", "rep").alias("component_id")
        ),
        "classes",
    )
    return tables.lookup(hashed, classes, [node])


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = SHINGLE_WORDS,
    max_distance: int = MAX_DISTANCE,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    The component is the smallest id that links of at most ``max_distance``
    bits reach. NULL, empty and blank texts have fingerprint zero and link like
    any other; equal texts share a fingerprint; repeated rows stay; a NULL id
    never names a component unless all ids of it are NULL. Other columns of
    ``docs`` are not read. An empty table gives no rows.
    """
    if not 0 <= max_distance <= 31:
        raise ValueError("max_distance must be between 0 and 31")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hashed = tables.cut(fingerprints(keyed, shingle_words=shingle_words).drop("text"), "fingerprints")
    distinct = tables.cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    joined = components(links(distinct.select("fp"), max_distance))
    return _named(hashed, distinct, joined, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def most_bits(similarity: float, bits: int = COMPARED_WORDS * BITS) -> int:
    """Differing bits of a candidate: what SimHash expects of sets of equal size at a Jaccard similarity, plus ``SPREAD``."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * share + SPREAD * math.sqrt(bits * share * (1 - share)))


def _shingle_set(text: str | None, shingle_words: int) -> np.ndarray:
    pieces = list(_shingle_hashes(text, shingle_words))
    return np.unique(np.concatenate(pieces)) if pieces else np.zeros(0, np.uint64)


def _set_sketch(shingles: np.ndarray) -> list[int]:
    """The wide sketch of a shingle set, each shingle counted once, and the set's own hash."""
    pieces = (shingles[at : at + 65_536] for at in range(0, len(shingles), 65_536))
    return [*_majority(pieces, WIDE_WORDS), xxhash.xxh64_intdigest(shingles.tobytes(), SEED)]


def jaccard(left: str | None, right: str | None, shingle_words: int = WIDE_SHINGLE_WORDS) -> float:
    """Similarity of the shingle sets of two whole texts; 1 where neither has words."""
    a, b = _shingle_set(left, shingle_words), _shingle_set(right, shingle_words)
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared) if len(a) or len(b) else 1.0


def _with_text(pairs: DataFrame, end: str, texts: DataFrame) -> DataFrame:
    """Add the text of one end of every pair; a node in more than ``CHUNK`` pairs is dealt over several tasks."""
    crowded = tables.cut(
        pairs.groupBy(end).agg(F.count("*").alias("n")).where(F.col("n") > CHUNK)
        .select(end, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")),
        "crowded",
    )
    parts = F.coalesce("chunks", F.lit(1))
    dealt = tables.lookup(pairs, crowded, [end]).withColumn("part", F.pmod(F.xxhash64("a", "b"), parts).cast("int")).drop("chunks")
    content = tables.lookup(texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), crowded, [end])
    copies = content.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("chunks")
    return dealt.join(copies.hint("merge"), [end, "part"]).drop("part")


def _alike(pairs: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """The pairs whose whole texts are at least ``similarity`` alike."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y, shingle_words) >= similarity for x, y in zip(left, right)], dtype=bool)

    both = _with_text(_with_text(pairs, "a", texts), "b", texts)
    return tables.cut(both.where(alike("text_a", "text_b")).select("a", "b"), "alike")


def _texts_of(pairs: DataFrame, distinct: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, text): the text behind every node of a pair, read from the documents again."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = tables.cut(tables.lookup(distinct.select("node", "digest"), tables.cut(ends, "ends"), ["node"], how="inner"), "wanted")
    read = docs.select(_digest(F.col("text")).alias("digest"), "text")
    once = tables.lookup(read, wanted.select("digest"), ["digest"], how="left_semi").groupBy("digest").agg(F.min("text").alias("text"))
    return tables.cut(tables.lookup(wanted, tables.cut(once, "once"), ["digest"]).select("node", "text"), "texts")


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _exact_links(roots: np.ndarray, sizes: np.ndarray, shingles: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links (as positions) that join documents of different roots wherever their shingle sets are similar.

    The sets stand one after the other in ``shingles``. A document meets all others at once
    through the places of its shingles; documents of the most frequent root are only met.
    """
    count = len(sizes)
    number = np.unique(shingles, return_inverse=True)[1]
    ends = np.cumsum(sizes)
    places = np.repeat(np.arange(count), sizes)[np.argsort(number, kind="stable")]
    heads = np.concatenate(([0], np.cumsum(np.bincount(number))))
    label = np.unique(roots, return_inverse=True)[1]
    left, right = [], []
    for at in np.flatnonzero(label != np.bincount(label).argmax()).tolist():
        mine = number[ends[at] - sizes[at] : ends[at]]
        lengths = heads[mine + 1] - heads[mine]
        meets = np.repeat(heads[mine] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.bincount(places[meets], minlength=count)
        total = sizes + sizes[at] - shared
        hits = np.flatnonzero(((shared / np.maximum(total, 1) >= similarity) | (total == 0)) & (label != label[at]))
        joined, first = np.unique(label[hits], return_index=True)
        left += [at] * len(joined)
        right += hits[first].tolist()
        label[np.isin(label, joined)] = label[at]
    return left, right


def _family_links(sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) links that join all similar documents of each family; rows (family, node, root, shingles).

    Documents with one root are joined already. A family with more than ``VERIFIED``
    shingles is dealt in chunks, those of its largest root apart from the others, and each
    pair of chunks that could hold different roots is a task of its own.
    """

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            heads = [i for i, name in enumerate(names) if not i or name != names[i - 1]]
            for head, stop in zip(heads, [*heads[1:], len(names)]):
                if names[head] != current:
                    yield from linked(held)
                    current, held = names[head], []
                part = batch.slice(head, stop - head)
                lists = part.column(4)
                held.append([
                    part.column(2).to_numpy(zero_copy_only=False).copy(), part.column(3).to_numpy(zero_copy_only=False).copy(),
                    lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64),
                    lists.flatten().to_numpy(zero_copy_only=False).copy(),
                ])
        yield from linked(held)

    def linked(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if held:
            node, root, sizes, shingles = (np.concatenate(x) for x in zip(*held))
            left, right = _exact_links(root, sizes, shingles, similarity)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(node[left]), pa.array(node[right])], ["a", "b"])

    sized = sets.groupBy("family", "root").agg(F.sum(F.size("shingles")).alias("n"))
    crowded = tables.cut(
        sized.groupBy("family").agg(F.max_by("root", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
        .where(F.col("all") > VERIFIED)
        .select(
            "family", "main", F.ceil(F.col("most") / VERIFIED).cast("int").alias("mains"),
            F.greatest(F.ceil((F.col("all") - F.col("most")) / VERIFIED), F.lit(1)).cast("int").alias("rest"),
        ),
        "crowded",
    )
    of_main, spread, all_chunks = F.col("root") == F.col("main"), F.xxhash64("node"), F.col("mains") + F.col("rest")
    own = F.when(of_main, F.pmod(spread, F.col("mains"))).otherwise(F.col("mains") + F.pmod(spread, F.col("rest")))
    others = F.when(of_main, F.sequence(F.col("mains"), all_chunks - 1)).otherwise(F.sequence(F.lit(0), all_chunks - 1))
    parts = F.array_remove(others.cast("array<long>"), F.col("own"))
    dealt = (
        tables.lookup(sets, crowded, ["family"])
        .withColumn("own", own.cast("long"))
        .withColumn("other", F.explode(F.when(F.col("mains").isNotNull(), parts).otherwise(F.array(F.lit(0).cast("long")))))
        .withColumn("part", F.when(F.col("mains").isNotNull(), F.least("own", "other") * F.lit(1 << 31) + F.greatest("own", "other")).otherwise(0))
        .select("family", "part", "node", "root", "shingles")
    )
    return dealt.repartition("family", "part").sortWithinPartitions("family", "part").mapInArrow(verify, "a long, b long")


def _checked(candidates: DataFrame, texts: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """Components of the exact links among the documents that candidates join.

    A group of near copies has many candidates and needs few of them. So a few of each
    document are compared first. A family is what candidates join, directly or not; where
    its documents are still apart, all pairs of them from different components are
    decided. So it does not matter which of the candidates among a family were given out:
    two similar documents that both hang on a third unlike them meet all the same.
    """

    @F.pandas_udf("array<long>")
    def shingled(content: pd.Series) -> pd.Series:
        return pd.Series([_shingle_set(x, shingle_words).view(np.int64) for x in content], dtype=object)

    ends = candidates.select(F.inline(F.array(F.struct(F.col("a").alias("node"), "a", "b"), F.struct(F.col("b").alias("node"), "a", "b"))))
    first = tables.cut(
        tables.first_per_key(ends, ["node"], [F.xxhash64("a", "b")], FIRST_CHECKS).select("a", "b").distinct(), "first"
    )
    confirmed = _alike(first, texts, shingle_words, similarity)
    roots = components(confirmed)
    families = components(candidates).withColumnRenamed("root", "family")
    members = tables.cut(
        tables.lookup(families, roots, ["node"]).select("node", "family", F.coalesce("root", "node").alias("root")), "members"
    )
    apart = members.groupBy("family").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    apart = tables.cut(apart.select("family"), "apart")
    if apart.isEmpty():
        return roots
    wanted = tables.cut(tables.lookup(members, apart, ["family"], how="inner"), "wanted")
    sets = tables.cut(
        tables.lookup(texts, wanted, ["node"], how="inner").select("family", "node", "root", shingled("text").alias("shingles")), "sets"
    )
    return components(confirmed.unionByName(_family_links(sets, similarity)))


def _joined(docs: DataFrame, shingle_words: int, similarity: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(doc_id, digest, node, ...) of every row of (doc_id, text), one row per node, and (node, root) of joined nodes."""

    @F.pandas_udf("array<long>")
    def sketched(texts: pd.Series) -> pd.Series:
        found = [_set_sketch(_shingle_set(x, shingle_words)) for x in texts]
        return pd.Series(list(np.array(found, np.uint64).view(np.int64)), dtype=object)

    words = [f"w{i}" for i in range(WIDE_WORDS)]
    wide = docs.select("doc_id", _digest(F.col("text")).alias("digest"), sketched(F.col("text")).alias("sketch")).select(
        "doc_id", "digest", *(F.col("sketch")[i].alias(w) for i, w in enumerate([*words, "node"]))
    )
    hashed = tables.cut(wide, "sketches")
    distinct = tables.cut(
        hashed.groupBy("node", *words).agg(F.min("doc_id").alias("rep"), F.min("digest").alias("digest")), "distinct"
    )
    per_word = 2 * (MAX_DISTANCE + 1)
    keys = F.flatten(F.array(*(_keys(F.col(w), MAX_DISTANCE, per_word * i) for i, w in enumerate(words))))
    compared = words[:COMPARED_WORDS]
    keyed = distinct.select(F.explode(keys).alias("key"), "node", *compared)
    met = _linked_runs(keyed, compared, _wide_test(most_bits(similarity)))
    candidates = tables.cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    return hashed, distinct, _checked(candidates, _texts_of(candidates, distinct, docs), shingle_words, similarity)


def similar_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle_words: int = WIDE_SHINGLE_WORDS,
    similarity: float = WIDE_SIMILARITY,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) where documents have a Jaccard similarity of at least ``similarity``.

    A sketch of 320 bits is five SimHash words of the set of shingles, each counted once
    however often it occurs, as in the similarity. Each word is indexed
    by its pigeonring keys, fifty in all. Rows that share a key are compared over three
    of the words; those within the distance that SimHash expects at the similarity, and
    two standard deviations more, are candidates. The shingle sets of their whole texts
    decide, within everything that candidates join, so nothing below the similarity is ever
    linked and no unlike document stands between two alike. A pair right at the threshold
    shares no key in about one case of eight, nearer pairs hardly ever do. Texts with equal
    shingle sets are one. ``fingerprint`` is the set's hash. Odd rows are treated as in
    ``near_duplicates``.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    hashed, distinct, joined = _joined(docs, shingle_words, similarity)
    return _named(hashed.select("doc_id", "node"), distinct, joined, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar ones: the one with the smallest id.

    Rows without id come last, so one stays only where its whole group has no id. Where
    rows of a group share the smallest id, that with the smallest digest of its text stays;
    rows of other groups do not lose theirs by having the same id.
    """
    rows = packed(docs, doc_id=F.col(doc_id), text=F.col(text))
    hashed, _, joined = _joined(rows.drop("_in"), WIDE_SHINGLE_WORDS, WIDE_SIMILARITY)
    grouped = tables.lookup(hashed.select("doc_id", "digest", "node"), joined, ["node"])
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")
    best = grouped.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(order).alias("best"))
    name = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-"))
    kept = tables.cut(best.select("best.doc_id", "best.digest").select(name.alias("key"), "digest"), "kept")
    keyed = rows.select("_in", name.alias("key"), _digest(F.col("text")).alias("digest"))
    return tables.lookup(keyed, kept, ["key", "digest"], how="left_semi").dropDuplicates(["key", "digest"]).select("_in.*")
