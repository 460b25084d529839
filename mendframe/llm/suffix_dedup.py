"""Repeated passages by sorting suffixes in two stages.

Two equal strings of ``span`` bytes have the same anchor: the gram of ``GRAM`` bytes
inside them with the smallest hash. So suffixes are sorted per gram, and only those
whose gram stands at two places at least. The windows of one anchor form a piece of
text. A sort takes the pieces of whole grams: suffixes smaller than their successor
are sorted directly, all others follow by one scan of the buckets of first bytes.
Common prefixes of neighbours then tell which windows stand elsewhere, too.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mendframe.functions import tables
from mendframe.llm.common import map_batches, mixed, packed

SPAN = 400  # bytes of a string that must not come twice
GRAM = 160  # bytes of an anchor; fewer give fewer anchors, more give smaller sorts
READ = 1 << 18  # windows that are looked at together; bounds memory for long texts
PIECES = 1_024  # different pieces that a gram may bring into a sort; more are split by longer grams
SORTED = 1 << 20  # bytes of pieces that are sorted together, about

_END = 0xFF  # no byte of UTF-8
_MULTIPLIER = 0x9E3779B97F4A7C15
_PLACE_BITS = 24

# ---- anchors


@functools.lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, by doubling."""
    made, known = np.ones(n, np.uint64), 1
    while known < n:
        more = min(known, n - known)
        made[known : known + more] = made[:more] * np.uint64(pow(base, known, 1 << 64))
        known += more
    return made


def _gram_hashes(data: np.ndarray, gram: int, room: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from every place; equal bytes have equal hashes. ``room``: the most bytes ever."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_MULTIPLIER, room)[:n], out=sums[1:])
    down = _powers(pow(_MULTIPLIER, -1, 1 << 64), room)[: n - gram + 1]
    return mixed((sums[gram:] - sums[:-gram]) * down)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` values in a row."""
    rest = np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate([values, rest]).reshape(-1, width)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    onward = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(values) - width + 1
    return np.minimum(onward[:count], upto[width - 1 : width - 1 + count])


def anchors(data: bytes, span: int = SPAN, gram: int = GRAM) -> Iterator[tuple[int, int, int, int]]:
    """(place, first, past, gram hash) of every anchor: the windows that have it cover data[first:past].

    Every window of ``span`` bytes belongs to one anchor, which its content alone decides
    (the leftmost of equal grams). Windows are read in bounded numbers, so a long run of
    windows with one anchor may come in two parts.
    """
    for at in range(0, len(data) - span + 1, READ):
        part = np.frombuffer(data, np.uint8, min(READ + span - 1, len(data) - at), at)
        hashes = _gram_hashes(part, gram, READ + span)
        shift = np.uint64(_PLACE_BITS)
        keyed = (hashes >> shift << shift) | np.arange(len(hashes), dtype=np.uint64)
        place = (_least(keyed, span - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
        edges = np.flatnonzero(np.diff(place)) + 1
        first = np.concatenate([[0], edges])
        past = np.concatenate([edges, [len(place)]]) + span - 1
        where = place[first]
        yield from zip((where + at).tolist(), (first + at).tolist(), (past + at).tolist(), hashes[where].view(np.int64).tolist())


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text; rows of equal text share their result."""
    return F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32))


_ANCHORS = T.StructType(
    [T.StructField("key", T.BinaryType())]
    + [T.StructField(name, T.LongType()) for name in ("place", "first", "past", "gram")]
    + [T.StructField("piece", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("end", T.LongType())]
)


def anchor_table(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, place, first, past, gram, piece, n, end) of every anchor of (key, text).

    ``piece`` stands for the bytes first:past and the anchor's place there. Equal pieces
    one after another, as periodic text has them, are one row: the first of ``n``, whose
    windows together cover first:end.
    """

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[list] = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
            data, last = text.encode() if text else b"", None
            for place, first, past, hashed in anchors(data, span, gram):
                piece = xxhash.xxh3_128_digest(data[first:past], place - first)
                if piece == last:
                    rows[-1][6:] = rows[-1][6] + 1, past
                else:
                    rows.append([key, place, first, past, hashed, piece, 1, past])
                last = piece
        columns = zip(*rows) if rows else [()] * len(_ANCHORS)
        kinds = [pa.binary() if f.dataType == T.BinaryType() else pa.int64() for f in _ANCHORS]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _ANCHORS.names)

    return map_batches(texts, found, _ANCHORS)


# ---- sorting


def _rises(data: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successor; the last one is not."""
    step = np.zeros(len(data), np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1
    decides = np.where(step != 0, np.arange(len(data)), len(data))
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    return step[decides] > 0


def suffix_order(data: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places, their suffixes in order by the first ``depth`` bytes at least.

    ``wanted`` are sorted places with ``depth`` bytes behind them before the next ``_END``.
    Suffixes smaller than their successor are sorted directly. Any other begins with a
    byte not below its successor's, so one scan over the buckets of first bytes, in order,
    puts each behind the one that follows it in the text.
    """
    rises = _rises(data)
    next_rise = np.where(rises, np.arange(len(data)), len(data))
    next_rise = np.minimum.accumulate(next_rise[::-1])[::-1]
    taken = np.zeros(len(data) + 1, np.int32)  # wanted places, and what follows them up to a rise
    np.add.at(taken, wanted, 1)
    np.add.at(taken, next_rise[wanted] + 1, -1)
    part = np.cumsum(taken[:-1]) > 0

    direct = np.flatnonzero(part & rises)
    padded = np.concatenate([data, np.zeros(depth, np.uint8)])
    strings = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(strings).view(f"S{depth}").ravel(), kind="stable")]
    heads = np.searchsorted(data[direct], np.arange(257))

    induced = part & ~rises
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    order: list[np.ndarray] = []
    for byte in range(256):
        bucket, level = waiting[byte], np.concatenate(waiting[byte]) if waiting[byte] else direct[:0]
        while len(level):  # a byte before an induced suffix of the same byte
            before = level[level > 0] - 1
            level = before[induced[before] & (data[before] == byte)]
            bucket.append(level)
        bucket.append(direct[heads[byte] : heads[byte + 1]])
        whole = np.concatenate(bucket)
        order.append(whole)
        before = whole[whole > 0] - 1
        before = before[induced[before] & (data[before] > byte)]
        if len(before):
            at = np.argsort(data[before], kind="stable")
            before = before[at]
            values, starts = np.unique(data[before], return_index=True)
            for value, group in zip(values.tolist(), np.split(before, starts[1:])):
                waiting[value].append(group)
    ranked = np.concatenate(order)
    is_wanted = np.zeros(len(data), bool)
    is_wanted[wanted] = True
    return ranked[is_wanted[ranked]]


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int, step: int = 40) -> np.ndarray:
    """Bytes that each suffix but the last shares with the next in order, ``depth`` at most."""
    common = np.zeros(max(len(order) - 1, 0), np.int64)
    padded = np.concatenate([data, np.zeros(step, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, step)
    alive = np.arange(len(common))
    while len(alive):
        a, b = order[alive] + common[alive], order[alive + 1] + common[alive]
        same = windows[a] == windows[b]
        length = np.where(same.all(axis=1), step, same.argmin(axis=1))
        common[alive] += length
        alive = alive[(length == step) & (common[alive] < depth)]
    return np.minimum(common, depth)


def repeated_windows(pieces: list[bytes], span: int) -> list[np.ndarray]:
    """For each piece the places of its windows of ``span`` bytes that stand at another place of the pieces, too."""
    data = np.frombuffer(b"".join(p + bytes([_END]) for p in pieces), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(p) + 1 for p in pieces])])
    counts = np.array([len(p) - span + 1 for p in pieces])
    owner = np.repeat(np.arange(len(pieces)), counts)
    wanted = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[owner]
    order = suffix_order(data, wanted, span)
    equal = common_prefixes(data, order, span) >= span
    again = np.zeros(len(order), bool)
    again[:-1] |= equal
    again[1:] |= equal
    hit = np.sort(order[again])
    edges = np.searchsorted(hit, starts)
    return [hit[a:b] - s for a, b, s in zip(edges, edges[1:], starts)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    made: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if made and low <= made[-1][1]:
            made[-1] = made[-1][0], max(high, made[-1][1])
        else:
            made.append((low, high))
    return made


_SPANS = "key binary, low bigint, high bigint"
_KEPT = ("gram", "bytes", "key", "first")


def sort_pieces(pieces: DataFrame, span: int) -> DataFrame:
    """(key, low, high): spans that stand elsewhere, from (gram, piece, bytes, key, first).

    The pieces of a gram come into one sort. Rows without a key only serve to be found:
    their own places are known to be covered.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(name).to_pylist() for name in _KEPT)):
                if row[0] != last and size >= SORTED:
                    yield sorted_rows(rows)
                    rows, size = [], 0
                rows.append(row)
                size, last = size + len(row[1]), row[0]
        if rows:
            yield sorted_rows(rows)

    def sorted_rows(rows: list[tuple]) -> pa.RecordBatch:
        out: list[tuple] = []
        for (_, _, key, first), hits in zip(rows, repeated_windows([r[1] for r in rows], span)):
            if key is not None and len(hits):
                out += [(key, low + first, high + first) for low, high in _merged([(h, h + span) for h in hits.tolist()])]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())],
            ["key", "low", "high"],
        )

    dealt = pieces.select(*_KEPT).repartition("gram").sortWithinPartitions("gram")
    return dealt.mapInArrow(run, _SPANS)


# ---- pieces


def _cut_pieces(texts: DataFrame, places: DataFrame) -> DataFrame:
    """The bytes of (key, place, first, past, gram, piece, copies), each text read once, as (gram, piece, copies, key, first, place, bytes)."""
    asked = tables.cut(
        places.groupBy("key").agg(F.collect_list(F.struct("gram", "piece", "copies", "place", "first", "past")).alias("asked")), "asked"
    )
    held = tables.lookup(texts, asked.select("key"), ["key"], "left_semi")
    one = held.groupBy("key").agg(F.first("text").alias("text"))  # copies of a text meet map-side
    kind = "gram bigint, piece binary, copies bigint, key binary, first bigint, place bigint, bytes binary"

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for key, text, wanted in zip(*(batch.column(name).to_pylist() for name in ("key", "text", "asked"))):
            data = text.encode()
            for w in wanted:
                alone = key if w["copies"] == 1 else None
                rows.append((w["gram"], w["piece"], w["copies"], alone, w["first"], w["place"], data[w["first"] : w["past"]]))
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary())
        columns = zip(*rows) if rows else [()] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["gram", "piece", "copies", "key", "first", "place", "bytes"]
        )

    return map_batches(one.join(asked, "key"), found, kind)


def _split(pieces: DataFrame, size: int, span: int) -> DataFrame:
    """Every piece cut to its windows that begin ``size * i .. size * (i + 1) - 1`` bytes before the anchor, for each i.

    All windows of such a part share the bytes around the anchor that each of them must
    hold; these become the part's gram. At size 1 that is the window itself.
    """
    before = F.col("place") - F.col("first")  # bytes of the piece before its anchor
    far, near = before, before - (F.length("bytes") - span)  # first and last window, by their distance to the anchor
    part = F.sequence(F.floor(near / size), F.floor(far / size))
    cut = pieces.select("*", F.explode(part).alias("i"))
    low, high = F.greatest(near, F.col("i") * size), F.least(far, (F.col("i") + 1) * size - 1)
    cut = cut.select("gram", "piece", "copies", "key", "place", "first", "bytes", "i", low.alias("low"), high.alias("high"), before.alias("before"))

    def sub(start: Column, end: Column) -> Column:
        return F.substring(F.col("bytes"), (F.col("before") + start + 1).cast("int"), (end - start).cast("int"))

    # relative to the anchor, windows lie in [-high, span - low); all of a part share [-size * i, span - size * (i + 1) + 1)
    shared = sub(-F.col("i") * size, F.lit(span + 1) - (F.col("i") + 1) * size)
    own = sub(-F.col("high"), F.lit(span) - F.col("low"))
    return cut.select(
        F.xxhash64("gram", "i", F.lit(size), shared).alias("gram"),
        F.unhex(F.md5(F.concat(own, F.encode(F.concat_ws(",", "i", "low", "high"), "utf-8")))).alias("piece"),
        "copies", "key", "place", (F.col("place") - F.col("high")).alias("first"), own.alias("bytes"),
    )


def _decided(pieces: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, low, high) of all spans of pieces that stand elsewhere; grams of too many pieces are split first."""
    found: list[DataFrame] = []
    size = 1 << (span - gram).bit_length()
    while True:
        pieces = tables.cut(pieces, "pieces")
        variants = tables.cut(pieces.groupBy("gram").agg(F.count("*").alias("n")), "variants")
        crowded = variants.where(F.col("n") > PIECES).select("gram")
        few = tables.lookup(pieces, variants.where(F.col("n").between(2, PIECES)).select("gram"), ["gram"], "left_semi")
        found.append(tables.cut(sort_pieces(few, span), "spans"))
        if crowded.isEmpty():
            break
        size //= 2
        parts = tables.cut(_split(tables.lookup(pieces, crowded, ["gram"], "left_semi"), size, span), "parts")
        copies = parts.groupBy("gram", "piece").agg(F.sum("copies").alias("total"))
        counted = tables.cut(tables.lookup(parts, copies, ["gram", "piece"], "inner"), "counted")
        again = counted.where("total > 1")
        found.append(
            again.where("key is not null").select("key", F.col("first").alias("low"), (F.col("first") + F.length("bytes")).alias("high"))
        )
        witness = again.withColumn("key", F.lit(None).cast("binary")).dropDuplicates(["gram", "piece"])
        pieces = counted.where("total = 1").unionByName(witness).withColumn("copies", F.col("total")).drop("total")
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    return spans


def repeated_spans(texts: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, spans): bytes of each text of (key, text) under a string of ``span`` bytes that also starts elsewhere.

    Rows of equal text count as copies of each other. Texts without such bytes have no row.
    """
    found = tables.cut(anchor_table(texts, span, gram), "anchors")
    twice = tables.cut(found.groupBy("gram").agg(F.sum("n").alias("n")).where("n > 1").select("gram"), "twice")
    places = tables.cut(tables.lookup(found, twice, ["gram"], "left_semi"), "places")
    copies = tables.cut(places.groupBy("gram", "piece").agg(F.sum("n").alias("copies")), "copies")
    variants = copies.groupBy("gram").agg(F.count("*").alias("variants"))
    known = tables.cut(tables.lookup(copies, variants, ["gram"], "inner"), "known")
    places = tables.cut(tables.lookup(places, known, ["gram", "piece"], "inner"), "places")
    whole = places.where("copies > 1").select("key", F.col("first").alias("low"), F.col("end").alias("high"))
    mixed_grams = places.where("variants > 1").drop("variants")
    samples = mixed_grams.where("copies = 1").unionByName(mixed_grams.where("copies > 1").dropDuplicates(["gram", "piece"]))
    spans = whole.unionByName(_decided(_cut_pieces(texts, samples), span, gram))
    return spans.groupBy("key").agg(F.collect_set(F.struct("low", "high")).alias("spans"))


def without_repeated(rows: DataFrame, text: Column, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """Every row as ``_in`` with ``n_bytes``, the removed ``spans`` of its text and the bytes ``kept``.

    A byte goes if a string of ``span`` bytes over it starts at any other place too, in the
    same text or another; overlapping places count, and strings are judged on the input.
    Texts are taken in UTF-8, so what is kept may begin inside a character; NULL is empty.
    Shorter texts are kept whole. Of several copies none is left. NULL and repeated ids do
    not matter, rows of equal text are copies. ``gram`` bytes at most half a span are usual.
    """
    if not 8 <= gram < span:
        raise ValueError("a gram has 8 bytes at least and fewer than a span")
    work = packed(rows, text=text).withColumn("key", text_key(F.col("text")))
    texts = packed(rows, text=text).select(text_key(F.col("text")).alias("key"), "text").where(F.octet_length("text") >= span)
    spans = tables.cut(repeated_spans(texts, span, gram), "spans")
    joined = tables.lookup(work, spans, ["key"], "left").select("_in", "text", "spans")
    pair = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    made = T.StructType([
        work.schema["_in"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(pair)), T.StructField("kept", T.BinaryType()),
    ])
    pair_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def trim(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes, removed, left = [], [], []
        for value, found in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            data = value.encode() if value else b""
            gone = _merged([(s["low"], s["high"]) for s in found or ()])
            edges = [0, *(x for pair in gone for x in pair), len(data)]
            sizes.append(len(data))
            removed.append([{"start": a, "end": b} for a, b in gone])
            left.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
        return pa.RecordBatch.from_arrays(
            [batch.column("_in"), pa.array(sizes, pa.int64()), pa.array(removed, pair_type), pa.array(left, pa.binary())],
            ["_in", "n_bytes", "spans", "kept"],
        )

    return map_batches(joined, trim, made)


def digest_repeated(docs: DataFrame) -> DataFrame:
    """Per document its bytes, how many go in how many spans, and a digest of the rest."""
    trimmed = without_repeated(docs.select("doc_id", "text"), F.col("text"))
    length = F.aggregate("spans", F.lit(0).cast("long"), lambda sum_, s: sum_ + s["end"] - s["start"])
    return trimmed.select(
        F.col("_in.doc_id").alias("doc_id"), "n_bytes", length.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
